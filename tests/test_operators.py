"""Operators on small cases: nulls, ties, repeated rows, empty tables."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patrika.functions import urls
from patrika.operators import binary, listing, merge, resolve, sequences


def test_search_of_blank_query_keeps_rows(spark):
    rows = spark.createDataFrame([("aa bb",), (None,)], "t string")
    assert listing.token_search(rows, "  ", ["t"]).count() == 2
    assert listing.token_search(rows, "Bb aa", ["t"]).count() == 1
    assert listing.search_tokens("x") == ["x"]


def test_page_bounds(spark):
    rows = spark.range(5)
    with pytest.raises(ValueError):
        listing.page(rows, [F.col("id")], 0)
    assert listing.page(rows, [F.col("id")], 500, -3, clamp=True).count() == 5


def test_merge_policies(spark):
    table = spark.createDataFrame([(1, "a", "", 5), (2, "b", "x", 7), (3, None, None, None)], "k int, o string, f string, s int")
    batch = spark.createDataFrame([(1, "z", "new", 4), (2, None, "y", 9), (4, "n", "m", 1)], "k int, o string, f string, s int")
    out = {r.k: (r.o, r.f, r.s, r.changed) for r in merge.keyed_merge(table, batch, ["k"], overwrite=["o"], fill=["f"], touch=["s"]).collect()}
    assert out == {1: ("z", "new", 5, True), 2: ("b", "x", 9, False), 3: (None, None, None, False), 4: ("n", "m", 1, True)}
    assert merge.keyed_merge(table.limit(0), batch.limit(0), ["k"]).count() == 0


def test_insert_unseen_compares_nulls(spark):
    table = spark.createDataFrame([(None, 1)], "k int, v int")
    batch = spark.createDataFrame([(None, 2), (5, 3)], "k int, v int")
    assert {(r.k, r.v) for r in merge.insert_unseen(table, batch, ["k"]).collect()} == {(None, 1), (5, 3)}


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 4), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_limiter_equals_plain_log(times, limit, window):
    times = sorted(times)
    kept, want = [], []
    for t in times:
        ok = sum(1 for x in kept if x > t - window) < limit
        kept += [t] if ok else []
        want.append(ok)
    assert sequences.admit(times, limit, window) == want


def test_domain_suffix_needs_a_dot(spark):
    rows = spark.createDataFrame([(1, "https://www.jobs.gov.example/x"), (2, "http://notgov.example"), (3, None), (4, "gov.example:8080/a")], "id int, url string")
    domains = spark.createDataFrame([("gov.example",), ("jobs.gov.example",)], "d string")
    assert {r.id: r.matched for r in resolve.domain_match(rows, "id", F.col("url"), domains, "d").collect()} == {1: "jobs.gov.example", 2: None, 3: None, 4: "gov.example"}


@pytest.mark.parametrize("url, want", [("/a", "https://h.x/a"), ("b", "https://h.x/p/b"), ("//c.y/d", "https://c.y/d"), ("http://e", "http://e"), ("#f", None), ("javascript:x", None), ("", None)])
def test_absolute(spark, url, want):
    frame = spark.createDataFrame([(url, "https://h.x/p/q?z=/1")], "u string, b string")
    assert frame.select(urls.absolute(F.col("u"), F.col("b"))).first()[0] == want


def test_similar_titles_equals_all_pairs(spark):
    titles = ["chief engineer 2020", "chief engineer 2021", "Chief  engineer 2020", "other", None, ""]
    rows = spark.createDataFrame([(i, t, "o") for i, t in enumerate(titles)], "id int, t string, b string")
    got = {(r.id_a, r.id_b) for r in resolve.similar_titles(rows, "id", "t", [F.col("b")]).collect()}
    low = [(i, t.strip().lower()) for i, t in enumerate(titles) if t]
    assert got == {(i, j) for i, a in low for j, b in low if i < j and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.88}


@given(st.binary(max_size=200), st.integers(0, 200_000))
@settings(max_examples=100, deadline=None)
def test_jpeg_padding_is_exact(body, more):
    data = b"\xff\xd8" + body
    out = binary.pad_jpeg(data, len(data) + more)
    assert len(out) == len(data) + (more if more >= 4 else 0) and out.endswith(body)


def test_zip_and_candidates(spark):
    files = spark.createDataFrame([("a", "2.txt", b"x"), ("a", "1.txt", b"y"), ("b", "only", b"z")], "k string, n string, c binary")
    got = {r.k: r.n for r in binary.zipped(files, "k", "n", "c").collect()}
    assert got == {"a": "files.zip", "b": "only"}
    tries = spark.createDataFrame([(1, 10, "s"), (1, 30, "m"), (1, 60, "l"), (2, 70, "x"), (2, 90, "y")], "k int, size int, q string")
    assert {r.k: r.q for r in binary.pick_candidate(tries, "k", "size", F.lit(40), F.lit(80)).collect()} == {1: "m", 2: "x"}


def test_nested_chunks_hold_all_children_in_bounded_arrays(spark):
    parents = spark.createDataFrame([("hot",), ("one",), ("none",)], "k string")
    ids = [f"i{n:04d}" for n in range(1000)]
    children = spark.createDataFrame([("hot", i) for i in reversed(ids)] + [("one", "x"), ("gone", "y"), (None, "z")], "k string, item string")
    got = {(r.k, r.chunk): [x["item"] for x in r.items_] for r in listing.nested_chunks(parents, children, "k", ["item"], "items_", 64).collect()}
    assert got == {("hot", n): ids[64 * n : 64 * n + 64] for n in range(16)} | {("one", 0): ["x"], ("none", 0): []}
    assert {(r.k, r.chunk, len(r.items_)) for r in listing.nested_chunks(parents, children.limit(0), "k", ["item"], "items_", 64).collect()} == {("hot", 0, 0), ("one", 0, 0), ("none", 0, 0)}


def test_nested_chunks_query_reads_every_notice_type(spark, sf):
    from patrika.plans import registry
    from patrika.sources.tables import read_table

    rows = registry.queries()["nested_items_of_source"](spark, sf)
    items = read_table(spark, sf, "raw_items").join(read_table(spark, sf, "sources").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    assert rows.agg(F.sum("items")).first()[0] == items.select("source_id", "id").distinct().count()
    assert rows.agg(F.max("items")).first()[0] <= 1000


def test_best_and_pivot_cover_every_field(spark, sf):
    from patrika.plans import registry
    from patrika.sources.tables import read_table

    candidates = read_table(spark, sf, "field_candidates")
    pairs = {(r.job_id, r.field_name) for r in candidates.select("job_id", "field_name").distinct().collect()}
    best = [(r.job_id, r.field_name) for r in registry.queries()["best_and_runner_up"](spark, sf).collect()]
    assert len(best) == len(pairs) and set(best) == pairs
    told = {(r.job_id, r.field_name) for r in candidates.where("value is not null").select("job_id", "field_name").distinct().collect()}
    pivoted = registry.queries()["field_pivot"](spark, sf).collect()
    assert {(r.job_id, f) for r in pivoted for f in r.asDict() if f != "job_id" and r[f] is not None} == told
