"""Titles of one notice."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from patrika.llm import titles
from patrika.llm.names import align
from patrika.llm.titles import VantageTree, fingerprint, home_and_asked, notice_classes, notice_pairs, plan_shards, read_title, shards_of, stage_of

MASK = 2**64 - 1


def halves(points):
    return np.array([[p >> 64, p & MASK] for p in points], dtype=np.uint64)


@given(st.lists(st.integers(0, 2**128 - 1), min_size=1, max_size=120), st.integers(0, 70), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_tree_equals_all_distances(points, radius, twist):
    points = points + [p ^ (1 << (7 * twist)) for p in points]
    tree = VantageTree(halves(points), leaf=4)
    for p in points[:5]:
        want = {i for i, q in enumerate(points) if (p ^ q).bit_count() <= radius}
        assert set(tree.within(halves([p])[0], radius)) == want
    got = [(i, j) for a, b in tree.pairs(radius, 7) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= radius]


@given(st.lists(st.integers(0, 2**128 - 1), min_size=8, max_size=60), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_shards_lose_no_pair(points, radius):
    points = points + [p ^ 5 for p in points]
    levels = plan_shards([(p >> 64, p & MASK) for p in points], 3)
    where = [set(shards_of(p, levels, radius)) for p in points]
    assert all(where)
    for i, p in enumerate(points):
        for j, q in enumerate(points):
            if (p ^ q).bit_count() <= radius:
                assert where[i] & where[j]


@given(st.lists(st.integers(0, 2**128 - 1), min_size=8, max_size=60), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_each_pair_meets_in_one_shard(points, radius):
    points = points + [p ^ 5 for p in points]
    levels = plan_shards([(p >> 64, p & MASK) for p in points], 3)
    where = [home_and_asked(p, levels, radius) for p in points]
    for i, p in enumerate(points):
        for j in range(i):
            met = (where[i][0] == where[j][0]) + (where[i][0] in where[j][1]) + (where[j][0] in where[i][1])
            assert met <= 1 and (met or (p ^ points[j]).bit_count() > radius)


WORDS = ["senior", "sr", "junior", "jr", "clerk", "clerks", "civil", "national", "state", "=zp", "zp", "zilla", "parishad", "zillaparishad", "pokagobad", "bokagobad", "pokagobd", "jonasugad", "s", "=sc", "scc", "=", "क्लर्क"]


@given(st.lists(st.tuples(*[st.lists(st.sampled_from(WORDS), min_size=1, max_size=7, unique=True)] * 2), min_size=1, max_size=20))
@settings(max_examples=300, deadline=None)
def test_no_aligned_lists_are_ruled_out(pairs):
    words = titles._Words()
    a, b = (words([" ".join(sorted(p[k])) for p in pairs]) for k in (0, 1))
    for (left, right), may in zip(pairs, words.may_align(a, b)):
        assert may or not align(sorted(left), sorted(right), set())


def test_links_of_titles_that_differ_in_place(monkeypatch):
    rng = random.Random(3)
    places = ["".join(rng.choice("bdgjkmnprstv") + rng.choice("aeiou") for _ in range(3)) + "gad" for _ in range(200)]
    sigs = sorted({f"civil clerk {p} senior" for p in places} | {f"civil clerk {p} sr" for p in places[:3]})
    points = [fingerprint(s.split(" "), {"civil", "clerk", "senior", "sr"}) for s in sigs]
    levels = plan_shards(points, 3)
    rows = []
    for sig, (high, low) in zip(sigs, points):
        home, asked = home_and_asked((high & MASK) << 64 | (low & MASK), levels, 6)
        rows += [("t", "2022", "", "", shard, shard != home, sig, high, low) for shard in (home, *asked)]
    rows.sort(key=lambda r: r[4:6])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["field_name", "year", "stage", "number", "shard", "asks", "sig", "high", "low"])
    tried = []
    monkeypatch.setattr(titles, "align", lambda *lists: tried.append(lists) or align(*lists))
    got = [frozenset((r["src"], r["dst"])) for out in titles._links(6)(iter([batch])) for r in out.to_pylist()]
    bits = [(h & MASK) << 64 | (low & MASK) for h, low in points]
    near = [(i, j) for i in range(len(sigs)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 6]
    want = [frozenset((sigs[i], sigs[j])) for i, j in near if align(sigs[i].split(" "), sigs[j].split(" "), set())]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want)) and len(want) >= 3
    # nearly all pairs of places are ruled out by their letters
    assert len(near) > 5000 and len(tried) < len(near) / 10


def test_read_title():
    assert read_title("X Board Result for Clerk 2022 (Notice 71234/2022)")[::2] == ("2022", "71234")
    assert read_title("Latest: X Board - Result for Clerk 2022 - (Notification No. 5 of 2022) PDF")[::2] == ("2022", "5")
    assert read_title("Stenographer 2019 60 Posts (Notice  8/2019)")[2] == "8"
    assert stage_of(["police", "recruitment", "cell", "abad", "admit", "card"]) == ("admit_card", ["police", "recruitment", "cell", "abad"])


def test_classes_and_cases(spark):
    same = ["Zilla Parishad Pokagobad Recruitment to the post of Senior Clerk (Civil) 2022 5 Posts (Advt. No. 1/2022)", "PDF | zilla parishad pokagobad - recruitmnet to the post of Sr. Clerk (Civil) 2022 - (No. 1/22)",
            "Recruitment of Senior Clerk (Civil) 2022: Zilla Parishad Pokagobad (Notice 1/2022)"]
    other = [same[0].replace("2022", "2023"), same[0].replace("No. 1/", "No. 2/"), same[0].replace("Recruitment to", "Result for"), same[0].replace("Senior", "Junior"), same[0].replace("Pokagobad", "Jonasugad"), same[0].replace("Civil", "Hindi")]
    rows = [(f"s{i}", t) for i, t in enumerate(same)] + [("s0", same[0]), ("copy", same[0])] + [(f"o{i}", t) for i, t in enumerate(other)] + [("n", None), ("e", ""), ("w", "..."), (None, same[0]), ("long", "word " * 2000)]
    # word counts are those of a corpus: repeat the words so that they are known
    corpus = [(f"c{i}", t) for i in range(30) for t in (same[0], *other)]
    frame = spark.createDataFrame([("t", i, t, 1) for i, t in rows], "field_name string, id string, title string, number int")
    known = frame.unionByName(spark.createDataFrame([("t", i, t, 1) for i, t in corpus], frame.schema))
    for shard_rows in (4000, 1):
        pairs = {(r.id_a, r.id_b) for r in notice_pairs(frame, notice_classes(known, shard_rows=shard_rows)).collect()}
        assert pairs == {(a, b) for a in ("copy", "s0", "s1", "s2") for b in ("copy", "s0", "s1", "s2") if a < b}
    assert notice_pairs(frame.limit(0), notice_classes(frame.limit(0))).count() == 0
