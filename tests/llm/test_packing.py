"""Packing: whole, within capacity, and as full as plain best fit."""

import math
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from patrika.llm import packing
from patrika.llm.packing import best_fit_plan, fill_report, pack, token_counts


def plain_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@given(st.lists(st.integers(1, 24), max_size=120), st.integers(24, 60))
@settings(max_examples=200, deadline=None)
def test_plan_equals_plain_best_fit(sizes, capacity):
    runs, opened = best_fit_plan(dict(Counter(sizes)), capacity)
    load, seen = defaultdict(int), Counter()
    for size, rank, n, container, per in runs:
        for k in range(n):
            load[container + k // per] += size
            seen[size, rank + k] += 1
    assert len(load) == opened == plain_best_fit(sizes, capacity)
    assert all(x <= capacity for x in load.values()) and set(seen.values()) <= {1} and len(seen) == len(sizes)


def check(spark, rows, capacities):
    out = pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint, capacity_tokens string"), capacities).collect()
    for cap in capacities:
        load, pieces = defaultdict(int), Counter()
        for r in out:
            if r.capacity_tokens == cap:
                load[r.container_no] += r.tokens
                pieces[r.doc_id, r.piece_no] += 1
        assert not load or max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        want = Counter((d, k) for d, n, _ in rows for k in range(math.ceil((n or 0) / cap)))
        assert pieces == want
    return out


def test_pack_is_whole(spark, monkeypatch):
    rows = [(i, (i * 37) % 90, "x") for i in range(300)] + [(1000, 0, None), (1001, 5000, None), (7, 3, None)]
    first = check(spark, rows, [64, 100])
    monkeypatch.setattr(packing, "RANKED", 2)
    salted = check(spark, rows, [64, 100])
    assert len(first) == len(salted)
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), [8]).count() == 0


def test_tokens_and_fill(spark):
    texts = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "हिन्दी <|endoftext|>")], "doc_id bigint, text string")
    counts = {r.doc_id: r.tokens for r in token_counts(texts).collect()}
    assert counts[1] == 2 and counts[2] == 0 and 3 not in counts and counts[4] > 5
    report = fill_report(pack(token_counts(texts), [16])).collect()[0]
    assert report.containers >= report.least_possible
