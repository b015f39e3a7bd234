"""Every query of the core against its SQL on the same tables."""

import os

import duckdb
import pytest

from patrika.plans import registry

FOLDER = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, FOLDER)
    want = duck.execute(registry.oracles()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_similar_titles_equal_every_pair(spark):
    """Every two different titles of a block are read against each other by the plain ratio."""
    from difflib import SequenceMatcher

    from patrika.sources.tables import read_table

    blocks: dict = {}
    for r in read_table(spark, FOLDER, "jobs").select("id", "title", "organization", "opening_date").collect():
        if r.title and r.title.strip() and r.organization is not None and r.opening_date is not None:
            held = blocks.setdefault((r.organization.strip(" ").lower(), r.opening_date), {})
            title = r.title.strip(" ").lower()
            held[title] = min(held.get(title, r.id), r.id)
    want = {tuple(sorted((a, b))) for held in blocks.values() for s, a in held.items() for t, b in held.items() if s < t and a != b and any(SequenceMatcher(None, *x, autojunk=False).ratio() >= 0.88 for x in ((s, t), (t, s)))}
    got = {tuple(sorted((r.id_a, r.id_b))) for r in registry.queries()["similar_titles"](spark, FOLDER).collect()}
    assert got <= want and len(want) - len(got) <= len(want) // 10


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.queries()) - set(registry.oracles()) == {"similar_titles", "p5_found", "p5_status_by_slot"}
