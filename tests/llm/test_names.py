"""Spellings of names, and components."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from patrika.llm.components import connected_components
from patrika.llm.names import abbreviates, align, deletes, edits, name_classes, name_pairs, words_of

SAME = [
    ("Federal Signal Maintenance Council", "FSMC"), ("Federal Signal Maintenance Council", "Fed. Signal Maint. Cncl."), ("Federal Signal Maintenance Council", "Council of Signal Maintenance (Federal)"),
    ("Zilla Parishad Pokagobad", "Pokagobad ZP"), ("Chief Data Entry Operator (Mechanical)", "Ch. D.E.O. (Mech.)"), ("Senior Store Keeper (Rural)", "Senior Storekeeper (Rural)"),
]
OTHER = [("Municipal Council Pokagobad", "Municipal Corporation Pokagobad"), ("Senior Clerk (Technical)", "Senior Clerk (Mechanical)"), ("National Tea Board", "Federal Tea Board"), ("District Court Abad", "District Court Xbad")]


def test_alignment():
    for a, b in SAME:
        assert align(words_of(a), words_of(b), set()) > 0, (a, b)
    for a, b in OTHER:
        assert align(words_of(a), words_of(b), set()) == 0, (a, b)
    assert abbreviates("jr", "junior") and not abbreviates("electrn", "electrical")


@given(st.text("abcd", min_size=1, max_size=7), st.text("abcd", min_size=1, max_size=7))
@settings(max_examples=300, deadline=None)
def test_shared_deletes_find_every_edit(a, b):
    """Words one edit apart, a swap included, share a word with at most one letter left out."""
    if edits(a, b) <= 1:
        assert deletes(a, 1) & deletes(b, 1)


def test_classes_and_cases(spark):
    names = ["Federal Signal Maintenance Council"] * 9 + ["Fdeeral Signal Maintenance Council", "FSMC", "The Federal Signal Maintenance Council", "Zilla Parishad Pokagobad", "Pokagobad ZP", "Zilla Parishad Jonasugad", "Jonasugad ZP", None, "", " ", "...", "x" * 5000]
    frame = spark.createDataFrame([("organization", n, 1) for n in names], "field_name string, name string, class_id int")
    pairs = {(r.name_a, r.name_b) for r in name_pairs(name_classes(frame, [])).collect()}
    assert ("FSMC", "Federal Signal Maintenance Council") in pairs and ("Pokagobad ZP", "Zilla Parishad Pokagobad") in pairs
    assert all(("Pokagobad" in a) == ("Pokagobad" in b) and a < b for a, b in pairs)
    assert name_pairs(name_classes(frame.limit(0), [])).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = {x: find(x) for x in parent}
    got = {int(r.node): int(r.component) for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_assignment_of_many_words():
    from itertools import permutations

    from patrika.llm.names import _matched

    long, short = "Federal Signal Maintenance Council Rural Health Education Board", "Fed. Sig. Maint. Cncl. Rur. Hlth. Educ. Bd."
    assert align(words_of(long), words_of(short), set()) > 0
    assert align(words_of(long), words_of(short.replace("Hlth", "Textl")), set()) == 0
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 5)
        values = [[rng.choice((0.0, 0.6, 0.8, 1.0)) for _ in range(rng.randrange(n, 6))]]
        values += [[rng.choice((0.0, 0.6, 0.8, 1.0)) for _ in values[0]] for _ in range(n - 1)]
        whole = [sum(values[i][j] for i, j in enumerate(p)) for p in permutations(range(len(values[0])), n) if all(values[i][j] > 0 for i, j in enumerate(p))]
        got = _matched(values)
        assert (got is None) == (not whole) and (got is None or abs(sum(values[i][j] for i, j in enumerate(got)) - max(whole)) < 1e-9 and len(set(got)) == n)


def test_initials_with_and_without_scope():
    from patrika.llm.names import keys_of

    keys = [set(keys_of(words_of(x), [1] * len(words_of(x)))) for x in ("Federal Txa Brd", "Txa Brd")]
    assert {k for k in keys[0] if k[0] == "i"} & keys[1]
