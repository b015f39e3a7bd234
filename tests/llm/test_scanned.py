"""Scanned texts: noise put in is found again."""

import random

import pytest

from patrika.llm.scanned import LETTER_SLIPS, Reader, _count_words, apply, fit_editor, furniture_lines, repair_scans
from patrika.sources.tables import read_table


@pytest.fixture(scope="module")
def editor(spark, folder):
    jobs = read_table(spark, folder, "jobs").selectExpr("detailed_description as text")
    return fit_editor(jobs.unionByName(read_table(spark, folder, "raw_notifications").selectExpr("pdf_text as text")))[0]


def test_spoilt_words_held_out(editor):
    """Accuracy on words spoilt with another seed than training's: what is changed is found, what is whole is kept."""
    rng = random.Random(99)
    words = [w for w, n in editor.counts.items() if n >= 30 and w.isalpha() and len(w) > 3]
    reader = Reader(editor)
    kept = sum(not reader.edits(w) for w in words) / len(words)
    found = tried = 0
    for word in words:
        places = [(i, a, b) for a, b in LETTER_SLIPS[:15] for i in range(len(word)) if word.startswith(b, i)]
        if places:
            i, wrong, right = rng.choice(places)
            spoilt = word[:i] + wrong + word[i + len(right) :]
            if spoilt not in editor.counts:
                tried += 1
                found += bool(reader.edits(spoilt))
    assert kept > 0.97 and found / tried > 0.95


def test_reading(editor):
    text = "Federal Board - 2023          1\nThe fee is non-refundable and must be paid by the appli-\ncants witb the certificate. Applicants are self-\nattested here.\n\nTotal number of posts advertised:\n84\n          - 1 -\nFederal Board - 2023          2\nThe gates close early."
    found, repaired = Reader(editor).read(text)
    assert set(found) == {(1, "furniture"), (8, "furniture"), (9, "furniture"), (2, "hyphen"), (3, "misread")}
    assert "applicants with the certificate" in repaired and "self-attested" in repaired and "84" in repaired


def test_furniture_needs_a_page():
    assert furniture_lines(["one line of text."]) == set()
    assert furniture_lines([]) == set()


def test_cases(spark, editor):
    frame = spark.createDataFrame([("f", "a", None, 1), ("f", "b", "", 1), ("f", "c", "x" * 200_000, 1), ("f", "d", "\n\n", 1), (None, None, "plain text", 1)], "field_name string, record_id string, text string, line_no int")
    rows = {r.record_id: r for r in repair_scans(frame, (editor, {})).collect()}
    assert rows["a"].repaired is None and rows["b"].repaired == "" and len(rows["c"].repaired) == 200_000 and not rows["d"].defects
    assert repair_scans(frame.limit(0), (editor, {})).count() == 0
    assert fit_editor(frame.limit(0))[0].counts == {}
    assert list(_count_words(iter([])))[0].num_rows == 0


def test_one_wide_line_leaves_the_furniture():
    page = ["The fee is non-refundable and must be paid by the applicant.", "It is due before the last date given above, in full."] * 10
    wide = [*page, "row " * 60, "- 1 -", *page]
    assert furniture_lines(wide) == {21}
    assert furniture_lines(["row " * 60, "row " * 70, "- 1 -", *page[:2]]) == set()


def test_decisions_made_before_change_nothing(spark, folder):
    texts = read_table(spark, folder, "raw_notifications").selectExpr("'pdf_text' as field_name", "canonical_key as record_id", "pdf_text as text").distinct()
    editor, decided = fit_editor(texts)
    assert decided
    show = lambda known: sorted((r.record_id, r.repaired or "", tuple(r.defects)) for r in repair_scans(texts, (editor, known)).collect())
    assert show(decided) == show({})


def test_joins_held_out(editor):
    """Words split at random places, and words with a hyphen of their own, that training did not see as such."""
    rng = random.Random(5)
    reader = Reader(editor)
    words = [w for w, n in editor.counts.items() if n >= 10 and w.isalpha() and w.isascii() and len(w) > 5]
    joined = [reader.split_here(w[:k], w[k:], "-") for w in words for k in (rng.randrange(2, len(w) - 2),)]
    own = [w.split("-") for w, n in editor.counts.items() if n >= 3 and w.count("-") == 1 and all(p.isalpha() for p in w.split("-"))]
    assert sum(joined) / len(joined) > 0.97 and sum(not reader.split_here(a, b, "-") for a, b in own) / len(own) > 0.9


def test_lost_and_added_letters(editor):
    """A letter lost from or doubled in a frequent word is put right, and is no misread line."""
    rng = random.Random(6)
    words = [w for w, n in editor.counts.items() if n >= 100 and w.isalpha() and w.isascii() and len(w) > 7]
    found = tried = 0
    for word in words:
        i = rng.randrange(1, len(word) - 1)
        for shown in (word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:]):
            if shown not in editor.counts:
                tried += 1
                edits = Reader(editor).edits(shown)
                found += bool(edits)
    assert tried and found / tried > 0.8
    defects, repaired = Reader(editor).read("Every candidate must bring the certifcate to the hall.\nIt is kept there.")
    assert "certificate" in repaired and not [d for d in defects if d[1] == "misread"]


def test_long_words_with_many_places(editor):
    """More places for slips than any cap: two slips in a long word of the texts are still undone."""
    word = "illicitly" * 4
    editor.counts[word] = 500
    try:
        twice = word.replace("i", "1", 2)
        assert word in {apply(twice, e) for e in editor.candidates(twice)}
    finally:
        del editor.counts[word]
