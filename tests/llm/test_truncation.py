"""Texts cut off before their end."""

from patrika.llm import truncation
from patrika.llm.truncation import StackAutomaton, find_truncated, open_brackets, read_text, sentences, truncation_by_source

SENTENCES = ["The fee must be paid before the last date given above.", "Candidates shall report at the centre in good time.", "Selected persons are placed on probation for two years."]


def corpus():
    return [(i, " ".join(SENTENCES), "a") for i in range(40)] + [(100 + i, SENTENCES[0] + "\n\nSd/-\nMember Secretary\nFederal Board", "a") for i in range(20)] + [(200 + i, "1. Reasoning\n2. Surveying", "b") for i in range(20)]


CASES = [
    (1000, SENTENCES[0] + " Candidates shall report at the cen", True), (1001, SENTENCES[0] + "\n\nSelected persons are placed", True), (1002, SENTENCES[0] + " Candidates shall rep…", True),
    (1003, SENTENCES[0] + " Candidates shall report at�", True), (1004, SENTENCES[0] + " Candidates shall [more]", True), (1005, SENTENCES[0], False), (1006, SENTENCES[0] + "\n\nSd/-\nMember Secretary\nOther Board", False),
    (1007, "1. Reasoning\n2. Field safety", False), (1008, None, False), (1009, "", False), (1010, " \n ", False), (1011, SENTENCES[0] * 3000, False),
]


def test_cases(spark):
    rows = [(d, t, s, "x") for d, t, s in corpus()] + [(d, t, None if d % 2 else "c", "x") for d, t, _ in CASES]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, flags string")
    found = find_truncated(frame)
    got = {r.doc_id: r.cut for r in found.collect()}
    assert {d: got[d] for d, _, _ in CASES} == {d: c for d, _, c in CASES}
    assert not any(got[d] for d, _, _ in corpus())
    rates = {r.source: (r.documents, r.cut_documents) for r in truncation_by_source(found).collect()}
    assert rates["a"] == (60, 0) and rates[None] == (6, 2)
    assert find_truncated(frame.limit(0)).count() == 0


def test_automaton():
    assert open_brackets("a (b [c] d") == 1 and open_brackets("a ) b") == 0 and open_brackets("“x”") == 0
    broken = lambda text: bool(read_text(text)[1] & truncation.BROKEN)
    assert broken("text &am") and broken("a <di") and broken('a <div class="x y') and broken("x\\u09") and broken("x%2") and broken("भाष�")
    assert not broken("50% of") and not broken("a < b") and not broken("<b>x</b>") and not broken("AT&T") and read_text("A. B (see")[1] & truncation.OPEN_BRACKET
    assert read_text("One. Two (three")[1] & truncation.UNENDED and not read_text("One. Two (three).")[1] & (truncation.UNENDED | truncation.OPEN_BRACKET)
    assert sentences('He said "go." Then No. 4 came.\nA line\nwrapped one') == ['He said "go."', "Then No. 4 came.", "A line wrapped one"]


def test_rows_vanish_without_the_stack(spark, monkeypatch):
    """Planted open quotes, brackets, tags and escapes are found by what the automaton leaves on its stack, and by nothing else."""
    start = SENTENCES[0] + "\n\n"
    ends = ['Quoted "as the notice has it', "Bracketed (as the notice has it", "Braced [as the notice has it", "Marked <em>as the notice has it", "Tagged <a href", "Escaped as &am", "Escaped as \\u09", "Candidates shall report at the"]
    rows = [(d, t, s) for d, t, s in corpus()] + [(1000 + i, start + end, "c") for i, end in enumerate(ends)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in find_truncated(frame).where("cut").collect()} == {1000 + i for i in range(len(ends))}
    monkeypatch.setattr(StackAutomaton, "flags", lambda self: 0)
    assert find_truncated(frame).where("cut").count() == 0


def test_brackets_open_before_the_last_paragraph(spark):
    closed = "Note (see below)\n\n" + "Zinc plates\n" * 600 + "Zebra quartz"
    opened = [closed.replace(")", ""), closed.replace("(see below)", '"see below'), closed.replace("(see below)", "<b>see below")]
    texts = [t.replace("Zebra", word) for t, word in zip([closed, *opened], ("Zebra", "Yarrow", "Xenon", "Walnut"))]
    rows = [(d, t, s) for d, t, s in corpus()] + [(1000 + i, t, "c") for i, t in enumerate(texts)]
    got = {r.doc_id: r.cut for r in find_truncated(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [got[1000 + i] for i in range(4)] == [False, True, True, True]


def test_quotes_and_elements():
    assert open_brackets('say "x') == 1 and open_brackets('("x") "y"') == 0 and open_brackets('a 5" pipe, and 6 "') == 0
    assert open_brackets("<B>x <p>y") == 1 and open_brackets("<b><i>x</b></i><br> (a <b>c) d</b>") == 0 and open_brackets("a < b > c <name>") == 0
