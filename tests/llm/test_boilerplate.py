"""Main bodies of pages."""

from patrika.llm.boilerplate import body_lines, is_prompt, main_lines, main_text
from patrika.sources.tables import read_table

PAGE = """<html><head><title>The Title</title><script>x</script></head><body><div class="a1"><p>Site</p><li><a href="/x">Home</a></li><li><a href="/y">Contact</a></li></div>
<div class="b2"><h1>The Title</h1><p>Posted on 1 May 2020 by web team | 55 views</p><p>A long paragraph, with commas, and words enough to count as one of the main body, surely.</p>
<table><tr><td>Fee:</td><td> 100</td></tr></table><p>Print this page</p></div><div class="c3"><h4>Follow us</h4><li><a href="/z">Other notice of another body, 2020</a></li></div>
<div class="d4"><p>Matter shown here is meant as information, and nothing more than that.</p></div></body></html>"""
TEXT = "Site\nHome\nContact\n\nThe Title\nPosted on 1 May 2020 by web team | 55 views\nA long paragraph, with commas, and words enough to count as one of the main body, surely.\nFee: 100\nPrint this page\nFollow us\nOther notice of another body, 2020\nMatter shown here is meant as information, and nothing more than that."
SCHEMA = "id string, raw_html string, raw_text string, title_raw string, line_no int, form string"


def test_tree_keeps_the_notice():
    marks = body_lines(TEXT, PAGE)
    kept = [n for n, (line, ok) in enumerate(zip(TEXT.split("\n"), marks), 1) if ok and not is_prompt(line)]
    assert kept == [5, 7, 8]


def test_cases_and_clashing_columns(spark):
    rows = [("a", PAGE, TEXT, "The Title", 1, "x"), ("a", PAGE, TEXT, "The Title", 1, "x"), ("b", None, None, None, None, None), ("c", "", "  \n", "t", None, None), ("d", "no markup", "no markup", None, None, None),
            ("e", "<div>" * 5000, "x", "y", None, None), ("f", None, TEXT, "The Title", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.raw_item_id, r.line_no) for r in main_lines(frame).collect()}
    assert {n for i, n in got if i == "a"} == {5, 7, 8}
    # without HTML the same lines are told by what is known of their forms
    assert {5, 7, 8} <= {n for i, n in got if i == "f"} and not {1, 2, 3, 9} & {n for i, n in got if i == "f"}
    assert not [x for x in got if x[0] in "bc"]
    assert main_lines(frame.limit(0)).count() == 0
    assert {r.raw_item_id for r in main_text(frame).collect()} >= {"a", "f"}


def test_body_starts_at_the_title(spark, folder):
    pages = read_table(spark, folder, "raw_items").where("raw_html is not null and raw_text is not null").dropDuplicates(["id"])
    first = {r.raw_item_id: r.n for r in main_lines(pages).groupBy("raw_item_id").agg({"line_no": "min"}).withColumnRenamed("min(line_no)", "n").collect()}
    for r in pages.collect():
        lines = r.raw_text.split("\n")
        assert "".join(lines[first[r.id] - 1].split()).lower() == "".join(r.title_raw.split()).lower()


def test_a_long_menu_without_lines_is_passed_over():
    menu = '<div class="m0">' + "".join(f'<li><a href="/{i}">Option number {i}</a></li>' for i in range(200)) + "</div>"
    page, text = PAGE.replace('<div class="b2">', menu + '<div class="b2">'), "A line of no block\n" + TEXT
    assert [n for n, ok in enumerate(body_lines(text, page), 1) if ok] == [n + 1 for n, ok in enumerate(body_lines(TEXT, PAGE), 1) if ok]
    # a line whose only block lies far ahead does not take the lines before it along
    strayed = text.replace("A line of no block", "Follow us")
    assert body_lines(strayed, page)[5:10] == body_lines(text, page)[5:10]


def test_long_lines_keep_their_own_form():
    from patrika.llm.boilerplate import line_form

    start = "Word " * 40
    assert line_form(start + "ends here.") != line_form(start + "Menu") and line_form(start + "in 2020.") == line_form(start + " in 1999.")
    assert line_form(start + "ends here.")[-1] == "." and line_form(start + "Menu")[-1] == "u" and line_form("Short 12") == "short 9"
