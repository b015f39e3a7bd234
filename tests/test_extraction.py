"""Functions of titles, texts and addresses on what the tables hold seldom."""

import datetime

from pyspark.sql import functions as F

from patrika.functions import extract, text, titles, urls
from patrika.operators import feeds, parsers


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first().x


def test_category_vacancies(spark):
    of = lambda v: column(spark, v, extract.category_vacancies)
    assert tuple(of("Total 1 2 3 4 5 15 1")) == (1, 2, 3, 4, 5, 15)
    assert tuple(of("total 1 -- 3 5 9")) == (1, 0, 3, None, 5, 9)
    # the later line adds up and has the greater total
    assert of("Total 1 1 1 1 1 0\nx\nTotal 2 2 2 2 2 10")["total"] == 10
    assert of("Total 9 9 9 9 9 45\nTotal 2 2 2 2 2 10")["total"] == 45
    assert of("Total 1 2 3") is None and of("") is None and of(None) is None
    total = lambda v: column(spark, v, lambda c: extract.vacancy_total(c, extract.category_vacancies(c)))
    assert total("Total 1 2 3 4 5 15") == 15 and total("Total vacancies: 1,200") == 1200 and total("2,345 posts") == 2345 and total("") is None


def test_fees_and_ages(spark):
    area = column(spark, "x\nFee for General: Rs 1,100 \n SC/ST: Nil\nWomen: 50\nlater ST 9", extract.fee_area)
    assert area == "Fee for General: Rs 1,100\nSC/ST: Nil\nWomen: 50"
    of = lambda name: column(spark, area, lambda c: extract.amount_for(c, extract.FEE_CATEGORIES[name]))
    assert (of("general"), of("sc_st"), of("female"), of("disabled")) == (1100, 0, 50, None)
    ages = lambda v: [column(spark, v, lambda c, k=k: extract.stated_ages(c)[k]) for k in (0, 1)]
    assert ages("Age limit: 18 to 35 years") == [18, 35] and ages("Minimum age 21, max age: 40") == [21, 40] and ages("none") == [None, None]


def test_dates(spark):
    day = lambda v: column(spark, v, extract.parse_date)
    assert day("31-02-2026") == datetime.date(2026, 3, 3) and day("5.1.24") == datetime.date(2024, 1, 5)
    assert day("12 January 2024,") == day("Jan 12, 2024") == datetime.date(2024, 1, 12)
    assert day("soon") is None and day("") is None and day(None) is None and day("40 March 2024") is None


def test_values(spark):
    assert column(spark, "  Pay level 7 ", lambda c: extract.sanitized(c, 20, require=extract.PAY_WORDS)) == "Pay level 7"
    assert column(spark, "click here", lambda c: extract.sanitized(c, 20)) is None and column(spark, "x" * 21, lambda c: extract.sanitized(c, 20)) is None
    assert column(spark, "Exam Centre: : Delhi ; Pune", lambda c: extract.line_value(c, extract.LINE_VALUES["centres"])) == "Delhi ; Pune"
    assert column(spark, "about 1,200.5", extract.to_number) == 1200.5 and column(spark, "not mentioned", extract.to_number) == 0 and column(spark, "1-2", extract.to_number) is None


def test_titles(spark):
    name = lambda title, preferred=None: spark.range(1).select(titles.exam_name(F.lit(title), F.lit(title), F.lit("SSC"), F.lit(preferred).cast("string")).alias("x")).first().x
    assert name("RECRUITMENT OF SBI CLERKS (Apply Online from 1.2.2025) 2025-26") == "Sbi Clerks 2025-26".replace("Sbi", "SBI")
    assert name("x", "Junior Engineer Examination 2024") == "Junior Engineer Examination 2024"
    assert column(spark, "page 1\nEngagement of Officers in the cadre\nApply now", titles.best_heading) == "Engagement of Officers in the cadre"
    assert column(spark, "", titles.best_heading) is None and column(spark, "S.S.C. Exam", text.slugify) == "ssc-exam"


def test_urls(spark):
    assert column(spark, "a\\b c//d", urls.attachment_path) == "a/b%20c/d"
    assert column(spark, "https://x.y/z/Some_Name+2.html", urls.title_of_url) == "Some Name 2"
    assert column(spark, "see (https://a.gov.example/x), a.gov.example/y or http://other.example", lambda c: urls.urls_of_text(c, ["gov.example"])) == ["https://a.gov.example/x", "https://gov.example/x", "https://gov.example/y"]


def test_links_and_pages(spark):
    page = "<a href='/a.pdf'><b>One &amp; two</b></a><A class=x HREF=b>Apply</A><a>none</a><a href=\"#x\">skip</a>"
    rows = [tuple(r) for r in parsers.links(spark.createDataFrame([(1, page, "https://h.example/d/i.html"), (2, None, None), (3, "", "x")], "ident int, page string, base string")).collect()]
    assert rows == [(1, 0, "One & two", "https://h.example/a.pdf"), (1, 1, "Apply", "https://h.example/d/b")]
    made = spark.range(1).select(feeds.link_array((F.lit("u"), "apply", "A", False), (F.lit("u"), "apply", "B", True), (F.lit(" "), "apply", "C", True), (F.lit("u"), "pdf", "D", True)).alias("l")).first().l
    assert [(x.kind, x.label) for x in made] == [("apply", "A"), ("pdf", "D")]


def test_either_column(spark):
    rows = spark.createDataFrame([("a", "u", None), ("b", None, "u"), ("c", "", "v"), ("d", "w", "v"), ("e", None, None)], "id string, x string, y string")
    assert sorted(tuple(r) for r in feeds.either_column_duplicates(rows, "id", "x", "y").collect()) == [("a", "b"), ("b", "a"), ("c", "d")]
