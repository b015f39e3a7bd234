"""The page and payload parsers. Each query lays the rows of a table out as pages of the kind its parser reads; its SQL reads the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patrika.operators import parsers
from patrika.plans.records import registrar

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

_DAY = "strftime(published_on AT TIME ZONE 'UTC','%Y-%m-%d')"
_N = "(SELECT DISTINCT canonical_key AS ident, source_key, title, trim(regexp_replace(title,'\\s+',' ','g')) AS t, detail_url, pdf_url, apply_url, exam_id, CAST(published_on AT TIME ZONE 'UTC' AS DATE) AS day FROM raw_notifications WHERE title IS NOT NULL AND detail_url IS NOT NULL)"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _notices(t) -> DataFrame:
    rows = t("raw_notifications").where("title is not null and detail_url is not null")
    return rows.select(F.col("canonical_key").alias("ident"), "source_key", "title", "detail_url", "pdf_url", "apply_url", "exam_id", F.to_date("published_on").alias("day")).distinct()


def _pages(t, body: Column, *more: str) -> DataFrame:
    """Pages (ident, page, base) with `body` between a menu and a footer."""
    page = F.concat(F.lit("<html><head><title>x</title></head><body><ul><li><a href='/home'>Home</a></li></ul>"), body, F.lit("<p>Visitors: 5</p></body></html>"))
    return _notices(t).select("ident", page.alias("page"), F.lit("https://base.example/list/index.html").alias("base"), *more)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _row(url: str, label: str) -> Column:
    day = F.coalesce(F.date_format("day", "dd-MM-yyyy"), F.lit(""))
    return F.concat(F.lit("<table><tr><th>Date</th><th>Name</th><th>Link</th></tr><tr class=r><td>"), day, F.lit("</td><td><b>"), _escaped(F.col("title")), F.lit("</b>\n</td><td><a class='x' href="), F.lit("'"), F.col(url), F.lit(f"'><i>{label}</i></a></td></tr></table>"))


@query(f"SELECT ident, 1 AS pos, t AS title, detail_url, CAST(NULL AS VARCHAR) AS pdf_url, day AS published FROM {_N} WHERE t <> ''")
def notice_table_pages(t, spark) -> DataFrame:
    return parsers.notice_table(_pages(t, _row("detail_url", "view")), 3)


@query(f"SELECT ident, 1 AS pos, t AS title, CAST(NULL AS VARCHAR) AS detail_url, pdf_url, day AS published FROM {_N} WHERE pdf_url IS NOT NULL AND t <> ''")
def board_table_pages(t, spark) -> DataFrame:
    pages = _pages(t, _row("pdf_url", "view"), "pdf_url").where("pdf_url is not null").drop("pdf_url")
    return parsers.notice_table(pages, 2, "Notice")


@query(f"SELECT ident, 1 AS pos, t AS title, CAST(NULL AS VARCHAR) AS detail_url, pdf_url, CAST(NULL AS DATE) AS published FROM {_N} WHERE pdf_url IS NOT NULL AND t <> ''")
def document_link_pages(t, spark) -> DataFrame:
    pages = _pages(t, _row("pdf_url", "Click here"), "pdf_url").where("pdf_url is not null").drop("pdf_url")
    return parsers.document_links(pages)


@query(f"SELECT ident, 1 AS pos, t AS title, detail_url, CAST(NULL AS VARCHAR) AS pdf_url, day AS published FROM {_N} WHERE t <> '' AND (day IS NULL OR day >= DATE '2024-06-30' - 120)")
def dated_link_pages(t, spark) -> DataFrame:
    return parsers.dated_links(_pages(t, _row("detail_url", "click here")), "2024-06-30").where("title != ''")


@query(f"""SELECT ident, 1 AS pos, t AS title, detail_url, CAST(NULL AS VARCHAR) AS pdf_url, CAST(NULL AS DATE) AS published FROM {_N} WHERE length(t) BETWEEN 10 AND 220 AND regexp_matches(t,'(?i)exam|recruitment|service|test|combined|engineering|medical|defence|nda|cds|civil|\\b20\\d{{2}}\\b')
AND NOT regexp_matches(t,'(?i)question papers|cut[- ]?off|answer keys?|marks of recommended|common mistakes|copyright|screen reader')""")
def exam_entry_pages(t, spark) -> DataFrame:
    entry = F.concat(F.lit("<ul class=arrows><li><a href=\""), F.col("detail_url"), F.lit("\">"), _escaped(F.col("title")), F.lit("</a></li></ul>"))
    return parsers.exam_entries(_pages(t, entry), ["exam-calendar", "active-exams"])


@query(f"SELECT ident, 1 AS pos, t AS title, detail_url, CAST(NULL AS VARCHAR) AS pdf_url, day AS published FROM {_N} WHERE contains(t,'2024')")
def calendar_pages(t, spark) -> DataFrame:
    return parsers.calendar_rows(_pages(t, _row("detail_url", "open")), 2024, "date")


@query(f"""SELECT ident, t AS name, coalesce(strftime(day,'%d-%m-%Y'),'') AS notification, coalesce(exam_id,'') AS exam, nullif(substr(concat_ws(' | ', 'name: ' || nullif(t,''), 'notification: ' || strftime(day,'%d-%m-%Y'), 'exam: ' || nullif(exam_id,'')),1,340),'') AS summary FROM {_N}""")
def detail_label_pages(t, spark) -> DataFrame:
    cell = lambda label, value: F.concat(F.lit(f"<tr><th>{label}</th><td> "), value, F.lit(" </td></tr>"))
    body = F.concat(F.lit("<table>"), cell("Name of  Examination", _escaped(F.col("title"))), cell("Date of Notification", F.coalesce(F.date_format("day", "dd-MM-yyyy"), F.lit(""))), cell("Exam &amp; Number", _text("exam_id")), F.lit("</table>"))
    return parsers.label_values(_pages(t, body), {"name": "name of", "notification": "date of notification", "exam": "exam & number"})


def _detail_body() -> Column:
    link = lambda url, label: F.concat(F.lit("<p><a href=\""), _text(url), F.lit(f"\">{label}</a></p>"))
    return F.concat(F.lit("<h1>"), _escaped(F.col("title")), F.lit("</h1><p>Notification No. "), F.crc32("ident").cast("string"), F.lit("</p>"), link("detail_url", "Read more"), link("pdf_url", "Notification"), link("apply_url", "Apply <b>now</b>"))


@query(f"SELECT ident, pdf_url, nullif(apply_url,'') AS apply_url FROM {_N}")
def detail_link_pages(t, spark) -> DataFrame:
    return parsers.detail_links(_pages(t, _detail_body()))


@query(f"SELECT ident, apply_url FROM {_N}")
def single_notice_pages(t, spark) -> DataFrame:
    return parsers.single_notice(_pages(t, _detail_body()), "(?i)apply", r"Notification No\. (\d+)").select("ident", "apply_url")


@query(f"SELECT DISTINCT ident, detail_url, CASE WHEN starts_with(source_key,'banking') THEN NULL ELSE pdf_url END AS listed, pdf_url FROM {_N}")
def items_with_details(t, spark) -> DataFrame:
    listed = F.when(~F.col("source_key").startswith("banking"), F.col("pdf_url"))
    items = _notices(t).select("ident", "source_key", "detail_url", listed.alias("pdf_url"), F.lit(None).cast("string").alias("apply_url"), listed.alias("listed"))
    landed = _pages(t, _detail_body(), "detail_url").select(F.col("detail_url").alias("ident"), "page", "base").dropDuplicates(["ident"])
    return parsers.filled_from_details(items, parsers.detail_links(landed)).select("ident", "detail_url", "listed", "pdf_url").distinct()


@query(f"SELECT ident, coalesce(pdf_url, CASE WHEN starts_with(source_key,'police') THEN 'https://b.example/2.pdf' END) AS pdf_url FROM {_N}")
def items_with_probes(t, spark) -> DataFrame:
    keys = t("sources").where("source_key like 'police%'").select("source_key").distinct()
    probes = keys.select(F.col("source_key").alias("source"), F.explode(F.expr("array(struct('https://b.example/1.pdf' as url, 1 as rank, 'text/html' as content_type), struct('https://b.example/2.pdf' as url, 2 as rank, 'application/PDF' as content_type), struct('https://b.example/3.pdf' as url, 3 as rank, 'application/pdf' as content_type))")).alias("p")).select("source", "p.*")
    return parsers.filled_from_probes(_notices(t).withColumnRenamed("source_key", "source"), probes).select("ident", "pdf_url")


@query(f"""SELECT ident, CASE WHEN starts_with(source_key,'banking') THEN 'banking' WHEN starts_with(source_key,'police') THEN 'police' ELSE 'other' END AS parser, t AS title FROM {_N} WHERE t <> '' AND
(NOT starts_with(source_key,'police') OR day IS NULL OR day >= DATE '2024-06-30' - 120)""")
def pages_by_source(t, spark) -> DataFrame:
    pages = _pages(t, _row("detail_url", "view"), "source_key")
    kinds = {"banking": lambda p: parsers.notice_table(p, 3), "police": lambda p: parsers.dated_links(p, "2024-06-30")}
    key = F.split("source_key", "_")[0]
    return parsers.parse_by_source(pages, key, kinds, lambda p: parsers.notice_table(p, 2, "Notice")).where("title != ''").select("ident", "parser", "title")


_PAYLOAD = "SELECT ident, detail_url AS id, t AS title, exam_id, regexp_extract(pdf_url,'^https://[^/]+(/.*)$',1) AS pdf_path, day AS published, CASE WHEN day IS NOT NULL THEN year(day) || '-' || lpad(CAST((year(day) + 1) % 100 AS VARCHAR),2,'0') END AS session FROM " + _N


def _payloads(t) -> DataFrame:
    path = F.regexp_extract("pdf_url", "^https://[^/]+(/.*)$", 1)
    entry = F.struct(F.col("detail_url").alias("id"), F.concat(F.lit("  "), "title").alias("headline"), F.col("exam_id").alias("examId"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z")).alias("startDate"), F.year("day").alias("year"), F.array(F.struct(F.lit("/a.png").alias("path"), F.lit("image").alias("type")), F.struct(path.alias("path"), F.lit("pdf").alias("type"))).alias("attachments"))
    return _notices(t).select("ident", F.to_json(F.struct(F.array(entry).alias("data"))).alias("payload"))


@query(_PAYLOAD + " WHERE t <> ''")
def board_payloads(t, spark) -> DataFrame:
    return parsers.board_payload(_payloads(t))


@query(_PAYLOAD + " WHERE t <> '' AND year(day) IN (2023, 2024)")
def calendar_payloads(t, spark) -> DataFrame:
    return parsers.board_payload(_payloads(t), [2023, 2024])


_PLAIN = "(SELECT DISTINCT id, raw_html FROM raw_items WHERE raw_html IS NOT NULL)"


@query(rf"""SELECT id AS ident, count(*) AS links FROM (SELECT id, unnest(regexp_extract_all(raw_html,'(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>.*?</a\s*>')) AS a FROM {_PLAIN}) WHERE NOT regexp_matches(a,'(?i)href="(?:#|javascript:|mailto:|tel:|"|\s*")') GROUP BY id""")
def link_counts(t, spark) -> DataFrame:
    pages = t("raw_items").where("raw_html is not null").select(F.col("id").alias("ident"), F.col("raw_html").alias("page"), F.lit("https://b.example/").alias("base")).distinct()
    return parsers.links(pages).groupBy("ident").agg(F.count(F.lit(1)).alias("links"))


@query(rf"""SELECT id, nullif(substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(CASE WHEN b <> '' THEN b ELSE raw_html END,'(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->',' ','g'),'<[^>]*>',' ','g'),'&nbsp;',' '),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&amp;','&'),'\s+',' ','g')),1,4000),'') AS snippet
FROM (SELECT *, regexp_extract(raw_html,'(?is)<body\b[^>]*>(.*)',1) AS b FROM {_PLAIN})""")
def page_snippets(t, spark) -> DataFrame:
    return t("raw_items").where("raw_html is not null").select("id", "raw_html").distinct().select("id", parsers.snippet(F.col("raw_html")).alias("snippet"))
