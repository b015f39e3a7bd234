"""Records out of listing and detail pages: table functions over landed pages, one row an item.

Every parser takes pages (ident, page, base) and gives (ident, pos, title, detail_url, pdf_url, published). Cells, links and list entries
are taken out by expressions, so pages stay in the JVM; `parse_by_source` picks the parser by the source's key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrika.functions.extract import nonempty, strict_dates
from patrika.functions.text import squeeze
from patrika.functions.titles import is_likely_exam
from patrika.functions.urls import absolute, is_document, title_of_url

HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
LINK = r"(?is)(<a\b[^>]*?\bhref\s*=[^>]*>.*?</a\s*>)"
ROW, CELL, ENTRY = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>", r"(?is)(<li\b[^>]*>.*?</li\s*>)"
# Labels that name no document, and paths under which documents lie without an extension.
GENERIC, STORES = r"(?i)^(?:click here|view|download|here)$", r"(?i)\.pdf(?:\?|$)|sscfileserver|uploadedfiles|/api/attachment/"


def visible(html: Column) -> Column:
    """The text of a piece of a page: tags as spaces, the common entities read, squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return squeeze(text)


def snippet(page: Column, most: int = 4000) -> Column:
    """The visible text of the body, cut to `most` characters; null if there is none. The cut is the feature."""
    body = F.regexp_extract(page, r"(?is)<body\b[^>]*>(.*)", 1)
    return nonempty(F.substring(visible(F.when(body != "", body).otherwise(page)), 1, most))


def first_href(html: Column) -> Column:
    """The address of the first link of a piece of a page."""
    return F.coalesce(*[nonempty(F.regexp_extract(html, HREF, k)) for k in (1, 2, 3)])


def links(pages: DataFrame) -> DataFrame:
    """(ident, pos, label, url): every link of each page with an address that resolves; labels may hold other tags, quotes may be of either kind."""
    each = pages.select("ident", "base", F.posexplode(F.regexp_extract_all("page", F.lit(LINK), F.lit(1))).alias("pos", "_a"))
    return each.select("ident", "pos", visible(F.col("_a")).alias("label"), absolute(first_href(F.col("_a")), F.col("base")).alias("url")).where("url is not null")


def table_rows(pages: DataFrame) -> DataFrame:
    """(ident, pos, cells, url): the rows of all tables of each page, the visible text of their cells, and the address of their first link."""
    each = pages.select("ident", "base", F.posexplode(F.regexp_extract_all("page", F.lit(ROW), F.lit(1))).alias("pos", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(CELL), F.lit(1)), visible)
    return each.select("ident", "pos", cells.alias("cells"), absolute(first_href(F.col("_r")), F.col("base")).alias("url"))


def first_of(items: DataFrame, *key: str) -> DataFrame:
    """The first item of each page by position for each key; null parts of a key are equal."""
    once = Window.partitionBy("ident", *[F.coalesce(F.col(c), F.lit("")) for c in key]).orderBy("pos")
    return items.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")


def _item(title: Column, url: Column, document: Column, published: Column) -> list[Column]:
    return ["ident", "pos", title.alias("title"), F.when(~document, url).alias("detail_url"), F.when(document, url).alias("pdf_url"), published.cast("date").alias("published")]


def notice_table(pages: DataFrame, least_cells: int, generic_title: str | None = None) -> DataFrame:
    """Rows of date, title and link. A title that names nothing is replaced by `generic_title`, or its row dropped if there is none."""
    rows = table_rows(pages).where((F.size("cells") >= least_cells) & F.col("url").isNotNull()).withColumn("_t", F.col("cells")[1]).where("_t != ''")
    generic = F.col("_t").rlike(GENERIC)
    rows = rows.withColumn("_t", F.when(generic, generic_title).otherwise(F.col("_t"))) if generic_title else rows.where(~generic)
    day = F.get(strict_dates(F.translate(F.col("cells")[0], ".", "-")), F.lit(0))
    return first_of(rows.select(*_item(F.col("_t"), F.col("url"), F.col("url").rlike(STORES), day)), "title", "detail_url", "pdf_url")


def document_links(pages: DataFrame) -> DataFrame:
    """Links to documents; a label that names nothing is replaced by the first cell of its row that names something."""
    rows = table_rows(pages).where("url is not null").withColumn("_t", F.get(F.filter("cells", lambda c: (c != "") & ~c.rlike(GENERIC) & (F.size(strict_dates(c)) == 0)), F.lit(0)))
    named = rows.groupBy("ident", "url").agg(F.min_by("_t", "pos").alias("_t"))
    found = links(pages).where(is_document(F.col("url"))).join(named, ["ident", "url"], "left")
    title = F.when((F.col("label") == "") | F.col("label").rlike(GENERIC), F.coalesce("_t", "label")).otherwise(F.col("label"))
    return first_of(found.select(*_item(title, F.col("url"), F.lit(True), F.lit(None))), "pdf_url")


def dated_links(pages: DataFrame, as_of: str, days: int = 120) -> DataFrame:
    """Links of rows with the date in the row, none older than `days` before `as_of`; undated ones stay. Of equal addresses the last gives the values."""
    rows = table_rows(pages).where("url is not null")
    day = F.get(strict_dates(F.translate(F.array_join("cells", " "), ".", "-")), F.lit(0))
    rows = rows.withColumn("_d", day).where(F.col("_d").isNull() | (F.col("_d") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    title = F.get(F.filter("cells", lambda c: (c != "") & ~c.rlike(GENERIC) & (F.size(strict_dates(F.translate(c, ".", "-"))) == 0)), F.lit(0))
    last = rows.groupBy("ident", "url").agg(F.min("pos").alias("pos"), F.max_by(F.struct(title.alias("t"), F.col("_d").alias("d")), "pos").alias("_x"))
    return last.select(*_item(F.col("_x.t"), F.col("url"), is_document(F.col("url")), F.col("_x.d")))


def exam_entries(pages: DataFrame, skipped: list[str]) -> DataFrame:
    """List entries that name examinations; an entry without a label takes its title from the address. Addresses that end in a skipped name are left out."""
    each = pages.select("ident", "base", F.posexplode(F.regexp_extract_all("page", F.lit(ENTRY), F.lit(1))).alias("pos", "_e"))
    rows = each.select("ident", "pos", visible(F.col("_e")).alias("_t"), F.coalesce(absolute(first_href(F.col("_e")), F.col("base")), F.col("base")).alias("url"))
    rows = rows.withColumn("_t", F.when(F.col("_t") == "", title_of_url(F.col("url"))).otherwise(F.col("_t")))
    name = F.lower(F.regexp_extract("url", r"([^/?#]*)/*(?:[?#].*)?$", 1))
    return first_of(rows.where(is_likely_exam(F.col("_t")) & ~name.isin(skipped)).select(*_item(F.col("_t"), F.col("url"), is_document(F.col("url")), F.lit(None))), "title", "detail_url", "pdf_url")


def calendar_rows(pages: DataFrame, year: int, date_label: str) -> DataFrame:
    """Rows of a table with a header whose title names the year; the date is that of the column headed `date_label`, else the first of the row."""
    rows = table_rows(pages)
    heads = rows.groupBy("ident").agg(F.min_by(F.transform("cells", F.lower), "pos").alias("_h"))
    rows = rows.where("pos > 0").join(heads, "ident")
    at = F.array_position(F.transform("_h", lambda h: h.contains(date_label)), True).cast("int")
    dates = lambda c: F.get(strict_dates(F.translate(c, ".", "-")), F.lit(0))
    title_at = F.array_position(F.transform("_h", lambda h: h.contains("name") | h.contains("title")), True).cast("int")
    title = F.get(F.col("cells"), F.greatest(title_at, F.lit(1)) - 1)
    day = F.coalesce(F.when(at > 0, dates(F.get(F.col("cells"), at - 1))), dates(F.array_join("cells", " ")))
    return rows.where(title.contains(str(year))).select(*_item(title, F.col("url"), is_document(F.col("url")), day))


def label_values(pages: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(ident, one column a label): the value beside the first label of the first table that contains the wanted words, and `summary` of those found."""
    first = pages.withColumn("page", F.regexp_extract("page", r"(?is)<table\b[^>]*>(.*?)</table\s*>", 1))
    rows = table_rows(first).where((F.size("cells") >= 2) & (F.col("cells")[0] != "")).select("ident", "pos", F.lower(F.col("cells")[0]).alias("_l"), F.col("cells")[1].alias("_v"))
    picked = [F.min_by(F.when(F.col("_l").contains(words), F.col("_v")), F.when(F.col("_l").contains(words), F.col("pos"))).alias(name) for name, words in labels.items()]
    found = rows.groupBy("ident").agg(*picked)
    parts = F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), nonempty(F.col(name))) for name in labels])
    return pages.select("ident").join(found, "ident", "left").withColumn("summary", nonempty(F.substring(parts, 1, 340)))


def detail_links(pages: DataFrame, preferred_host: str | None = None) -> DataFrame:
    """(ident, pdf_url, apply_url): the first document, of the preferred host if it has one, and the first link that asks to apply."""
    found = links(pages)
    document = is_document(F.col("url"))
    preferred = document & F.col("url").contains(preferred_host) if preferred_host else F.lit(False)
    first = lambda cond: F.min_by(F.when(cond, F.col("url")), F.when(cond, F.col("pos")))
    best = found.groupBy("ident").agg(F.coalesce(first(preferred), first(document)).alias("pdf_url"), first(F.col("label").rlike("(?i)apply|register|online")).alias("apply_url"))
    return pages.select("ident").join(best, "ident", "left")


def single_notice(pages: DataFrame, apply_words: str, number: str) -> DataFrame:
    """(ident, title, apply_url): one item a page: its first heading with the notification's number, and the last link that matches."""
    last = links(pages).where(F.col("label").rlike(apply_words)).groupBy("ident").agg(F.max_by("url", "pos").alias("apply_url"))
    heading, stated = visible(F.regexp_extract("page", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)), nonempty(F.regexp_extract(visible(F.col("page")), number, 1))
    return pages.select("ident", F.concat_ws(" - ", nonempty(heading), stated).alias("title")).join(last, "ident", "left")


def filled_from_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """Items (detail_url, pdf_url, apply_url) with missing addresses from landed detail pages (ident, pdf_url, apply_url) under their address."""
    known = details.select(F.col("ident").alias("detail_url"), F.col("pdf_url").alias("_p"), F.col("apply_url").alias("_a"))
    return items.join(known, "detail_url", "left").withColumns({"pdf_url": F.coalesce("pdf_url", "_p"), "apply_url": F.coalesce("apply_url", "_a")}).drop("_p", "_a")


def filled_from_probes(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items without a document get the first accessible candidate: `probes` has source, url, rank and content_type, a few a source."""
    best = probes.where(F.lower("content_type").contains("pdf")).groupBy("source").agg(F.min_by("url", "rank").alias("_p"))
    return items.join(best, "source", "left").withColumn("pdf_url", F.coalesce("pdf_url", "_p")).drop("_p")


def parse_by_source(pages: DataFrame, key: Column, parsers: dict[str, Callable[[DataFrame], DataFrame]], other: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every page by the parser of its source's key, by `other` if it has none; `parser` names it."""
    keyed = pages.withColumn("_key", F.coalesce(key, F.lit("")))
    branches = [parse(keyed.where(F.col("_key") == name).drop("_key")).withColumn("parser", F.lit(name)) for name, parse in parsers.items()]
    return reduce(DataFrame.unionByName, [*branches, other(keyed.where(~F.col("_key").isin(list(parsers))).drop("_key")).withColumn("parser", F.lit("other"))])


BOARD = "struct<data:array<struct<id:string,headline:string,examId:string,startDate:string,year:int,attachments:array<struct<path:string,type:string>>>>>"


def board_payload(rows: DataFrame, years: list[int] | None = None) -> DataFrame:
    """(ident, id, title, exam_id, pdf_path, published, session) of each entry of JSON payloads (ident, payload): the first attachment that is a PDF; only `years` if given."""
    entry = rows.select("ident", F.explode(F.from_json("payload", BOARD)["data"]).alias("e")).where(squeeze(F.col("e.headline")) != "")
    if years is not None:
        entry = entry.where(F.col("e.year").isin(years))
    document = F.get(F.filter("e.attachments", lambda a: F.lower(a["path"]).rlike(r"\.pdf$") | (F.lower(a["type"]) == "pdf")), F.lit(0))
    session = F.concat(F.col("e.year").cast("string"), F.lit("-"), F.lpad(((F.col("e.year") + 1) % 100).cast("string"), 2, "0"))
    return entry.select("ident", "e.id", squeeze(F.col("e.headline")).alias("title"), F.col("e.examId").alias("exam_id"), document["path"].alias("pdf_path"), F.to_date(F.substring("e.startDate", 1, 10)).alias("published"), session.alias("session"))
