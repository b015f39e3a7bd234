"""Records out of landed pages and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patrika.functions.text import squeeze
from patrika.functions.urls import absolute

_ANCHOR = r"<[aA] [^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</[aA]>"


def anchors(pages: DataFrame, ident: str, page: str) -> DataFrame:
    """(ident, pos, href, label) of every flat link of each page, from 0, labels squeezed and unescaped for the common entities."""
    links = F.arrays_zip(F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(2)).alias("label"))
    rows = pages.where(F.col(page).isNotNull()).select(ident, F.posexplode(links).alias("pos", "_l"))
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_l.label"), "&nbsp;", " "), "&gt;", ">"), "&amp;", "&")
    return rows.select(ident, "pos", F.col("_l.href").alias("href"), squeeze(label).alias("label"))


def notice_links(links: DataFrame, ident: str, wanted: str, noise: str, most: int = 200) -> DataFrame:
    """Links whose label and address match `wanted` and not `noise`, titles of four characters or more, first of each (label, address), by position, at most `most` a page.

    The limit is the parser's own; it keeps the first links of each page.
    """
    text = F.lower(F.concat_ws(" ", "label", "href"))
    kept = links.where((F.length("label") >= 4) & text.rlike(wanted) & ~text.rlike(noise))
    first = kept.groupBy(ident, F.lower("label").alias("_l"), F.col("href")).agg(F.min(F.struct("pos", "label")).alias("_f"))
    listed = first.groupBy(ident).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("_f.pos").alias("pos"), F.col("_f.label").alias("label"), "href"))), 1, most).alias("_all"))
    return listed.select(ident, F.explode("_all").alias("_x")).select(ident, "_x.pos", "_x.label", "_x.href")


def scored_link(links: DataFrame, ident: str, score: Column, positive: bool = True) -> DataFrame:
    """(ident, href, score): the link with the highest score on each page, the first of equals; scores of 0 lose if `positive`."""
    rows = links.withColumn("_score", score)
    if positive:
        rows = rows.where("_score > 0")
    best = F.max_by(F.struct("href", F.col("_score").alias("score")), F.struct("_score", (-F.col("pos")).alias("p")))
    return rows.groupBy(ident).agg(best.alias("_b")).select(ident, "_b.href", "_b.score")


def resolved(links: DataFrame, base: Column) -> DataFrame:
    """Links with their address resolved against the page's; those without one are dropped."""
    return links.withColumn("url", absolute(F.col("href"), base)).where(F.col("url").isNotNull())


def json_values(rows: DataFrame, ident: str, column: str) -> DataFrame:
    """(ident, key, value) of each entry of a JSON object, values as text; objects that cannot be read give nothing."""
    return rows.select(ident, F.explode(F.map_entries(F.from_json(column, "map<string,string>"))).alias("_e")).select(ident, "_e.key", "_e.value")


def json_salvage(text: Column, schema: str) -> Column:
    """The JSON object in a text: the text itself, else what lies between its first and last brace."""
    whole = F.from_json(text, schema)
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)
    return F.when(F.trim(text).startswith("{"), F.coalesce(whole, inner)).otherwise(inner)
