"""Listings with totals, related rows, and the state that crawls leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrika.operators.listing import token_search


def common_filters(rows: DataFrame, equal: dict[str, str | None], query: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows that equal every given value, then match the search; values that are null or empty filter nothing."""
    for name, value in equal.items():
        if value:
            rows = rows.where(F.col(name) == value)
    return token_search(rows, query, columns) if query else rows


def deadline_rank(deadline: Column, created: Column, status: Column, as_of: Column, grace: int, fresh: int) -> Column:
    """Where a row stands among equals: open or closed within `grace` days, undated but new within `fresh` days, then the rest by status."""
    day = as_of.cast("date")
    return F.when(deadline >= F.date_sub(day, grace), 0).when(deadline.isNull() & (created >= as_of - F.make_dt_interval(F.lit(fresh))), 1).when(status == "archived", 3).otherwise(2)


def page_with_total(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page, each row with `total`, how many rows there are in all; the total is one aggregate, not a window over all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def ordered_facet(rows: DataFrame, column: str) -> DataFrame:
    """(column, count, place): the counts of each value in order, greatest first, then by name. Only the counts are put in order, in one task: for columns of few values."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), F.asc_nulls_last(column))))


def response(page: DataFrame, order: Sequence[str], fields: Sequence[str], facets: DataFrame, limit: int, offset: int) -> DataFrame:
    """(body): one JSON object with total, limit, offset, the facets in order and the items of a page (of at most 200 rows, see listing.page)."""
    items = page.agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))).alias("_i"))
    named = facets.agg(F.sort_array(F.collect_list(F.struct("place", F.struct(*[c for c in facets.columns if c != "place"]).alias("f")))).alias("_f"))
    body = F.struct(F.coalesce("total", F.lit(0)).alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.transform("_f", lambda f: f["f"]).alias("agencies"), F.transform("_i", lambda i: i["item"]).alias("items"))
    return items.crossJoin(F.broadcast(named)).select(F.to_json(body).alias("body"))


def is_new(published: Column, fetched: Column, as_of: Column, days: int = 3) -> Column:
    """Whether a notice is at most `days` old; false without a time, and for the future."""
    age = F.unix_micros(as_of) - F.unix_micros(F.coalesce(published, fetched))
    return F.coalesce(age.between(0, days * 86_400_000_000), F.lit(False))


def link_array(*links: tuple[Column, str, str, bool]) -> Column:
    """array<struct<kind, label, url, is_primary>> of (url, kind, label, primary): those with an address, the first of each (kind, url)."""
    made = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.trim(url).alias("url"), F.lit(primary).alias("is_primary")) for url, kind, label, primary in links]), lambda x: x["url"] != "")
    keys = F.transform(made, lambda x: F.concat_ws("::", x["kind"], x["url"]))
    return F.filter(made, lambda x, i: F.array_position(keys, F.concat_ws("::", x["kind"], x["url"])) == i + 1)


def link_by_kind(links: Column, kind: str, primary_first: bool = True) -> Column:
    """The address of the first link of a kind, a primary one before others; empty without one."""
    of_kind = F.filter(links, lambda x: x["kind"] == kind)
    primary = F.get(F.filter(of_kind, lambda x: x["is_primary"]), F.lit(0))["url"] if primary_first else F.lit(None)
    return F.coalesce(primary, F.get(of_kind, F.lit(0))["url"], F.lit(""))


def related_hint(rows: DataFrame, candidates: DataFrame, block: str, ident: str, tokens: str, least: float, margin: float) -> DataFrame:
    """(ident, related, score): the candidate of the same block that shares most tokens, if it reaches `least` and leads the next by `margin`.

    `candidates` holds a bounded number of rows a block (such as the latest 50); a row is no candidate of itself.
    """
    a = rows.select(block, F.col(ident).alias("_a"), F.size(tokens).alias("_na"), F.explode(tokens).alias("_t"))
    b = candidates.select(block, F.col(ident).alias("_b"), F.size(tokens).alias("_nb"), F.explode(tokens).alias("_t"))
    shared = a.join(b, [block, "_t"]).where("_a != _b").groupBy("_a", "_b", "_na", "_nb").agg(F.count(F.lit(1)).alias("_n"))
    scored = shared.select(F.col("_a").alias(ident), F.col("_b").alias("related"), (F.col("_n") / F.greatest("_na", "_nb")).alias("score"))
    w = Window.partitionBy(ident).orderBy(F.desc("score"), "related")
    best = scored.withColumns({"_k": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_k = 1")
    return best.where((F.col("score") >= least) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin)).select(ident, "related", "score")


def either_column_duplicates(rows: DataFrame, ident: str, left: str, right: str) -> DataFrame:
    """(ident, duplicate_of): the least other id one of whose two addresses equals the row's first non-empty one; the OR is two equi-joins over minima.

    Of each address only its two least ids are kept, enough to leave out the row itself.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    asked = rows.select(ident, F.coalesce(blank(left), blank(right)).alias("_u")).where("_u is not null")
    held = rows.select(F.col(ident).alias("_o"), F.explode(F.array(left, right)).alias("_u")).where("_u != ''").distinct()
    least = held.groupBy("_u").agg(F.min("_o").alias("_first"))
    second = held.join(least, "_u").where("_o != _first").groupBy("_u").agg(F.min("_o").alias("_second"))
    found = asked.join(least.join(second, "_u", "left"), "_u").withColumn("duplicate_of", F.when(F.col("_first") != F.col(ident), F.col("_first")).otherwise(F.col("_second")))
    return found.where("duplicate_of is not null").groupBy(ident).agg(F.min("duplicate_of").alias("duplicate_of"))


def merged_segments(first: DataFrame, second: DataFrame, keys: Sequence[str], kinds: tuple[str, str]) -> DataFrame:
    """(keys, segment, kind, first, last): two lists of ranges as one, by start, the first list before the second where starts are equal."""
    both = first.withColumns({"kind": F.lit(kinds[0]), "_k": F.lit(0)}).unionByName(second.withColumns({"kind": F.lit(kinds[1]), "_k": F.lit(1)}))
    return both.withColumn("segment", F.row_number().over(Window.partitionBy(*keys).orderBy("first", "_k")) - 1).select(*keys, "segment", "kind", "first", "last")


def claimed(rows: DataFrame, as_of: Column, stale_minutes: int = 30, force: bool = False) -> DataFrame:
    """Rows a worker may take, as `processing`: downloaded or new ones, and those left in processing for long, none of them processed; all if forced."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < as_of - F.make_dt_interval(mins=F.lit(stale_minutes)))
    free = F.col("processed_at").isNull() & (F.col("status").isin("downloaded", "new") | stale)
    return (rows if force else rows.where(free)).withColumn("status", F.lit("processing"))


def audit_rows(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, action, changes): what an append-only log records between two states: created, removed, or changed with the fields that differ."""
    a = before.select(key, F.struct(*fields).alias("_a"))
    b = after.select(key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full")
    differs = F.filter(F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    action = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "removed").otherwise("changed")
    changes = F.when(action == "changed", F.array_join(differs, ",")).otherwise("")
    return both.select(key, action.alias("action"), changes.alias("changes")).where("action != 'changed' or changes != ''")


def stored_blobs(rows: DataFrame, content: Column, suffix: str = ".pdf") -> DataFrame:
    """(name, bytes, references): a content-addressed store: one blob for each different content, named by its SHA-256."""
    return rows.select(F.sha2(content, 256).alias("_h"), F.octet_length(content).alias("_n")).where("_h is not null").groupBy("_h").agg(F.max("_n").alias("bytes"), F.count(F.lit(1)).alias("references")).select(F.concat("_h", F.lit(suffix)).alias("name"), "bytes", "references")


def retry_plan(attempts: DataFrame, key: str, most: int = 2, delay_seconds: int = 30) -> DataFrame:
    """(key, attempt, wait_seconds): the next attempt of every key whose last one failed, with a delay that grows by attempt; none beyond `most`, one row a key."""
    last = attempts.groupBy(key).agg(F.max(F.struct("attempt", "ok")).alias("_l"))
    return last.where(~F.col("_l.ok") & (F.col("_l.attempt") < most)).select(key, (F.col("_l.attempt") + 1).alias("attempt"), (F.col("_l.attempt") * delay_seconds).alias("wait_seconds"))


def filled_blanks(rows: DataFrame, fills: dict[str, str]) -> DataFrame:
    """Columns that are null or empty take the value of another column."""
    return rows.withColumns({name: F.coalesce(F.when(F.col(name) != "", F.col(name)), F.col(other)) for name, other in fills.items()})
