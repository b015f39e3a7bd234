"""Searching, ordering, paging and counting of listings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patrika.session import cut_lineage


def search_tokens(query: str) -> list[str]:
    """Lower-case words of two characters or more; the whole query if there are none."""
    found = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if len(t) >= 2]
    return found or ([query.strip().lower()] if query.strip() else [])


def token_search(rows: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which every token of the query is found in one of the columns, whatever its case. A blank query keeps all rows."""
    words = search_tokens(query)
    if not words:
        return rows
    found = [reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(w), F.lit(False)) for c in columns]) for w in words]
    return rows.where(reduce(lambda a, b: a & b, found))


def substring_search(rows: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which the text as a whole is found in one of the columns, whatever its case."""
    low = text.strip().lower()
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False)) for c in columns])) if low else rows


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, clamp: bool = False, most: int = 200) -> DataFrame:
    """One page. Limits outside 1..most are refused, or brought inside if `clamp`."""
    if clamp:
        limit, offset = max(1, min(most, limit)), max(0, offset)
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be in 1..{most} and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def facet(rows: DataFrame, column: str) -> DataFrame:
    """(column, count): how many rows hold each value, null among them."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`, which must end in something unique to be stable."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def best_and_runner_up(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column]) -> DataFrame:
    """The best row of each key with the score of the next one (null if there is none) as `next_score`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), *tie)
    return rows.withColumns({"_place": F.row_number().over(w), "next_score": F.lead(score).over(w)}).where("_place = 1").drop("_place")


def nested_children(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in the given order, empty where there are none."""
    packed = F.struct(*[F.col(c) for c in [*order, *[f for f in fields if f not in order]]])
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(packed)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def nested_chunks(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str, size: int) -> DataFrame:
    """(key, chunk, name): the children of each parent in arrays of at most `size`, numbered from 0 in the given order; one empty chunk where there are none.

    Children are sorted in ranges of key and order, so that those of one parent lie in several tasks; their places are
    counted by range, then across ranges. `order` must tell children of one parent apart.
    """
    held = children.join(parents.select(key), key, "left_semi")
    conf = parents.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), 2 * parents.sparkSession.sparkContext.defaultParallelism)
    # written once: ranges are sampled, and both readers must see the same
    ranged = cut_lineage(held.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_place", place).join(starts, [key, "_range"])
    chunk = F.floor((F.col("_before") + F.col("_place")) / size).cast("bigint")
    lists = numbered.groupBy(key, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
    childless = parents.join(counts.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("bigint").alias("chunk"), F.array().cast(lists.schema[name].dataType).alias(name))
    return lists.unionByName(childless)


def slug_or_id(rows: DataFrame, wanted: str, slug: str, ident: str) -> DataFrame:
    """The row whose slug matches, else the one whose id does; ties by id."""
    rank = F.when(F.col(slug) == wanted, 0).when(F.col(ident).cast("string") == wanted, 1)
    return rows.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", ident).limit(1).drop("_rank")
