"""Rival values of one field: unpivot, choose, compare, pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivot_fields(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field_name, value) for each non-blank field, values as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(*keys, F.explode(F.filter(pairs, lambda p: F.trim(p["value"]) != "")).alias("_p")).select(*keys, "_p.field_name", "_p.value")


def pivot_fields(rows: DataFrame, key: str, fields: Sequence[str], value: str = "value") -> DataFrame:
    """One row a key with a column for each field; the field list is fixed, so no pass looks for it."""
    return rows.groupBy(key).pivot("field_name", list(fields)).agg(F.min(value))


def best_candidate(rows: DataFrame, keys: Sequence[str], score: Column, tie: Sequence[Column], value: str = "value") -> DataFrame:
    """The value with the highest score for each key, ties by `tie`, by one map-side combined aggregation."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(score, *tie)).alias(value))


def near_tie_candidate(rows: DataFrame, keys: Sequence[str], score: str, value: str, order: Sequence[Column], margin: float = 0.01, bonus: float = 1.2) -> DataFrame:
    """The best value of each key after near-ties that agree with the first of them get a bonus.

    Near-ties score less than `margin` below the best. The first of them by `order` sets the value that earns `bonus`.
    """
    w = Window.partitionBy(*keys)
    near = rows.withColumn("_near", F.max(score).over(w) - F.col(score) < margin)
    first = near.withColumn("_first", F.first(value).over(w.orderBy(F.col("_near").desc(), *order)))
    raised = first.withColumn("_score", F.when(F.col("_near") & F.col(value).eqNullSafe(F.col("_first")), F.col(score) * bonus).otherwise(F.col(score)))
    return raised.withColumn("_place", F.row_number().over(w.orderBy(F.col("_score").desc(), *order))).where("_place = 1").select(*keys, value)


def agreement(rows: DataFrame, keys: Sequence[str], best: DataFrame, value: str = "value") -> DataFrame:
    """(keys, best value, candidates, agreeing, ratio, conflict): the share of candidates that equal the best; conflict below one half."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(best.select(*keys, F.col(value).alias("best_value")), list(keys))
    out = joined.groupBy(*keys, "best_value").agg(F.sum("_n").alias("candidates"), F.sum(F.when(F.col(value).eqNullSafe(F.col("best_value")), F.col("_n")).otherwise(0)).alias("agreeing"))
    ratio = F.col("agreeing") / F.col("candidates")
    return out.withColumns({"ratio": ratio, "conflict": ratio < 0.5})


def conflict_pairs(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value_a, value_b, supporters_a, supporters_b) of every two different values of a key.

    Pairs are made between values, not between candidates: equal candidates are counted first.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(*keys, F.col(value).alias("value_a"), F.col("n").alias("supporters_a"))
    b = counts.select(*keys, F.col(value).alias("value_b"), F.col("n").alias("supporters_b"))
    return a.join(b, list(keys)).where(F.col("value_a") < F.col("value_b"))


def locked(chosen: DataFrame, locks: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Chosen values, replaced where a lock holds one; `locked` says so."""
    held = locks.select(*keys, F.col(value).alias("_lock"), F.lit(True).alias("_has"))
    out = chosen.join(held, list(keys), "left")
    return out.select(*keys, F.when(F.col("_has"), F.col("_lock")).otherwise(F.col(value)).alias(value), F.coalesce("_has", F.lit(False)).alias("locked"))
