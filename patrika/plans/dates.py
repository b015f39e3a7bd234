"""Problem 5: dates and times of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrika.operators.timestamps import page_dates
from patrika.sources.tables import read_table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_item_id, slot, norm) of every value that gives a valid date."""
    dates = page_dates(read_table(spark, folder, "raw_items"), read_table(spark, folder, "sources"))
    return dates.where(F.col("norm").isNotNull()).select("raw_item_id", "slot", "norm").distinct()


def p5_status_by_slot(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each slot are dates, instants, ambiguous, nonexistent, without zone or invalid."""
    dates = page_dates(read_table(spark, folder, "raw_items"), read_table(spark, folder, "sources"))
    return dates.groupBy("slot", "status").agg(F.count(F.lit(1)).alias("values"))


QUERIES = {"p5_found": p5_found, "p5_status_by_slot": p5_status_by_slot}
ORACLES: dict[str, str] = {}
