"""Landed fetches and files as sources. Nothing is fetched at query time: pages and files are landed by whatever fetches them, one row an attempt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patrika.functions.text import pdf_text


def last_success(attempts: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, attempt, body, failed): the body of the first of at most `most` attempts that has one; how many failed before it; null if none did."""
    tried = attempts.where(F.col("attempt") <= most)
    good = F.col("body").isNotNull() & (F.col("body") != "")
    first = F.min(F.when(good, F.struct("attempt", "body")))
    out = tried.groupBy(key).agg(first.alias("_f"), F.sum(F.when(good, 0).otherwise(1)).alias("_all"))
    return out.select(key, F.col("_f.attempt").alias("attempt"), F.col("_f.body").alias("body"), F.coalesce(F.col("_f.attempt") - 1, F.col("_all")).cast("int").alias("failed"))


def page_text(plain: Column, rendered: Column) -> Column:
    """The plain body, or the rendered one where the plain is blank."""
    return F.coalesce(F.when(F.trim(plain) != "", plain), rendered)


def landed_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """(path, bytes, sha256, content, error): files of a folder; an empty file or one above `most_bytes` has an error and no content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    error = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large")
    return rows.select("path", F.col("length").alias("bytes"), F.when(error.isNull(), F.sha2("content", 256)).alias("sha256"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def document_text(*extracted: Column, most: int = 300_000) -> Column:
    """The text of the first extractor that gave any, normalised, cut to `most` characters as the source has it."""
    return F.substring(F.coalesce(*[F.when(F.trim(c) != "", pdf_text(c)) for c in extracted]), 1, most)


def download_state(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, status, sha256, bytes, error): rows with their landed file: kept if they have a digest already, else downloaded or in error."""
    found = files.select(key, F.col("sha256").alias("_s"), F.col("bytes").alias("_n"), F.col("error").alias("_e"))
    both = rows.join(found, key, "left")
    had, ok = F.col("sha256").isNotNull(), F.col("_s").isNotNull()
    return both.select(key, F.when(had, F.col("status")).when(ok, "downloaded").otherwise("error").alias("status"), F.coalesce("sha256", "_s").alias("sha256"), F.when(ok, F.col("_n")).alias("bytes"), F.when(~had & ~ok, F.coalesce("_e", F.lit("not landed"))).alias("error"))


def seeds(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed relation of the code, such as the sources that are known from the start."""
    return spark.createDataFrame(list(rows), schema)


def seed_changes(table: DataFrame, seed: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, change): what seeding does to the table: created, updated or unchanged, by the fields that the seed gives."""
    old = table.select(*keys, F.struct(*fields).alias("_old"))
    both = seed.select(*keys, F.struct(*fields).alias("_new")).join(old, list(keys), "left")
    return both.select(*keys, F.when(F.col("_old").isNull(), "created").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated").alias("change"))
