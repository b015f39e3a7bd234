"""A table that micro-batches are merged into.

Plain parquet has no MERGE. Each batch writes a new version of the table beside the old one and then moves a pointer file,
so a batch that is lost half-way leaves the old version in place, and one that is replayed finds its number already there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from patrika.operators.merge import keyed_merge, last_wins


class VersionedTable:
    """Versions of a table below one folder; `current` names the one in force."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The number of the batch that wrote the current version; null before the first."""
        found = [s.getPath().getName() for s in (self._fs.globStatus(self._path(f"{self.folder}/_current-*")) or [])]
        return max((int(n.rpartition("-")[2]) for n in found), default=None)

    def read(self) -> DataFrame | None:
        number = self.version()
        return None if number is None else self.spark.read.parquet(f"{self.folder}/version={number}")

    def commit(self, rows: DataFrame, number: int) -> None:
        """Write `rows` as version `number` and make it current; older versions but the last are removed."""
        before = self.version()
        rows.write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        self._fs.create(self._path(f"{self.folder}/_current-{number}"), True).close()
        for status in self._fs.globStatus(self._path(f"{self.folder}/*")):
            name = status.getPath().getName()
            old = int(name.replace("=", "-").rpartition("-")[2])
            if old != number and old != before:
                self._fs.delete(status.getPath(), True)
            elif old == before and before != number and name.startswith("_current"):
                self._fs.delete(status.getPath(), True)


def merge_batches(table: VersionedTable, keys: Sequence[str], order: Sequence[str], **policy: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row of each key in the batch, merged into the table by keyed_merge's policy."""

    def merge(batch: DataFrame, number: int) -> None:
        done = table.version()
        if done is not None and done >= number:
            return
        rows = last_wins(batch, keys, order)
        held = table.read()
        merged = rows if held is None else keyed_merge(held, rows, keys, **policy).drop("changed").select(held.columns)
        table.commit(merged, number)

    return merge


def start_merge(stream: DataFrame, table: VersionedTable, keys: Sequence[str], order: Sequence[str], checkpoint: str, **policy: Sequence[str]) -> DataStreamWriter:
    """A writer that merges all available rows of `stream` and stops; call start() on it."""
    return stream.writeStream.foreachBatch(merge_batches(table, keys, order, **policy)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, key, count) of events by event time; events later than `late` behind the newest are left out."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("window.start").alias("window_start"), key, "count")
