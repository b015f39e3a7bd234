"""Order within keys: islands, streaks, schedules and limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def contiguous_ranges(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, first, last) of the runs of consecutive numbers; repeated numbers count once."""
    once = rows.select(*keys, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return once.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def failures_since_success(rows: DataFrame, key: str, at: Sequence[str], ok: Column) -> DataFrame:
    """(key, failures, last_success): events after the last successful one by `at`; all of them if there is none."""
    place = F.struct(*at)
    marked = rows.withColumns({"_at": place, "_ok": F.when(ok, place)})
    last = marked.groupBy(key).agg(F.max("_ok").alias("_last"))
    joined = marked.join(last, key)
    failures = F.sum(F.when(F.col("_last").isNull() | (F.col("_at") > F.col("_last")), 1).otherwise(0))
    return joined.groupBy(key).agg(failures.alias("failures"), F.max("_ok")[at[0]].alias("last_success"))


# Minutes between visits by the least priority of each band, and for no band.
BANDS, SELDOM = [(90, 30), (70, 120), (50, 360)], 1440


def crawl_frequency(priority: Column, configured: Column, failures: Column, bands: list[tuple[int, int]] = BANDS) -> Column:
    """Minutes between visits: the lesser of the configured number (a day if none) and that of the priority's band (50 if none); a day at least after five failures."""
    wanted = F.coalesce(F.when(priority != 0, priority), F.lit(50))
    by_priority = F.lit(SELDOM)
    for least, minutes in reversed(bands):
        by_priority = F.when(wanted >= least, minutes).otherwise(by_priority)
    minutes = F.least(F.coalesce(F.when(configured != 0, configured), F.lit(SELDOM)), by_priority)
    return F.when(F.coalesce(failures, F.lit(0)) >= 5, F.greatest(minutes, F.lit(SELDOM))).otherwise(minutes)


def due(last: Column, minutes: Column, as_of: Column) -> Column:
    """Whether a visit is due: never made, or made `minutes` ago or earlier."""
    return last.isNull() | (F.unix_micros(last) + minutes.cast("bigint") * 60_000_000 <= F.unix_micros(as_of))


def window_counts(rows: DataFrame, key: str, at_seconds: str, window_seconds: int) -> DataFrame:
    """Rows with `in_window`: how many rows of their key lie in the window that ends with them."""
    w = Window.partitionBy(key).orderBy(at_seconds).rangeBetween(-(window_seconds - 1), 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w))


class SlidingLog:
    """A limiter's log of admitted times: at most `limit` of them; refused requests leave no trace."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.log = limit, window, deque()

    def admit(self, t: int) -> bool:
        while self.log and self.log[0] <= t - self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(t)
        return True


def admit(times: list[int], limit: int, window: int) -> list[bool]:
    """Which of the ascending times a sliding log admits."""
    log = SlidingLog(limit, window)
    return [log.admit(t) for t in times]


def rate_limited(rows: DataFrame, key: str, ident: str, at_seconds: str, limit: int, window_seconds: int) -> DataFrame:
    """(key, ident, allowed): the decision of a sliding-log limiter for each request, by time, then id.

    Admission depends on earlier admissions, so the requests of one key are read in order; they stream through their task, which
    keeps the log of one key, `limit` times at most.
    """
    kept = rows.select(key, ident, at_seconds)
    schema = StructType([*kept.select(key, ident).schema.fields, StructField("allowed", BooleanType())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = object(), SlidingLog(limit, window_seconds)
        for batch in batches:
            allowed = []
            for who, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if who != now:
                    now, log = who, SlidingLog(limit, window_seconds)
                allowed.append(log.admit(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=[key, ident, "allowed"])

    return kept.repartition(F.col(key)).sortWithinPartitions(key, at_seconds, ident).mapInArrow(decide, schema)
