"""Session settings that operators rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "patrika", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` overrides any setting."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the cluster's shared folder (spark.checkpoint.dir).

    A folder on this machine is used only where the cluster names none and there is but one machine, as in tests; it is removed at the end.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="patrika-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """`frame` written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def spread(frame: DataFrame, *columns: str) -> DataFrame:
    """`frame` by the hash of `columns` in a fixed number of partitions, for work that is heavy for its bytes.

    Adaptive execution would join such partitions by their size. The number follows the session's shuffle partitions.
    """
    conf = frame.sparkSession.conf
    n = max(int(conf.get("spark.sql.shuffle.partitions")), 2 * frame.sparkSession.sparkContext.defaultParallelism)
    return frame.repartition(n, *columns)
