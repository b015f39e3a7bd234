"""Streams over files, run to their end."""

from patrika.streaming.limiter import limited_stream
from patrika.streaming.tables import VersionedTable, start_merge, windowed_counts


def test_merge_stream_is_idempotent(spark, tmp_path):
    schema = "k int, name string, seen int"
    source, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "table"))

    def run(rows, check):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_merge(stream, table, ["k"], ["seen"], str(tmp_path / check), overwrite=["name"], touch=["seen"]).start().awaitTermination()
        return {r.k: (r.name, r.seen) for r in table.read().collect()}

    assert run([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "c") == {1: ("b", 2), 2: ("c", 1)}
    assert run([(2, "d", 5), (3, "e", 1)], "c") == {1: ("b", 2), 2: ("d", 5), 3: ("e", 1)}
    # the same batches once more, as after a lost checkpoint, change nothing
    number = table.version()
    stream = spark.readStream.schema(schema).parquet(source)
    start_merge(stream, table, ["k"], ["seen"], str(tmp_path / "other"), overwrite=["name"], touch=["seen"]).start().awaitTermination()
    assert table.version() == number


def test_limiter_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 4, 0), ("a", 5, 100)], "client string, request_id bigint, at bigint").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("client string, request_id bigint, at bigint").parquet(source)
    query = limited_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.request_id: r.allowed for r in spark.table("limited").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2021-01-01 00:10:00' AS at, 'x' AS k UNION ALL SELECT timestamp'2021-01-01 00:50:00', 'x' UNION ALL SELECT timestamp'2021-01-01 03:00:00', 'x'").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("at timestamp, k string").parquet(source)
    query = windowed_counts(stream, "at", "k").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["count"] for r in spark.table("windows").collect()) == [1, 2]
