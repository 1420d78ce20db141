from pyspark.sql import functions as F

from larkfield.operators.snapshot import SnapshotTable
from larkfield.streaming import dedup, sessions


def test_pairing_and_windows_as_streams(spark, tmp_path):
    rows = [("s", str(i), f"2024-01-01 00:{i:02d}:00") for i in range(10)]
    calls = spark.createDataFrame(rows, "session_id string, call_id string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    calls.write.parquet(f"{tmp_path}/starts")
    calls.withColumn("ts", F.expr("ts + interval 5 seconds")).write.parquet(f"{tmp_path}/ends")
    read = lambda n: spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/{n}")
    paired = sessions.pair_stream(read("starts"), read("ends"))
    query = paired.writeStream.format("memory").queryName("paired").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    query.awaitTermination()
    assert {r.latency_ms for r in spark.table("paired").collect()} == {5000}
    counted = sessions.windowed_counts(read("starts").withColumn("event_type", F.lit("x")), "5 minutes")
    query = counted.writeStream.format("memory").outputMode("complete").queryName("counted").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("counted").collect()) == [5, 5]


def test_session_counts(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in sessions.session_counts(rows).collect()) == [1, 2]


def test_keep_current(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t")
    schema = "id long, v string, version long"
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(2, "d", 3)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{tmp_path}/in")
        sessions.keep_current(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, "id", f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.v) for r in table.read().collect()} == {(1, "b"), (2, "d")}


def test_late_versions_and_batches_played_again_change_nothing(spark, tmp_path):
    table = SnapshotTable(spark, f"{tmp_path}/t")
    schema = "id long, v string, version long"
    for batch in ([(1, "a", 5)], [(1, "late", 3), (2, "x", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sessions.keep_current(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table, "id", f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.v) for r in table.read().collect()} == {(1, "a"), (2, "x")}
    before = table.meta()
    spark.read.parquet(f"{tmp_path}/in").write.parquet(f"{tmp_path}/again")
    assert table.get_meta(f"batch:{tmp_path}/ck") == "1" and table.meta() == before


def test_repeats_and_late_rows(spark, tmp_path):
    schema = "id long, ts timestamp, v string"
    hour = lambda h, m=0: f"2024-01-0{1 + h // 24} {h % 24:02d}:{m:02d}:00"
    batches = [
        [(1, hour(0), "a"), (1, hour(0), "again"), (2, hour(1), "a"), (None, hour(1), "no id"), (3, None, "no time")],
        [(2, hour(1), "again"), (4, hour(30), "a"), (5, hour(0, 30), "first seen now")],  # the mark is at hour 1
        [(6, hour(5), "late"), (4, hour(30), "again"), (7, hour(8), "on time"), (6, hour(6), "on the edge")],  # now at hour 30
    ]
    for batch in batches:
        spark.createDataFrame(batch, "id long, t string, v string").select("id", F.to_timestamp("t").alias("ts"), "v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        dedup.split(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
        dedup.once(spark, f"{tmp_path}/out", ["id"], f"{tmp_path}/c2").awaitTermination()
    late = {(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out/late").collect()}
    assert late == {(6, "late"), (6, "on the edge")}
    rows = [(r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()]
    assert sorted(i for i, _ in rows if i is not None) == [1, 2, 3, 4, 5, 7] and (2, "a") in rows and (4, "a") in rows and (None, "no id") in rows
