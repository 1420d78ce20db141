"""Repeated and late events: each event once, and those that come too late in a table of their own.

Spark drops rows that its watermark has passed, so they are told apart before a watermark is set: ``split`` files each
micro-batch into rows that are on time and rows that are late, against the latest time of the batches before. ``once`` then
reads the rows that are on time and keeps the first of those that share their keys (``dropDuplicatesWithinWatermark``);
nothing that ``split`` let through is late there, as its watermark is never ahead of the one that rows were split by.

Below the output: ontime/batch=N, late/batch=N, marks/batch=N (the latest time of a batch), rows (each event once). Batches
played again replace their partitions. Defined results: a row is late if its time is ``delay`` or more before the latest time
of all earlier batches; repeats more than ``delay`` apart may stay; rows without a time are on time, and repeats of
them are not told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split(stream: DataFrame, output: str, checkpoint: str, delay: str = "1 day", column: str = "ts"):
    """Starts the query that files new rows; it ends when all that is there is filed."""
    spark = stream.sparkSession
    marks = "latest timestamp, batch long"
    spark.createDataFrame([], marks).write.mode("ignore").partitionBy("batch").parquet(f"{output}/marks")

    def take(rows: DataFrame, number: int) -> None:
        before = spark.read.schema(marks).parquet(f"{output}/marks").where(F.col("batch") < number).agg(F.max("latest").alias("__latest"))
        late = F.coalesce(F.col(column) <= F.col("__latest") - F.expr(f"interval {delay}"), F.lit(False))
        told = rows.crossJoin(F.broadcast(before)).withColumn("__late", late).drop("__latest")  # one row
        for name, wanted in (("ontime", ~F.col("__late")), ("late", F.col("__late"))):
            told.where(wanted).drop("__late").write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")
        rows.agg(F.max(column).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{output}/marks/batch={number}")

    timed = stream.withColumn(column, F.col(column).cast("timestamp"))
    return timed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(spark: SparkSession, output: str, keys: list[str], checkpoint: str, delay: str = "1 day", column: str = "ts"):
    """Starts the query that writes each event that was on time once."""
    schema = spark.read.parquet(f"{output}/ontime").schema
    rows = spark.readStream.schema(schema).parquet(f"{output}/ontime").withWatermark(column, delay).dropDuplicatesWithinWatermark(keys)
    return rows.drop("batch").writeStream.format("parquet").option("path", f"{output}/rows").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
