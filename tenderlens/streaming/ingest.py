"""Streaming forms: windowed counts with a watermark, deduplication, and an idempotent keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_batches(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """A query that keeps the last row of each key: a batch writes the merged state to a folder of its number, so that a
    batch that is run again gives the same folder; readers take the highest complete one."""
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = [p for p in (f"{path}/{n}" for n in range(number - 1, -1, -1)) if _complete(spark, p)][:1]
        state = latest(batch, keys, order)
        if before:
            state = latest(spark.read.parquet(before[0]).unionByName(state), keys, order)
        state.write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _complete(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
