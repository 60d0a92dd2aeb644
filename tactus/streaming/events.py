"""Streaming forms of the batch operators: block activity in tumbling windows and sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files events*.parquet in a folder; ts becomes a time stamp with zone, as watermarks need one."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def block_activity(rows: DataFrame, block: str = "1 day", late: str = "2 days", level: float = 30.0) -> DataFrame:
    """Mean power of each user's values in tumbling blocks, and whether it is over `level` dB."""
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", block), "user_id").agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count("*").alias("n"))
    db = 10 * F.log10(F.col("power") + 1e-12)
    return out.select(F.col("window.start").alias("start"), "user_id", "n", F.round(db, 6).alias("level"), (db > level).alias("active"))


def event_sessions(rows: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user's events that are less than `gap` apart."""
    out = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n", "top")


def run_once(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there into a Parquet table (append mode, exactly once by checkpoint) and read it."""
    q = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)
