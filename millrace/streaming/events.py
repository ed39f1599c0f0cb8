"""Windowed sums over the events as a stream: an extension, as the star and sort operators are batch only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and cents of each window and type. Works on a stream, with a watermark, and on a table."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    sums = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return sums.select(F.unix_seconds(F.col("window.start")).alias("start"), "event_type", "n", "cents")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file by file as a stream, run until all is read; the result is the table that it kept."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    name = f"windows_{uuid.uuid4().hex}"
    stream = windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path))
    run = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


QUERIES = {"event_windows": lambda spark, d: windowed(spark.read.parquet(f"{d}/events.parquet"))}
SQL = {"event_windows": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL"}
