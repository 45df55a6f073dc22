"""Streaming forms of the table operators, on tables whose files arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream, with the schema of those already there."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def delivered_scans(scans: DataFrame, late: str = "1 hour") -> DataFrame:
    """Scans without their re-deliveries, as long as these come within ``late``; the state of older ones is dropped."""
    return scans.filter("run is not null and scan is not null and loaded_at is not null").withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["run", "scan"])


def scans_per_window(scans: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Scans loaded of each run in tumbling or sliding windows."""
    w = F.window("loaded_at", width, slide) if slide else F.window("loaded_at", width)
    return scans.withWatermark("loaded_at", late).groupBy(w.alias("w"), "run").agg(F.count("*").alias("n"), F.count("rt").alias("n_timed")).select(F.col("w.start").alias("start"), "run", "n", "n_timed")


def load_sessions(scans: DataFrame, gap: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Stretches of a run's loading without a pause of ``gap``."""
    return scans.withWatermark("loaded_at", late).groupBy(F.session_window("loaded_at", gap).alias("w"), "run").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "run", "n")


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """All that is there now, processed into the memory table ``name``; for tests and small reports."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return q
