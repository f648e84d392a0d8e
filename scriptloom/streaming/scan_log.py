"""The scan log as a stream: append, also exactly once into a keyed table, deduplication within a watermark, windowed
alerts, and alerts of single scripts from state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable


def read(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Parquet files as they arrive; ts as a timestamp with zone, as watermarks need it."""
    return spark.readStream.schema(schema).options(**options).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def append(log: DataFrame, path: str, checkpoint: str):
    return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def append_once(log: DataFrame, table: KeyedTable, checkpoint: str, writer: str = "scan_log"):
    """Appends to a keyed table whose manifest counts the stream's batches: a batch that ran before its checkpoint was
    written runs again after a restart, finds itself counted and adds nothing. One writer name for each checkpoint."""

    def add(batch: DataFrame, number: int) -> None:
        table.append(batch, writer=writer, batch=number)

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(log: DataFrame, key: str = "script_hash", delay: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(log: DataFrame, *, width: str = "1 day", delay: str = "1 hour", slow_ms: float = 3000.0, most_errors: float = 0.05) -> DataFrame:
    """Scans, the 95th percentile of their time and their share of errors in each window, with alerts."""
    w = log.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("scans"), F.percentile_approx("value", 0.95).alias("p95_ms"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"))
    return w.select(F.col("window.start").alias("start"), "scans", "p95_ms", "error_rate", (F.col("p95_ms") > slow_ms).alias("slow"), (F.col("error_rate") > most_errors).alias("failing"))
