"""Schemas of the engine's relations, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable, Rules

SAMPLES = "id long, content_hash string, content string, label string, source string, url string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz"
VERSIONS = "id long, version string, total_samples long, malicious_count long, benign_count long, sources map<string,long>, metadata map<string,string>, created_at timestamp_ntz"
SCANS = "id long, request_id string, timestamp timestamp, script_hash string, is_malicious boolean, confidence double, model_version string, api_key_prefix string, processing_time_ms double"
CHUNKS = "content string, db_id long, chunk_index int, chunk_id long, total_chunks int, token_count int, chunk_type string, start_token int, end_token int, function_name string, line_start int, line_end int, parent_id string, parent_context string, label string, source string, metadata map<string,string>"
POINTS = "point_id long, vector array<double>, db_id long, chunk_index int, total_chunks int, token_count int, code_preview string, parent_id string, parent_context string, label string, label_binary int, source string, language string, metadata map<string,string>"
KNOWLEDGE = "point_id string, description string, cve_id string, severity string, type string, pattern string, metadata map<string,string>"
TABLES = {"samples": SAMPLES, "dataset_versions": VERSIONS, "scan_history": SCANS, "chunks": CHUNKS, "points": POINTS, "knowledge": KNOWLEDGE}


#: What the samples table holds of its rows when they are written.
SAMPLE_RULES = Rules(
    checks={"label": "label IN ('malicious', 'benign')", "hash": "length(content_hash) <= 64", "source": "length(source) <= 100"},
    unique=("content_hash",), required=("content_hash", "content", "label", "source"), created="created_at", updated="updated_at",
)


def samples_table(spark: SparkSession, folder: str, buckets: int = 16) -> KeyedTable:
    """The samples as a keyed table with its rules, made where there is none."""
    return KeyedTable.create(spark, folder, SAMPLES, "id", buckets, SAMPLE_RULES)


def create(spark: SparkSession, folder: str) -> None:
    """An empty table of each relation under folder, where there is none yet; samples by label, as queries filter on it."""
    for name, schema in TABLES.items():
        writer = spark.createDataFrame([], schema).write.mode("ignore")
        (writer.partitionBy("label") if name == "samples" else writer).parquet(f"{folder}/{name}")


def conformed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with exactly the schema's columns and types; what they lack is null, what they have besides goes."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def stamped(rows: DataFrame) -> DataFrame:
    """created_at where it is missing, and updated_at, set to now."""
    now = F.current_timestamp().cast("timestamp_ntz")
    created = F.coalesce("created_at", now) if "created_at" in rows.columns else now
    return rows.withColumn("created_at", created).withColumn("updated_at", now)
