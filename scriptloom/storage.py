"""The folder that the driver and all executors share, and tables written there to end their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it isn't set, a local session gets a temporary folder, and a cluster an error, as its
    executors could not read the driver's folders."""
    context = spark.sparkContext
    if base := context.getConf().get("spark.checkpoint.dir"):
        return base
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends there, and lost executors cost nothing before it."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
