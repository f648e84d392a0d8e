"""All registered queries of the library, with their DuckDB counterparts."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry

for _module in ("relational", "texts", "search", "flows", "feeds", "stores", "ingest"):
    importlib.import_module(f"scriptloom.plans.{_module}")


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that pass validation, once each, with features, by label and source."""
    from .plans import flows

    return flows.curated(spark, sf_dir).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("entropy"), 6).alias("avg_entropy"))
