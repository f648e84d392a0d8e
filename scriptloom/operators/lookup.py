"""A store laid out for look-ups: bucketed and sorted by hash, with Bloom filters, so that the store isn't shuffled.

An id list or an incoming batch is dealt by the store's own buckets and joined to it bucket by bucket; a single hash opens
one bucket's file and skips its row groups by bounds and Bloom filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lay_out(rows: DataFrame, name: str, folder: str, *, key: str = "content_hash", buckets: int | None = None, more: tuple[str, ...] = ("id",)) -> DataFrame:
    """Writes rows as a table of the session's catalog under `folder`, in buckets of the key, sorted, with Bloom filters on the
    key and `more`. There are as many buckets as shuffle partitions unless told otherwise: with fewer, Spark would rather
    shuffle both sides. A table of that name is an error."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(buckets, key).write.option("path", f"{folder}/{name}").option("compression", "zstd").bucketBy(buckets, key).sortBy(key)
    for column in (key, *more):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.saveAsTable(name)
    return spark.table(name)




def found(store: DataFrame, keys: DataFrame, key: str = "content_hash") -> DataFrame:
    """The store's rows of these keys. The keys are dealt to the store's buckets; the store stays where it is."""
    return store.join(keys.select(key).distinct().hint("merge"), key, "left_semi")


def missing(rows: DataFrame, store: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose key the store hasn't got; rows with a null key are missing. The store is neither shuffled nor sent out."""
    return rows.join(store.select(key).hint("merge"), key, "left_anti")


def point(store: DataFrame, *values: str, key: str = "content_hash") -> DataFrame:
    """Rows of a few keys: their buckets alone are opened."""
    return store.filter(F.col(key).isin(list(values)))
