"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so (the first sentence end or line end after a least length), so equal texts
give equal chunks and long texts are compared as short lists. Each chunk gets an identifier of hash and length, which
is verified: the distinct contents behind each identifier are counted, and a document with a chunk whose identifier
has more than one content is compared by its whole text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A chunk ends at the first of these characters after 1,024 others, or after 4,096.
CHUNK = r"(?s).{1023,4094}?[.!?\n]|.{1,4096}"


def chunk_id(chunk: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(chunk)), F.lit("-"), F.length(chunk).cast("string"))


def collisions(chunks: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content; chunks has id and chunk."""
    return chunks.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("id")


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", identify: Callable[[Column], Column] = chunk_id) -> DataFrame:
    """For each row: keep_id (the largest key of the rows with the same text), group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are equal. Rows that repeat a key and its text are told apart by
    nothing, and are all kept if their key is the largest. A row with a null key is kept only where no row with its text
    has a key; kept is never null. Very long texts are read whole. Extra columns of docs are ignored. No rows give no rows.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = base.select("doc_id", "t", F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    rows = cut.select("doc_id", "t", F.array_join(F.transform("chunks", identify), " ").alias("recipe"), F.sha2("t", 256).alias("text_sha256"))
    clash = collisions(cut.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk"))
    rows = rows.drop("t")
    if not clash.isEmpty():
        sha = F.sha2("t", 256).alias("text_sha256")
        marked = cut.select(sha, F.explode(F.transform("chunks", identify)).alias("id")).join(clash, "id", "left_semi").select("text_sha256").distinct()
        whole = base.select(sha, F.col("t").alias("whole")).join(marked, "text_sha256", "left_semi").distinct()
        rows = rows.join(whole, "text_sha256", "left").select("doc_id", "text_sha256", F.concat("recipe", F.coalesce(F.concat(F.lit(" "), "whole"), F.lit(""))).alias("recipe"))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    # written, so that the join's sides are plain exchanges and Spark can split a group with very many copies
    out = rows.join(stored(groups), "recipe", "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""
