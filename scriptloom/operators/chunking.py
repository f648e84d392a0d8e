"""Documents to chunks: windows of tokens as one expression, with ids that depend on content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def tokens(content: Column) -> Column:
    return F.array_remove(F.split(content, f"{t.BLANK}+"), "")


def sliding(rows: DataFrame, size: int = 128, overlap: int = 16, *, content: str = "content", id: str = "id") -> DataFrame:
    """A row for each window: chunk_index, content, token_count, start_token, end_token, total_chunks, chunk_id, parent_id,
    parent_context, with the row's other columns. Texts that fit in one window keep their content as it stands. Windows are
    made before they become rows, so that none carries the whole text or its tokens."""
    stride = size - overlap if size > overlap else max(1, size // 2)
    c = F.col(content)
    names = rows.columns
    rows = rows.filter(~t.is_blank(c)).withColumn("_t", tokens(c)).withColumn("_n", F.size("_t"))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / stride)).cast("int")
    rows = rows.withColumn("parent_id", t.parent_id(c, F.col(id))).withColumn("parent_context", t.first_lines(c)).withColumn("total_chunks", last + 1)
    windows = F.when(F.col("_n") <= size, F.array(c)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("_t", i * stride + 1, size), " ")))
    kept = [*(n for n in names if n != content), "_n", "parent_id", "parent_context", "total_chunks"]
    rows = rows.select(*kept, F.posexplode(windows).alias("chunk_index", content))
    start = F.col("chunk_index") * stride
    out = rows.select(*names, "_n", "parent_id", "parent_context", "total_chunks", "chunk_index").withColumn("start_token", start).withColumn("end_token", F.least(F.col("_n"), start + size))
    return out.withColumn("token_count", F.col("end_token") - F.col("start_token")).withColumn("chunk_id", t.chunk_id(F.col(content), F.col("chunk_index"))).withColumn("chunk_type", F.lit("sliding_window")).drop("_n")


def whole(rows: DataFrame, *, content: str = "content", id: str = "id") -> DataFrame:
    """One chunk for each document."""
    c = F.col(content)
    return rows.withColumn("chunk_index", F.lit(0)).withColumn("total_chunks", F.lit(1)).withColumn("parent_id", t.parent_id(c, F.col(id))).withColumn("parent_context", t.first_lines(c)).withColumn("chunk_id", t.chunk_id(c, F.lit(0))).withColumn("chunk_type", F.lit("whole"))


def chunk(rows: DataFrame, strategy: str = "sliding", **how) -> DataFrame:
    if strategy == "hierarchical":
        from .code import hierarchical

        return hierarchical(rows, **how)
    return sliding(rows, **how) if strategy == "sliding" else whole(rows)


def point_id(id: Column, content: Column, index: Column) -> Column:
    return F.coalesce(id, t.chunk_id(content, index))
