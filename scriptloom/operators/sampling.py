"""Splitting, balancing and augmentation, with chance from a portable hash of seed and id (see text.seeded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from . import quality

TECHNIQUES = ["base64", "hex", "rot13", "rename_vars", "split_strings", "add_junk"]
NATIVE = ["base64", "hex", "rot13", "add_junk"]
# Lines that do nothing.
JUNK = ["_ = 1 + 1", "__ = 'junk'", "___ = [1, 2, 3]", "____ = {'a': 1}", "_____ = None"]


def order_key(seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


def hash_rank(rows: DataFrame, seed: int = 42, by: str | None = None) -> DataFrame:
    """rows with rank (from 1) in hash order, in all or per value of `by`: ranks inside the hash's leading digits, after
    the counts of the cells before, so no window holds a whole class."""
    rows = rows.withColumn("_o", order_key(seed)).withColumn("_cell", F.substring("_o", 1, 2))
    keys = [by] if by else []
    cells = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    ahead = cells.withColumn("_ahead", F.sum("_n").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(ahead), [*keys, "_cell"]).withColumn("rank", F.col("_ahead") + F.row_number().over(W.partitionBy(*keys, "_cell").orderBy("_o", "id"))).drop("_o", "_cell", "_ahead")


def split(rows: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with part: the first ceil(n * fraction) in hash order are test, the rest train."""
    n = rows.agg(F.ceil(F.count(F.lit(1)) * F.lit(fraction)).alias("_test"))
    return hash_rank(rows, seed).join(F.broadcast(n)).withColumn("part", F.when(F.col("rank") <= F.col("_test"), "test").otherwise("train")).drop("_test", "rank")


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("label") == "malicious").alias("m"), F.count_if(F.col("label") == "benign").alias("b"))


def undersample(rows: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Malicious and benign rows; the class that is too large for malicious = ratio * benign is cut in hash order."""
    n = class_counts(rows).select(F.least(F.col("m"), F.floor(F.col("b") * ratio)).alias("km"), F.least(F.col("b"), F.floor(F.col("m") / ratio)).alias("kb"))
    ranked = hash_rank(rows.filter(F.col("label").isin("malicious", "benign")), seed, "label").join(F.broadcast(n))
    return ranked.filter(F.col("rank") <= F.when(F.col("label") == "malicious", F.col("km")).otherwise(F.col("kb"))).drop("rank", "km", "kb")


def oversample(rows: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Malicious and benign rows; the class that is too small is repeated in hash order (column copy, from 0) up to its target."""
    n = class_counts(rows).select("m", "b", F.greatest(F.col("m"), F.floor(F.col("b") * ratio)).alias("tm"), F.greatest(F.col("b"), F.floor(F.col("m") / ratio)).alias("tb"))
    ranked = hash_rank(rows.filter(F.col("label").isin("malicious", "benign")), seed, "label").join(F.broadcast(n))
    mine, target = (F.when(F.col("label") == "malicious", F.col(x)).otherwise(F.col(y)) for x, y in (("m", "b"), ("tm", "tb")))
    times = F.floor((target - F.col("rank")) / mine).cast("int")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).drop("rank", "m", "b", "tm", "tb")


def hybrid(rows: DataFrame, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Both classes cut to the smaller, then malicious rows repeated up to int(smaller * ratio)."""
    n = class_counts(rows).select(F.least("m", "b").alias("k"))
    ranked = hash_rank(rows.filter(F.col("label").isin("malicious", "benign")), seed, "label").join(F.broadcast(n)).filter(F.col("rank") <= F.col("k"))
    target = F.when(F.col("label") == "malicious", F.greatest(F.col("k"), F.floor(F.col("k") * ratio))).otherwise(F.col("k"))
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((target - F.col("rank")) / F.col("k")).cast("int")))).drop("rank", "k")


def forced_undersample(rows: DataFrame, most: float = 1.5, seed: int = 42) -> DataFrame:
    """Before training: classes are cut to the smaller one's size if the larger has more than `most` times as many."""
    n = class_counts(rows).select(F.when(F.greatest("m", "b") > F.lit(most) * F.least("m", "b"), F.least("m", "b")).otherwise(F.greatest("m", "b")).alias("k"))
    ranked = hash_rank(rows.filter(F.col("label").isin("malicious", "benign")), seed, "label").join(F.broadcast(n))
    return ranked.filter(F.col("rank") <= F.col("k")).drop("rank", "k")


def junk_added(content: Column, id: Column, seed: int = 42) -> Column:
    """After a line in ten (by hash) one of five lines that do nothing."""

    def one(line: Column, i: Column) -> Column:
        chance = t.seeded(id.cast("string"), i.cast("string"), seed=seed)
        extra = F.element_at(F.array(*map(F.lit, JUNK)), (F.floor(chance / 10) % 5 + 1).cast("int"))
        return F.when(chance % 10 == 0, F.concat(line, F.lit("\n"), extra)).otherwise(line)

    return F.array_join(F.transform(t.lines(content), one), "\n")


def encoded(content: Column, technique: Column, id: Column, seed: int = 42, other: Column | None = None) -> Column:
    """The text by a technique: encodings stand in a one-line assignment; `other` gives those that need a parser."""
    return (
        F.when(technique == "base64", F.concat(F.lit("data = '"), t.as_base64(content), F.lit("'  # base64")))
        .when(technique == "hex", F.concat(F.lit("data = '"), t.as_hex(content), F.lit("'  # hex")))
        .when(technique == "rot13", F.concat(F.lit("data = '''"), t.rot13(content), F.lit("'''  # rot13")))
        .when(technique == "add_junk", junk_added(content, id, seed))
        .otherwise(other if other is not None else content)
    )


def variants(rows: DataFrame, n: int = 2, techniques: list[str] = NATIVE, seed: int = 42) -> DataFrame:
    """n variants of each malicious row: id null, source and metadata tell the technique and the parent."""
    bad = rows.filter(F.col("label") == "malicious").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    pick = F.element_at(F.array(*map(F.lit, techniques)), (t.seeded(F.col("id").cast("string"), F.col("copy").cast("string"), seed=seed) % len(techniques) + 1).cast("int"))
    # Texts first: next to a null named id, the lambdas of add_junk would take that one for the parent's id.
    bad = bad.withColumn("technique", pick).withColumn("content", encoded(F.col("content"), F.col("technique"), F.col("id"), seed)).withColumnRenamed("id", "parent_id")
    return bad.select(F.lit(None).cast("long").alias("id"), "content", "label", F.concat("source", F.lit("_augmented")).alias("source"), "technique", "parent_id", "copy")


def augmented(rows: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    return rows.unionByName(variants(rows, n, seed=seed), allowMissingColumns=True)


def applied(rows: DataFrame, techniques: list[str] = NATIVE, seed: int = 42) -> DataFrame:
    """Each row by each technique, where the text changes."""
    each = rows.withColumn("technique", F.explode(F.array(*map(F.lit, techniques))))
    out = each.withColumn("changed", encoded(F.col("content"), F.col("technique"), F.col("id"), seed)).filter("changed <> content")
    return out.withColumn("content", F.col("changed")).drop("changed").withColumn("source", F.concat("source", F.lit("_"), "technique"))


def class_weights(rows: DataFrame, how: str = "inverse_frequency") -> DataFrame:
    """label, n, weight: total / n or its root, scaled to add up to the number of classes; 1.0 each if there is one class only."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(0))
    raw = F.sum("n").over(every) / F.col("n")
    raw = F.sqrt(raw) if how == "sqrt_inverse" else raw
    rows = counts.withColumn("raw", raw).withColumn("k", F.count(F.lit(1)).over(every))
    return rows.withColumn("weight", F.when(F.col("k") < 2, 1.0).otherwise(F.col("raw") * F.col("k") / F.sum("raw").over(every))).select("label", "n", "weight")


def holdout(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """rows with part: the first n of each label in hash order are query, the rest train."""
    return hash_rank(rows, seed, "label").withColumn("part", F.when(F.col("rank") <= n, "query").otherwise("train")).drop("rank")


def from_points(points: DataFrame, samples: DataFrame, language: str = "python") -> DataFrame:
    """Samples (content, label, source, metadata) of the documents whose first chunk, or only one, is among the points: fetched
    by id, sanitised (what is refused goes) and given a header of their context. Points without an id are of no document, and
    neither are those of id 0."""
    ids = points.filter("db_id is not null and db_id <> 0 and (chunk_index = 0 or chunk_index is null)").select(F.col("db_id").alias("id")).distinct()
    clean = quality.sanitized(samples.join(ids, "id", "left_semi")).filter("reason is null")
    told = {"language": F.lit(language), "source": F.col("source"), "label": F.col("label")} | ({"file_path": F.col("path")} if "path" in samples.columns else {})
    kept = F.create_map(F.lit("db_id"), F.col("id").cast("string"), F.lit("original_source"), F.col("source"))
    return clean.select(t.with_context(F.col("clean"), "structured", **told).alias("content"), "label", F.lit("qdrant_code_samples").alias("source"), kept.alias("metadata"))
