"""Vector search over arrays of doubles: exact cosine, in blocks of queries; ranks, levels, aggregation and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BOOSTED_WORDS, words_in
from .vectorindex import best

# Least scores by mode.
THRESHOLDS = {"default": 0.30, "strict": 0.45, "lenient": 0.15}
#: Queries that meet one vector in a block.
QUERY_BLOCK = 512


def threshold(mode: str = "default", value: float | None = None, model: dict[str, float] | None = None) -> float:
    """An explicit value, else the model's for this mode, else the mode's."""
    return value if value is not None else (model or {}).get(mode, THRESHOLDS[mode])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def scored(queries: DataFrame, vectors: DataFrame, blocks: int | None = None) -> DataFrame:
    """query_id, vec_id, score and the vectors' other columns, for a stated set of queries (query_id, q) against all
    vectors (vec_id, v). Queries are dealt to blocks; a vector visits each block, in one of several cells, so that
    neither side is held whole."""
    blocks = blocks or max(1, -(-queries.count() // QUERY_BLOCK))
    cells = 16
    q = queries.select("query_id", normalised(F.col("q")).alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    v = vectors.withColumn("v", normalised(F.col("v"))).withColumn("cell", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return v.join(q, ["block", "cell"]).withColumn("score", dot(F.col("q"), F.col("v"))).drop("block", "cell", "q", "v")


def filtered_search(queries: DataFrame, points: DataFrame, where: dict[str, str], k: int = 5, least: float = THRESHOLDS["default"]) -> DataFrame:
    """The k best points of each query among those whose columns have the given values, all of them, from a least score on."""
    for name, value in where.items():
        points = points.filter(F.col(name) == value)
    return best(queries, points, k, least=least)


def top_k(scores: DataFrame, k: int, *, least: float | None = None, per: list[str] = ["query_id"], id: str = "vec_id") -> DataFrame:
    """The k best of each query (score, then id), ranked from 1."""
    rows = scores.filter(F.col("score") >= least) if least is not None else scores
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*per).orderBy(F.desc("score"), id))).filter(F.col("rank") <= k)


def balanced(scores: DataFrame, limit: int, least: float) -> DataFrame:
    """Half of the limit for each label (one at least), merged by score."""
    halves = top_k(scores, max(1, limit // 2), least=least, per=["query_id", "label"])
    return halves.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def to_documents(hits: DataFrame, strategy: str = "max_score", top_n: int = 3) -> DataFrame:
    """query_id, db_id, score, num_chunks, vec_id and label of the best chunk; hits without a db_id go."""
    hits = hits.filter("db_id is not null")
    best = F.max_by(F.struct("vec_id", "label"), F.struct("score", -F.col("vec_id"))).alias("best")
    if strategy == "average_top_n":
        hits = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_id", "db_id").orderBy(F.desc("score"), "vec_id")))
        score = F.avg(F.when(F.col("_r") <= top_n, F.col("score")))
    elif strategy == "weighted_avg":
        score = F.when(F.sum("score") > 0, F.sum(F.col("score") * F.col("score")) / F.sum("score")).otherwise(0.0)
    else:
        score = F.max("score")
    return hits.groupBy("query_id", "db_id").agg(score.alias("score"), F.count(F.lit(1)).alias("num_chunks"), best).select("query_id", "db_id", "score", "num_chunks", F.col("best.vec_id").alias("vec_id"), F.col("best.label").alias("label"))


def with_content(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """Full texts joined last; flags tell hits whose document is missing."""
    return hits.join(samples.select(F.col("id").alias("db_id"), "content", "source"), "db_id", "left").withColumn("content_fetch_failed", F.col("content").isNull())


def boosted(hits: DataFrame, code: str = "code", factor: float = 1.2) -> DataFrame:
    """Scores times factor where the code has one of the words, in any case."""
    hit = F.size(words_in(F.coalesce(F.col(code), F.lit("")), BOOSTED_WORDS)) > 0
    return hits.withColumn("boosted", hit).withColumn("original_score", F.col("score")).withColumn("score", F.when(hit, F.col("score") * factor).otherwise(F.col("score")))


def diversified(hits: DataFrame, similar: Column, penalty: float = 0.9) -> DataFrame:
    """Scores times penalty where an earlier hit of the query is similar. `similar` compares a.code with b.code; a query's
    hits are few (a top k), and only they meet."""
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    a, b = ranked.alias("a"), ranked.select("query_id", "rank", "code").alias("b")
    late = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.rank") < F.col("a.rank")) & similar, "left_semi").select("query_id", "rank", F.lit(True).alias("diversity_penalized"))
    out = ranked.join(late, ["query_id", "rank"], "left").withColumn("diversity_penalized", F.coalesce("diversity_penalized", F.lit(False)))
    return out.withColumn("score", F.when(F.col("diversity_penalized"), F.col("score") * penalty).otherwise(F.col("score"))).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def blended(score: Column, other: Column, share: float = 0.6) -> Column:
    return F.lit(share) * other + F.lit(1 - share) * score


def always_k(scores: DataFrame, k: int, least: float, *, balance: bool = True, per_label: int = 1) -> DataFrame:
    """k hits of each query wherever there are as many: level 1 passes the threshold (label-balanced if asked), level 2
    is without it, level 3 without balance; a hit counts at its first level, and level 3 is marked low_confidence."""
    one = (balanced(scores, 2 * k, least) if balance else top_k(scores, 2 * k, least=least)).withColumn("level", F.lit(1))
    two = balanced(scores, 3 * k, 0.0).withColumn("level", F.lit(2))
    three = top_k(scores, 2 * k).withColumn("level", F.lit(3))
    merged = one.unionByName(two).unionByName(three).groupBy("query_id", "vec_id").agg(F.min("level").alias("level"), F.max("score").alias("score"), F.max("label").alias("label"))
    out = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("level", F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return out.withColumn("low_confidence", F.col("level") == 3)


def topped_up(hits: DataFrame, scores: DataFrame, per_label: int) -> DataFrame:
    """hits, and for each query the best of a label that has fewer than per_label hits, up to twice what is missing."""
    labels = scores.select("query_id", "label").distinct()
    have = labels.join(hits.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n")), ["query_id", "label"], "left").select("query_id", "label", (F.lit(per_label) - F.coalesce("n", F.lit(0))).alias("need")).filter("need > 0")
    fresh = top_k(scores.join(hits.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti"), 2 * per_label, per=["query_id", "label"])
    more = fresh.join(have, ["query_id", "label"]).filter(F.col("rank") <= 2 * F.col("need")).select("query_id", "vec_id", "label", "score")
    return hits.select("query_id", "vec_id", "label", "score").unionByName(more)


def retrieval_figures(hits: DataFrame, low: float = 0.2, most_low: float = 0.5) -> DataFrame:
    """Per query: mean, least, largest and median score, share of hits under the least mode's threshold, labels, alerts."""
    f = hits.groupBy("query_id").agg(
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.percentile("score", 0.5).alias("median_score"),
        F.avg(F.when(F.col("score") < THRESHOLDS["default"], 1.0).otherwise(0.0)).alias("low_rate"), F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"),
    )
    return f.withColumn("balanced", (F.col("malicious") > 0) & (F.col("benign") > 0)).withColumn("alert", (F.col("avg_score") < low) | (F.col("low_rate") > most_low))


def mean_pooled(rows: DataFrame, key: str, v: str = "v") -> DataFrame:
    """The mean vector of each key's rows (by place, with partial sums)."""
    each = rows.select(key, F.posexplode(v).alias("place", "x")).groupBy(key, "place").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias(v))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """An upsert: of the rows of a key the last stays."""
    columns = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"), F.max(order).alias(order)).select(key, order, "r.*")


def reranked(hits: DataFrame, k: int, strategy: str = "heuristic", similar: Column | None = None, cross: Column | None = None) -> DataFrame:
    """hits by a strategy (none, heuristic, cross_encoder or hybrid), cut to k: boost and diversity, then a given cross-encoder
    column blended in."""
    if strategy in ("heuristic", "hybrid"):
        hits = boosted(hits)
        if similar is not None:
            hits = diversified(hits, similar)
    if strategy in ("cross_encoder", "hybrid") and cross is not None:
        hits = hits.withColumn("score", blended(F.col("score"), cross))
    return top_k(hits.drop("rank"), k)
