"""Registered queries: vector search, near duplicates and upserts. Search queries are the vectors whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, dedup, metrics, store, vectorindex
from ..operators import vectors as v
from ..registry import query
from ..functions.text import BOOSTED_WORDS
from ..sources.samples import EXPLOIT_PATTERNS, SAMPLES_SQL, SCRIPTS_SQL, VECTORS_SQL, samples, scripts, table, vectors

DOCS = f"WITH {SAMPLES_SQL} "

_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
_SCORED = f"""WITH {VECTORS_SQL}, n AS (SELECT *, {_NORM} AS norm FROM vectors),
 u AS (SELECT vec_id, db_id, chunk_index, label, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS v FROM n),
 scored AS (SELECT q.vec_id AS query_id, q.label AS query_label, u.vec_id, u.db_id, u.chunk_index, u.label, list_dot_product(q.v, u.v) AS score FROM u, u q WHERE q.vec_id % 100 = 0)"""


#: The most hits of one label that any query here looks at.
POOL = 50


def asked(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The best of each query and label, as many as any ranking here needs."""
    return vectorindex.best(asked(spark, d), vectors(spark, d), POOL, per="label")


def _rank(rows: str, k: int, per: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY score DESC, vec_id) AS rank FROM {rows}) WHERE rank <= {k})"


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    for n in names:
        rows = rows.withColumn(n, F.round(n, 6))
    return rows


@query("vec_02_pooled", f"WITH {VECTORS_SQL}, e AS (SELECT db_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors), p AS (SELECT db_id, i, avg(x) AS x FROM e GROUP BY db_id, i) SELECT db_id, round(sum(x), 6) AS total, count(*) AS dims FROM p GROUP BY db_id")
def _(spark, d):
    pooled = v.mean_pooled(vectors(spark, d), "db_id")
    return pooled.select("db_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("v").cast("long").alias("dims"))


@query("vec_03_normalised", f"WITH {VECTORS_SQL} SELECT vec_id, round({_NORM}, 6) AS norm, round(v[1] / {_NORM}, 6) AS first FROM vectors")
def _(spark, d):
    return vectors(spark, d).select("vec_id", F.round(v.norm(F.col("v")), 6).alias("norm"), F.round(F.get(v.normalised(F.col("v")), F.lit(0)), 6).alias("first"))


@query("vec_04_norm_figures", f"WITH {VECTORS_SQL}, n AS (SELECT {_NORM} AS norm FROM vectors) SELECT round(avg(norm), 6) AS mean_norm, round(stddev_pop(norm), 6) AS std_norm, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm FROM n")
def _(spark, d):
    f = metrics.spread(vectors(spark, d).select(v.norm(F.col("v")).alias("norm")), "norm")
    return _rounded(f, *f.columns)


@query("vec_05_top_k", f"{_SCORED} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM {_rank('scored', 10)} WHERE score >= 0.0")
def _(spark, d):
    return _rounded(v.top_k(scored(spark, d), 10, least=0.0).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score"), "score")


@query("vec_05_top_k_of_label", f"{_SCORED} SELECT query_id, vec_id, round(score, 6) AS score FROM {_rank('''(SELECT * FROM scored WHERE label = 'malicious' AND score >= 0.1)''', 5)}")
def _(spark, d):
    return _rounded(v.top_k(scored(spark, d).filter("label = 'malicious'"), 5, least=0.1).select("query_id", "vec_id", "score"), "score")


@query("vec_06_balanced", f"{_SCORED} SELECT query_id, vec_id, label, round(score, 6) AS score FROM {_rank('''(SELECT * FROM scored WHERE score >= 0.0)''', 5, 'query_id, label')}")
def _(spark, d):
    return _rounded(v.balanced(scored(spark, d), 10, 0.0).select("query_id", "vec_id", "label", "score"), "score")


def values_sql(texts: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in texts) + ")"


_PATTERNS = [row[0] for row in EXPLOIT_PATTERNS]


@query("vec_07_knowledge_hits", f"WITH {SCRIPTS_SQL} SELECT id, pattern FROM scripts, {values_sql(_PATTERNS)} k(pattern) WHERE contains(content, pattern)")
def _(spark, d):
    """Scripts that hold an exploit pattern; the patterns are a fixed array."""
    return scripts(spark, d).select("id", F.explode(F.filter(F.array(*map(F.lit, _PATTERNS)), lambda p: F.contains("content", p))).alias("pattern"))


_CHUNKS = _rank("scored", 30)
for _name, _score in (("max_score", "max(score)"), ("weighted_avg", "CASE WHEN sum(score) > 0 THEN sum(score * score) / sum(score) ELSE 0 END"), ("average_top_n", "avg(score) FILTER (r <= 2)")):

    @query(f"vec_08_{_name}", f"{_SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, db_id ORDER BY score DESC, vec_id) AS r FROM {_CHUNKS}) SELECT query_id, db_id, round({_score}, 6) AS score, count(*) AS num_chunks, max(vec_id) FILTER (r = 1) AS vec_id FROM h GROUP BY query_id, db_id")
    def _(spark, d, name=_name):
        out = v.to_documents(v.top_k(scored(spark, d), 30), name, 2)
        return _rounded(out.select("query_id", "db_id", "score", "num_chunks", "vec_id"), "score")


@query("vec_09_with_content", f"{_SCORED}, {SAMPLES_SQL}, h AS (SELECT query_id, db_id, max(score) AS score FROM {_CHUNKS} GROUP BY query_id, db_id) SELECT query_id, db_id, s.id IS NULL AS content_fetch_failed, md5(s.content) AS digest FROM h LEFT JOIN samples s ON s.id = h.db_id")
def _(spark, d):
    hits = v.to_documents(v.top_k(scored(spark, d), 30))
    return v.with_content(hits, samples(spark, d)).select("query_id", "db_id", "content_fetch_failed", F.md5("content").alias("digest"))


_BOOSTED = f"len(list_filter({BOOSTED_WORDS!r}, lambda w: contains(lower(code), w))) > 0"
_HITS = f"{_SCORED}, {SAMPLES_SQL}, hits AS (SELECT h.query_id, h.vec_id, h.score, coalesce(s.content, '') AS code FROM {_CHUNKS} h LEFT JOIN samples s ON s.id = h.db_id)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    code_of = samples(spark, d).select(F.col("id").alias("db_id"), F.col("content").alias("code"))
    return v.top_k(scored(spark, d), 30).select("query_id", "vec_id", "db_id", "score").join(code_of, "db_id", "left").select("query_id", "vec_id", "score", F.coalesce("code", F.lit("")).alias("code"))


@query("vec_10_boosted", f"{_HITS} SELECT query_id, vec_id, {_BOOSTED} AS boosted, round(score * CASE WHEN {_BOOSTED} THEN 1.2 ELSE 1 END, 6) AS score FROM hits")
def _(spark, d):
    return _rounded(v.boosted(_hits(spark, d)).select("query_id", "vec_id", "boosted", "score"), "score")


@query("vec_11_diversified", f"{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits) SELECT query_id, vec_id, EXISTS (SELECT 1 FROM r b WHERE b.query_id = a.query_id AND b.rank < a.rank AND b.code = a.code) AS diversity_penalized FROM r a")
def _(spark, d):
    return v.diversified(_hits(spark, d), F.col("a.code") == F.col("b.code")).select("query_id", "vec_id", "diversity_penalized")


@query("vec_11_similar")
def _(spark, d):
    """The same by the ratio of matching blocks of the whole codes, within each query's ten best hits."""
    hits = v.top_k(_hits(spark, d), 10).drop("rank")
    ranked = hits.withColumn("rank", F.row_number().over(_window()))
    pairs = ranked.alias("a").join(ranked.alias("b"), "query_id").filter("b.rank < a.rank").select("query_id", F.col("a.vec_id").alias("vec_id"), F.round(code.similarity("a.code", "b.code"), 6).alias("ratio"))
    return pairs.groupBy("query_id", "vec_id").agg(F.max("ratio").alias("ratio"), (F.max("ratio") >= 0.95).alias("diversity_penalized"))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


@query("vec_12_blended", f"{_SCORED} SELECT query_id, vec_id, round(0.6 * (vec_id % 7) / 7 + 0.4 * score, 6) AS score FROM {_CHUNKS}")
def _(spark, d):
    return _rounded(v.top_k(scored(spark, d), 30).select("query_id", "vec_id", v.blended(F.col("score"), F.pmod("vec_id", F.lit(7)) / 7).alias("score")), "score")


_LEVELS = f"""{_SCORED}, l AS (
  SELECT query_id, vec_id, label, score, 1 AS level FROM {_rank("(SELECT * FROM scored WHERE score >= 0.2)", 10, "query_id, label")}
  UNION ALL SELECT query_id, vec_id, label, score, 2 FROM {_rank("(SELECT * FROM scored WHERE score >= 0.0)", 15, "query_id, label")}
  UNION ALL SELECT query_id, vec_id, label, score, 3 FROM {_rank("scored", 20)}),
 m AS (SELECT query_id, vec_id, min(level) AS level, max(score) AS score FROM l GROUP BY query_id, vec_id)"""


@query("vec_13_always_k", f"{_LEVELS} SELECT query_id, vec_id, level::INT AS level, rank, level = 3 AS low_confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, score DESC, vec_id) AS rank FROM m) WHERE rank <= 10")
def _(spark, d):
    return v.always_k(scored(spark, d), 10, 0.2).select("query_id", "vec_id", "level", F.col("rank").cast("long").alias("rank"), "low_confidence")


@query("ded_09_merged_levels", f"{_LEVELS} SELECT query_id, level::INT AS level, count(*) AS n FROM m GROUP BY query_id, level")
def _(spark, d):
    s = scored(spark, d)
    levels = v.balanced(s, 20, 0.2).select("query_id", "vec_id", F.lit(1).alias("level")).unionByName(v.balanced(s, 30, 0.0).select("query_id", "vec_id", F.lit(2).alias("level"))).unionByName(v.top_k(s, 20).select("query_id", "vec_id", F.lit(3).alias("level")))
    return levels.groupBy("query_id", "vec_id").agg(F.min("level").alias("level")).groupBy("query_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("vec_14_topped_up", f"""{_SCORED}, h AS (SELECT * FROM {_rank('scored', 5)}), need AS (SELECT l.query_id, l.label, 3 - coalesce(c.n, 0) AS need FROM (SELECT DISTINCT query_id, label FROM scored) l LEFT JOIN (SELECT query_id, label, count(*) AS n FROM h GROUP BY query_id, label) c USING (query_id, label)),
 f AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.label ORDER BY s.score DESC, s.vec_id) AS k FROM scored s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = s.query_id AND h.vec_id = s.vec_id))
 SELECT query_id, vec_id, label FROM h UNION ALL SELECT f.query_id, f.vec_id, f.label FROM f JOIN need USING (query_id, label) WHERE need > 0 AND k <= 2 * need""")
def _(spark, d):
    s = scored(spark, d)
    return v.topped_up(v.top_k(s, 5), s, 3).select("query_id", "vec_id", "label")


@query("vec_16_retrieval_figures", f"{_SCORED} SELECT query_id, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(CASE WHEN score < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS low_rate, count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign FROM {_rank('scored', 10)} GROUP BY query_id")
def _(spark, d):
    f = v.retrieval_figures(v.top_k(scored(spark, d), 10)).drop("balanced", "alert")
    return _rounded(f, "avg_score", "min_score", "max_score", "median_score", "low_rate")


@query("vec_17_collection", f"WITH {VECTORS_SQL} SELECT count(*) AS total, count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign FROM vectors")
def _(spark, d):
    return vectors(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"))


@query("vec_20_scroll", f"WITH {VECTORS_SQL} SELECT vec_id, db_id, chunk_index, label FROM vectors")
def _(spark, d):
    return vectors(spark, d).drop("v")


_RELEVANT = f"(SELECT *, label = query_label AS relevant FROM {_rank('scored', 5)} WHERE vec_id <> query_id)"


def _judged(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = vectors(spark, d)
    truth = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    hits = v.top_k(scored(spark, d), k).filter("vec_id <> query_id")
    return hits.join(truth, "query_id").withColumn("relevant", F.col("label") == F.col("query_label"))


@query("evl_09_ranked_quality", f"{_SCORED}, q AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS mrr, max(relevant::INT)::DOUBLE AS hit, avg(relevant::INT) AS precision FROM {_RELEVANT} GROUP BY query_id) SELECT round(avg(mrr), 6) AS mean_mrr, round(avg(hit), 6) AS mean_hit, round(avg(precision), 6) AS mean_precision, round(stddev_pop(precision), 6) AS std_precision FROM q")
def _(spark, d):
    f = metrics.spread(metrics.ranked_quality(_judged(spark, d, 5), 5), "mrr", "hit", "precision").select("mean_mrr", "mean_hit", "mean_precision", "std_precision")
    return _rounded(f, *f.columns)


_SWEEP = f"""{_SCORED}, j AS (SELECT score, label = query_label AS relevant FROM {_rank('scored', 50)} WHERE vec_id <> query_id),
 t AS (SELECT unnest(range(50)) AS step), c AS (SELECT step::INT AS step, count(*) FILTER (relevant AND s >= step) AS tp, count(*) FILTER (NOT relevant AND s >= step) AS fp, (SELECT count(*) FROM j WHERE relevant) AS positives
   FROM t, (SELECT *, least(49, floor(score / (0.9 / 49) + 1e-9)) AS s FROM j) GROUP BY step),
 m AS (SELECT *, step * (0.9 / 49) AS threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(positives, 0), 0) AS r FROM c),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)"""


@query("evl_08_threshold_sweep", f"{_SWEEP} SELECT step, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1_score FROM f")
def _(spark, d):
    s = metrics.threshold_sweep(_judged(spark, d, 50).select("score", "relevant"))
    return _rounded(s.drop("threshold"), "precision", "recall", "f1_score")


@query("evl_08_best_threshold", f"{_SWEEP} SELECT round(threshold, 6) AS default_threshold FROM f ORDER BY round(f1, 9) DESC, step LIMIT 1")
def _(spark, d):
    s = metrics.threshold_sweep(_judged(spark, d, 50).select("score", "relevant")).withColumn("f1_score", F.round("f1_score", 9))
    return _rounded(metrics.best_thresholds(s).select("default_threshold"), "default_threshold")


# Near duplicates and upserts.


@query("ded_01_hashes", DOCS + "SELECT id, content_hash FROM samples")
def _(spark, d):
    return samples(spark, d).select("id", "content_hash")


@query("ded_02_exact", DOCS + "SELECT min(id) AS id, content_hash FROM samples WHERE content <> '' GROUP BY content_hash")
def _(spark, d):
    return dedup.exact(samples(spark, d)).select("id", "content_hash")


@query("ded_03_absent", DOCS + "SELECT id, content_hash FROM samples WHERE content_hash NOT IN (SELECT content_hash FROM samples WHERE label = 'benign')")
def _(spark, d):
    s = samples(spark, d)
    return dedup.absent(s, s.filter("label = 'benign'")).select("id", "content_hash")


_TOKENS = r"list_distinct(list_filter(string_split_regex(content, '\s+'), lambda x: x <> ''))"


@query("ded_04_jaccard", f"{DOCS}, t AS (SELECT id, {_TOKENS} AS t FROM samples) SELECT a.id, round(coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0), 6) AS jaccard FROM t a JOIN t b ON b.id = a.id + 1")
def _(spark, d):
    sets = samples(spark, d).select("id", dedup.token_set(F.col("content")).alias("t"))
    after = sets.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"))
    return sets.join(after, "id").select("id", F.round(dedup.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


_NEAR = f"""{DOCS}, x AS (SELECT min(id) AS id, any_value(content) AS content FROM samples WHERE content <> '' GROUP BY content_hash),
 t AS (SELECT id, {_TOKENS} AS t FROM x), e AS (SELECT id, unnest(t) AS w, len(t) AS n FROM t),
 p AS (SELECT a.id AS i, b.id AS j, count(*) AS c, any_value(a.n) AS ni, any_value(b.n) AS nj FROM e a JOIN e b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 GROUP BY a.id, b.id),
 near AS (SELECT i, j FROM p WHERE c / (ni + nj - c) >= 0.85)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """samples() without the labels' columns, so that no join moves the texts."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"))


@query("ded_05_near_pairs", f"{_NEAR} SELECT i, j FROM near")
def _(spark, d):
    return dedup.near_pairs(dedup.exact(_texts(spark, d), in_place=True), 0.85)


_GREEDY = f"""{_NEAR.replace("WITH ", "WITH RECURSIVE ", 1)},
 node AS MATERIALIZED (SELECT j AS id, list(i) AS earlier, row_number() OVER (ORDER BY j) AS k FROM near GROUP BY j),
 walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT w.k + 1, CASE WHEN len(list_filter(n.earlier, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, n.id) ELSE w.gone END
  FROM walk w JOIN node n ON n.k = w.k + 1)
 SELECT id FROM x WHERE id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))"""


@query("ded_05_greedy", _GREEDY)
def _(spark, d):
    return dedup.greedy_jaccard(_texts(spark, d)).select("id")


# The bands' recall isn't 1 by rule, but seeds are fixed: on the tables of the tests all near pairs share a band.
@query("ded_06_minhash", _GREEDY)
def _(spark, d):
    return dedup.two_stage(_texts(spark, d), "lsh").select("id")


@query("ded_07_two_stage", _GREEDY)
def _(spark, d):
    return dedup.two_stage(_texts(spark, d), "auto").select("id")


@query("ded_08_whole_rows", "SELECT DISTINCT source, lang, n_chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("source", "lang", "n_chars").dropDuplicates()


@query("snk_04_last_wins", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return v.last_wins(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("snk_05_knowledge_points", "SELECT md5(description) AS point_id, any_value(description) AS description, max_by(severity, item_id) AS severity, 'vulnerability' AS type FROM (SELECT item_id, text AS description, CASE WHEN item_id % 2 = 0 THEN 'HIGH' ELSE 'UNKNOWN' END AS severity FROM benchmark) WHERE trim(description) <> '' GROUP BY md5(description)")
def _(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("description"), F.when(F.col("item_id") % 2 == 0, "HIGH").alias("severity"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("point_id"))
    return store.knowledge_points(b)


@query("snk_06_patterns", "SELECT md5(text) AS point_id, 'malware_pattern' AS type FROM benchmark WHERE trim(text) <> '' GROUP BY 1")
def _(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("description"), F.lit("HIGH").alias("severity"), F.lit("x").alias("type"), F.lit(None).cast("string").alias("point_id"))
    return store.knowledge_points(b, "malware_pattern").select("point_id", "type")


@query("snk_07_upserted", "SELECT doc_id, 'new' AS state FROM labels UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit("old").alias("state"))
    return store.upserted(old, table(spark, d, "labels").select("doc_id", F.lit("new").alias("state")), "doc_id")


@query("snk_01_jsonl_rows", DOCS + "SELECT count(*) AS rows, sum(length(content))::BIGINT AS chars FROM samples WHERE label = 'malicious'")
def _(spark, d):
    """What an export holds: rows as JSON text, read again."""
    rows = samples(spark, d).filter("label = 'malicious'").select(F.to_json(F.struct("content", "label", "source")).alias("value"))
    return rows.select(F.from_json("value", "content string, label string, source string").alias("r")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("r.content")).alias("chars"))
