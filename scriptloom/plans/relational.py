"""Registered queries: the store's statements, reports, sampling and metrics, over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import metrics, sampling, store
from ..registry import query
from ..sources.samples import SAMPLES_SQL, SCANS_SQL, label_of, samples, scans, table
from ..storage import shared_dir

WITH = f"WITH {SAMPLES_SQL} "
LABELLED = "label IN ('malicious', 'benign')"


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).filter(F.col("label").isin("malicious", "benign"))


# The store's statements. Labelled documents stand for what is stored, all documents for a batch that comes in.

_NEW = "new AS (SELECT content_hash, min(id) AS id FROM samples WHERE content <> '' AND content_hash NOT IN (SELECT content_hash FROM samples WHERE label <> 'unknown') GROUP BY content_hash)"


@query("sql_03_insert_if_absent", f"{WITH}, {_NEW} SELECT id, content_hash FROM new")
def _(spark, d):
    s = samples(spark, d)
    return store.new_rows(s, s.filter("label <> 'unknown'")).select("id", "content_hash")


@query("sql_04_insert_batch", f"{WITH}, {_NEW} SELECT (SELECT count(*) FROM new) AS added, count(*) - (SELECT count(*) FROM new) AS duplicates, count(*) AS total FROM samples WHERE content <> ''")
def _(spark, d):
    s = samples(spark, d)
    return store.insert_report(s, s.filter("label <> 'unknown'"))


@query("sql_05_page_by_label", WITH + "SELECT id, label, source FROM samples WHERE label = 'malicious' ORDER BY id DESC LIMIT 20 OFFSET 10")
def _(spark, d):
    return store.page(samples(spark, d).filter("label = 'malicious'").select("id", "label", "source"), [F.desc("id")], 20, 10)


@query("sql_06_lookup", WITH + "SELECT id, content, label, source FROM samples WHERE id = 42")
def _(spark, d):
    return samples(spark, d).filter("id = 42").select("id", "content", "label", "source")


@query("sql_07_hashes", WITH + "SELECT DISTINCT content_hash FROM samples")
def _(spark, d):
    return samples(spark, d).select("content_hash").distinct()


@query("sql_08_statistics", WITH + "SELECT count(*) AS total_count, count(*) FILTER (label = 'malicious') AS malicious_count, count(*) FILTER (label = 'benign') AS benign_count, count(DISTINCT source) AS source_count, round(avg(length(content)), 6) AS avg_content_length FROM samples")
def _(spark, d):
    return metrics.statistics(samples(spark, d)).withColumn("avg_content_length", F.round("avg_content_length", 6))


@query("sql_09_refreshed", WITH + "SELECT label, source, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM samples GROUP BY label, source")
def _(spark, d):
    """Statistics by label and source, written twice and read as of the last refresh."""
    folder = f"{shared_dir(spark)}/statistics-{uuid.uuid4().hex}"
    s = samples(spark, d)
    for rows in (s.filter("label <> 'unknown'"), s):
        store.refresh(rows.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")), folder)
    return store.refreshed(spark, folder)


@query("sql_10_balance_and_sources", WITH + "SELECT source, count(*) AS n, coalesce(max(g.m) / nullif(max(g.b), 0), 0) AS balance_ratio FROM samples, (SELECT count(*) FILTER (label = 'malicious') AS m, count(*) FILTER (label = 'benign') AS b FROM samples) g GROUP BY source")
def _(spark, d):
    s = samples(spark, d)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(metrics.statistics(s).select(metrics.ratio(F.col("malicious_count"), F.col("benign_count")).alias("balance_ratio"))))


_VERSIONS = "SELECT 'v-' || source AS version, count(*) AS total_samples, count(*) FILTER (label = 'malicious') AS malicious_count FROM samples GROUP BY source"


def _versions(s: DataFrame) -> DataFrame:
    return s.groupBy(F.concat(F.lit("v-"), "source").alias("version")).agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(F.col("label") == "malicious").alias("malicious_count"))


@query("sql_11_snapshot", f"{WITH}, v AS ({_VERSIONS}) SELECT 'v-all' AS version, count(*) AS total_count, count(DISTINCT source) AS source_count FROM samples WHERE 'v-all' NOT IN (SELECT version FROM v)")
def _(spark, d):
    s = samples(spark, d)
    return store.snapshot(metrics.statistics(s).select("total_count", "source_count"), _versions(s), F.lit("v-all")).select("version", "total_count", "source_count")


@query("sql_12_versions", f"{WITH}{_VERSIONS} ORDER BY version DESC")
def _(spark, d):
    return _versions(samples(spark, d)).orderBy(F.desc("version"))


@query("sql_13_fetch_by_ids", WITH + "SELECT id, label, content_hash FROM samples WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    ids = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return store.fetch(samples(spark, d), ids).select("id", "label", "content_hash")


@query("sql_14_id_range", WITH + "SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM samples")
def _(spark, d):
    return samples(spark, d).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("sql_15_scan_rows", f"WITH {SCANS_SQL} SELECT id, script_hash, is_malicious, round(confidence, 6) AS confidence, round(processing_time_ms, 6) AS processing_time_ms FROM scans")
def _(spark, d):
    return scans(spark, d).select("id", "script_hash", "is_malicious", F.round("confidence", 6).alias("confidence"), F.round("processing_time_ms", 6).alias("processing_time_ms"))


@query("sql_16_admin", WITH + "SELECT label, source, count(*) AS n FROM samples GROUP BY label, source ORDER BY n DESC, label, source LIMIT 10")
def _(spark, d):
    samples(spark, d).createOrReplaceTempView("admin_samples")
    return spark.sql("SELECT label, source, count(*) AS n FROM admin_samples GROUP BY label, source ORDER BY n DESC, label, source LIMIT 10")


# Reports.


@query("agg_01_distribution", WITH + "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM samples GROUP BY label")
def _(spark, d):
    return metrics.distribution(samples(spark, d), "label").withColumn("percent", F.round("percent", 6))


@query("agg_02_lengths", WITH + "SELECT min(length(content))::DOUBLE AS min_length, max(length(content))::DOUBLE AS max_length, round(avg(length(content)), 6) AS mean_length, quantile_cont(length(content), 0.5) AS median_length FROM samples")
def _(spark, d):
    return metrics.length_figures(samples(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


_BALANCE = """b AS (SELECT count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign FROM samples),
 r AS (SELECT *, CASE WHEN benign > 0 THEN malicious / benign WHEN malicious > 0 THEN 'inf'::DOUBLE ELSE 0 END AS balance_ratio FROM b)"""
_GRADE = "CASE WHEN malicious = 0 OR benign = 0 THEN 'CRITICAL' WHEN balance_ratio BETWEEN 0.8 AND 1.25 THEN 'EXCELLENT' WHEN balance_ratio BETWEEN 0.5 AND 2 THEN 'GOOD' WHEN balance_ratio BETWEEN 0.25 AND 4 THEN 'FAIR' ELSE 'POOR' END"


@query("agg_03_balance", f"{WITH}, {_BALANCE} SELECT malicious, benign, round(balance_ratio, 6) AS balance_ratio, {_GRADE} AS grade FROM r")
def _(spark, d):
    return metrics.balance(samples(spark, d)).withColumn("balance_ratio", F.round("balance_ratio", 6))


@query("agg_04_grade_by_source", WITH.replace("WITH ", "WITH ") + f", b AS (SELECT source, count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign FROM samples GROUP BY source), r AS (SELECT *, CASE WHEN benign > 0 THEN malicious / benign WHEN malicious > 0 THEN 'inf'::DOUBLE ELSE 0 END AS balance_ratio FROM b) SELECT source, {_GRADE} AS grade FROM r")
def _(spark, d):
    n = samples(spark, d).groupBy("source").agg(F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"))
    r = F.when(F.col("benign") > 0, F.col("malicious") / F.col("benign")).when(F.col("malicious") > 0, F.lit(float("inf"))).otherwise(0.0)
    return n.withColumn("r", r).select("source", metrics.grade(F.col("r"), F.col("malicious"), F.col("benign")).alias("grade"))


@query("agg_05_report", f"{WITH}, {_BALANCE} SELECT (SELECT count(*) FROM samples) AS total, malicious, benign, {_GRADE} AS grade, (SELECT max(length(content)) FROM samples)::DOUBLE AS max_length FROM r")
def _(spark, d):
    s = samples(spark, d)
    return metrics.statistics(s).select(F.col("total_count").alias("total")).join(F.broadcast(metrics.balance(s).drop("balance_ratio"))).join(F.broadcast(metrics.length_figures(s).select("max_length")))


@query("agg_06_percentages", WITH + "SELECT source, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent, count(*) AS n FROM samples GROUP BY source")
def _(spark, d):
    return metrics.distribution(samples(spark, d), "source").withColumn("percent", F.round("percent", 6))


@query("agg_07_balance_check", f"{WITH}, {_BALANCE} SELECT malicious > 0 AND benign > 0 AND abs(balance_ratio - 1.0) <= 0.2 AS balanced FROM r")
def _(spark, d):
    return metrics.balance(samples(spark, d)).select(((F.col("malicious") > 0) & (F.col("benign") > 0) & (F.abs(F.col("balance_ratio") - 1.0) <= 0.2)).alias("balanced"))


@query("agg_08_by_source", WITH + "SELECT source, count(*) AS total, count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign, round(avg(length(content)), 6) AS avg_length FROM samples GROUP BY source")
def _(spark, d):
    n = samples(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"), F.avg(F.length("content")).alias("avg_length"))
    return n.withColumn("avg_length", F.round("avg_length", 6))


@query("agg_11_operation_rollup", "SELECT event_type AS operation, count(*) AS attempts, count(*) FILTER (value >= 1) AS successes, count(*) FILTER (NOT value >= 1) AS failures, sum(user_id % 3)::BIGINT AS retries, round(count(*) FILTER (value >= 1) * 100.0 / count(*), 6) AS success_rate, count(*) FILTER (NOT value >= 1) > 0.1 * count(*) AS alert FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("event_type", "operation")
    return metrics.operation_rates(e, "operation", F.col("value") >= 1, F.pmod("user_id", F.lit(3))).withColumn("success_rate", F.round("success_rate", 6))


@query("src_29_retry_by_user", "SELECT user_id % 10 AS operation, count(*) AS attempts, count(*) FILTER (value >= 1) AS successes, count(*) FILTER (NOT value >= 1) AS failures, sum(event_id % 2)::BIGINT AS retries, round(count(*) FILTER (value >= 1) * 100.0 / count(*), 6) AS success_rate, count(*) FILTER (NOT value >= 1) > 0.1 * count(*) AS alert FROM events GROUP BY user_id % 10")
def _(spark, d):
    e = table(spark, d, "events").withColumn("operation", F.pmod("user_id", F.lit(10)))
    return metrics.operation_rates(e, "operation", F.col("value") >= 1, F.pmod("event_id", F.lit(2))).withColumn("success_rate", F.round("success_rate", 6))


# Sampling.


def _rank(by: str = "", where: str = "TRUE") -> str:
    return f"(SELECT *, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY md5('42:' || id), id) AS rank FROM samples WHERE {where})"


@query("smp_04_undersample", f"{WITH}, n AS (SELECT count(*) FILTER (label = 'malicious') AS m, count(*) FILTER (label = 'benign') AS b FROM samples) SELECT id, label FROM {_rank('label', LABELLED)}, n WHERE rank <= CASE label WHEN 'malicious' THEN least(m, b) ELSE least(b, m) END")
def _(spark, d):
    return sampling.undersample(samples(spark, d)).select("id", "label")


@query("smp_05_oversample", f"{WITH}, n AS (SELECT count(*) FILTER (label = 'malicious') AS m, count(*) FILTER (label = 'benign') AS b FROM samples), r AS (SELECT *, CASE label WHEN 'malicious' THEN m ELSE b END AS mine, greatest(m, b) AS target FROM {_rank('label', LABELLED)}, n) SELECT id, label, unnest(range(0, ((target - rank) // mine + 1)::BIGINT))::INT AS copy FROM r")
def _(spark, d):
    return sampling.oversample(samples(spark, d)).select("id", "label", "copy")


@query("smp_06_hybrid", f"{WITH}, n AS (SELECT least(count(*) FILTER (label = 'malicious'), count(*) FILTER (label = 'benign')) AS k FROM samples), r AS (SELECT *, CASE label WHEN 'malicious' THEN greatest(k, floor(k * 1.5)::BIGINT) ELSE k END AS target FROM {_rank('label', LABELLED)}, n WHERE rank <= k) SELECT id, label, unnest(range(0, ((target - rank) // k + 1)::BIGINT))::INT AS copy FROM r")
def _(spark, d):
    return sampling.hybrid(samples(spark, d), 1.5).select("id", "label", "copy")


@query("smp_07_forced_undersample", f"{WITH}, n AS (SELECT count(*) FILTER (label = 'malicious') AS m, count(*) FILTER (label = 'benign') AS b FROM samples) SELECT id, label FROM {_rank('label', LABELLED)}, n WHERE rank <= CASE WHEN greatest(m, b) > 1.5 * least(m, b) THEN least(m, b) ELSE greatest(m, b) END")
def _(spark, d):
    return sampling.forced_undersample(samples(spark, d)).select("id", "label")


@query("smp_08_shuffle", f"{WITH} SELECT id, rank FROM {_rank()}")
def _(spark, d):
    return sampling.hash_rank(samples(spark, d)).select("id", "rank")


@query("smp_09_split", f"{WITH}, n AS (SELECT ceil(count(*) * 0.1) AS k FROM samples) SELECT id, CASE WHEN rank <= k THEN 'test' ELSE 'train' END AS part FROM {_rank()}, n")
def _(spark, d):
    return sampling.split(samples(spark, d)).select("id", "part")


_CHANCE = "('0x' || substr(md5('42:' || id || ':' || c), 1, 7))::BIGINT"


@query("smp_01_variants", f"{WITH}, v AS (SELECT id, content, source, c, (['base64', 'hex', 'rot13'])[({_CHANCE} % 3 + 1)::INT] AS technique FROM samples, (SELECT unnest([1, 2]) AS c) WHERE label = 'malicious') SELECT id AS parent_id, c::INT AS copy, technique, source || '_augmented' AS source, md5(CASE technique WHEN 'base64' THEN 'data = ''' || to_base64(encode(content)) || '''  # base64' WHEN 'hex' THEN 'data = ''' || lower(hex(encode(content))) || '''  # hex' ELSE 'data = ''''''' || translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') || '''''''  # rot13' END) AS digest FROM v")
def _(spark, d):
    return sampling.variants(samples(spark, d), 2, ["base64", "hex", "rot13"]).select("parent_id", "copy", "technique", "source", F.md5("content").alias("digest"))


@query("smp_02_augmented", f"{WITH}, a AS (SELECT label, 1 AS n FROM samples UNION ALL SELECT label, 2 FROM samples WHERE label = 'malicious') SELECT label, sum(n)::BIGINT AS n FROM a GROUP BY label")
def _(spark, d):
    return sampling.augmented(samples(spark, d), 2).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("smp_03_applied", f"{WITH} SELECT id, 'rot13' AS technique, source || '_rot13' AS source FROM samples UNION ALL SELECT id, 'hex', source || '_hex' FROM samples")
def _(spark, d):
    return sampling.applied(samples(spark, d), ["hex", "rot13"]).select("id", "technique", "source")


@query("smp_11_augmentation_statistics", f"{WITH} SELECT source, label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM samples GROUP BY source, label")
def _(spark, d):
    n = samples(spark, d).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W

    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))), 6))


for _how, _raw in (("inverse_frequency", "sum(count(*)) OVER () / count(*)"), ("sqrt_inverse", "sqrt(sum(count(*)) OVER () / count(*))")):

    @query(f"smp_12_class_weights_{_how}", f"{WITH}, w AS (SELECT label, count(*) AS n, {_raw} AS raw FROM samples WHERE {LABELLED} GROUP BY label) SELECT label, n, round(raw * count(*) OVER () / sum(raw) OVER (), 6) AS weight FROM w")
    def _(spark, d, how=_how):
        return sampling.class_weights(labelled(spark, d), how).withColumn("weight", F.round("weight", 6))


@query("smp_13_pos_weight", f"{WITH} SELECT CASE WHEN count(*) FILTER (label = 'malicious') = 0 OR count(*) FILTER (label = 'benign') = 0 THEN 1.0 ELSE round(count(*) FILTER (label = 'benign') / count(*) FILTER (label = 'malicious'), 6) END AS pos_weight FROM samples")
def _(spark, d):
    n = sampling.class_counts(samples(spark, d))
    return n.select(F.when((F.col("m") == 0) | (F.col("b") == 0), 1.0).otherwise(F.round(F.col("b") / F.col("m"), 6)).alias("pos_weight"))


@query("smp_14_validation_sample", f"{WITH} SELECT id, label FROM {_rank('label', LABELLED)} WHERE rank <= 25")
def _(spark, d):
    return sampling.hash_rank(labelled(spark, d), by="label").filter("rank <= 25").select("id", "label")


@query("smp_15_holdout", f"{WITH} SELECT id, label, CASE WHEN rank <= 10 THEN 'query' ELSE 'train' END AS part FROM {_rank('label', LABELLED)}")
def _(spark, d):
    return sampling.holdout(labelled(spark, d), 10).select("id", "label", "part")


@query("smp_16_starvation", f"{WITH} SELECT label, CASE WHEN count(*) < 500 THEN 'critical' WHEN count(*) < 1000 THEN 'low' ELSE 'ok' END AS level FROM samples GROUP BY label")
def _(spark, d):
    return samples(spark, d).groupBy("label").agg(metrics.starvation(F.count(F.lit(1))).alias("level"))


# Metrics of predictions. The "model" answers by the documents' length and source, in several spellings.

_PREDS = """preds AS (SELECT l.doc_id AS id, l.toxic AS y_true, d.source AS source,
  CASE WHEN d.n_chars % 7 = 0 THEN 'maybe' WHEN d.n_chars % 3 = 0 THEN 'MALICIOUS.' ELSE '# Analysis: The script above is classified as: BENIGN, I think' END AS answer
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
 parsed AS (SELECT *, CASE WHEN answer LIKE 'MAL%' THEN 1 WHEN answer LIKE '#%' THEN 0 ELSE -1 END AS verdict FROM preds),
 guesses AS (SELECT *, CASE WHEN verdict >= 0 THEN verdict WHEN upper(answer) LIKE 'M%' THEN 1 ELSE 0 END AS y_pred FROM parsed)"""
_MATRIX = "matrix AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn FROM guesses)"


def guesses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    n = F.col("n_chars")
    answer = F.when(n % 7 == 0, "maybe").when(n % 3 == 0, "MALICIOUS.").otherwise(f"{t.ANCHOR} BENIGN, I think")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y_true"), "source", answer.alias("answer")).withColumn("verdict", t.parsed_verdict(F.col("answer")))
    fallback = F.when(F.startswith(F.upper("answer"), F.lit("M")), 1).otherwise(0)
    return rows.withColumn("y_pred", F.when(F.col("verdict") >= 0, F.col("verdict")).otherwise(fallback))


@query("txt_10_parsed_verdicts", f"WITH {_PREDS} SELECT id, verdict, y_pred FROM guesses")
def _(spark, d):
    return guesses(spark, d).select("id", "verdict", "y_pred")


@query("evl_01_confusion", f"WITH {_PREDS}, {_MATRIX} SELECT * FROM matrix")
def _(spark, d):
    return metrics.confusion(guesses(spark, d))


@query("evl_02_rates", f"WITH {_PREDS}, {_MATRIX}, p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM matrix) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_score, round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (fn + tp), 6) AS false_negative_rate FROM p")
def _(spark, d):
    r = metrics.rates(metrics.confusion(guesses(spark, d)))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("evl_04_auc", f"WITH {_PREDS}, {_MATRIX} SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc, round(tp / (tp + fn) * tp / (tp + fp) + (1 - tp / (tp + fn)) * (tp + fn) / (tp + fp + fn + tn), 6) AS average_precision FROM matrix")
def _(spark, d):
    r = metrics.hard_auc(metrics.confusion(guesses(spark, d)))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("evl_04_score_auc", "WITH s AS (SELECT toxic AS y, d.n_chars AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id), r AS (SELECT y, avg(rk) OVER (PARTITION BY score) AS rk FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS rk FROM s)) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM r")
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("y_true"), F.col("n_chars").alias("score"))
    return metrics.score_auc(rows).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("evl_05_class_report", f"""WITH {_PREDS}, {_MATRIX}, e AS (
  SELECT 'benign' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, (tn + fp)::DOUBLE AS support FROM matrix
  UNION ALL SELECT 'malicious', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), (tp + fn)::DOUBLE FROM matrix),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM e),
 u AS (SELECT class, p, r, f, support FROM f UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f)
 SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM u""")
def _(spark, d):
    r = metrics.class_report(metrics.confusion(guesses(spark, d)))
    return r.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")), "support")


@query("evl_06_format_errors", f"WITH {_PREDS} SELECT count(*) FILTER (verdict = -1) AS format_errors, round(avg(CASE WHEN verdict = -1 THEN 1.0 ELSE 0.0 END), 6) AS format_error_rate FROM guesses")
def _(spark, d):
    g = guesses(spark, d)
    return g.agg(F.count_if(F.col("verdict") == -1).alias("format_errors"), F.round(F.avg((F.col("verdict") == -1).cast("double")), 6).alias("format_error_rate"))


@query("evl_07_first_predictions", f"WITH {_PREDS} SELECT id, y_true, y_pred, substr(answer, 1, 20) AS answer FROM guesses ORDER BY id LIMIT 10")
def _(spark, d):
    return guesses(spark, d).orderBy("id").limit(10).select("id", "y_true", "y_pred", F.substring("answer", 1, 20).alias("answer"))


@query("evl_10_confidence", "SELECT event_id AS id, round(1 / (1 + exp(user_id % 5 - value / 100)), 6) AS confidence FROM events")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(metrics.confidence(F.col("value") / 100, F.pmod("user_id", F.lit(5))), 6).alias("confidence"))


@query("evl_12_improvement", f"WITH {_PREDS}, a AS (SELECT source, avg((y_true = y_pred)::INT) AS plain, avg((y_true = CASE WHEN verdict = -1 THEN 0 ELSE verdict END)::INT) AS better FROM guesses GROUP BY source) SELECT source, CASE WHEN plain <> 0 THEN round((better - plain) / plain * 100, 6) WHEN better > 0 THEN 'inf'::DOUBLE ELSE 0 END AS improvement FROM a")
def _(spark, d):
    a = guesses(spark, d).groupBy("source").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("plain"), F.avg((F.col("y_true") == F.when(F.col("verdict") == -1, 0).otherwise(F.col("verdict"))).cast("double")).alias("better"))
    return a.select("source", F.round(metrics.improvement(F.col("plain"), F.col("better")), 6).alias("improvement"))


@query("evl_13_loss_factor", f"{WITH}, w AS (SELECT label, count(*) AS n, sum(count(*)) OVER () / count(*) AS raw FROM samples WHERE {LABELLED} GROUP BY label), x AS (SELECT label, raw * count(*) OVER () / sum(raw) OVER () AS weight FROM w) SELECT s.id // 100 AS batch, round(avg(weight), 6) AS factor FROM samples s JOIN x ON s.label = x.label GROUP BY s.id // 100")
def _(spark, d):
    s = labelled(spark, d)
    w = F.broadcast(sampling.class_weights(s).select("label", "weight"))  # a row for each of two labels
    return s.join(w, "label").groupBy(F.floor(F.col("id") / 100).alias("batch")).agg(F.round(F.avg("weight"), 6).alias("factor"))


# The scan log in batch form.


@query("str_02_first_scans", f"WITH {SCANS_SQL} SELECT script_hash, min(id) AS id, count(*) AS scans FROM scans GROUP BY script_hash")
def _(spark, d):
    return scans(spark, d).groupBy("script_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("scans"))


@query("str_03_daily_alerts", "SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS scans, round(avg((event_type = 'error')::INT), 6) AS error_rate, avg((event_type = 'error')::INT) > 0.05 AS failing, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("scans"), F.avg((F.col("event_type") == "error").cast("double")).alias("e"), F.round(F.percentile("value", 0.95), 6).alias("p95_ms"))
    return e.select("day", "scans", F.round("e", 6).alias("error_rate"), (F.col("e") > 0.05).alias("failing"), "p95_ms")


@query("flt_20_label_normaliser", "SELECT doc_id AS id, CASE toxic WHEN 1 THEN 'malicious' WHEN 0 THEN 'benign' ELSE 'unknown' END AS label FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), label_of(F.col("toxic")).alias("label"))
