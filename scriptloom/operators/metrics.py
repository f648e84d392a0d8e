"""Reports on samples and metrics of predictions, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts and percentages; null counts as unknown."""
    n = rows.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(0))))


def length_figures(rows: DataFrame, content: str = "content") -> DataFrame:
    """Least, largest, mean and exact median length; zeros without rows."""
    n = F.length(content)
    return rows.agg(*(F.coalesce(x, F.lit(0.0)).alias(name) for name, x in (("min_length", F.min(n).cast("double")), ("max_length", F.max(n).cast("double")), ("mean_length", F.avg(n)), ("median_length", F.percentile(n, 0.5)))))


def balance(rows: DataFrame) -> DataFrame:
    """malicious, benign, balance_ratio (infinite without benign rows, if there are malicious ones) and its grade."""
    n = rows.agg(F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"))
    r = F.when(F.col("benign") > 0, F.col("malicious") / F.col("benign")).when(F.col("malicious") > 0, F.lit(float("inf"))).otherwise(0.0)
    return n.withColumn("balance_ratio", r).withColumn("grade", grade(F.col("balance_ratio"), F.col("malicious"), F.col("benign")))


def grade(r: Column, malicious: Column, benign: Column) -> Column:
    return F.when((malicious == 0) | (benign == 0), "CRITICAL").when(r.between(0.8, 1.25), "EXCELLENT").when(r.between(0.5, 2.0), "GOOD").when(r.between(0.25, 4.0), "FAIR").otherwise("POOR")


def statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("label") == "malicious").alias("malicious_count"), F.count_if(F.col("label") == "benign").alias("benign_count"),
        F.count_distinct("source").alias("source_count"), F.avg(F.length("content")).alias("avg_content_length"),
    )


def confusion(rows: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    hit = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(guess) == p))
    return rows.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))


def rates(matrix: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return matrix.select(ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1_score"), ratio(tn, tn + fp).alias("specificity"), ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fn, fn + tp).alias("false_negative_rate"))


def hard_auc(matrix: DataFrame) -> DataFrame:
    """ROC AUC and average precision of hard labels; null unless truth and predictions have both classes."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ok = (tp + fn > 0) & (fp + tn > 0) & (tp + fp > 0) & (fn + tn > 0)
    r, p, prior = tp / (tp + fn), tp / (tp + fp), (tp + fn) / (tp + fp + fn + tn)
    return matrix.select(F.when(ok, (r + tn / (tn + fp)) / 2).alias("roc_auc"), F.when(ok, r * p + (1 - r) * prior).alias("average_precision"))


def score_auc(rows: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """ROC AUC by rank sums: positives' and negatives' counts for each distinct score, in a running sum over distinct scores."""
    n = rows.groupBy(score).agg(F.count_if(F.col(truth) == 1).cast("double").alias("p"), F.count_if(F.col(truth) == 0).cast("double").alias("q"))
    below = F.sum("q").over(W.orderBy(score)) - F.col("q")
    s = n.select("p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("s"))
    return s.agg(F.try_divide(F.sum("s"), F.sum("p") * F.sum("q")).alias("roc_auc"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of benign, malicious, and their macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    row = lambda name, a, b, c: F.struct(F.lit(name).alias("class"), ratio(a, a + b).alias("precision"), ratio(a, a + c).alias("recall"), (a + c).cast("double").alias("support"))
    each = matrix.select(F.inline(F.array(row("benign", tn, fn, fp), row("malicious", tp, fp, fn))))
    each = each.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1_score")
    macro = each.agg(F.lit("macro avg").alias("class"), *(F.avg(c).alias(c) for c in names), F.sum("support").alias("support"))
    weighted = each.agg(F.lit("weighted avg").alias("class"), *(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted)


def threshold_sweep(pairs: DataFrame, steps: int = 50, top: float = 0.9) -> DataFrame:
    """Precision, recall and F1 of score >= threshold for evenly spaced thresholds; pairs (score, relevant) are counted once
    by the last threshold they pass, and sums run over the thresholds."""
    last = F.least(F.lit(steps - 1), F.floor(F.col("score") / F.lit(top / (steps - 1)) + 1e-9)).cast("int")
    n = pairs.withColumn("step", last).filter("step >= 0").groupBy("step").agg(F.count_if("relevant").alias("tp"), F.count_if(~F.col("relevant")).alias("fp"))
    all_ = pairs.agg(F.count_if("relevant").alias("positives"))
    line = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"), (F.col("id") * F.lit(top / (steps - 1))).alias("threshold"))
    w = W.orderBy(F.desc("step"))
    run = line.join(n, "step", "left").select("step", "threshold", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("tp", "fp")))
    out = run.join(F.broadcast(all_)).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("positives")))
    return out.withColumn("f1_score", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("step", "threshold", "tp", "fp", "precision", "recall", "f1_score")


def best_thresholds(sweep: DataFrame, precise: float = 0.8, thorough: float = 0.8) -> DataFrame:
    """The thresholds of the largest F1: of all, of those precise enough, of those with recall enough (the lowest of equals)."""
    pick = lambda ok: F.max_by(F.when(ok, F.col("threshold")), F.when(ok, F.struct("f1_score", -F.col("step"))))
    return sweep.agg(pick(F.lit(True)).alias("default_threshold"), pick(F.col("precision") >= precise).alias("strict_threshold"), pick(F.col("recall") >= thorough).alias("lenient_threshold"))


def ranked_quality(hits: DataFrame, k: int) -> DataFrame:
    """Per query: mrr, hit (any relevant) and precision among its first k (of those returned); hits: query_id, rank, relevant."""
    return hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("mrr"), F.max(F.col("relevant").cast("double")).alias("hit"), F.avg(F.col("relevant").cast("double")).alias("precision"))


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*(f(c).cast("double").alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def confidence(a: Column, b: Column) -> Column:
    """Softmax of two logits, of the first; steady for large ones."""
    return 1 / (1 + F.exp(b - a))


def improvement(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) / before * 100).when(after > 0, F.lit(float("inf"))).otherwise(0.0)


def starvation(n: Column) -> Column:
    return F.when(n < 500, "critical").when(n < 1000, "low").otherwise("ok")


def operation_rates(rows: DataFrame, operation: str, ok: Column, retries: Column) -> DataFrame:
    """Attempts, successes, failures and retries by operation, success in percent, and an alert over 10 % failures."""
    n = rows.groupBy(operation).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum(retries).alias("retries"))
    return n.withColumn("success_rate", F.col("successes") * 100.0 / F.col("attempts")).withColumn("alert", F.col("failures") > 0.1 * F.col("attempts"))
