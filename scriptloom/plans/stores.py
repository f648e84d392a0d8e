"""Registered queries: the keyed table's writes, versions, rules and logs; tables are made in the shared folder."""

from __future__ import annotations

import datetime
import functools
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import KeyedTable
from ..operators.stepcache import StepCache
from ..operators.textindex import TextIndex
from ..operators.vectorindex import VectorIndex
from ..registry import query
from ..sources import paged, schemas
from ..sources.samples import SAMPLES_SQL, SCANS_SQL, samples, scans, table, vectors
from ..storage import shared_dir
from ..streaming import alerts, scan_log
from . import flows
from .search import _SCORED, _rank, asked

DOCS = f"WITH {SAMPLES_SQL} "


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _states(spark: SparkSession, d: str) -> KeyedTable:
    """Documents as old rows, then labelled ones as new rows, then those of low quality deleted; each a version with a name."""
    t = KeyedTable.create(spark, folder(spark, "states"), "doc_id long, source string, state string", "doc_id")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    t.insert(docs.select("doc_id", "source", F.lit("old").alias("state")))
    t.name("loaded")
    t.upsert(labels.select("doc_id", F.lit("label").alias("source"), F.lit("new").alias("state")))
    t.name("labelled")
    t.delete(labels.filter("quality = 0").select("doc_id"))
    return t


_LABELLED = "SELECT doc_id, 'label' AS source, 'new' AS state FROM labels UNION ALL SELECT doc_id, source, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


@query("snk_04_keyed_upsert", f"SELECT * FROM ({_LABELLED}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    """The table after an insert, an upsert and a delete."""
    return _states(spark, d).read()


@query("sql_11_as_of", f"SELECT 'loaded' AS version, doc_id, source, 'old' AS state FROM documents UNION ALL SELECT 'labelled', * FROM ({_LABELLED})")
def _(spark, d):
    """Both named versions, read after later writes."""
    t = _states(spark, d)
    return t.read(name="loaded").withColumn("version", F.lit("loaded")).unionByName(t.read(name="labelled").withColumn("version", F.lit("labelled")))


@query("sql_12_history", """WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM labels) AS l, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS x, (SELECT count(*) FROM labels WHERE quality = 0) AS gone)
 SELECT unnest([0, 1, 2, 3, 4, 5])::BIGINT AS version, unnest(['create', 'insert', 'name', 'upsert', 'name', 'delete']) AS operation, unnest([NULL, NULL, 'loaded', NULL, 'labelled', NULL]) AS name, unnest([0, d, d, d + x, d + x, d + x - gone])::BIGINT AS rows FROM n""")  # fmt: skip
def _(spark, d):
    """Versions with their rows, from the manifests."""
    return _states(spark, d).history().select("version", "operation", "name", "rows")


@query("snk_07_cleared", "SELECT doc_id, 'back' AS state FROM labels")
def _(spark, d):
    """Cleared, then filled again: only what came after is there."""
    t = _states(spark, d)
    t.clear()
    t.upsert(table(spark, d, "labels").select("doc_id", F.lit("back").alias("state")))
    return t.read().select("doc_id", "state")


_REASON = "CASE WHEN label NOT IN ('malicious', 'benign') THEN 'check label' WHEN id <> min(id) OVER (PARTITION BY content_hash, label IN ('malicious', 'benign')) THEN 'content_hash is taken' END"


@query("sql_01_refused", f"{DOCS}, j AS (SELECT id, {_REASON} AS reason FROM samples) SELECT id, reason FROM j WHERE reason IS NOT NULL")
def _(spark, d):
    """All samples into the table with its rules: rows that break a check or repeat a hash come back with the reason."""
    _, refused = schemas.samples_table(spark, folder(spark, "samples")).insert(samples(spark, d))
    return refused.select("id", F.array_join("reasons", ", ").alias("reason"))


@query("sql_01_accepted", f"{DOCS}, j AS (SELECT *, {_REASON} AS reason FROM samples) SELECT id, content_hash, label, source FROM j WHERE reason IS NULL")
def _(spark, d):
    t = schemas.samples_table(spark, folder(spark, "samples"))
    t.insert(samples(spark, d))
    return t.read().select("id", "content_hash", "label", "source")


def _looked_up(spark: SparkSession, d: str) -> KeyedTable:
    t = KeyedTable.create(spark, folder(spark, "samples"), "id long, content string, label string, content_hash string", "id", 64)
    t.insert(samples(spark, d).filter("label <> 'unknown'"))
    return t


@query("sql_06_keyed_lookup", f"{DOCS} SELECT id, content_hash, label FROM samples WHERE label IN ('malicious', 'benign') AND id IN (0, 7, 42, 100, 105)")
def _(spark, d):
    """Look-ups by bucket, bounds and Bloom filter."""
    return _looked_up(spark, d).lookup([0, 7, 42, 100, 105]).select("id", "content_hash", "label")


@query("sql_13_keyed_fetch", f"{DOCS} SELECT id, content_hash, label FROM samples WHERE label IN ('malicious', 'benign') AND id % 100 = 0")
def _(spark, d):
    """Every hundredth id, from its buckets' files."""
    asked = table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("id"))
    return _looked_up(spark, d).fetch(asked).select("id", "content_hash", "label")


@query("sql_15_logged_once", f"WITH {SCANS_SQL} SELECT id, script_hash, is_malicious FROM scans")
def _(spark, d):
    """The scan log as a stream into a keyed table, then the same stream again from a lost checkpoint: nothing is added twice."""
    t = KeyedTable.create(spark, folder(spark, "scans"), "id long, script_hash string, is_malicious boolean", "id", 8)
    shape = scans(spark, d).select("id", "script_hash", "is_malicious")
    arrived = folder(spark, "arrived")
    shape.repartitionByRange(3, "id").write.parquet(arrived)
    for _ in range(2):
        log = spark.readStream.schema(shape.schema).parquet(arrived)
        scan_log.append_once(log, t, folder(spark, "checkpoint")).awaitTermination()
    return t.read()


def refreshed_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = KeyedTable.create(spark, folder(spark, "statistics"), "group string, n long", "group", 4)
    s = samples(spark, d).groupBy(F.concat_ws("/", "label", "source").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    for rows in (s.filter("n > 1"), s):
        t.upsert(rows)
    return t.read()


@query("sql_09_refresh_commit", f"{DOCS} SELECT label || '/' || source AS \"group\", count(*) AS n FROM samples GROUP BY label, source")
def _(spark, d):
    """Statistics refreshed twice by the same commits as any write."""
    return refreshed_statistics(spark, d)


@query("str_05_cached_training_rows", flows._TRAINING)
def _(spark, d):
    """The training rows through a step cache, run twice: the second time every step is read."""
    cache = StepCache(spark, folder(spark, "steps"))
    flows.cached_training_rows(spark, d, cache)
    again = StepCache(spark, cache.folder)
    return flows.cached_training_rows(spark, d, again).select("id", "part", "label", F.md5("text").alias("digest"))


def _recorded(spark: SparkSession, d: str) -> str:
    """All samples as a feed of pages, each with the first keyword that it holds."""
    paged.register(spark)
    words = ("license", "token", "password", "the")
    keyword = F.coalesce(*(F.when(F.contains(F.lower("content"), F.lit(w)), w) for w in words))
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60), "yyyy-MM-dd HH:mm:ss")
    where = folder(spark, "feed")
    paged.record(samples(spark, d).select("id", keyword.alias("keyword"), "source", at.alias("published"), "content"), where, 100)
    return where


_FIRST = "CASE WHEN contains(lower(content), 'license') THEN 'license' WHEN contains(lower(content), 'token') THEN 'token' WHEN contains(lower(content), 'password') THEN 'password' WHEN contains(lower(content), 'the') THEN 'the' END"


@query("src_06_paged_feed", f"{DOCS}, k AS (SELECT id, {_FIRST} AS keyword, to_timestamp(1700000000 + id * 60) AS moment, md5(content) AS digest FROM samples) SELECT id, keyword, digest FROM k WHERE keyword = 'the' AND moment >= to_timestamp(1700012000) AND moment < to_timestamp(1700048000)")
def _(spark, d):
    """One keyword of a paged feed between two times: both conditions go to the reader."""
    low, high = (F.date_format(F.timestamp_seconds(F.lit(x)), "yyyy-MM-dd HH:mm:ss") for x in (1_700_012_000, 1_700_048_000))
    rows = spark.read.format("paged_feed").option("path", _recorded(spark, d)).load()
    return rows.filter((F.col("keyword") == "the") & (F.col("published") >= low) & (F.col("published") < high)).select("id", "keyword", F.md5("content").alias("digest"))


@query("src_28_retried_feed", f"{DOCS} SELECT source, count(*) AS n, sum(length(content))::BIGINT AS characters FROM samples GROUP BY source")
def _(spark, d):
    """A feed whose page 1 fails twice is read whole."""
    where = _recorded(spark, d)
    (Path(where.removeprefix("file://").removeprefix("file:")) / "fail-1").write_text("2")
    rows = spark.read.format("paged_feed").options(path=where, initialDelay="0.01").load()
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("characters"))


_SCAN = "SELECT user_id::VARCHAR AS script_hash, ts, event_type = 'error' AS failed, value > 5 AS predicted FROM events"


@query("str_03_recall_alerts", f"""WITH e AS ({_SCAN}), w AS (SELECT script_hash, (epoch_ms(ts) // 604800000)::BIGINT AS week, count(*) AS scans, avg(predicted::INT) AS value FROM e GROUP BY ALL)
 SELECT script_hash, week, scans, round(value, 6) AS value FROM w WHERE value < 0.9""")
def _(spark, d):
    """Weekly recall of each script from the stateful stream: all events arrive, and one later scan ends the last week."""
    alerts.use_state_store(spark)
    e = table(spark, d, "events")
    shape = e.select(F.col("user_id").cast("string").alias("script_hash"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), (F.col("value") > 5).alias("predicted"), F.lit(True).alias("truth"))
    last = shape.agg(F.max("ts")).select(F.lit("").alias("script_hash"), (F.col("max(ts)") + F.expr("INTERVAL 20 DAYS")).alias("ts"), F.lit(False).alias("failed"), F.lit(True).alias("predicted"), F.lit(True).alias("truth"))
    arrived, out, checkpoint = (folder(spark, n) for n in ("arrived", "alerts", "checkpoint"))
    for rows in (shape, last, last):
        rows.write.mode("append").parquet(arrived)
        log = spark.readStream.schema(shape.schema).parquet(arrived)
        found = alerts.script_alerts(log, forget=datetime.timedelta(days=3650))
        found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    told = spark.read.schema(alerts.OUTPUT).parquet(out).filter("kind = 'recall'")
    return told.select("script_hash", (F.unix_millis("at") / alerts.WEEK_MS - 1).cast("long").alias("week"), "scans", F.round("value", 6).alias("value"))


NEEDLES = ["license", "qzxqzx", "the ", "PASSWORD", "of"]


@query("sql_02_trigram_search", DOCS + "SELECT needle, id FROM samples, (SELECT unnest(" + repr(NEEDLES) + ") AS needle) WHERE contains(lower(content), lower(needle))")
def _(spark, d):
    """Texts that hold each needle: by the trigram index, but for the needle of two characters."""
    made = TextIndex.build(samples(spark, d).select("id", "content"), folder(spark, "trigrams"))
    hits = [made.search(n).select(F.lit(n).alias("needle"), "id") for n in NEEDLES]
    return functools.reduce(DataFrame.unionByName, hits)


@query("vec_23_index_exact", f"{_SCORED} SELECT query_id, vec_id, label, round(score, 6) AS score FROM {_rank('scored', 10)}")
def _(spark, d):
    """The collection as an index, all its cells searched."""
    made = VectorIndex.build(vectors(spark, d), folder(spark, "vectors"))
    return made.search(asked(spark, d), 10, exact=True).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


@query("vec_23_index_hits")
def _(spark, d):
    """The nearest 32 cells searched by codes, the best hits scored exactly; recall is measured in the tests."""
    made = VectorIndex.build(vectors(spark, d), folder(spark, "vectors"))
    return made.search(asked(spark, d), 10, probes=32).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))
