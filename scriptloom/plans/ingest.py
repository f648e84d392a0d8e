"""Registered queries: labelled folders, packages, first members, fallbacks, samples from points, and knowledge search."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import code, dedup, lookup, quality, sampling
from ..operators import vectors as v
from ..registry import query
from ..sources import samples as src
from ..sources.samples import SAMPLES_SQL, SCRIPTS_SQL, VECTORS_SQL, samples, scripts, table, vectors
from ..storage import shared_dir
from .feeds import _LITERALS, _REASON
from .search import _SCORED, _rank, asked
from .texts import ALL_LINES, BLANK_LINES, CLEAN, CODE, COMMENT_LINES, _CUT, _HEAD, _TAIL, strip

DOCS = f"WITH {SAMPLES_SQL} "


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("flt_29_processed", DOCS + f"SELECT id, contains({_HEAD} || 'Target Script:' || chr(10) || {_CUT} || {_TAIL} || ' ' || CASE WHEN label IN ('benign', 'malicious') THEN upper(label) ELSE label END, 'Classification:') AS marked, contains('# Classification: ' || label || chr(10) || content, 'Classification:') AS with_header FROM samples")
def _(spark, d):
    """Whether a processed row's whole prompt holds the marker that the rule asks for: the plain prompt, and one whose text has the context header."""
    c, mark = F.col("content"), F.lit("Classification:")
    headed = t.training_prompt(t.with_context(c, "structured", label=F.col("label")), F.col("label"))
    return samples(spark, d).select("id", F.contains(t.training_prompt(c, F.col("label")), mark).alias("marked"), F.contains(headed, mark).alias("with_header"))


@query("src_19_fallback", f"""{DOCS}, lit AS (SELECT row_number() OVER () - 1 AS k, content FROM ({_LITERALS}))
 SELECT feed, label, md5(content) AS digest FROM (SELECT 'en' AS feed, label, content FROM (SELECT label, content FROM samples WHERE lang = 'en' ORDER BY id LIMIT 25)
 UNION ALL SELECT 'xx', 'malicious', content FROM lit WHERE k < 3 AND NOT EXISTS (SELECT 1 FROM samples WHERE lang = 'xx'))""")  # fmt: skip
def _(spark, d):
    """A feed's first rows, and for a feed without any the fixed rows, at most as many as asked for."""
    s, fixed = samples(spark, d), src.fallback_rows(spark)
    feeds = [src.or_fallback(s.filter(F.col("lang") == lang).select("id", "content", "label"), fixed, n).withColumn("feed", F.lit(lang)) for lang, n in (("en", 25), ("xx", 3))]
    return src.merged(*feeds).select("feed", "label", F.md5("content").alias("digest"))


@F.pandas_udf(T.BinaryType())
def _packed(files: pd.Series) -> pd.Series:
    def one(rows) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as z:
            for r in rows:
                data = r["content"].encode()
                info = tarfile.TarInfo(r["path"])
                info.size = len(data)
                z.addfile(info, io.BytesIO(data))
        return out.getvalue()

    return files.map(one)


_PACKAGES = f"""WITH {SCRIPTS_SQL}, p AS (SELECT source, count(*) AS n FROM scripts GROUP BY source), top AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS rank FROM p),
 f AS (SELECT s.source, s.id, s.path, s.content, row_number() OVER (PARTITION BY s.source ORDER BY s.id) AS k FROM scripts s JOIN top USING (source) WHERE rank <= 10),
 m AS (SELECT source, id, content, row_number() OVER (PARTITION BY source ORDER BY id) AS j FROM f WHERE k <= 60 AND path LIKE '%.py'),
 g AS (SELECT * FROM m WHERE j <= 15 AND length({strip('content')}) > 100 AND {ALL_LINES} - {COMMENT_LINES} - {BLANK_LINES} >= 5 AND coalesce({COMMENT_LINES} / nullif({ALL_LINES} - {BLANK_LINES}, 0), 0) <= 0.5)"""


@query("src_20_packages", f"{_PACKAGES} SELECT source AS package, md5(content) AS digest FROM g")
def _(spark, d):
    """The packages of most files: each one's source distribution is chosen from its links and read; its first Python
    members of some length that pass the quality filter are samples."""
    rows = scripts(spark, d)
    top = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10).select("source")
    # an archive holds at most sixty files, so a group is bounded
    files = src.per_key_limit(rows.join(top, "source", "left_semi"), "source", [F.col("id")], 60)
    built = files.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws("/", F.col("id").cast("string"), "path").alias("path"), "content"))), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))).alias("files"))
    link = lambda kind, end: F.struct(F.lit(kind).alias("packagetype"), F.concat(F.lit("https://example.org/"), "source", F.lit(end)).alias("url"))
    pages = built.select("source", _packed("files").alias("raw"), F.to_json(F.array(link("bdist_wheel", ".whl"), link("sdist", ".tar.gz"))).alias("page"))
    chosen = pages.withColumn("url", src.first_sdist(F.from_json("page", "array<struct<packagetype:string,url:string>>"))).filter(F.col("url").endswith(".tar.gz"))
    members = chosen.select("source", F.explode(code.package_files("raw", F.lit(15))).alias("content"))
    return members.filter(quality.quality_reason(F.col("content")).isNull()).select(F.col("source").alias("package"), F.md5("content").alias("digest"))


@F.pandas_udf(T.BinaryType())
def _two_members(name: pd.Series, content: pd.Series) -> pd.Series:
    def one(n: str, c: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("folder/"), b"")
            z.writestr(zipfile.ZipInfo(n), c)
            z.writestr(zipfile.ZipInfo("second.txt"), "second")
        return out.getvalue()

    return pd.Series([one(*r) for r in zip(name, content, strict=True)])


@query("src_33_first_members", CODE + "SELECT id, md5(content) AS digest FROM scripts")
def _(spark, d):
    """The first member that can be read, of archives of two."""
    raw = scripts(spark, d).select("id", _two_members("path", "content").alias("raw"))
    return raw.select("id", F.md5(code.first_member("raw")).alias("digest"))


@query("src_03_folders")
def _(spark, d):
    """Scripts written as files in two folders and read back, with their folders' labels, by the strict validator."""
    rows = scripts(spark, d).filter("label <> 'unknown'").withColumn("name", F.concat_ws("_", F.col("id").cast("string"), F.replace("path", F.lit("/"), F.lit("_"))))
    from ..operators import store

    at = {label: folder(spark, label).removeprefix("file://").removeprefix("file:") for label in ("malicious", "benign")}
    for label, where in at.items():
        store.write_files(rows.filter(F.col("label") == label).select("id", "content", F.lit("s").alias("source"), "name"), where, "x", "name").count()
    taken, reasons = src.labelled_folders(spark, at["malicious"], at["benign"])
    figures = taken.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("taken"))
    return figures.select("label", "reason", "n").unionByName(reasons)


_CONTEXT = "'# === CODE METADATA ===' || chr(10) || '# File: ' || path || chr(10) || '# Language: python' || chr(10) || '# Source: ' || source || chr(10) || '# Classification: ' || label || chr(10) || '# ====================' || chr(10) || chr(10) || "


@query("smp_10_pattern_samples", f"""WITH {SCRIPTS_SQL}, {VECTORS_SQL}, b AS (SELECT item_id, trim(text) AS description FROM benchmark),
 ids AS (SELECT DISTINCT db_id FROM vectors WHERE db_id <> 0 AND (chunk_index = 0 OR chunk_index IS NULL)),
 c AS (SELECT id, label, md5({_CONTEXT}{CLEAN}) AS digest FROM scripts WHERE id IN (SELECT db_id FROM ids) AND ({_REASON}) IS NULL)
 SELECT source, label, md5(string_agg(digest, '' ORDER BY digest)) AS digests, count(*) AS n FROM (SELECT 'qdrant' AS source, 'malicious' AS label, md5('# Vulnerability: ' || description || chr(10) || '# CVE: N/A' || chr(10) || '# Severity: HIGH' || chr(10) || '# Known malicious pattern:' || chr(10) || description || chr(10)) AS digest FROM b WHERE description <> ''
  UNION ALL SELECT 'qdrant_code_samples', label, digest FROM c) GROUP BY source, label""")
def _(spark, d):
    """Samples from both collections: knowledge rows with a description, and the documents of first chunks, fetched whole,
    sanitised and given their context."""
    known = table(spark, d, "benchmark").select(F.trim("text").alias("description")).filter("description <> ''")
    patterns = known.select(t.pattern_sample(F.col("description"), F.col("description"), F.lit(None).cast("string"), F.lit("HIGH")).alias("content"), F.lit("malicious").alias("label"), F.lit("qdrant").alias("source"))
    both = src.merged(patterns, sampling.from_points(vectors(spark, d), scripts(spark, d)))
    # digests are sorted within a source and label for the comparison alone
    return both.groupBy("source", "label").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("content"))), "")).alias("digests"), F.count(F.lit(1)).alias("n"))


_KNOWN = f"{_SCORED}, k AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH'][(vec_id % 3 + 1)::INT] AS severity, 'CVE-' || (vec_id % 50) AS cve_id FROM scored)"


def _knowledge(spark, d):
    rows = vectors(spark, d)
    severity = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return rows.withColumn("severity", severity).withColumn("cve_id", F.concat(F.lit("CVE-"), (F.col("vec_id") % 50).cast("string")))


for _name, _where, _limit, _least in (("severity", {"severity": "HIGH"}, 5, 0.3), ("cve", {"cve_id": "CVE-0"}, 10, 0.3), ("both", {"severity": "HIGH", "label": "malicious"}, 5, 0.1)):

    @query(f"vec_07_by_{_name}", f"{_KNOWN} SELECT query_id, vec_id, severity, cve_id, round(score, 6) AS score FROM {_rank('(SELECT * FROM k WHERE score >= ' + str(_least) + ' AND ' + ' AND '.join(f'{c} = ' + repr(x) for c, x in _where.items()) + ')', _limit)}")
    def _(spark, d, where=_where, limit=_limit, least=_least):
        """Search under equality filters, all of which must hold, with a least score."""
        hits = v.filtered_search(asked(spark, d), _knowledge(spark, d), where, limit, least)
        return hits.select("query_id", "vec_id", "severity", "cve_id", F.round("score", 6).alias("score"))


@query("vec_19_id_split", f"WITH {VECTORS_SQL}, s AS (SELECT *, CASE WHEN chunk_index = 2 THEN NULL ELSE db_id END AS own FROM vectors) SELECT label, count(*) AS n, count(*) FILTER (own IS NULL) AS synthetic, count(DISTINCT own) AS documents, round(count(own) * 100.0 / count(*), 6) AS with_id, (SELECT md5(string_agg(k, ',' ORDER BY k)) FROM (SELECT CASE WHEN own IS NULL THEN 'p' || (('0x' || substr(md5(vec_id || '_' || chunk_index), 1, 16))::HUGEINT % 9223372036854775807)::BIGINT ELSE 'd' || own || '_' || chunk_index END AS k FROM s z WHERE z.label = s.label)) AS points FROM s GROUP BY label")
def _(spark, d):
    """Rows split by whether they have a document's id: those that have are named by it and the chunk, the others by a point id."""
    s = vectors(spark, d).withColumn("own", F.when(F.col("chunk_index") != 2, F.col("db_id")))
    point = F.concat(F.lit("p"), t.chunk_id(F.col("vec_id").cast("string"), F.col("chunk_index")).cast("string"))
    k = F.when(F.col("own").isNull(), point).otherwise(F.concat(F.lit("d"), F.col("own").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")))
    return s.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("own").isNull()).alias("synthetic"), F.count_distinct("own").alias("documents"),
        F.round(F.count("own") * 100.0 / F.count(F.lit(1)), 6).alias("with_id"), F.md5(F.array_join(F.array_sort(F.collect_list(k)), ",")).alias("points"),
    )


_STORED = "label <> 'unknown'"


def _laid_out(spark, d):
    return lookup.lay_out(samples(spark, d).filter(_STORED), f"samples_{uuid.uuid4().hex}", shared_dir(spark))


@query("sql_03_bucketed_insert", f"{DOCS} SELECT min(id) AS id, content_hash FROM samples WHERE content <> '' AND content_hash NOT IN (SELECT content_hash FROM samples WHERE {_STORED}) GROUP BY content_hash")
def _(spark, d):
    """What an insert adds, against a store that isn't shuffled."""
    return lookup.missing(dedup.exact(samples(spark, d)), _laid_out(spark, d)).select("id", "content_hash")


@query("sql_13_bucketed_fetch", f"{DOCS} SELECT id, label, content_hash FROM samples WHERE {_STORED} AND content_hash IN (SELECT content_hash FROM samples WHERE id % 10 = 0)")
def _(spark, d):
    asked_for = samples(spark, d).filter("id % 10 = 0").select("content_hash")
    return lookup.found(_laid_out(spark, d), asked_for).select("id", "label", "content_hash")
