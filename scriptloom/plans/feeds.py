"""Registered queries: feeds that need a parser or archive reader, generated samples, trigram search, and whole upserts."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import chunking, code, quality, sampling, store, textindex
from ..operators import vectors as v
from ..registry import query
from ..sources import samples as src
from ..sources.samples import SAMPLES_SQL, SCRIPTS_SQL, samples, scripts, table
from .search import _BOOSTED, _HITS, _hits
from .texts import BASE64_SHARE, CLEAN, CODE, CONTROL, DOCS, ENTROPY, share_sql, strip

_SEED = "('0x' || substr(md5('42:' || {}), 1, 7))::BIGINT"


@query("flt_02_labels", DOCS + "SELECT id, lower(label) IN ('malicious', 'benign') AS valid FROM samples")
def _(spark, d):
    return samples(spark, d).select("id", F.lower("label").isin("malicious", "benign").alias("valid"))


@query("flt_17_content_checks")
def _(spark, d):
    c = F.col("content")
    return scripts(spark, d).select("id", F.is_valid_utf8(c).alias("encoding"), code.parses(c).alias("syntax"), (t.code_density(c) >= 0.1).alias("density"))


@query("flt_28_separate_checks", CODE + "SELECT id, path LIKE '%.py' AS extension, length(content) > 0 AND strlen(content) <= 10485760 AS size FROM scripts")
def _(spark, d):
    size = F.octet_length("content")
    return scripts(spark, d).select("id", F.col("path").endswith(".py").alias("extension"), ((size > 0) & (size <= 10 << 20)).alias("size"))


@query("src_15_code_feed")
def _(spark, d):
    c = F.col("content")
    return scripts(spark, d).filter((F.length(c) > 100) & (t.code_density(c) >= 0.1)).filter(code.parses(c)).select("id", "source", F.length(c).alias("size"))


@query("src_20_first_sdist", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/' || doc_id || '.tar.gz' END AS url FROM documents")
def _(spark, d):
    link = lambda kind, end: F.struct(kind.alias("packagetype"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"), F.lit(end)).alias("url"))
    second = F.when(F.col("doc_id") % 2 == 0, "sdist").otherwise("bdist_egg")
    urls = F.to_json(F.array(link(F.lit("bdist_wheel"), ".whl"), link(second, ".tar.gz")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), src.first_sdist(F.from_json(urls, "array<struct<packagetype:string,url:string>>")).alias("url"))


@query("src_25_synthetic", f"SELECT DISTINCT (['def area(x):\n    return x * ', 'for i in range(', 'values = [i for i in range('])[(c % 3 + 1)::INT] || (c // 3 % 50) || chr(10) AS content, 'benign' AS label, 'synthetic' AS source FROM (SELECT {_SEED.format('doc_id')} AS c FROM documents)")
def _(spark, d):
    return src.synthetic(table(spark, d, "documents"), "doc_id")


@F.pandas_udf(T.BinaryType())
def _zipped(name: pd.Series, content: pd.Series) -> pd.Series:
    def one(n: str, c: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo(n), c)
        return out.getvalue()

    return pd.Series([one(n, c) for n, c in zip(name, content, strict=True)])


@query("src_26_archives", CODE + "SELECT id, md5(content) AS digest FROM scripts WHERE length(content) > 50 AND NOT path LIKE '%.bin'")
def _(spark, d):
    """Scripts in archives of their own, read back: members with a script's suffix and more than 50 characters."""
    raw = scripts(spark, d).select("id", _zipped("path", "content").alias("raw"))
    return raw.filter(quality.archive_bytes(F.col("raw"))).select("id", F.explode(code.archive_members("raw")).alias("m")).select("id", F.md5("m.content").alias("digest"))


@query("src_34_downloads", CODE + "SELECT id, path LIKE '%.py' AS packed, md5(content) AS digest FROM scripts WHERE length(content) > 50 AND NOT path LIKE '%.sh'")
def _(spark, d):
    """Python scripts come packed, shell scripts under an archive's name, and the others as they are."""
    rows, path = scripts(spark, d), F.col("path")
    packed = rows.filter(path.endswith(".py")).select("id", F.concat("path", F.lit(".zip")).alias("name"), _zipped("path", "content").alias("raw"))
    plain = rows.filter(~path.endswith(".py")).select("id", F.when(path.endswith(".sh"), F.concat("path", F.lit(".gz"))).otherwise(path).alias("name"), F.encode("content", "UTF-8").alias("raw"))
    both = packed.union(plain).select("id", F.endswith("name", F.lit(".zip")).alias("packed"), F.explode(code.downloads("name", "raw")).alias("m"))
    return both.select("id", "packed", F.md5("m.content").alias("digest"))


_LITERALS = " UNION ALL ".join("SELECT " + "'" + c.replace("'", "''") + "' AS content" for c, _, _ in src.EXPLOIT_SAMPLES)


@query("src_24_exploit_samples", f"""{DOCS}, merged AS (SELECT content, label, source FROM samples UNION ALL SELECT content, 'malicious', 'cve_patterns' FROM ({_LITERALS}))
 SELECT label, source, count(*) AS n, sum(length(content))::BIGINT AS characters, min(sha256(content)) AS first_hash FROM merged GROUP BY label, source""")
def _(spark, d):
    """The fixed scripts among the samples, by label and source."""
    both = src.merged(samples(spark, d).select("content", "label", "source", "content_hash"), src.exploit_samples(spark))
    return both.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("characters"), F.min("content_hash").alias("first_hash"))


@query("src_32_extra_feeds", f"{DOCS} SELECT feed, count(*) AS n FROM (SELECT 'a' AS feed FROM samples WHERE lang = 'en' UNION ALL SELECT 'b' FROM samples WHERE lang = 'de' UNION ALL SELECT 'c' FROM samples WHERE lang = 'es') GROUP BY feed")
def _(spark, d):
    s = samples(spark, d)
    return src.merged(*(s.filter(F.col("lang") == x).select("id", F.lit(f).alias("feed")) for f, x in (("a", "en"), ("b", "de"), ("c", "es")))).groupBy("feed").agg(F.count(F.lit(1)).alias("n"))


@query("str_04_first_rows", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def _(spark, d):
    return table(spark, d, "events").orderBy("event_id").limit(100).select("event_id")


@query("sql_02_trigram_counts", DOCS + "SELECT id, len(list_distinct(list_transform(range(1, length(content) - 1), lambda i: substr(lower(content), i, 3))))::INT AS trigrams FROM samples")
def _(spark, d):
    return samples(spark, d).select("id", textindex.trigram_count(F.lower("content"), F.length("content")).alias("trigrams"))


@query("snk_02_file_names", CODE + "SELECT source || '_' || id || '_' || replace(path, '/', '_') AS name, length(content)::INT AS size FROM scripts")
def _(spark, d):
    return scripts(spark, d).select(store.file_name(F.col("source"), F.col("id").cast("string"), F.col("path")).alias("name"), F.length("content").alias("size"))


@query("txt_09_balanced_examples", f"{DOCS}, r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS n FROM samples WHERE label <> 'unknown') SELECT row_number() OVER (ORDER BY n, CASE label WHEN 'malicious' THEN 0 ELSE 1 END)::INT AS place, id, label FROM r WHERE n <= 5")
def _(spark, d):
    from pyspark.sql import Window as W

    known = samples(spark, d).filter("label <> 'unknown'").select("id", "label")
    top = src.per_key_limit(known, "label", [F.col("id")], 5).withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("id")))
    turn = F.when(F.col("label") == "malicious", 0).otherwise(1)
    return top.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("n", turn))).select("place", "id", "label")


_REASON = f"CASE WHEN {strip('content')} = '' THEN 'empty' WHEN {share_sql(CONTROL)} > 0.1 OR {BASE64_SHARE} > 0.4 THEN 'binary' WHEN {ENTROPY} < 1.5 THEN 'entropy' WHEN length({CLEAN}) < 10 THEN 'short' END"
_T = r"list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')"


@query("vec_18_upsert", f"""WITH {SCRIPTS_SQL}, c AS (SELECT id, label, {CLEAN} AS content FROM scripts WHERE ({_REASON}) IS NULL),
 k AS (SELECT id, label, content, {_T} AS t FROM c), w AS (SELECT *, len(t) AS n, greatest(0, ceil((len(t) - 128) / 112))::BIGINT AS last FROM k),
 x AS (SELECT id, label, content, t, n, unnest(range(0, last + 1)) AS i FROM w),
 y AS (SELECT id, label, i::INT AS chunk_index, CASE WHEN n <= 128 THEN content ELSE array_to_string(t[i * 112 + 1:i * 112 + 128], ' ') END AS text FROM x)
 SELECT id, label, chunk_index, md5(substr(text, 1, 200)) AS preview, (('0x' || substr(md5(text || '_' || chunk_index), 1, 16))::HUGEINT % 9223372036854775807)::BIGINT AS point_id FROM y""")
def _(spark, d):
    """Scripts to points: sanitised, cut into windows, with ids and a preview of 200 characters."""
    clean = quality.sanitized(scripts(spark, d)).filter("reason is null").select("id", "label", F.col("clean").alias("content"))
    return chunking.sliding(clean).select("id", "label", "chunk_index", F.md5(F.substring("content", 1, 200)).alias("preview"), F.col("chunk_id").alias("point_id"))


_BOOST = f"CASE WHEN {_BOOSTED} THEN 1.2 ELSE 1 END"


@query("vec_21_reranked", f"{_HITS} SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score * {_BOOST} DESC, vec_id) AS rank FROM hits) WHERE rank <= 5")
def _(spark, d):
    return v.reranked(_hits(spark, d), 5).select("query_id", "vec_id", "rank")


@query("src_23_pattern_severity", f"WITH {SCRIPTS_SQL} SELECT id, count(*) AS patterns, count(*) FILTER (severity = 'HIGH') AS high FROM scripts, (VALUES " + ", ".join(f"('{p}', '{s}')" for p, _, s, _ in src.EXPLOIT_PATTERNS) + ") k(pattern, severity) WHERE contains(content, pattern) GROUP BY id")
def _(spark, d):
    """How many exploit patterns a script has, and how many of high severity: the patterns are a small table, broadcast."""
    k = F.broadcast(src.exploit_patterns(spark).select("pattern", "severity"))
    hits = scripts(spark, d).select("id", "content").join(k, F.contains("content", F.col("pattern")))
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("severity") == "HIGH").alias("high"))


@query("smp_01_parsed_variants")
def _(spark, d):
    """Variants whose technique needs a parser, over scripts."""
    rows = scripts(spark, d).withColumn("technique", F.element_at(F.array(F.lit("rename_vars"), F.lit("split_strings")), (t.seeded(F.col("id").cast("string")) % 2 + 1).cast("int")))
    other = F.when(F.col("technique") == "rename_vars", code.variables_renamed("content", "id")).otherwise(code.strings_split("content"))
    return rows.select("id", "technique", F.md5(sampling.encoded(F.col("content"), F.col("technique"), F.col("id"), other=other)).alias("digest"))
