"""Whole flows: curation of samples to training text, and analysis of scripts in batches."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as t
from ..operators import chunking, dedup, metrics, quality, sampling
from ..operators.stepcache import StepCache
from ..registry import query
from ..sources.samples import SAMPLES_SQL, samples, samples_of, table
from .texts import _CUT, _HEAD, _TAIL, _TOKENS, _VALID, ENTROPY, strip


@dataclass
class Settings:
    """What a curation run does; fields are checked on creation."""

    min_length: int = 50
    max_length: int = 50_000
    max_comments: float = 0.8
    near_method: str = "auto"
    near_threshold: float = 0.85
    test_fraction: float = 0.1
    variants: int = 2
    balance_ratio: float = 1.0
    balance: str = "undersample"
    chunk_size: int = 128
    overlap: int = 16
    steps: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        kinds = {"int": int, "float": (int, float), "str": str}
        for f in dataclasses.fields(self):
            value, kind = getattr(self, f.name), kinds.get(f.type, dict)
            if not isinstance(value, kind) or isinstance(value, bool):
                raise TypeError(f"{f.name} is {value!r}, not of type {f.type}")
        if not 0 <= self.max_comments <= 1 or self.variants < 0 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("max_comments, variants, overlap or chunk_size is out of range")
        if self.near_method not in ("auto", "jaccard", "lsh", "exact"):
            raise ValueError(f"no such method: {self.near_method}")
        if not 0 < self.min_length <= self.max_length:
            raise ValueError("min_length must lie between 1 and max_length")
        if not 0 < self.near_threshold <= 1 or not 0 < self.test_fraction < 1 or self.balance_ratio <= 0:
            raise ValueError("near_threshold, test_fraction and balance_ratio are out of range")
        if self.balance not in ("undersample", "oversample", "hybrid", "none"):
            raise ValueError(f"no such balance: {self.balance}")

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Settings from named values; names that are no settings are an error."""
        if unknown := set(values) - {f.name for f in dataclasses.fields(cls)}:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str | None = None, section: str = "curation") -> Settings:
        """Settings from a section of a configuration file (see config.load); without the section, the defaults."""
        return cls.of(config.load(path).get(section) or {})

    def on(self, step: str) -> bool:
        """A step's own setting, else the one for all, else yes."""
        return self.steps.get(step, self.steps.get("all", True))


def curated(spark: SparkSession, sf_dir: str, s: Settings | None = None) -> DataFrame:
    """Samples that pass validation, the first of each text, with features."""
    return curated_of(samples(spark, sf_dir), s or Settings())


def curated_of(rows: DataFrame, s: Settings) -> DataFrame:
    rows = rows.withColumn("reason", quality.validation_reason(F.col("content"), F.col("label"), min_length=s.min_length, max_length=s.max_length, max_comments=s.max_comments)).filter("reason is null").drop("reason")
    rows = dedup.exact(rows)
    c = F.col("content")
    return rows.withColumn("entropy", t.entropy(c)).withColumn("network_apis", t.words_in(c, t.NETWORK)).withColumn("suspicious", t.words_in(c, t.SUSPICIOUS))


def _split(rows: DataFrame, fraction: float) -> DataFrame:
    return sampling.split(rows.select("id", "content", "label", "source"), fraction)


def _enlarged(parts: DataFrame, variants: int) -> DataFrame:
    """Training rows with variants; variants of 0 leaves the rows as they are."""
    train = parts.filter("part = 'train'").drop("part")
    if not variants:
        return train
    return sampling.augmented(train, variants).withColumn("id", F.coalesce("id", t.chunk_id(F.col("parent_id").cast("string"), F.col("copy")))).select("id", "content", "label", "source")


def _balanced(train: DataFrame, how: str, ratio: float) -> DataFrame:
    return train if how == "none" else {"undersample": sampling.undersample, "oversample": sampling.oversample, "hybrid": sampling.hybrid}[how](train, ratio)


def _prompts(train: DataFrame, parts: DataFrame) -> DataFrame:
    both = train.select("id", "content", "label", F.lit("train").alias("part")).unionByName(parts.filter("part = 'test'").select("id", "content", "label", "part"))
    return both.select("id", "part", "label", t.training_prompt(F.col("content"), F.col("label")).alias("text"))


def _curated_rows(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    return curated_of(samples_of(documents, labels), settings).select("id", "content", "label", "source")


def cached_training_rows(spark: SparkSession, sf_dir: str, cache: StepCache, s: Settings | None = None) -> DataFrame:
    """training_rows() step by step through a cache: a step runs again if its code, settings or inputs have changed, and so
    does what follows it."""
    s = s or Settings()
    inputs = [cache.source(table(spark, sf_dir, name)) for name in ("documents", "labels")]
    rules = {f: getattr(s, f) for f in ("min_length", "max_length", "max_comments")}
    kept = cache.step("curate", _curated_rows, *inputs, settings=Settings(**rules))
    parts = cache.step("split", _split, kept, fraction=s.test_fraction)
    train = cache.step("augment", _enlarged, parts, variants=s.variants if s.on("augment") else 0)
    even = cache.step("balance", _balanced, train, how=s.balance if s.on("balance") else "none", ratio=s.balance_ratio)
    return cache.step("prompt", _prompts, even, parts).rows


def training_rows(spark: SparkSession, sf_dir: str, s: Settings | None = None) -> DataFrame:
    """part (train or test) and the prompt of each curated sample: split first, then variants and balance for training alone."""
    s = s or Settings()
    parts = _split(curated(spark, sf_dir, s), s.test_fraction)
    train = _enlarged(parts, s.variants if s.on("augment") else 0)
    return _prompts(_balanced(train, s.balance if s.on("balance") else "none", s.balance_ratio), parts)


def analysed(requests: DataFrame, examples: DataFrame) -> DataFrame:
    """A batch of scripts (id, content) to prompts: refused if blank or too long; the examples of malicious patterns (a few
    rows: code, label) stand before each."""
    ok = (F.length("content") <= 100_000) & (t.strip(F.col("content")) != "")
    shown = examples.agg(F.collect_list(F.struct("code", "label")).alias("examples"))
    return requests.withColumn("accepted", ok).join(F.broadcast(shown)).select("id", "accepted", F.when(F.col("accepted"), t.few_shot_prompt(F.col("content"), F.col("examples"))).alias("prompt"))


_CURATED = f"WITH {SAMPLES_SQL}, valid AS (SELECT * FROM samples WHERE {_VALID} IS NULL), once AS (SELECT * FROM valid WHERE id IN (SELECT min(id) FROM valid WHERE content <> '' GROUP BY content_hash))"


@query("flow_curated", f"{_CURATED} SELECT label, source, count(*) AS n, round(avg({ENTROPY}), 6) AS avg_entropy FROM once GROUP BY label, source")
def _(spark, d):
    return curated(spark, d).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("entropy"), 6).alias("avg_entropy"))


_TRAINING = f"""{_CURATED}, r AS (SELECT id, content, label, row_number() OVER (ORDER BY md5('42:' || id), id) AS rank, ceil(count(*) OVER () * 0.1) AS k FROM once),
 train AS (SELECT id, content, label FROM r WHERE rank > k),
 lines AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM train WHERE label = 'malicious'),
 seeds AS (SELECT *, ('0x' || substr(md5('42:' || id || ':' || i), 1, 7))::BIGINT AS s FROM lines),
 junked AS (SELECT id, string_agg(CASE WHEN s % 10 = 0 THEN line || chr(10) || (['_ = 1 + 1', '__ = ''junk''', '___ = [1, 2, 3]', '____ = {{''a'': 1}}', '_____ = None'])[(s // 10 % 5 + 1)::INT] ELSE line END, chr(10) ORDER BY i) AS junk FROM seeds GROUP BY id),
 v AS (SELECT id, content, c, (['base64', 'hex', 'rot13', 'add_junk'])[(('0x' || substr(md5('42:' || id || ':' || c), 1, 7))::BIGINT % 4 + 1)::INT] AS technique FROM train, (SELECT unnest([1, 2]) AS c) WHERE label = 'malicious'),
 a AS (SELECT id, content, label FROM train UNION ALL
  SELECT (('0x' || substr(md5(id || '_' || c), 1, 16))::HUGEINT % 9223372036854775807)::BIGINT, CASE technique WHEN 'base64' THEN 'data = ''' || to_base64(encode(content)) || '''  # base64' WHEN 'hex' THEN 'data = ''' || lower(hex(encode(content))) || '''  # hex'
   WHEN 'rot13' THEN 'data = ''''''' || translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') || '''''''  # rot13' ELSE junk END, 'malicious' FROM v JOIN junked USING (id)),
 n AS (SELECT least(count(*) FILTER (label = 'malicious'), count(*) FILTER (label = 'benign')) AS k FROM a),
 b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS place FROM a WHERE label IN ('malicious', 'benign')),
 parts AS (SELECT id, 'train' AS part, label, content FROM b, n WHERE place <= n.k UNION ALL SELECT id, 'test', label, content FROM r WHERE rank <= k)
 SELECT id, part, label, md5({_HEAD} || 'Target Script:' || chr(10) || {_CUT} || {_TAIL} || ' ' || upper(label)) AS digest FROM parts"""


@query("flow_training_rows", _TRAINING)
def _(spark, d):
    return training_rows(spark, d).select("id", "part", "label", F.md5("text").alias("digest"))


@query("flow_split", f"{_CURATED}, r AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rank, ceil(count(*) OVER () * 0.1) AS k FROM once) SELECT id, CASE WHEN rank <= k THEN 'test' ELSE 'train' END AS part FROM r")
def _(spark, d):
    return sampling.split(curated(spark, d).select("id")).select("id", "part")


@query("flow_analysed", "SELECT conv_id * 1000 + turn AS id, length(text) <= 100000 AND regexp_replace(text, '\\s', '', 'g') <> '' AS accepted FROM conversations")
def _(spark, d):
    requests = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    examples = table(spark, d, "benchmark").orderBy("item_id").limit(3).select(F.col("text").alias("code"), F.lit("malicious").alias("label"))
    return analysed(requests, examples).select("id", "accepted")


@query("flow_source_report", f"""{_CURATED}, k AS (SELECT source, len({_TOKENS}) AS n FROM once WHERE {strip('content')} <> ''),
 c AS (SELECT source, n, unnest(range(0, greatest(0, ceil((n - 128) / 112))::BIGINT + 1)) AS i FROM k),
 chunks AS (SELECT source, count(*) AS chunks, sum(least(n, i * 112 + 128) - i * 112)::BIGINT AS tokens FROM c GROUP BY source),
 labels AS (SELECT source, count(*) FILTER (label = 'malicious') AS malicious, count(*) FILTER (label = 'benign') AS benign FROM once GROUP BY source)
 SELECT source, chunks, tokens, malicious, benign, round(coalesce(malicious / nullif(malicious + benign, 0), 0), 6) AS malicious_share FROM chunks JOIN labels USING (source)""")
def _(spark, d):
    """Chunks, tokens and balance by source of what curation keeps."""
    rows = curated(spark, d).select("id", "content", "label", "source")
    chunks = chunking.sliding(rows).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    labels = rows.groupBy("source").agg(F.count_if(F.col("label") == "malicious").alias("malicious"), F.count_if(F.col("label") == "benign").alias("benign"))
    return chunks.join(labels, "source").withColumn("malicious_share", F.round(metrics.ratio(F.col("malicious"), F.col("malicious") + F.col("benign")), 6))
