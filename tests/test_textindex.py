"""Substring search by the trigram index: equal to contains on all rows, and what it reads."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.operators import textindex
from scriptloom.operators.textindex import TextIndex, packed, trigrams, unpacked

SF = "/root/testdata/sf0.01"


def bytes_read(spark, run):
    """Bytes that scans have read while `run` ran, and its result."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    out = run()
    return total() - before, out


@given(st.lists(st.integers(0, 1 << 40), unique=True, max_size=50))
def test_numbers_in_seven_bits(numbers):
    x = np.sort(np.array(numbers, np.int64))
    assert unpacked(packed(x)).tolist() == x.tolist()
    if len(x) and x.max() < 128:
        assert len(packed(x)) == len(x)


def test_trigrams():
    assert len(trigrams("ab")) == 0 and len(trigrams("aaaa")) == 1 and len(trigrams("abcd😀")) == 3


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang")
    odd = spark.createDataFrame([(10**6, None, "x"), (10**6 + 1, "", "x"), (10**6 + 2, "ab", "x"), (10**6 + 3, "İstanbul ÀÉ 😀😀😀 license", "x"), (10**6 + 3, "the same key, another text with LICENSE", "x")], docs.schema)
    rows = docs.union(odd).cache()
    old, textindex.BLOCK = textindex.BLOCK, 100_000
    made = TextIndex.build(rows.repartition(24), str(tmp_path_factory.mktemp("index") / "i"))
    textindex.BLOCK = old
    return rows, made


def needles(rows):
    r = random.Random(3)
    texts = [x[0] for x in rows.filter("content is not null").orderBy("id").select("content").collect()]
    some = [t[a : a + n] for t, n in zip(r.sample(texts, 3), (3, 9, 30), strict=True) for a in [r.randrange(max(1, len(t) - n))]]
    return [*some, "LICENSE", "zzzzqqqq", "😀😀😀", "i̇st", "ab", "", "%_\\"]


def test_like_contains(spark, index):
    rows, made = index
    for needle in needles(rows):
        want = rows.filter(F.contains(F.lower("content"), F.lower(F.lit(needle))))
        found = made.search(needle)
        assert found.columns == rows.columns
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), needle


def test_what_is_read(spark, index):
    rows, made = index
    whole, _ = bytes_read(spark, lambda: made.texts().filter(F.contains("content", F.lit("zzzz"))).collect())
    absent, found = bytes_read(spark, lambda: made.search("qzxqzx").collect())
    assert found == [] and absent < whole / 3  # postings of its trigrams alone (mostly footers here), and no text
    assert not [f for f in made.search("qzxqzx").inputFiles() if "/texts/" in f]
    rare = rows.filter("id = 500").first().content[:40]
    assert made.search(rare).count() > 0
    blocks = made.candidates(rare).select("_block").distinct().count()
    assert 0 < blocks < made.texts().select("_block").distinct().count() / 2
    plan = made.search(rare)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan and "PushedFilters: [" in plan  # folders and row groups without candidates aren't read


def test_frequent_trigrams_have_a_row_for_each_block(index):
    _, made = index
    most = made.postings().groupBy("gram").agg(F.count_distinct("block").alias("blocks"), F.max("n").alias("n"), F.sum("n").alias("total")).orderBy(F.desc("total")).first()
    assert most.blocks > 10 and most.n < most.total / 5


def test_no_rows(spark, tmp_path):
    made = TextIndex.build(spark.createDataFrame([], "id long, content string"), str(tmp_path / "i"))
    assert made.search("license").count() == 0 and made.search("").count() == 0


@given(st.lists(st.text(max_size=30), max_size=6), st.booleans())
def test_trigrams_of_many_texts(texts, wide):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + (["".join(map(chr, range(0x10000, 0x10000 + 140_000)))] * 2 if wide else [])  # too many characters for one number
    grams, row = textindex.trigram_rows(texts)
    want = [(g, k) for k, t in enumerate(texts) for g in trigrams(t).tolist()]
    assert list(zip(grams.tolist(), row.tolist(), strict=True)) == sorted(want) if not wide else len(grams) == len(want)


@given(st.lists(st.lists(st.integers(0, 1 << 40), unique=True, min_size=1, max_size=9), max_size=9))
def test_many_lists_in_seven_bits(lists):
    size = [len(x) for x in lists]
    data, ends = textindex.packed_lists(np.array([n for x in lists for n in sorted(x)], np.int64), np.cumsum([0, *size[:-1]])[: len(size)].astype(np.int64))
    assert [unpacked(data[a:b].tobytes()).tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [sorted(x) for x in lists]


def test_few_small_files_of_postings(index):
    """However many tasks and blocks there are, a folder gets few files, and their Bloom filters are small."""
    _, made = index
    files = [Path(f) for f in Path(made.folder, "postings").glob("bucket=*/*.parquet")]
    per = [sum(f.parent == d for f in files) for d in {f.parent for f in files}]
    assert max(per) <= 1 + textindex.SPREAD and max(f.stat().st_size for f in files) < 200_000
