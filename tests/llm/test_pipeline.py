"""The pipeline's stages, each judged on its own input."""

import collections

import corpus_pipeline
import pytest
from scriptloom.llm import langid
from scriptloom.llm.common import stored

from .test_operators import brute_components

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR))
        out.append(docs)
    return out


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_languages_keep_clean_documents(spark, stages):
    assert ids(stages[1]) == ids(stages[0])
    odd = stages[0].unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123", "en", "x", 3)], stages[0].schema))
    assert ids(corpus_pipeline.language_id(spark, odd, DIR)) == ids(stages[0])


def test_exact(stages):
    last = {}
    for r in stages[1].orderBy("doc_id").collect():
        last[r.text] = r.doc_id
    assert ids(stages[2]) == set(last.values())


def test_near(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == {c for _, _, c in brute_components(rows, 5, 80)}


def test_one_of_each_group_stays(spark):
    """Null and repeated keys: exactly one row of each group, and no row of another."""
    rows = [(1, "x"), (1, "y"), (2, "x"), (None, "z"), (None, "z"), (3, "w"), (3, "w"), (4, None), (4, ""), (None, "v"), (5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.exact(spark, docs, DIR).collect()]
    assert sorted(got, key=repr) == sorted([(1, "y"), (2, "x"), (None, "z"), (3, "w"), (4, ""), (5, "v")], key=repr)
    w = [f"word{i}" for i in range(400)]
    t = lambda a, b: " ".join(w[a:b])
    rows = [(7, t(0, 50)), (7, t(100, 150)), (8, t(0, 52)), (6, t(100, 152)), (None, t(200, 250)), (None, t(200, 252)), (9, t(300, 350)), (9, t(300, 350)), (10, ""), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text[:7]) for r in corpus_pipeline.near(spark, docs, DIR).collect()), key=repr)
    assert got == sorted([(7, "word0 w"), (6, "word100"), (None, "word200"), (9, "word300"), (10, ""), (10, "")], key=repr)


def test_mixing_keeps_all(stages):
    assert collections.Counter(map(tuple, stages[3].collect())) == collections.Counter(map(tuple, stages[4].collect()))


def test_packing_follows_the_mixture(spark, stages):
    from pyspark.sql import functions as F

    from scriptloom.llm import mixing

    want = [r.doc_id for r in mixing.mix(stages[3]).orderBy("position").collect()]
    got = [r.doc_id for r in stages[5].filter("start = 0").orderBy("sequence_id", "offset").collect()]
    assert got == want
    assert stages[5].agg(F.sum("length")).first()[0] == stages[5].select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_without_files(spark, stages):
    assert corpus_pipeline.pack(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), DIR).count() == 1


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_learning_leaves_the_fold_out(spark):
    """What is learnt is the same whatever the held-out documents say."""
    import zlib

    rows = [(k, f"text number {k} of these", "en") for k in range(60)]
    changed = [(k, "zzz qqq xxx" if zlib.crc32(str(k).encode()) % 3 == 1 else t, lang) for k, t, lang in rows]
    learnt = [sorted(langid.learn(spark.createDataFrame(x, "doc_id long, text string, lang string").filter(~langid.held_out()))) for x in (rows, changed)]
    assert learnt[0] == learnt[1] and rows != changed


def test_clashing_names_and_empty_tables(spark, stages):
    """Extra columns named as the stages' own are carried through; no rows give no rows."""
    from pyspark.sql import functions as F

    names = ["score", "lang_pred", "n_langs", "_doc", "_row", "_first", "row", "go", "n", "class", "root", "kept"]
    odd = stages[0].withColumns({x: F.lit(1) for x in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, DIR)
            assert out.columns == odd.columns and bool(out.count()) == bool(docs.count())


def test_map_columns_go_through_every_stage(spark):
    """Columns without an order, with kinds that repeat."""
    w = [f"word{i}" for i in range(400)]
    rows = [(1, " ".join(w[:60]), "en", "a", 1, {"k": 1}), (1, " ".join(w[:60]), "en", "a", 1, {"k": 0}), (2, " ".join(w[:61]), "en", "b", 2, None), (3, " ".join(w[100:160]), "de", "a", 3, {}), (None, " ".join(w[200:260]), None, None, None, {"x": 2})] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>").repartition(3)
    exact = corpus_pipeline.exact(spark, docs, DIR)
    assert sorted(((r.doc_id, r.m) for r in exact.collect()), key=repr) == sorted([(1, {"k": 0}), (2, None), (3, {}), (None, {"x": 2})], key=repr)
    near = corpus_pipeline.near(spark, docs, DIR)
    assert sorted(((r.doc_id, r.m) for r in near.collect()), key=repr) == sorted([(1, {"k": 0}), (3, {}), (None, {"x": 2})], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR))
        assert docs.count() > 0
