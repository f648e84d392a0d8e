"""Vector search: exact against SQL's sums, and the recall of the index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.operators import vectorindex
from scriptloom.operators import vectors as v
from scriptloom.operators.vectorindex import VectorIndex, best
from scriptloom.sources.samples import vectors

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return vectors(spark, SF).cache()


@pytest.fixture(scope="module")
def queries(rows):
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, str(tmp_path_factory.mktemp("vectors") / "i"))


def hits(df):
    return sorted((r.query_id, r.vec_id, r.score) for r in df.select("query_id", "vec_id", "score").collect())


def test_exact_is_bit_equal(spark, rows, queries, index, monkeypatch):
    want = hits(v.top_k(v.scored(queries, rows), 10))
    assert hits(best(queries, rows, 10)) == want
    assert [(q, x) for q, x, _ in hits(index.search(queries, 10, exact=True))] == [(q, x) for q, x, _ in want]
    monkeypatch.setattr(vectorindex, "QUERY_BYTES", 2000)  # several passes
    monkeypatch.setattr(vectorindex, "SCORES", 500)
    assert hits(best(queries, rows, 10)) == want
    per = v.top_k(v.scored(queries, rows), 3, per=["query_id", "label"], least=0.1)
    assert hits(best(queries, rows, 3, per="label", least=0.1)) == hits(per)


def test_recall(spark, rows, queries, index):
    want = {}
    for q, x, _ in hits(best(queries, rows, 10)):
        want.setdefault(q, set()).add(x)
    got = {}
    for q, x, s in hits(index.search(queries, 10)):
        got.setdefault(q, set()).add(x)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    recall = np.mean([len(got[q] & want[q]) / 10 for q in want])
    assert recall >= 0.9 and abs(index.recall(queries, 10, 16) - recall) < 1e-9
    assert index.vectors().count() == rows.count() and index.vectors().select("_cell").distinct().count() > 10


def test_tuned_recall(spark, tmp_path):
    """Ten times the vectors; fewer cells are opened than there are."""
    rows = vectors(spark, "/root/testdata/sf0.1")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    probes, cells = index.tuned(asked, 10), index.vectors().select("_cell").distinct().count()
    assert index.recall(asked, 10, probes) >= 0.9 and probes < cells
    print(f"recall@10 {index.recall(asked, 10, probes):.3f} with {probes} of {cells} cells")


def test_scores_of_the_index_are_exact(spark, rows, queries, index):
    score = {(q, x): s for q, x, s in hits(v.scored(queries, rows))}
    assert all(abs(s - score[q, x]) < 1e-6 for q, x, s in hits(index.search(queries, 5, probes=3)))


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], None), (3, None, "a"), (4, [1.0, 0.0], None), (4, [0.0, 2.0], "b")], "vec_id long, v array<double>, label string")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, q array<double>")
    assert hits(best(asked, rows, 3)) == [(7, 1, 1.0), (7, 2, 0.0), (7, 4, 1.0)]
    assert hits(best(asked, rows, 1, per="label")) == [(7, 1, 1.0), (7, 4, 0.0), (7, 4, 1.0)]
    assert best(asked.limit(0), rows, 3).count() == 0 and best(asked, rows.limit(0), 3).count() == 0
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    assert hits(index.search(asked, 2)) == [(7, 1, 1.0), (7, 4, 1.0)]


def test_best_holds_few_hits_at_once(spark, monkeypatch):
    """Many queries and ties: the same hits as by brute force, and no more are scored exactly at once than are asked for."""
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (700, 4)).astype(float)
    v[:300] = v[0]
    label = ["a" if i % 3 else None for i in range(700)]
    rows = spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(700)], "vec_id long, label string, v array<double>").repartition(3)
    u = vectorindex.normalised(v)
    want = {}
    for q in range(0, 700, 7):
        for kind in ("a", None):
            mine = np.array([i for i in range(700) if label[i] == kind])
            score = vectorindex.dots(np.repeat(u[[q]], len(mine), 0), u[mine])
            want[q, kind] = [(int(mine[k]), float(score[k])) for k in np.lexsort((mine, -score))[:5]]
    found = {}
    for x in vectorindex.best(rows.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows, 5, per="label").collect():
        found.setdefault((x.query_id, x.label), []).append((x.vec_id, x.score))
    assert {k: sorted(x, key=lambda h: (-h[1], h[0])) for k, x in found.items()} == want
    sizes, plain = [], vectorindex.dots
    monkeypatch.setattr(vectorindex, "HITS", 100)
    monkeypatch.setattr(vectorindex, "dots", lambda a, b: sizes.append(len(a)) or plain(a, b))
    kept = np.full((100, 5), -np.inf)
    sent = [len(w) for w, _, _ in vectorindex._hits(np.arange(100), u[:700:7], u, np.arange(700), 5, None, kept)]
    assert max(sizes) <= 100 and sum(sent) == 500 and np.isfinite(kept).all()
    again = [len(w) for w, _, _ in vectorindex._hits(np.arange(100), u[:700:7], u[600:], np.arange(600, 700), 5, None, kept)]
    assert sum(again) < 500  # what isn't among the best so far goes no further
