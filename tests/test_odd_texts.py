"""Queries over texts that the tables don't have, against their SQL."""

import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptloom import catalog
from scriptloom.operators import textindex


@pytest.fixture
def tables(spark, tmp_path):
    def make(texts):
        spark.createDataFrame([(i, x, "en", "web", 1) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(i, 1, 1) for i, _ in texts[:1]], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")

        def both(name):
            key = lambda r: repr(r)
            return sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()), key=key), sorted(con.sql(catalog.oracle_sql()[name]).fetchall(), key=key)

        return both

    return make


def test_short_is_told_by_characters(tables):
    found, want = tables([(3, "ééééé"), (9, "ééééééééé"), (15, "éééééééééé"), (21, "short"), (27, "long enough")])("flt_13_binary_bytes")
    assert found == want and {r[0] for r in found if r[1]} == {3, 9, 21}


def test_trigrams_of_long_and_odd_texts(tables, spark):
    texts = [(1, "aXaxax"), (2, None), (3, "ab"), (4, ""), (5, "ẞabc ẞABC"), (6, "abcABC"), (7, "ééé 😀😀😀😀 名")]
    found, want = tables(texts)("sql_02_trigram_counts")
    assert found == want
    # quadratic work over a million characters of two bytes took minutes
    long = spark.range(1).select(F.repeat(F.lit("éa b"), 250_000).alias("x")).cache()
    began = time.time()
    assert long.select(textindex.trigram_count(F.lower("x"), F.length("x"))).first()[0] == 4
    assert time.time() - began < 30


def test_first_text_of_blank_documents(spark, tmp_path):
    """A blank text is still what a document has where its benchmark item is blank too, and a vertical tab is no blank."""
    texts = ["", " \t", None, "x", "\x0b", "y"]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "\n"), (2, " "), (3, "\x0b"), (4, None), (5, "z")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = sorted(map(tuple, catalog.queries()["flt_21_first_text"](spark, str(tmp_path)).collect()))
    want = sorted(con.sql(catalog.oracle_sql()["flt_21_first_text"]).fetchall())
    assert found == want and [i for i, x in found if x is None] == [2]


def test_batches_of_long_texts_are_bounded(spark):
    """Python tasks get texts by bytes, not 10,000 rows however long; a limit that the session sets itself stays."""
    from scriptloom import session

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    session.ship(spark)
    found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 5 and max(found) < 1.5 * session.BATCH_BYTES
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    session.ship(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (str(1 << 20), f"{1 << 20}b")
