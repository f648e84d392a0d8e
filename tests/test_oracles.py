"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import json
import math
from pathlib import Path

import duckdb
import pytest

from scriptloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# What queries that need a parser gave when their results were last checked (test_parsed.py): rows and a digest of them.
GOLDEN = json.loads((Path(__file__).parent / "golden.json").read_text())

# Whose results other tests hold against brute force.
ELSEWHERE = {"vec_23_index_hits": "test_vectorindex.py", "src_03_folders": "test_ingest.py"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v) or v != v:
            return None
        return round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


def digest(frame):
    return hashlib.sha256(repr(rows(frame)).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    found = catalog.queries()[name](spark, DIR).toPandas()
    if name in catalog.oracle_sql():
        assert rows(found) == rows(db.sql(catalog.oracle_sql()[name]).df())
    elif name in ELSEWHERE:
        assert len(found) > 0
    else:
        assert [len(found), digest(found)] == GOLDEN[name]
