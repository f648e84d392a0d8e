"""Look-ups on the bucketed store: rows, the plan's exchanges, and how much of the store is read."""

import uuid

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import lookup


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.repeat(F.lit("x"), F.lit(50)).alias("content"))
    return lookup.lay_out(rows, "store_" + uuid.uuid4().hex, str(tmp_path_factory.mktemp("store")), buckets=8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_leave_the_store_in_place(spark, store):
    batch = spark.range(19_990, 20_020).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content_hash")).union(spark.createDataFrame([(None, None)], "id long, content_hash string"))
    for df, want in ((lookup.missing(batch, store), [None, *range(20_000, 20_020)]), (lookup.found(store, batch), list(range(19_990, 20_000)))):
        text = plan(df)
        side = [line for line in text.split("\n") if "Exchange" in line or "Bucketed: true" in line]
        assert sorted((r.id for r in df.collect()), key=lambda x: (x is not None, x)) == want
        assert sum("Exchange" in line for line in side) <= 2 and "BroadcastExchange" not in text
        scan = next(k for k, line in enumerate(text.split("\n")) if "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = text.split("\n")
        above, at = [], depth(lines[scan])
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        assert not [line for line in above if "Exchange" in line], above


def test_a_point_opens_one_bucket(spark, store):
    h = store.filter("id = 77").first().content_hash
    one = lookup.point(store, h)
    assert [r.id for r in one.collect()] == [77]
    metrics = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert one.rdd.getNumPartitions() == 1 and 0 < metrics.apply("numOutputRows").value() <= 20_000 / 8 + 500  # rows of one bucket
    assert len(store.inputFiles()) == 8 and lookup.point(store, "absent").count() == 0
