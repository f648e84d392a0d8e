"""Stateful alerts: across micro-batches and a restart, by hand-made scans and by brute force over the events."""

import datetime

import pytest
from pyspark.sql import functions as F

from scriptloom.streaming import alerts

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 4)  # a week by the clock's epoch begins here
SCHEMA = "script_hash string, ts timestamp, failed boolean, predicted boolean, truth boolean"


@pytest.fixture
def run(spark, tmp_path):
    alerts.use_state_store(spark)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))

    def one(*batches, **options):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
            q = alerts.script_alerts(log, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
            q.awaitTermination()
        return sorted((r.script_hash, r.kind, r.at, r.scans, round(r.value, 6)) for r in spark.read.parquet(out).collect())

    return one


def scans(key, day, n, failed=0, predicted=True, truth=True):
    return [(key, START + day * DAY + datetime.timedelta(minutes=i), i < failed, predicted, truth) for i in range(n)]


def test_errors_add_up_over_batches_and_restarts(run):
    found = run(scans("a", 0, 15, failed=1) + scans("b", 0, 30), scans("a", 1, 15, failed=1), scans("a", 2, 15, failed=3))
    assert [(k, kind, n, v) for k, kind, _, n, v in found] == [("a", "errors", 30, round(2 / 30, 6))]  # told once while it is too high


def test_a_week_is_judged_when_it_is_over(run):
    week = scans("a", 0, 8) + scans("a", 3, 4, predicted=False) + scans("b", 2, 10) + scans("c", 1, 5, truth=None, predicted=False)
    found = run(week, scans("x", 9, 1), scans("y", 10, 1))
    assert found == [("a", "recall", START + 7 * DAY, 12, round(8 / 12, 6))]


def test_scripts_without_scans_are_forgotten(spark, run):
    found = run(scans("a", 0, 2), scans("b", 20, 1), scans("b", 41, 1), scans("b", 42, 1), forget=datetime.timedelta(days=10))
    assert [(k, kind, n) for k, kind, _, n, _ in found] == [("a", "forgotten", 2)]  # b's next scan came before its time was over


def test_like_brute_force(spark, run):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(user_id as string) as script_hash", "cast(ts as timestamp) as ts", "event_type = 'error' as failed", "value > 5 as predicted", "true as truth").orderBy("ts").collect()
    rows = [tuple(r) for r in events]
    cuts = [rows[: len(rows) // 2], rows[len(rows) // 2 :], [("end", rows[-1][1] + 20 * DAY, False, True, True)], [("end", rows[-1][1] + 21 * DAY, False, True, True)]]
    found = run(*cuts, forget=datetime.timedelta(days=400))
    weeks = {}
    for key, ts, _, predicted, _ in rows:
        w = (ts - START).days // 7
        e, f = weeks.get((key, w), (0, 0))
        weeks[key, w] = (e + 1, f + predicted)
    want = sorted((k, "recall", START + 7 * (w + 1) * DAY, e, round(f / e, 6)) for (k, w), (e, f) in weeks.items() if f < 0.9 * e)
    assert [r for r in found if r[1] == "recall"] == want
