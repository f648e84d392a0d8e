"""Alerts of single scripts, from state that outlives micro-batches.

Each script hash has its first and last scan, its scans and errors, and for each week that isn't over the scans that should
have been found and those that were. An alert tells a share of errors above its limit (once until it falls again) and a
finished week's recall below its own. Weeks end, and scripts without scans are forgotten, by timers in event time, so late
rows within the watermark still count and the state doesn't grow with all scripts ever seen.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

WEEK_MS = 7 * 24 * 3600 * 1000
OUTPUT = "script_hash string, kind string, at timestamp, scans long, value double, first timestamp, last timestamp"
#: The state store that timers and several states a key need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _time(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).replace(tzinfo=None)


class ScanState(StatefulProcessor):
    def __init__(self, most_errors: float, least_scans: int, least_recall: float, forget_ms: int):
        self.most_errors, self.least_scans, self.least_recall, self.forget_ms = most_errors, least_scans, least_recall, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, scans long, errors long, alerted boolean")
        self.weeks = handle.getMapState("weeks", "week long", "expected long, found long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, scans, errors, alerted = self.seen.get() if self.seen.exists() else (None, None, 0, 0, False)
        before, weeks = last, {}
        for b in rows:
            ms = b["ms"].astype("int64")
            low, high = int(ms.min()), int(ms.max())
            first, last = min(first, low) if first is not None else low, max(last, high) if last is not None else high
            scans, errors = scans + len(b), errors + int(b["failed"].sum())
            truth, found = b["truth"] == 1, b["predicted"] == 1
            for week, part in pd.DataFrame({"week": ms // WEEK_MS, "expected": truth, "found": truth & found}).groupby("week"):
                e, f = weeks.get(week, (0, 0))
                weeks[int(week)] = (e + int(part["expected"].sum()), f + int(part["found"].sum()))
        for week, (e, f) in weeks.items():
            if self.weeks.containsKey((week,)):
                e0, f0 = self.weeks.getValue((week,))
                e, f = e + e0, f + f0
            else:
                self.handle.registerTimer((week + 1) * WEEK_MS)
            self.weeks.updateValue((week,), (e, f))
        if before is None or last > before:
            if before is not None:
                self.handle.deleteTimer(before + self.forget_ms)
            self.handle.registerTimer(last + self.forget_ms)
        high = scans >= self.least_scans and errors > self.most_errors * scans
        if high and not alerted:
            yield self._row(key, "errors", last, scans, errors / scans, first, last)
        self.seen.update((first, last, scans, errors, high))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.seen.exists():
            return
        first, last, scans, errors, _ = self.seen.get()
        for (week,) in sorted(tuple(k) for k in self.weeks.keys()):
            if (week + 1) * WEEK_MS <= at:
                expected, found = self.weeks.getValue((week,))
                self.weeks.removeKey((week,))
                if expected and found < self.least_recall * expected:
                    yield self._row(key, "recall", (week + 1) * WEEK_MS, expected, found / expected, first, last)
        if last + self.forget_ms <= at:
            yield self._row(key, "forgotten", at, scans, errors / scans, first, last)
            self.seen.clear()
            self.weeks.clear()

    @staticmethod
    def _row(key, kind: str, at: int, scans: int, value: float, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"script_hash": [key[0]], "kind": [kind], "at": [_time(at)], "scans": [scans], "value": [float(value)], "first": [_time(first)], "last": [_time(last)]})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def script_alerts(scans: DataFrame, *, delay: str = "1 hour", most_errors: float = 0.05, least_scans: int = 20, least_recall: float = 0.9, forget: datetime.timedelta = datetime.timedelta(days=30)) -> DataFrame:
    """script_hash, kind (errors, recall or forgotten), at, scans, value, first and last of the script, from a stream of scans:
    script_hash, ts, failed, predicted, truth (null where it isn't known). Rows without a hash or time are left out; rows that
    repeat count each. Rows later than `delay` are dropped by the watermark."""
    rows = scans.filter("script_hash is not null and ts is not null").withWatermark("ts", delay)
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    rows = rows.select("script_hash", "ts", F.unix_millis("ts").alias("ms"), F.coalesce(F.col("failed").cast("int"), F.lit(0)).alias("failed"), number("predicted"), number("truth"))
    processor = ScanState(most_errors, least_scans, least_recall, int(forget.total_seconds() * 1000))
    return rows.groupBy("script_hash").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")
