"""The keyed table: what it holds after writes, versions, conflicts, crashes, rules and counted batches."""

import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.operators.keyed import KeyedTable, Rules
from scriptloom.sources import schemas
from scriptloom.streaming import scan_log

SCHEMA = "k long, v string"


@pytest.fixture
def make(spark, tmp_path_factory):
    def one(rules=None, schema=SCHEMA, buckets=8):
        return KeyedTable.create(spark, str(tmp_path_factory.mktemp("keyed") / "t"), schema, "k", buckets, rules)

    return one


def rows(table, **version):
    return sorted((r.k, r.v) for r in table.read(**version).collect())


def test_upsert_delete_and_versions(spark, make):
    t = make()
    assert rows(t) == []
    v1, refused = t.upsert(spark.createDataFrame([(k, f"a{k}") for k in range(100)], SCHEMA))
    assert refused.count() == 0 and rows(t) == [(k, f"a{k}") for k in range(100)]
    before = t.manifest().folders
    v2, _ = t.upsert(spark.createDataFrame([(3, "b3"), (200, "b200")], SCHEMA))
    after = t.manifest().folders
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2  # only buckets of the batch are written anew
    want = {k: f"a{k}" for k in range(100)} | {3: "b3", 200: "b200"}
    assert rows(t) == sorted(want.items()) and t.manifest().total == 101
    v3 = t.delete(spark.createDataFrame([(3,), (7,), (999,)], "k long"))
    assert rows(t) == sorted((k, v) for k, v in want.items() if k not in (3, 7))
    assert rows(t, version=v1) == [(k, f"a{k}") for k in range(100)] and rows(t, version=v2) == sorted(want.items())
    assert t.delete(spark.createDataFrame([(999999,)], "k long")) >= v3
    t.clear()
    assert rows(t) == [] and rows(t, version=v3) != []
    assert [(r.operation, r.rows) for r in t.history().collect()][:4] == [("create", 0), ("upsert", 100), ("upsert", 101), ("delete", 99)]


def test_named_versions_and_expiry(spark, make):
    t = make()
    t.upsert(spark.createDataFrame([(1, "a")], SCHEMA))
    t.name("first")
    for i in range(5):
        t.upsert(spark.createDataFrame([(1, f"b{i}"), (i + 10, "x")], SCHEMA))
    assert t.name("first") < t.manifest().version
    folders = set(t.files.names("data"))
    gone = t.expire(keep=2)
    assert gone and rows(t, name="first") == [(1, "a")] and len(rows(t)) == 6
    left = {f.split("/")[1] for v in t.versions() for f in t.manifest(v).all()}
    assert left < folders
    with pytest.raises(KeyError):
        t.read(name="other")


def test_one_of_two_writers_wins_and_the_other_retries(spark, make):
    t = make()
    t.upsert(spark.createDataFrame([(k, "a") for k in range(20)], SCHEMA))
    other, tries = KeyedTable(spark, t.folder), []

    def first(m):
        tries.append(m.version)
        if len(tries) == 1:  # between the data and the manifest another writer commits
            other.upsert(spark.createDataFrame([(1, "other"), (50, "other")], SCHEMA))

    t.before_commit = first
    t.upsert(spark.createDataFrame([(2, "mine"), (50, "mine")], SCHEMA))
    assert len(tries) == 2 and tries[1] == tries[0] + 1
    found = dict(rows(t))
    assert (found[1], found[2], found[50]) == ("other", "mine", "mine")


def test_writers_at_once(spark, make):
    t = make()

    def write(i):
        KeyedTable(spark, t.folder).upsert(spark.createDataFrame([(k, str(i)) for k in range(i, 40, 4)], SCHEMA))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert rows(t) == [(k, str(k % 4)) for k in range(40)] and t.versions() == list(range(5))


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, make):
    t = make()
    t.upsert(spark.createDataFrame([(1, "a")], SCHEMA))

    def crash(m):
        raise RuntimeError("the driver is gone")

    t.before_commit = crash
    with pytest.raises(RuntimeError):
        t.upsert(spark.createDataFrame([(1, "b"), (2, "b")], SCHEMA))
    again = KeyedTable(spark, t.folder)
    assert rows(again) == [(1, "a")]
    again.upsert(spark.createDataFrame([(2, "c")], SCHEMA))
    assert rows(again) == [(1, "a"), (2, "c")]


def test_rules(spark, make):
    t = make(Rules(checks={"short": "length(v) < 5"}, unique=("u",), required=("v",)), "k long, v string, u string")
    batch = [(1, "a", "x"), (2, "toolong", "y"), (3, None, "z"), (None, "a", "q"), (4, "a", "x"), (5, "a", None), (6, "a", None), (7, "a", "w"), (7, "b", "w")]
    _, refused = t.upsert(spark.createDataFrame(batch, "k long, v string, u string"))
    told = sorted((r.k if r.k is not None else -1, list(r.reasons)) for r in refused.collect())
    assert told == [(-1, ["k is null"]), (2, ["check short"]), (3, ["v is null"]), (4, ["u is taken"]), (7, ["k repeats"])]
    assert [r[0] for r in rows(t)] == [1, 5, 6, 7]
    _, refused = t.upsert(spark.createDataFrame([(8, "a", "w"), (1, "c", "n"), (9, "d", "x")], "k long, v string, u string"))
    assert [(r.k, list(r.reasons)) for r in refused.collect()] == [(8, ["u is taken"])]  # 1 gave x up, so 9 may have it
    _, refused = t.insert(spark.createDataFrame([(1, "z", "zz"), (20, "n", "n"), (21, "m", "m")], "k long, v string, u string"))
    assert [(r.k, list(r.reasons)) for r in refused.collect()] == [(20, ["u is taken"])]
    assert dict(rows(t))[1] == "c" and dict(rows(t))[21] == "m"


def test_times_and_the_samples_rules(spark, tmp_path):
    t = schemas.samples_table(spark, str(tmp_path / "s"), 4)
    batch = "select {} as id, '{}' as content_hash, 'x' as content, '{}' as label, 's' as source"
    _, refused = t.upsert(spark.sql(batch.format(1, "h1", "benign") + " union all " + batch.format(2, "h2", "unknown")))
    assert [(r.id, list(r.reasons)) for r in refused.collect()] == [(2, ["check label"])]
    first = t.read().first()
    t.upsert(spark.sql(batch.format(1, "h3", "malicious")))
    second = t.read().first()
    assert second.created_at == first.created_at and second.updated_at > first.updated_at and second.label == "malicious"


def test_the_last_of_a_key_by_order(spark, make):
    t = make()
    _, refused = t.upsert(spark.createDataFrame([(1, "a", 1), (1, "c", 3), (1, "b", 2), (2, "n", None)], "k long, v string, seq long"), order="seq")
    assert rows(t) == [(1, "c"), (2, "n")] and refused.count() == 2


def test_a_counted_batch_is_written_once(spark, make):
    t = make()
    batch = spark.createDataFrame([(1, "a")], SCHEMA)
    v1, _ = t.upsert(batch, writer="log", batch=0)
    assert t.upsert(spark.createDataFrame([(1, "b")], SCHEMA), writer="log", batch=0)[0] == v1 and rows(t) == [(1, "a")]
    t.upsert(spark.createDataFrame([], SCHEMA), writer="log", batch=1)
    assert t.manifest().batches == {"log": 1}
    with pytest.raises(ValueError):
        t.upsert(batch, writer="log")


def test_appends_and_compaction(spark, make):
    t = make(buckets=2)
    for i in range(4):
        t.append(spark.createDataFrame([(10 * i + j, "a") for j in range(10)], SCHEMA), writer="w", batch=i)
    t.append(spark.createDataFrame([(999, "again")], SCHEMA), writer="w", batch=3)
    assert rows(t) == [(k, "a") for k in range(40)] and max(map(len, t.manifest().folders.values())) == 4 and t.manifest().total == 40
    t.upsert(spark.createDataFrame([(5, "b")], SCHEMA))
    t.compact(most=2)
    assert rows(t) == [(k, "b" if k == 5 else "a") for k in range(40)] and {len(f) for f in t.manifest().folders.values()} == {1}


def test_a_stream_that_stops_between_commit_and_checkpoint(spark, make, tmp_path):
    """The batch's manifest is there, the checkpoint's commit isn't: the batch runs again and adds nothing."""
    t, source = make(), tmp_path / "in"
    spark.range(100).selectExpr("id as k", "'a' as v").repartition(2).write.parquet(str(source))
    log = spark.readStream.schema(SCHEMA).parquet(str(source))
    real = t.append

    def stop(*a, **b):
        real(*a, **b)
        raise RuntimeError("stopped before the checkpoint")

    t.append = stop
    with pytest.raises(Exception, match="stopped"):
        scan_log.append_once(log, t, str(tmp_path / "c")).awaitTermination()
    assert len(rows(t)) == 100 and t.manifest().batches == {"scan_log": 0}
    again = KeyedTable(spark, t.folder)
    scan_log.append_once(log, again, str(tmp_path / "c")).awaitTermination()
    assert rows(again) == [(k, "a") for k in range(100)]
    spark.range(100, 120).selectExpr("id as k", "'b' as v").write.mode("append").parquet(str(source))
    scan_log.append_once(log, again, str(tmp_path / "c")).awaitTermination()
    assert len(rows(again)) == 120


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["upsert", "insert", "delete"]), st.lists(st.integers(0, 12), max_size=6)), max_size=4))
def test_like_a_dictionary(spark, tmp_path_factory, steps):
    t, want = KeyedTable.create(spark, str(tmp_path_factory.mktemp("keyed") / "t"), SCHEMA, "k", 4), {}
    for i, (kind, keys) in enumerate(steps):
        batch = spark.createDataFrame([(k, f"{i}") for k in keys], SCHEMA)
        if kind == "delete":
            t.delete(batch)
            want = {k: v for k, v in want.items() if k not in keys}
        elif kind == "upsert":
            t.upsert(batch)
            want |= {k: f"{i}" for k in keys}
        else:
            t.insert(batch)
            want = {k: f"{i}" for k in keys} | want
    assert rows(t) == sorted(want.items()) and t.manifest().total == len(want)


def test_lookup_opens_few_buckets(spark, make):
    t = make(buckets=16)
    t.upsert(spark.range(5000).selectExpr("id as k", "concat('v', id) as v"))
    found = t.lookup([17, 4000, 99999])
    assert sorted(map(tuple, found.collect())) == [(17, "v17"), (4000, "v4000")]
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 3
