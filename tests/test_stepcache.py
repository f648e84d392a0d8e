"""The step cache: what runs again, and that hits start no job."""

import pytest

from scriptloom.operators import stepcache
from scriptloom.operators.stepcache import StepCache
from scriptloom.plans import flows

SF = "/root/testdata/sf0.001"


def jobs(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_second_run_reads_every_step(spark, tmp_path):
    want = rows(flows.training_rows(spark, SF))
    first = StepCache(spark, str(tmp_path))
    assert rows(flows.cached_training_rows(spark, SF, first)) == want
    assert first.misses == ["curate", "split", "augment", "balance", "prompt"] and not first.hits
    second = StepCache(spark, str(tmp_path))
    inputs = [spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")]
    before, _ = jobs(spark), inputs
    out = flows.cached_training_rows(spark, SF, second)
    assert jobs(spark) - before <= 2  # the schemas of the two tables; no step's job
    assert second.hits == first.misses and not second.misses and rows(out) == want
    third = StepCache(spark, str(tmp_path))
    s = flows.Settings(variants=1)
    assert rows(flows.cached_training_rows(spark, SF, third, s)) == rows(flows.training_rows(spark, SF, s))
    assert third.hits == ["curate", "split"] and third.misses == ["augment", "balance", "prompt"]


def doubled(rows, times=2):
    return rows.selectExpr(f"id * {times} as id")


def test_inputs_settings_and_switches(spark, tmp_path):
    data = str(tmp_path / "in")
    spark.range(5).write.parquet(data)

    def run(on=lambda s: True, **settings):
        cache = StepCache(spark, str(tmp_path / "c"), on)
        one = cache.step("one", doubled, cache.source(spark.read.parquet(data)), **settings)
        two = cache.step("two", doubled, one)
        return cache.hits, sorted(r.id for r in two.rows.collect())

    assert run() == ([], [0, 4, 8, 12, 16]) and run() == (["one", "two"], [0, 4, 8, 12, 16])
    assert run(times=3) == ([], [0, 6, 12, 18, 24]) and run(times=3)[0] == ["one", "two"]
    assert run(on=lambda s: s != "one")[0] == []  # what follows a step that isn't cached runs too
    spark.range(5, 6).write.mode("append").parquet(data)
    assert run() == ([], [0, 4, 8, 12, 16, 20])


def test_other_code_is_another_step(spark, tmp_path, monkeypatch):
    assert stepcache.code_key(flows._split) != stepcache.code_key(flows._prompts)
    names = {m.__name__ for m in stepcache.modules_of(flows._split)}
    assert {"scriptloom.plans.flows", "scriptloom.operators.sampling", "scriptloom.functions.text"} <= names
    before = stepcache.code_key(flows._split)
    real = stepcache.Path.read_bytes
    monkeypatch.setattr(stepcache.Path, "read_bytes", lambda p: real(p) + (b"#" if p.name == "sampling.py" else b""))
    assert stepcache.code_key(flows._split) != before


def test_a_crash_leaves_no_result(spark, tmp_path, monkeypatch):
    cache = StepCache(spark, str(tmp_path))
    source = stepcache.Kept(spark.range(3), "x")

    def crash(*a):
        raise RuntimeError("gone")

    monkeypatch.setattr(cache.files, "write_new", crash)
    with pytest.raises(RuntimeError):
        cache.step("one", doubled, source)
    again = StepCache(spark, str(tmp_path))
    again.step("one", doubled, source)
    assert again.misses == ["one"]
