"""Operators on small literal inputs, with results worked out by hand or by plain Python."""

import codecs
import hashlib
import io
import math
import tarfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptloom import config
from scriptloom.functions import text as t
from scriptloom.operators import chunking, code, dedup, metrics, quality, sampling, store
from scriptloom.operators import vectors as v
from scriptloom.plans import flows
from scriptloom.sources import samples as src
from scriptloom.streaming import scan_log


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("answer,want", [("BENIGN", 0), ("MALICIOUS.", 1), ("maybe", -1), ("", -1), (f"x\n{t.ANCHOR} malicious, surely", 1), (f"{t.ANCHOR} BENIGN\n{t.ANCHOR} MALICIOUS", 1), ("first\nBENIGN!", 0)])
def test_verdicts(spark, answer, want):
    assert one(spark, t.parsed_verdict(F.col("x")), x=answer) == want


@pytest.mark.parametrize("text", ["", "aaaa", "hello world", "é😀é\n", "import os\n" * 30])
def test_entropy_and_rot13(spark, text):
    n = len(text)
    want = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0
    assert abs(one(spark, t.entropy(F.col("x")), x=text) - want) < 1e-9
    assert one(spark, t.rot13(F.col("x")), x=text) == codecs.encode(text, "rot13")


def test_ids(spark):
    digest = hashlib.md5(b"abc_2").digest()
    assert one(spark, t.chunk_id(F.col("x"), F.lit(2)), x="abc") == int.from_bytes(digest[:8], "big") % (2**63 - 1)
    assert one(spark, t.parent_id(F.col("x"), F.lit(0)), x="abc") == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, t.parent_id(F.col("x"), F.lit(7)), x="abc") == hashlib.sha256(b"7_abc").hexdigest()


def test_space_and_cuts(spark):
    assert one(spark, t.normalise_space(F.col("x")), x="\n\na  \n\n\n\n\nb\t\n\n") == "a\n\n\nb"
    assert one(spark, t.head_and_tail(F.col("x"), 200), x="x" * 300) == "x" * 50 + "\n\n# ... [Truncated 100 chars] ...\n\n" + "x" * 50
    assert one(spark, t.head_and_tail(F.col("x"), 200), x="short") == "short"
    assert one(spark, t.redact(F.col("x")), x="Bearer abcdefghijklmnopqrstuvwx") == "Bearer ***REDACTED***"


def test_few_shot(spark):
    df = spark.createDataFrame([("target ```", [("bad", "malicious"), ("good", None)])], "c string, e array<struct<code:string,label:string>>")
    text = df.select(t.few_shot_prompt(F.col("c"), F.col("e"))).first()[0]
    assert "Example 1 (MALICIOUS):\n```\nbad\n```\n\nExample 2 (UNKNOWN):" in text and "target ``\\`" in text and text.endswith(t.ANCHOR)


def test_aggregation_of_chunks(spark):
    hits = spark.createDataFrame([(0, 1, 0.9, 10, "a"), (0, 1, 0.7, 11, "a"), (0, 2, 0.8, 12, "b"), (0, 2, 0.6, 13, "b"), (0, None, 0.99, 14, "b")], "query_id long, db_id long, score double, vec_id long, label string")
    got = {r.db_id: (round(r.score, 6), r.num_chunks, r.vec_id) for r in v.to_documents(hits).collect()}
    assert got == {1: (0.9, 2, 10), 2: (0.8, 2, 12)}
    three = spark.createDataFrame([(0, 1, s, k, "a") for k, s in enumerate((0.9, 0.8, 0.5))], hits.schema)
    assert abs(v.to_documents(three, "average_top_n", 2).first().score - 0.85) < 1e-9
    two = spark.createDataFrame([(0, 1, s, k, "a") for k, s in enumerate((0.9, 0.6))], hits.schema)
    assert abs(v.to_documents(two, "weighted_avg").first().score - 0.78) < 1e-9


def test_rerank(spark):
    hits = spark.createDataFrame([(0, 1, 0.80, "same"), (0, 2, 0.79, "same"), (0, 3, 0.70, "eval(x)")], "query_id long, vec_id long, score double, code string")
    got = {r.vec_id: r.diversity_penalized for r in v.diversified(hits, F.col("a.code") == F.col("b.code")).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert {r.vec_id: r.boosted for r in v.boosted(hits).collect()} == {1: False, 2: False, 3: True}


@pytest.mark.parametrize("n,k", [(0, 5), (2, 5), (10, 5), (100, 5)])
def test_always_k(spark, n, k):
    scores = spark.createDataFrame([(0, i, i / 200 - 0.2, "malicious" if i % 3 else "benign") for i in range(n)], "query_id long, vec_id long, score double, label string")
    assert v.always_k(scores, k, 0.99).count() == min(n, k)


def test_thresholds():
    assert v.threshold("lenient") < v.threshold() < v.threshold("strict") and v.threshold("strict", 0.1) == 0.1


def test_confusion_example(spark):
    m = spark.createDataFrame([(242, 12, 8, 238)], "tp long, fp long, fn long, tn long")
    r = metrics.rates(m).first()
    assert abs(r.accuracy - 0.96) < 1e-9 and abs(r.precision - 242 / 254) < 1e-9 and abs(r.recall - 0.968) < 1e-9
    assert metrics.hard_auc(spark.createDataFrame([(0, 0, 0, 5)], m.schema)).first().roc_auc is None


def test_greedy_is_not_components(spark):
    # 1~2, 2~3, not 1~3: 2 is dropped by 1, so 3 stays
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (4, 6)], "i long, j long")
    assert {r.id for r in dedup.greedy_dropped(pairs).collect()} == {2, 5, 6}


def test_greedy_follows_long_chains(spark):
    # each version is near to the next alone: every second one is dropped, however long the chain
    pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 210)], "i long, j long").coalesce(1)
    assert {r.id for r in dedup.greedy_dropped(pairs).collect()} == set(range(2, 211, 2))


def test_exact_keeps_the_first(spark):
    rows = src.merged(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "")], "id long, content string"))
    got = dedup.exact(store.cleaned(rows))
    assert {r.id for r in got.collect()} == {1, 2}


def test_hierarchical(spark):
    big = "def big():\n" + "\n".join(f"    x{i} = {i} + 1" for i in range(300))
    texts = [(1, "import os\n\ndef a():\n    return 1\n\nclass B:\n    def c(self):\n        pass\n"), (2, "not python ("), (3, big)]
    got = code.hierarchical(spark.createDataFrame(texts, "id long, content string"), most=100).collect()
    kinds = {k: sorted(r.chunk_type for r in got if r.id == k) for k in (1, 2, 3)}
    assert kinds[1] == ["class", "function", "module"] and kinds[2] == ["sliding_window"] and set(kinds[3]) == {"sliding_window_fallback"}


def test_windows(spark):
    rows = chunking.sliding(spark.createDataFrame([(1, " ".join(map(str, range(300))))], "id long, content string"), 128, 16).orderBy("chunk_index").collect()
    assert [(r.start_token, r.end_token) for r in rows] == [(0, 128), (112, 240), (224, 300)] and {r.total_chunks for r in rows} == {3}


def test_quality_reasons(spark):
    reason = lambda x: one(spark, quality.source_reason(F.col("x")), x=x)
    assert [reason(x) for x in ("   ", "short", "a" * 9 + "\x00" + "b" * 9, "MZ" + "x" * 20, "A" * 100, "é" * 50, "print('hello world')")] == ["empty_content", "too_short", "null_bytes_detected", "windows_executable", "excessive_base64", "low_ascii_ratio", None]
    assert one(spark, t.code_density(F.col("x")), x="\n" + "# c\n" * 9 + "x = 1\n") == pytest.approx(1 / 12)


def test_code_udfs(spark):
    df = spark.createDataFrame([(1, "import os, sys\nfrom a import b\nx = eval('longer text')\n"), (2, "def ("), (3, None)], "id long, content string")
    f = {r.id: r.f for r in df.select("id", code.ast_features("content").alias("f")).collect()}
    assert f[1].imports == ["os", "sys", "a.b"] and f[1].dangerous_patterns == ["eval"] and f[2].function_calls == []
    assert [r[0] for r in df.orderBy("id").select(code.valid_syntax(F.col("content"))).collect()][:2] == [True, False]
    assert "'longe' + 'r text'" in df.filter("id = 1").select(code.strings_split("content")).first()[0]
    renamed = df.filter("id = 1").select(code.variables_renamed("content", "id")).first()[0]
    assert "var_" in renamed and "eval" in renamed


def test_license_header_state(spark):
    x = "# MIT License\n# Copyright me\n'''one line'''\ncode = 1\n'''end'''\nmore = 2"
    assert one(spark, code.licenses_removed("x"), x=x) == "more = 2"


def test_archives():
    text = "print('hello')\n" * 10
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.py", text)
        f.writestr("b.bin", text)
        f.writestr("c.py", "short")
    g = io.BytesIO()
    with tarfile.open(fileobj=g, mode="w:gz") as f:
        info = tarfile.TarInfo("d.sh")
        info.size = len(text)
        f.addfile(info, io.BytesIO(text.encode()))
    assert [m["name"] for m in code.members(z.getvalue())] == ["a.py"] and [m["name"] for m in code.members(g.getvalue())] == ["d.sh"]
    assert code.members(b"nonsense") == [] and code.members(None) == []


def test_archive_bytes(spark):
    assert one(spark, quality.archive_bytes(F.col("x")), x=bytearray(b"\x1f\x8b\x08aaaaaaa")) is True
    assert one(spark, quality.binary_bytes(F.col("x")), x=bytearray(b"GIF89aaaaaaaaaa")) is True
    assert [one(spark, quality.member_binary(F.col("x")), x=bytearray(b)) for b in (b"Rar!xx", b"a\0" * 11, b"a\0" * 10, b"print(1)")] == [True, True, False, False]
    assert one(spark, quality.binary_bytes(F.col("x")), x=bytearray(b"plain text here")) is False


def test_store_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "malicious", "s"), (2, "b", "benign", "s")], "id long, content string, label string, source string")
    store.write_jsonl(rows, str(tmp_path / "j"), "malicious")
    assert [r.content for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a"]
    store.save_artifact(rows, str(tmp_path / "p" / "inner"))
    assert store.load_artifact(spark, str(tmp_path / "p")).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_text("print(1)")
    (tmp_path / "x" / "b.txt").write_text("no")
    got = src.script_files(spark, str(tmp_path)).collect()
    assert [r.content for r in got] == ["print(1)"]


def test_records(spark):
    v31 = '{"cve":{"id":"A","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":"Remote Code"}],"references":[{"url":"u"}],"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":9.8,"baseSeverity":"CRITICAL"}}],"cvssMetricV2":[{"cvssData":{"baseScore":5.0},"baseSeverity":"MEDIUM"}]}}}'
    none = '{"cve":{"id":"B","descriptions":[],"metrics":{}}}'
    raw = spark.createDataFrame([(v31,), (none,)], "value string")
    got = {r.cve_id: r for r in src.flatten_cves(raw).collect()}
    assert got["A"].cvss_score == 9.8 and got["A"].references == ["u"] and got["B"].cvss_score is None and got["B"].severity == "UNKNOWN"
    assert [r.cve_id for r in src.flatten_cves(raw, keywords=["code"]).collect()] == ["A"]


def test_balance(spark):
    rows = spark.createDataFrame([(i, f"c{i}", "malicious" if i < 10 else "benign", "s") for i in range(40)], "id long, content string, label string, source string")
    count = lambda df: {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    assert count(sampling.undersample(rows)) == {"malicious": 10, "benign": 10}
    assert count(sampling.oversample(rows)) == {"malicious": 30, "benign": 30}
    assert count(sampling.hybrid(rows, 1.5)) == {"malicious": 15, "benign": 10}
    parts = sampling.split(rows)
    assert parts.filter("part = 'test'").count() == 4 and parts.count() == 40
    assert sampling.class_weights(rows.filter("label = 'benign'")).first().weight == 1.0


def test_settings():
    with pytest.raises(ValueError):
        flows.Settings(balance="sideways")
    s = flows.Settings(steps={"all": False, "augment": True})
    assert s.on("augment") and not s.on("balance")


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_path / "in"
    events.write.parquet(str(folder))
    log = scan_log.read(spark, str(folder), events.schema)
    scan_log.append(log, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    q = scan_log.windowed(log).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("scans")).first()[0] == events.count()
    q = scan_log.deduplicated(log.withColumn("script_hash", F.col("user_id")), delay="60 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == events.select("user_id").distinct().count()


def test_schemas(spark, tmp_path):
    from scriptloom.sources import schemas

    schemas.create(spark, str(tmp_path))
    schemas.create(spark, str(tmp_path))
    rows = schemas.conformed(schemas.stamped(spark.createDataFrame([(1, "x", 5)], "id int, content string, other int")), schemas.SAMPLES)
    assert rows.first().id == 1 and rows.first().label is None and rows.first().updated_at is not None and "other" not in rows.columns


def test_small_helpers(spark):
    assert [src.backoff(k) for k in (0, 3, 10)] == [1.0, 8.0, 60.0]
    assert one(spark, src.host_of(F.col("x")), x="https://a.b/c?d") == "a.b"
    assert one(spark, src.raw_url(F.col("x")), x="https://github.com/o/r/blob/main/f.py") == "https://raw.githubusercontent.com/o/r/main/f.py"
    assert one(spark, t.language(F.col("x")), x="src/run.sh") == "bash"
    assert one(spark, F.array_join(src.trigrams(F.col("x")), ","), x="AbcdX") == "abc,bcd,cdx"
    assert one(spark, t.pattern_sample(F.col("x"), F.lit(None).cast("string"), F.lit(""), F.lit("LOW"), "description_only"), x="d") == "# d\n# Pattern: N/A"


def test_rerank_strategies(spark):
    hits = spark.createDataFrame([(0, 1, 0.5, "eval(x)"), (0, 2, 0.55, "plain")], "query_id long, vec_id long, score double, code string")
    first = lambda **how: v.reranked(hits, 1, **how).first().vec_id
    assert first() == 1 and first(strategy="none") == 2 and first(strategy="cross_encoder", cross=F.lit(1.0) - F.col("vec_id") / 10) == 1


def test_minhash_finds_near_pairs(spark):
    """Of all pairs as similar as 0.85, MinHash finds nine of ten at least, and none that isn't; permutations differ."""
    from pyspark.sql import functions as F

    from scriptloom.sources.samples import samples

    once = dedup.exact(samples(spark, "/root/testdata/sf0.01"))
    want = {tuple(r) for r in dedup.near_pairs(once, 0.85).collect()}
    got = {tuple(r) for r in dedup.minhash_pairs(once, 0.85).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want)
    bands = dedup.minhash(once.limit(5)).groupBy("id").agg(F.countDistinct("value").alias("n")).collect()
    assert all(r.n == 16 for r in bands)


def test_config(tmp_path, monkeypatch):
    file = tmp_path / "c.json"
    file.write_text('{"curation": {"min_length": "${LEAST:-60}", "near_threshold": "${NEAR:-0.9}", "balance": "${BALANCE:-none}"}, "other": ["${ON:-True}", "${NONE}", "${X:-a:-b}", "12", "x${ON}", "${RATE:-1e-3}"]}')
    assert config.load(str(file), {})["other"] == [True, "", "a:-b", "12", "x${ON}", 0.001]
    assert config.load(None, {"CONFIG_PATH": str(file), "LEAST": "7", "ON": "off"})["curation"]["min_length"] == 7
    monkeypatch.setenv("LEAST", "70")
    s = flows.Settings.load(str(file))
    assert (s.min_length, s.near_threshold, s.balance, s.max_length) == (70, 0.9, "none", 50_000)
    assert flows.Settings.load(str(file), "absent") == flows.Settings()
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "missing.yaml"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"a": {"b": "${B:-5}"}}))
    assert config.load(str(tmp_path / "c.yaml"), {}) == {"a": {"b": 5}}


@pytest.mark.parametrize("values,error", [({"min_length": "many"}, TypeError), ({"steps": 1}, TypeError), ({"min_length": 0}, ValueError), ({"max_comments": 1.5}, ValueError), ({"near_method": "magic"}, ValueError), ({"overlap": 128}, ValueError), ({"unknown": 1}, ValueError), ({"variants": True}, TypeError)])
def test_settings_are_checked(values, error):
    with pytest.raises(error):
        flows.Settings.of(values)


def test_downloads(spark):
    text = "print('hello')\n" * 10
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.py", text)
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as f:
        f.writestr("picture.png", text)
    files = [("a.zip", z.getvalue()), ("named.txt", z.getvalue()), ("b.zip", empty.getvalue()), ("c.sh", text.encode()), ("c.GZ", text.encode()), ("short.py", b"x" * 49), ("d.py", b"\xff" + text.encode()), ("e.py", b"\0" * 99), (None, text.encode()), ("f.py", None)]
    df = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in files], "name string, raw binary")
    got = [[(m.name, m.content) for m in r[0]] for r in df.coalesce(1).select(code.downloads("name", "raw")).collect()]
    assert got == [[("a.py", text)], [("a.py", text)], [], [("c.sh", text)], [], [], [("d.py", text)], [], [("", text)], []]


def test_sample_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "dir/a.py", "x = 'é'"), (2, None, None, None), (3, "s", "b\\c.py", "y")], "id long, source string, file_name string, content string")
    paths = [r.path for r in store.write_files(rows, str(tmp_path / "out"), "20240101").collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["s_20240101_b_c.py", "s_20240101_dir_a.py", "unknown_20240101_sample_2"]
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"s_20240101_dir_a.py": "x = 'é'", "unknown_20240101_sample_2": "", "s_20240101_b_c.py": "y"}


def test_report_and_refresh(spark, tmp_path):
    stats = spark.createDataFrame([("a", 1, 0.5)], "label string, n long, share double")
    store.write_report(stats, str(tmp_path / "r.yaml"))
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load((tmp_path / "r.yaml").read_text()) == [{"label": "a", "n": 1, "share": 0.5}]
    with pytest.raises(ValueError):
        store.write_report(spark.range(3), str(tmp_path / "r.yaml"), most=2)
    store.refresh(stats, str(tmp_path / "s"))
    before = store.refreshed(spark, str(tmp_path / "s"))
    store.refresh(stats.withColumn("n", F.lit(2).cast("long")), str(tmp_path / "s"))
    assert before.first().n == 1 and store.refreshed(spark, str(tmp_path / "s")).collect() == [("a", 2, 0.5)]


def test_database_table(spark):
    url, driver = "jdbc:derby:memory:samples;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id", "concat('t', id) AS content").write.jdbc(url, "samples", properties={"driver": driver})
    got = src.jdbc(spark, url, "samples", low=0, high=100, parts=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and {(r[0], r[1]) for r in got.collect()} == {(k, f"t{k}") for k in range(100)}


def test_exploit_samples(spark):
    rows = src.exploit_samples(spark).collect()
    assert len(rows) == len({r.content_hash for r in rows}) == 4 and {r.label for r in rows} == {"malicious"}
    assert [r.metadata["pattern"] for r in rows][:2] == ["command_injection", "arbitrary_code_execution"] and rows[3].metadata["severity"] == "HIGH"


def test_junk_depends_on_the_parent(spark):
    rows = spark.createDataFrame([(k, "\n".join(f"line {i}" for i in range(60)), "malicious", "s") for k in range(4)], "id long, content string, label string, source string")
    got = {r.parent_id: r.content for r in sampling.variants(rows, 1, ["add_junk"]).collect()}
    assert len(set(got.values())) == 4 and got == {r.id: r.x for r in rows.select("id", sampling.junk_added(F.col("content"), F.col("id")).alias("x")).collect()}


def test_chunks_by_strategy(spark):
    rows = spark.createDataFrame([(1, "x = 1\n\n\ndef f():\n    return 1\n")], "id long, content string")
    kinds = {s: [r.chunk_type for r in chunking.chunk(rows, s).collect()] for s in ("sliding", "hierarchical", "whole")}
    assert kinds == {"sliding": ["sliding_window"], "hierarchical": ["module", "function"], "whole": ["whole"]}


def test_windows_do_not_carry_whole_texts_and_blanks_are_told_early(spark):
    """Windows are made before they become rows; blank texts need no copy of the text; entropies are those of a plain count."""
    words = [str(k) for k in range(1000)]
    texts = [None, "", " \n \x1c\x85　", "a " * 150, "\n x", " ".join(words), "  " + "\t".join(words) + " \n", "é名" * 90 + "".join(map(chr, range(0x4E00, 0x4E00 + 500))), "x y " * 64, "x y " * 64 + "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("other", F.lit(1)).coalesce(1)
    got = chunking.sliding(rows, 128, 16)
    assert got.columns[:3] == ["id", "content", "other"] and got.columns[3:] == ["parent_id", "parent_context", "total_chunks", "chunk_index", "start_token", "end_token", "token_count", "chunk_id", "chunk_type"]
    want = []
    for i, x in enumerate(texts):
        split = (x or "").split()
        last = max(0, math.ceil((len(split) - 128) / 112))
        want += [(i, k, x if len(split) <= 128 else " ".join(split[k * 112 : k * 112 + 128]), k * 112, min(len(split), k * 112 + 128), last + 1) for k in range(last + 1) if split]
    assert sorted(got.select("id", "chunk_index", "content", "start_token", "end_token", "total_chunks").collect()) == sorted(want)
    generate = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x)
    assert "posexplode" in generate
    found = {r.id: r for r in quality.sanitized(rows).collect()}
    assert [found[i].reason for i in range(3)] == ["empty_content"] * 3 and found[3].reason == "extremely_low_entropy" and found[5].reason is None
    for i, x in enumerate(texts[1:], 1):
        assert math.isclose(found[i].entropy, -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()), abs_tol=1e-9)
    assert spark.range(1).select(t.is_blank(F.lit("  "))).first()[0] and "regexp_replace" not in str(t.is_blank(F.col("x")))
