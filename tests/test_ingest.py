"""Labelled folders, first members, package files, fallbacks and samples from points."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptloom.operators import code, sampling
from scriptloom.sources import samples as src

GOOD = "import os\n\n\ndef run(x):\n    return os.path.join(x, 'a')\n\n\nprint(run('b'))\n"


def test_labelled_folders(spark, tmp_path):
    files = {"bad/a.py": GOOD.encode(), "bad/deep/b.py": b"def broken(:\n", "bad/c.txt": GOOD.encode(), "good/d.py": b"", "good/e.py": b"\xff\xfe\x00", "good/f.py": b"# only\n" * 40, "good/g.py": GOOD.encode(), "good/x/h.py": GOOD.encode()}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    taken, reasons = src.labelled_folders(spark, str(tmp_path / "bad"), str(tmp_path / "good"))
    assert sorted((r.source.rsplit("/", 1)[1], r.label) for r in taken.collect()) == [("a.py", "malicious"), ("g.py", "benign"), ("h.py", "benign")]
    assert sorted(map(tuple, reasons.collect())) == [("benign", "density", 1), ("benign", "encoding", 1), ("malicious", "syntax", 1)]
    with pytest.raises(ValueError):
        src.labelled_folders(spark)


def zipped(*files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def test_first_member(spark):
    rows = [(1, zipped(("d/", b""), ("a", b"first"), ("b", b"second"))), (2, zipped()), (3, b"nonsense"), (4, None), (5, zipped(("empty", b""), ("b", b"x")))]
    got = spark.createDataFrame(rows, "id long, raw binary").select("id", code.first_member("raw").alias("m")).collect()
    assert {r.id: r.m and bytes(r.m) for r in got} == {1: b"first", 2: None, 3: None, 4: None, 5: b""}


def test_large_members_are_read():
    big = b"x = 1\n" * (2 << 20)
    assert [len(m["content"]) for m in code.members(zipped(("big.py", big)))] == [len(big)]


def test_package_files(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as z:
        for name, data in (("a.py", b"a" * 101), ("b.txt", b"b" * 200), ("c.py", b" " * 90 + b"c" * 100), ("d.py", b"d" * 300), ("e.py", b"e" * 300)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            z.addfile(info, io.BytesIO(data))
    rows = [(1, out.getvalue()), (2, zipped(("a.py", b"z" * 150))), (3, b"nonsense"), (4, None)]
    got = spark.createDataFrame(rows, "id long, raw binary").select("id", code.package_files("raw", F.lit(3)).alias("m")).collect()
    assert {r.id: [x[0] for x in r.m] for r in got} == {1: ["a", "d"], 2: ["z"], 3: [], 4: []}


def test_fallback(spark):
    fixed, none = src.fallback_rows(spark), spark.createDataFrame([], "id long, content string, label string")
    assert src.or_fallback(none, fixed, 2).count() == 2 and src.or_fallback(none, fixed, 99).count() == len(src.EXPLOIT_SAMPLES)
    assert src.or_fallback(fixed.filter("id = 3"), fixed, 2).select("id").collect()[0][0] == 3 and src.or_fallback(fixed.filter("id = 3"), fixed, 2).count() == 1


def test_samples_from_points(spark):
    points = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, None), (None, 0), (0, 0), (9, 0), (4, 0)], "db_id long, chunk_index int")
    rows = spark.createDataFrame([(k, GOOD, "benign", "s") for k in (0, 1, 2, 3)] + [(4, "aaaa", "malicious", "s")], "id long, content string, label string, source string")
    got = sampling.from_points(points, rows).collect()
    assert sorted(r.metadata["db_id"] for r in got) == ["1", "3"]
    assert all(r.content.startswith("# === CODE METADATA ===\n# Language: python\n# Source: s\n# Classification: benign\n") and r.source == "qdrant_code_samples" for r in got)
