"""Parser queries against plain versions, row by row over the whole smallest table."""

import ast
import collections
import difflib
import hashlib
import json
import math
import re

import pytest

from scriptloom import catalog
from scriptloom.functions import text as t
from scriptloom.operators import code
from scriptloom.sources.samples import scripts

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def content(spark):
    return {r.id: r.content for r in scripts(spark, DIR).collect()}


def tree_of(x):
    try:
        return ast.parse(x)
    except (SyntaxError, ValueError):
        return None


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def shortened(x, most=600):
    """The same rule told step by step."""
    if len(x) <= most:
        return x
    tail = x[len(x) - int(0.3 * most) :]
    room, tree, pieces, used = most - len(tail), tree_of(x), [], 0
    lines = x.split("\n")
    if tree:
        imports = "\n".join(lines[n.lineno - 1] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)))
    else:
        imports = "\n".join(re.findall(r"(?m)^(?:from\s+\S+\s+)?import\s+.+$", x))
    if imports and len(imports) < 0.3 * room:
        pieces.extend(["# Imports", imports])
        used = len(imports)
    for n in ast.walk(tree) if tree else []:
        if isinstance(n, ast.FunctionDef):
            body = "\n".join(lines[n.lineno - 1 : n.end_lineno])
            if any(w in body for w in t.SECURITY_WORDS):
                if used + len(body) >= 0.7 * room:
                    break
                pieces.extend(["# Security Function", body])
                used += len(body)
    left = room - used - 100
    if left > 200:
        pieces.extend(["# Code Body", x[:left]])
    out = "\n".join(pieces + ["\n# ... [TRUNCATED] ...\n", "# End of file (Payloads often here)", tail])
    return out if len(out) <= most else x[: most // 2 - 50] + f"\n\n# ... [Truncated {len(x) - most} chars] ...\n\n" + x[-(most // 2 - 50) :]


def test_smart_cut(spark, content):
    found = {r.id: r.digest for r in catalog.queries()["txt_05_smart_cut"](spark, DIR).collect()}
    assert found == {k: md5(shortened(x)) for k, x in content.items()}
    odd = ["", "x" * 5000, "import a\n" * 400, "import a\n" + "def f():\n    eval(x)\n" * 200, "def broken(:\n" * 100 + "import os\n"]
    for x in odd:
        for most in (100, 600, 1000):
            assert code.cut_smartly(x, most) == shortened(x, most)


def test_features(spark, content):
    found = {r.id: json.loads(r.features) for r in catalog.queries()["fea_07_features"](spark, DIR).collect()}
    for k, x in content.items():
        n = collections.Counter(x)
        entropy = -sum(c / len(x) * math.log2(c / len(x)) for c in n.values()) if x else 0.0
        f = found[k]
        assert math.isclose(f["entropy"], entropy, abs_tol=1e-9) and f["length"] == len(x)
        assert f["network_apis"] == [w for w in t.NETWORK if w in x.lower()]
        tree = tree_of(x)
        kinds = collections.Counter(type(node).__name__ for node in ast.walk(tree)) if tree else {}
        assert f["ast"]["node_counts"] == dict(kinds) and f["ast"]["complexity_score"] == len(kinds)
        calls = [node.func.id if isinstance(node.func, ast.Name) else node.func.attr for node in ast.walk(tree) if isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute))] if tree else []
        assert f["ast"]["function_calls"] == calls and f["ast"]["dangerous_patterns"] == [c for c in calls if c in code.DANGEROUS]


def test_entropy_of_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, "a"), (3, "ab" * 5000), (4, "😀é漢" * 3), (5, "\x00\x01"), (6, "z" * 300_000 + "y")]
    found = {r.id: r.e for r in spark.createDataFrame(rows, "id long, c string").coalesce(1).select("id", t.entropy("c").alias("e")).collect()}
    for k, x in rows:
        want = None if x is None else -sum(c / len(x) * math.log2(c / len(x)) for c in collections.Counter(x).values()) if x else 0.0
        assert found[k] is want or math.isclose(found[k], want, abs_tol=1e-9)


def test_hierarchical_chunks(spark, content):
    found = collections.defaultdict(list)
    for r in catalog.queries()["chk_02_hierarchical"](spark, DIR).collect():
        found[r.id].append(r.asDict())
    for k, x in content.items():
        tree = tree_of(x)
        tops = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if tree else []
        kinds = collections.Counter(r["chunk_type"] for r in found[k])
        if not x.strip():
            assert not found[k]
        elif tops:
            assert kinds["class"] + kinds["function"] == len(tops), k


def test_similar_hits(spark):
    from scriptloom.operators import vectors as v
    from scriptloom.plans import search

    hits = collections.defaultdict(list)
    for r in v.top_k(search._hits(spark, DIR), 10).collect():
        hits[r.query_id].append((-r.score, r.vec_id, r.code))
    want = {}
    for q, rows in hits.items():
        rows.sort(key=lambda x: x[:2])
        for i, (_, vec, x) in enumerate(rows):
            ratios = [round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for _, _, y in rows[:i]]
            if ratios:
                want[q, vec] = (max(ratios), max(ratios) >= 0.95)
    found = {(r.query_id, r.vec_id): (r.ratio, r.diversity_penalized) for r in catalog.queries()["vec_11_similar"](spark, DIR).collect()}
    assert found == want
