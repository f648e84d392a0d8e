"""Queries that need a parser, over the whole smallest table: what each kind of script must give is known from how it is made."""

import ast

import pytest

from scriptloom import catalog
from scriptloom.functions import text as t
from scriptloom.sources.samples import scripts

DIR = "/root/testdata/sf0.001"
FUNCTION = "def run(x):\n    value = eval(x)\n    return value"


@pytest.fixture(scope="module")
def content(spark):
    return {r.id: r.content for r in scripts(spark, DIR).collect()}


@pytest.fixture
def found(spark):
    def run(name):
        rows = catalog.queries()[name](spark, DIR).collect()
        out = {}
        for r in rows:
            out.setdefault(r.id, []).append(r)
        return out

    return run


def has_tree(code):
    try:
        compile(code, "script", "exec", ast.PyCF_ONLY_AST | ast.PyCF_TYPE_COMMENTS, dont_inherit=True)
    except (SyntaxError, ValueError):
        return False
    return True


def test_syntax(content, found):
    want = {k: has_tree(c) for k, c in content.items()}
    assert {want[k] for k in content if k % 6 in (0, 1, 2, 5)} == {True} and not all(want.values())
    checks, reports, feed = found("flt_17_content_checks"), found("flt_27_syntax_report"), found("src_15_code_feed")
    assert {k: r[0].syntax for k, r in checks.items()} == want == {k: r[0].valid for k, r in reports.items()}
    assert all((r[0].error is None) == want[k] for k, r in reports.items())
    valid, warned = found("flt_07_syntax"), found("flt_09_warned")
    assert all(valid[k][0].valid for k in content if want[k])
    assert {k: r[0].validation_warning for k, r in warned.items()} == {k: None if r[0].valid else "syntax_error" for k, r in valid.items()}
    assert set(feed) == {k for k, r in checks.items() if want[k] and r[0].density and len(content[k]) > 100}
    reasons = found("flt_16_file_checks")
    assert {k for k, r in reasons.items() if r[0].reason == "syntax"} == {k for k, c in content.items() if k % 6 in (0, 5) and c and checks[k][0].density and not want[k]}


def test_features(content, found):
    features, imports, functions = found("fea_05_ast"), found("fea_11_imports"), found("fea_12_security_functions")
    context, guard = found("fea_10_parent_context"), found("fea_13_main_guard")
    told = {0: ("eval", "os,base64", "eval"), 1: ("", "", ""), 2: ("get,run", "", ""), 5: ("", "", "")}
    for k, kind in ((k, k % 6) for k in content if k % 6 in told):
        f = features[k][0]
        assert (f.calls, f.imports, f.dangerous) == told[kind]
        assert imports[k][0].imports == ("import os\nimport base64" if kind == 0 else "")
        assert [(r.start, r.end, r.code) for r in functions.get(k, [])] == ([(4, 7, FUNCTION)] if kind == 0 else [])
        assert context[k][0].context == ("# Imports: os, base64 | # Definitions: def run(x...); class Store" if kind == 0 else "")
        assert guard[k][0].main == ""
    for k, c in content.items():
        if not has_tree(c):
            assert (features[k][0].calls, features[k][0].complexity_score) == ("", 0) and k not in functions
            assert context[k][0].context == " ".join(y.strip() for y in c.split("\n")[:5] if y.strip())[:500]


def test_chunks(content, found):
    chunks = found("chk_02_hierarchical")
    for k, c in content.items():
        if k % 6 == 0:
            kinds = [r.chunk_type for r in sorted(chunks[k], key=lambda r: (r.part, r.piece))]
            assert set(kinds) <= {"module", "function", "class", "sliding_window_fallback"} and kinds[-2:] == ["function", "class"]
        elif k % 6 == 5:
            assert k not in chunks
        words = len([w for w in c.split() if w])
        assert words == 0 or sum(r.token_count for r in chunks.get(k, [])) >= (0 if k % 6 == 1 else words)


def test_sizes_and_changes(spark, content, found):
    assert t.SECURITY_WORDS and all(r[0].file_size == len(content[k].encode()) and r[0].line_count == content[k].count("\n") + 1 for k, r in found("flt_16_file_checks").items())
    from scriptloom.operators import code

    rows = scripts(spark, DIR)
    for k, c, renamed, halves, bare in rows.select("id", "content", code.variables_renamed("content", "id"), code.strings_split("content"), code.licenses_removed("content")).collect():
        assert has_tree(renamed) == has_tree(c) and (k % 6 not in (1, 3, 4, 5) or renamed == c or has_tree(c))
        if k % 6 == 0:
            assert "NOTE" not in renamed and ast.dump(ast.parse(halves)).count("BinOp") >= 1
            note = ast.parse(halves).body[-1].value
            assert eval(compile(ast.Expression(note), "note", "eval"), {}) == ast.parse(c).body[-1].value.value
        if k % 6 == 2:
            assert bare == c[c.index("url =") :]
