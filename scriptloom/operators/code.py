"""What needs a Python parser or archive reader: Arrow-batched functions over native columns. Filter natively first."""

from __future__ import annotations

import ast
import difflib
import io
import re
import tarfile
import warnings
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Calls that count as dangerous, and names that are never renamed.
DANGEROUS = {"eval", "exec", "compile", "__import__", "system", "popen", "spawn", "call", "loads", "load", "decode"}
KEPT_NAMES = {"print", "len", "range", "str", "int", "list", "dict", "open", "exec", "eval"}


# Types as objects: workers import this module, and only a session can parse type strings.
_KINDS = {"int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[v] if isinstance(v, str) else v) for k, v in fields.items()])


_STRINGS = T.ArrayType(T.StringType())
_REPORT = _struct(valid="boolean", error="string", line="int", offset="int")
_TREE = _struct(function_calls=_STRINGS, imports=_STRINGS, dangerous_patterns=_STRINGS, node_counts=T.MapType(T.StringType(), T.IntegerType()), complexity_score="int")
_FUNCTIONS = T.ArrayType(_struct(code="string", start="int", end="int"))
_PARTS = T.ArrayType(_struct(chunk_type="string", function_name="string", line_start="int", line_end="int", content="string"))
_MEMBERS = T.ArrayType(_struct(name="string", content="string"))


def parse(code: str | None) -> ast.Module | None:
    """The syntax tree; None where there is none (syntax errors, NUL characters, nesting too deep)."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    return code.map(lambda x: parse(x) is not None).astype(bool)


def valid_syntax(c: Column, python2: bool = True) -> Column:
    """Python 3, or what looks like Python 2."""
    old = F.lit(False)
    if python2:
        for p in t.PYTHON2:
            old = old | c.rlike(p)
    return parses(c) | old


@F.pandas_udf(_REPORT)
def syntax_report(code: pd.Series) -> pd.DataFrame:
    def one(x: str | None) -> tuple:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(x or "")
            return True, None, None, None
        except SyntaxError as e:
            return False, e.msg, e.lineno, e.offset
        except (ValueError, RecursionError, MemoryError) as e:
            return False, str(e), None, None

    return pd.DataFrame([one(x) for x in code], columns=["valid", "error", "line", "offset"])


def tree_features(code: str | None) -> dict:
    out = {"function_calls": [], "imports": [], "dangerous_patterns": [], "node_counts": {}, "complexity_score": 0}
    if (tree := parse(code)) is None:
        return out
    counts: Counter = Counter()
    for node in ast.walk(tree):
        counts[type(node).__name__] += 1
        match node:
            case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
                out["function_calls"].append(name)
            case ast.Import(names=names):
                out["imports"] += [n.name for n in names]
            case ast.ImportFrom(module=module, names=names):
                out["imports"] += [f"{module or ''}.{n.name}" for n in names]
    out["dangerous_patterns"] = [n for n in out["function_calls"] if n in DANGEROUS]
    return out | {"node_counts": dict(counts), "complexity_score": len(counts)}


@F.pandas_udf(_TREE)
def ast_features(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tree_features(x) for x in code], columns=["function_calls", "imports", "dangerous_patterns", "node_counts", "complexity_score"])


def source_lines(code: str, first: int, last: int) -> str:
    return "\n".join(code.split("\n")[first:last])


def imports_of(code: str, tree: ast.Module | None) -> str:
    if tree is None:
        return "\n".join(re.findall(r"(?m)^(?:from\s+\S+\s+)?import\s+.+$", code))
    return "\n".join(source_lines(code, n.lineno - 1, n.lineno) for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)))


def functions_of(code: str, tree: ast.Module | None) -> list[dict]:
    """Functions with a security word: their source and line range (from 0, end excluded)."""
    found = [(source_lines(code, n.lineno - 1, n.end_lineno), n.lineno - 1, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)] if tree else []
    return [{"code": c, "start": a, "end": b} for c, a, b in found if any(w in c for w in t.SECURITY_WORDS)]


@F.pandas_udf(T.StringType())
def import_lines(code: pd.Series) -> pd.Series:
    """Lines of import statements, in the tree's order; by pattern where there is no tree."""
    return code.map(lambda x: imports_of(x or "", parse(x)))


@F.pandas_udf(_FUNCTIONS)
def security_functions(code: pd.Series) -> pd.Series:
    return code.map(lambda x: functions_of(x or "", parse(x)))


@F.pandas_udf(T.StringType())
def main_guard(code: pd.Series) -> pd.Series:
    """The block under a comparison of __name__, else what follows one by pattern, else the empty text."""

    def one(x: str | None) -> str:
        x = x or ""
        for n in ast.walk(parse(x) or ast.Module([], [])):
            match n:
                case ast.If(test=ast.Compare(left=ast.Name(id="__name__"))):
                    return source_lines(x, n.lineno - 1, n.end_lineno)
        m = re.search(r"(?s)if\s+__name__\s*==\s*[\"']__main__[\"']\s*:.*", x)
        return m[0] if m else ""

    return code.map(one)


@F.pandas_udf(T.StringType())
def parent_context(code: pd.Series) -> pd.Series:
    """Docstring, imports and signatures of a module in at most 500 characters; the first lines where there is no tree."""

    def one(x: str | None) -> str:
        x = x or ""
        if (tree := parse(x)) is None:
            return " ".join(y.strip() for y in x.split("\n")[:5] if y.strip())[:500]
        doc, mods, signs = ast.get_docstring(tree), [], []
        for n in ast.walk(tree):
            match n:
                case ast.Import(names=names):
                    mods += [a.name for a in names]
                case ast.ImportFrom(module=str(module)):
                    mods.append(module)
        for n in tree.body:
            match n:
                case ast.FunctionDef(name=name):
                    signs.append(f"def {name}({', '.join(a.arg for a in n.args.args[:3])}...)")
                case ast.ClassDef(name=name):
                    signs.append(f"class {name}")
        parts = [f"# Module: {doc[:200]}" if doc else "", f"# Imports: {', '.join(mods[:10])}" if mods else "", f"# Definitions: {'; '.join(signs[:5])}" if signs else ""]
        return " | ".join(p for p in parts if p)[:500]

    return code.map(one)


@F.pandas_udf(T.StringType())
def variables_renamed(code: pd.Series, id: pd.Series) -> pd.Series:
    """Variables get numbered names that depend on the row's id and their order; texts without a tree stay."""

    def one(x: str | None, seed: int) -> str | None:
        if not x or (tree := parse(x)) is None:
            return x
        names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - KEPT_NAMES)
        new = {n: f"var_{1000 + (int(seed or 0) * 31 + 7 * k) % 9000}" for k, n in enumerate(names)}
        return re.sub(rf"\b({'|'.join(map(re.escape, names))})\b", lambda m: new[m[0]], x) if names else x

    return pd.Series([one(x, s) for x, s in zip(code, id.fillna(0), strict=True)])


@F.pandas_udf(T.StringType())
def strings_split(code: pd.Series) -> pd.Series:
    """Quoted strings of more than four characters as the sum of their halves."""

    def halves(q: str):
        return lambda m: f"{q}{m[1][: len(m[1]) // 2]}{q} + {q}{m[1][len(m[1]) // 2 :]}{q}" if len(m[1]) > 4 else m[0]

    return code.map(lambda x: re.sub(r'"([^"]{4,})"', halves('"'), re.sub(r"'([^']{4,})'", halves("'"), x)) if x else x)


@F.pandas_udf(T.StringType())
def licenses_removed(code: pd.Series) -> pd.Series:
    """Without comment lines and leading docstrings that tell a license or copyright (ten of each pattern at most), and
    without a docstring block at the beginning; a block is closed by a later line than the one that opens it."""
    patterns = [re.compile(rf"^\s*#.*?{w}.*?\n", re.I | re.M) for w in ("copyright", "license")] + [re.compile(rf'^\s*""".*?{w}.*?"""', re.I | re.S) for w in ("copyright", "license")]

    def one(x: str | None) -> str | None:
        if not x:
            return x
        for p in patterns:
            x = p.sub("", x, count=10)
        rows = x.split("\n")
        start = next((k for k, r in enumerate(rows) if r.strip() and not r.strip().startswith("#")), None)
        if start is not None and rows[start].strip().startswith(('"""', "'''")):
            end = next((k for k in range(start + 1, len(rows)) if '"""' in rows[k] or "'''" in rows[k]), None)
            if end is not None:
                rows = rows[:start] + rows[end + 1 :]
        return "\n".join(rows)

    return code.map(one)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(_PARTS)
def definitions(code: pd.Series) -> pd.Series:
    """The module's rest, then each top-level function and class, by lines; empty where there is no tree."""

    def one(x: str | None) -> list[dict]:
        if not x or (tree := parse(x)) is None:
            return []
        found = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        taken = {k for n in found for k in range(n.lineno, n.end_lineno + 1)}
        rest = "\n".join(line for k, line in enumerate(x.split("\n"), 1) if k not in taken).strip()
        rows = [("module", None, 1, None, rest)] if rest else []
        rows += [("class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno, source_lines(x, n.lineno - 1, n.end_lineno)) for n in found]
        return [dict(zip(("chunk_type", "function_name", "line_start", "line_end", "content"), r, strict=True)) for r in rows]

    return code.map(one)


def hierarchical(rows: DataFrame, *, most: int = 512, size: int = 128, overlap: int = 16) -> DataFrame:
    """A chunk for each top-level definition and the module's rest; definitions of more than `most` tokens and texts without
    a tree go by sliding windows."""
    from .chunking import sliding, tokens

    parts = rows.filter(t.strip(F.col("content")) != "").withColumn("_d", definitions("content"))
    keep = [c for c in rows.columns if c != "content"]
    each = parts.filter(F.size("_d") > 0).select(*keep, F.posexplode("_d").alias("part", "_p")).select(*keep, "part", "_p.*").withColumn("token_count", F.size(tokens(F.col("content"))))
    fits = each.filter(F.col("token_count") <= most).withColumn("piece", F.lit(0))
    long = sliding(each.filter(F.col("token_count") > most).drop("token_count"), size, overlap).withColumn("chunk_type", F.lit("sliding_window_fallback")).withColumnRenamed("chunk_index", "piece")
    none = sliding(parts.filter(F.size("_d") == 0).drop("_d"), size, overlap).withColumnRenamed("chunk_index", "piece").withColumn("part", F.lit(0))
    columns = [*keep, "part", "piece", "chunk_type", "content", "token_count"]
    return fits.select(*columns).unionByName(long.select(*columns)).unionByName(none.select(*columns)).withColumn("chunk_id", t.chunk_id(F.col("content"), F.col("part") * 1000 + F.col("piece")))


# Suffixes of members that are taken from archives, passwords that are tried on encrypted ones, and
# suffixes of archives.
MEMBER_SUFFIXES = (".py", ".ps1", ".js", ".vbs", ".bat", ".sh", ".cmd")
PASSWORDS = (b"infected", b"malware", b"virus", b"password", b"")
ARCHIVE_SUFFIXES = (".zip", ".tar", ".gz", ".7z", ".rar")


def _opened(z: zipfile.ZipFile, i: zipfile.ZipInfo) -> bytes:
    """A member's bytes; empty if none of the passwords fits (AES is not supported)."""
    if not i.flag_bits & 1:
        return z.read(i)
    for p in PASSWORDS:
        try:
            return z.read(i, p or None)
        except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error):
            continue
    return b""


def members(raw: bytes | None) -> list[dict]:
    """(name, text) of the script files in a ZIP or tar archive, of any size: text of more than 50 characters without NUL."""
    found: list[tuple[str, bytes]] = []
    try:
        if raw and zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                found = [(i.filename, _opened(z, i)) for i in z.infolist() if not i.is_dir()]
        elif raw:
            with tarfile.open(fileobj=io.BytesIO(raw)) as z:
                found = [(i.name, z.extractfile(i).read()) for i in z if i.isfile()]
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, RuntimeError):
        return []
    texts = [(n, b.decode("utf-8", "ignore")) for n, b in found if n.lower().endswith(MEMBER_SUFFIXES)]
    return [{"name": n, "content": c} for n, c in texts if len(c) > 50 and "\0" not in c]


@F.pandas_udf(T.BinaryType())
def first_member(raw: pd.Series) -> pd.Series:
    """The bytes of the first file of a ZIP archive that can be read, with a known password or none; null if there is none."""

    def one(x: bytes | None) -> bytes | None:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(x or b""))) as z:
                for i in z.infolist():
                    data = b"" if i.is_dir() else _opened(z, i)
                    if data or not (i.is_dir() or i.file_size):
                        return data
        except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError):
            pass
        return None

    return raw.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def package_files(raw: pd.Series, most: pd.Series) -> pd.Series:
    """The texts of an archive's first `most` Python files (tar, else ZIP) that have more than 100 characters without outer
    blanks; none if it can't be read."""

    def one(x: bytes | None, n: int) -> list[str]:
        data = bytes(x or b"")
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as z:
                files = [z.extractfile(i).read() for i in [m for m in z.getmembers() if m.isfile() and m.name.endswith(".py")][:n]]
        except tarfile.ReadError:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    files = [z.read(i) for i in [m for m in z.namelist() if m.endswith(".py")][:n]]
            except (zipfile.BadZipFile, EOFError, OSError, RuntimeError):
                return []
        except (tarfile.TarError, EOFError, OSError):
            return []
        return [c for c in (f.decode("utf-8", "ignore") for f in files) if len(c.strip()) > 100]

    return pd.Series([one(*r) for r in zip(raw, most, strict=True)])


@F.pandas_udf(_MEMBERS)
def archive_members(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: members(bytes(x)) if x is not None else [])


@F.pandas_udf(_MEMBERS)
def downloads(name: pd.Series, raw: pd.Series) -> pd.Series:
    """The scripts (name, text) in a downloaded file of 50 bytes or more: an archive's script members, none if an archive
    has none, else the file itself if its text has more than 50 characters and no NUL. Bytes that aren't UTF-8 are left out."""

    def one(n: str | None, x: bytes | None) -> list[dict]:
        if x is None or len(x) < 50:
            return []
        x, n = bytes(x), n or ""
        if found := members(x):
            return found
        text = "" if n.lower().endswith(ARCHIVE_SUFFIXES) else x.decode("utf-8", "ignore")
        return [{"name": n, "content": text}] if len(text) > 50 and "\0" not in text else []

    return pd.Series([one(*r) for r in zip(name, raw, strict=True)])


# Shares of the whole for the end, of the head for imports and for all parts before the body, the room that
# marks take, the least body, and the headings.
END_SHARE, IMPORTS_SHARE, PARTS_SHARE, MARKS, LEAST_BODY = 0.3, 0.3, 0.7, 100, 200
HEADINGS = {"imports": "# Imports", "function": "# Security Function", "body": "# Code Body"}
MIDDLE, ENDING = "\n# ... [TRUNCATED] ...\n", "# End of file (Payloads often here)"


def cut_smartly(x: str | None, most: int) -> str | None:
    """A text longer than `most` by its telling parts, from one parse: candidates are ranked, their running lengths say which
    of them fit before the body, and the end always stays."""
    if not x or len(x) <= most:
        return x
    end = x[-int(most * END_SHARE) :]
    head, tree = most - len(end), parse(x)
    imports = imports_of(x, tree)
    first = [("imports", imports)] if 0 < len(imports) < head * IMPORTS_SHARE else []
    ranked = first + [("function", f["code"]) for f in functions_of(x, tree)]
    running = np.cumsum([len(part) for _, part in ranked])
    fits = [k < len(first) or total < head * PARTS_SHARE for k, total in enumerate(running)]
    n = (fits + [False]).index(False)
    room = head - (int(running[n - 1]) if n else 0) - MARKS
    chosen = ranked[:n] + ([("body", x[:room])] if room > LEAST_BODY else [])
    out = "\n".join([line for kind, part in chosen for line in (HEADINGS[kind], part)] + [MIDDLE, ENDING, end])
    if len(out) <= most:
        return out
    side = most // 2 - MARKS // 2
    return f"{x[:side]}\n\n# ... [Truncated {len(x) - most} chars] ...\n\n{x[-side:]}"


@F.pandas_udf(T.StringType())
def smart_cut(code: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([cut_smartly(*r) for r in zip(code, most, strict=True)])
