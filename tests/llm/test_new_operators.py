"""BPE by forced boundaries, the filter audit and tokenizer alignment against brute force."""

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from scriptloom.llm import alignment, bpe, filter_audit
from tokenizers import Tokenizer

from .test_operators import CLASH, ROWS, SCHEMA, docs, none, result  # noqa: F401

ODD = ["a<|endoftext|>b <|startoftext|><|EndOfText|>", "qzxjqzxj" * 30, "</w> a</w>b", "'s't're've'm'll'd'sxz don'tx", "<s> </s> <unk> <0x41> ▁x ▁", "  two  spaces\n\n", "ｆｕｌｌ ﬁ é é İ", "日本語 한글 Жд 😀🎉"]


@pytest.fixture(scope="module")
def more(spark, docs):  # noqa: F811
    rows = [(1000 + k, t, "en", "z", len(t), *CLASH) for k, t in enumerate(ODD)] + [(1000, ODD[0], "en", "z", 1, *CLASH), (1000, "another text of that key", "de", "z", 1, *CLASH)]
    return docs.union(spark.createDataFrame(rows, SCHEMA)).repartition(4).cache()


def rows_of(df):
    return [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in df.select("doc_id", "text", "lang").collect()]


def test_bpe(more, none):  # noqa: F811
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, text, _ in rows_of(more):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((d, len(ids), struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)))
    found = bpe.decode(bpe.encode(more))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(none)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_forced_boundaries(name):
    """Random strings of all kinds of characters; the cuts are where no token has the pair."""
    r = random.Random(1)
    alphabet = "abcdezqxjvkw'’-–.,!?&%$<|>/\\_=+*#()[]{}0123456789 \n\t\r\x0b\x1c\x85\xa0 éàüßñÉÖÇ×÷İıſǅΑαдЖ漢字日本한글😀🎉́̈‍﻿"
    rows = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ODD
    e, t = bpe.ForcedEncoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    ids, n = e.many(pa.array(rows))
    ends = np.cumsum(n)
    for x, a, b in zip(rows, (ends - n).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == t.encode(x, add_special_tokens=False).ids
    inverse = {c: b for b, c in bpe.BYTE_CHARACTERS.items()}
    inside = {(inverse[a], inverse[b]) for token in t.get_vocab(with_added_tokens=False) for a, b in itertools.pairwise(token.removesuffix("</w>"))}
    assert inside == set(zip(*(x.tolist() for x in np.nonzero(~e.forced)), strict=True))
    assert e.fragments[0]


def brute_audit(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    marks = []
    for d, t, lang in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        q = labels.get(d, (0, 0)) if d is not None else (0, 0)
        marks.append((lang, {f for f in fails if fails[f]}, q[0] == 1, q[1] == 1))
    out = []
    for part in {m[0] for m in marks}:
        mine = [m for m in marks if m[0] == part]
        shapley, rows = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before, here = set(order[:step]), [m for m in mine if f in m[1] and not m[1] & set(order[:step])]
                shapley[f] += len(here)
                rows.append((part, "".join(order), step + 1, sum(not m[1] & (before | {f}) for m in mine), len(here), sum(f in m[1] and bool(m[1] & before) for m in mine), sum(m[1] == {f} for m in mine), sum(m[2] for m in here), sum(m[3] for m in here), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("bits", [None, 2])
def test_filter_audit(spark, more, none, monkeypatch, bits):  # noqa: F811
    """Also with a sketch so small that every text may repeat."""
    if bits:
        monkeypatch.setattr(filter_audit, "MOST_BITS", bits)
    labels = {k: (k % 2, k % 3 == 0) for k in range(0, 60, 2)} | {1000: (1, 1)}
    table = spark.createDataFrame([(k, int(q), int(x), "x") for k, (q, x) in labels.items()] + [(None, 1, 1, "x"), (4, None, None, "x")], "doc_id long, quality int, toxic int, mask string")
    assert result(filter_audit.filter_audit(more, table), *AUDIT) == sorted(brute_audit(rows_of(more), labels), key=repr)
    assert filter_audit.filter_audit(none, table).count() == 0


def test_sketch_clears_only_what_stands_once(spark):
    r = random.Random(5)
    values = [r.getrandbits(63) for _ in range(4000)]
    values += values[:300]
    table = filter_audit.sketch(spark.createDataFrame([(v,) for v in values], "h long").repartition(5), 16)
    again = filter_audit.may_repeat(np.array(values), table)
    assert again[:300].all() and again[4000:].all()
    assert again[300:4000].mean() < 0.02


def brute_alignment(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    inverse = {c: b for b, c in bpe.BYTE_CHARACTERS.items()}
    links, per = Counter(), []
    for d, text, _ in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        a_bytes = [bytes(inverse[c] for c in t.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if s.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, s.id_to_piece(x)) for x in b)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            per.append((d, [], [], [], []))
            continue
        spans = [list(zip(ids, itertools.pairwise([0, *itertools.accumulate(map(len, raw))]), strict=True)) for ids, raw in ((a, a_bytes), (b, b_bytes))]
        mine = [(x, y) for x, (lo, hi) in spans[0] for y, (lo2, hi2) in spans[1] if max(lo, lo2) < min(hi, hi2)] if len(a) < 3000 else near_links(spans)
        links.update(mine)
        cuts = sorted({e for _, (_, e) in spans[0]} & {e for _, (_, e) in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append([",".join(str(x) for x, (lo, hi) in side if start <= lo and hi <= c) for side in spans] if len(a) < 3000 else None)
            start = c
        per.append((d, a, b, groups, mine))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for d, a, b, groups, mine in per:
        text = None if None in groups else ";".join("|".join(g) for g in groups)
        out.append((d, len(a), len(b), len(groups), len(mine), sum(links[p] == best[p[1]] for p in mine), sum(links[p] for p in mine), "" if not a else text and hashlib.sha256(text.encode()).hexdigest()))
    return out


def near_links(spans):
    out, k = [], 0
    for x, (lo, hi) in spans[0]:
        while spans[1][k][1][1] <= lo:
            k += 1
        j = k
        while j < len(spans[1]) and spans[1][j][1][0] < hi:
            out.append((x, spans[1][j][0]))
            j += 1
    return out


def test_alignment(more, none, monkeypatch):  # noqa: F811
    rows = [r for r in rows_of(more)]
    want = sorted(brute_alignment(rows), key=repr)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for size in (alignment.CHUNK, 200):
        monkeypatch.setattr(alignment, "CHUNK", size)
        found = result(alignment.align(more), *columns)
        assert [r[:-1] for r in found] == [r[:-1] for r in want]
        assert all(w[-1] is None or f[-1] == w[-1] for f, w in zip(found, want, strict=True))
    assert alignment.align(none).count() == 0
