"""The training-data operators against brute force, on a small table with every odd case: nulls, empty and long texts,
ties, repeated rows, and extra columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from scriptloom.llm import anchors, common, exact_dedup, jaccard_join, langid, license_scan, media, mixing, packing, substring_dedup, suffix_dedup, token_output
from scriptloom.llm.tokens import PieceEncoder
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part long, owner long, places string, score double, slot long, rep long, root long, h string, s string, recipe string, deal long, class long"


def texts():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = make(60), make(20)
    out = [make(r.randint(30, 200)) for _ in range(20)]
    out += [out[0], out[0], out[1]]
    for k in (2, 3, 4):  # near copies
        for _ in range(4):
            w = out[k].split(" ")
            w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
            out.append(" ".join(w))
    out += [make(10) + " " + passage + " " + make(10) for _ in range(3)] + [passage + "\n" + line + "\n" + line + "\n" + line]
    out += [None, "", "   \n\t ", "one", "one two", "One Two", "a b c", "a  b\n\nc", "É à ü 😀 ñ", "12345 678", make(4000), "x" * 5000, "ab" * 1000]
    out += ["GNU General Public License, and the mit\nlicense.", "Apache Licence 2.0", "GNU Genral Public License", "cc by cc by", "MIT   License CC-BY"]
    out += ["<|endoftext|> special <|endoftext|>", "tab\tand  spaces \n", "don't you're it's ###!!! 1,234.5"]
    return out


TEXTS = texts()
ROWS = [(k, t, ("en", "de", None)[k % 3], ("a", "a", "b", "c", None)[k % 5], len(t or "")) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[5], (None, "a row without a key", "en", "a", 19), (None, None, None, None, None)]
CLASH = (1, 2, "x", 0.5, 3, 4, 5, "h", "s", "r", 6, 7)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def result(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


KEYED = [(d, t or "") for d, t, *_ in ROWS]


def test_exact(docs, none):
    groups = {}
    for d, t in KEYED:
        groups.setdefault(t, []).append(d)
    want = []
    for d, t in KEYED:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    for identify in (exact_dedup.chunk_id, lambda c: exact_dedup.F.lit("same")):  # all identifiers collide: whole texts are compared
        assert result(exact_dedup.exact_dedup(docs, identify=identify), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_components(rows, n, per_cent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), d) if x is not None], default=None)
    return [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("n,per_cent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(docs, none, n, per_cent):
    keyed = docs.filter("doc_id is not null")
    want = brute_components([(d, t) for d, t in KEYED if d is not None], n, per_cent)
    assert result(jaccard_join.jaccard_join(keyed, words=n, per_cent=per_cent), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert jaccard_join.jaccard_join(none).count() == 0
    assert jaccard_join.jaccard_join(docs, words=n, per_cent=per_cent).count() == len(ROWS)


def odd_keys():
    """Documents that only a row without a key connects, and two texts of one key with a near copy each."""
    w = [f"word{i}" for i in range(60)]
    rows = [(50, w[:10]), (None, w[3:13]), (51, w[6:16]), (60, w[20:30]), (60, w[40:50]), (61, w[20:31]), (62, w[40:51]), (None, w[52:56]), (None, w[52:57])]
    return [(d, " ".join(t)) for d, t in rows]


def test_jaccard_of_null_and_repeated_keys(spark, docs):
    rows = [(d, t) for d, t in KEYED] + odd_keys()
    want = brute_components(rows, 1, 50)
    found = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=1, per_cent=50)
    assert result(found, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_jaccard_in_blocks(docs, monkeypatch):
    """Families are tied and clusters cut into blocks: the same components."""
    want = brute_components([(d, t) for d, t in KEYED if d is not None], 3, 80)
    monkeypatch.setattr(jaccard_join, "PAIRS_UP_TO", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(common, "BLOOM_KEYS", 0)
    assert result(jaccard_join.jaccard_join(docs.filter("doc_id is not null"), words=3, per_cent=80), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in up)
    assert result(common.components(spark.createDataFrame(edges, "a long, b long")), "id", "root") == sorted(want, key=repr)


def removed(flags):
    return sum(flags), sum(1 for a, b in zip([False, *flags], flags, strict=False) if b and not a)


def covered(raw, width):
    """For each string, which of its bytes lie in a string of `width` bytes that also starts elsewhere."""
    n = Counter(x[i : i + width] for x in raw for i in range(len(x) - width + 1))
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - width + 1):
            if n[x[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        yield gone


@pytest.mark.parametrize("width,reported", [(400, 256), (40, 40), (60, 21)])
def test_suffixes(docs, none, width, reported):
    raw = [t.encode() for _, t in KEYED]
    want = []
    for (d, _), x, gone, part in zip(KEYED, raw, covered(raw, width), covered(raw, reported), strict=True):
        want.append((d, len(x), *removed(gone), hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest(), sum(part)))
    assert result(suffix_dedup.suffix_dedup(docs, width=width, reported=reported), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated") == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_texts_whose_polynomial_hashes_agree(spark, monkeypatch):
    """Thue-Morse texts agree in every polynomial hash with an odd base; and ids that clash are made anew."""
    bit = [bin(i).count("1") & 1 for i in range(1 << 11)]
    texts = ["".join("ab"[b] for b in bit), "".join("ab"[1 - b] for b in bit), "short", "other"]
    raw = [t.encode() for t in texts]
    want = [(k, sum(gone)) for k, gone in enumerate(covered(raw, 1200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert result(suffix_dedup.suffix_dedup(docs, width=1200), "doc_id", "n_removed") == sorted(want, key=repr)
    whole = suffix_dedup.text_ids

    def clashing(data, offsets, salt=0):
        ids = whole(data, offsets, salt).copy()
        ids[:, 0] = ids[:, 0] if salt else 1
        return ids

    monkeypatch.setattr(suffix_dedup, "text_ids", clashing)
    assert result(suffix_dedup.suffix_dedup(docs, width=1200), "doc_id", "n_removed") == sorted(want, key=repr)


def test_anchors_of_long_texts(monkeypatch):
    """Beyond the places that one stretch can number, anchors are still found where they are."""
    r = np.random.default_rng(3)
    whole = r.integers(0, 1 << 63, (1 << 24) + 1000).astype(np.uint64)
    whole[-300:] = whole[100:400]
    at = anchors.least_in_windows(whole, 200)
    assert len(at) == len(whole) - 199 and (at[-101:] - (len(whole) - 300)).tolist() == (at[100:201] - 100).tolist()
    monkeypatch.setattr(anchors, "_PLACE_BITS", 6)
    for n in (7, 63, 64, 65, 121, 122, 123, 1000):
        h = r.integers(0, 50, n).astype(np.uint64)
        order = common.mixed(h, 40)
        assert anchors.least_in_windows(h, 7).tolist() == [i + int(np.argmin(order[i : i + 7])) for i in range(n - 6)]


def test_suffix_sort():
    r = random.Random(5)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(300)]
    group = np.sort(np.array([r.randrange(20) for _ in strings]))
    s = suffix_dedup.Strings(strings)
    order, agree = s.neighbours(group)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        mine = [strings[k] for k in order[at]]
        assert mine == sorted(strings[k] for k in at)
        assert agree[at[0]] == -1
    s.prefix[:] = 0  # every hash agrees: verification must find out
    order, agree = s.neighbours(group)
    for g in set(group.tolist()):
        at = np.flatnonzero(group == g)
        assert [strings[k] for k in order[at]] == sorted(strings[k] for k in at)


def test_phrases(docs, none):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in KEYED]
    least = {}
    for d, w in words:
        for i in range(len(w) - 12 if d is not None else 0):
            x = tuple(w[i : i + 13])
            least[x] = min(least.get(x, d), d)
    want = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12 if d is not None else 0):
            if least[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert result(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    kept = {r.kept_sha256: r.kept_text for r in substring_dedup.substring_dedup(docs).collect()}
    assert all(hashlib.sha256(x.encode()).hexdigest() == h for h, x in kept.items())
    short = substring_dedup.substring_dedup(docs, with_kept=False)
    assert short.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and result(short, *short.columns) == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_phrases_around_one_anchor(spark, monkeypatch):
    """An anchor that very many documents have, in differing surroundings, is no shard of its own."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    grams = [[word() for _ in range(4)] for _ in range(3000)]
    data, offsets = common.texts(pa.array([" ".join(g) for g in grams]))
    start, end, first = common.words_of(data, offsets, substring_dedup._SPACE)
    hashes = substring_dedup.gram_hashes(common.word_hashes(data, start, end))[first[:-1]]
    gram = grams[int(np.argmin(common.mixed(hashes, 40)))]
    rows = [(k, [word() for _ in range(9)] + gram + [word() for _ in range(9)]) for k in range(300)]
    rows += [(k + 1000, w[:2] + [word()] + w[3:] if k % 2 else w[:12] + [word()]) for k, w in rows[:20]]
    least = {}
    for d, w in rows:
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, w in rows:
        gone = {i + j for i in range(len(w) - 12) for j in range(13) if least[tuple(w[i : i + 13])] < d}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sum(n for _, _, n, _ in want)
    whole = substring_dedup.occurrences

    def bounded(frags, of, owner, width):
        assert len(frags) < 100
        return whole(frags, of, owner, width)

    monkeypatch.setattr(substring_dedup, "SHARD_FRAGMENTS", 20)
    monkeypatch.setattr(substring_dedup, "occurrences", bounded)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    assert result(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)


def test_more_words_than_characters():
    n = 1_100_100 // 13 + 1
    line = [" ".join(f"{13 * k + i:x}" for i in range(13)) for k in range(n)]
    line.append(f"{line[5]} more {line[7]}")
    where, at = substring_dedup.occurrences(pa.array([x.encode() for x in line]), np.append(np.arange(n + 1), 9), np.append(np.arange(n + 1), n + 5), 13)
    assert sorted(zip(where.tolist(), at.tolist(), strict=True)) == [(n, 0), (n, 14), (n + 1, 0)]


def test_licenses(docs, none):
    want = []
    for d, t in KEYED:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    found = license_scan.license_scan(docs)
    assert result(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r.doc_id: r for r in found.collect()}
    by_text = {t: labels[d] for d, t, *_ in ROWS if t}
    assert by_text["Apache Licence 2.0"].labels == "apache" and by_text["Apache Licence 2.0"].n_base == 0
    assert by_text["GNU Genral Public License"].labels == "gpl" and by_text["GNU Genral Public License"].spans[0].edits == 1
    assert all(0 <= r.score <= 1 for r in labels.values())
    assert license_scan.license_scan(none).count() == 0


@pytest.mark.parametrize("text", ["apache licensees", "gnu general public licenseabcdef", "mit licensexyz", "a bsd licenseqq", "xapache license", "mit license" + "z" * 500])
def test_notices_end_with_words(text):
    fuzzy = [license_scan.Phrase(p, label) for p, label in (license_scan.BASE_PHRASES | license_scan.MORE_PHRASES).items()]
    *_, spans = license_scan.scan_text(text, fuzzy)
    whole = license_scan.normalised(text)
    assert all(whole[s["end"] : s["end"] + 1] in (b"", b" ") and (not s["start"] or whole[s["start"] - 1 : s["start"]] == b" ") for s in spans)


@settings(max_examples=60, deadline=None)
@given(st.text("gnuapchelmits rb", max_size=60), st.sampled_from(list(license_scan.BASE_PHRASES)), st.integers(0, 3))
def test_seeds_lose_nothing(noise, phrase, cut):
    """Wherever the whole text has a match with so few edits, the seeds find one too."""
    text = license_scan.normalised(noise[: len(noise) // 2] + " " + phrase[:cut] + phrase[cut + 1 :] + " " + noise[len(noise) // 2 :])
    p = license_scan.Phrase(phrase, "x")
    whole = regex.search(rf"(?<![^ ])(?:{regex.escape(phrase)}){{e<={p.edits}}}(?![^ ])".encode(), text)
    assert bool(p.found(text)) == bool(whole and whole.end() > whole.start())


@pytest.mark.parametrize("weights,power", [(None, 0.5), (None, 1.0), ({"a": 0.7, "b": 0.2, "c": 0.1}, 1.0)])
def test_mixing(spark, docs, none, weights, power):
    many = docs.select("doc_id", "source").union(spark.range(1000, 1400).selectExpr("id", "substr('aaabbc', cast(id % 6 as int) + 1, 1)"))
    rows = mixing.mix(many, weights=weights, power=power, block=4, resolution=100).collect()
    assert sorted(r.position for r in rows) == list(range(many.count()))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault((r.source, r.block), r.slot)
    assert len(set(slots.values())) == len(slots)
    order = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in rows)
    # while all sources last, each has had its share to within one block
    last = min(max(s for (src, _), s in slots.items() if src == name) for name in {r.source for r in rows})
    period = {}
    for r in rows:
        period[r.source] = max(period.get(r.source, Fraction(0)), Fraction(r.block, r.deadline))
    for name, share in period.items():
        for t in range(0, last, 7):
            had = sum(1 for (src, _), s in slots.items() if src == name and s < t)
            assert abs(had - share * t) < 1
    assert mixing.mix(none).count() == 0


def test_one_document(spark):
    assert mixing.mix(spark.createDataFrame([(1, "x")], "doc_id long, source string")).first().position == 0


def ids_of(path, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(path))
    return t.encode(text, add_special_tokens=False).ids + [end]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_token_files(docs, none):
    start, want = 0, []
    for d, t, *_ in by_key(ROWS):
        ids = ids_of("word_bpe_49k.json", t or "", 2)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    blocks = token_output.write_tokens(docs)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_output.read_tokens(blocks).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_output.read_tokens(token_output.write_tokens(none)).count() == 0
    block = bytearray(blocks.filter("n > 0").first().data)
    block[-3] ^= 1
    with pytest.raises(ValueError):
        token_output.from_block(bytes(block))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 65535)), min_size=1, max_size=3000))
def test_coder(ids):
    lanes, data = token_output.encode_ids(np.array(ids))
    assert token_output.decode_ids(len(ids), lanes, data).tolist() == ids


def test_coder_learns():
    """A cycle costs next to nothing beyond what lanes need to start and end; real ids cost less than by their frequency."""
    ids = np.tile(np.arange(50), 20_000)
    assert len(token_output.encode_ids(ids)[1]) * 8 < 0.4 * len(ids)
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, _ = PieceEncoder(public_tokenizers.path("word_bpe_49k.json")).with_end(texts, 2)
    n = np.bincount(ids)
    n = n[n > 0]
    assert len(token_output.encode_ids(ids)[1]) * 8 < -(n * np.log2(n / len(ids))).sum() - 0.4 * len(ids)
    with pytest.raises(ValueError):
        token_output.encode_ids(np.array([1 << 16]))


def test_packing(docs, none):
    rows = packing.pack(docs, length=128).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        assert 0 < r.length <= 128 and r.offset + r.length <= 128 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    line = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in line:  # gapless
        assert r.sequence_id * 128 + r.offset == at
        at += r.length
    want = [i for _, t, *_ in by_key(ROWS) for i in ids_of("byte_bpe_50k.json", t or "", 1)]
    assert np.frombuffer(b"".join(bytes(r.ids) for r in line), "<u4").tolist() == want
    assert packing.pack(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.,'Éß")), max_size=60))
@pytest.mark.parametrize("path", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces(path, text):
    e = ENCODERS.setdefault(path, PieceEncoder(public_tokenizers.path(path)))
    ids, n = e.many(pa.array([text, None, "", text + "İ, x."]))
    whole = [Tokenizer.from_file(public_tokenizers.path(path)) if path not in WHOLE else WHOLE[path]][0]
    WHOLE[path] = whole
    want = [whole.encode(t, add_special_tokens=False).ids for t in (text, "", "", text + "İ, x.")]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("path", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_pieces(path):
    """As the library encodes whole texts: special strings, letters whose lower case is longer, odd spaces and marks."""
    r, whole = random.Random(5), Tokenizer.from_file(public_tokenizers.path(path))
    parts = ["a", "B", "the", "Kedİ", "İ", "ß", "ŉ", "é", "E\u0301", "\u0307", "=\u0338", "'s", "'LL", "1", "²", ",", ".", "!?", " ", "  ", "\n", "\t", "\r", "\u00a0", "\u200b", "中文", "Σ", "😀", "×", "ɏ", "ɐ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + ["kedİ, köpek", "İZMİRİ, bir"]
    ids, n = PieceEncoder(public_tokenizers.path(path)).many(pa.array(texts))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


ENCODERS, WHOLE = {}, {}


def test_languages(spark, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = langid.held_out()
    counts = langid.learn(rows.filter(~fold))
    out = langid.identify(rows.select("doc_id", "text", "lang", fold.alias("held_out")), counts, keep=["doc_id", "lang", "held_out"]).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out} == {True}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "le de la que les des dans")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, counts, keep=["doc_id"]).collect()} | {4: 0} == {1: "und", 2: "und", 3: "und", 4: 0}
    assert langid.identify(odd, [], keep=["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert langid.learn(none) == [] and langid.identify(none, counts, keep=["doc_id"]).count() == 0


def test_mixtures(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = langid.learn(rows)
    pick = {r.lang: r.text for r in rows.filter("length(text) between 2000 and 4000").collect()}
    both = spark.createDataFrame([(1, pick["en"][:1500] + " " + pick["de"][:1500])], "doc_id long, text string")
    r = langid.identify(both, counts, keep=["doc_id"]).first()
    assert r.n_langs == 2 and r.lang_pred in ("en", "de") and 0.3 < r.score < 0.7


def plain_language(text, langs, p):
    """(language, score, size of the set) by the plain definition, in loops and double precision."""
    low = [32, *(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()), 32]
    grams = Counter(((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17 for a, b, c in zip(low, low[1:], low[2:]) if b != 32)
    if not grams:
        return "und", 0.0, 0
    n, like = np.array(list(grams.values()), float), p[list(grams)].astype(float)

    def fit(members):
        share = np.array([1 / len(members) if k in members else 0.0 for k in range(len(langs))])
        for _ in range(langid.ROUNDS):
            mine = like * share
            share = (mine / mine.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        return share, float(n @ np.log(like @ share))

    share, best = fit(range(len(langs)))
    order = sorted(range(len(langs)), key=lambda k: (-share[k], k))
    cost, value, size, top = langid.PENALTY * math.log(n.sum() + 1), float(n @ np.log(like[:, order[0]])), 1, None
    while size < len(langs) and best - value > cost:
        now, more = fit(order[: size + 1])
        if more - value <= cost:
            break
        value, size, top = more, size + 1, int(now.argmax())
    if top is None:
        top = int((n @ np.log(like)).argmax())
    return langs[top], float(share[top]), size


def test_languages_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = langid.learn(rows.filter(~langid.held_out()))
    langs, p = langid.model(counts)
    picked = [r.text for r in rows.orderBy("doc_id").limit(60).collect()]
    mixed = [f"{a[: 200 + 40 * k]} {b[:600]}" for k, (a, b) in enumerate(zip(picked[:20], picked[20:40], strict=True))]
    texts = [*picked, *mixed, "", None, "123 !!", "a", "ÀÉ", picked[0]]
    found = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), counts, keep=["doc_id"]).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(texts) and got[0][1:] == got[len(texts) - 1][1:] and len({r.n_langs for r in found}) > 2  # equal texts, equal rows
    for k, text in enumerate(texts):
        lang, score, size = plain_language(text, langs, p)
        assert (got[k].lang_pred, got[k].n_langs) == (lang, size) and abs(got[k].score - score) < 1e-3


def scalar_adpcm(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = step >> 3
            for bit, shift in ((4, 0), (2, 1), (1, 2)):
                change += (step >> shift) if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGE[code])))
            out.append(value)
    return out


def test_codecs():
    assert media.MULAW[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    r = random.Random(1)
    blocks = [bytes(r.randrange(256) for _ in range(64)) for _ in range(5)]
    got = media.adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(5, 64))
    assert got.tolist() == [scalar_adpcm(b) for b in blocks]
    for codec in media.FORMATS:
        assert media.from_wav(media.to_wav(b"x" * 1152, codec))[0::2] == (codec, b"x" * 1152)
    assert media.doubled(np.array([0, 10, -3], np.int16)).tolist() == [0, 5, 10, 3, -3, -3]
    with pytest.raises(ValueError):
        media.from_wav(b"RIFFxxxxWAVE")


def test_media(docs, none):
    audio = media.store_text_audio(docs)
    want = []
    for d, t in KEYED:
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    digests = media.audio_digests(audio)
    assert result(digests, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    by_text = {}
    sizes = {r.doc_id: (r.media_sha256, r.feature) for r in digests.collect() if r.doc_id is not None}
    for d, t in KEYED:
        if d is not None:
            assert by_text.setdefault(t, sizes[d]) == sizes[d]
    r = media.audio_columns(audio).filter("doc_id = 0").first()
    assert len(r.mulaw) == 4 * len(r.payload) and bytes(r.payload).startswith(TEXTS[0].encode())
    assert media.audio_digests(media.store_text_audio(none)).count() == 0


def test_long_rows_are_cut_apart(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "c", ""]})
    assert [b.num_rows for b in common.slices([batch], "text", 20)] == [2, 1, 2]
