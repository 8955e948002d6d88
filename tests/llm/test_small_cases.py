"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, crf, debruijn, licenses, minhash, packing, srs, toxicity, va_file
from tessera.llm.common import struct_lists

DOCS = "doc_id long, text string, key string, value string, id string, text_2 int"
WORDS = " ".join(f"word{i}" for i in range(120))
ROWS = [(1, WORDS, "a", None, None, 1), (2, None, None, None, None, None), (3, "", "b", "c", "d", 2), (None, WORDS, "x", "y", "z", 3), (5, "one two three", None, None, None, 4), (5, "one two three", None, None, None, 4), (6, "é \x1c \U0001f600 " + "x" * 70000, None, None, None, 5), (7, WORDS + " more", None, None, None, 6), (8, " \n\t ", None, None, None, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_bpe(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    got = by_id(bpe.transform(docs, path, public_tokenizers.PATTERN, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect())
    assert sum(map(len, got.values())) == len(ROWS)
    for row in ROWS:
        ids = codec.encoding.encode_ordinary(row[1] or "")
        for r in got[row[0]]:
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((row[1] or "").encode()).hexdigest()
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    decoded = by_id(bpe.decode(encoded, path, public_tokenizers.PATTERN).collect())
    assert all(bytes(r["bytes"]).decode() == (row[1] or "") for row in ROWS for r in decoded[row[0]])
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_boundaries_change_no_ids(monkeypatch):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "SLICE", 7)
    for text in ["a  b   c\n\n d's  I'll 12ab  ", " " * 50 + "x", "x\x1c y\x85 z  q  \t w" * 9, "don't  stop\r\n  now " * 20, "é" * 60]:
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)
        assert isinstance(codec.encoding, tiktoken.Encoding)


def test_packing(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    capacity = 64
    pieces = packing.piece_digests(docs, path, capacity, 1)
    packed = packing.pack(pieces, capacity, [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]).collect()
    got = by_id(packed)
    for row in ROWS:
        ids = np.array([*library.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        same = sum(r[0] == row[0] for r in ROWS)
        own = sorted(got[row[0]], key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == same * len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            assert r["start"] == r["piece"] * capacity
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(packing.piece_digests(none, path, capacity, 1), capacity, [F.col("doc_id")]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"), capacity, [F.col("length")])
    ids = packing.token_pieces(docs, path, capacity, 1).where("doc_id = 5").first()["ids"]
    assert np.frombuffer(bytes(ids), "<u4").tolist() == [*library.encode("one two three", add_special_tokens=False).ids, 1]


def test_packing_splits_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 10)
    rows = [(i, 3 if i % 3 else 7) for i in range(100)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 10, [F.col("doc_id")]).collect()
    places = {(r["sequence_id"], x) for r in packed for x in range(r["offset"], r["offset"] + r["length"])}
    assert len(packed) == 100 and len(places) == sum(n for _, n in rows) and max(x for _, x in places) < 10


def test_minhash(spark, docs, none):
    got = by_id(minhash.classes(docs).collect())
    assert {k: {r["component_id"] for r in v} for k, v in got.items()} == {1: {1}, 2: {2}, 3: {3}, None: {None}, 5: {5}, 6: {6}, 7: {1}, 8: {8}}
    assert not got[7][0]["kept"] and got[None][0]["kept"] and len(got[5]) == 2
    assert got[1][0]["n_shingles"] == 116 and got[5][0]["n_shingles"] == 1 and got[8][0]["n_shingles"] == 0
    assert minhash.classes(none).count() == 0
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1


def test_minhash_of_looser_links(spark):
    draw = np.random.default_rng(6)
    texts = [" ".join(f"a{i}{x}" for x in range(n)) for i, n in enumerate([1, 2, 3, 4, 6, 9, 20, 60, 200] * 4)]
    for t in list(texts):
        own = t.split()
        for share in (0.6, 0.7, 0.8):
            texts.append(" ".join([*own[: max(1, round(len(own) * share))], *(f"b{x}" for x in draw.integers(0, 10**9, round(len(own) * (1 - share))))]))
    rows = list(enumerate(texts))
    for percent in (50, 60, 80):
        got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=1, percent=percent).collect()}
        sets = [set(t.split()) for t in texts]
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((want[a], want[b]))
                    want = [low if x == high else x for x in want]
        assert got == dict(enumerate(want))
    assert minhash.least_shared(80) == minhash.least_shared(100) == minhash.SHARED
    for percent in (30, 101):
        with pytest.raises(ValueError):
            minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)


def test_debruijn(spark, docs, none):
    got = by_id(debruijn.apply(docs, debruijn.digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"]).collect())
    assert got[7][0]["n_removed"] == 120 and got[7][0]["kept_sha256"] == hashlib.sha256(b"more").hexdigest()
    assert all(r["n_removed"] == 0 for k in (1, 2, 3, None, 5, 6, 8) for r in got[k])
    assert len(got[5]) == 2 and got[8][0]["n_words"] == 0
    assert debruijn.apply(none, debruijn.digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"]).count() == 0
    out = debruijn.remove(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert out.where("doc_id = 7").first()["text"] == "more"


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r["predicted"] for r in toxicity.score(docs, model, ["doc_id", "text_2"]).collect()} == {1}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0)), ["doc_id"]).collect()} == {0}
    mixed = toxicity.fit(docs, spark.createDataFrame([(1, 1), (5, 0), (5, 0), (6, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, mixed, ["doc_id"]).count() == len(ROWS)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert toxicity.accepted(docs, mixed).columns == docs.columns
    assert not docs.select(toxicity.held_out().alias("h")).where("h is null").count()


VECTORS = "vec_id long, embedding array<double>, id long, v string"


def vector_rows():
    draw = np.random.default_rng(4)
    rows = [(int(i), draw.normal(size=6).round(1).tolist(), None, None) for i in range(300)]
    rows += [(300, None, 1, "v"), (301, [], None, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None), (303, [float("nan")] * 6, None, None), (304, [float("inf")] * 6, None, None), (305, [0.0] * 6, None, None), (306, [1.0, 2.0], None, None), (None, [1.0] * 6, None, None)]
    rows += [(400 + i, rows[0][1], None, None) for i in range(40)] + [rows[7]]
    return rows


def usable(rows, zero):
    kept = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            kept[i] = v
    return kept


def test_va_file(spark):
    rows = vector_rows()
    got = {}
    for r in va_file.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in usable(rows, True).items()}
    for q in (i for i in own if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v, strict=True)), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert va_file.search(spark.createDataFrame([], VECTORS), F.lit(True), k=5).count() == 0


def test_va_file_of_large_values_is_exact(spark):
    draw = np.random.default_rng(5)
    v = np.floor(draw.normal(size=(80, 4)) * 1e15)
    for a, b in zip(v[:40], v[40:], strict=True):
        exact = sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
        if -(1 << 63) <= exact < 1 << 63:
            assert va_file.product(a.tolist(), b.tolist()) == exact
        else:
            with pytest.raises(OverflowError):
                va_file.product(a.tolist(), b.tolist())
    # Components whose scaled floor a long could not hold, or only beyond 2^55; the scores fit a long.
    rows = [(i, [float(2**70) * (i % 3 == j) for j in range(3)] + [float(2**50 + i)]) for i in range(30)] + [(100, [0.0, 0.0, 0.0, 1 / 256])]
    got = va_file.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, k=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(n + 1, i, 2**58 + 256 * i) for n, i in enumerate((29, 28, 27))]


def test_va_file_bounds_hold_and_leave_few():
    draw = np.random.default_rng(6)
    v = np.floor(draw.normal(size=(2000, 64)) * 32)
    grid = va_file.Grid(v.min(axis=0), v.max(axis=0))
    packed = grid.cells(v)
    assert len(packed[0]) == 64 * va_file.BITS // 8
    centres, q = grid.centres(packed), v[:20]
    assert (np.abs(v - centres) <= grid.step / 2 * (1 + 1e-9)).all()
    assert (np.abs(q @ v.T - q @ centres.T) <= grid.width(q)[:, None]).all()
    ids = np.arange(len(v))
    out = va_file.scan(grid, ids, ids, centres, ids[:20], ids[:20], q, 5)
    for own in range(20):
        kept = {c for a, c in zip(out["query_id"], out["vec_key"], strict=True) if a == own}
        scores = q[own] @ v.T
        scores[own] = -np.inf
        assert set(np.argsort(-scores)[:5]) <= kept and len(kept) < 200


def test_srs(spark):
    rows = vector_rows()
    got = {}
    for r in srs.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    own = {i: np.array(v) for i, v in usable(rows, False).items()}
    hits = total = 0
    for q in (i for i in own if i % 100 == 0):
        best = sorted((float(np.sqrt(((own[q] - v) ** 2).sum())), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:10]
        found = sorted(got[q])
        assert [n for n, *_ in found] == list(range(1, len(best) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        total += len(best)
    assert hits / total >= 0.9
    assert srs.search(spark.createDataFrame([], VECTORS), F.lit(True), k=5).count() == 0


def test_srs_finds_neighbours_in_order_and_verifies_a_part():
    draw = np.random.default_rng(8)
    tree = srs.Tree(draw.normal(size=(700, 16)))
    q = draw.normal(size=16)
    rows = np.concatenate([r for r, _ in tree.neighbours(q)])
    away = np.concatenate([d for _, d in tree.neighbours(q)])
    assert np.allclose(away, ((tree.points[rows] - q) ** 2).sum(axis=1))
    assert sorted(rows) == list(range(700)) and (np.diff(away) >= 0).all()
    centres = draw.normal(size=(200, 64))
    for v, most in ((draw.normal(size=(8000, 64)), 0.85), (np.repeat(centres, 40, axis=0) + 0.1 * draw.normal(size=(8000, 64)), 0.1)):
        points = srs.Points(np.arange(8000), v, 10)
        hits = 0
        for own in range(40):
            distance = np.sqrt(((v - v[own]) ** 2).sum(axis=1))
            distance[own] = np.inf
            hits += len(set(np.argsort(distance)[:10]) & {i for _, i in points.nearest(own, v[own])})
        assert hits >= 0.9 * 400 and points.verified < most * 40 * 8000, (hits, points.verified / 40 / 8000)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, key int"
    rows = [(1, 1, "assistant", "<|im_end|><\\|x|>", None, 1), (1, 0, "user", None, "f", 2), (2, None, None, "a\nb<|", None, 3), (None, 0, "us\ner%<", "", None, 4), (3, 0, "assistant", "t", None, 5), (3, 0, "assistant", "t", None, 5)]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, schema)).collect()}

    def digest(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[1]["turns_sha256"] == digest([("user", ""), ("assistant", "<|im_end|><\\|x|>")])
    assert got[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|><\\|x|>").hexdigest() and got[1]["loss_chars"] == 16
    assert got[2]["turns_sha256"] == digest([("", "a\nb<|")]) and got[2]["loss_chars"] == 0
    assert got[None]["turns_sha256"] == digest([("us\ner%<", "")])
    assert got[3]["n_turns"] == 2 and got[3]["loss_chars"] == 2
    assert chat.digests(spark.createDataFrame([], schema)).count() == 0


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "uri": "i.png", "width": 57, "height": 28}, {"type": "audio", "uri": "a.wav", "seconds": 2.0}, {"type": "text", "text": "end"}, {"type": "document", "uri": "d.pdf", "pages": 3}]
    turn = chat.format_turn("assistant", parts)
    assert [a["tokens"] for a in turn.attachments] == [3, 25, 1680] and turn.expanded == 1708
    ((role, read),) = chat.read(turn.text)
    assert role == "assistant" and read == [("text", "see <|image:0|> "), ("image", "0"), ("audio", "1"), ("text", "end"), ("document", "2")]
    assert "".join(chat.unescape(turn.text[a:b]) for a, b in turn.loss) == "see <|image:0|> end"
    df = spark.createDataFrame([(1, "user", [("text", "hi", None, None, None, None, None), ("image", None, "u", 28.0, 28.0, None, None)])], f"conv_id long, role string, content {chat.PARTS}")
    row = chat.turns(df, ["conv_id"], parts=F.col("content")).first()
    assert row["expanded_tokens"] == 1 and row["attachments"][0]["uri"] == "u" and row["loss"] == []
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_chat_parts_without_sizes(spark):
    schema = f"conv_id long, role string, content {chat.PARTS}"
    nan, endless = float("nan"), float("inf")
    content = [None, ("image", None, "u", nan, 28.0, None, None), ("image", None, "u", endless, 28.0, None, None), ("image", None, "u", -57.0, -28.0, None, None), ("audio", None, "a", None, None, -endless, None), ("document", None, "d", None, None, None, -2), (None, None, None, None, None, None, None), ("text", "t", None, None, None, None, None)]
    rows = [(1, "assistant", content), (2, None, None), (3, "assistant", [])]
    got = {r["conv_id"]: r for r in chat.turns(spark.createDataFrame(rows, schema), ["conv_id"], parts=F.col("content")).collect()}
    assert [a["tokens"] for a in got[1]["attachments"]] == [0] * 5 and got[1]["expanded_tokens"] == 0
    assert len(got[1]["loss"]) == 1 and got[2]["attachments"] == [] and got[3]["formatted"] == "<|im_start|>assistant\n<|im_end|>\n"


def test_licenses(spark, docs, none):
    template = licenses.TEMPLATES["MIT"]
    changed = template.replace("without restriction", "with no restriction").replace("Software", "Program", 2)
    rows = [(1, f"{WORDS} {changed} {WORDS}", None, None, None, 1), (2, "Licensed under CC BY-NC 4.0. x Licensed under CC BY-NC 4.0.", None, None, None, 1), (3, None, None, None, None, 1), (4, "licensed", None, None, None, 1)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {1, 2} and len(got[2]) == 2
    assert got[1][0]["license"] == "MIT" and got[1][0]["coverage"] > 0.9
    assert got[1][0]["first_word"] == 120 and got[1][0]["last_word"] == 120 + len(licenses.words(changed)) - 1
    assert licenses.scan(none).count() == 0


def test_formulas_and_fallbacks_are_text():
    from tessera.llm import dom

    page = "<p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2 TeX</annotation><annotation-xml><ci>x</ci></annotation-xml></semantics></math> then <object data=a><param name=b>see <i>this</i></object> end.<svg><text>no</text></svg>"
    assert [b.text for b in dom.blocks(page)] == ["If x=2 then see this end."]


def test_adjacent_licenses():
    line = "Released under the MIT License."
    scanner = licenses.Scanner(licenses.TEMPLATES)
    spans = lambda text: [(f["license"], f["first_word"], f["last_word"]) for f in scanner.scan(text)]
    assert spans(f"w0 w1 {line} {line} z") == [("MIT line", 2, 6), ("MIT line", 7, 11)]
    for name, template in licenses.TEMPLATES.items():
        n = len(licenses.words(template))
        for copies in (2, 3, 5):
            assert spans("w0 w1 " + " ".join([template] * copies) + " z y") == [(name, 2 + n * c, 1 + n * (c + 1)) for c in range(copies)]
            apart = spans("w0 w1 " + " q r ".join([template] * copies) + " z y")
            assert apart == [(name, 2 + (n + 2) * c, 1 + n + (n + 2) * c) for c in range(copies)]
    template = licenses.TEMPLATES["MIT"]
    changed = template.replace("without restriction", "with no restriction").replace("Software", "Program", 2)
    n, m = len(licenses.words(template)), len(licenses.words(changed))
    for texts, sizes in (((changed, template, changed), (m, n, m)), ((changed, changed, changed), (m, m, m)), ((template, changed, template), (n, m, n))):
        got = spans(f"w0 w1 {' '.join(texts)} z")
        ends = [sum(sizes[: k + 1]) for k in range(3)]
        assert got == [("MIT", 2 + e - size, 1 + e) for e, size in zip(ends, sizes, strict=True)]


def test_licenses_against_brute_force():
    """Planted copies with some words changed are found, unless nearly too many; what is found holds enough of its template."""
    draw = np.random.default_rng(12)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = [n for n in licenses.TEMPLATES if len(scanner.templates[n]) >= 20 and "BSD" not in n]
    for _ in range(60):
        text, planted = [], []
        for name in draw.choice(names, draw.integers(0, 4)):
            text += [f"w{x}" for x in draw.integers(0, 50, draw.integers(0, 30))] + draw.choice(["the", "license", "software", "of"], draw.integers(0, 6)).tolist()
            own, first = [], len(text)
            for word in scanner.templates[name]:
                x = draw.random()
                keep = word in scanner.telling[name] or x > 0.08
                own += [word] if keep else [f"x{draw.integers(0, 99)}"] if x > 0.04 else []
            text += own
            if sum(w[0] != "x" for w in own) >= 0.88 * len(scanner.templates[name]):
                planted.append((name, first, len(text)))
        found = scanner.scan(" ".join(text))
        for name, first, end in planted:
            assert any(f["first_word"] < end and first <= f["last_word"] for f in found), (name, first, end, found)
            assert any(f["license"] == name and abs(f["first_word"] - first) < 6 and abs(f["last_word"] + 1 - end) < 6 for f in found), (name, first, end, found)
        for f in found:
            template = scanner.templates[f["license"]]
            own = text[f["first_word"] : f["last_word"] + 1]
            assert f["coverage"] >= licenses.COVERAGE and common(own, template) >= f["matched"] >= licenses.DENSITY * len(own)


def common(a, b):
    best = np.zeros(len(b) + 1, int)
    for x in a:
        best = np.maximum.accumulate(np.concatenate([[0], np.maximum(best[1:], np.where(np.array(b) == x, best[:-1] + 1, 0))]))
    return best[-1]


def test_licenses_in_very_long_texts():
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES)
    line = licenses.TEMPLATES["MIT line"]
    start = time.process_time()
    assert len(scanner.scan("under the software license of " * 20_000 + line)) == 1
    assert len(scanner.scan("software " * 100_000 + line)) == 1
    assert time.process_time() - start < 30
    versions = {scanner.scan(f"a {licenses.TEMPLATES[n]} b")[0]["license"] for n in licenses.TEMPLATES}
    assert versions == set(licenses.TEMPLATES)


def test_capitals_of_whole_texts():
    mostly = lambda text: toxicity.patterns(text)[len(toxicity.MARKS)]
    for n in (100, 1999, 2000, 3999, 4000, 5999, 6000, 50000):
        assert mostly("A" * (3 * n // 10 + 1) + "a" * (n - 3 * n // 10 - 1)) == 1
        assert mostly("a" * (n - 3 * n // 10) + "É" * (3 * n // 10)) == 0
    assert mostly("Ab" * 4000) == 1 and mostly("aB" * 4000) == 1 and mostly("aaaB" * 4000) == 0 and mostly("Baaa" * 4000) == 0
    assert mostly("") == 0 and mostly("\ud800" * 10) == 0


def test_html(spark):
    page = "<html><body><nav><ul><li><a href=/>Home page</a><li><a href=/b>More</a></ul></nav><article><h1>A &amp; B</h1><p>First <b>bold\n text</b> &lt;here&gt; and more words to read.<p>Second paragraph of the article follows here, as it should.</article><script>var x = '<p>no</p>'</script><footer>&copy; someone 2020</footer></body></html>"
    rows = [(1, page, "t", 1), (2, None, None, None), (3, "", None, 2), (None, "<", None, 3), (4, "<p" * 5000, None, 4), (1, page, "t", 1)]
    got = {}
    for r in crf.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars long"), ["page_id"]).collect():
        got.setdefault(r["page_id"], []).append(r)
    want = "A & B\nFirst bold text <here> and more words to read.\nSecond paragraph of the article follows here, as it should."
    assert [r["text"] for r in got[1]] == [want, want] and got[1][0]["n_chars"] == len(want)
    assert got[2][0]["text"] == "" and got[3][0]["text"] == "" and got[4][0]["text"] == ""
    assert crf.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"]).count() == 0


def test_runs_of_a_batch_stay_arrays():
    starts = np.arange(300_000, dtype=np.int32) % 100_000
    runs = pa.StructArray.from_arrays([pa.array(starts), pa.array(np.ones(300_000, np.int32))], ["first", "count"])
    column = pa.ListArray.from_arrays(pa.array([0, 100_000, 100_000, 100_000, 300_000], pa.int32()), runs, mask=pa.array([False, True, False, False]))

    def peak(read):
        tracemalloc.start()
        out = read()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    lists, held = peak(lambda: struct_lists(column))
    plain, objects = peak(column.to_pylist)
    assert held * 10 < objects
    assert [None if x is None else list(zip(x["first"], x["count"], strict=True)) for x in lists] == [[(r["first"], r["count"]) for r in x] if x else None for x in plain]
    assert struct_lists(column.slice(3))[0]["first"].tolist() == lists[3]["first"].tolist()
    for n_words in (100_049, 100_060):
        want = np.arange(n_words) < 100_049
        assert (debruijn.marks(n_words, lists[0]) == want).all() and (debruijn.marks(n_words, lists[3]) == want).all()
    few = {"first": np.array([2, 9]), "count": np.array([1, 2])}
    assert np.flatnonzero(debruijn.marks(20, few, 3)).tolist() == [2, 3, 4, 9, 10, 11, 12]
    assert not debruijn.marks(20, None).any()
