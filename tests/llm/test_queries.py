"""The registered queries of the corpus operators: SQL twins, brute force, round trips, recall and held-out accuracy."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, crf, debruijn, licenses, minhash, packing, word_bpe
from tessera.llm.queries import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def rows(sf, table):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_licenses(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    lines = {v: k for k, v in licenses.TEMPLATES.items() if k.endswith(" line")}
    want = Counter()
    for d in rows(MIDDLE, "documents"):
        for line in (d["text"] or "").split("\n"):
            if line in lines:
                want[d["doc_id"], lines[line]] += 1
    got = Counter((r["doc_id"], r["license"]) for r in QUERIES["op2_patience_licenses"](spark, MIDDLE).collect())
    assert got == want and sum(want.values()) > 20
    assert scanner.scan(None) == []


def lcs(a, b):
    best = np.zeros(len(b) + 1, int)
    for x in a:
        best = np.maximum.accumulate(np.concatenate([[0], np.maximum(best[1:], np.where(np.array(b) == x, best[:-1] + 1, 0))]))
    return best[-1]


def test_patience_is_a_common_subsequence():
    draw = np.random.default_rng(1)
    for _ in range(60):
        a = [str(i) for i in draw.integers(0, 60, 50)]
        b = [x for x in a if draw.random() > 0.2] + [str(i) for i in draw.integers(60, 70, 3)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(a, b)
    order = draw.permutation(40).tolist()
    assert len(licenses.increasing(list(enumerate(order)))) == max_run(order)


def max_run(order):
    best = []
    for i, x in enumerate(order):
        best.append(1 + max((best[j] for j in range(i) if order[j] < x), default=0))
    return max(best)


def test_byte_bpe(spark):
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {d["doc_id"]: d["text"] or "" for d in rows(SMALL, "documents")}
    for r in QUERIES["op3_byte_bpe"](spark, SMALL).collect():
        text = texts.pop(r["doc_id"])
        ids = codec.encoding.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert not texts


def check_packed(packed, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        own[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(own) == set(texts)
    total = 0
    for key, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(own[key], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(i, s, min(4096, len(ids) - s)) for i, s in enumerate(range(0, len(ids), 4096))]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
        total += len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = sorted((r["length"] for r in packed), reverse=True)
    assert len(bins) == best_fit(lengths, 4096)
    return total, len(bins)


def best_fit(lengths, capacity):
    from bisect import bisect_left, insort

    gaps, opened = [], 0
    for n in lengths:
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += gap == capacity
        if gap > n:
            insort(gaps, gap - n)
    return opened


def test_best_fit(spark):
    packed = QUERIES["op4_best_fit"](spark, SMALL).collect()
    total, bins = check_packed(packed, {d["doc_id"]: d["text"] for d in rows(SMALL, "documents")})
    assert bins <= 1.05 * -(-total // 4096) + 1


def test_best_fit_rounds_against_the_sequential_one(spark):
    draw = np.random.default_rng(2)
    for capacity, low, high, n in ((7, 1, 7, 300), (50, 1, 16, 300), (4096, 1, 4096, 400), (4096, 500, 1500, 400)):
        lengths = draw.integers(low, high + 1, n).tolist()
        packed = packing.pack(spark.createDataFrame([(x,) for x in lengths], "length long"), capacity, [F.col("length")]).collect()
        bins = defaultdict(list)
        for r in packed:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in bins.values():
            assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)])[:-1].tolist()]
            assert sum(n for _, n in places) <= capacity
        assert sorted(n for places in bins.values() for _, n in places) == sorted(lengths)
        best = best_fit(sorted(lengths, reverse=True), capacity)
        assert len(bins) <= best + best // 50 + (capacity == 4096)


def test_ids_of_texts_with_special_strings_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), word_bpe.words(path)
    draw = np.random.default_rng(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", "a", "don't", "\n", "é", "A\u0301", "<", "|>", "\x1c", "7", "東京"]
    for _ in range(3000):
        text = "".join(draw.choice(parts, draw.integers(0, 9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_html(spark):
    got = {r["page_id"]: r for r in QUERIES["op6_crf"](spark, MIDDLE).collect()}
    pages = rows(MIDDLE, "pages")
    assert len(got) == len(pages)
    for p in pages:
        text = got[p["page_id"]]["text"]
        assert got[p["page_id"]]["n_chars"] == len(text) and got[p["page_id"]]["url"] == p["url"]
        assert text and "©" not in text


def test_field_on_held_out_pages():
    field = crf.default_field()
    right = total = 0
    for found, labels in crf.labelled_pages(200, seed=77):
        right += sum(a == b for a, b in zip(field.decode(found), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(3)
    for _ in range(20):
        n = int(draw.integers(1, 7))
        gains, moves = draw.normal(size=n), draw.normal(size=(2, 2))

        class Fixed(crf.Field):
            def emission(self, block, at, of):
                return gains[at]

        score = lambda y: sum(gains[i] * v for i, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        paths = [[int(x) for x in f"{k:0{n}b}"] for k in range(1 << n)]
        assert abs(score(Fixed({}, moves).decode([None] * n)) - max(map(score, paths))) < 1e-9


def windows_removed(texts, k=50):
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out[d] = gone
    return words, out


def test_debruijn(spark):
    words, gone = windows_removed({d["doc_id"]: d["text"] for d in rows(SMALL, "documents")})
    for r in QUERIES["op7_debruijn"](spark, SMALL).collect():
        w, g = words[r["doc_id"]], gone[r["doc_id"]]
        kept = b" ".join(x for x, y in zip(w, g, strict=True) if not y)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(g), hashlib.sha256(kept).hexdigest())
    assert sum(map(sum, gone.values())) > 0


def test_debruijn_on_shared_pieces(spark):
    draw = np.random.default_rng(6)
    base = [f"w{i}" for i in draw.integers(0, 400, 600)]
    texts = {}
    for d in range(60):
        parts = []
        for _ in range(draw.integers(1, 4)):
            at = int(draw.integers(0, 520))
            parts += base[at : at + int(draw.integers(20, 140))]
            parts += [f"x{i}" for i in draw.integers(0, 5, draw.integers(0, 40))]
        if draw.random() < 0.3:
            parts = ["same"] * int(draw.integers(40, 120)) + parts
        texts[d] = " ".join(parts)
    words, gone = windows_removed(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in debruijn.apply(df, debruijn.digest, "n_words long, n_removed long, kept_sha256 string", ["doc_id"]).collect():
        kept = b" ".join(x for x, y in zip(words[r["doc_id"]], gone[r["doc_id"]], strict=True) if not y)
        assert (r["n_removed"], r["kept_sha256"]) == (sum(gone[r["doc_id"]]), hashlib.sha256(kept).hexdigest())


def near_classes(texts, n, percent, lower):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode()
        w = (w.lower() if lower else w).split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        both = Counter(e for x in s for e in inverted[x])
        for e, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[e]) - c):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for x in s:
            inverted[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_minhash(spark):
    want = near_classes({d["doc_id"]: d["text"] for d in rows(SMALL, "documents")}, 4, 80, True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op8_minhash"](spark, SMALL).collect()}
    assert got == want


def test_minhash_on_chains_of_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_ROWS", 16)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 2000)
    draw = np.random.default_rng(8)
    texts = {}
    for family in range(3):
        w = [f"f{family}w{i}" for i in range(70)]
        for d in range(50):
            w = list(w)
            for _ in range(int(draw.integers(0, 3))):
                w[int(draw.integers(0, 70))] = f"n{draw.integers(0, 9999)}"
            texts[family * 50 + d] = " ".join(w)
    for d in range(150, 170):
        texts[d] = " ".join(f"f0w{i}" for i in range(30)) + " " + " ".join(f"own{d}x{i}" for i in range(40))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(df, words=4, lower=True).collect()}
    assert got == near_classes(texts, 4, 80, True)


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in rows("/root/testdata/sf0.1", "labels")}
    table = Counter()
    for r in QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            table[labels[r["doc_id"]], r["predicted"]] += 1
    assert table[1, 1] / (table[1, 1] + table[1, 0]) > 0.85 and table[1, 1] / (table[1, 1] + table[0, 1]) > 0.95


def test_projected_neighbours(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(MIDDLE, "embeddings")}
    got = defaultdict(list)
    for r in QUERIES["op10_projected_neighbours"](spark, MIDDLE).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in (i for i in vectors if i % 100 == 0):
        best = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
        total += 10
        assert all(abs(s - np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())) < 1e-12 for _, i, s in got[q])
    assert hits / total >= 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "toxicity":
            predicted = {r["doc_id"]: r["predicted"] for r in QUERIES["op9_toxicity"](spark, SMALL).collect()}
            assert set(after) == {d for d in before if not predicted[d]}
        elif name == "minhash_near_dedup":
            assert set(after) == {d for d, (_, c) in near_classes(before, 5, 80, False).items() if c == d}
        else:
            words, gone = windows_removed(before)
            assert {d: t.encode().split() for d, t in after.items()} == {d: [x for x, y in zip(words[d], gone[d], strict=True) if not y] for d in before}
    check_packed(corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect(), after)
    assert corpus_pipeline.run(spark, SMALL).count() >= len(after)
