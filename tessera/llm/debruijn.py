"""Repeated passages across documents by compaction of a de Bruijn graph over words.

Edges are the windows of `k` consecutive words. Consecutive edges that share a minimiser (the least hashed `q`-gram of
the window, the leftmost of equals) form a path; every window has its minimiser inside, so equal windows lie on paths
with equal minimisers. A path travels as one row: minimiser, hash of all its words, source coordinates.
1. Minimisers seen once are dropped by a group-by. A minimiser with one path value is nonbranching: one join settles
   all edges of the path for all its documents.
2. At branching minimisers equal paths settle first; of each path only its first document goes on.
3. Those source coordinates are looked up in the texts again and verified edge by edge.
Edges that also start in a document with a smaller id are covered; covered runs of a document merge into spans.
All group-bys pre-aggregate, and hot passages meet only in joins whose skewed partitions Spark splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_batches, release
from tessera.llm.shingles import MULTIPLIER, hashes, mix, split, windows

WINDOW = 50
GRAM = 12
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOW = np.uint64(0xFFFFFFFF)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def paths(h: np.ndarray, k: int = WINDOW, q: int = GRAM) -> tuple[np.ndarray, ...]:
    """Paths of a document by its word hashes: minimiser hash, path hash, first window, number of windows."""
    edges = len(h) - k + 1
    if edges < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = windows(h, q)
    # Order by the upper half of the hash, then leftmost: the position travels in the lower half.
    least, span, width = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1, k - q + 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, edges))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), MULTIPLIER)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _INVERSE)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])
        path = mix((total[first + count + k - 1] - total[first]) * back[first] + count.astype(np.uint64)) ^ (at[first] - first).astype(np.uint64)
    return grams[at[first]].view(np.int64), path.view(np.int64), first, count


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that take part, with a hash of the text that tells rows of one id apart."""
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].cast("long").alias("doc"), F.xxhash64(text).alias("kind"), text.alias("text"))


def covered(df: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc, kind, first, count`: runs of windows of each document that also start in a document with a smaller id."""
    docs = _keyed(df, id_col, text_col).where("doc is not null")

    def walk(batch: dict[str, list]) -> dict[str, list]:
        found = [paths(hashes(split(t)), k) for t in batch["text"]]
        sizes = [len(f[0]) for f in found]
        out = {n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("gram", "path", "first", "count"))}
        return out | {n: np.repeat(np.array(batch[n]), sizes) for n in ("doc", "kind")}

    # Written once: the texts are walked once, and both readers below see the same rows.
    rows = cut(map_batches(docs, walk, "gram long, path long, doc long, kind long, first int, count int"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc").alias("start"), F.max("doc").alias("stop"), (F.min("path") != F.max("path")).alias("branches"))
    # Written aside, so that both sides of the join are plain exchanges, whose hot partitions Spark can split.
    shared = cut(shared.where("start < stop").select("gram", "start", "branches"))
    hits = cut(rows.join(shared, "gram").where("branches or doc > start").drop("start"))
    release(df.sparkSession.sparkContext, rows, shared)
    straight = hits.where("not branches")

    branching = hits.where("branches").drop("branches")
    paths_of = cut(branching.groupBy("gram", "path").agg(F.min("doc").alias("start")))
    settled = branching.join(paths_of, ["gram", "path"])
    equal = settled.where("doc > start")
    sources = settled.where("doc = start").groupBy("doc", "kind").agg(F.collect_set(F.struct("gram", "first", "count")).alias("at"))

    def look(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("gram", "doc", "kind", "first", "edges")}
        for doc, kind, text, at in zip(batch["doc"], batch["kind"], batch["text"], batch["at"], strict=True):
            edge = windows(hashes(split(text)), k).view(np.int64)
            for gram, first, count in zip(at["gram"], at["first"], at["count"], strict=True):
                for name, x in zip(out, (gram, doc, kind, first, edge[first : first + count]), strict=True):
                    out[name].append(x)
        return out

    looked = cut(map_batches(docs.join(sources, ["doc", "kind"]), look, "gram long, doc long, kind long, first int, edges array<long>", ("at",)))
    edges = looked.select("gram", "doc", "kind", "first", F.posexplode("edges").alias("step", "edge"))
    starts = cut(edges.groupBy("gram", "edge").agg(F.min("doc").alias("start"), F.max("doc").alias("stop")).where("start < stop").drop("stop"))
    single = edges.join(starts, ["gram", "edge"]).where("doc > start").select("doc", "kind", (F.col("first") + F.col("step")).alias("first"), F.lit(1).alias("count"))
    columns = ["doc", "kind", "first", "count"]
    return straight.select(*columns).unionByName(equal.select(*columns)).unionByName(single)


def marks(n_words: int, runs: dict[str, np.ndarray] | None, k: int = WINDOW) -> np.ndarray:
    """Which words lie in a covered window; `runs` holds `first` and `count` of each run."""
    if not runs:
        return np.zeros(n_words, bool)
    ends = np.minimum(n_words, runs["first"] + runs["count"] + (k - 1))
    step = np.bincount(runs["first"], minlength=n_words + 1) - np.bincount(ends, minlength=n_words + 1)
    return np.cumsum(step[:-1]) > 0


def apply(df: DataFrame, fn: Callable[[str, dict[str, np.ndarray] | None], dict], fields: str, keep: list[str], k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`keep` columns of every row of `df` with the `fields` that `fn(text, covered runs)` makes.

    A word is covered when one of its windows of `k` words also starts in a document with a smaller id; windows are
    judged on the input. Null and empty texts have no words. Rows with a null id are neither sources nor covered. Rows
    that repeat an id are parts of one document: they never cover one another. An empty table gives an empty result.
    """
    runs = covered(df, k, id_col, text_col).distinct().groupBy("doc", "kind").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    named = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(*named, df[id_col].cast("long").alias("doc"), F.xxhash64(text).alias("kind"), text.alias("text"))
    joined = rows.join(runs, ["doc", "kind"], "left").drop("doc", "kind")
    types = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    made = [f.split()[0] for f in fields.split(", ")]

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [fn(t, r) for t, r in zip(batch["text"], batch["runs"], strict=True)]
        return {f"k{i}": batch[f"k{i}"] for i in range(len(keep))} | {n: [x[n] for x in found] for n in made}

    out = map_batches(joined, run, f"{types}, {fields}", ("runs",))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made)


def digest(text: str, runs: dict[str, np.ndarray] | None, k: int = WINDOW) -> dict:
    """Counts, and the digest of the kept words joined by one space."""
    words = split(text)
    if not runs:
        return {"n_words": len(words), "n_removed": 0, "kept_sha256": hashlib.sha256(b" ".join(words)).hexdigest()}
    gone = marks(len(words), runs, k)
    kept = b" ".join([words[i] for i in np.flatnonzero(~gone)])
    return {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def kept_text(text: str, runs: dict[str, np.ndarray] | None, k: int = WINDOW) -> str:
    """The text without its covered words; blanks between kept neighbours stay, a gap becomes one line feed."""
    if not runs:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    kept = np.flatnonzero(~marks(len(places), runs, k))
    parts = []
    for run in np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1):
        if len(run):
            parts.append(raw[places[run[0]][0] : places[run[-1]][1]])
    return b"\n".join(parts).decode("utf-8", "surrogatepass")


def remove(df: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with covered words taken out of `text_col`; other columns, and the number and ids of rows, stay. Null texts
    become empty ones."""
    keep = [c for c in df.columns if c != text_col]
    made = "_kept"
    while made in df.columns:
        made += "_"
    fn = lambda text, runs: {made: kept_text(text, runs, k)}
    out = apply(df, fn, f"{made} string", keep, k, id_col, text_col)
    return out.select(*[F.col(made).alias(c) if c == text_col else F.col(c) for c in df.columns])
