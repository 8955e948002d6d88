"""Toxicity by weak supervision.

1. Cues: words and word beginnings that labelled rows tie to toxicity beyond chance become lexicon voters; marks and
   shapes of a text are pattern voters; the annotator's label is a voter too.
2. A generative label model estimates by expectation maximisation how often each voter fires for either class, and the
   correlations of voters within a class, by which it divides their weight.
3. A linear classifier is trained on the model's posterior labels and scores every whole text.
Only the labelled sample is bounded (`SAMPLE` rows, by a hash of the id); every text is scored over its whole length.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_rows, map_batches
from tessera.llm.shingles import hashes, split, windows

#: Labelled rows that voters and classifier are fitted on, at most.
SAMPLE = 20_000
#: Lexicon voters, at most (the strongest): it bounds the model that every task receives.
VOTERS = 512
#: The fewest toxic rows that a cue is seen in.
SUPPORT = 3
#: Lengths of word beginnings tried as cues, besides whole words.
STEMS = (4, 5, 6, 7)
#: Share of toxic rows among those that hold a cue, at least.
PURITY = 0.6
WORDS = regex.compile(r"\p{L}+")
#: Marks whose density is a pattern voter, and the density (of characters) at which it fires.
MARKS = {"!": 0.004, "?": 0.004, "*": 0.01, "%": 0.01, "@": 0.002, "#": 0.01, "$": 0.01}

#: Share of a text's characters that must be capitals.
CAPITALS = 0.3


def cues_of(text: str) -> set[str]:
    """Candidate cues of a text: whole words (closed by a blank) and word beginnings, lower case."""
    out = set()
    for word in set(WORDS.findall(text.lower())):
        out.add(word + " ")
        out.update(word[:n] for n in STEMS if len(word) >= n)
    return out


@lru_cache(maxsize=1)
def capital() -> np.ndarray:
    """For each code point whether it is a capital; one table for each worker process."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def patterns(text: str) -> list[float]:
    """Pattern votes of a text: dense marks, mostly capitals, one line, very short."""
    n = max(1, len(text))
    capitals = np.count_nonzero(capital()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")])
    return [*(float(text.count(m) >= d * n) for m, d in MARKS.items()), float(capitals > CAPITALS * n), float("\n" not in text), float(n < 200)]


@lru_cache(maxsize=4)
def automaton(cues: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds every cue in one pass; one automaton for each worker process."""
    found = ahocorasick.Automaton()
    for i, cue in enumerate(cues):
        found.add_word(cue.rstrip(" "), (i, len(cue.rstrip(" ")), cue.endswith(" ")) if not found.exists(cue.rstrip(" ")) else (*found.get(cue.rstrip(" ")), i, len(cue.rstrip(" ")), cue.endswith(" ")))
    found.make_automaton()
    return found


def hits(text: str, cues: tuple[str, ...]) -> Counter:
    """Occurrences of each cue: a stem begins a word, a whole word also ends there."""
    low = text.lower()
    out: Counter = Counter()
    if not cues:
        return out
    for end, value in automaton(cues).iter(low):
        for at in range(0, len(value), 3):
            cue, size, whole = value[at : at + 3]
            start = end - size + 1
            if (start == 0 or not low[start - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                out[cue] += 1
    return out


class Model:
    """Cues, weights and bias of the linear classifier."""

    def __init__(self, cues: tuple[str, ...], weights: np.ndarray, bias: float):
        self.cues, self.weights, self.bias = cues, weights, bias

    def score(self, text: str | None) -> float:
        """Probability of toxicity of a whole text; null is the empty text."""
        text = text or ""
        x = self.bias + float(features([dict(hits(text, self.cues))], [patterns(text)], len(self.cues))[0] @ self.weights)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def features(found: list[dict[int, int]], marks: list[list[float]], cues: int) -> np.ndarray:
    """Rows of: any cue, logarithm of occurrences, each cue, patterns."""
    out = np.zeros((len(found), 2 + cues + len(MARKS) + 3))
    for row, (own, pattern) in enumerate(zip(found, marks, strict=True)):
        if own:
            out[row, 0] = 1
            out[row, 1] = math.log1p(sum(own.values()))
            out[row, [2 + c for c in own]] = 1
        out[row, 2 + cues :] = pattern
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Posterior probability of the toxic class for each row of binary `votes` and the annotator's `labels`.

    Starts from the labels; each round estimates the rates at which voters fire in either class and their correlations
    within the class, divides the weight of a voter by the sum of its positive correlations, and infers the classes.
    """
    posterior = np.clip(labels, 0.05, 0.95).astype(float)
    every = np.column_stack([votes, labels])
    for _ in range(rounds):
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        prior = np.clip(toxic / len(labels), 1e-3, 1 - 1e-3)
        one = (posterior @ every + 0.1) / (toxic + 0.2)
        zero = ((1 - posterior) @ every + 0.1) / (clean + 0.2)
        one[-1], zero[-1] = max(one[-1], 0.8), min(zero[-1], 0.1)
        centred = every - posterior[:, None] * one - (1 - posterior)[:, None] * zero
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
        correlation = (centred.T @ centred) / len(labels) / np.outer(spread, spread)
        share = 1 / np.maximum(1, np.clip(correlation, 0, 1).sum(axis=1))
        share[-1] = 1
        fires, silent = np.log(one / zero) * share, np.log((1 - one) / (1 - zero)) * share
        x = math.log(prior / (1 - prior)) + every @ fires + (1 - every) @ silent
        posterior = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return posterior


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 0.02, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on probabilities by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (target - p) - ridge * w)
        size = np.abs(step).max()
        w += step if size < 4 else step * (4 / size)
        if size < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    """Fit on at most `sample` labelled documents, taken by a hash of the id, with at most `voters` cues of their words.

    Null ids and null labels are left out; labels that repeat an id are toxic if one is; of documents that repeat an id
    one text is taken. Near copies in the sample (equal least shingle) count once. Without labels of both classes the
    model scores every text by the share of toxic labels, 0 if there are none."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def least(batch: dict[str, list]) -> dict[str, list]:
        shingles = [windows(hashes(w), min(5, len(w))) if (w := split(t)) else [0] for t in batch["text"]]
        return {"least": [int(min(s) >> np.uint64(1)) if len(s) else 0 for s in shingles], "text": [t or "" for t in batch["text"]], "y": [int(y > 0) for y in batch["y"]]}

    single = map_batches(rows.select("text", "y"), least, "least long, text string, y int").groupBy("least", "y").agg(F.min("text").alias("text")).select("y", "text")
    single = single.persist()
    try:
        return _fitted(single, voters)
    finally:
        single.unpersist()


def _fitted(single: DataFrame, voters: int) -> Model:
    counts = {r["y"]: r["n"] for r in single.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model((), np.zeros(2 + len(MARKS) + 3), 60.0 if toxic else -60.0)

    def tally(batch: dict[str, list]) -> dict[str, list]:
        seen = Counter(), Counter()
        for text, y in zip(batch["text"], batch["y"], strict=True):
            seen[y].update(cues_of(text))
        names = list(seen[0] | seen[1])
        return {"cue": names, "clean": [seen[0][c] for c in names], "toxic": [seen[1][c] for c in names]}

    tallied = map_batches(single, tally, "cue string, clean long, toxic long").groupBy("cue").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = F.count("*").alias("n")
    base = toxic / (toxic + clean)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(rate / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    tallied = tallied.persist()
    kinds = tallied.where(F.col("toxic") + F.col("clean") >= SUPPORT).agg(total).first()["n"]
    likely = tallied.where((F.col("toxic") >= SUPPORT) & (rate >= PURITY) & (gain >= math.log(max(2, kinds))))
    ranked = likely.orderBy(gain.desc(), "cue").collect()  # words of at most SAMPLE documents
    tallied.unpersist()
    cues = _lexicon([(r["cue"], r["toxic"], r["clean"]) for r in ranked])[:voters]

    def seen(batch: dict[str, list]) -> dict[str, list]:
        own = [hits(t, cues) for t in batch["text"]]
        return {"y": batch["y"], "cue": [list(h) for h in own], "times": [list(h.values()) for h in own], "marks": [patterns(t) for t in batch["text"]]}

    rows = map_batches(single, seen, "y int, cue array<int>, times array<int>, marks array<double>").collect()  # at most SAMPLE documents
    x = features([dict(zip(r["cue"], r["times"], strict=True)) for r in rows], [r["marks"] for r in rows], len(cues))
    labels = np.array([r["y"] for r in rows], float)
    posterior = label_model(np.column_stack([x[:, :1], x[:, 2:]]), labels)
    weights, bias = logistic(x, posterior)
    return Model(cues, weights, bias)


def _lexicon(ranked: list[tuple[str, int, int]]) -> tuple[str, ...]:
    """The best cues, shortest first where one contains another: a longer cue stays only if it is purer."""
    kept: dict[str, float] = {}
    for cue, toxic, clean in sorted(ranked, key=lambda r: (len(r[0].rstrip(" ")), r[0])):
        purity = toxic / (toxic + clean)
        if all(kept.get(cue.rstrip(" ")[:n], -1.0) < purity for n in STEMS):
            kept[cue] = purity
    order = {cue: i for i, (cue, _, _) in enumerate(ranked)}
    return tuple(sorted(kept, key=order.__getitem__))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` columns of every row with `score double` (0 to 1) and `predicted int` (1 from 0.5). Null texts are empty;
    null ids, ties and repeated rows stay as they are; an empty table gives an empty result."""
    named = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batch: dict[str, list]) -> dict[str, list]:
        scores = [model.score(t) for t in batch["text"]]
        return {f"k{i}": batch[f"k{i}"] for i in range(len(keep))} | {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    out = map_batches(docs.select(*named, docs[text_col].alias("text")), run, ", ".join(filter(None, [types, "score double, predicted int"])))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that the model does not predict to be toxic."""
    return filter_rows(docs, text_col, lambda texts: [model.score(t) < 0.5 for t in texts])


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: CRC-32 of the id as text divisible by 5. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
