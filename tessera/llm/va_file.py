"""Exact top-k inner products by a vector-approximation file.

1. Every vector is quantised once: a few bits a dimension say in which cell of a uniform grid its component lies. These
   packed cells are the approximation file; only they are scanned, for a lower and an upper bound of each score.
2. What may still be among a query's best by its bounds is kept as pairs of keys, a few for each block and query.
3. Exact vectors are read for these in order of their bounds: first the `k` best by bound of each query, then those whose
   upper bound reaches the kth score found. Those left unread cannot matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import cut, map_batches

#: Bits of a cell in each dimension.
BITS = 6
#: Queries whose bounds are held at once.
HELD = 64
#: Relative width added to bounds for the rounding of sums of doubles.
ROUNDING = 1e-9
#: From here on doubles are integers of their own and products of them are computed on Python integers.
WHOLE = 2.0**52


class Grid:
    """A uniform grid between the least and the greatest value of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.bits, self.low = bits, low
        self.step = np.maximum((high - low) / ((1 << bits) - 1), np.finfo(float).tiny)
        self.most = np.maximum(np.abs(low), np.abs(high)) + self.step

    def cells(self, v: np.ndarray) -> list[bytes]:
        """The packed cells of each vector."""
        cell = np.clip(np.rint((v - self.low) / self.step), 0, (1 << self.bits) - 1).astype(np.uint8)
        bits = np.unpackbits(cell[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(v), -1), axis=1)]

    def centres(self, packed: list[bytes]) -> np.ndarray:
        """The middles of packed cells."""
        dim = len(self.low)
        bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, : dim * self.bits]
        weights = 1 << np.arange(self.bits)[::-1]
        return self.low + (bits.reshape(len(packed), dim, self.bits) @ weights) * self.step

    def width(self, queries: np.ndarray) -> np.ndarray:
        """How far a score may lie from the product with a cell's middle, for each query."""
        return np.abs(queries) @ (self.step / 2 + ROUNDING * self.most)


def scan(grid: Grid, ids: np.ndarray, keys: np.ndarray, centres: np.ndarray, query_ids: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int) -> dict[str, list]:
    """The candidates of a block that may be among the `k` best of each query: keys, and bounds of their scores."""
    out: dict[str, list] = {"query_key": [], "query_id": [], "vec_key": [], "low": [], "high": []}
    for at in range(0, len(queries), HELD):
        middle = queries[at : at + HELD] @ centres.T
        for row, own, key, width in zip(middle, query_ids[at : at + HELD], query_keys[at : at + HELD], grid.width(queries[at : at + HELD]), strict=True):
            others = np.flatnonzero(ids != own)
            if len(others) > k:
                kth = np.partition(row[others], -k)[-k]
                others = others[row[others] + width >= kth - width]
            out["query_key"] += [int(key)] * len(others)
            out["query_id"] += [int(own)] * len(others)
            out["vec_key"] += keys[others].tolist()
            out["low"] += (row[others] - width).tolist()
            out["high"] += (row[others] + width).tolist()
    return out


def product(a: list[float], b: list[float]) -> int:
    """The inner product of integers held as doubles, exactly; raises if a long cannot hold it."""
    if max(map(abs, a)) * max(map(abs, b)) * len(a) < 2.0**53:
        return int(np.dot(a, b))
    exact = sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    if not -(1 << 63) <= exact < 1 << 63:
        raise OverflowError("a score does not fit a long")
    return exact


def search(df: DataFrame, is_query: Column, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id, rank (from 1), vec_id, score long`: the `k` highest integer inner products of floor(scale * x).

    Queries are the rows where `is_query` holds, candidates every row with another id. Null ids, and vectors that are
    null, empty or hold null or non-finite components take no part; only vectors of one length are compared. A repeated
    row of the same id and vector counts once. Ties go to the smaller id. Fewer than `k` candidates: all of them. An
    empty table gives an empty result; other columns are not read. A score that a long cannot hold raises.
    """
    rows = blocks.single(df, is_query, id_col, vector_col, zero=True)
    scaled = lambda x: F.when(F.abs(x * scale) < WHOLE, F.floor(x * scale).cast("double")).otherwise(x * scale)
    whole = cut(rows.withColumn("v", F.transform("v", scaled)))
    grids = {dim: Grid(low, high) for dim, low, high in _ranges(whole)}  # one for each length of vectors

    def quantise(batch: dict[str, list]) -> dict[str, list]:
        cells: dict[int, list[bytes]] = {dim: grids[dim].cells(np.array([v for v in batch["v"] if len(v) == dim]))[::-1] for dim in set(batch["dim"])}
        return {n: batch[n] for n in ("key", "id", "dim")} | {"cells": [cells[dim].pop() for dim in batch["dim"]]}

    file = cut(map_batches(whole.select("key", "id", "dim", "v"), quantise, "key long, id long, dim int, cells binary"))
    queries = whole.where("asks").select("key", "id", "dim", "v")

    def build(table: pa.Table) -> blocks.Index:
        grid = grids[table["dim"][0].as_py()]
        ids, keys, centres = table["id"].to_numpy(), table["key"].to_numpy(), grid.centres(table["cells"].to_pylist())
        return lambda asked: scan(grid, ids, keys, centres, asked["id"].to_numpy(), asked["key"].to_numpy(), blocks.matrix(asked["v"]), k)

    bounds = "query_key long, query_id long, vec_key long, low double, high double"
    none = F.lit(None).cast("binary").alias("cells"), F.lit(None).cast("array<double>").alias("v")
    kept = cut(blocks.ask(file.select("key", "id", "dim", "cells", none[1]), queries.select("key", "id", "dim", none[0], "v"), build, bounds))

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("high").desc(), "vec_key", "query_key"))
    first = kept.withColumn("place", place).where(F.col("place") <= k).drop("place")
    begun = cut(_read(first, whole))
    sure = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_key", "query_key"))
    kth = begun.withColumn("place", sure).where(F.col("place") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    # A score as a double may be rounded; the bound is compared a little below it.
    open_ = kept.join(kth, "query_id").where(F.col("high") >= F.col("kth") - F.abs("kth") * ROUNDING)
    rest = open_.join(begun.select("query_key", "vec_key"), ["query_key", "vec_key"], "left_anti").drop("kth")
    return blocks.best(begun.unionByName(_read(rest, whole)), k, F.col("score").desc())


def _ranges(whole: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The length, least and greatest components of the vectors of each length."""

    def extremes(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"dim": [], "low": [], "high": []}
        for dim in set(map(len, batch["v"])):
            v = np.array([x for x in batch["v"] if len(x) == dim])
            for name, x in (("dim", dim), ("low", v.min(axis=0).tolist()), ("high", v.max(axis=0).tolist())):
                out[name].append(x)
        return out

    found = map_batches(whole.select("v"), extremes, "dim int, low array<double>, high array<double>")
    parts = found.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    joined = parts.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("x"))
    return [(r["dim"], np.array([x["low"] for x in r["x"]]), np.array([x["high"] for x in r["x"]])) for r in joined.collect()]


def _read(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """`query_key, query_id, vec_key, vec_id, score` of pairs of keys, by their exact vectors."""
    vectors = whole.select(F.col("key").alias("vec_key"), F.col("id").alias("vec_id"), F.col("v").alias("b"))
    asked = whole.where("asks").select(F.col("key").alias("query_key"), F.col("v").alias("a"))
    both = pairs.join(vectors, "vec_key").join(asked, "query_key").select("query_key", "query_id", "vec_key", "vec_id", "a", "b")

    def score(batch: dict[str, list]) -> dict[str, list]:
        return {n: batch[n] for n in ("query_key", "query_id", "vec_key", "vec_id")} | {"score": [product(a, b) for a, b in zip(batch["a"], batch["b"], strict=True)]}

    return map_batches(both, score, "query_key long, query_id long, vec_key long, vec_id long, score long")
