"""Approximate nearest neighbours by low-dimensional stable projections indexed by a kd-tree.

Gaussian projections keep distances: the squared projected distance over the squared distance follows a chi-square law
with as many degrees of freedom as projections. A query takes its neighbours in the projected space one by one in order
of distance, the boxes of the tree opened only as far as that order asks; each is verified on its original vector, and
the query stops when a nearer point than the kth found would with high probability have been seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.common import cut

#: Projections (even, so that the chi-square law has a closed form), rows of a leaf, leaves opened first.
PROJECTIONS = 16
LEAF = 64
FIRST = 2
#: Relative width within which products decide which distances are computed exactly.
ROUNDING = 1e-9
#: Probability that a nearer point would have been seen, at which a query stops.
CERTAINTY = 0.95


def chi_square(x: float, freedom: int) -> float:
    """Distribution function of the chi-square law for an even number of degrees of freedom."""
    if x >= 1400:
        return 1.0
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - exp(-x / 2) * total


@lru_cache(maxsize=16)
def quantile(certainty: float, freedom: int) -> float:
    """Where the distribution function reaches `certainty`."""
    low, high = 0.0, 1400.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < certainty else (low, middle)
    return high


def projection(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    """The same Gaussian matrix in every task."""
    return np.random.default_rng([20, dim, m]).standard_normal((dim, m))


class Tree:
    """A kd-tree over projected points: split at the median of the widest side until a leaf holds few rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.squares = points, (points * points).sum(axis=1)
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            side = np.ptp(points[rows], axis=0).argmax()
            half = len(rows) // 2
            order = np.argpartition(points[rows, side], half)
            stack += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in self.leaves])

    def neighbours(self, point: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All rows in order of their squared distance from `point`, with these distances, in growing batches.

        Leaves are opened in order of the distance of their boxes; a row is given once no box still closed is nearer.
        """
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        far, own = (gap * gap).sum(axis=1), float(point @ point)
        order = np.argsort(far, kind="stable")
        far = np.append(far[order], np.inf)
        rows, distance, opened, size = np.empty(0, np.int64), np.empty(0), 0, LEAF
        while opened < len(order):
            more = np.concatenate([self.leaves[i] for i in order[opened : opened + FIRST + opened // 3]])
            opened = min(len(order), opened + FIRST + opened // 3)
            away = np.maximum(0, self.squares[more] - 2 * (self.points[more] @ point) + own)
            rows, distance = np.concatenate([rows, more]), np.concatenate([distance, away])
            ready = distance <= far[opened]
            given = np.flatnonzero(ready)[np.argsort(distance[ready], kind="stable")]
            while len(given):
                now, given = given[:size], given[size:]
                size += size // 3
                yield rows[now], distance[now]
            rows, distance = rows[~ready], distance[~ready]


class Points:
    """A block of vectors indexed by its projections. Equal vectors are one point with its k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, certainty: float = CERTAINTY):
        self.k = k
        order = np.lexsort((ids, *v.T[::-1]))
        ids, v = ids[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]).any(axis=1)]))
        ends = np.minimum(np.append(first[1:], len(ids)), first + k + 1)
        self.ids = [ids[a:b] for a, b in zip(first, ends, strict=True)]
        self.points = v[first]
        self.squares = (self.points**2).sum(axis=1)
        self.matrix = projection(v.shape[1])
        self.enough = quantile(certainty, self.matrix.shape[1])
        self.tree = Tree(self.points @ self.matrix)
        self.verified = 0

    def nearest(self, own: int, q: np.ndarray) -> list[tuple[float, int]]:
        """Distance and id of the nearest found, nearest first."""
        best: list[tuple[float, int]] = []
        own_square = float(q @ q)
        for rows, projected in self.tree.neighbours(q @ self.matrix):
            all_seen = False
            if len(best) == self.k:
                # A point this far in the projected space would, if nearer than the kth, have come before: stop there.
                stop = np.searchsorted(projected, max(self.enough * best[-1][0] ** 2, np.finfo(float).tiny))
                rows, all_seen = rows[:stop], stop < len(rows)
            self.verified += len(rows)
            square = self.squares[rows] - 2 * (self.points[rows] @ q) + own_square
            slack = ROUNDING * (self.squares[rows] + own_square)
            limit = best[-1][0] ** 2 if len(best) == self.k else np.partition(square, self.k)[self.k] + slack.max() if len(rows) > self.k else np.inf
            near = rows[square - slack <= limit]
            distance = np.sqrt(((self.points[near] - q) ** 2).sum(axis=1))
            best = sorted([*best, *((float(d), int(i)) for d, j in zip(distance, near, strict=True) for i in self.ids[j] if i != own)])[: self.k]
            if all_seen:
                break
        return best


def search(df: DataFrame, is_query: Column, k: int, certainty: float = CERTAINTY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`query_id, rank (from 1), vec_id, score double`: the `k` nearest found by Euclidean distance in double precision.

    Queries are the rows where `is_query` holds, candidates every row with another id; every row is indexed. Null ids,
    and vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of one
    length are compared. A repeated row of the same id and vector counts once. Ties go to the smaller id. Fewer than
    `k` candidates: all of them. An empty table gives an empty result; other columns are not read.
    """
    rows = cut(blocks.single(df, is_query, id_col, vector_col, zero=False))

    def build(table: pa.Table) -> blocks.Index:
        points = Points(table["id"].to_numpy(), blocks.matrix(table["v"]), k, certainty)

        def ask(queries: pa.Table) -> dict[str, list]:
            found = [(own, i, d) for own, q in zip(queries["id"].to_pylist(), blocks.matrix(queries["v"]), strict=True) for d, i in points.nearest(own, q)]
            return dict(zip(("query_id", "vec_id", "score"), zip(*found, strict=True) if found else ((), (), ()), strict=True))

        return ask

    columns = ["key", "id", "dim", "v"]
    found = blocks.ask(rows.select(*columns), rows.where("asks").select(*columns), build, "query_id long, vec_id long, score double")
    return blocks.best(found, k, F.col("score").asc())
