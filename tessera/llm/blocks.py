"""A stated query set against all rows, in bounded blocks: the frame that both vector searches run in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_groups

#: Rows of a block of candidates and of a lot of queries: a task holds one of each, about 20 MB at 128 dimensions.
CANDIDATE_ROWS = 16384
QUERY_ROWS = 2048

#: What a block of candidates is made into once: each lot of queries is then asked of it.
Index = Callable[[pa.Table], dict[str, list]]


def usable(vector: str, zero: bool) -> Column:
    """Vectors that take part: not null or empty, every component finite, and not all zero unless `zero`."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return kept if zero else kept & F.exists(vector, lambda x: x != 0)


def single(df: DataFrame, is_query: Column, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """`key, id, dim, v array<double>, asks` of the rows that take part, each pair of id and vector once."""
    whole = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = whole.where(F.col("id").isNotNull() & usable("v", zero)).withColumns({"key": F.xxhash64("id", "v"), "dim": F.size("v")})
    return kept.groupBy("key").agg(*(F.first(c).alias(c) for c in ("id", "dim", "v")), F.max("asks").alias("asks"))


def ask(candidates: DataFrame, queries: DataFrame, build: Callable[[pa.Table], Index], schema: str) -> DataFrame:
    """Every query against every candidate of its `dim`; both have the same columns, among them `dim` and a unique `key`.

    Candidates are dealt by key into blocks of bounded size, each row once. Queries go to every block in lots of bounded
    size: they are a stated set. A task builds a block's index once and then streams the lots through it.
    """
    n, q = candidates.count(), queries.count()
    blocks, lots = max(1, ceil(n / CANDIDATE_ROWS)), max(1, ceil(q / QUERY_ROWS))
    held = candidates.withColumns({"block": F.pmod("key", F.lit(blocks)), "lot": F.lit(0).cast("long")})
    asked = queries.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "lot": 1 + F.pmod(F.xxhash64("key"), F.lit(lots))})
    index: dict[tuple, Index] = {}

    def group(at: tuple, slices: list[pa.RecordBatch]) -> Iterable[dict[str, list]]:
        table = pa.Table.from_batches(slices).combine_chunks()
        if at[2] == 0:
            index.clear()
            index[at[:2]] = build(table)
        elif at[:2] in index:
            yield index[at[:2]](table)

    return map_groups(held.unionByName(asked), ["dim", "block", "lot"], group, schema, dealt_by=["dim", "block"])


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The first `k` of each query in order of `score`, ties to smaller ids: `query_id, rank (from 1), vec_id, score`."""
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length by rows."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
