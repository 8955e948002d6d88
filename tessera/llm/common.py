"""Shared pieces: table access, lineage cuts, Arrow mapping, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lineage import cut, release

#: Rows and bytes of an Arrow batch sent to Python: they bound a worker's memory when rows are long.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of a batch given to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def struct_lists(column: pa.ListArray) -> list[dict[str, np.ndarray] | None]:
    """Lists of structs of numbers without nulls as numpy views by field, none for a null or empty list: a batch within
    BATCH_BYTES can hold millions of structs, for which Python objects would take some thirty times the bytes."""
    at, rows = column.offsets.to_pylist(), column.values
    fields = {f.name: rows.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(rows.type)}
    return [{n: x[a:b] for n, x in fields.items()} if b > a else None for a, b in zip(at, at[1:], strict=False)]


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str, structs: tuple[str, ...] = ()) -> DataFrame:
    """Apply `fn` to each batch: columns as Python lists in, columns as lists out. One batch is held at a time.

    The columns that `structs` names come as `struct_lists`.
    """
    spark = df.sparkSession
    set_batches(spark)
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: struct_lists(batch.column(i)) if n in structs else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, fn: Callable[[list], list[bool]]) -> DataFrame:
    """Rows of `df` whose `column` values `fn` accepts. Python sees that column only; the batches pass through."""
    set_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(fn(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, list[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str, dealt_by: list[str] | None = None) -> DataFrame:
    """Stream groups of rows with equal `keys`: `fn(key, slices)` is called once per group with zero-copy batch slices.

    Rows are dealt by hash of the keys (or of the first of them, `dealt_by`) and sorted, so a task holds one group at a
    time, in order of the keys. Callers bound a group's size.
    """
    spark = df.sparkSession
    set_batches(spark)
    arrow = _arrow_schema(spark, schema)
    dealt = df.repartition(*(dealt_by or keys))

    def emit(outs: Iterable[dict[str, list]]) -> Iterator[pa.RecordBatch]:
        for out in outs:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            rows = list(zip(*cols, strict=True))
            start = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i] != rows[start]:
                    if held and rows[start] != now:
                        yield from emit(fn(now, held))
                        held = []
                    now = rows[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from emit(fn(now, held))

    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(ddl)
    try:
        return to_arrow_schema(parsed, timezone="UTC", prefers_large_types=False)
    except TypeError:
        return to_arrow_schema(parsed)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a long, b long)`: `node long, component long`, the smallest id reachable.

    Alternating large-star and small-star steps; every step is a pre-aggregated group-by and an equi-join, the driver
    sees one row per round. Nodes without edges are not in the result. Empty input gives an empty result.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    context = edges.sparkSession.sparkContext
    while True:
        # A star forest is the fixed point: each node hangs once and no root hangs itself.
        hung = now.select("v", F.lit(1).alias("hangs")).unionByName(now.select(F.col("u").alias("v"), F.lit(0).alias("hangs")).distinct())
        per_node = hung.groupBy("v").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("root"))
        if per_node.where("n > 1 or (n = 1 and root = 0)").limit(1).count() == 0:
            break
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Written aside, so that both sides of the join are plain exchanges, whose hot partitions Spark can split.
        near = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m")))
        large = cut(both.join(near, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")))
        hooks = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        before = now
        now = cut(hooks.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        release(context, before, near, large, least)
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
