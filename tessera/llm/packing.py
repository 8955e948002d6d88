"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

Lengths are integers up to the capacity, so the documents are held as runs of equal length and the gaps as runs of equal
size: tables that the capacity bounds, whatever the number of documents. In a round
1. documents and gaps are sorted by size and dealt into ranges; a successor sweep of each range goes from large to small
   and matches each document with the smallest gap left that holds it;
2. documents that compete for a gap get it by rank; a sweep over all ranges settles the documents whose own range has no gap;
3. the gaps are updated, and the round repeats.
The longest documents take part first: rounds admit lengths from a threshold on, which falls when all of them are placed.
New sequences are opened only when no gap holds any admitted document, and only as many as those surely need.
The driver sees one row every ROUNDS rounds. Ranking documents within runs, cutting and placing are distributed joins and windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_batches, release
from tessera.llm.word_bpe import words

#: Rows of one length that one task ranks and places.
RANKED_ROWS = 1024
#: Ranges that a round sweeps beside one another.
RANGES = 8
#: Rounds between two looks of the driver.
ROUNDS = 2
#: Kinds of a run: documents left, gaps left, documents placed, gaps updated in this round.
DOCS, GAPS, PLACED, UPDATED = range(4)
RUN = "kind int, size long, first long, n long, each long, sequence long, used long"
Run = tuple[int, int, int, int, int, int, int]


def sweep(runs: list[Run], capacity: int) -> list[Run]:
    """Match runs of documents (`size, first rank, n`) with runs of gaps (`size, first sequence, n`), large to small.

    A gap takes as many documents of one run as it holds, and no other run before the next round. A placed run puts `each`
    documents of consecutive ranks one after the other from `used` into each of its sequences.
    """
    docs = sorted((r for r in runs if r[0] == DOCS), key=lambda r: (-r[1], r[2]))
    gaps = sorted((r for r in runs if r[0] == GAPS), key=lambda r: (r[1], -r[2]))
    out = [r for r in runs if r[0] in (PLACED, UPDATED)]
    open_gaps: list[tuple[int, int, int]] = []

    def place(length: int, rank: int, n: int, each: int, gap: int, first: int) -> None:
        out.append((PLACED, length, rank, n, each, first, capacity - gap))
        if gap > each * length:
            out.append((UPDATED, gap - each * length, first, n // each, 0, 0, 0))

    for _, length, rank, left, *_ in docs:
        while gaps and gaps[-1][1] >= length:
            open_gaps.append(gaps.pop()[1:4])
        while left and open_gaps:
            gap, first, count = open_gaps.pop()
            each = gap // length
            full = min(count, left // each)
            if full:
                place(length, rank, full * each, each, gap, first)
                rank, left = rank + full * each, left - full * each
            if left and full < count:
                place(length, rank, left, left, gap, first + full)
                left, full = 0, full + 1
            if full < count:
                open_gaps.append((gap, first + full, count - full))
        if left:
            out.append((DOCS, length, rank, left, 0, 0, 0))
    return out + [(GAPS, *gap, 0, 0, 0) for gap in open_gaps] + gaps


def plan(runs: DataFrame, capacity: int) -> DataFrame:
    """Place all of `runs(length, n)`: `length, first rank, n, each, sequence, used`, a table that the capacity bounds."""
    spark = runs.sparkSession
    fields = [f.split()[0] for f in RUN.split(", ")]

    def swept(table: pa.Table) -> pa.Table:
        rows = sweep(list(zip(*(table[f].to_pylist() for f in fields), strict=True)), capacity)
        types = table.select(fields).schema
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(fields), types.types, strict=True)], schema=types)

    none = [F.lit(0).cast("long").alias(f) for f in ("each", "sequence", "used")]
    state = cut(runs.select(F.lit(DOCS).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *none).coalesce(1))
    threshold, opened = capacity // 2, 0
    left = F.col("kind") == DOCS
    while True:
        admitted = left & (F.col("size") > threshold)
        row = state.agg(
            F.max(F.when(left, F.col("size"))).alias("longest"), F.max(F.when(F.col("kind") == GAPS, F.col("size"))).alias("gap"), F.min(F.when(admitted, F.col("size"))).alias("least"),
            F.sum(F.when(admitted, F.col("n"))).alias("n"), F.sum(F.when(admitted, F.col("n") * F.col("size"))).alias("tokens"),
        ).first()
        if row["longest"] is None:
            break
        if row["longest"] <= threshold:
            # Above a quarter of the capacity the order of lengths decides how full sequences get; below it hardly does.
            threshold = row["longest"] * 9 // 10 if row["longest"] * 4 > capacity else row["longest"] // 4
            continue
        now = state
        if (row["gap"] or 0) < row["least"]:
            fresh = max(-(-row["tokens"] // capacity), -(-row["n"] // (capacity // (threshold + 1))))
            now = now.unionByName(spark.range(1).select(F.lit(GAPS).alias("kind"), *(F.lit(x).cast("long").alias(f) for f, x in zip(fields[1:], (capacity, opened, fresh, 0, 0, 0), strict=True))))
            opened += fresh
        takes_part = admitted | (F.col("kind") == GAPS)
        settled = now.where(takes_part)
        for _ in range(ROUNDS):
            ranges = settled.groupBy(F.expr(f"int((size - 1) * {RANGES} div {capacity})")).applyInArrow(lambda key, table: swept(table), RUN)
            settled = ranges.groupBy().applyInArrow(lambda key, table: swept(table), RUN)
            settled = settled.withColumn("kind", F.when(F.col("kind") == UPDATED, GAPS).otherwise(F.col("kind")))
        state, before = cut(settled.unionByName(now.where(~takes_part)).coalesce(1)), state
        release(spark.sparkContext, before)
    return state.where(F.col("kind") == PLACED).select(F.col("size").alias("length"), "first", "n", "each", "sequence", "used")


def pack(pieces: DataFrame, capacity: int, order: list[Column], length_col: str = "length") -> DataFrame:
    """`pieces` with `sequence_id long` (from 0) and `offset long`: best fit of the longest first.

    `length_col` holds 1 to `capacity`; other lengths raise. Pieces of one length are told apart by `order`; repeated
    rows are placed each on its own. An empty table gives an empty result. Columns named like the added ones are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    own = [f"c{i}" for i in range(len(names))]
    by = [f"o{i}" for i in range(len(order))]
    rows = cut(pieces.select(*[pieces[c].alias(o) for c, o in zip(names, own, strict=True)], F.col(length_col).cast("long").alias("l"), *[c.alias(o) for c, o in zip(order, by, strict=True)]))
    checked = rows.agg(F.count("*").alias("n"), F.min("l").alias("least"), F.max("l").alias("most"), F.count("l").alias("known")).first()
    if checked["n"] and (checked["known"] < checked["n"] or checked["least"] < 1 or checked["most"] > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    runs = cut(rows.groupBy("l").agg(F.count("*").alias("run")))  # at most `capacity` rows
    made = plan(runs.select(F.col("l").alias("length"), F.col("run").alias("n")), capacity)

    # Ranks within a length: rows are dealt into lots of bounded size, numbered there, and shifted by the lots before.
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(runs), "l")
    dealt = numbered.withColumn("lot", F.pmod(F.xxhash64("row"), F.ceil(F.col("run") / RANKED_ROWS))).drop("run")
    counts = dealt.groupBy("l", "lot").agg(F.count("*").alias("held"))
    before = Window.partitionBy("l").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("l", "lot", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("l", "lot").orderBy(*by, "row")).cast("long") - 1)
    ranked = ranked.join(base, ["l", "lot"]).withColumn("rank", F.col("rank") + F.col("base")).drop("lot", "base", "row", *by)

    # Each document takes the last placed run that begins at or before its rank; runs are cut at the bounds of slots.
    slots = made.withColumn("slot", F.explode(F.expr(f"sequence(first div {RANKED_ROWS}, (first + n - 1) div {RANKED_ROWS})")))
    starts = slots.select(F.col("length").alias("l"), "slot", F.greatest(F.col("first"), F.col("slot") * RANKED_ROWS).alias("rank"), F.struct("first", "each", "sequence", "used").alias("at"))
    both = ranked.withColumn("slot", F.expr(f"rank div {RANKED_ROWS}")).withColumn("is_row", F.lit(1)).unionByName(starts.withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("l", "slot").orderBy("rank", "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("at", F.last("at", ignorenulls=True).over(upto)).where("is_row = 1").withColumn("step", F.col("rank") - F.col("at.first"))
    sequence = F.col("at.sequence") + F.expr("step div at.each")
    offset = F.col("at.used") + F.col("step") % F.col("at.each") * F.col("l")
    return placed.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], sequence.alias("sequence_id"), offset.alias("offset"))


def cut_pieces(lengths: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Start and length of the pieces of each document: whole, or cut at multiples of the capacity if longer."""
    return [[(s, min(capacity, n - s)) for s in range(0, n, capacity)] for n in lengths]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with `end_id`, cut those over `capacity`: `id_col, piece, start, length, ids binary`.

    `ids` are little-endian unsigned 32-bit integers. Null texts are empty ones: one piece of `end_id`. Null ids and
    repeated rows stay as they are. An empty table gives an empty result; other columns are not read.
    """
    return _pieces(docs, path, capacity, end_id, id_col, text_col, "ids binary", lambda ids: ids)


def piece_digests(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `token_pieces`, with the CRC-32 of the packed ids (`ids_crc32 long`) in their place."""
    return _pieces(docs, path, capacity, end_id, id_col, text_col, "ids_crc32 long", zlib.crc32)


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, field: str, fn: Callable) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("key", "piece", "start", "length", field.split()[0])}
        table = words(path)
        for key, text in zip(batch["key"], batch["text"], strict=True):
            packed = table.encode(text) + end
            for i, (start, length) in enumerate(cut_pieces([len(packed) // 4], capacity)[0]):
                row = (key, i, start, length, fn(packed[4 * start : 4 * (start + length)]))
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
        return out

    source = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    return map_batches(source, run, f"key {kind}, piece int, start long, length long, {field}").withColumnRenamed("key", id_col)
