"""Symbols and calls of files as tables: the scanner runs over Arrow batches, ids are made from file and start."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import symbol_id
from tessera.sources.scanner import scan

ROWS = "array<struct<is_call:boolean,name:string,kind:string,start:long,end:long,start_line:int,end_line:int,parent:long,parent_name:string,callee:string>>"
_FIELDS = [("is_call", pa.bool_()), ("name", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parent", pa.int64()), ("parent_name", pa.string()), ("callee", pa.string())]


def extract(files: DataFrame) -> DataFrame:
    """`file_id, path` with one row for each symbol and call: positions of parents and callers within the file."""
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("rows", pa.list_(pa.struct(_FIELDS)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                symbols, calls = scan((text or "").encode("utf-8", "surrogatepass"), language or "")
                rows = []
                for s in symbols:
                    owner = symbols[s.parent] if s.parent is not None else None
                    rows.append({"is_call": False, "name": s.name, "kind": s.kind, "start": s.start, "end": s.end, "start_line": s.start_line, "end_line": s.end_line, "parent": owner.start if owner else None, "parent_name": owner.name if owner else None, "callee": None})
                for c in calls:
                    caller = symbols[c.caller] if c.caller is not None else None
                    owner = symbols[caller.parent] if caller and caller.parent is not None else None
                    rows.append({"is_call": True, "name": caller.name if caller else None, "kind": None, "start": c.start, "end": c.end, "start_line": c.start_line, "end_line": c.end_line, "parent": caller.start if caller else None, "parent_name": owner.name if owner else None, "callee": c.callee})
                if rows:
                    yield pa.RecordBatch.from_pylist([{"file_id": file_id, "path": path, "rows": rows}], schema)

    source = files.select(F.col("file_id").cast("long"), "path", "language", "text")
    return source.mapInArrow(run, f"file_id long, path string, rows {ROWS}").select("file_id", "path", F.inline("rows"))


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`symbols` and `calls` with global ids: a symbol's id is its file's id and its start."""
    file_id = F.col("file_id")
    place = [F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "start_line", "end_line"]
    above = F.when(F.col("parent").isNotNull(), symbol_id(file_id, F.col("parent")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    symbols = extracted.where("not is_call").select(symbol_id(file_id, F.col("start")).alias("symbol_id"), "name", "kind", "file_id", *place, above.alias("parent"), "parent_name", stem.alias("stem"), F.lit("Public").alias("visibility"), F.lit(None).cast("string").alias("signature"))
    calls = extracted.where("is_call").select("file_id", above.alias("caller"), F.col("name").alias("caller_name"), F.col("callee").alias("callee_name"), *place, "parent_name")
    return symbols, calls
