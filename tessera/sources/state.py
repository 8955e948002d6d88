"""Snapshots of files, their differences, and change records applied to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_state(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """`path, content_hash` of each file; a null text is hashed as empty."""
    return files.select(F.col(path_col).alias("path"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("content_hash"))


def quick_state(files: DataFrame) -> DataFrame:
    """`path, content_hash` by size and time only: no content is read; a change within a second that keeps the size is missed."""
    return files.select("path", F.xxhash64("size_bytes", "modified_at").cast("string").alias("content_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """`path, op`: created, modified and deleted paths between two states; unchanged paths have no row."""
    joined = old.select("path", F.col("content_hash").alias("_old")).join(new.select("path", F.col("content_hash").alias("_new")), "path", "full_outer")
    op = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return joined.select("path", op.alias("op")).where("op is not null")


def files_changed(old: DataFrame, new: DataFrame) -> bool:
    """Whether two states differ: stops at the first difference."""
    return diff(old, new).limit(1).count() > 0


def changed_since(seen: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of `current` whose (path, content_hash) was not seen."""
    return current.join(seen.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")


def last_changes(changes: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The last change of each key: replaying a batch changes nothing."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(key, *[F.col("_last")[c].alias(c) for c in rest]).select(*changes.columns)


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """`table` after `changes(key, op, seq, ...)`: deleted and modified rows leave, the last state of the others joins."""
    last = last_changes(changes, key, seq)
    kept = table.join(last.select(key), key, "left_anti").select(*table.columns)
    return kept.unionByName(last.where("op <> 'deleted'").select(*table.columns))
