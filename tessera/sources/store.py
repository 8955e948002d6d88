"""A stored index: one Parquet folder for each table and a manifest, written last, that makes it valid."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import StoreError

VERSION = 1
MANIFEST = "_manifest"
#: Sort keys within the files of a table: filters on them skip row groups.
SORTED = {"lines": ["file_id", "line_number"], "symbols": ["name", "symbol_id"], "terms": ["term"], "edges": ["to_id"], "norms": ["file_id", "line_number"], "idf": ["term"]}


def save(spark: SparkSession, tables: dict[str, DataFrame], directory: str, root: str, fragments: int) -> None:
    """Write `tables` below `directory`; an older index there stays valid until its manifest is gone."""
    delete(spark, directory, tables_too=False)
    for name, df in tables.items():
        keys = SORTED.get(name)
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{directory}/{name}")
    manifest = json.dumps({"version": VERSION, "root": root, "tables": sorted(tables), "fragments": fragments})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/{MANIFEST}")


def exists(spark: SparkSession, directory: str) -> bool:
    """Whether a manifest is there."""
    return _exists(spark, f"{directory}/{MANIFEST}/_SUCCESS")


def manifest(spark: SparkSession, directory: str) -> dict:
    """The manifest; raises if it is missing or of another version."""
    if not exists(spark, directory):
        raise StoreError(f"no index in {directory}")
    found = json.loads(spark.read.text(f"{directory}/{MANIFEST}").first()["value"])
    if found.get("version") != VERSION:
        raise StoreError(f"index of version {found.get('version')}, not {VERSION}")
    return found


def load(spark: SparkSession, directory: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of a stored index."""
    found = manifest(spark, directory)
    return {name: spark.read.parquet(f"{directory}/{name}") for name in found["tables"]}, found


def delete(spark: SparkSession, directory: str, tables_too: bool = True) -> None:
    """Delete an index, or its manifest only."""
    path = _path(spark, directory if tables_too else f"{directory}/{MANIFEST}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
