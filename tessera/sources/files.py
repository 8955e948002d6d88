"""Source trees and document tables as one `files` frame: `file_id, path, language, size_bytes, line_count, modified_at,
is_binary, is_generated, is_vendor, text`."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import RepositoryError
from tessera.functions.text import LANGUAGES, language_of
from tessera.sources.ignore import compile_rules, ignored

# Directories that are never entered.
EXCLUDED = ("target", "node_modules", "dist", "build", ".git", ".svn", "__pycache__", ".next", ".nuxt", ".cache", ".parcel-cache", "coverage", ".turbo")
COLUMNS = ["file_id", "path", "language", "size_bytes", "line_count", "modified_at", "is_binary", "is_generated", "is_vendor", "text"]
#: Bytes at the start of a file in which a NUL makes it binary.
HEAD = 8192
#: Bytes of file content that a task reads.
TASK_BYTES = 32 << 20


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """Relative path, size and time of the source files of a local tree, in order of path: hidden and excluded
    directories and whatever ignore files rule out are not entered; other extensions are left out."""
    top = Path(root)

    def visit(directory: Path, rules: list) -> Iterator[tuple[str, int, int]]:
        relative = "" if directory == top else f"{directory.relative_to(top).as_posix()}/"
        for name in (".gitignore", ".ignore", *((".git/info/exclude",) if directory == top else ())):
            if (directory / name).is_file():
                rules = [*rules, *compile_rules((directory / name).read_text(errors="replace"), relative)]
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            path = relative + entry.name
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            if entry.is_dir():
                if entry.name not in EXCLUDED and not ignored(path, True, rules):
                    yield from visit(Path(entry.path), rules)
            elif entry.is_file() and entry.name.rpartition(".")[2].lower() in LANGUAGES and "." in entry.name and not ignored(path, False, rules):
                stat = entry.stat()
                yield path, stat.st_size, int(stat.st_mtime)

    yield from visit(top, [])


def open_tree(spark: SparkSession, root: str) -> DataFrame:
    """The files of a tree. Local trees are listed on the driver (names and sizes only) and read by the executors, which
    must see the same folder; a URI of another store is read by Spark's binary source, which hides names that begin
    with `_` or `.`."""
    if "://" in root and not root.startswith("file://"):
        return _open_store(spark, root)
    path = os.path.realpath(root.removeprefix("file://"))
    if not os.path.isdir(path):
        raise RepositoryError(f"not a directory: {root}")
    listed = sorted(walk(path))
    total = sum(size for _, size, _ in listed)
    rows = spark.createDataFrame(pa.table({"file_id": pa.array(range(len(listed)), pa.int64()), "path": pa.array([r[0] for r in listed], pa.string()), "modified_at": pa.array([r[2] for r in listed], pa.int64())}))
    parts = max(1, min(len(listed), total // TASK_BYTES + 1, 4096))
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("modified_at", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    content = Path(path, row["path"]).read_bytes()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pylist([row | {"content": content}], schema)

    return described(rows.repartition(parts).mapInArrow(read, "file_id long, path string, modified_at long, content binary"))


def _open_store(spark: SparkSession, root: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, position('{base.split('://', 1)[1].split('/', 1)[-1]}' in path) + {len(base.split('://', 1)[1].split('/', 1)[-1])})")
    excluded = "|".join(d.replace(".", r"\.") for d in EXCLUDED)
    rows = found.select(relative.alias("path"), F.unix_timestamp("modificationTime").alias("modified_at"), "content")
    rows = rows.where(~F.col("path").rlike(rf"(^|/)(?:{excluded})/") & ~F.col("path").rlike(r"(^|/)\.") & (language_of(F.col("path")) != "unknown"))
    # Paths only: their order numbers the files.
    ids = rows.select("path").distinct().withColumn("file_id", F.row_number().over(Window.orderBy("path")).cast("long") - 1)
    return described(rows.join(ids, "path").select("file_id", "path", "modified_at", "content"))


def described(raw: DataFrame) -> DataFrame:
    """`files` from `file_id, path, modified_at, content binary`. Broken UTF-8 is replaced in `text`; lines are line
    feeds plus one."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = raw.withColumn("text", text)
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    generated = name.endswith(".gen.rs") | name.endswith(".pb.rs") | F.contains(name, F.lit(".generated."))
    vendor = F.col("path").rlike(r"(^|/)[^/]*vendor[^/]*(/|$)")
    binary = F.contains(F.expr(f"substring(content, 1, {HEAD})"), F.lit(b"\0"))
    return rows.select("file_id", "path", language_of(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), lines.cast("int").alias("line_count"), "modified_at", binary.alias("is_binary"), generated.alias("is_generated"), vendor.alias("is_vendor"), "text")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan over all cores: dealt anew only if it has fewer partitions than there are cores, which a large input
    never has, so that no large text is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def searchable(files: DataFrame) -> DataFrame:
    """Files whose content is searched and scanned: vendored and binary ones are only counted."""
    return files.where("not is_binary and not is_vendor")
