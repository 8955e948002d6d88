"""Lines of files and the searches over them. Everything is a projection of the file scan: no shuffle but for caps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import octets

MODES = ("exact", "case_insensitive", "identifier", "word", "regex")
#: Lines whose lengths are summed at once for offsets: two short sums for each line, whatever the file's length.
STRIDE = 32
MAX_RESULTS = 1000


def lines(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """`file_id, line_number (from 1), line, start_byte, end_byte`: lines without their terminators.

    Offsets are of the bytes as stored: a carriage return before the line feed belongs to no line but is counted. A last
    empty line is none. They are prefix sums within the row, in two levels, so that no window shuffles the texts.
    """
    parts = F.split(F.col("text"), "\n")
    raw = files.select(files[id_col].cast("long").alias("file_id"), files[text_col].alias("text")).where("text is not null and text <> ''")
    raw = raw.select("file_id", parts.alias("parts"))
    raw = raw.select("file_id", F.when(F.element_at("parts", -1) == "", F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts")).alias("parts"))
    raw = raw.withColumn("sizes", F.transform("parts", lambda p: (octets(p) + 1).cast("long")))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    strides = F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / STRIDE).cast("int"))
    raw = raw.withColumn("sums", F.transform(strides, lambda c: F.aggregate(F.slice("sizes", c * STRIDE + 1, F.lit(STRIDE)), zero, add)))
    # Both mentions of the sums keep the optimiser from computing them anew for every stride.
    known = F.sequence(F.lit(0), F.size("sums") - 1)
    raw = raw.withColumn("starts", F.transform(known, lambda c: F.aggregate(F.slice("sums", F.lit(1), c), zero, add)))
    start = lambda i: F.get("starts", F.floor(i / STRIDE).cast("int")) + F.aggregate(F.slice("sizes", F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE), zero, add)
    rows = F.transform("parts", lambda p, i: F.struct((i + 1).alias("line_number"), p.alias("raw"), start(i).alias("start_byte")))
    out = raw.select("file_id", F.inline(rows))
    line = F.when(F.col("raw").endswith("\r"), F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(F.col("raw"))
    out = out.select("file_id", "line_number", line.alias("line"), "start_byte")
    return out.withColumn("end_byte", F.col("start_byte") + octets(F.col("line")))


def matches(line: Column, pattern: str, mode: str = "exact") -> Column:
    """Whether a line matches. Identifier compares blank-separated tokens, word looks at word ends; a pattern that is no
    regular expression matches nothing."""
    if mode == "exact":
        return F.contains(line, F.lit(pattern))
    if mode == "case_insensitive":
        return F.contains(F.lower(line), F.lower(F.lit(pattern)))
    if mode == "identifier":
        return F.array_contains(F.split(line, r"\s+"), pattern)
    if mode == "word":
        return line.rlike(rf"(?U)(?<!\w){_quoted(pattern)}(?!\w)")
    if mode == "regex":
        return line.rlike(f"(?U){pattern}") if valid_regex(pattern) else F.lit(False)
    raise ValueError(f"mode must be one of {', '.join(MODES)}")


def _quoted(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def valid_regex(pattern: str) -> bool:
    """Whether the JVM compiles a pattern (else Python's verdict, where no session runs)."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None:
        try:
            return bool(re.compile(pattern))
        except re.error:
            return False
    try:
        session._jvm.java.util.regex.Pattern.compile(f"(?U){pattern}")
    except Exception:
        return False
    return True


def search(all_lines: DataFrame, pattern: str, mode: str = "exact", file_ids: list[int] | DataFrame | None = None, max_results: int = MAX_RESULTS, max_files: int = 10) -> DataFrame:
    """Matching lines, at most min(max_results, 100 * max_files) for each file, the first by line."""
    return search_many(all_lines, {0: (pattern, mode)}, file_ids, max_results, max_files).drop("query_id")


def search_many(all_lines: DataFrame, queries: dict[int, tuple[str, str]], file_ids: list[int] | DataFrame | None = None, max_results: int = MAX_RESULTS, max_files: int = 10) -> DataFrame:
    """`query_id` and matching lines for a stated set of (pattern, mode): one pass over the lines for all queries."""
    chosen = all_lines
    if isinstance(file_ids, DataFrame):
        chosen = chosen.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    elif file_ids is not None:
        chosen = chosen.where(F.col("file_id").isin([int(i) for i in file_ids]))
    line = F.col("line")
    hit = F.array(*[F.when(matches(line, p, m), F.lit(q).cast("long")) for q, (p, m) in queries.items()])
    found = chosen.withColumn("query_id", F.explode(F.array_compact(hit)))
    cap = min(max_results, 100 * max_files)
    order = Window.partitionBy("query_id", "file_id").orderBy("line_number")
    capped = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    return capped.select("query_id", *all_lines.columns)


def summary(found: DataFrame) -> DataFrame:
    """Matches and files with matches, by query."""
    return found.groupBy("query_id").agg(F.count("*").alias("matches"), F.countDistinct("file_id").alias("files"))


def source_slice(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """`ranges` (file_id, start_byte, end_byte) with `source`: their bytes as text; null out of range or for broken UTF-8."""
    content = files.select("file_id", F.encode("text", "UTF-8").alias("content"))
    piece = F.expr("substring(content, int(start_byte + 1), int(end_byte - start_byte))")
    inside = (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("content"))
    joined = ranges.join(content, "file_id").withColumn("_piece", F.when(inside, piece))
    return joined.withColumn("source", F.when(F.is_valid_utf8(F.col("_piece").cast("string")), F.decode("_piece", "UTF-8"))).drop("content", "_piece")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Overlapping and touching ranges of a file as one: `file_id, start_byte, end_byte, start_line, end_line`."""
    order = Window.partitionBy("file_id").orderBy("start_byte", "end_byte", "start_line", "end_line")
    reach = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach >= F.col("start_byte"), 0).otherwise(1))
    grouped = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("file_id", "_island").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    return out.drop("_island")
