"""Candidates, their ranks, and the greedy plan within a budget."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.text import compact, estimate_tokens, trim
from tessera.operators.graph import if_small
from tessera.sources.lineage import cut

#: Candidates without a text of their own, up to which the texts are not shuffled to them.
SMALL_CANDIDATES = 50_000


@dataclass(frozen=True)
class TokenBudget:
    """Limits of a plan."""

    max_tokens: int = 2000
    max_files: int = 10
    max_symbols: int = 20
    max_depth: int = 3

    def with_files(self, n: int) -> TokenBudget:
        return TokenBudget(self.max_tokens, n, self.max_symbols, self.max_depth)

    def with_symbols(self, n: int) -> TokenBudget:
        return TokenBudget(self.max_tokens, self.max_files, n, self.max_depth)

    def with_depth(self, n: int) -> TokenBudget:
        return TokenBudget(self.max_tokens, self.max_files, self.max_symbols, n)


def symbol_candidates(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols named like a query of the small set `queries(query_id, query)`."""
    found = symbols.join(F.broadcast(queries), symbols["name"] == queries["query"])
    return found.select("query_id", "query", F.lit(0).alias("source"), "symbol_id", "name", "kind", F.lit("References").alias("relationship"), "file_id", "start_byte", "end_byte", "start_line", "end_line", F.lit(0.0).alias("similarity"), F.lit(None).cast("string").alias("content"))


def lexical_candidates(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Lines that a search found, named by their trimmed text."""
    named = found.join(F.broadcast(queries), "query_id")
    return named.select("query_id", "query", F.lit(1).alias("source"), F.lit(None).cast("long").alias("symbol_id"), F.concat(F.lit("match:"), trim(F.col("line"))).alias("name"), F.lit("Variable").alias("kind"), F.lit(None).cast("string").alias("relationship"), "file_id", "start_byte", "end_byte", F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), F.lit(0.0).alias("similarity"), F.col("line").alias("content"))


def semantic_candidates(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Lines that a cosine search found, named by file and start."""
    named = found.join(F.broadcast(queries), "query_id")
    name = F.concat_ws(":", F.lit("semantic"), F.col("file_id"), F.col("start_byte"))
    return named.select("query_id", "query", F.lit(2).alias("source"), F.lit(None).cast("long").alias("symbol_id"), name.alias("name"), F.lit("Variable").alias("kind"), F.lit(None).cast("string").alias("relationship"), "file_id", "start_byte", "end_byte", F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), F.col("score").alias("similarity"), F.lit(None).cast("string").alias("content"))


def rank(candidates: DataFrame) -> DataFrame:
    """`candidates` with their components and `total`; the order is total, source, file, start, symbol."""
    parts = scores.components(F.col("name"), F.col("kind"), F.col("relationship"), F.col("query"), F.col("similarity"))
    ranked = candidates.withColumns(parts)
    return ranked.withColumn("total", scores.total({n: F.col(n) for n in parts}))


def order() -> list:
    """Rank order of candidates, without ties."""
    return [F.round("total", 9).desc(), F.col("source").asc(), F.col("file_id").asc(), F.col("start_byte").asc(), F.col("symbol_id").asc_nulls_last()]


def plan(ranked: DataFrame, files: DataFrame, budget: TokenBudget, compacting: bool = True) -> DataFrame:
    """The greedy plan of each query: `query_id, position, file_id, start_byte, end_byte, start_line, end_line, name, token_count, content`.

    In rank order: stop at `max_symbols`; skip a new file beyond `max_files`, a start already taken, and what has no
    text; what does not fit the rest of the budget is compacted to it, or skipped if that fails or `compacting` is off.
    The budget is hard. A query's candidates are sorted and streamed through its fold, which holds only its state;
    before that, candidates that no fold could take are cut: repeats of a range, and beyond the first `2 * max_symbols` of
    one size in one file (fewer than `max_symbols` find their start taken; as another is refused, so are all that follow). Lines bring their text; the rest of what is
    left is looked up in the files, without a shuffle of the texts while these are few.
    """
    first = Window.partitionBy("query_id", "file_id", "start_byte", "end_byte").orderBy(*order())
    single = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    size = F.col("end_byte") - F.col("start_byte")
    single = single.where(size >= 0).withColumn("_size", F.ceil(size / 4.0))
    if not compacting:
        single = single.where(F.col("_size") <= budget.max_tokens)
        alike = Window.partitionBy("query_id", "file_id", "_size").orderBy(*order())
        single = single.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= 2 * budget.max_symbols).drop("_n")
    keys = ["query_id", "total", "source", "file_id", "start_byte", "symbol_id", "end_byte", "start_line", "end_line", "name"]
    single = cut(single.select(*keys, "content"))
    texts = files.select("file_id", F.encode("text", "UTF-8").alias("_content"))
    sought = if_small(single.where("content is null").drop("content"), SMALL_CANDIDATES)
    slices = texts.join(sought, "file_id").where(F.col("end_byte") <= F.octet_length("_content"))
    content = F.decode(F.expr("substring(_content, int(start_byte + 1), int(end_byte - start_byte))"), "UTF-8")
    joined = single.where("content is not null").unionByName(slices.select(*keys, content.alias("content")))
    joined = joined.withColumn("token_count", estimate_tokens(F.col("content")))
    dealt = joined.repartition("query_id").sortWithinPartitions("query_id", *order())
    names = [*keys, "content", "token_count"]
    out = ["query_id", "position", "file_id", "start_byte", "end_byte", "start_line", "end_line", "name", "token_count", "content"]
    schema = pa.schema([(n, pa.string() if n in ("name", "content") else pa.int64()) for n in out])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            taken = []
            for row in batch.to_pylist():
                if state is None or row["query_id"] != now:
                    now, state = row["query_id"], Fold(budget, compacting)
                fragment = state.take(row)
                if fragment:
                    taken.append({n: fragment[n] for n in out})
            if taken:
                yield pa.RecordBatch.from_pylist(taken, schema)

    ddl = ", ".join(f"{n} {'string' if n in ('name', 'content') else 'long'}" for n in out)
    return dealt.select(*names).mapInArrow(fold, ddl)


class Fold:
    """State of one query's plan."""

    def __init__(self, budget: TokenBudget, compacting: bool):
        self.budget, self.compacting = budget, compacting
        self.used, self.n, self.files, self.starts = 0, 0, set(), set()

    def take(self, row: dict) -> dict | None:
        """The fragment made of a candidate, or None if it is refused."""
        left = self.budget.max_tokens - self.used
        if self.n >= self.budget.max_symbols or left <= 0 or row["content"] is None:
            return None
        if (row["file_id"], row["start_byte"]) in self.starts:
            return None
        if row["file_id"] not in self.files and len(self.files) >= self.budget.max_files:
            return None
        content, tokens = row["content"], row["token_count"]
        if tokens > left:
            content = compact(content, left) if self.compacting else None
            if content is None:
                return None
            tokens = -(-len(content.encode("utf-8", "surrogatepass")) // 4)
        self.used += tokens
        self.files.add(row["file_id"])
        self.starts.add((row["file_id"], row["start_byte"]))
        self.n += 1
        return row | {"content": content, "token_count": tokens, "position": self.n - 1}


def totals(fragments: DataFrame) -> DataFrame:
    """`query_id, total_tokens, total_files, total_symbols` of plans."""
    return fragments.groupBy("query_id").agg(F.sum("token_count").alias("total_tokens"), F.countDistinct("file_id").alias("total_files"), F.count("*").alias("total_symbols"))
