"""Term index over lines and sparse cosine search. The term table is the inverted list: written once, sorted by term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scores import reciprocal_rank
from tessera.functions.text import is_fragment, tokens

SMALLEST_NORM = 1e-10


@dataclass
class TermIndex:
    """`terms(file_id, line_number, start_byte, end_byte, term, tf)`, `idf(term, df, idf)`, `norms(file_id, line_number, norm)`, all fragments."""

    terms: DataFrame
    idf: DataFrame
    norms: DataFrame
    fragments: int


def fragments(lines: DataFrame) -> DataFrame:
    """Lines that the index keeps, as documents."""
    return lines.where(is_fragment(F.col("line")))


def term_counts(docs: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """`key, term, tf`: occurrences per hundred tokens of a text, rounded down, at least 1.

    Counted inside the row, as runs of its sorted tokens: no shuffle, and linear in the text but for the sort.
    """
    split = docs.select(*key, F.array_sort(tokens(F.col(text_col))).alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    first = lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1))
    runs = split.withColumn("starts", F.filter(F.sequence(F.lit(0), F.col("n") - 1), first))
    run = lambda at, i: F.struct(F.get("tokens", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.col("n")) - at).alias("c"))
    counted = runs.select(*key, "n", F.inline(F.transform("starts", run)))
    return counted.select(*key, "term", F.greatest(F.floor(F.col("c") * 100 / F.col("n")), F.lit(1)).cast("long").alias("tf"))


def build(lines: DataFrame) -> TermIndex:
    """Term counts, inverse document frequencies over all kept lines, and norms of lines."""
    docs = fragments(lines)
    terms = term_counts(docs, ["file_id", "line_number", "start_byte", "end_byte"], "line")
    return TermIndex(terms, frequencies(terms, docs.count()), norms(terms), docs.count())


def frequencies(terms: DataFrame, n: int) -> DataFrame:
    """`term, df, idf`: ln(n / df) + 1."""
    return terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")) + 1.0)


def norms(terms: DataFrame) -> DataFrame:
    """Root of the summed squares of a line's counts."""
    return terms.groupBy("file_id", "line_number").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))


def query_vectors(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """`query_id, term, weight, query_norm` of `queries(query_id, query)`; terms that no line has weigh nothing."""
    counted = term_counts(queries, ["query_id"], "query")
    weighted = idf.join(F.broadcast(counted), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    size = weighted.groupBy("query_id").agg(F.greatest(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), F.lit(SMALLEST_NORM)).alias("query_norm"))
    return weighted.select("query_id", "term", "weight").join(F.broadcast(size), "query_id")


def cosine_search(index: TermIndex, queries: DataFrame, limit: int = 100, weighting: str = "tf") -> DataFrame:
    """`query_id, file_id, line_number, start_byte, end_byte, score`: the `limit` most similar lines above 0.

    `queries(query_id, query)` is a small stated set; its vectors are broadcast. Lines are weighted by their counts, or
    by counts and frequencies with `weighting="tfidf"`. Ties go to the smaller file and start.
    """
    vectors = F.broadcast(query_vectors(queries, index.idf))
    hits = index.terms.join(vectors, "term")
    lengths = index.norms
    if weighting == "tfidf":
        heavy = index.terms.join(index.idf, "term").withColumn("tf", F.col("tf") * F.col("idf"))
        hits, lengths = heavy.drop("idf", "df").join(vectors, "term"), norms(heavy)
    key = ["query_id", "file_id", "line_number", "start_byte", "end_byte"]
    dots = hits.groupBy(*key, "query_norm").agg(F.sum(F.col("weight") * F.col("tf")).alias("dot"))
    scored = dots.join(lengths, ["file_id", "line_number"]).withColumn("score", F.col("dot") / (F.col("query_norm") * F.col("norm")))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "file_id", "start_byte")
    return scored.where("score > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(*key, "score")


def ranked_positions(found: DataFrame) -> DataFrame:
    """Matches with `position` from 0 in the order of file and line, by query: counts of files first, then lines within."""
    per_file = found.groupBy("query_id", "file_id").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("query_id").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("query_id", "file_id").orderBy("line_number")
    ranked = found.withColumn("_i", F.row_number().over(inside) - 1).join(base, ["query_id", "file_id"])
    return ranked.withColumn("position", F.col("_base") + F.col("_i")).drop("_base", "_i")


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = 100, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """Rank fusion by query, file and start: reciprocal lexical rank plus weighted similarity; the best `limit`.

    `query_id, file_id, start_byte, lexical_score, semantic_score, score`; ties go to the smaller file and start.
    """
    left = ranked_positions(lexical).select("query_id", "file_id", "start_byte", reciprocal_rank(F.col("position"), lexical_weight).alias("lexical_score"), F.lit(0.0).alias("semantic_score"))
    right = semantic.select("query_id", "file_id", "start_byte", F.lit(0.0).alias("lexical_score"), (F.col("score") * semantic_weight).alias("semantic_score"))
    both = left.unionByName(right).groupBy("query_id", "file_id", "start_byte").agg(F.sum("lexical_score").alias("lexical_score"), F.sum("semantic_score").alias("semantic_score"))
    both = both.withColumn("score", F.col("lexical_score") + F.col("semantic_score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "file_id", "start_byte")
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def query_frame(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """A stated set of query texts as a frame."""
    return spark.createDataFrame(list(queries.items()), "query_id long, query string")
