"""Named queries over the driver's tables and their DuckDB twins.

Documents stand for files. In the text profile a symbol is the first token of a line if it is long enough, and a call is
any other token of that line that is some symbol's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T
from tessera.operators import graph, lexical, planning, semantic
from tessera.sources import state
from tessera.sources.files import spread

# The stated queries of the registered searches.
EXACT = {1: ("The", "exact"), 2: ("idiot", "exact"), 3: ("und ", "exact")}
CASELESS = {1: ("LICENSE", "case_insensitive"), 2: ("ÉEN", "case_insensitive")}
IDENTIFIER = {1: ("the", "identifier"), 2: ("de", "identifier")}
WORD = {1: ("The", "word"), 2: ("die", "word")}
REGEX = {1: ("^[A-Z][a-z]+ [a-z]+ of", "regex"), 2: ("[0-9]{3,}", "regex"), 3: ("(", "regex")}
CONTEXT = {1: "the", 2: "idiot", 3: "ndthe", 4: "license version"}
#: Names of the registered symbol lookup, besides the queries.
NAMES = ("thandthe", "that", "nicht", "licensed")
CAP = 1000
BUDGET = planning.TokenBudget()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`file_id, path, language, text` of the documents."""
    docs = spread(_table(spark, sf_dir, "documents"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id"), F.lit("."), F.coalesce("lang", F.lit("")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("lang").alias("language"), "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lines(files(spark, sf_dir))


def named_lines(lines: DataFrame, length: int) -> DataFrame:
    """The lines that are symbols of the text profile, with `tokens, name, symbol_id`."""
    split = F.filter(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    named = lines.withColumn("tokens", split).withColumn("name", F.get("tokens", F.lit(0))).where(F.length("name") >= length)
    return named.withColumn("symbol_id", graph.symbol_id(F.col("file_id"), F.col("start_byte")))


def text_symbols(lines: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Symbols and calls of the text profile."""
    named = named_lines(lines, length)
    number = F.col("line_number")
    symbols = named.select("symbol_id", "name", F.lit("Function").alias("kind"), "file_id", "start_byte", "end_byte", number.alias("start_line"), number.alias("end_line"))
    calls = named.select(F.col("symbol_id").alias("caller"), "file_id", "name", F.explode(F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1)))).alias("callee_name"))
    return symbols, calls.where("callee_name <> name").drop("name")


def _edges(spark: SparkSession, sf_dir: str, length: int) -> tuple[DataFrame, DataFrame]:
    symbols, calls = text_symbols(_lines(spark, sf_dir), length)
    return symbols, graph.resolve_calls(calls, symbols)


def lines_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    newlines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return found.select("file_id", "path", T.language_of(F.col("path")).alias("extension_language"), F.octet_length("text").cast("long").alias("size_bytes"), (newlines + 1).cast("int").alias("line_count"), F.contains(F.substring("text", 1, 8192), F.lit("\0")).alias("is_binary"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _search(queries: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lexical.search_many(_lines(spark, sf_dir), queries)

    return run


def search_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    german = files(spark, sf_dir).where("language = 'de'")
    return lexical.search_many(_lines(spark, sf_dir), EXACT, file_ids=german)


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.summary(lexical.search_many(_lines(spark, sf_dir), EXACT))


def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    ranges = lexical.lines(found).select("file_id", "start_byte", "end_byte")
    return lexical.source_slice(found, ranges)


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lexical.search_many(_lines(spark, sf_dir), {1: ("the", "exact"), 2: ("ing", "exact")})
    number = F.col("line_number")
    return lexical.merge_ranges(hit.select("file_id", "start_byte", (F.col("end_byte") + 1).alias("end_byte"), number.alias("start_line"), number.alias("end_line")))


def analyze_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", T.analyze_query(F.col("text")).alias("mode"))


def _index(spark: SparkSession, sf_dir: str) -> semantic.TermIndex:
    return semantic.build(_lines(spark, sf_dir))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.term_counts(semantic.fragments(_lines(spark, sf_dir)), ["file_id", "line_number"], "line")


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).idf.select("term", "df", F.round("idf", 6).alias("idf"))


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).norms.select("file_id", "line_number", F.round("norm", 6).alias("norm"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.cosine_search(_index(spark, sf_dir), semantic.query_frame(spark, CONTEXT))
    return found.select("query_id", "file_id", "line_number", F.round("score", 6).alias("score"))


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lines = _lines(spark, sf_dir)
    found = lexical.search_many(all_lines, {q: (p, "case_insensitive") for q, p in CONTEXT.items()})
    near = semantic.cosine_search(semantic.build(all_lines), semantic.query_frame(spark, CONTEXT))
    return semantic.fuse(found, near).select("query_id", "file_id", "start_byte", F.round("lexical_score", 6).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_symbols(_lines(spark, sf_dir), 4)[0].select("symbol_id", "name", "file_id", "start_byte", "end_byte", "start_line")


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).where(F.col("name").isin(*CONTEXT.values(), *NAMES))


def symbols_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("symbols"), F.min("name").alias("least"), F.countDistinct("name").alias("names"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, 4)[1]


def local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, calls = text_symbols(_lines(spark, sf_dir), 4)
    return graph.resolve_local(calls, own)


def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    seen = state.file_state(own.where("language <> 'fr'"))
    return state.changed_since(seen, state.file_state(own)).select("path", "content_hash")


def fragment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.fragments(_lines(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("fragments"))


def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edges = _edges(spark, sf_dir, 4)
    return graph.references(edges, own)


def _traverse(up: bool, length: int) -> Callable[[SparkSession, str], DataFrame]:
    """8 letters give the small graph of the fixed twins, 4 the whole one, that of `call_edges`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = files(spark, sf_dir)
        return graph.traverse_lists(graph.callee_lists(named_lines(lexical.lines(own), length), own), 3, up)

    return run


def _direct_callers(length: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own, edges = _edges(spark, sf_dir, length)
        return graph.neighbours(edges, own.select(F.col("symbol_id").alias("root")))

    return run


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = semantic.query_frame(spark, CONTEXT)
    all_lines = _lines(spark, sf_dir)
    own = text_symbols(all_lines, 4)[0]
    found = lexical.search_many(all_lines, {q: (p, "exact") for q, p in CONTEXT.items()})
    near = semantic.cosine_search(semantic.build(all_lines), asked)
    parts = [planning.symbol_candidates(own, asked), planning.lexical_candidates(found, asked), planning.semantic_candidates(near, asked)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), files(spark, sf_dir)


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = planning.rank(_candidates(spark, sf_dir)[0])
    return ranked.select("query_id", "source", "file_id", "start_byte", "symbol_match", "definition", F.round("semantic", 6).alias("semantic"), F.round("total", 6).alias("total"))


def context_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, own = _candidates(spark, sf_dir)
    made = planning.plan(planning.rank(found), own, BUDGET, compacting=False)
    return made.select("query_id", "position", "file_id", "start_byte", "end_byte", "token_count", "content")


def context_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.totals(context_plan(spark, sf_dir))


def compact_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = lexical.search_many(_lines(spark, sf_dir), EXACT).groupBy("query_id", "file_id").agg(F.array_sort(F.collect_list("line_number")).alias("numbers"))
    spans = F.concat(F.col("path"), F.lit(":"), F.array_join(F.transform("numbers", lambda n: F.concat_ws("-", n, n)), ","))
    return hit.join(files(spark, sf_dir).select("file_id", "path"), "file_id").select("query_id", spans.alias("output"))


def combine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.collect_list(F.col("quality").cast("double")).alias("q"), F.sum("toxic").alias("t"))
    return per_file.select("doc_id", F.round(scores.combine_scores(F.col("q"), F.col("t")), 6).alias("score"))


def cache_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = state.file_state(files(spark, sf_dir))
    poor = _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("file_id"), F.lit("!").alias("more")).distinct()
    kept = files(spark, sf_dir).where("language <> 'es'").join(poor, "file_id", "left").select("path", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))
    made = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id")).alias("path"), "text")
    return state.diff(old, state.file_state(kept.unionByName(made)))


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "deleted").when(F.col("event_type") == "signup", "created").otherwise("modified")
    changes = events.select(F.col("user_id").alias("path"), op.alias("op"), F.col("event_id").alias("seq"))
    table = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.lit(-1).cast("long").alias("seq"))
    return state.apply_changes(table, changes)


def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(_table(spark, sf_dir, "pages")).select(F.col("page_id").alias("file_id"), F.col("html").alias("text"))
    return lexical.search_many(lexical.lines(pages), {1: ("<ARTICLE>", "case_insensitive"), 2: ("<nav", "exact")}).select("query_id", "file_id", "line_number", "start_byte", "end_byte")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(spark, sf_dir).select("term").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "context_plan": context_plan,
    "lines_offsets": lines_offsets,
    "file_metadata": file_metadata,
    "token_estimate": token_estimate,
    "search_exact": _search(EXACT),
    "search_case_insensitive": _search(CASELESS),
    "search_identifier": _search(IDENTIFIER),
    "search_word": _search(WORD),
    "search_regex": _search(REGEX),
    "search_in_files": search_in_files,
    "match_summary": match_summary,
    "source_slice": source_slice,
    "merge_ranges": merge_ranges,
    "analyze_query": analyze_query,
    "term_counts": term_counts,
    "idf": idf,
    "norms": norms,
    "vocabulary": vocabulary,
    "semantic_topk": semantic_topk,
    "hybrid_fusion": hybrid_fusion,
    "symbols": symbols,
    "find_symbol": find_symbol,
    "symbols_in_file": symbols_in_file,
    "call_edges": call_edges,
    "local_edges": local_edges,
    "find_references": find_references,
    "direct_callers": _direct_callers(8),
    "callers_upto_3": _traverse(True, 8),
    "callees_upto_3": _traverse(False, 8),
    "all_direct_callers": _direct_callers(4),
    "all_callers_upto_3": _traverse(True, 4),
    "all_callees_upto_3": _traverse(False, 4),
    "rank_candidates": rank_candidates,
    "context_totals": context_totals,
    "compact_output": compact_output,
    "combine_scores": combine_scores,
    "cache_diff": cache_diff,
    "changed_since": changed_since,
    "fragment_lines": fragment_lines,
    "apply_changes": apply_changes,
    "web_lines": web_lines,
}
