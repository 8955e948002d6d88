"""The index of a source tree or of a document table, and the queries over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, lexical, planning, semantic
from tessera.operators.planning import TokenBudget
from tessera.sources import files as tree
from tessera.sources import state, store, symbols
from tessera.sources.lineage import cut

TABLES = ("files", "lines", "symbols", "calls", "edges", "terms", "idf", "norms")


class CodeIndex:
    """Tables of a tree: files, lines, symbols, calls, edges, and terms with their frequencies and norms.

    `strict` resolves calls by bare names only. Tables are frames; the base ones are kept, derived ones follow from them.
    """

    def __init__(self, spark: SparkSession, root: str, files: DataFrame, strict: bool = False, tables: dict[str, DataFrame] | None = None, fragments: int | None = None):
        self.spark, self.root, self.strict = spark, root, strict
        self._fragments = fragments
        if tables is None:
            self._build(cut(files))
        else:
            self._take(tables)

    @classmethod
    def open(cls, spark: SparkSession, root: str, strict: bool = False) -> CodeIndex:
        """Index the files of a tree."""
        return cls(spark, root, tree.open_tree(spark, root), strict)

    @classmethod
    def from_files(cls, spark: SparkSession, files: DataFrame, root: str = "", strict: bool = False) -> CodeIndex:
        """Index a frame of `file_id, path, text` (a document table of any size); `language` is by extension if missing."""
        language = F.col("language") if "language" in files.columns else T.language_of(F.col("path"))
        lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        size, no = F.octet_length("text").cast("long"), F.lit(False)
        whole = files.select(F.col("file_id").cast("long").alias("file_id"), "path", language.alias("language"), size.alias("size_bytes"), lines.cast("int").alias("line_count"), F.lit(0).cast("long").alias("modified_at"), no.alias("is_binary"), no.alias("is_generated"), no.alias("is_vendor"), "text")
        return cls(spark, root, whole, strict)

    @classmethod
    def open_cached(cls, spark: SparkSession, root: str, directory: str, strict: bool = False) -> CodeIndex:
        """The stored index if its files are those of the tree, else a new one, stored in its place."""
        current = tree.open_tree(spark, root)
        if store.exists(spark, directory):
            tables, manifest = store.load(spark, directory)
            if manifest["root"] == root and not state.files_changed(state.file_state(tables["files"]), state.file_state(current)):
                return cls(spark, root, tables["files"], strict, tables, manifest["fragments"])
        index = cls(spark, root, current, strict)
        index.save_cache(directory)
        return index

    def _build(self, files: DataFrame) -> None:
        self.files = files
        content = tree.searchable(files)
        self.lines = cut(lexical.lines(content))
        extracted = cut(symbols.extract(content))
        own, calls = symbols.tables(extracted)
        self.extracted = extracted
        self._derive(own, calls, cut(self._terms(self.lines)))

    def _terms(self, lines: DataFrame) -> DataFrame:
        return semantic.term_counts(semantic.fragments(lines), ["file_id", "line_number", "start_byte", "end_byte"], "line")

    def _derive(self, own: DataFrame, calls: DataFrame, terms: DataFrame) -> None:
        self.symbols, self.calls, self.terms = own, calls, terms
        resolve = graph.resolve_calls if self.strict else graph.resolve_qualified
        self.edges = cut(resolve(calls, own))
        self._fragments = semantic.fragments(self.lines).count()
        self.idf, self.norms = cut(semantic.frequencies(terms, self._fragments)), cut(semantic.norms(terms))

    def _take(self, tables: dict[str, DataFrame]) -> None:
        for name in (*TABLES, "extracted"):
            setattr(self, name, tables[name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in (*TABLES, "extracted")}

    def save_cache(self, directory: str) -> None:
        """Store all tables; an index that was loaded from the same folder must not be saved over itself."""
        store.save(self.spark, self.tables(), directory, self.root, self._fragments)

    # Changes

    def reindex(self) -> None:
        """Build everything from the tree again."""
        self._build(cut(tree.open_tree(self.spark, self.root)))

    def process_changes(self, changes: DataFrame) -> None:
        """Apply `changes(seq, op, path, text)`: the last change of a path counts, so that a replay changes nothing.

        Lines, symbols, calls and terms of changed files are replaced; edges, frequencies and norms follow from all.
        """
        last = cut(state.last_changes(changes.select("seq", "op", "path", "text")))
        gone = self.files.join(last.select("path"), "path", "left_semi").select("file_id")
        fresh = last.where("op <> 'deleted'")
        known = self.files.select("path", "file_id")
        top = self.files.agg(F.coalesce(F.max("file_id"), F.lit(-1)).alias("m")).first()["m"]
        new_paths = fresh.join(known, "path", "left_anti").select("path")
        # Numbers of new paths only, after those in use: a micro-batch, not the index.
        numbered = new_paths.withColumn("file_id", F.row_number().over(Window.orderBy("path")).cast("long") + F.lit(top))
        ids = known.join(fresh.select("path"), "path", "left_semi").select("path", "file_id").unionByName(numbered)
        raw = fresh.join(ids, "path").select("file_id", "path", F.lit(0).cast("long").alias("modified_at"), F.encode("text", "UTF-8").alias("content"))
        added = cut(tree.described(raw))
        gone = cut(gone)
        drop = lambda df: df.join(gone, "file_id", "left_anti").select(*df.columns)
        self.files = cut(drop(self.files).unionByName(added))
        content = tree.searchable(added)
        lines = cut(lexical.lines(content))
        self.lines = cut(drop(self.lines).unionByName(lines))
        self.extracted = cut(drop(self.extracted).unionByName(symbols.extract(content)))
        own, calls = symbols.tables(self.extracted)
        self._derive(own, calls, cut(drop(self.terms).unionByName(self._terms(lines))))

    def reindex_file(self, path: str, text: str | None) -> None:
        """Replace one file, or remove it if `text` is None."""
        op = "deleted" if text is None else "modified"
        self.process_changes(self.spark.createDataFrame([(0, op, path, text)], "seq long, op string, path string, text string"))

    # Queries

    def search(self, query: str, budget: TokenBudget | None = None, mode: str = "exact", file_ids: list[int] | None = None) -> DataFrame:
        return lexical.search(self.lines, query, mode, file_ids, max_files=(budget or TokenBudget()).max_files)

    def semantic_search(self, query: str, limit: int = 100, weighting: str = "tf") -> DataFrame:
        found = semantic.cosine_search(self._index(), semantic.query_frame(self.spark, {0: query}), limit, weighting)
        return found.drop("query_id")

    def _index(self) -> semantic.TermIndex:
        return semantic.TermIndex(self.terms, self.idf, self.norms, self._fragments)

    def analyze_query(self, query: str, strict_words: bool = False) -> str:
        return self.spark.range(1).select(T.analyze_query(F.lit(query), strict_words).alias("mode")).first()["mode"]

    def hybrid_search(self, query: str, budget: TokenBudget | None = None, mode: str | None = None) -> DataFrame:
        """Route a query: `lexical` and `semantic` searches score by themselves, `hybrid` fuses both."""
        limits = budget or TokenBudget()
        mode = mode or self.analyze_query(query)
        found = lexical.search_many(self.lines, {0: (query, "case_insensitive")}, max_files=limits.max_files)
        if mode == "lexical":
            return found.select("file_id", "start_byte", F.lit(1.0).alias("lexical_score"), F.lit(0.0).alias("semantic_score"), F.lit(1.0).alias("score"))
        near = semantic.cosine_search(self._index(), semantic.query_frame(self.spark, {0: query}), 10 * limits.max_files)
        if mode == "semantic":
            return near.select("file_id", "start_byte", F.lit(0.0).alias("lexical_score"), F.col("score").alias("semantic_score"), "score")
        return semantic.fuse(found, near, 10 * limits.max_files).drop("query_id")

    def find_symbol(self, name: str) -> DataFrame:
        return self.symbols.where(F.col("name") == name)

    get_definition = find_symbol

    def find_references(self, name: str) -> DataFrame:
        """Symbols with an edge to a symbol of that name, one row for each call site."""
        hit = graph.references(self.edges, self.find_symbol(name)).withColumnRenamed("name", "referenced")
        return hit.join(self.symbols, hit["from_id"] == self.symbols["symbol_id"]).select(*self.symbols.columns, "relationship")

    def _from(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], "root long")

    def _roots(self, ids: int | list[int] | DataFrame) -> DataFrame:
        """One id, a list of them, or any number as a table `root`."""
        return ids if isinstance(ids, DataFrame) else self._from(ids if isinstance(ids, list) else [ids])

    def get_callers(self, symbol_id: int) -> DataFrame:
        return graph.neighbours(self.edges, self._from([symbol_id])).select("node")

    def get_callees(self, symbol_id: int) -> DataFrame:
        return graph.neighbours(self.edges, self._from([symbol_id]), up=False).select("node")

    def get_callers_upto(self, symbol_ids: int | list[int] | DataFrame, depth: int) -> DataFrame:
        return graph.traverse(self.edges, self._roots(symbol_ids), depth)

    def get_callees_upto(self, symbol_ids: int | list[int] | DataFrame, depth: int) -> DataFrame:
        return graph.traverse(self.edges, self._roots(symbol_ids), depth, up=False)

    def plan_context(self, query: str, budget: TokenBudget | None = None, semantic_leg: bool = False, compacting: bool = True) -> DataFrame:
        """The plan of one query; see `plan_contexts`."""
        return self.plan_contexts({0: query}, budget, semantic_leg, compacting).drop("query_id")

    def plan_contexts(self, queries: dict[int, str], budget: TokenBudget | None = None, semantic_leg: bool = False, compacting: bool = True) -> DataFrame:
        """Plans of a batch of queries in one job: symbols by name, matching lines and, if asked, similar lines, ranked
        and packed into the budget."""
        limits = budget or TokenBudget()
        asked = semantic.query_frame(self.spark, queries)
        found = lexical.search_many(self.lines, {q: (p, "exact") for q, p in queries.items()}, max_files=limits.max_files)
        candidates = planning.symbol_candidates(self.symbols, asked).unionByName(planning.lexical_candidates(found, asked))
        if semantic_leg:
            near = semantic.cosine_search(self._index(), asked, 10 * limits.max_files)
            candidates = candidates.unionByName(planning.semantic_candidates(near, asked))
        return planning.plan(planning.rank(candidates), self.files, limits, compacting)

    def get_source(self, file_id: int, start: int, end: int) -> str | None:
        ranges = self.spark.createDataFrame([(file_id, start, end)], "file_id long, start_byte long, end_byte long")
        row = lexical.source_slice(self.files, ranges).first()
        return row["source"] if row else None

    def get_symbol(self, symbol_id: int):
        return self.symbols.where(F.col("symbol_id") == symbol_id).first()

    def get_file(self, file_id: int):
        return self.files.drop("text").where(F.col("file_id") == file_id).first()

    def get_file_by_path(self, path: str):
        return self.files.drop("text").where(F.col("path") == path).first()

    def get_content(self, file_id: int) -> str | None:
        row = tree.searchable(self.files).where(F.col("file_id") == file_id).select("text").first()
        return row["text"] if row else None

    def symbols_in_file(self, file_id: int) -> DataFrame:
        return self.symbols.where(F.col("file_id") == file_id)

    def file_count(self) -> int:
        return self.files.count()

    def symbol_count(self) -> int:
        return self.symbols.count()

    def doc_count(self) -> int:
        return self._fragments

    def on_change(self) -> Callable[[DataFrame, int], None]:
        """A sink for `foreachBatch` over a change log."""
        return lambda batch, _: self.process_changes(batch) if batch.limit(1).count() else None
