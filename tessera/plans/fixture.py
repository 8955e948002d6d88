"""A small source tree of several languages, and queries of the code profile over it.

The driver's tables hold no code; these sources do, so that scanner, call resolution, compacted plans, changes and the
store have registered queries too. What each returned was checked by hand against the sources and is fixed here.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph, planning
from tessera.plans.engine import CodeIndex
from tessera.sources import files as tree
from tessera.sources import store, symbols

SOURCES = {
    "shop/cart.py": (
        "class Cart:\n    def put(self, item):\n        self.check(item)\n        self.items.append(cost(item))\n\n    def check(self, item):\n        return cost(item) > 0\n\n\n"
        "def cost(item):\n    # cost(nothing)\n    return round_up(item.weight)\n\n\ndef round_up(x):\n    return int(x + 1)\n"
    ),
    "shop/price.rs": (
        "pub struct Price { cents: u64 }\n\nimpl Price {\n    pub fn fresh(cents: u64) -> Price { verify(cents); Price { cents } }\n}\n\n"
        "fn verify(cents: u64) { limit::most(cents); self::verify(cents); }\n"
    ),
    "shop/limit.rs": "pub fn most(cents: u64) -> u64 { cents }\n",
    "web/page.js": "class Page {\n  show(x) { this.draw(x); }\n  draw(x) { paint(x); }\n}\nfunction paint(x) { return x; }\n",
    "lib/util.go": "package lib\n\ntype Box struct {\n\tsize int\n}\n\nfunc Grow(n int) int { return n }\n\nfunc Fill(n int) { Grow(n) }\n",
    "old/half.py": "def first():\n    print second()\n\ndef second():\n    return 2\n",
    "vendor/Kept.java": "class Kept {\n    int size;\n    void run() { step(); }\n    void step() { run(); }\n}\n",
}
#: Changes in order: a file made and made again, one altered, one removed, one of them replayed.
CHANGES = [
    (1, "created", "web/extra.js", "function extra(x) { return x; }\n"),
    (2, "modified", "shop/limit.rs", "pub fn least(cents: u64) -> u64 { cents }\n"),
    (3, "deleted", "lib/util.go", None),
    (4, "modified", "web/extra.js", "function extra(x) { return paint(x); }\n"),
    (4, "modified", "web/extra.js", "function extra(x) { return paint(x); }\n"),
]


def sources(spark: SparkSession) -> DataFrame:
    """`file_id, path, modified_at, content` of the tree, numbered in order of path."""
    rows = [(i, path, 0, bytearray(text.encode())) for i, (path, text) in enumerate(sorted(SOURCES.items()))]
    return tree.described(spark.createDataFrame(rows, "file_id long, path string, modified_at long, content binary"))


def _extracted(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return symbols.tables(symbols.extract(tree.searchable(sources(spark))))


def _index(spark: SparkSession) -> CodeIndex:
    return CodeIndex(spark, "", sources(spark))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark).select("path", "language", "size_bytes", "line_count", "is_binary", "is_vendor", "is_generated")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _extracted(spark)[0].join(sources(spark).select("file_id", "path"), "file_id")
    return own.select("path", "name", "kind", "parent_name", "start_line", "end_line")


def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _extracted(spark)[1].join(sources(spark).select("file_id", "path"), "file_id")
    return calls.select("path", "caller_name", "callee_name", "start_line")


def _named(edges: DataFrame, own: DataFrame) -> DataFrame:
    one = own.select(F.col("symbol_id").alias("from_id"), F.col("name").alias("caller"))
    other = own.select(F.col("symbol_id").alias("to_id"), F.col("name").alias("callee"), F.col("kind").alias("callee_kind"))
    return edges.join(one, "from_id").join(other, "to_id").select("caller", "callee", "callee_kind")


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as the index resolves them by default."""
    own, calls = _extracted(spark)
    return _named(graph.resolve_qualified(calls, own), own)


def code_edges_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, calls = _extracted(spark)
    return _named(graph.resolve_calls(calls, own), own)


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to each symbol, one row for each call."""
    own, calls = _extracted(spark)
    found = graph.references(graph.resolve_qualified(calls, own), own)
    return found.join(own.select(F.col("symbol_id").alias("from_id"), F.col("name").alias("caller")), "from_id").select("name", "caller", "relationship")


def code_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers within three steps of the symbols named `round_up` and `most`."""
    own, calls = _extracted(spark)
    roots = own.where(F.col("name").isin("round_up", "most")).select(F.col("symbol_id").alias("root"))
    found = graph.traverse(graph.resolve_qualified(calls, own), roots, 3)
    names = own.select("symbol_id", "name")
    first = found.join(names.withColumnsRenamed({"symbol_id": "root", "name": "callee"}), "root")
    return first.join(names.withColumnsRenamed({"symbol_id": "node", "name": "caller"}), "node").select("callee", "caller", "depth")


def code_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every two symbols of a file, whether the first's range holds the other's start, holds all of it, or overlaps it."""
    own = _extracted(spark)[0].select("file_id", "name", "start_byte", "end_byte", "start_line", "end_line")
    other = own.select("file_id", *(F.col(c).alias(f"other_{c}") for c in own.columns if c != "file_id"))
    pairs = own.join(other, "file_id").where("start_byte < other_start_byte")
    start, end, at, to = (F.col(c) for c in ("start_byte", "end_byte", "other_start_byte", "other_end_byte"))
    return pairs.select("name", "other_name", T.contains_byte(start, end, at).alias("holds_start"), T.contains_range(start, end, at, to).alias("holds_all"), T.overlaps(start, end, at, to).alias("overlap"), T.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan whose fragment is compacted: the class does not fit its budget of tokens."""
    made = _index(spark).plan_context("Cart", planning.TokenBudget(30, 10, 20, 3))
    return made.select("position", "name", "start_line", "token_count", "content")


def code_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and their callers after a feed of changes."""
    index = _index(spark)
    index.process_changes(spark.createDataFrame(CHANGES, "seq long, op string, path string, text string"))
    own = index.symbols.join(index.files.select("file_id", "path"), "file_id")
    callers = index.edges.groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return own.join(callers, "symbol_id", "left").select("path", "name", F.coalesce("n", F.lit(0)).alias("callers"))


def code_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the tables of an index that was stored in the cluster's shared folder and read back."""
    index = _index(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid4().hex}"
    index.save_cache(folder)
    tables, manifest = store.load(spark, folder)
    rows = [(name, tables[name].count()) for name in ("files", "lines", "symbols", "calls", "edges")] + [("fragments", manifest["fragments"])]
    store.delete(spark, folder)
    return spark.createDataFrame(rows, "name string, n long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "code_files": code_files,
    "code_symbols": code_symbols,
    "code_calls": code_calls,
    "code_edges": code_edges,
    "code_edges_strict": code_edges_strict,
    "code_references": code_references,
    "code_callers": code_callers,
    "code_ranges": code_ranges,
    "code_context": code_context,
    "code_changes": code_changes,
    "code_store": code_store,
}

# Results of the queries, each row checked by hand against the sources.
_SYMBOLS = [
    ("lib/util.go", "Box", "Struct", None, 3, 5), ("lib/util.go", "Grow", "Function", None, 7, 7), ("lib/util.go", "Fill", "Function", None, 9, 9),
    ("old/half.py", "first", "Function", None, 1, 2), ("old/half.py", "second", "Function", None, 4, 5),
    ("shop/cart.py", "Cart", "Class", None, 1, 7), ("shop/cart.py", "put", "Function", "Cart", 2, 4), ("shop/cart.py", "check", "Function", "Cart", 6, 7),
    ("shop/cart.py", "cost", "Function", None, 10, 12), ("shop/cart.py", "round_up", "Function", None, 15, 16),
    ("shop/limit.rs", "most", "Function", None, 1, 1),
    ("shop/price.rs", "Price", "Struct", None, 1, 1), ("shop/price.rs", "Price", "Impl", None, 3, 5), ("shop/price.rs", "fresh", "Function", "Price", 4, 4), ("shop/price.rs", "verify", "Function", None, 7, 7),
    ("web/page.js", "Page", "Class", None, 1, 4), ("web/page.js", "show", "Method", "Page", 2, 2), ("web/page.js", "draw", "Method", "Page", 3, 3), ("web/page.js", "paint", "Function", None, 5, 5),
]
_CALLS = [
    ("lib/util.go", "Fill", "Grow", 9), ("old/half.py", "first", "second", 2),
    ("shop/cart.py", "put", "self.check", 3), ("shop/cart.py", "put", "self.items.append", 4), ("shop/cart.py", "put", "cost", 4), ("shop/cart.py", "check", "cost", 7),
    ("shop/cart.py", "cost", "round_up", 12), ("shop/cart.py", "round_up", "int", 16),
    ("shop/price.rs", "fresh", "verify", 4), ("shop/price.rs", "verify", "limit::most", 7), ("shop/price.rs", "verify", "self::verify", 7),
    ("web/page.js", "show", "this.draw", 2), ("web/page.js", "draw", "paint", 3),
]
_BARE = [("Fill", "Grow"), ("first", "second"), ("put", "cost"), ("check", "cost"), ("cost", "round_up"), ("fresh", "verify"), ("verify", "verify"), ("draw", "paint")]
#: Members of the same class, and a path whose head is the stem of a file.
_QUALIFIED = [("put", "check", "Function"), ("show", "draw", "Method"), ("verify", "most", "Function")]
_EDGES = [(*e, "Function") for e in _BARE] + _QUALIFIED
_AFTER = [
    ("old/half.py", "first", 0), ("old/half.py", "second", 1), ("shop/cart.py", "Cart", 0), ("shop/cart.py", "put", 0), ("shop/cart.py", "check", 1), ("shop/cart.py", "cost", 2),
    ("shop/cart.py", "round_up", 1), ("shop/limit.rs", "least", 0), ("shop/price.rs", "Price", 0), ("shop/price.rs", "Price", 0), ("shop/price.rs", "fresh", 0), ("shop/price.rs", "verify", 2),
    ("web/extra.js", "extra", 0), ("web/page.js", "Page", 0), ("web/page.js", "show", 0), ("web/page.js", "draw", 1), ("web/page.js", "paint", 2),
]
_PLANNED = "class Cart:\n    def put(self, item):\n        self.check(item)\n        self.items.append(cost(item))\n\n...\n[1 more lines]"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of fixed rows; `columns` are names and types."""
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    names = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in names)
    body = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)
    return f"SELECT {casts} FROM (VALUES {body}) AS t({', '.join(n for n, _ in names)})"


def _sizes() -> list[tuple]:
    languages = {"py": "python", "rs": "rust", "js": "javascript", "go": "go", "java": "java"}
    return [(path, languages[path.split(".")[1]], len(text), text.count("\n") + 1, False, path.startswith("vendor/"), False) for path, text in SOURCES.items()]


_PLACES = _values("path VARCHAR, name VARCHAR, kind VARCHAR, parent_name VARCHAR, start_line INTEGER, end_line INTEGER", _SYMBOLS)
ORACLES: dict[str, str] = {
    "code_files": _values("path VARCHAR, language VARCHAR, size_bytes BIGINT, line_count INTEGER, is_binary BOOLEAN, is_vendor BOOLEAN, is_generated BOOLEAN", _sizes()),
    "code_symbols": _PLACES,
    "code_calls": _values("path VARCHAR, caller_name VARCHAR, callee_name VARCHAR, start_line INTEGER", _CALLS),
    "code_edges": _values("caller VARCHAR, callee VARCHAR, callee_kind VARCHAR", _EDGES),
    "code_edges_strict": _values("caller VARCHAR, callee VARCHAR, callee_kind VARCHAR", [(*e, "Function") for e in _BARE]),
    "code_references": _values("name VARCHAR, caller VARCHAR, relationship VARCHAR", [(b, a, "Calls") for a, b, _ in _EDGES]),
    "code_callers": _values("callee VARCHAR, caller VARCHAR, depth INTEGER", [("most", "verify", 1), ("most", "fresh", 2), ("round_up", "cost", 1), ("round_up", "put", 2), ("round_up", "check", 2)]),
    # In these sources ranges nest or are apart, and no two of a file begin on one line.
    "code_ranges": f"""WITH s AS ({_PLACES})
SELECT a.name, b.name AS other_name, b.end_line <= a.end_line AS holds_start, b.end_line <= a.end_line AS holds_all, b.start_line <= a.end_line AS overlap, a.end_line - a.start_line + 1 AS lines
FROM s a JOIN s b ON a.path = b.path AND a.start_line < b.start_line""",
    "code_context": _values("position BIGINT, name VARCHAR, start_line BIGINT, token_count BIGINT, content VARCHAR", [(0, "Cart", 1, 30, _PLANNED)]),
    "code_changes": _values("path VARCHAR, name VARCHAR, callers BIGINT", _AFTER),
    "code_store": _values("name VARCHAR, n BIGINT", [("files", 7), ("lines", sum(len(t.splitlines()) for p, t in SOURCES.items() if p[0] != "v")), ("symbols", len(_SYMBOLS)), ("calls", len(_CALLS)), ("edges", len(_EDGES)), ("fragments", sum(bool(x.strip()) and x.strip()[0] != "#" for p, t in SOURCES.items() if p[0] != "v" for x in t.splitlines()))]),
}
