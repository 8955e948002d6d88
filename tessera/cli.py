"""Command line: index a tree, answer one query, serve, or follow changes."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession

from tessera.operators.planning import TokenBudget
from tessera.plans import render
from tessera.plans.engine import CodeIndex

MODES = ("symbol", "references", "callers", "callees", "lexical", "context")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Budgeted retrieval over a source tree")
    p.add_argument("--repo", default=".")
    p.add_argument("--mode", choices=MODES, default="context")
    p.add_argument("--max-tokens", type=int, default=2000)
    p.add_argument("--max-files", type=int, default=10)
    p.add_argument("--max-symbols", type=int, default=20)
    p.add_argument("--format", choices=render.FORMATS, default="compact")
    p.add_argument("--semantic", action="store_true", help="add similar lines to the context")
    p.add_argument("--mcp", action="store_true", help="serve JSON-RPC on standard input and output")
    p.add_argument("--use-cache", metavar="DIR", help="open the index stored there, or store it")
    p.add_argument("--watch", action="store_true", help="follow changes of the tree")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("query", nargs="*")
    return p


def answer(index: CodeIndex, query: str, args: argparse.Namespace) -> str:
    """The text of one query."""
    budget = TokenBudget(args.max_tokens, args.max_files, args.max_symbols)
    if args.mode == "context":
        rows = render.attributed(index.plan_context(query, budget, args.semantic), index.files)
        return render.render(rows, args.format, query, args.max_tokens)
    if args.mode == "lexical":
        found = index.search(query, budget).select("file_id", "line_number", "line")
        shown = found.join(index.files.select("file_id", "path"), "file_id").orderBy("path", "line_number").collect()  # capped for each file
        rows = [{"path": r["path"], "start_line": r["line_number"], "end_line": r["line_number"], "name": "", "content": r["line"], "token_count": -(-len(r["line"].encode()) // 4)} for r in shown]
        return render.render(rows, args.format, query)
    if args.mode == "symbol":
        found = index.find_symbol(query)
    elif args.mode == "references":
        found = index.find_references(query)
    else:
        roots = [r["symbol_id"] for r in index.find_symbol(query).select("symbol_id").collect()]
        walk = index.get_callers_upto if args.mode == "callers" else index.get_callees_upto
        reached = walk(roots, budget.max_depth).select("node").distinct()
        found = index.symbols.join(reached, index.symbols["symbol_id"] == reached["node"])
    shown = found.join(index.files.select("file_id", "path"), "file_id").orderBy("symbol_id").collect()
    rows = [{"path": r["path"], "start_line": r["start_line"], "end_line": r["end_line"], "name": r["name"], "content": index.get_source(r["file_id"], r["start_byte"], r["end_byte"]) if args.format == "full" else "", "token_count": (r["end_byte"] - r["start_byte"] + 3) // 4} for r in shown]
    return render.render(rows, args.format, query)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    index = CodeIndex.open_cached(spark, args.repo, args.use_cache) if args.use_cache else CodeIndex.open(spark, args.repo)
    if args.mcp:
        from tessera.plans.server import Server

        Server(index).serve(sys.stdin, sys.stdout)
    elif args.watch:
        _follow(spark, index, args.repo)
    elif args.query:
        print(answer(index, " ".join(args.query), args))
    else:
        parser().print_usage()
        return 2
    return 0


def _follow(spark: SparkSession, index: CodeIndex, root: str) -> None:
    import time

    from tessera.streaming.changes import ChangePoller, stream

    log = tempfile.mkdtemp(prefix="tessera-changes-")
    poller, running = ChangePoller(root, log), stream(spark, index, log, tempfile.mkdtemp(prefix="tessera-stream-"))
    try:
        while running.isActive:
            poller.poll()
            time.sleep(0.25)
    except KeyboardInterrupt:
        running.stop()


if __name__ == "__main__":
    sys.exit(main())
