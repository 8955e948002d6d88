"""JSON-RPC server over an index: one JSON object a line, on standard input and output."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from itertools import accumulate
from typing import IO

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.operators.lexical import summary
from tessera.operators.planning import TokenBudget
from tessera.plans import render
from tessera.plans.engine import CodeIndex
from tessera.sources.lineage import cut

log = logging.getLogger(__name__)
# Codes of errors.
PARSE, INVALID, METHOD, PARAMS, INTERNAL, CANCELLED, TIMEOUT = -32700, -32600, -32601, -32602, -32603, -32800, -32801
TIMEOUT_MS = 30_000
#: Rows of one answer; the rest follows by `offset`.
PAGE = 200


def _tool(name: str, description: str, required: str, text: str, **numbers: int) -> dict:
    properties = {required: {"type": "string", "description": text}} | {n: {"type": "integer", "default": d} for n, d in numbers.items()}
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": [required]}}


TOOLS = [
    _tool("search_code", "Search lines of code for a text", "query", "Text to search for", max_tokens=2000),
    _tool("find_symbol", "Find functions, types and other symbols by name", "name", "Name of the symbol", max_tokens=2000, offset=0),
    _tool("get_context", "The best fragments for a query within a budget of tokens", "query", "Query", max_tokens=2000, max_files=10),
    _tool("find_callers", "Functions that call a symbol", "symbol", "Name of the symbol", depth=2, offset=0),
    _tool("find_callees", "Functions that a symbol calls", "symbol", "Name of the symbol", depth=2, offset=0),
    _tool("get_definition", "Where a symbol is defined, with its source", "name", "Name of the symbol"),
    _tool("find_references", "Symbols that refer to a symbol", "name", "Name of the symbol", offset=0),
]


class Fault(Exception):
    """An error with its code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class Server:
    """Handles requests. Calls of tools run as tagged Spark jobs, so that a deadline or a cancel message ends them."""

    def __init__(self, index: CodeIndex):
        self.index = index
        self.timeout_ms = TIMEOUT_MS
        self.session = uuid.uuid4().hex
        self.started, self.requests, self.stopped = time.time(), 0, False
        self.cancelled: set[str] = set()
        self.running: dict[str, str] = {}
        self.methods: dict[str, Callable[[dict, str], dict]] = {
            "initialize": self._initialize, "tools/list": lambda p, i: {"tools": TOOLS}, "tools/call": self._call, "shutdown": self._shutdown,
            "cancel": self._cancel, "health": lambda p, i: {"status": "ok"}, "session/status": self._status, "workspace/info": self._workspace,
        }
        self.tools: dict[str, Callable[[dict], str]] = {
            "search_code": self._search_code, "find_symbol": self._find_symbol, "get_context": self._get_context, "find_callers": lambda a: self._walk(a, True),
            "find_callees": lambda a: self._walk(a, False), "get_definition": self._get_definition, "find_references": self._find_references,
        }

    def handle_line(self, line: str) -> str | None:
        """The reply to one line, None for blanks and notifications."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
        except ValueError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": f"parse error: {e}"}})
        reply = self.handle(request)
        return None if reply is None else json.dumps(reply, ensure_ascii=False)

    def handle(self, request: dict) -> dict | None:
        self.requests += 1
        key = request.get("id") if isinstance(request, dict) else None
        try:
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise Fault(INVALID, "not a request")
            method = self.methods.get(request["method"])
            if method is None:
                raise Fault(METHOD, f"no method {request['method']}")
            body = {"result": method(request.get("params") or {}, str(key))}
        except Fault as e:
            body = {"error": {"code": e.code, "message": str(e)}}
        except QueryError as e:
            body = {"error": {"code": PARAMS, "message": str(e)}}
        except Exception as e:
            log.exception("request failed")
            body = {"error": {"code": INTERNAL, "message": str(e).split("\n")[0]}}
        if key is None and isinstance(request, dict) and "method" in request:
            return None
        return {"jsonrpc": "2.0", "id": key} | body

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """Reply line by line until the input ends or a shutdown. Tool calls run beside the reader, so that a cancel
        message reaches the call that runs."""
        lock, threads = threading.Lock(), []

        def answer(line: str) -> None:
            reply = self.handle_line(line)
            if reply is not None:
                with lock:
                    sink.write(reply + "\n")
                    sink.flush()

        for line in source:
            if '"tools/call"' in line:
                threads.append(threading.Thread(target=answer, args=(line,)))
                threads[-1].start()
            else:
                answer(line)
            if self.stopped:
                break
        for t in threads:
            t.join()

    def _initialize(self, params: dict, _: str) -> dict:
        self.timeout_ms = int(params.get("timeout", self.timeout_ms))
        return {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "0.1.0"}, "workspace": self.index.root}

    def _shutdown(self, params: dict, _: str) -> dict:
        self.stopped = True
        return {"status": "shutdown"}

    def _status(self, params: dict, _: str) -> dict:
        return {"session": self.session, "requests": self.requests, "uptime_seconds": int(time.time() - self.started)}

    def _workspace(self, params: dict, _: str) -> dict:
        return {"root": self.index.root, "files": self.index.file_count(), "symbols": self.index.symbol_count()}

    def _cancel(self, params: dict, _: str) -> dict:
        key = str(params.get("id", params.get("requestId")))
        self.cancelled.add(key)
        if key in self.running:
            self.index.spark.sparkContext.cancelJobsWithTag(self.running[key])
        return {"cancelled": key}

    def _call(self, params: dict, key: str) -> dict:
        tool = self.tools.get(params.get("name"))
        if tool is None:
            raise Fault(PARAMS, f"no tool {params.get('name')}")
        context = self.index.spark.sparkContext
        tag = f"tessera-{self.session}-{uuid.uuid4().hex}"
        self.running[key] = tag
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout_ms / 1000, stop)
        timer.start()
        context.addJobTag(tag)
        try:
            text = tool(params.get("arguments") or {})
        except Exception:
            if not late.is_set() and key not in self.cancelled:
                raise
            text = ""
        finally:
            timer.cancel()
            context.removeJobTag(tag)
            self.running.pop(key, None)
        if late.is_set():
            raise Fault(TIMEOUT, f"no result within {self.timeout_ms} ms")
        if key in self.cancelled:
            self.cancelled.discard(key)
            raise Fault(CANCELLED, "cancelled")
        return {"content": [{"type": "text", "text": text}]}

    @staticmethod
    def _text(arguments: dict, name: str, other: str | None = None) -> str:
        value = arguments.get(name, arguments.get(other))
        if not isinstance(value, str):
            raise QueryError(f"{name} is missing")
        return value

    def _search_code(self, arguments: dict) -> str:
        # A count of matches needs no tokens beyond its own line, whatever the budget.
        budget = TokenBudget(int(arguments.get("max_tokens", 2000)))
        found = self.index.search(self._text(arguments, "query"), budget).withColumn("query_id", F.lit(0))
        row = summary(found).first()
        return f"Found {row['matches'] if row else 0} matches in {row['files'] if row else 0} files"

    def _placed(self, rows: DataFrame, limit: int, offset: int = 0, keys: tuple[str, ...] = ("symbol_id",)) -> list:
        """At most `limit` symbols in order of `keys`, from `offset` on, with their paths."""
        few = rows.orderBy(*keys).offset(offset).limit(limit)
        return few.join(self.index.files.select("file_id", "path"), "file_id").orderBy(*keys).collect()

    def _page(self, rows: DataFrame, arguments: dict, show: Callable[[Row], str], none: str, keys: tuple[str, ...] = ("symbol_id",)) -> str:
        """A page of `rows` from the argument `offset` on, a line each, and how many follow. A page ends where the
        argument `max_tokens` is used up, but holds one row."""
        offset = int(arguments.get("offset", 0))
        if offset < 0:
            raise QueryError("offset is negative")
        placed = self._placed(rows, PAGE + 1, offset, keys)
        lines = [show(r) for r in placed[:PAGE]]
        if "max_tokens" in arguments:
            used = accumulate((len(line.encode()) + 4) // 4 for line in lines)
            lines = lines[: max(1, sum(u <= int(arguments["max_tokens"]) for u in used))]
        if len(placed) > len(lines):
            lines.append(f"{rows.count() - offset - len(lines)} more from offset {offset + len(lines)}")
        return "\n".join(lines) or (f"Nothing from offset {offset} on" if offset else none)

    def _find_symbol(self, arguments: dict) -> str:
        name = self._text(arguments, "name")
        return self._page(self.index.find_symbol(name), arguments, lambda r: f"- {r['name']} ({r['kind']}) at {r['path']}:{r['start_line']}:{r['end_line']}", f"No symbol {name}")

    def _get_context(self, arguments: dict) -> str:
        budget = TokenBudget(int(arguments.get("max_tokens", 2000)), int(arguments.get("max_files", 10)))
        rows = render.attributed(self.index.plan_context(self._text(arguments, "query"), budget), self.index.files)
        return render.context(rows, budget.max_tokens)

    def _walk(self, arguments: dict, up: bool) -> str:
        name = self._text(arguments, "symbol")
        roots = self.index.find_symbol(name).select(F.col("symbol_id").alias("root"))
        if roots.isEmpty():
            return f"No symbol {name}"
        walk = self.index.get_callers_upto if up else self.index.get_callees_upto
        found = cut(walk(roots, int(arguments.get("depth", 2))).groupBy("node").agg(F.min("depth").alias("depth")))
        rows = found.join(self.index.symbols, found["node"] == self.index.symbols["symbol_id"])
        return self._page(rows, arguments, lambda r: f"- {r['name']} ({r['kind']}) at {r['path']}:{r['start_line']} depth {r['depth']}", f"No {'callers' if up else 'callees'} of {name}", ("depth", "symbol_id"))

    def _get_definition(self, arguments: dict) -> str:
        name = self._text(arguments, "name", "symbol")
        rows = self._placed(self.index.get_definition(name), 1)
        if not rows:
            return f"No symbol {name}"
        r = rows[0]
        return f"{r['name']} ({r['kind']}) at {r['path']}:{r['start_line']}:{r['end_line']}\n{self.index.get_source(r['file_id'], r['start_byte'], r['end_byte'])}"

    def _find_references(self, arguments: dict) -> str:
        name = self._text(arguments, "name", "symbol")
        return self._page(self.index.find_references(name), arguments, lambda r: f"- {r['name']} ({r['relationship']}) at {r['path']}:{r['start_line']}", f"No references to {name}")
