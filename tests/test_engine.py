import io
import json

import pytest

from tessera import cli
from tessera.errors import RepositoryError
from tessera.operators.planning import TokenBudget
from tessera.plans.engine import CodeIndex
from tessera.plans.server import Server
from tessera.sources import files as tree
from tessera.sources import state
from tessera.sources.ignore import compile_rules, ignored
from tessera.streaming.changes import ChangePoller, stream

SOURCES = {
    "math.rs": "pub fn add(a: i32, b: i32) -> i32 {\n    a + b\n}\n\nfn twice(a: i32) -> i32 {\n    add(a, a)\n}\n",
    "main.rs": "use math::add;\n\nfn main() {\n    let sum = add(1, 2);\n    math::twice(sum);\n}\n",
    "pkg/__init__.py": "def load():\n    return load()\n",
    "target/skip.rs": "fn no() {}\n",
    "sub/deep/gone.py": "def gone(): pass\n",
    "vendor/lib.rs": "fn vendored() {}\n",
    ".gitignore": "sub/**/gone.py\n",
    "notes.xyz": "not source",
}


def write(root, sources):
    for path, text in sources.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    write(top, SOURCES)
    return top


@pytest.fixture(scope="module")
def index(spark, root):
    return CodeIndex.open(spark, str(root))


def test_walk(root):
    assert [p for p, _, _ in tree.walk(str(root))] == ["main.rs", "math.rs", "pkg/__init__.py", "vendor/lib.rs"]


def test_missing_tree(spark):
    with pytest.raises(RepositoryError):
        tree.open_tree(spark, "/nowhere/at/all")


def test_ignore_rules():
    rules = compile_rules("*.log\n!keep.log\n/top\nbuild/\n# note\na/**/b\n")
    assert ignored("x/y.log", False, rules) and not ignored("keep.log", False, rules)
    assert ignored("top", False, rules) and not ignored("x/top", False, rules)
    assert ignored("x/build", True, rules) and not ignored("x/build", False, rules)
    assert ignored("a/b", False, rules) and ignored("a/x/y/b", False, rules)


def ids(index):
    return {r["name"]: r["symbol_id"] for r in index.symbols.collect()}


def test_symbols_and_edges(index):
    own = ids(index)
    assert set(own) == {"add", "twice", "main", "load"}
    pairs = {(r["from_id"], r["to_id"]) for r in index.edges.collect()}
    assert pairs == {(own["twice"], own["add"]), (own["main"], own["add"]), (own["main"], own["twice"]), (own["load"], own["load"])}
    assert index.file_count() == 4 and index.symbol_count() == 4


def test_queries(index):
    own = ids(index)
    assert {r["name"] for r in index.find_references("add").collect()} == {"twice", "main"}
    assert [r["node"] for r in index.get_callers(own["twice"]).collect()] == [own["main"]]
    up = {(r["node"], r["depth"]) for r in index.get_callers_upto(own["add"], 3).collect()}
    assert up == {(own["twice"], 1), (own["main"], 1)}
    row = index.get_definition("add").first()
    assert index.get_source(row["file_id"], row["start_byte"], row["end_byte"]).startswith("pub fn add")
    assert index.get_file_by_path("main.rs")["language"] == "rust"
    vendored = index.get_file_by_path("vendor/lib.rs")
    assert vendored["is_vendor"] and index.get_content(vendored["file_id"]) is None
    assert index.hybrid_search("add").count() == 4
    assert index.hybrid_search("how add").count() > 0
    assert index.semantic_search("add").count() == 4


def test_plan(index):
    got = index.plan_context("add").orderBy("position").collect()
    assert got[0]["name"] == "add" and got[0]["token_count"] == 12
    assert len({(r["file_id"], r["start_byte"]) for r in got}) == len(got) == 4
    small = index.plan_context("add", TokenBudget(13)).collect()
    assert sum(r["token_count"] for r in small) <= 13
    batch = index.plan_contexts({1: "add", 2: "load"}, semantic_leg=True).groupBy("query_id").count().collect()
    assert {r["query_id"] for r in batch} == {1, 2}


def test_cache(spark, root, index, tmp_path):
    store = str(tmp_path / "store")
    first = CodeIndex.open_cached(spark, str(root), store)
    again = CodeIndex.open_cached(spark, str(root), store)
    for name, df in first.tables().items():
        assert df.count() == again.tables()[name].count()
    assert again.plan_context("add").count() == 4
    write(root, {"extra.rs": "fn extra() {}\n"})
    try:
        assert CodeIndex.open_cached(spark, str(root), store).file_count() == 5
    finally:
        (root / "extra.rs").unlink()


def content(index):
    files = index.files.select("file_id", "path")
    own = {r["file_id"]: r["path"] for r in files.collect()}
    names = {r["symbol_id"]: (own[r["file_id"]], r["name"]) for r in index.symbols.collect()}
    lines = sorted((own[r["file_id"]], r["line_number"], r["line"], r["start_byte"]) for r in index.lines.collect())
    edges = sorted((names[r["from_id"]], names[r["to_id"]]) for r in index.edges.collect())
    idf = sorted((r["term"], r["df"], round(r["idf"], 9)) for r in index.idf.collect())
    return lines, edges, idf, sorted(names.values())


def test_changes_equal_a_rebuild(spark, tmp_path):
    top = tmp_path / "tree"
    write(top, SOURCES)
    live = CodeIndex.open(spark, str(top))
    log, state_dir = str(tmp_path / "log"), str(tmp_path / "state")
    poller = ChangePoller(str(top), log)
    assert poller.poll() == 0
    write(top, {"math.rs": "pub fn plus() {}\n", "new.py": "def fresh():\n    load()\n"})
    (top / "main.rs").unlink()
    assert poller.poll() == 3
    for _ in range(2):
        running = stream(spark, live, log, state_dir, available_now=True)
        running.awaitTermination()
        assert running.exception() is None
        assert content(live) == content(CodeIndex.open(spark, str(top)))
        write(top, {"math.rs": "pub fn plus() { fresh() }\n"})
        poller.poll()
    live.reindex_file("new.py", None)
    assert "fresh" not in ids(live)


def test_state(spark):
    old = state.file_state(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, text string"))
    new = state.file_state(spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "")], "path string, text string"))
    assert {tuple(r) for r in state.diff(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    assert not state.files_changed(old, old)
    assert {r["path"] for r in state.changed_since(old, new).collect()} == {"b", "d"}


def call(server, name, /, **arguments):
    reply = server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    return reply["result"]["content"][0]["text"] if "result" in reply else reply["error"]["code"]


def test_server(index):
    server = Server(index)
    assert call(server, "search_code", query="add") == "Found 4 matches in 2 files"
    assert call(server, "find_symbol", name="twice") == "- twice (Function) at math.rs:5:7"
    assert "pub fn add" in call(server, "get_definition", name="add")
    assert "- main (Calls) at main.rs:3" in call(server, "find_references", name="add") == call(server, "find_references", symbol="add")
    assert call(server, "find_references", name="add", max_tokens=1).endswith("1 more from offset 1")
    assert "main" in call(server, "find_callers", symbol="add") and "twice" in call(server, "find_callees", symbol="main")
    assert call(server, "get_context", query="add").startswith("Context: ")
    assert call(server, "search_code") == -32602 and call(server, "nothing") == -32602
    assert server.handle({"jsonrpc": "2.0", "id": 2, "method": "none"})["error"]["code"] == -32601
    assert server.handle({"id": 2})["error"]["code"] == -32600
    assert json.loads(server.handle_line("{"))["error"]["code"] == -32700
    assert server.handle_line("  ") is None
    assert server.handle({"jsonrpc": "2.0", "method": "health"}) is None
    server.cancelled.add("1")
    assert call(server, "search_code", query="add") == -32800
    server.timeout_ms = 0
    assert call(server, "search_code", query="add") == -32801
    sink = io.StringIO()
    Server(index).serve(io.StringIO('{"jsonrpc":"2.0","id":1,"method":"tools/list"}\n\n{"jsonrpc":"2.0","id":2,"method":"shutdown"}\n{"x"'), sink)
    replies = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert len(replies[0]["result"]["tools"]) == 7 and replies[1]["id"] == 2 and len(replies) == 2


def test_server_pages_hot_names(spark):
    n = 1050
    rows = [(i, f"f{i:04}.py", ("def top():\n    user_1049()\n\n" if i == 0 else "") + f"def new():\n    pass\n\ndef user_{i}():\n    new()\n") for i in range(n)]
    server = Server(CodeIndex.from_files(spark, spark.createDataFrame(rows, "file_id long, path string, text string")))

    def pages(tool, **arguments):
        out, offset = [], 0
        while True:
            *lines, last = call(server, tool, offset=offset, **arguments).splitlines()
            out += lines
            if " more from offset " not in last:
                return [*out, last]
            more, offset = int(last.split()[0]), int(last.split()[-1])
            assert len(lines) == 200 and more > 0 and offset == len(out)

    assert len(set(pages("find_symbol", name="new"))) == n
    assert len(set(pages("find_references", symbol="new"))) == n
    callers = pages("find_callers", symbol="new")
    assert len(set(callers)) == n + 1 and callers[-1].startswith("- top ") and callers[-1].endswith("depth 2")
    assert all(c.endswith("depth 1") for c in callers[:-1])
    assert call(server, "find_symbol", name="new", offset=-1) == -32602
    assert call(server, "find_symbol", name="new", offset=n) == f"Nothing from offset {n} on"


def test_cli(index):
    args = cli.parser().parse_args(["--format", "jsonl", "--", "add"])
    rows = [json.loads(x) for x in cli.answer(index, "add", args).splitlines()]
    assert rows[0]["file"] == "math.rs" and rows[0]["lines"] == "1-3"
    for mode in cli.MODES:
        for kind in ("json", "compact", "full"):
            args = cli.parser().parse_args(["--mode", mode, "--format", kind])
            assert cli.answer(index, "add", args)
    args = cli.parser().parse_args([])
    assert cli.answer(index, "nothing at all", args).startswith("No results found for")
