import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import compact
from tessera.operators import graph, lexical, planning, semantic
from tessera.plans import catalog


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")


def test_lines(spark):
    texts = ["a\r\nbé\n\nc", "x\n", "", None, "\n\n", "\n".join("z" * (i % 7) for i in range(200))]
    got = {}
    for r in lexical.lines(files(spark, texts)).collect():
        got.setdefault(r["file_id"], []).append((r["line_number"], r["line"], r["start_byte"], r["end_byte"]))
    assert sorted(got[0]) == [(1, "a", 0, 1), (2, "bé", 3, 6), (3, "", 7, 7), (4, "c", 8, 9)]
    assert got[1] == [(1, "x", 0, 1)]
    assert 2 not in got and 3 not in got
    assert [x[2] for x in sorted(got[4])] == [0, 1]
    for number, line, start, end in got[5]:
        assert texts[5].encode()[start:end].decode() == line == "z" * ((number - 1) % 7)


def test_search_modes(spark):
    lines = lexical.lines(files(spark, ["fn foo(x)\nfoo bar\nFOO\nlet foobar = 1", "none"]))
    hits = lambda p, m: sorted(r["line_number"] for r in lexical.search(lines, p, m).collect() if r["file_id"] == 0)
    assert hits("foo", "exact") == [1, 2, 4]
    assert hits("foo", "case_insensitive") == [1, 2, 3, 4]
    assert hits("foo", "identifier") == [2]
    assert hits("foo", "word") == [1, 2]
    assert hits("^f.o", "regex") == [2]
    assert hits("(", "regex") == []
    assert hits("", "exact") == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        lexical.search(lines, "x", "other")


def test_caps_and_file_filters(spark):
    lines = lexical.lines(files(spark, ["a\n" * 30, "a\n" * 3]))
    assert lexical.search(lines, "a", max_results=5).count() == 8
    assert lexical.search(lines, "a", file_ids=[1]).count() == 3
    assert lexical.search(lines, "a", file_ids=lines.where("file_id = 1")).count() == 3
    assert lexical.search(lines.limit(0), "a").count() == 0
    found = lexical.search_many(lines, {7: ("a", "exact"), 8: ("b", "exact")})
    assert [tuple(r) for r in lexical.summary(found).collect()] == [(7, 33, 2)]


def test_source_slice(spark):
    own = files(spark, ["aéb"])
    ranges = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (0, 0, 9), (0, 2, 1)], "file_id long, start_byte long, end_byte long")
    got = {(r["start_byte"], r["end_byte"]): r["source"] for r in lexical.source_slice(own, ranges).collect()}
    assert got == {(0, 3): "aé", (1, 2): None, (0, 9): None, (2, 1): None}


def test_merge_ranges_covers(spark):
    draw = random.Random(1)
    rows = [(draw.randint(0, 3), s := draw.randint(0, 60), s + draw.randint(0, 9), s, s) for _ in range(60)]
    out = lexical.merge_ranges(spark.createDataFrame(rows, "file_id long, start_byte long, end_byte long, start_line long, end_line long")).collect()
    for file_id in range(4):
        spans = sorted((r["start_byte"], r["end_byte"]) for r in out if r["file_id"] == file_id)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        want = {x for f, s, e, *_ in rows if f == file_id for x in range(s, e + 1)}
        assert want == {x for s, e in spans for x in range(s, e + 1)}


def test_semantic(spark):
    lines = lexical.lines(files(spark, ["fn calculate sum\nfn calculate product\nfn other\n// calculate\n   \n# calculate"]))
    index = semantic.build(lines)
    assert index.fragments == 3
    found = semantic.cosine_search(index, semantic.query_frame(spark, {1: "calculate", 2: "missing"})).collect()
    assert sorted(r["line_number"] for r in found) == [1, 2]
    assert semantic.cosine_search(index, semantic.query_frame(spark, {1: "calculate"}), weighting="tfidf").count() == 2
    empty = semantic.build(lines.limit(0))
    assert semantic.cosine_search(empty, semantic.query_frame(spark, {1: "calculate"})).count() == 0


def test_fusion_ranks(spark):
    lines = lexical.lines(files(spark, ["b\na\na", "a"]))
    found = lexical.search_many(lines, {1: ("a", "exact")})
    ranked = semantic.ranked_positions(found).orderBy("position").select("file_id", "line_number", "position").collect()
    assert [tuple(r) for r in ranked] == [(0, 2, 0), (0, 3, 1), (1, 1, 2)]


def walk(edges, root, depth, up):
    seen, front = {}, {root}
    for level in range(1, depth + 1):
        front = {(a if up else b) for a, b in edges for f in front if (b if up else a) == f} - set(seen)
        seen |= dict.fromkeys(front, level)
    return seen


@pytest.mark.parametrize("up", [True, False])
def test_traversal(spark, up):
    draw = random.Random(2)
    edges = [(draw.randint(0, 15), draw.randint(0, 15)) for _ in range(30)] + [(1, 1), (2, 3), (3, 4), (4, 2)]
    df = spark.createDataFrame(edges, "from_id long, to_id long")
    roots = spark.createDataFrame([(i,) for i in range(16)], "root long")
    got = graph.traverse(df, roots, 3, up).collect()
    want = {(r, n, d) for r in range(16) for n, d in walk(edges, r, 3, up).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert graph.traverse(df, roots, 0, up).count() == 0


@pytest.mark.parametrize("bound", [graph.MOST_STEPS, 20, 3])
@pytest.mark.parametrize("up", [True, False])
def test_traversal_from_all(spark, monkeypatch, up, bound):
    monkeypatch.setattr(graph, "MOST_STEPS", bound)
    monkeypatch.setattr(graph, "TASK_STEPS", 7)
    monkeypatch.setattr(graph, "BATCH_NODES", 3)
    draw = random.Random(4)
    edges = [(draw.randint(0, 40) << 32, draw.randint(0, 15) << 32) for _ in range(60)] + [(1, 1), (2, 3), (3, 4), (4, 2), (2, 3), (50, 1)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "from_id long, to_id long")
    for depth in (1, 2, 3, 5):
        got = graph.traverse_all(df, depth, up).collect()
        want = {(r, n, d) for r in {x for e in edges for x in e} for n, d in walk(edges, r, depth, up).items()}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert graph.traverse_all(df, 0, up).count() == 0
    assert graph.traverse_all(df.limit(0), 3, up).count() == 0


def test_traversal_from_all_shuffles_no_pairs(spark):
    # 300 lines that call 40 names whose lines call one another: 12,000 pairs from 340 rows with an edge.
    edges = [(1000 + i, i % 40) for i in range(300)] + [(i, (i * 7 + j) % 40) for i in range(40) for j in range(6)]
    found = graph.traverse_all(spark.createDataFrame(edges, "from_id long, to_id long"), 3)
    assert found.count() > 9_000
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "distinct" not in plan.lower()


@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_callee_lists(spark, monkeypatch, rows, twice):
    draw = random.Random(5)
    texts = ["\n".join(" ".join(f"w{draw.randint(0, 25)}" for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 9))) for _ in range(30)]
    own = files(spark, texts).repartition(3)
    if twice:
        # Its lines lie in two places, and names of either are its own.
        own = own.withColumn("file_id", F.when(F.col("file_id") == 29, 0).otherwise(F.col("file_id")))
    monkeypatch.setattr(graph, "SMALL_NAMES", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        lines = lexical.lines(own)
        symbols, calls = catalog.text_symbols(lines, 2)
        want = {tuple(r)[:2] for r in graph.resolve_calls(calls, symbols).collect()}
        found = graph.callee_lists(catalog.named_lines(lines, 2), own)
        got = [(r["from_id"], to) for r in found.collect() for to in r["to"]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and set(got) == want and len(got) == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert twice or "Join" not in plan and "Aggregate" not in plan


def test_registered_traversal_shuffles_no_calls(spark, monkeypatch, tmp_path):
    # However many names there are, calls are not joined with them.
    monkeypatch.setattr(graph, "SMALL_NAMES", 0)
    monkeypatch.setattr(graph, "resolve_calls", lambda *_: pytest.fail("calls are joined"))
    docs = spark.createDataFrame([(1, "alpha beta\nbeta gamma alpha", "s", "en"), (2, "gamma beta\n", "s", "en")], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    a, b, g = 1 << 32, (1 << 32) + 11, 2 << 32
    want = {(a, b, 1), (a, g, 2), (a, a, 2), (b, g, 1), (b, a, 1), (b, b, 2), (g, b, 1), (g, a, 2), (g, g, 2)}
    assert {tuple(r) for r in catalog.QUERIES["all_callees_upto_3"](spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in catalog.QUERIES["all_callers_upto_3"](spark, str(tmp_path)).collect()} == {(y, x, d) for x, y, d in want}


def test_call_resolution(spark):
    symbols = spark.createDataFrame([(1, "f", 0, None, "a"), (2, "f", 1, None, "b"), (3, "g", 1, "T", "b"), (4, "new", 2, "P", "c"), (5, "P", 2, None, "c"), (6, "only", 2, "P", "c")], "symbol_id long, name string, file_id long, parent_name string, stem string")
    rows = [(10, 0, "f", None), (11, 1, "self::f", None), (12, 3, "f", None), (None, 0, "f", None), (13, 1, "self.g", "T"), (14, 0, "P::new", None), (15, 0, "String::new", None), (16, 0, "b::f", None), (17, 0, "x.only", None), (18, 0, "zzz", None)]
    calls = spark.createDataFrame(rows, "caller long, file_id long, callee_name string, parent_name string")
    strict = {tuple(r)[:2] for r in graph.resolve_calls(calls, symbols).collect()}
    assert strict == {(10, 1), (11, 2), (12, 1)}
    local = {tuple(r)[:2] for r in graph.resolve_local(calls, symbols).collect()}
    assert local == {(10, 1), (11, 2)}
    wide = {tuple(r)[:2] for r in graph.resolve_qualified(calls, symbols).collect()}
    assert wide == {(10, 1), (11, 2), (12, 1), (13, 3), (14, 4), (16, 2), (17, 6)}


def brute_plan(rows, budget, compacting):
    used, taken, seen_files, seen = 0, [], set(), set()
    for r in rows:
        if len(taken) >= budget.max_symbols or used >= budget.max_tokens:
            break
        if (r["file_id"], r["start_byte"]) in seen or (r["file_id"] not in seen_files and len(seen_files) >= budget.max_files):
            continue
        content = r["content"]
        size = -(-len(content.encode()) // 4)
        if size > budget.max_tokens - used:
            content = compact(content, budget.max_tokens - used) if compacting else None
            if content is None:
                continue
            size = -(-len(content.encode()) // 4)
        seen.add((r["file_id"], r["start_byte"]))
        seen_files.add(r["file_id"])
        used += size
        taken.append((r["file_id"], r["start_byte"], size))
    return taken


@pytest.mark.parametrize("compacting", [True, False])
def test_plan_invariants(spark, compacting):
    draw = random.Random(3)
    texts = ["\n".join("w" * draw.randint(0, 90) for _ in range(40)) for _ in range(8)]
    own = files(spark, texts)
    lines = lexical.lines(own)
    asked = semantic.query_frame(spark, {1: "w"})
    ranked = planning.rank(planning.lexical_candidates(lexical.search_many(lines, {1: ("w", "exact")}), asked))
    ordered = [r.asDict() for r in ranked.orderBy(*planning.order()).collect()]
    for r in ordered:
        r["content"] = texts[r["file_id"]].encode()[r["start_byte"] : r["end_byte"]].decode()
    for budget in (planning.TokenBudget(60, 2, 5), planning.TokenBudget(0), planning.TokenBudget(100, 1, 20), planning.TokenBudget(9)):
        got = planning.plan(ranked, own, budget, compacting).orderBy("position").collect()
        assert [(r["file_id"], r["start_byte"], r["token_count"]) for r in got] == brute_plan(ordered, budget, compacting)
        assert sum(r["token_count"] for r in got) <= budget.max_tokens
        assert len({r["file_id"] for r in got}) <= budget.max_files and len(got) <= budget.max_symbols


@pytest.mark.parametrize("compacting", [True, False])
def test_plan_takes_a_line_where_a_longer_range_is_refused(spark, compacting):
    text = "\n".join(["w" * 30] * 10)
    own = files(spark, [text, text])
    asked = semantic.query_frame(spark, {1: "w"})
    whole = spark.createDataFrame([(i, "w", "Function", i, 0, len(text), 1, 10) for i in range(2)], "symbol_id long, name string, kind string, file_id long, start_byte long, end_byte long, start_line int, end_line int")
    found = lexical.search_many(lexical.lines(own), {1: ("w", "exact")})
    ranked = planning.rank(planning.symbol_candidates(whole, asked).unionByName(planning.lexical_candidates(found, asked)))
    ordered = [r.asDict() for r in ranked.orderBy(*planning.order()).collect()]
    for r in ordered:
        r["content"] = text[r["start_byte"] : r["end_byte"]]
    for budget in (planning.TokenBudget(16), planning.TokenBudget(60), planning.TokenBudget(90), planning.TokenBudget(200, 2, 3), planning.TokenBudget(200)):
        want = brute_plan(ordered, budget, compacting)
        got = planning.plan(ranked, own, budget, compacting).orderBy("position").collect()
        assert [(r["file_id"], r["start_byte"], r["token_count"]) for r in got] == want
        assert compacting or budget.max_tokens > 60 or (0, 0, 8) in want
