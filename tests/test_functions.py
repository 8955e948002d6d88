import pytest
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_languages(spark):
    paths = ["a.rs", "b/c.py", "d.JS", "e.xyz", "f.h", "noext", "g.tsx"]
    got = [r["x"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(T.language_of(F.col("p")).alias("x")).collect()]
    assert got == ["rust", "python", "javascript", "unknown", "cpp", "unknown", "typescript"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("fn main() { let x = 5; if é_b }"))) == ["fn", "main", "let", "x", "5", "é", "b"]
    assert one(spark, T.estimate_tokens(F.lit("éé1"))) == 2
    assert one(spark, T.estimate_tokens(F.lit(""))) == 0


@pytest.mark.parametrize(
    ("query", "mode"),
    [("How does the cache work?", "hybrid"), ("calculate_sum", "lexical"), ("MyStruct::new", "lexical"), ("show_user", "hybrid"), ("a long text of more than twenty bytes", "hybrid"), ("", "lexical")],
)
def test_routing(spark, query, mode):
    assert one(spark, T.analyze_query(F.lit(query))) == mode


def test_strict_routing(spark):
    assert one(spark, T.analyze_query(F.lit("show_user"), strict_words=True)) == "lexical"


def test_compact():
    assert T.compact("abc", 1) == "abc"
    text = "\n".join(f"line {i}" for i in range(50))
    cut = T.compact(text, 20)
    assert len(cut.encode()) <= 80
    assert cut.startswith("line 0\n")
    kept, more = cut.rsplit("...\n[", 1)
    assert int(more.split()[0]) == text.count("\n") - kept.count("\n")
    assert len(T.compact("é" * 100, 10).encode()) <= 40
    assert T.compact("x" * 100, 1) is None


def test_ranges(spark):
    i = F.lit
    assert one(spark, T.contains_byte(i(2), i(5), i(2)))
    assert not one(spark, T.contains_byte(i(2), i(5), i(5)))
    assert one(spark, T.contains_range(i(2), i(5), i(3), i(5)))
    assert not one(spark, T.overlaps(i(2), i(5), i(5), i(6)))
    assert one(spark, T.line_count(i(2), i(5))) == 4


def test_scores(spark):
    total = lambda name, kind, tie, query, near: one(spark, scores.total(scores.components(F.lit(name), F.lit(kind), F.lit(tie), F.lit(query), F.lit(near))))
    assert total("add", "Function", "References", "add", 0.0) == 220
    assert total("match:let add", "Variable", None, "add", 0.0) == 130
    assert total("semantic:1:2", "Variable", None, "add", 0.5) == 155
    assert total("x", "Call", None, "add", 0.0) == -20
    assert total("x", "Function", "Implements", "add", 0.0) == 70
    assert total("x", "Function", "Calls", "add", 0.0) == 140
    assert one(spark, scores.combine_scores(F.array(F.lit(0.5), F.lit(1.0)), F.lit(0))) == 0.375
    assert one(spark, scores.combine_scores(F.array().cast("array<double>"), F.lit(0))) == 0
    assert one(spark, scores.combine_scores(F.array(F.lit(0.01)), F.lit(0))) == 0.1
    assert one(spark, T.strip_self(F.lit("self::self::f"))) == "f"
