"""The pipeline's stages on nulls, repeated rows, extra columns with clashing names, and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import debruijn, minhash, packing, toxicity

WORDS = " ".join(f"word{i}" for i in range(90))
TAIL = " " + " ".join(f"own{i}" for i in range(40))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 string, _kept int, doc long, kind string, node long, component string, sketch int, l int, rank string"
EXTRA = ("a", 1, 2, "b", 3, "c", 4, 5, "d")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 0), (2, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


ROWS = [
    (1, WORDS, "en", "s", 10, *EXTRA),
    (2, None, None, None, None, *[None] * 9),
    (4, "", None, "s", 0, *EXTRA),
    (None, WORDS, "en", None, None, *EXTRA),
    (6, WORDS + " tail", "en", "s", 1, *EXTRA),
    (7, "other " + WORDS + TAIL, "en", "s", 1, *EXTRA),
    (7, "other " + WORDS + TAIL, "en", "s", 1, *EXTRA),
]


def test_stages(spark, tables):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    near = corpus_pipeline.drop_near_copies(spark, docs, tables)
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in near.collect()) == [-1, 1, 2, 4, 7, 7]
    parted = corpus_pipeline.drop_repeated_passages(spark, docs, tables)
    assert parted.columns == docs.columns and parted.count() == len(ROWS)
    texts = {r["doc_id"]: r for r in parted.collect()}
    assert texts[6]["text"] == "tail" and texts[6]["n_chars"] == 4 and texts[6]["_kept"] == 1 and texts[None]["text"] == WORDS
    assert texts[7]["text"] == "other\n" + TAIL.strip()
    assert corpus_pipeline.pack_sequences(spark, docs, tables).count() == len(ROWS)
    clean = corpus_pipeline.drop_toxic(spark, docs, tables)
    assert clean.columns == docs.columns


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, 3, 1, 2, 3, 4) for i in range(5)], "doc_id long, length long, l int, lot int, rank int, sequence_id int")
    packed = packing.pack(rows, 7, [F.col("doc_id")])
    assert packed.columns == ["doc_id", "length", "l", "lot", "rank", "sequence_id", "offset"]
    assert packed.select("sequence_id").distinct().count() == 3 and {r["l"] for r in packed.collect()} == {1}
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, score int")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "1 as toxic"))
    assert toxicity.score(docs, model, ["doc_id", "text"]).columns == ["doc_id", "text", "score", "predicted"]
    assert minhash.classes(docs).count() == 1
    assert debruijn.remove(docs).collect() == docs.collect()
