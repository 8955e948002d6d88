"""From raw documents to training sequences: toxic documents go, one of each group of near copies stays, passages that
an earlier document has go, and the rest is packed into token sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import debruijn, minhash, packing, toxicity
from tessera.llm.common import cut, table

CAPACITY = 4096
END_ID = 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of rows that are not held out, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of 80 % alike sets of five-word shingles."""
    return minhash.representatives(docs, words=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that also start in an earlier document; n_chars follows the text."""
    return debruijn.remove(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place: see the packing operator."""
    pieces = packing.piece_digests(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)
    return packing.pack(pieces, CAPACITY, [F.col(c) for c in ("doc_id", "piece", "ids_crc32")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express the classifier; a test holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage kept is cut from its lineage before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
