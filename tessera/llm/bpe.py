"""Byte-level BPE by the tiktoken library with a local rank file.

Long texts are split before encoding at boundaries where no match of the pattern can span, so that memory and time
stay linear in the text; decoding joins the ranks' raw bytes and never passes through a lossy string.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches

#: Characters encoded in one call.
SLICE = 1 << 16
#: A blank or line feed after a visible character: every alternative of the pattern ends before it, and it begins a match.
BOUNDARY = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


class Codec:
    """Encoder and decoder over one rank file; `pattern` splits texts before merging. No special tokens exist."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimals = [str(i) for i in range(max(ranks.values()) + 1)]

    def slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE:
            found = BOUNDARY.search(text, start + SLICE)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is the empty text."""
        if not text:
            return []
        if len(text) <= SLICE:
            return self.encoding.encode_ordinary(text)
        return [i for part in self.slices(text) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        """The exact bytes that were encoded."""
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and rank file."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, ids array<int>` for each row, in the same partitions (no shuffle).

    Null and empty texts give an empty array; null ids, ties and repeated rows stay as they are; other columns are not
    read. An empty table gives an empty result.
    """
    return transform(df, path, pattern, lambda c, texts: {"ids": [c.encode(t) for t in texts]}, "ids array<int>", id_col, text_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col, bytes binary` from arrays of ids; null arrays give empty bytes."""
    return transform(df, path, pattern, lambda c, rows: {"bytes": [c.decode(r or []) for r in rows]}, "bytes binary", id_col, ids_col)


def transform(df: DataFrame, path: str, pattern: str, fn: Callable[[Codec, list], dict[str, list]], fields: str, id_col: str = "doc_id", value_col: str = "text") -> DataFrame:
    """Apply `fn(codec, values)` to batches; `fields` is the DDL of the columns that it returns beside the id."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("key"), df[value_col].alias("value"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"key": batch["key"]} | fn(codec(path, pattern), batch["value"])

    return map_batches(source, run, f"key {kind}, {fields}").withColumnRenamed("key", id_col)



def digests(c: Codec, texts: list[str | None]) -> dict[str, list]:
    """Counts and digests of a round trip: encode the whole text, hash the ids, decode them, hash the bytes."""
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for text in texts:
        ids = c.encode(text)
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(" ".join([c.decimals[i] for i in ids]).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
    return out
