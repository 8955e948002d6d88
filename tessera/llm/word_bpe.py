"""Ids of whole texts by a `tokenizers` file with word ends, for corpora: each distinct word is tokenised once a worker.

The file's pre-tokeniser never joins across blanks, so a text is the concatenation of its blank-separated chunks. A
chunk of plain Latin letters is normalised and split here, as the file says; any other goes whole through the library.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: Distinct chunks and pieces that a worker keeps; a table is emptied when it is full.
KEPT_CHUNKS = 400_000
KEPT_PIECES = 250_000
#: The file's own rule for pieces of a lower-cased chunk.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that normalisation form C keeps and whose lower case is the same one by one in every implementation.
PLAIN = re.compile("[\x21-\x7e¡-įı-ɏ]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
#: Marks that commonly end a word and are always a piece of their own after a letter.
ENDS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        packed = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Words(dict):
    """Chunk to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        self.pieces = _Pieces(self.whole.model)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        if not (chunk.isascii() or PLAIN.fullmatch(chunk)):
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        elif chunk.isalpha():
            packed = self.pieces[chunk.lower()]
        elif chunk[-1] in ENDS and chunk[:-1].isalpha():
            packed = self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        else:
            packed = b"".join([self.pieces[p] for p in PIECES.findall(chunk.lower())])
        self[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null is the empty text. A text that holds the string of an added token, which may
        reach over chunks, goes whole through the library."""
        text = text or ""
        if self.special.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        # str.split also parts at four control characters, which the file's rule takes as visible.
        parts = BLANKS.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.__getitem__, filter(None, parts)))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One table for each worker process and file."""
    return Words(path)
