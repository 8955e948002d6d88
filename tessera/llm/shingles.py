"""Words and word shingles of whole texts as 63-bit hashes, vectorised by document."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words whose hashes a worker keeps; the table is emptied when it is full.
KEPT_WORDS = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, 7)
        return h


_words = _Words()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the ASCII blanks 0x20 and 0x09 to 0x0D; `lower` maps only A-Z. Null has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` words: doubling, so that a long run takes a logarithmic number of passes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, power, span, at = None, 0, MULTIPLIER, 1, h
    rest = n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = at, span
                else:
                    size = len(h) - (done + span) + 1
                    out = out[:size] * power + at[done : done + size]
                    done += span
            rest >>= 1
            if rest:
                at = at[: len(at) - span] * power + at[span:]
                power = power * power
                span *= 2
        return mix(out)


def shingle_set(text: str | None, n: int, lower: bool) -> np.ndarray:
    """Sorted distinct hashes of the `n`-word shingles; fewer words are one shingle, no words none."""
    words = split(text, lower)
    if not words:
        return np.empty(0, np.int64)
    h = hashes(words)
    found = windows(h, n) if len(words) >= n else windows(h, len(words)) ^ np.uint64(len(words))
    return np.unique((found >> np.uint64(1)).astype(np.int64))


def fingerprint(found: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()
