"""Words, shingles and n-grams of whole texts as numpy arrays, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd

from tallyward.session import ship

ship(__name__)

#: Bytes of text worked on at once inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 1_000_000

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shifts and odd multipliers)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) + U64(seed * 0x632BE59BD9B4E019 % (1 << 64)))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: The word rule: everything but the six ASCII white-space bytes is part of a word.
IS_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` whose total length stays near ``limit``."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


class PrefixHash:
    """Polynomial hashes of any byte range of a buffer in O(1), 64 bits, finally scrambled."""

    def __init__(self, buffer: np.ndarray, seed: int = 1):
        n = len(buffer)
        powers = np.full(n + 1, _BASE, dtype=U64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.inverse = np.full(n + 1, _BASE_INVERSE, dtype=U64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_byte_values(seed)[buffer] * powers[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U64) * _BASE)


class Words(NamedTuple):
    """Words of several texts: hash, byte range in ``buffer``, and where each text's words begin."""

    buffer: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into the word arrays
    text_start: np.ndarray  # byte offset of each text in buffer


def words(texts: list[bytes], lower: bool = True) -> Words:
    """Split at ASCII white space after lower-casing A-Z."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buffer = LOWER[buffer]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_start = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=text_start[1:])
    space = IS_SPACE[buffer]
    edges = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    start, end = edges[0::2], edges[1::2]
    hashes = PrefixHash(buffer).ranges(start, end)
    first = np.searchsorted(start, text_start)
    return Words(buffer, hashes, start, end, first, text_start[:-1])


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words per text: sorted hashes, and offsets per text.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    found = words(texts)
    h, first = found.hashes, found.first
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(h)) - first[:-1][owner]
    full = np.flatnonzero(rank + size <= counts[owner])
    value = np.full(len(full), U64(size), dtype=U64)
    for k in range(size):
        value = mix(value * _BASE + h[full + k])
    who = owner[full]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.empty(len(short), dtype=U64)
        for i, t in enumerate(short):
            acc = np.full(1, U64(counts[t]), dtype=U64)
            for x in h[first[t] : first[t + 1]]:
                acc = mix(acc * _BASE + x)
            whole[i] = acc[0]
        value, who = np.concatenate([value, whole]), np.concatenate([who, short])
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    if len(value):
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        value, who = value[fresh], who[fresh]
    return value, np.searchsorted(who, np.arange(len(texts) + 1))


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of a pandas text column; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]


def strings(values: list) -> pd.Series:
    """A text column that Arrow turns into one array, whatever its length."""
    return pd.Series(values, dtype=object)
