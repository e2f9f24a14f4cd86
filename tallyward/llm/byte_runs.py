"""Runs of windows that share one sampled suffix: the starting point of substring deduplication."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tallyward.llm.text import U64, PrefixHash
from tallyward.session import ship

ship(__name__)

#: Bytes worked on at once; a longer text is cut into segments that overlap by one window less a byte.
SEGMENT = 1 << 21


class Runs(NamedTuple):
    """Runs of consecutive windows with the same anchor, in the order of their text."""

    text: np.ndarray  # index of the text
    start: np.ndarray  # first window start, byte offset in the text
    windows: np.ndarray  # number of windows
    anchor: np.ndarray  # bytes from ``start`` to the anchor
    gram: np.ndarray  # hash of the anchor's q-gram: the initial bucket
    whole: np.ndarray  # hash of all bytes that the windows cover


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from minima inside blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes], window: int, q: int) -> Runs:
    """The anchor of a window is its q-gram with the smallest hash (the first of equals), so equal windows have
    their anchor at the same place, whatever surrounds them."""
    parts: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), SEGMENT - window):
            piece = text[at : at + SEGMENT - 1] if len(text) >= SEGMENT else text
            if len(piece) < window:
                continue
            if size + len(piece) > SEGMENT:
                parts.append(_runs(group, window, q))
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
            if len(text) < SEGMENT:
                break
    parts.append(_runs(group, window, q))
    return Runs(*(np.concatenate(column) for column in zip(*parts, strict=True)))


def _runs(group: list[tuple[int, int, bytes]], window: int, q: int) -> tuple[np.ndarray, ...]:
    if not group:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    buffer = np.frombuffer(b"".join(piece for _, _, piece in group), dtype=np.uint8)
    sizes = np.array([len(piece) for _, _, piece in group])
    first = np.cumsum(sizes) - sizes
    hashed = PrefixHash(buffer, seed=5)
    at = np.arange(len(buffer) - q + 1)
    grams = hashed.ranges(at, at + q)
    low = U64((1 << 24) - 1)
    lowest = _sliding_minimum((grams & ~low) | at.astype(U64), window - q + 1)
    anchor = (lowest & low).astype(np.int64)
    owner = np.repeat(np.arange(len(group)), sizes)
    inside = owner[: len(anchor)] == owner[window - 1 :]
    valid = np.flatnonzero(inside)
    fresh = np.ones(len(valid), dtype=bool)
    fresh[1:] = (anchor[valid[1:]] != anchor[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(valid)))
    start = valid[begin]
    place = anchor[start]
    whole = PrefixHash(buffer, seed=7).ranges(start, start + count + window - 1)
    piece = owner[start]
    texts = np.array([g[0] for g in group])
    offsets = np.array([g[1] for g in group])
    return texts[piece], start - first[piece] + offsets[piece], count, place - start, grams[place], whole
