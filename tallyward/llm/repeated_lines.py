"""Repeated lines and sentences removed by global hashing of normalised units.

A text is cut into lines, and lines into sentences. A unit is normalised to its words (A-Z in lower case, ASCII
white space and punctuation are breaks) and digested to 128 bits. Of all units with the same digest the earliest by
(doc_id, place) stays, and the rest are removed; offsets are code points of the original text. A unit with fewer
than ``least_words`` words is ordinary language and never judged alone, but goes with its line.

Digests are counted with map-side aggregation and joined back, so a line in a third of all documents needs no task
of its own. Defined results: null and empty texts have no units; rows without id rank last and count as one
document; rows that share an id count as one document, so equal units of theirs all stay; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.leak_index import IS_BREAK
from tallyward.llm.text import IS_SPACE, LOWER, U64, PrefixHash, chunks, encoded, mix, strings
from tallyward.session import ship

ship(__name__)

NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class UnitSettings:
    least_words: int = 4
    sentences: bool = True


def _sequence_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of ranges of a word sequence."""
    base = U64(0xD1342543DE82EF95 + 2 * seed)
    inverse = U64(pow(int(base), -1, 1 << 64))
    powers, back = np.full(len(words) + 1, base, dtype=U64), np.full(len(words) + 1, inverse, dtype=U64)
    powers[0] = back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(mix(words + U64(seed)) * powers[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(U64))


def units(texts: list[bytes], settings: UnitSettings) -> pd.DataFrame:
    """Units of several texts: ``owner``, ``start``, ``end``, ``h1``, ``h2``, ``again`` (repeats an earlier unit of
    its own text)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.flatnonzero(np.diff(IS_BREAK[raw].astype(np.int8), prepend=1))
    words = PrefixHash(LOWER[raw], seed=3).ranges(edges[0::2], edges[1::2])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    after_line = np.flatnonzero(raw == 10) + 1
    parts = []
    line_starts = np.unique(np.concatenate([[0], after_line[after_line < len(raw)], begins[:-1]]))
    stop = (raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)
    sentence_starts = np.union1d(line_starts, np.flatnonzero(stop & IS_SPACE[raw[1:]]) + 2)
    sentence_starts = sentence_starts[sentence_starts < len(raw)]
    for level, starts in ((1, line_starts), (2, sentence_starts)):
        if level == 2 and not settings.sentences:
            break
        ends = np.append(starts[1:], len(raw))
        owner = np.searchsorted(begins, starts, side="right") - 1
        ends = np.minimum(ends, begins[owner + 1] - 1)  # not the separator after a text
        first, last = np.searchsorted(edges[0::2], starts), np.searchsorted(edges[0::2], ends)
        keep = last - first >= settings.least_words
        if level == 2:  # a line of one sentence is judged as a line
            line = np.searchsorted(line_starts, starts, side="right") - 1
            keep &= np.bincount(line, minlength=len(line_starts))[line] > 1
        first, last = first[keep], last[keep]
        parts.append(
            pd.DataFrame(
                {
                    "owner": owner[keep],
                    "start": points[starts[keep]] - points[begins[owner[keep]]],
                    "end": points[ends[keep]] - points[begins[owner[keep]]],
                    "h1": _sequence_hashes(words, first, last, level).astype(np.int64),
                    "h2": _sequence_hashes(words, first, last, level + 10).astype(np.int64),
                }
            )
        )
    out = pd.concat(parts, ignore_index=True)
    out["again"] = out.duplicated(["owner", "h1", "h2"])
    return out


def unit_rows(docs: DataFrame, settings: UnitSettings) -> DataFrame:
    """All units: ``rank_id``, ``text_key``, ``start``, ``end``, ``h1``, ``h2``, ``again``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = encoded(batch["text"])
            ids, keys = batch["rank_id"].to_numpy(), batch["text_key"].to_numpy()
            for a, b in chunks(texts):
                found = units(texts[a:b], settings)
                owner = found.pop("owner").to_numpy() + a
                found.insert(0, "text_key", keys[owner])
                found.insert(0, "rank_id", ids[owner])
                yield found

    keyed = docs.where("text <> ''").select(*_keys(), "text")
    return keyed.mapInPandas(
        work, "rank_id long, text_key long, start long, end long, h1 long, h2 long, again boolean"
    )


def _keys():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("rank_id"), F.xxhash64("text").alias("text_key")


def removed_spans(docs: DataFrame, settings: UnitSettings | None = None) -> DataFrame:
    """Units to remove: ``rank_id``, ``text_key``, ``start``, ``end``."""
    found = unit_rows(docs, settings or UnitSettings())
    shared = (
        found.where("not again")
        .groupBy("h1", "h2")
        .agg(F.min("rank_id").alias("earliest"), F.max("rank_id").alias("latest"))
        .where("latest > earliest")
        .drop("latest")
    )
    return (
        found.join(shared, ["h1", "h2"], "left")
        .where("again or rank_id > earliest")
        .select("rank_id", "text_key", "start", "end")
    )


def deduplicate(docs: DataFrame, settings: UnitSettings | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``text`` (what stays), ``removed`` (merged code point ranges of the original text),
    ``n_removed`` (code points)."""
    spans = (
        removed_spans(docs, settings)
        .groupBy("rank_id", "text_key")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text
    )

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for text, cut in zip(batch["text"], batch["spans"], strict=True):
                merged: list[list[int]] = []
                for s in sorted((int(c["start"]), int(c["end"])) for c in cut) if cut is not None else []:
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                if merged:
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))
                kept.append(text)
                removed.append([{"start": a, "end": b} for a, b in merged])
                sizes.append(sum(b - a for a, b in merged))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "text": strings(kept), "removed": removed, "n_removed": sizes}
            )

    return (
        docs.select("doc_id", "text", *_keys())
        .join(spans, ["rank_id", "text_key"], "left")
        .select("doc_id", "text", "spans")
        .mapInPandas(rebuild, "doc_id long, text string, removed array<struct<start:long,end:long>>, n_removed long")
    )
