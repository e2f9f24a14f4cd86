"""Exact removal of repeated byte strings by bucket refinement of sampled suffixes.

Every string of ``window`` bytes that also starts in a document with a smaller id is removed, byte by byte.

1. Initial buckets. A window is represented by the suffix that starts at its anchor, its q-gram with the smallest
   hash, so equal windows fall into the same q-gram bucket at the same place. Consecutive windows with one anchor
   form a run: about one suffix in fifteen bytes is bucketed instead of every one.
2. First refinement. A bucket is sorted on the identifiers of the whole runs (the bytes before and after the
   q-gram). In a class of equal runs all but those of the smallest document are settled. A bucket with one class
   is settled entirely; in a mixed bucket only the first document of each class goes on.
3. Last refinement. The windows of those runs are sorted on the identifiers of both halves, the pointers at their
   own and at the later offset, and settled against the smallest document of each final bucket.

Identifiers are hashes: 80 bits for runs inside a bucket, 128 bits for windows. Whole texts are used; texts move
compressed; equal runs of one task are merged before the shuffle. Defined results: null and empty texts have 0
bytes; texts shorter than a window lose nothing; rows without id rank last and count as one document, as do rows
that share an id; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.byte_runs import runs_of
from tallyward.llm.text import U64, PrefixHash, chunks, encoded, mix
from tallyward.session import materialize, ship

ship(__name__)

#: Texts of a batch that are held as bytes at once.
SLICE_ROWS = 512
NO_ID = (1 << 63) - 1
#: Runs of one task and group: bucket, identifier, document, text, start and windows; then those settled at once.
COLUMNS = ["part", "g", "w", "d", "k", "s", "n", "d2", "k2", "s2", "n2"]
PACKED = "part int, " + ", ".join(f"{c} binary" for c in COLUMNS[1:])
SPANS = "rank_id long, text_key long, start long, windows int, settled boolean"


@dataclass(frozen=True)
class SubstringSettings:
    window: int = 50
    q: int = 20
    bucket_bytes: int = 8_000_000  # text behind one group of buckets
    refined: int = 40_000  # runs in one group of the last refinement
    flush: int = 250_000  # runs gathered in a task before they are sent, about 41 bytes each


def _keys():
    return F.coalesce("doc_id", F.lit(NO_ID)).alias("rank_id"), F.xxhash64("text").alias("text_key")


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), SLICE_ROWS):
            yield batch.iloc[k : k + SLICE_ROWS]


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(U64)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def _sent(gathered: list[tuple[np.ndarray, ...]], groups: int) -> pd.DataFrame:
    """Runs of one task by bucket group; equal runs of the same task keep their smallest document only in
    ``first``, the others are marked as settled at once."""
    ids, keys, start, windows, gram, whole = (np.concatenate(c) for c in zip(*gathered, strict=True))
    order = np.lexsort((start, ids, whole, gram))
    g, w, d = gram[order], whole[order], ids[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
    least = d[head][np.cumsum(head) - 1]
    later = np.zeros(len(order), dtype=bool)
    later[order] = d > least
    again = np.zeros(len(order), dtype=bool)  # the same run of a repeated row
    at, before = order[1:], order[:-1]
    again[at] = ~head[1:] & (d[1:] == d[:-1]) & (start[at] == start[before]) & (keys[at] == keys[before])
    group = (gram >> U64(40)) % U64(groups)
    rows = []
    place = np.argsort(group, kind="stable")  # keeps the order of documents, which packs well
    edges = np.searchsorted(group[place], np.arange(groups + 1))
    for k in range(groups):
        own = place[edges[k] : edges[k + 1]]
        if not len(own):
            continue
        own = own[~again[own]]
        live, done = own[~later[own]], own[later[own]]
        rows.append(
            (
                k,
                _low_bytes(gram[live], 5),
                _low_bytes(whole[live], 5),
                _pack(np.diff(ids[live], prepend=0)),
                _pack(keys[live]),
                _pack(np.diff(start[live], prepend=0).astype(np.int32)),
                _pack(windows[live].astype(np.uint8)),
                _pack(ids[done]),
                _pack(keys[done]),
                _pack(start[done]),
                _pack(windows[done].astype(np.uint8)),
            )
        )
    return pd.DataFrame(rows, columns=COLUMNS)


def sampled_runs(docs: DataFrame, groups: int, settings: SubstringSettings) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered, size = [], 0
        for batch in _slices(batches):
            texts = encoded(batch["text"])
            ids, keys = batch["rank_id"].to_numpy(), batch["text_key"].to_numpy()
            for a, b in chunks(texts, 500_000):
                r = runs_of(texts[a:b], settings.window, settings.q)
                gathered.append((ids[r.text + a], keys[r.text + a], r.start, r.windows, r.gram, r.whole))
                size += len(r.text)
                if size >= settings.flush:
                    yield _sent(gathered, groups)
                    gathered, size = [], 0
        if size:
            yield _sent(gathered, groups)

    return docs.where("text <> ''").select(*_keys(), "text").mapInPandas(work, PACKED)


def _first_refinement(packed: pd.DataFrame) -> pd.DataFrame:
    """Settled runs, and those of mixed buckets that need another look."""
    columns = []
    for r in packed.itertuples(index=False):
        columns.append(
            (
                _from_low_bytes(r.g, 5),
                _from_low_bytes(r.w, 5),
                np.cumsum(_unpack(r.d, "<i8")),
                _unpack(r.k, "<i8"),
                np.cumsum(_unpack(r.s, "<i4").astype(np.int64)),
                _unpack(r.n, "u1"),
            )
        )
    gram, whole, ids, keys, start, windows = (np.concatenate(c) for c in zip(*columns, strict=True))
    order = np.lexsort((ids, whole, gram))
    gram, whole, ids = gram[order], whole[order], ids[order]
    new_bucket = np.ones(len(order), dtype=bool)
    new_bucket[1:] = gram[1:] != gram[:-1]
    new_class = new_bucket.copy()
    new_class[1:] |= whole[1:] != whole[:-1]
    bucket = np.cumsum(new_bucket) - 1
    settled = ids > ids[new_class][np.cumsum(new_class) - 1]
    classes = np.bincount(bucket[new_class])
    smallest = np.minimum.reduceat(ids, np.flatnonzero(new_bucket)) if len(ids) else ids
    largest = np.maximum.reduceat(ids, np.flatnonzero(new_bucket)) if len(ids) else ids
    mixed = ((classes > 1) & (smallest < largest))[bucket] if len(ids) else settled
    keep = settled | mixed
    at = order[keep]
    live = pd.DataFrame(
        {
            "rank_id": ids[keep],
            "text_key": keys[at],
            "start": start[at],
            "windows": windows[at].astype(np.int32),
            "settled": settled[keep],
        }
    )
    done = [
        pd.DataFrame(
            {
                "rank_id": _unpack(r.d2, "<i8"),
                "text_key": _unpack(r.k2, "<i8"),
                "start": _unpack(r.s2, "<i8"),
                "windows": _unpack(r.n2, "u1").astype(np.int32),
                "settled": True,
            }
        )
        for r in packed.itertuples(index=False)
    ]
    return pd.concat([live, *done], ignore_index=True)


def _last_refinement(runs: pd.DataFrame, settings: SubstringSettings) -> pd.DataFrame:
    """Windows of the given runs (column ``bytes``) that also start in a smaller document."""
    raw = runs["bytes"].tolist()
    buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(x) for x in raw])
    count = sizes - settings.window + 1
    run = np.repeat(np.arange(len(raw)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + offset
    half = settings.window // 2
    one, two = PrefixHash(buffer, seed=11), PrefixHash(buffer, seed=13)
    pointer = one.ranges(at, at + half), two.ranges(at, at + half)
    later = one.ranges(at + half, at + settings.window), two.ranges(at + half, at + settings.window)
    a = mix(pointer[0] * U64(0x9FB21C651E98DF25) + later[0])
    b = mix(pointer[1] * U64(0xD6E8FEB86659FD93) + later[1])
    ids = runs["rank_id"].to_numpy()[run]
    order = np.lexsort((ids, b, a))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    gone = np.zeros(len(order), dtype=bool)
    gone[order] = ids[order] > ids[order][head][np.cumsum(head) - 1]
    found = np.flatnonzero(gone)
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (run[found[1:]] != run[found[:-1]]) | (found[1:] != found[:-1] + 1)
    begin = np.flatnonzero(fresh)
    who = run[found[begin]]
    return pd.DataFrame(
        {
            "rank_id": runs["rank_id"].to_numpy()[who],
            "text_key": runs["text_key"].to_numpy()[who],
            "start": runs["start"].to_numpy()[who] + offset[found[begin]],
            "windows": np.diff(np.append(begin, len(found))).astype(np.int32),
            "settled": True,
        }
    )


def _compressed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``rank_id``, ``text_key`` and the text's bytes, compressed for the shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            yield batch[["doc_id", "rank_id", "text_key"]].assign(
                packed=[zlib.compress(t, 1) for t in encoded(batch["text"])]
            )

    return docs.select("doc_id", *_keys(), "text").mapInPandas(
        work, "doc_id long, rank_id long, text_key long, packed binary"
    )


def _by_document(spans: DataFrame) -> DataFrame:
    """One row per text; repeated rows of a text bring the same runs, which count once."""
    runs = spans.groupBy("rank_id", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    return runs.select(
        "rank_id", "text_key", F.col("runs.start").alias("starts"), F.col("runs.windows").alias("counts")
    )


def repeated_spans(docs: DataFrame, settings: SubstringSettings | None = None) -> DataFrame:
    """Runs of removed windows: ``rank_id``, ``text_key``, ``start`` (byte), ``windows``."""
    s = settings or SubstringSettings()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // s.bucket_bytes))
    refined = materialize(
        sampled_runs(docs, groups, s).groupBy("part").applyInPandas(_first_refinement, SPANS)
    )
    unsettled = refined.where("not settled")
    parts = max(1, -(-unsettled.count() // s.refined))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys, start, raw, part = [], [], [], [], []
            for r in batch.itertuples(index=False):
                text = zlib.decompress(r.packed)
                begins = np.array(r.starts, dtype=np.int64)
                counts = np.array(r.counts, dtype=np.int64)
                pieces = [text[b : b + n + s.window - 1] for b, n in zip(begins.tolist(), counts.tolist(), strict=True)]
                bucket = _buckets(pieces, s)
                ids += [r.rank_id] * len(pieces)
                keys += [r.text_key] * len(pieces)
                start += begins.tolist()
                raw += pieces
                part.append((bucket >> U64(20)) % U64(parts))
            yield pd.DataFrame(
                {
                    "part": np.concatenate(part).astype(np.int32) if part else np.zeros(0, dtype=np.int32),
                    "rank_id": ids,
                    "text_key": keys,
                    "start": start,
                    "bytes": raw,
                }
            )

    pieces = (
        _compressed(docs)
        .drop("doc_id")
        .join(_by_document(unsettled), ["rank_id", "text_key"])
        .dropDuplicates(["rank_id", "text_key"])
        .mapInPandas(cut, "part int, rank_id long, text_key long, start long, bytes binary")
    )
    more = pieces.groupBy("part").applyInPandas(lambda runs: _last_refinement(runs, s), SPANS)
    done = refined.where("settled").unionByName(materialize(more))
    return done.select("rank_id", "text_key", "start", "windows")


def _buckets(pieces: list[bytes], s: SubstringSettings) -> np.ndarray:
    """The q-gram bucket of each run: the gram of its windows' common anchor."""
    r = runs_of(pieces, s.window, s.q)
    first = np.searchsorted(r.text, np.arange(len(pieces)))
    return r.gram[first]


def deduplicate(docs: DataFrame, settings: SubstringSettings | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``removed`` (maximal byte ranges of the original text), ``kept`` (the
    remaining bytes)."""
    s = settings or SubstringSettings()
    spans = _by_document(repeated_spans(docs, s))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            sizes, removed, kept = [], [], []
            for packed, starts, counts in zip(batch["packed"], batch["starts"], batch["counts"], strict=True):
                text = zlib.decompress(packed)
                sizes.append(len(text))
                if starts is None:
                    removed.append([])
                    kept.append(text)
                    continue
                change = np.zeros(len(text) + 1, dtype=np.int64)
                begin = np.array(starts, dtype=np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + np.array(counts, dtype=np.int64) + s.window - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[0::2], edges[1::2], strict=True)])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": sizes, "removed": removed, "kept": kept})

    joined = _compressed(docs).join(spans, ["rank_id", "text_key"], "left")
    return joined.select("doc_id", "packed", "starts", "counts").mapInPandas(
        rebuild, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
