"""Benchmark decontamination: every training passage is a BM25 query against an index of test items.

The inverted index holds, per term, the share of an item's own score that the term brings, with maxima per
block of items. A passage is first bounded by the sum of its terms' largest shares, then by its block maxima, as
in block-max WAND; only blocks whose bound reaches the threshold are scored, and all items above it are
retrieved. A hit counts as a leak if word n-grams of the item's question and of its answer occur in the passage.

Words are runs of characters other than ASCII white space and punctuation, A-Z in lower case. The answer is what
follows the last ``?``, or the last third of the words where nothing does. Defined results: null or empty texts
and items match nothing; rows without id are searched like others; repeated rows and items match each. Only ids
and texts are read. The index is broadcast in shards of at most ``shard_words`` words; document frequencies are
those of the whole benchmark, so the number of shards does not change any score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.text import IS_SPACE, LOWER, U64, PrefixHash, chunks, encoded, mix
from tallyward.session import ship

ship(__name__)

IS_BREAK = IS_SPACE.copy()
IS_BREAK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


@dataclass(frozen=True)
class LeakSettings:
    window: int = 64  # words of a passage; passages overlap by half
    threshold: float = 0.4  # least share of an item's own BM25 score
    block: int = 16  # items per block of the index
    k1: float = 1.2
    b: float = 0.75
    gram: int = 3  # words of an n-gram compared in verification
    question: float = 0.5  # least share of the question's n-grams found
    answer: float = 0.5
    shard_words: int = 2_000_000


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, and offsets per text."""
    buffer = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(IS_BREAK[buffer].astype(np.int8), prepend=1))
    start, end = edges[0::2], edges[1::2]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return PrefixHash(buffer, seed=2).ranges(start, end), np.searchsorted(start, begins)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct n-grams of a word sequence; a shorter sequence is one n-gram."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, dtype=U64)
    acc = np.full(len(words) - size + 1, U64(size), dtype=U64)
    for k in range(size):
        acc = mix(acc * U64(31) + words[k : k + len(acc)])
    return np.unique(acc)


def halves(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer part of an item's words."""
    asked, mark, _ = text.rpartition("?")
    cut = len(plain_words([asked.encode()])[0]) if mark else 0
    if not 0 < cut < len(words):
        cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Postings by term: item and share of its score; the same by block with the block's maximum."""

    vocabulary: np.ndarray
    largest: np.ndarray  # by term
    first: np.ndarray
    item: np.ndarray
    share: np.ndarray
    first_block: np.ndarray
    block: np.ndarray
    block_share: np.ndarray
    ids: list[int]
    parts: list[tuple[np.ndarray, np.ndarray]]  # n-grams of question and answer


def build(items: pd.DataFrame, frequency: dict[int, int], n_items: int, mean_length: float, s: LeakSettings) -> Index:
    items = items.sort_values(["item_id", "text"], kind="stable")
    texts = items["text"].tolist()
    hashes, first = plain_words(encoded(texts))
    rows, parts = [], []
    for i, text in enumerate(texts):
        own = hashes[first[i] : first[i + 1]]
        terms, count = np.unique(own, return_counts=True)
        df = np.array([frequency[int(t)] for t in terms.astype(np.int64)], dtype=float)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        weight = idf * count * (s.k1 + 1) / (count + s.k1 * (1 - s.b + s.b * len(own) / max(1e-9, mean_length)))
        rows.append(pd.DataFrame({"term": terms, "item": i, "share": weight / max(weight.sum(), 1e-12)}))
        parts.append(tuple(grams(p, s.gram) for p in halves(text, own)))
    postings = pd.concat(rows) if rows else pd.DataFrame({"term": [], "item": [], "share": []})
    postings = postings.astype({"term": "uint64", "item": "int64", "share": "float64"})
    postings = postings.sort_values(["term", "item"])
    vocabulary, start = np.unique(postings["term"].to_numpy(), return_index=True)
    by_block = (
        postings.assign(block=postings["item"] // s.block).groupby(["term", "block"], as_index=False)["share"].max()
    )
    term_of_block = by_block["term"].to_numpy(dtype=U64)
    share = postings["share"].to_numpy()
    return Index(
        vocabulary,
        np.maximum.reduceat(share, start) if len(start) else share,
        np.append(start, len(postings)),
        postings["item"].to_numpy(),
        share,
        np.append(np.searchsorted(term_of_block, vocabulary), len(by_block)),
        by_block["block"].to_numpy(),
        by_block["share"].to_numpy(),
        items["item_id"].tolist(),
        parts,
    )


def _gather(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of ``terms``, and how many each has."""
    sizes = first[terms + 1] - first[terms]
    return np.repeat(first[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), sizes


def passages(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last word (exclusive) of the half-overlapping passages of several texts."""
    step = window // 2
    sizes = np.diff(first)
    number = np.where(sizes > 0, np.maximum(1, -(-(sizes - step) // step)), 0)
    owner = np.repeat(np.arange(len(sizes)), number)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begin = first[owner] + rank * step
    return owner, begin, np.minimum(begin + window, first[owner + 1])


def retrieve(
    ids: np.ndarray, begin: np.ndarray, end: np.ndarray, index: Index, s: LeakSettings
) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) of all items that reach the threshold, for passages ``ids[begin:end]``.

    ``ids`` are vocabulary places or -1. Bounds get tighter from step to step and are never too low: words
    counted as often as they occur, distinct terms, block maxima, and then the scores themselves.
    """
    least = s.threshold - 1e-9
    running = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, index.largest[ids], 0.0))])
    left = np.flatnonzero(running[end] - running[begin] >= least)
    blocks, n_items, terms = -(-len(index.ids) // s.block), len(index.ids), len(index.vocabulary)
    at_once = max(1, 2_000_000 // (s.window * max(1, min(blocks, s.window))))  # bounds what is gathered at once
    for k in range(0, len(left), at_once):
        chosen = left[k : k + at_once]
        sizes = end[chosen] - begin[chosen]
        passage = np.repeat(np.arange(len(chosen)), sizes)
        word = ids[np.arange(len(passage)) + np.repeat(begin[chosen] - (np.cumsum(sizes) - sizes), sizes)]
        pair = np.unique((passage * terms + word)[word >= 0])
        passage, term = pair // terms, pair % terms
        bound = np.bincount(passage, weights=index.largest[term], minlength=len(chosen))
        some = bound[passage] >= least
        passage, term = passage[some], term[some]
        at, times = _gather(index.first_block, term)
        place = np.repeat(passage, times) * blocks + index.block[at]
        is_open = np.bincount(place, weights=index.block_share[at], minlength=len(chosen) * blocks) >= least
        some = is_open.reshape(-1, blocks).any(axis=1)[passage]
        passage, term = passage[some], term[some]
        at, times = _gather(index.first, term)
        passage = np.repeat(passage, times)
        some = is_open[passage * blocks + index.item[at] // s.block]
        found, inverse = np.unique(passage[some] * n_items + index.item[at[some]], return_inverse=True)
        score = np.bincount(inverse, weights=index.share[at[some]], minlength=len(found))
        for j in np.flatnonzero(score >= least):
            yield int(chosen[found[j] // n_items]), int(found[j] % n_items), float(score[j])


def overlap(part: np.ndarray, near: dict[int, np.ndarray], size: int) -> float:
    """Share of an item part's n-grams in the text around a passage (1 for an empty part)."""
    if not len(part):
        return 1.0
    if len(part) > 1:
        return float(np.isin(part, near[size]).mean())
    return float(any(np.isin(part, n).any() for n in near.values()))  # may be shorter than an n-gram


def indexes(benchmark: DataFrame, settings: LeakSettings) -> list[Index]:
    """The index in shards of bounded size, with statistics of the whole benchmark."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, first = plain_words(encoded(batch["text"]))
            for i in range(len(batch)):
                own = hashes[first[i] : first[i + 1]].astype(np.int64)
                shard = np.full(len(np.unique(own)), batch["shard_key"].iloc[i])
                yield pd.DataFrame({"shard_key": shard, "term": np.unique(own), "length": len(own)})

    items = benchmark.select("item_id", "text").where("text is not null and trim(text) <> ''")
    items = items.withColumn("shard_key", F.xxhash64("item_id", "text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"[\s\p{Punct}]+"))).alias("words")).first()
    if not size["n"]:
        return []
    shards = max(1, -(-size["words"] // settings.shard_words))
    terms = items.mapInPandas(split, "shard_key long, term long, length long")
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    out = []
    for k in range(shards):
        mine = F.pmod(F.col("shard_key"), F.lit(shards)) == k
        known = frequency.join(terms.where(mine).select("term").distinct(), "term", "left_semi").toPandas()
        df = dict(zip(known["term"].tolist(), known["df"].tolist(), strict=True))
        own = items.where(mine).select("item_id", "text").toPandas()
        out.append(build(own, df, size["n"], size["words"] / size["n"], settings))
    return out


def _search(batch: pd.DataFrame, index: Index, s: LeakSettings) -> list[dict[int, tuple[float, float, float]]]:
    """Leaked items of each document: item to (score, question overlap, answer overlap), best passage each."""
    texts = encoded(batch["text"])
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    if not len(index.vocabulary):
        return out
    for a, b in chunks(texts):
        hashes, first = plain_words(texts[a:b])
        place = np.searchsorted(index.vocabulary, hashes)
        place[place == len(index.vocabulary)] = 0
        ids = np.where(index.vocabulary[place] == hashes, place, -1)
        owner, begin, end = passages(first, s.window)
        for p, i, value in retrieve(ids, begin, end, index, s):
            lower, upper = first[owner[p]], first[owner[p] + 1]
            around = hashes[max(lower, begin[p] - s.window // 2) : min(upper, end[p] + s.window // 2)]
            near = {k: grams(around, k) for k in range(1, s.gram + 1)}
            asked, answered = (overlap(part, near, s.gram) for part in index.parts[i])
            if asked >= s.question and answered >= s.answer:
                found, best = out[a + owner[p]], (min(1.0, value), asked, answered)
                found[i] = max(found.get(i, best), best)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None) -> DataFrame:
    """Per document and leaked item: ``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``."""
    settings = settings or LeakSettings()
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def against(index: Index) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (doc_id, index.ids[i], *found)
                    for doc_id, got in zip(batch["doc_id"], _search(batch, index, settings), strict=True)
                    for i, found in got.items()
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.select("doc_id", "text").mapInPandas(work, schema)

    found = [against(index) for index in indexes(benchmark, settings)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text leaks no item."""
    settings = settings or LeakSettings()
    for index in indexes(benchmark, settings):

        def work(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                clean = np.array([not got for got in _search(batch, index, settings)], dtype=bool)
                yield batch[clean] if len(batch) else batch

        docs = docs.mapInPandas(work, docs.schema)
    return docs
