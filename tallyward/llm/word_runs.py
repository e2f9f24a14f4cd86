"""Periodic runs of words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` and ``min_powers`` * q long,
that no neighbouring word extends. Per text:

1. Words that no such run can hold are put aside exactly: each word of a run lies in a window of ``2/3 min_words``
   words that occurs once more in the same stretch. What is left are a few stretches, or none.
2. Of each stretch the suffix automaton is built; its suffix links form a tree whose nodes are the classes of
   substrings by end position. Words are then appended one after the other: the path from the prefix's node to the
   root is accessed, and its preferred-path segments tell, for each range of lengths, where the suffix of that length
   ended last; the path is recoloured with the new end. A segment whose distance p between last and new end is one of
   its own lengths shows a square of root length p, and only a primitive root can show so. Preferred paths are kept as
   stacks of coloured intervals on the heavy paths of the tree, so an access is amortised over what it recolours.
3. Squares of one period at consecutive ends make a run; it begins two periods before the first end.

Defined results: a null or empty text has no runs and an empty collapsed text; ties between words are exact equality
of their bytes (case counts); repeated documents are judged each; other columns are not read. Memory is linear in the
longest periodic stretch of one text, about 1 kB a word of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.text import U64, encoded, mix, strings
from tallyward.session import ship

ship(__name__)


@dataclass(frozen=True)
class RunSettings:
    min_words: int = 24
    min_powers: int = 3  # least length in periods; from 2

    def __post_init__(self) -> None:
        if self.min_powers < 2 or self.min_words < 2:
            raise ValueError("runs have at least two words and two periods")

    @property
    def window(self) -> int:
        """A window this long around any word of a run recurs one period away inside the run."""
        return max(1, self.min_words - self.min_words // self.min_powers)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links, longest lengths, and the state of each prefix."""
    link, length, after, prefix = [-1], [0], [{}], []
    last = 0
    for word in words:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        p = last
        while p >= 0 and word not in after[p]:
            after[p][word] = state
            p = link[p]
        if p >= 0:
            q = after[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(after[q].copy())
                while p >= 0 and after[p].get(word) == q:
                    after[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        prefix.append(state)
        last = state
    return link, length, prefix


def heavy_paths(link: list[int], length: list[int]) -> list[int]:
    """The top node of each node's heavy path; the root is a path of its own."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size = [1] * len(link)
    heavy, weight = [-1] * len(link), [0] * len(link)
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if size[v] > weight[up]:
            weight[up], heavy[up] = size[v], v
    top = list(range(len(link)))
    for v in order[1:]:
        up = link[v]
        if up and heavy[up] == v:
            top[v] = top[up]
    return top


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(end, root length) of every square with a primitive root, by end."""
    link, length, prefix = automaton(words)
    top = heavy_paths(link, length)
    stacks: dict[int, list[tuple[int, int]]] = {}
    for end, v in enumerate(prefix):
        while v:
            head, deep = top[v], length[v]
            above = link[head]
            low = length[above]
            stack = stacks.get(head)
            if stack is None:
                stacks[head] = [(deep, end)]
            else:
                # the last entry lies next to the top; each tells how deep its colour reaches
                while stack:
                    reach, ended = stack[-1]
                    high = reach if reach < deep else deep
                    if low < end - ended <= high:
                        yield end, end - ended
                    if reach > deep:
                        break
                    low = reach
                    stack.pop()
                stack.append((deep, end))
            v = above


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least two periods."""
    open_runs: dict[int, list[int]] = {}
    done = []
    for end, period in squares(words):
        run = open_runs.get(period)
        if run is not None and run[1] == end - 1:
            run[1] = end
        else:
            if run is not None:
                done.append((run[0], run[1], period))
            open_runs[period] = [end, end]
    done += [(first, last, period) for period, (first, last) in open_runs.items()]
    return [(first - 2 * period + 1, last - first + 2 * period, period) for first, last, period in done]


def _repeated(codes: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(len(codes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def stretches(codes: np.ndarray, settings: RunSettings) -> list[tuple[int, int]]:
    """Ranges of words outside which no run lies."""
    window = settings.window
    waiting, out = [(0, len(codes))], []
    rolled, span = codes, 1
    while span < window:  # codes of windows by doubling
        step = min(span, window - span)
        if len(rolled) <= step:
            return []
        rolled = mix(rolled[:-step] * U64(0x9E3779B97F4A7C15) + rolled[step:])
        span += step
    while waiting:
        start, end = waiting.pop()
        if end - start < settings.min_words:
            continue
        twice = _repeated(rolled[start : end - window + 1])
        change = np.zeros(end - start + 1, dtype=np.int64)
        places = np.flatnonzero(twice)
        np.add.at(change, places, 1)
        np.add.at(change, places + window, -1)
        held = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0, append=0)
        parts = list(zip(np.flatnonzero(held > 0) + start, np.flatnonzero(held < 0) + start, strict=True))
        if parts == [(start, end)]:
            out.append((start, end))
        else:
            waiting += parts
    return sorted(out)


def document_runs(words: list[bytes], settings: RunSettings) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text's words, by start, then period."""
    if len(words) < settings.min_words:
        return []
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(U64)
    found = []
    for start, end in stretches(codes, settings):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words[start:end]]
        found += [(a + int(start), n, q) for a, n, q in runs_of(ids) if n >= max(settings.min_words, settings.min_powers * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run the first period stays."""
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep)]
    return b" ".join(words)


def find_runs(docs: DataFrame, settings: RunSettings | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``runs`` (start, length, period by start, then period) and ``collapsed``,
    the text with every run cut down to its first period."""
    settings = settings or RunSettings()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count, runs, texts = [], [], []
            for text in encoded(batch["text"]):
                words = text.split()  # bytes: at the six ASCII white-space characters only
                found = document_runs(words, settings)
                count.append(len(words))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                texts.append(collapsed(words, found).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "n_words": np.array(count, dtype=np.int64), "runs": runs, "collapsed": strings(texts)}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def with_longest(found: DataFrame) -> DataFrame:
    """``found`` with ``best``, the run of greatest exponent (length / period; ties: smallest start, then period)."""
    best = F.aggregate(
        F.col("runs"),
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda a, r: F.when(
            a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r
        ).otherwise(a),
    )
    return found.withColumn("best", best)
