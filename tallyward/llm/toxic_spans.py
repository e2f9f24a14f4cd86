"""Toxic spans and document scores from a linear-chain conditional random field.

1. Words and word prefixes are counted by document label over all labelled training documents; those that mark
   toxic documents form a lexicon. Tokens of toxic documents with a lexicon entry are the labelled tokens.
2. A two-state linear-chain CRF is fitted to labelled tokens of a bounded sample of those documents. Its inputs
   are lexicon evidence of a token and of its neighbours.
3. Forward-backward marginals of every token of every whole text give the offending offsets; their aggregates
   give the document score through a logistic curve fitted on the same sample, weighted to the true label shares.

Defined results: null and empty texts score like a text without evidence and have no spans; without labels of
both kinds the score is the share of toxic labels (0 if there is none); a document with several labels counts
once, as toxic if any label says so; repeated documents are scored each. Only ``doc_id``, ``text`` and the label
are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.text import chunks, strings
from tallyward.session import materialize, ship

ship(__name__)

WORD = re.compile(r"[^\W\d_]+")
#: Texts are tagged in groups of this many characters; a longer text is a group of its own.
GROUP_CHARS = 8_000_000
#: Labels are broadcast up to this many rows (16 bytes each); beyond that the join is shuffled.
BROADCAST_LABELS = 2_000_000


@dataclass(frozen=True)
class ToxicSettings:
    prefixes: tuple[int, ...] = (5, 6, 7)
    support: int = 4  # toxic documents that a lexicon entry needs
    odds: float = 12.0  # how much likelier an entry is in toxic documents
    lexicon: int = 20_000  # entries kept, strongest first: bounds the model
    sample: int = 400  # documents of each label that the CRF is fitted on
    steps: int = 30
    rate: float = 0.3
    ridge: float = 1e-4


@dataclass
class ToxicModel:
    lexicon: dict[str, float]
    emission: np.ndarray = field(default_factory=lambda: np.zeros(5))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))
    settings: ToxicSettings = field(default_factory=ToxicSettings)


def entries_of(word: str, prefixes: tuple[int, ...]) -> list[str]:
    return ["=" + word, *(word[:k] for k in prefixes if len(word) > k)]


class Evidence(dict):
    """Lexicon evidence by raw token, looked up once per distinct token."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) > 500_000:
            self.clear()
        known = self.model.lexicon
        found = max((known.get(e, 0.0) for e in entries_of(token.lower(), self.model.settings.prefixes)), default=0.0)
        self[token] = found
        return found


class Tokens:
    """Tokens of several texts with lexicon evidence, laid out step by step over texts of falling length."""

    def __init__(self, texts: list[str], evidence: Evidence):
        per_text = [[evidence[w] for w in WORD.findall(t)] for t in texts]
        self.lengths = np.array([len(p) for p in per_text], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        n = int(self.first[-1])
        score = np.fromiter((x for p in per_text for x in p), dtype=np.float64, count=n)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(n) - self.first[:-1][self.owner]
        head, tail = place == 0, place == self.lengths[self.owner] - 1
        before = np.where(head, 0.0, np.roll(score, 1)) if n else score
        after = np.where(tail, 0.0, np.roll(score, -1)) if n else score
        self.inputs = np.stack([np.ones(n), score > 0, score, before, after], axis=1)
        self.head, self.tail = head, tail
        rank = np.empty(len(texts), dtype=np.int64)
        rank[np.argsort(-self.lengths, kind="stable")] = np.arange(len(texts))
        longest = int(self.lengths.max(initial=0))
        reach = np.bincount(self.lengths, minlength=longest + 1)
        self.active = len(texts) - np.cumsum(reach)[:longest]  # texts that have a token at each step
        self.step = np.concatenate([[0], np.cumsum(self.active)])
        self.slot = self.step[place] + rank[self.owner] if n else np.zeros(0, dtype=np.int64)


def marginals(tokens: Tokens, e: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log odds and the marginal of the toxic state, per token.

    ``e`` is the log odds that a token alone gives; ``transition[i, j]`` the log weight of going from i to j.
    """
    t = np.exp(transition)
    by_step = np.empty(len(e))
    by_step[tokens.slot] = np.clip(e, -30, 30)
    ahead, back = by_step.copy(), np.zeros(len(e))
    step, active = tokens.step, tokens.active
    for k in range(1, len(active)):
        now, past = slice(step[k], step[k + 1]), slice(step[k - 1], step[k - 1] + active[k])
        x = np.exp(ahead[past])
        ahead[now] += np.log((t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x))
    for k in range(len(active) - 1, 0, -1):
        now, past = slice(step[k], step[k + 1]), slice(step[k - 1], step[k - 1] + active[k])
        x = np.exp(by_step[now] + back[now])
        back[past] = np.log((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x))
    a, b = ahead[tokens.slot], back[tokens.slot]
    return a, b, 1 / (1 + np.exp(-(a + b)))


def fit_chain(tokens: Tokens, toxic: np.ndarray, settings: ToxicSettings) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood weights of the CRF by gradient steps with adaptive rates."""
    truth = (toxic[tokens.owner] > 0) & (tokens.inputs[:, 1] > 0)
    n = max(1, len(truth))
    linked = np.flatnonzero(~tokens.tail)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (truth[linked].astype(int), truth[linked + 1].astype(int)), 1)
    weights, first, second = np.zeros(9), np.zeros(9), np.zeros(9)
    for k in range(1, settings.steps + 1):
        emission, transition = weights[:5], weights[5:].reshape(2, 2)
        e = tokens.inputs @ emission
        a, b, m = marginals(tokens, e, transition)
        slope = tokens.inputs.T @ (truth - m)
        right = np.clip(e, -30, 30)[linked + 1] + b[linked + 1]
        joint = np.stack(
            [
                np.full(len(linked), transition[0, 0]),
                transition[0, 1] + right,
                transition[1, 0] + a[linked],
                transition[1, 1] + a[linked] + right,
            ]
        )
        joint = np.exp(joint - joint.max(axis=0, initial=-np.inf)) if len(linked) else joint
        expected = (joint / joint.sum(axis=0)).sum(axis=1) if len(linked) else np.zeros(4)
        gradient = np.concatenate([slope, pairs.ravel() - expected]) / n - settings.ridge * weights
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights = weights + settings.rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return weights[:5], weights[5:].reshape(2, 2)


def aggregates(tokens: Tokens, m: np.ndarray) -> np.ndarray:
    """Inputs of the document score: constant, largest marginal, expected toxic tokens (log), their share."""
    n = len(tokens.lengths)
    total = np.bincount(tokens.owner, weights=m, minlength=n)
    largest = np.zeros(n)
    np.maximum.at(largest, tokens.owner, m)
    share = total / np.maximum(1, tokens.lengths)
    return np.stack([np.ones(n), largest, np.log1p(total), np.sqrt(share)], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) / weight.sum() - penalty @ w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / weight.sum() + penalty
        w = w + np.linalg.solve(bend, slope)
    return w


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of labelled documents; several labels of one are combined."""
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def learn_lexicon(rows: DataFrame, settings: ToxicSettings) -> tuple[dict[str, float], dict[int, int]]:
    """Entries that mark toxic documents, with log odds; and the number of documents by label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                side = int(toxic > 0)
                seen.setdefault("", [0, 0])[side] += 1
                own = {w.lower() for w in set(WORD.findall(text or ""))}
                for entry in {e for w in own for e in entries_of(w, settings.prefixes)}:
                    seen.setdefault(entry, [0, 0])[side] += 1
                if len(seen) > 1_000_000:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    counted = materialize(
        rows.mapInPandas(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= settings.support) | (F.col("entry") == ""))
    )
    totals = counted.where("entry = ''").first()
    if totals is None:
        return {}, {}
    clean, toxic = totals["clean"], totals["toxic"]
    odds = F.log(
        (F.col("toxic") + 0.1) / F.lit(toxic + 0.2) / ((F.col("clean") + 0.1) / F.lit(clean + 0.2))
    )
    strong = (
        counted.where("entry <> ''")
        .select("entry", odds.alias("odds"))
        .where(F.col("odds") >= float(np.log(settings.odds)))
        .orderBy(F.desc("odds"), "entry")
        .limit(settings.lexicon)
        .collect()
    )
    return {r["entry"]: r["odds"] for r in strong}, {0: clean, 1: toxic}


def _counts(seen: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "entry": strings(list(seen)),
            "clean": np.array([v[0] for v in seen.values()], dtype=np.int64),
            "toxic": np.array([v[1] for v in seen.values()], dtype=np.int64),
        }
    )


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicSettings | None = None) -> ToxicModel:
    """Learn from the documents given (leave held-out ones out before) and their labels."""
    settings = settings or ToxicSettings()
    rows = training_rows(docs, labels)
    lexicon, totals = learn_lexicon(rows, settings)
    model = ToxicModel(lexicon, settings=settings)
    if not totals.get(0) or not totals.get(1):
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        model.curve = np.array([30.0 if share else -30.0, 0, 0, 0])
        return model
    drawn = []
    for side in (0, 1):  # a bounded sample, the same whatever the partitioning
        drawn += (
            rows.where(F.col("toxic") == side if side == 0 else F.col("toxic") > 0)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(settings.sample)
            .collect()
        )
    toxic = np.array([float(r["toxic"] > 0) for r in drawn])
    tokens = Tokens([r["text"] or "" for r in drawn], Evidence(model))
    model.emission, model.transition = fit_chain(tokens, toxic, settings)
    x = aggregates(tokens, marginals(tokens, tokens.inputs @ model.emission, model.transition)[2])
    drawn_by_side = np.bincount(toxic.astype(int), minlength=2)
    weight = np.array([totals[k] / max(1, drawn_by_side[k]) for k in (0, 1)])[toxic.astype(int)]
    model.curve = fit_curve(x, toxic, weight)
    return model


def _spans(text: str, flagged: np.ndarray) -> list[dict]:
    """Code point ranges of runs of flagged tokens."""
    out, last = [], -2
    for k, m in enumerate(WORD.finditer(text)):
        if flagged[k]:
            if k == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Per document: ``doc_id``, ``score``, ``toxic_tokens``, ``spans`` (code point ranges)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(model)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            scores, counts, spans = [], [], []
            for start, end in chunks(texts, GROUP_CHARS):
                part = texts[start:end]
                tokens = Tokens(part, evidence)
                m = marginals(tokens, tokens.inputs @ model.emission, model.transition)[2]
                x = aggregates(tokens, m)
                scores += (1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))).tolist()
                flagged = m >= 0.5
                number = np.bincount(tokens.owner, weights=flagged, minlength=len(part)).astype(int)
                counts += number.tolist()
                spans += [
                    _spans(t, flagged[tokens.first[i] : tokens.first[i + 1]]) if number[i] else []
                    for i, t in enumerate(part)
                ]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "toxic_tokens": counts, "spans": spans})

    return docs.select("doc_id", "text").mapInPandas(
        work, "doc_id long, score double, toxic_tokens int, spans array<struct<start:int,end:int>>"
    )
