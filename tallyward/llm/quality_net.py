"""Document quality by random indexing and a small network.

1. Each token gives three units: the lower-cased word, its shape (runs of capitals, small letters, digits and other
   characters) and its turn (the shape of the token before it, its own, and whether both tokens are equal). Units are
   hashed into buckets. Every bucket has a fixed sparse ternary index vector; its word vector is the sum of the index
   vectors of the units around its occurrences, turned by one place for each position, counted over all documents.
2. A document is the mean word vector of its units, per kind, beside the share of repeated tokens and its length.
3. A network of one hidden layer is fitted by numpy to the pooled vectors of a bounded, hash-drawn sample of labelled
   documents; a temperature fitted on a part that the network did not see calibrates its probabilities.

Defined results: null and empty texts pool to zeros and are scored like any other text; a document with several labels
counts as good if at least half of them say so; labels other than 0 and 1, or null, teach nothing; without labels of
both kinds the score is the share of good ones (0.5 if there is none). Repeated rows are scored each; of labelled rows
with one id, the one whose pooled vector is smallest teaches. Counts are whole numbers, so partitioning changes no
vector. Only ``doc_id``, ``text`` and the label are read.

The model has a fixed size: buckets x size numbers for the vectors (a task sends as many at most) and the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.text import IS_SPACE, U64, PrefixHash, chunks, encoded, mix, strings, words
from tallyward.session import ship

ship(__name__)

KINDS = 3  # word, shape, turn


@dataclass(frozen=True)
class QualitySettings:
    buckets: int = 1 << 13  # of each kind of unit
    size: int = 32  # of a word vector
    marks: int = 2  # places of +1 or -1 in an index vector
    window: int = 2  # units on either side that count as context
    sample: int = 20_000  # labelled documents that the network is fitted on, at most
    hidden: int = 16
    epochs: int = 60
    batch: int = 256
    rate: float = 0.01
    ridge: float = 1e-4
    held: int = 5  # one in so many of the sample fits the temperature


@dataclass
class QualityModel:
    vectors: np.ndarray  # kind and bucket x size, unit length
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    base: float = 0.5  # the score without a network
    settings: QualitySettings = field(default_factory=QualitySettings)


# ---------------------------------------------------------------- units


def _classes() -> np.ndarray:
    """Byte classes of shapes: capitals, small letters (with all bytes above ASCII), digits, each other byte itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91], table[97:123], table[128:], table[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
    return table


CLASSES = _classes()


@dataclass(frozen=True)
class Units:
    """Buckets of several texts' units: tokens x kinds, and where each text's tokens begin."""

    buckets: np.ndarray
    first: np.ndarray
    repeats: np.ndarray  # 1 where a token equals the one before it


def units(texts: list[bytes], settings: QualitySettings) -> Units:
    found = words(texts)
    first, n = found.first, len(found.hashes)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = CLASSES[raw]
    fresh = ~IS_SPACE[raw]  # bytes that begin a run of one class within a token
    fresh[1:] &= kind[1:] != kind[:-1]
    reach = np.concatenate([[0], np.cumsum(fresh)])
    shape = PrefixHash(kind[fresh], seed=2).ranges(reach[found.start], reach[found.end])
    head = np.zeros(n, dtype=bool)
    head[first[:-1][np.diff(first) > 0]] = True
    repeats = np.zeros(n, dtype=bool)
    repeats[1:] = found.hashes[1:] == found.hashes[:-1]
    repeats &= ~head
    before = np.zeros(n, dtype=U64)
    before[1:] = shape[:-1]
    before[head] = 0
    turn = mix(before + shape * U64(3)) + repeats.astype(U64)
    limit = U64(settings.buckets)
    buckets = np.empty((n, KINDS), dtype=np.int32)
    for k, codes in enumerate((found.hashes, shape, turn)):
        buckets[:, k] = (mix(codes + U64(k)) % limit).astype(np.int32) + k * settings.buckets
    return Units(buckets, first, repeats)


def index_vectors(settings: QualitySettings) -> np.ndarray:
    """The sparse ternary index vector of every bucket, from its number alone."""
    number = np.arange(KINDS * settings.buckets, dtype=U64)
    out = np.zeros((len(number), settings.size), dtype=np.int16)
    for k in range(settings.marks):
        drawn = mix(number * U64(settings.marks) + U64(k + 1))
        np.add.at(out, (number, drawn % U64(settings.size)), np.where(drawn >> U64(63), 1, -1))
    return out


def add_contexts(total: np.ndarray, found: Units, index: np.ndarray, settings: QualitySettings) -> None:
    """Add to each unit's vector the index vectors of the words and shapes around it, turned by their distance.

    Word and shape of the same token are contexts too, at distance zero.
    """
    n = len(found.buckets)
    if not n:
        return
    owner = np.repeat(np.arange(len(found.first) - 1, dtype=np.int32), np.diff(found.first))
    own = index[found.buckets[:, 0]], index[found.buckets[:, 1]]
    both = own[0] + own[1]
    around = np.zeros_like(both)
    for away in range(1, min(settings.window, n - 1) + 1):
        same = (owner[away:] == owner[:-away])[:, None]
        around[:-away] += np.roll(both, away, axis=1)[away:] * same
        around[away:] += np.roll(both, -away, axis=1)[:-away] * same
    for kind in range(KINDS):
        context = around + (own[1], own[0], both)[kind]
        centre = found.buckets[:, kind]
        order = np.argsort(centre, kind="stable")
        starts = np.flatnonzero(np.diff(centre[order], prepend=-1))
        total[centre[order[starts]]] += np.add.reduceat(context[order], starts, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame, settings: QualitySettings) -> np.ndarray:
    """The vectors of all buckets, of length one, from the contexts of all documents."""
    rows, size = KINDS * settings.buckets, settings.size
    columns = [f"v{k}" for k in range(size)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, index = np.zeros((rows, size), dtype=np.int64), index_vectors(settings)
        for batch in batches:
            texts = encoded(batch["text"])
            for a, b in chunks(texts):
                add_contexts(total, units(texts[a:b], settings), index, settings)
        met = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"bucket": met, **{c: total[met, k] for k, c in enumerate(columns)}})

    summed = (
        docs.select("text")
        .mapInPandas(work, ", ".join(["bucket long", *[f"{c} long" for c in columns]]))
        .groupBy("bucket")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )
    vectors = np.zeros((rows, size))
    found = summed.toPandas()  # one row per bucket, a number that settings fix
    vectors[found["bucket"].to_numpy(dtype=np.int64)] = found[columns].to_numpy(dtype=np.float64)
    norm = np.sqrt(np.square(vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


# ---------------------------------------------------------------- documents


def pooled(texts: list[bytes], vectors: np.ndarray, settings: QualitySettings) -> np.ndarray:
    """One row per text: mean vectors of its words, shapes and turns, share of repeated tokens, log of its length."""
    out = np.zeros((len(texts), KINDS * settings.size + 2), dtype=np.float64)
    for a, b in chunks(texts):
        found = units(texts[a:b], settings)
        count = np.diff(found.first)
        some = np.flatnonzero(count)
        starts = found.first[:-1][some]
        for kind in range(KINDS if len(some) else 0):
            sums = np.add.reduceat(vectors[found.buckets[:, kind]], starts, axis=0)
            out[a + some, kind * settings.size : (kind + 1) * settings.size] = sums / count[some, None]
        if len(some):
            out[a + some, -2] = np.add.reduceat(found.repeats.astype(np.float64), starts) / count[some]
        out[a:b, -1] = np.log1p(count)
    return out


def pool(docs: DataFrame, vectors: np.ndarray, settings: QualitySettings, *keep: str) -> DataFrame:
    """``keep`` columns and ``pooled`` of every row."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pooled(encoded(batch["text"]), vectors, settings)
            yield batch[list(keep)].assign(pooled=strings(list(rows)))

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInPandas(work, ", ".join([*kinds, "pooled array<double>"]))


# ---------------------------------------------------------------- network


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    first, bias, second, end = layers
    return np.tanh(x @ first + bias) @ second + end[0]


def gradients(x: np.ndarray, y: np.ndarray, layers: list[np.ndarray], ridge: float) -> list[np.ndarray]:
    """Of the mean log loss plus ``ridge / 2`` times the squared weights."""
    first, bias, second, _ = layers
    inner = np.tanh(x @ first + bias)
    slope = (sigmoid(logits(x, layers)) - y) / len(y)
    back = np.outer(slope, second) * (1 - inner**2)
    return [x.T @ back + ridge * first, back.sum(axis=0), inner.T @ slope + ridge * second, np.array([slope.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, settings: QualitySettings) -> list[np.ndarray]:
    """Two layers by mini-batch gradient steps with adaptive rates, from a fixed seed."""
    rng = np.random.default_rng(1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    layers = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], settings.hidden)),
        np.zeros(settings.hidden),
        rng.normal(0, 1 / np.sqrt(settings.hidden), settings.hidden),
        np.array([np.log(share / (1 - share))]),
    ]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(settings.epochs):
        order = rng.permutation(len(y))
        rate = settings.rate * (1 - epoch / settings.epochs)
        for k in range(0, len(order), settings.batch):
            part = order[k : k + settings.batch]
            step += 1
            for i, g in enumerate(gradients(x[part], y[part], layers, settings.ridge)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        scaled = z / np.exp(t)
        return float(np.mean(np.logaddexp(0, scaled) - y * scaled))

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


# ---------------------------------------------------------------- fit and score


def fit(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, label: str = "quality", settings: QualitySettings | None = None
) -> QualityModel:
    """Word vectors from all ``docs``, the network from the labels of ``labelled`` (leave held-out documents out)."""
    settings = settings or QualitySettings()
    vectors = word_vectors(docs, settings)
    width = KINDS * settings.size + 2
    model = QualityModel(vectors, np.zeros(width), np.ones(width), settings=settings)
    good = F.col(label).cast("double")
    known = (
        labels.where(F.col("doc_id").isNotNull() & good.isin(0.0, 1.0))
        .groupBy("doc_id")
        .agg((F.avg(good) >= 0.5).cast("int").alias("label"))
        .join(labelled.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.sample)
    )
    # as many ids as the sample has at most, whatever the tables
    rows = labelled.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    drawn = (
        pool(rows, vectors, settings, "doc_id", "label")
        .groupBy("doc_id", "label")
        .agg(F.min("pooled").alias("pooled"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .toPandas()
    )
    y = drawn["label"].to_numpy(dtype=np.float64)
    if len(y):
        model.base = float(y.mean())
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack(drawn["pooled"].to_list())
    model.shift, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.shift) / model.scale
    apart = np.arange(len(y)) % settings.held == settings.held - 1  # rows are in hash order
    if len(set(y[~apart].tolist())) < 2 or not apart.any():
        apart[:] = False
    model.layers = fit_network(x[~apart], y[~apart], settings)
    if apart.any():
        model.temperature = fit_temperature(logits(x[apart], model.layers), y[apart])
    return model


def probabilities(x: np.ndarray, model: QualityModel) -> np.ndarray:
    if not model.layers:
        return np.full(len(x), model.base)
    return sigmoid(logits((x - model.shift) / model.scale, model.layers) / model.temperature)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: ``doc_id`` and ``score``, the calibrated probability of good quality."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pooled(encoded(batch["text"]), model.vectors, model.settings)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": probabilities(rows, model)})

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, score double")
