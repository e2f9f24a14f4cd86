"""Language of each document by multilingual mixture inference.

A document is a draw from a mixture of languages, each a distribution over character n-grams. Expectation-
maximisation estimates the mixing proportions; the set of languages that a document really uses is the one
with the best penalised likelihood. The n-gram distributions are counted over all labelled documents.

Defined results: a null text or one without a letter is ``und`` with score 0 and no proportions; a null
``lang`` teaches nothing; without any labelled text everything is ``und``; ties go to the language that sorts
first. Repeated rows are judged (and counted) as often as they occur. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.text import U64, chunks, strings
from tallyward.session import ship

ship(__name__)

UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: What is not a letter becomes white space before n-grams are taken.
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class MixtureSettings:
    """``buckets`` bounds the model (languages x buckets numbers), whatever the corpus."""

    order: int = 4
    buckets: int = 1 << 16
    smoothing: float = 0.2
    steps: int = 12
    penalty: float = 2.0  # of one more language, in halves of the log of the number of n-grams


@dataclass(frozen=True)
class MixtureModel:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # n-gram bucket x language
    settings: MixtureSettings


def _grams(texts: list[str], settings: MixtureSettings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter n-grams of each text, and offsets per text."""
    plain = [f" {NOT_LETTERS.sub(' ', t.lower()).strip()} ".encode() for t in texts]
    # so that each text with a letter has an n-gram
    plain = [p.ljust(settings.order) if p.strip() else p for p in plain]
    buffer = np.frombuffer(b"".join(plain), dtype=np.uint8).astype(U64)
    ends = np.cumsum([len(p) for p in plain])
    code = np.zeros(max(0, len(buffer) - settings.order + 1), dtype=U64)
    for k in range(settings.order):
        code = code * U64(257) + buffer[k : len(code) + k]
    bucket = ((code * U64(0x9E3779B97F4A7C15)) >> U64(40)) % U64(settings.buckets)
    # an n-gram that runs over a text's end belongs to none
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep = np.zeros(len(code) + 1, dtype=np.int64)
    last = np.maximum(first, ends - settings.order + 1)
    np.add.at(keep, np.minimum(first, len(code)), 1)
    np.add.at(keep, np.minimum(last, len(code)), -1)
    inside = np.cumsum(keep)[:-1] > 0
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    return bucket[inside].astype(np.int64), offsets


def fit(docs: DataFrame, where: Column, settings: MixtureSettings | None = None) -> MixtureModel:
    """Count n-grams per language over every document for which ``where`` holds."""
    settings = settings or MixtureSettings()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                texts = texts.tolist()
                into = totals.setdefault(lang, np.zeros(settings.buckets, dtype=np.int64))
                for a, b in chunks(texts):
                    grams, _ = _grams(texts[a:b], settings)
                    into += np.bincount(grams, minlength=settings.buckets)
        for lang, into in totals.items():
            some = np.flatnonzero(into)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": into[some]})

    learn = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = (
        learn.select("lang", "text")
        .mapInPandas(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most languages x buckets rows
    )
    languages = tuple(sorted(counted["lang"].unique()))
    table = np.zeros((settings.buckets, len(languages)))
    for k, lang in enumerate(languages):
        rows = counted[counted["lang"] == lang]
        table[rows["bucket"].to_numpy(), k] = rows["n"].to_numpy()
    table += settings.smoothing
    return MixtureModel(languages, np.log(table / table.sum(axis=0)), settings)


def price_of(n_grams: np.ndarray | int, settings: MixtureSettings) -> np.ndarray:
    """What each further language must gain in log likelihood."""
    return settings.penalty * 0.5 * np.log(np.maximum(2, n_grams))


def proportions(log_p: np.ndarray, settings: MixtureSettings) -> np.ndarray:
    """Language proportions of one document from the log likelihoods of its n-grams (rows)."""
    single = log_p.sum(axis=0)
    n_languages = log_p.shape[1]
    best = np.zeros(n_languages)
    best[int(np.argmax(single))] = 1.0
    if n_languages == 1:
        return best
    likelihood = np.exp(log_p - log_p.max(axis=1, keepdims=True))
    shift = log_p.max(axis=1).sum()

    def estimate(members: np.ndarray) -> tuple[np.ndarray, float]:
        part = likelihood[:, members]
        weight = np.full(len(members), 1 / len(members))
        for _ in range(settings.steps):
            share = part * weight
            weight = (share / share.sum(axis=1)[:, None]).sum(axis=0) / len(part)
        return weight, float(np.log(part @ weight).sum()) + shift

    everything = np.arange(n_languages)
    order = np.lexsort((everything, -estimate(everything)[0]))
    price = float(price_of(len(log_p), settings))
    best_value = single.max() - price
    for size in range(2, n_languages + 1):
        members = np.sort(order[:size])
        weight, value = estimate(members)
        if value - price * size <= best_value:
            break
        best_value = value - price * size
        best = np.zeros(n_languages)
        best[members] = weight
    return best


def mixtures(grams: np.ndarray, offsets: np.ndarray, model: MixtureModel) -> np.ndarray:
    """Proportions (text x language) of several texts; zero rows for texts without n-grams.

    The log likelihood is concave in the proportions, so no mixture beats the best single language by more
    than (number of n-grams) x (largest mean likelihood ratio - 1). Expectation-maximisation is run only
    where that bound exceeds the price of a second language; elsewhere it could not change the answer.
    """
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), len(model.languages)))
    some = np.flatnonzero(sizes)
    if not len(some) or not model.languages:
        return out
    log_p = model.log_probability[grams]
    single = np.add.reduceat(log_p, offsets[some], axis=0)
    top = np.argmax(single, axis=1)
    out[some, top] = 1.0
    of_best = log_p[np.arange(len(log_p)), np.repeat(top, sizes[some])]
    ratio = np.add.reduceat(np.exp(log_p - of_best[:, None]), offsets[some], axis=0)
    gain = ratio.max(axis=1) - sizes[some]
    for i in some[gain > price_of(sizes[some], model.settings)]:
        out[i] = proportions(log_p[offsets[i] : offsets[i + 1]], model.settings)
    return out


def detect(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """Per document: ``doc_id``, ``lang_pred``, ``score`` (the proportion of that language), ``languages``
    (the chosen set with proportions, largest first)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            lang, score, mixture = [], [], []
            for a, b in chunks(texts):
                shares = mixtures(*_grams(texts[a:b], model.settings), model)
                for text, share in zip(texts[a:b], shares, strict=True):
                    if not share.any() or not LETTER.search(text):
                        share = np.zeros(0)
                    top = int(np.argmax(share)) if len(share) else -1
                    lang.append(model.languages[top] if top >= 0 else UNDETERMINED)
                    score.append(min(1.0, float(share[top])) if top >= 0 else 0.0)
                    mixture.append(
                        [
                            {"lang": model.languages[k], "share": float(share[k])}
                            for k in np.argsort(-share, kind="stable")
                            if share[k] > 0
                        ]
                    )
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "lang_pred": strings(lang), "score": score, "languages": mixture}
            )

    return docs.select("doc_id", "text").mapInPandas(
        judge, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )


def keep_determined(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """The rows of ``docs``, all columns, for which mixture inference names a language, as in ``detect``; where
    ``lang`` is null it becomes that language."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            lang: list[str | None] = []
            for a, b in chunks(texts):
                shares = mixtures(*_grams(texts[a:b], model.settings), model)
                for text, share in zip(texts[a:b], shares, strict=True):
                    told = share.any() and LETTER.search(text)
                    lang.append(model.languages[int(np.argmax(share))] if told else None)
            inferred = pd.Series(lang, index=batch.index, dtype=object)
            kept = inferred.notna()
            yield batch.assign(lang=batch["lang"].where(batch["lang"].notna(), inferred))[kept]

    return docs.mapInPandas(work, docs.schema)


def fold(doc_id: str, n: int) -> Column:
    """``crc32`` of the id's text modulo ``n``; null ids have fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
