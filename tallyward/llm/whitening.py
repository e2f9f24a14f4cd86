"""Whitening of vectors by shifted CholeskyQR.

Rows are moved to a whole-number grid, and each distinct grid row counts once in the fit. Gram matrices of the
centred rows are summed by Spark, never the rows themselves: each pass solves the rows against the triangular factor
so far, sums the Gram matrix of what results, and takes its Cholesky factor (the first one shifted, so that it exists
however ill conditioned the rows are) until the rows are orthonormal. The product R of the factors has the singular
values and right singular vectors of all the centred rows; its SVD gives the components.

Defined results: a row is left out if its vector is null, empty, or holds a null, non-finite or enormous entry (from
``LARGEST`` on, where the grid would leave the exact range), or if its length is not the one that most distinct
vectors have (ties: the longer). Repeated vectors count once in the fit and are whitened each; a null id is kept as an
id like any other. A component without variance (rank below the number of components) has a null ``whitened``;
without any variance ``explained`` and ``identity_error`` are null too. An empty table gives no rows. Other columns
are not read.

The driver holds a few matrices of dimension x dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import materialize, ship

ship(__name__)

#: Entries from this size on count as non-finite.
LARGEST = float(1 << 40)
#: Rows worked on at once inside a task.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class WhitenSettings:
    components: int = 16
    scale: float = 64.0  # steps of the grid per unit
    offset: int = 1_000_000  # added to each grid value
    passes: int = 6  # of CholeskyQR at most; two or three are the rule
    orthonormal: float = 1e-8  # largest entry of Gram - I from which one plain pass ends the work


@dataclass(frozen=True)
class Whitening:
    """Fitted components: ``projection`` (dimension x components) whitens a centred row."""

    n: int
    sums: tuple[int, ...]
    variance: np.ndarray  # of each component
    explained: np.ndarray
    components: np.ndarray  # unit vectors, one per row
    projection: np.ndarray  # null columns (NaN) without variance
    identity_error: float | None
    passes: int


def on_grid(df: DataFrame, vector: str, settings: WhitenSettings) -> DataFrame:
    """The usable rows of ``df`` with ``_x``, the vector as whole numbers."""
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * settings.scale).cast("long") + settings.offset)
    usable = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < LARGEST))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(usable).withColumn("_x", whole)


def _blocks(batch: pa.RecordBatch, dimension: int) -> Iterator[np.ndarray]:
    flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dimension)
    for k in range(0, len(rows), BLOCK_ROWS):
        yield rows[k : k + BLOCK_ROWS]


def moments(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums per dimension; sums travel as two halves, so that none overflows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimension
        for batch in batches:
            for x in _blocks(batch, dimension):
                n += len(x)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
        cells = [n, *sums]
        yield pa.record_batch(
            {
                "cell": pa.array(range(len(cells)), pa.int32()),
                "high": pa.array([c >> 32 for c in cells], pa.int64()),
                "low": pa.array([c & 0xFFFFFFFF for c in cells], pa.int64()),
            }
        )

    found = (
        fit.select("_x")
        .mapInArrow(work, "cell int, high long, low long")
        .groupBy("cell")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        .collect()
    )
    cells = {r["cell"]: (r["high"] << 32) + r["low"] for r in found}
    return cells.get(0, 0), [cells.get(k + 1, 0) for k in range(dimension)]


def _centring(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Grid rows minus the mean: whole parts are subtracted exactly, then the fraction below one."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def gram(fit: DataFrame, dimension: int, columns: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the products ``rows_of(x)ᵀ rows_of(x)`` over all rows: one partial matrix per task, added by Spark."""
    upper = np.triu_indices(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            for x in _blocks(batch, dimension):
                y = rows_of(x)
                total += y.T @ y
        cells = total[upper]
        yield pa.record_batch(
            {"cell": pa.array(np.arange(len(cells), dtype=np.int64)), "value": pa.array(cells, pa.float64())}
        )

    found = fit.select("_x").mapInArrow(work, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    cells = np.zeros(len(upper[0]))
    for r in found.collect():
        cells[r["cell"]] = r["value"]
    full = np.zeros((columns, columns))
    full[upper] = cells
    return full + np.triu(full, 1).T


def triangular_factor(
    gram_of: Callable[[np.ndarray], np.ndarray], dimension: int, settings: WhitenSettings
) -> tuple[np.ndarray, int]:
    """R of the QR decomposition of all rows, and the passes it took.

    ``gram_of(T)`` is the Gram matrix of the rows times ``T``. A shift of a few roundings keeps every factor definite;
    what it bends is put right by the next pass, since only the product of the factors counts.
    """
    factor = np.eye(dimension)
    for done in range(1, settings.passes + 1):
        products = gram_of(np.linalg.solve(factor, np.eye(dimension)))
        close = np.abs(products - np.eye(dimension)).max() < settings.orthonormal
        shift = 0.0 if close else 11 * dimension * (dimension + 1) * 2.0**-53 * np.trace(products)
        lower = np.linalg.cholesky(products + shift * np.eye(dimension))
        factor = lower.T @ factor
        if close:
            break
    return factor, done


def fit_whitening(fit: DataFrame, dimension: int, settings: WhitenSettings) -> Whitening | None:
    """Components of the distinct grid rows ``fit``; None without rows."""
    n, sums = moments(fit, dimension)
    if not n:
        return None
    sums = tuple(sums)
    centred = _centring(n, sums)
    count = min(settings.components, dimension)
    spread = gram(fit, dimension, 1, lambda x: np.sqrt(np.square(centred(x)).sum(axis=1, keepdims=True)))[0, 0]
    if not spread:
        empty = np.full(count, np.nan)
        return Whitening(n, sums, np.zeros(count), empty, np.eye(dimension)[:count], np.full((dimension, count), np.nan), None, 0)
    scale = np.sqrt(spread)  # rows of total length one: no pass depends on the units
    factor, passes = triangular_factor(
        lambda t: gram(fit, dimension, dimension, lambda x: (centred(x) / scale) @ t), dimension, settings
    )
    _, singular, right = np.linalg.svd(factor)
    right = right * np.where(right[np.arange(dimension), np.abs(right).argmax(axis=1)] < 0, -1, 1)[:, None]
    variance = np.square(singular * scale) / n
    explained = np.square(singular) / np.square(singular).sum()
    alive = singular[:count] > 1e-14 * singular[0]
    projection = np.full((dimension, count), np.nan)
    projection[:, alive] = right[:count][alive].T / np.sqrt(variance[:count][alive])
    used = projection[:, alive]
    # one more column of ones, so that means are taken off
    k = used.shape[1]
    check = gram(fit, dimension, k + 1, lambda x: np.column_stack([centred(x) @ used, np.ones(len(x))])) / n
    covariance = check[:k, :k] - np.outer(check[:k, k], check[:k, k])
    error = float(np.abs(covariance - np.eye(k)).max())
    return Whitening(n, sums, variance[:count], explained[:count], right[:count], projection, error, passes)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[str]:
    """Sum over dimensions of (n x - S)², exact: in 64 bits where it fits, else in Python's integers."""
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    gap = x - np.array(whole, dtype=np.int64)
    reach = (int(np.abs(gap).max(initial=0)) + 1) * n
    if reach * reach * x.shape[1] < 1 << 63:
        gap = gap * n - np.array(rest, dtype=np.int64)
        return [str(v) for v in np.square(gap).sum(axis=1).tolist()]
    gap = gap.astype(object) * n - np.array(rest, dtype=object)
    return [str(v) for v in np.square(gap).sum(axis=1)]


def whiten(
    df: DataFrame, ident: str = "vec_id", vector: str = "embedding", settings: WhitenSettings | None = None
) -> DataFrame:
    """``ident``, ``component`` (from 1), ``n``, ``deviation`` (decimal; null above 38 digits), ``whitened``,
    ``explained``, ``identity_error``: one row per usable row of ``df`` and component."""
    settings = settings or WhitenSettings()
    kind = df.schema[ident].dataType.simpleString()
    rows = on_grid(df.select(F.col(ident).alias("_id"), F.col(vector).alias("_v")), "_v", settings).select("_id", "_x")
    distinct = materialize(rows.select("_x").distinct())
    lengths = distinct.groupBy(F.size("_x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d"))
    usual = lengths.first()
    dimension = usual["d"] if usual else 1
    model = fit_whitening(distinct.where(F.size("_x") == dimension), dimension, settings) if usual else None
    n, sums = (model.n, model.sums) if model else (1, (0,))
    projection = model.projection if model else np.zeros((1, 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred = _centring(n, sums)
        for batch in batches:
            at = 0
            for x in _blocks(batch, dimension):
                white = centred(x) @ projection
                steps = np.arange(len(x) + 1, dtype=np.int32) * projection.shape[1]
                yield pa.record_batch(
                    {
                        "_id": batch.column("_id").slice(at, len(x)),
                        "deviation": pa.array(_deviations(x, n, sums), pa.string()),
                        "white": pa.ListArray.from_arrays(pa.array(steps), pa.array(white.ravel(), pa.float64())),
                    }
                )
                at += len(x)

    def constants(values: list[float]) -> list:
        return [F.lit(None if np.isnan(v) else float(v)).cast("double") for v in values]

    white = rows.where(F.size("_x") == dimension).mapInArrow(work, f"_id {kind}, deviation string, white array<double>")
    explained = F.array(*constants(model.explained.tolist() if model else [np.nan]))
    error = model.identity_error if model else None
    spread = white.select("_id", "deviation", F.posexplode("white").alias("_k", "_w"))
    return spread.select(
        F.col("_id").alias(ident),
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation as decimal(38, 0))").alias("deviation"),
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"),
        F.get(explained, F.col("_k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
