"""Exact nearest binary codes by incremental multi-index hashing.

A vector becomes a code of its sign bits. Codes are split into segments, each with a table from segment value to
codes. A query looks up segment values at radius 0, 1, 2, ... in one segment after the other. Once radius r is
done in the first j of m segments and r - 1 in the rest, every code within distance m * r + j - 1 has been seen; the
search ends as soon as the k-th verified distance is not above that.

Index and queries are cut into blocks of bounded size that meet pairwise, and the answers of the blocks are
merged. Of equal codes only the k + 1 smallest ids can ever be answers, so a vector that fills a third of the table
is one code. Ties go to the smaller id; a query is not its own neighbour. Defined results: null or empty vectors are
neither found nor asked for; missing, null and NaN components are bit 0; rows without id are ignored; a repeated row
counts once; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import materialize, ship

ship(__name__)


@dataclass(frozen=True)
class HammingSettings:
    k: int = 10
    index_block: int = 16_384  # codes
    query_block: int = 2_048


def codes(vectors: DataFrame, bits: int) -> DataFrame:
    """``vec_id``, ``code``: one bit per component, set where it is positive, in whole 8-byte words."""
    width = -(-bits // 64) * 64

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = np.zeros((len(batch), width), dtype=bool)
            for i, v in enumerate(batch["embedding"]):
                x = np.asarray(v, dtype=np.float64)
                signs[i, : len(x)] = x > 0
            packed = np.packbits(signs, axis=1, bitorder="little")
            yield pd.DataFrame({"vec_id": batch["vec_id"], "code": [row.tobytes() for row in packed]})

    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = usable.where("vec_id is not null and size(embedding) > 0")
    return usable.mapInPandas(work, "vec_id long, code binary")


@lru_cache(maxsize=64)
def masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with exactly ``radius`` set."""
    values = np.arange(1 << bits, dtype=np.int64)
    return values[np.bitwise_count(values) == radius]


class MultiIndex:
    """Segment tables over the codes of one block."""

    def __init__(self, words: np.ndarray):
        self.words = words  # code x 64-bit word
        bits = 64 * words.shape[1]
        length = int(np.clip(np.log2(max(2, len(words))), 4, 16))
        self.count = -(-bits // length)
        edges = np.linspace(0, bits, self.count + 1).astype(int)
        self.bits = np.diff(edges)
        flat = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
        self.tables = []
        self.edges = edges
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            value = flat[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64))
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))
            self.tables.append((order, starts))

    def search(self, query: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (places) that hold the nearest k, with distances; ``weight`` is how many ids a code stands for."""
        own = np.unpackbits(query.view(np.uint8), bitorder="little")
        seen = np.zeros(len(self.words), dtype=bool)
        found, distance = [], []
        tally = np.zeros(64 * self.words.shape[1] + 1, dtype=np.int64)
        for radius in range(int(self.bits.max()) + 1):
            for j, (order, starts) in enumerate(self.tables):
                if radius > self.bits[j]:
                    continue
                a, b = self.edges[j], self.edges[j + 1]
                value = int(own[a:b] @ (1 << np.arange(b - a, dtype=np.int64)))
                near = masks(int(b - a), radius) ^ value
                first, sizes = starts[near], starts[near + 1] - starts[near]
                some = sizes > 0
                first, sizes = first[some], sizes[some]
                at = order[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                at = at[~seen[at]]
                seen[at] = True
                d = np.bitwise_count(self.words[at] ^ query).sum(axis=1)
                found.append(at)
                distance.append(d)
                np.add.at(tally, d, weight[at])
                covered = self.count * radius + j
                if tally[: covered + 1].sum() >= k:
                    at, d = np.concatenate(found), np.concatenate(distance)
                    return at[d <= covered], d[d <= covered]
        return np.concatenate(found), np.concatenate(distance)


def nearest(vectors: DataFrame, is_query: Column, settings: HammingSettings | None = None) -> DataFrame:
    """Per query: ``query_id``, ``rank`` (1 to k), ``vec_id``, ``distance``."""
    s = settings or HammingSettings()
    wanted = s.k + 1  # the query itself may be among them
    bits = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    coded = materialize(codes(vectors.where("embedding is not null"), bits).distinct())
    few = W.partitionBy("code").orderBy("vec_id")
    index = (
        coded.withColumn("n", F.row_number().over(few))
        .where(F.col("n") <= wanted)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    index = materialize(index)
    asked = materialize(coded.where(is_query).withColumnRenamed("vec_id", "query_id"))
    query_codes = asked.select("code").distinct()
    index_blocks = max(1, -(-index.count() // s.index_block))
    query_blocks = max(1, -(-query_codes.count() // s.query_block))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")

    every_query = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb")
    every_index = F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("ib")
    left = index.select("code", "ids", block(index_blocks).alias("ib"), every_query).groupBy("ib", "qb")
    right = query_codes.select("code", block(query_blocks).alias("qb"), every_index).groupBy("ib", "qb")

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(have) and len(want):
            words = np.frombuffer(b"".join(have["code"]), dtype="<u8").reshape(len(have), -1)
            ids = have["ids"].tolist()
            weight = np.array([len(i) for i in ids])
            tables = MultiIndex(words)
            for code in want["code"]:
                at, d = tables.search(np.frombuffer(code, dtype="<u8"), weight, wanted)
                order = np.argsort(d, kind="stable")
                enough = np.searchsorted(np.cumsum(weight[at[order]]), wanted)
                last = d[order[min(enough, len(order) - 1)]]
                best = sorted((int(x), int(i)) for x, p in zip(d, at, strict=True) if x <= last for i in ids[p])
                rows += [(code, i, x) for x, i in best[:wanted]]
        return pd.DataFrame(rows, columns=["code", "vec_id", "distance"])

    found = left.cogroup(right).applyInPandas(search, "code binary, vec_id long, distance int")
    by_code = W.partitionBy("code").orderBy("distance", "vec_id")
    merged = found.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= wanted)
    by_query = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        asked.join(merged, "code")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= s.k)
        .select("query_id", "rank", "vec_id", "distance")
    )
