"""Near-duplicate documents by an LSH forest over MinHash signatures.

* Documents with the same shingle set are one representative from the start.
* Each of several trees is one order of the signature. Representatives that share its first hashes form a
  region; crowded regions are split by further hashes (adaptive depth). In a region, sorted by the rest of the
  order, a document's candidates are its neighbours with the longest common prefix, the region's first document
  and the first document of its part.
* Candidates are confirmed on the full shingle sets of whole texts. First every document's most frequent
  candidate, then all others whose ends are still in different components.
* Then regions whose members are still in different components are opened: first each member meets the member of
  most links, then the members' sets are joined by prefixes. A set's shingles are put into one order for all sets,
  roughly from rare to common; two sets of similarity t share one of the first n - ceil(t * n) + 1, so only members
  that do, whose sizes and places of that shingle allow the similarity, and whose components differ, are confirmed.
  No pair of one region is lost.

Families of texts that resemble each other but are no near copies differ in their rare shingles, so they seldom meet.
A shingle that many prefixes share is met in blocks, so no task holds all its documents. Defined results: null and
empty texts, and texts without words, have an empty set and are linked with nothing; rows without id stand alone; rows
that share an id are one document, which links all their texts; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.llm.components import components
from tallyward.llm.text import U64, chunks, mix, shingle_sets
from tallyward.session import materialize, ship

ship(__name__)


@dataclass(frozen=True)
class ForestSettings:
    """A pair of similarity 0.8 shares a region of some tree with probability 1 - (1 - 0.8**depth) ** trees,
    0.99998 with the defaults, and no pair of a region is lost. Of each hash 16 bits are kept."""

    words: int = 5
    percent: int = 80  # least 100 * intersection / union
    trees: int = 36
    depth: int = 6
    deepest: int = 10  # of the first candidates only
    part: int = 512  # documents of a region that are sorted together before it is split, or met in one block
    neighbours: int = 3
    rarity_bits: int = 18  # size of the table of shingle frequencies that orders the prefixes

    @property
    def hashes(self) -> int:
        return self.trees * self.depth


def signature(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set of shingle hashes."""
    x = (values >> U64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        h = (x[None, k : k + 4096] ^ b[:, None]) * a[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out.astype(np.uint16)  # the low bits: those of a minimum are as good as random


#: Texts that a task turns into Python objects at once, and bytes of them whose shingles it holds.
SLICE_ROWS, SLICE_BYTES = 256, 250_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame, settings: ForestSettings) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``k1``, ``k2`` (identity of the set), ``sig``."""
    seeds = mix(np.arange(1, 2 * settings.hashes + 1, dtype=U64))
    a = (seeds[: settings.hashes] >> U64(32)).astype(np.uint32) | np.uint32(1)
    b = (seeds[settings.hashes :] >> U64(32)).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = _bytes(batch.column("text"))
            n, k1, k2, sig = [], [], [], []
            for start, end in chunks(texts, SLICE_BYTES):
                values, first = shingle_sets(texts[start:end], settings.words)
                other = mix(values ^ U64(0x5851F42D4C957F2D))
                for i in range(end - start):
                    own = slice(first[i], first[i + 1])
                    n.append(first[i + 1] - first[i])
                    k1.append(values[own].sum(dtype=U64).astype(np.int64))
                    k2.append(other[own].sum(dtype=U64).astype(np.int64))
                    sig.append(signature(values[own], a, b).tobytes() if n[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, k1, k2)), pa.array(sig, pa.binary())],
                ["doc_id", "n", "k1", "k2", "sig"],
            )

    ids = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, F.col("text").cast("string").alias("text")).mapInArrow(
        work, "doc_id long, n long, k1 long, k2 long, sig binary"
    )


def candidates(reps: DataFrame, settings: ForestSettings) -> DataFrame:
    """Pairs ``a`` < ``b`` of representatives with ``votes``, the number of times they were proposed."""
    around = F.concat("sig", F.substring("sig", 1, 2 * settings.deepest))
    head, more = 2 * settings.depth, 2 * (settings.deepest - settings.depth)
    begin = F.col("tree") * head + 1
    paths = reps.select(
        "rep", around.alias("around"), F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))).alias("tree")
    ).select(
        "rep",
        F.xxhash64("tree", F.substring(F.col("around"), begin, F.lit(head))).alias("region"),
        F.substring(F.col("around"), begin + head, F.lit(more)).alias("path"),
    )
    regions = materialize(
        paths.groupBy("region").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where("size > 1")
    )
    members = paths.join(regions, "region")
    # adaptive depth: one more hash for each doubling beyond a part, then parts by id
    extra = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("size") / settings.part)))
    deep = F.least(F.lit(settings.deepest - settings.depth), extra).cast("int")
    shares = F.greatest(F.lit(1), F.ceil(F.col("size") / (16 * settings.part)))
    part = F.when(deep < settings.deepest - settings.depth, F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), shares))
    members = members.withColumn("sub", F.xxhash64("region", F.substring(F.col("path"), F.lit(1), 2 * deep), part))
    ordered = W.partitionBy("sub").orderBy("path", "rep")
    found = members.select(
        "rep",
        F.array(
            "leader",
            F.first("rep").over(ordered),
            *[F.lag("rep", k).over(ordered) for k in range(1, settings.neighbours + 1)],
        ).alias("others"),
    )
    return (
        found.select("rep", F.explode(F.array_distinct("others")).alias("other"))
        .where("other is not null and other <> rep")
        .groupBy(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        .agg(F.count("*").alias("votes"))
    )


def open_regions(reps: DataFrame, place: DataFrame, settings: ForestSettings) -> DataFrame:
    """Members of the regions that hold more than one component: ``region``, ``size``, ``rep``, ``n``, ``place``."""
    placed = reps.join(place.select(F.col("id").alias("rep"), F.col("component").alias("place")), "rep", "left")
    head = 2 * settings.depth
    members = placed.select(
        "rep",
        "n",
        F.coalesce("place", "rep").alias("place"),
        "sig",
        F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1))).alias("tree"),
    ).select(
        "rep", "n", "place", F.xxhash64("tree", F.substring(F.col("sig"), F.col("tree") * head + 1, F.lit(head))).alias("region")
    )
    apart = (
        members.groupBy("region")
        .agg(F.count("*").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
        .where("low <> high")
        .select("region", "size")
    )
    return members.join(apart, "region")


def _may_pair(settings: ForestSettings, x: str = "x", y: str = "y") -> Column:
    """Different components, and sizes that do not exclude the similarity (at most smaller / larger)."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (F.col(f"{x}.place") != F.col(f"{y}.place")) & (100 * F.least(n, m) >= settings.percent * F.greatest(n, m))


def hub_pairs(members: DataFrame, links: DataFrame, settings: ForestSettings) -> DataFrame:
    """Every member of an open region with the member that has most links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    hubs = (
        members.join(ends, "rep")
        .groupBy("region")
        .agg(F.max_by(F.struct("rep", "n", "place"), F.struct("degree", -F.col("rep"))).alias("hub"))
        .select("region", "hub.*")
    )
    return _distinct_pairs(members.alias("x").join(hubs.alias("y"), "region").where(_may_pair(settings)))


def rarity(texts: DataFrame, settings: ForestSettings) -> np.ndarray:
    """Level of each hash bucket of shingles by the number of texts that use it. Only an order for the prefixes is
    taken from it: any table gives the same links, a good one gives fewer meetings."""
    size = 1 << settings.rarity_bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in _slices(batches):
            plain = [zlib.decompress(t) for t in batch.column("text").to_pylist()]
            for start, end in chunks(plain, SLICE_BYTES):
                values, _ = shingle_sets(plain[start:end], settings.words)
                counts += np.bincount((values & U64(size - 1)).astype(np.int64), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["bucket", "uses"])

    summed = texts.select("text").mapInArrow(work, "bucket long, uses long").groupBy("bucket").agg(F.sum("uses").alias("uses"))
    found = summed.toPandas()  # one row per bucket: bounded by the setting
    uses = np.zeros(size, dtype=np.int64)
    uses[found["bucket"].to_numpy(dtype=np.int64)] = found["uses"].to_numpy(dtype=np.int64)
    return np.minimum(127, 4 * np.log2(1.0 + uses)).astype(np.uint8)


def prefixes(texts: DataFrame, settings: ForestSettings) -> DataFrame:
    """``rep``, ``n`` and ``shingles``: the first ones of each set, rare ones first, that two similar sets must share."""
    levels = rarity(texts, settings)
    low = U64(len(levels) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            plain = [zlib.decompress(t) for t in batch.column("text").to_pylist()]
            sizes, heads = [], []
            for start, end in chunks(plain, SLICE_BYTES):
                values, first = shingle_sets(plain[start:end], settings.words)
                # the level leads, 56 bits of the shingle follow
                ranked = (levels[(values & low).astype(np.int64)].astype(U64) << U64(56)) | (mix(values) >> U64(8))
                for i in range(end - start):
                    n = int(first[i + 1] - first[i])
                    keep = n + (-settings.percent * n // 100) + 1 if n else 0
                    own = np.sort(ranked[first[i] : first[i + 1]])[:keep]
                    sizes.append(n)
                    heads.append(own.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                ["rep", "n", "shingles"],
            )

    return texts.select("id", "text").mapInArrow(work, "rep long, n long, shingles array<long>")


def rest_pairs(heads: DataFrame, place: DataFrame, settings: ForestSettings) -> DataFrame:
    """Pairs of different components that share a shingle of their prefixes and may be similar enough. A shingle of
    more than ``part`` documents is met by blocks."""
    placed = heads.join(place.select(F.col("id").alias("rep"), F.col("component").alias("place")), "rep", "left")
    rows = placed.select("rep", "n", F.coalesce("place", "rep").alias("place"), F.posexplode("shingles").alias("at", "shingle"))
    shared = (
        rows.groupBy("shingle")
        .agg(F.count("*").alias("size"), F.min("place").alias("lowest"), F.max("place").alias("highest"))
        .where("lowest <> highest")
        .select("shingle", F.ceil(F.col("size") / settings.part).cast("int").alias("blocks"))
    )
    dealt = rows.join(shared, "shingle").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "shingle", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "n", "at", "place"
    )
    met = dealt.alias("x").join(dealt.alias("y"), ["shingle", "one", "two"])
    new = (F.col("one") == F.col("two")) | (F.col("x.block") != F.col("y.block"))
    # of the first shingle in common: itself and what follows it in both sets
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = (100 + settings.percent) * left >= settings.percent * (F.col("x.n") + F.col("y.n"))
    return _distinct_pairs(met.where((F.col("x.rep") < F.col("y.rep")) & new & enough & _may_pair(settings)))


def _distinct_pairs(met: DataFrame) -> DataFrame:
    x, y = F.col("x.rep"), F.col("y.rep")
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def compressed(docs: DataFrame) -> DataFrame:
    """``id`` and the text's bytes, compressed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            packed = [zlib.compress(t, 1) for t in _bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], ["id", "text"])

    plain = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )
    return plain.mapInArrow(work, "id long, text binary")


def confirmed(pairs: DataFrame, texts: DataFrame, settings: ForestSettings) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. ``texts``: ``id``, ``text`` (compressed)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, both in enumerate(zip(batch.column("text_a"), batch.column("text_b"), strict=True)):
                values, first = shingle_sets([zlib.decompress(t.as_py()) for t in both], settings.words)
                p, q = first[1], first[2] - first[1]
                common = p + q - len(np.unique(values))
                keep[i] = common > 0 and 100 * common >= settings.percent * (p + q - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    with_text = (
        pairs.select("a", "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return with_text.mapInArrow(work, "a long, b long").distinct()


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The compressed texts of ``ids`` (column ``id``)."""
    # the list of ids grows with the corpus, so texts are always met by a shuffle, compressed
    met = compressed(docs).join(ids.distinct().hint("merge"), "id", "left_semi")
    return materialize(met.dropDuplicates(["id", "text"]))


def near_duplicates(docs: DataFrame, settings: ForestSettings | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    settings = settings or ForestSettings()
    sketched = materialize(sketch(docs, settings))
    identity = ["k1", "k2", "n"]
    reps = materialize(
        sketched.where("n > 0 and doc_id is not null")
        .groupBy(*identity)
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    )
    classes = sketched.select("doc_id", "n", "k1", "k2").join(reps.drop("sig"), identity, "left").drop("k1", "k2")
    # rows of one id with different sets: the document stands in several classes and links them
    shared = materialize(
        classes.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(
            F.min("rep").alias("lowest"),
            F.max("rep").alias("highest"),
            (F.count("rep") < F.count("*")).alias("some_empty"),
        )
        .where("lowest is not null and (some_empty or lowest <> highest)")
        .select("doc_id", "lowest")
    )
    same_id = classes.join(shared, "doc_id").where("rep <> lowest").select(F.col("lowest").alias("a"), F.col("rep").alias("b"))
    pairs = materialize(candidates(reps, settings))
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")
    links = materialize(confirmed(best, texts, settings).unionByName(same_id.distinct()))
    place = materialize(components(links))
    apart = (
        pairs.join(best, ["a", "b"], "left_anti")
        .join(place.select(F.col("id").alias("a"), F.col("component").alias("place_a")), "a", "left")
        .join(place.select(F.col("id").alias("b"), F.col("component").alias("place_b")), "b", "left")
        .where(F.coalesce("place_a", "a") != F.coalesce("place_b", "b"))
    )
    links = materialize(links.unionByName(confirmed(apart, texts, settings)))
    place = materialize(components(links))
    judged = pairs.select("a", "b")  # all of them: refused, or within one component
    members = open_regions(reps, place, settings)
    proposed = materialize(hub_pairs(members, links, settings).join(judged, ["a", "b"], "left_anti"))
    opened = members.select(F.col("rep").alias("id")).distinct()
    texts = texts_of(docs, opened)
    if not proposed.isEmpty():
        judged = judged.unionByName(proposed)
        links = materialize(links.unionByName(confirmed(proposed, texts, settings)))
        place = materialize(components(links))
    if not texts.isEmpty():
        heads = materialize(prefixes(texts, settings))
        proposed = materialize(rest_pairs(heads, place, settings).join(judged, ["a", "b"], "left_anti"))
        if not proposed.isEmpty():
            links = materialize(links.unionByName(confirmed(proposed, texts, settings)))
            place = materialize(components(links))
    node = F.coalesce("rep", "lowest")
    found = classes.join(shared, "doc_id", "left").withColumn("rep", node)
    return found.join(place.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "rep", "doc_id"), F.lit(True)).alias("kept"),
    )
