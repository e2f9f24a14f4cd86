"""Global order without a global sort task: ranks, running totals and exact quantiles.

A running total over a whole table needs one order but not one task. Rows are range-partitioned by the full order,
ties included, sorted inside each partition and written once with their place. What a partition has to add is then a
prefix over one row per partition. Range bounds are Spark's own sample and only balance the work: any bounds give the
same exact answer, and a value that fills the table is cut along the columns that break its ties.

The number of partitions is ``spark.sql.shuffle.partitions``; adaptive execution merges small ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import materialize, ship, small_side

ship(__name__)

#: Low bits of Spark's monotonic id: the place of a row inside its partition.
PLACE_BITS = 33


def sorted_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` cut into contiguous ranges of ``order`` and sorted inside each, with ``_part`` and ``_row``.

    Both are those of this run of the plan: write the result before it is read twice.
    """
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    return ranged.withColumns(
        {
            "_part": F.shiftright("_place", PLACE_BITS).cast("int"),
            "_row": F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)),
        }
    ).drop("_place")


def _with_running(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Add ``before_*``: whole-number totals over the rows before, inside each partition as it is sorted."""
    names = [f"before_{m}" for m in measures]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(measures)
        for batch in batches:
            columns = list(batch.columns)
            for k, m in enumerate(measures):
                value = batch.column(m)
                through = pc.cumulative_sum(value, start=pa.scalar(carried[k], pa.int64()))
                columns.append(pc.subtract(through, value))
                if len(through):
                    carried[k] = through[-1].as_py()
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    return df.mapInArrow(work, schema)


def _offsets(written: DataFrame, size: Column) -> DataFrame:
    """(``_part``, ``_base``, ``_total``): what lies before each partition, and in all of them. One row each."""
    rows = written.groupBy("_part").agg(size.alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(everything).alias("_total"),
    )


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    *,
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, value) with its measures (whole numbers) and ``before_*``: totals over smaller values.

    ``descending`` totals over larger values instead.
    """
    one = df.groupBy(*keys, value).agg(*[F.sum(m).cast("bigint").alias(m) for m in measures])
    order = [*[F.col(k).asc() for k in keys], F.col(value).desc() if descending else F.col(value).asc()]
    placed = materialize(_with_running(sorted_ranges(one, *order), measures))
    # One row per partition and key that it holds: where the key begins there, and what it had before.
    pieces = placed.groupBy(*keys, "_part").agg(
        *[F.sum(m).alias(m) for m in measures],
        *[F.min_by(f"before_{m}", "_row").alias(f"_start_{m}") for m in measures],
    )
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = pieces.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_piece"),
        *[
            (F.coalesce(F.sum(m).over(earlier), F.lit(0)) - F.col(f"_start_{m}")).alias(f"_base_{m}")
            for m in measures
        ],
    )
    if not keys:
        base = F.broadcast(base)  # a row per partition
    same = F.col("_part") == F.col("_piece")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return placed.join(base, same).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"before_{m}") + F.col(f"_base_{m}")).alias(f"before_{m}") for m in measures],
    )


def row_numbers(
    df: DataFrame,
    first: str,
    then: str,
    tie: str,
    out: str = "rn",
    total: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Number all rows from 1 by ``(first, then, tie)``, without one task holding them all.

    The input is written once, because Spark reads it to sample it and again to cut it: pass only the columns you
    need, and name in ``keep`` those that the result needs.
    """
    kept = list(keep or df.columns)
    cut = sorted_ranges(materialize(df), *dict.fromkeys((first, then, tie)))
    placed = materialize(cut.select(*kept, "_part", "_row"))
    base = F.broadcast(_offsets(placed, F.max("_row") + 1))  # a row per partition
    extra = [F.col("_total").alias(total)] if total else []
    return placed.join(base, "_part").select(
        *kept, (F.col("_base") + F.col("_row") + 1).cast("bigint").alias(out), *extra
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    levels: Sequence[float],
    *,
    keys: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key group: ``(keys, level, value)``.

    ``linear`` interpolates between the two neighbours, ``higher`` takes the upper one and
    ``nearest`` the closer one (halves go up). Values are counted map-side, so only distinct values
    are ordered.
    """
    if method not in ("linear", "higher", "nearest"):
        raise ValueError(f"unknown quantile method {method!r}")
    counted = df.filter(F.col(value).isNotNull()).withColumn("_n", F.lit(1).cast("bigint"))
    ordered = running_totals(counted, value, ["_n"], keys=keys)
    size = F.col("_size")

    def rank_pair(q: Column) -> Column:
        at = q * (size - 1)
        whole = F.ceil(at) if method == "higher" else F.floor(at + 0.5)
        low, high = (F.floor(at), F.ceil(at)) if method == "linear" else (whole, whole)
        share = at - F.floor(at) if method == "linear" else F.lit(0.0)
        return F.struct(
            q.alias("level"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), share.alias("share")
        )

    # Ranks and rows meet by blocks of ranks, a few per level and key: a row covers one block, or as many as its value
    # fills, and only blocks that hold a wanted rank are looked at.
    block = F.greatest(F.lit(1), F.floor(size / (4 * len(levels)))).cast("bigint")
    sizes = small_side(ordered.groupBy(*keys).agg(F.sum("_n").alias("_size")).withColumn("_k", F.lit(1)))
    wanted = (
        sizes.select(*keys, "_size", F.explode(F.transform(F.lit([float(q) for q in levels]), rank_pair)).alias("_t"))
        .select(*keys, "_size", "_t.*", F.explode(F.array_distinct(F.array("_t.low", "_t.high"))).alias("_rank"))
        .select(*keys, "level", "low", "high", "share", "_rank", F.floor(F.col("_rank") / block).alias("_block"))
    )
    first = F.col("before__n")
    last = F.col("before__n") + F.col("_n") - 1
    hits = (
        ordered.withColumn("_k", F.lit(1))
        .join(sizes, [*keys, "_k"])
        .withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
        .join(small_side(wanted), [*keys, "_block"])
        .where(F.col("_rank").between(first, last))
    )
    held = F.col(value).cast("double")
    low = F.max(F.when(F.col("_rank") == F.col("low"), held))
    high = F.max(F.when(F.col("_rank") == F.col("high"), held))
    return (
        hits.groupBy(*keys, "level", "share")
        .agg(low.alias("_low"), high.alias("_high"))
        .select(*keys, "level", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("share")).alias("value"))
    )
