"""As-of aggregates over one entity's past, in plain windows or, for busy entities, in chunks.

Every aggregate looks at ``[q - w, q)``: strictly before the row, so a row never sees itself or
another row of the same millisecond.

* An ordinary entity goes through one ``Window.partitionBy(entity).orderBy(ms)`` with one RANGE frame
  per window length: a single shuffle and sort serve every output.
* A busy entity (see ``SkewPolicy``) would put its whole history in one task, and a sliding frame
  re-reads the frame for each row. Its rows are first collapsed to one per millisecond. Then every
  contribution becomes a +delta at its own time and a -delta when it leaves the window, and one
  running total per output, cut into time chunks, gives the same numbers in linear work. Chunk
  totals are aggregated map-side and added back, so no task needs more than one chunk.

Both ways are exact and give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import materialize
from tallyward.settings import SkewPolicy

NO_OFFSET = Window.unboundedPreceding


@dataclass(frozen=True)
class Additive:
    """Sum of ``column`` over the previous ``window_ms``; None means the whole past."""

    name: str
    column: str
    window_ms: int | None


@dataclass(frozen=True)
class Distinct:
    """Number of different non-null values of ``column`` over the previous ``window_ms``."""

    name: str
    column: str
    window_ms: int


@dataclass(frozen=True)
class BusyKeys:
    keys: DataFrame  # the distinct keys, and ``_chunk_ms``: how long the chunks of a key are
    small: bool  # few enough to broadcast

    def renamed(self, column: str) -> DataFrame:
        keys = self.keys.withColumnRenamed(self.keys.columns[0], column)
        return F.broadcast(keys) if self.small else keys

    def restrict(self, df: DataFrame, column: str, how: str) -> DataFrame:
        return df.join(self.renamed(column), column, how)

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The quiet rows, and the busy ones with ``_chunk_ms``. Written once, so that what ``df`` takes is not run twice."""
        both = materialize(df.join(self.renamed(column), column, "left").select(*df.columns, "_chunk_ms"))
        return both.filter(F.col("_chunk_ms").isNull()).drop("_chunk_ms"), both.filter(F.col("_chunk_ms").isNotNull())


def check_windows(specs: Sequence[Additive | Distinct]) -> None:
    bad = [s.name for s in specs if s.window_ms is not None and s.window_ms <= 0]
    if bad:
        raise ValueError(f"window lengths must be positive: {bad}")


def busy_keys(rows: DataFrame, entity: str, time: str, policy: SkewPolicy) -> BusyKeys | None:
    """Entities with more rows in one period than a sorted window should hold, or None."""
    return busy_entities(rows, [entity], time, policy)[entity]


def busy_entities(
    rows: DataFrame, entities: Sequence[str], time: str, policy: SkewPolicy
) -> dict[str, BusyKeys | None]:
    """``busy_keys`` of several entities in one narrow pass with map-side counting.

    The number of answers is at most rows / rows_per_period. They are written to the shared folder; up to
    ``max_broadcast_keys`` of an entity are broadcast, beyond that they are joined by shuffle.
    """
    if not policy.enabled or not entities:
        return dict.fromkeys(entities)
    pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("_of"), F.col(e).alias("_key")) for e in entities]))
    # Chunks of a whole period hold few rows where no period holds many.
    length = F.when(F.col("_rows") <= policy.rows_per_chunk, max(policy.period_ms, policy.chunk_ms))
    busy = materialize(
        rows.select(F.floor(F.col(time) / policy.period_ms).alias("_period"), pairs.alias("_p"))
        .select("_period", "_p.*")
        .filter(F.col("_key").isNotNull())
        .groupBy("_of", "_key", "_period")
        .count()
        .filter(F.col("count") > policy.rows_per_period)
        .groupBy("_of", "_key")
        .agg(F.max("count").alias("_rows"))
        .select("_of", "_key", length.otherwise(policy.chunk_ms).cast("bigint").alias("_chunk_ms"))
    )
    found = {r["_of"]: r["count"] for r in busy.groupBy("_of").count().collect()}
    return {
        e: BusyKeys(
            busy.filter(F.col("_of") == e).select(F.col("_key").alias(e), "_chunk_ms"),
            small=found[e] <= policy.max_broadcast_keys,
        )
        if e in found
        else None
        for e in entities
    }


def running_before(
    rows: DataFrame,
    keys: Sequence[str],
    at: str,
    measures: Sequence[str],
    *,
    chunk_ms: int,
    inclusive: bool = False,
) -> DataFrame:
    """Replace each measure with its total over rows of the same keys with a smaller ``at``.

    A key of any size is cut into chunks of ``chunk_ms``: totals per chunk are added up on a table
    with one row per (key, chunk), and only rows inside one chunk are sorted together.
    """
    pieces = rows.withColumn("_chunk", F.floor(F.col(at) / chunk_ms).cast("bigint"))
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(at)
        .rangeBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        pieces.groupBy(*keys, "_chunk")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            "_chunk",
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_base_{m}") for m in measures],
        )
    )
    others = [c for c in rows.columns if c not in measures]
    return (
        pieces.select(
            *others,
            "_chunk",
            *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_in_{m}") for m in measures],
        )
        .join(base, [*keys, "_chunk"])
        .select(*others, *[(F.col(f"_base_{m}") + F.col(f"_in_{m}")).alias(m) for m in measures])
    )


def plain(
    rows: DataFrame,
    entity: str,
    time: str,
    additive: Sequence[Additive],
    distinct: Sequence[Distinct],
) -> DataFrame:
    by_time = Window.partitionBy(entity).orderBy(time)

    def frame(window_ms: int | None) -> Window:
        return by_time.rangeBetween(NO_OFFSET if window_ms is None else -window_ms, -1)

    sums = [
        F.coalesce(F.sum(a.column).over(frame(a.window_ms)), F.lit(0)).cast("bigint").alias(a.name)
        for a in additive
    ]
    sets = [
        F.size(F.collect_set(d.column).over(frame(d.window_ms))).cast("bigint").alias(d.name)
        for d in distinct
    ]
    return rows.select("*", *sums, *sets)


def _marks(rows: DataFrame, entity: str, marks: Sequence[tuple[int, Column]], last: int | None, values: dict) -> DataFrame:
    """One row per mark (step, time) up to ``last``: what comes later is seen by nobody."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_step"), at.alias("_at")) for k, at in marks]))
    return (
        rows.select(entity, "_chunk_ms", each.alias("_s"), *[v.alias(n) for n, v in values.items()])
        .filter(F.col("_s._at") <= F.lit(last))
        .select(entity, F.floor(F.col("_s._at") / F.col("_chunk_ms")).alias("_chunk"), "_s.*", *values)
    )


def _presence(
    rows: DataFrame, entity: str, value: str, time: str, mine: Sequence[tuple[int, Distinct]], last: int | None
) -> list[DataFrame]:
    """Marks of the times at which a value counts: from its occurrence until it occurs again or leaves the window.

    The next occurrence is looked for inside a chunk. What the last one of a chunk then counts too much is taken back
    where the value occurs again in a later chunk, so that nothing is joined. A step's sign is that of its change.
    """
    chunk = F.floor(F.col(time) / F.col("_chunk_ms"))
    inside = Window.partitionBy(entity, value, chunk).orderBy(time)
    seen = (
        rows.filter(F.col(value).isNotNull())
        .select(entity, "_chunk_ms", value, time)
        .distinct()
        .select("*", F.lead(time).over(inside).alias("_next"), F.lag(time).over(inside).alias("_before"))
    )
    enters = [(k, F.col(time)) for k, _ in mine]
    leaves = [(-k, F.least(F.col("_next"), F.col(time) + d.window_ms)) for k, d in mine]
    later = Window.partitionBy(entity, value).orderBy(time)
    edges = (
        seen.filter(F.col("_next").isNull() | F.col("_before").isNull())
        .select(entity, "_chunk_ms", time, "_next", F.lead(time).over(later).alias("_later"))
        .filter(F.col("_next").isNull() & F.col("_later").isNotNull())
    )
    back = []
    for k, d in mine:
        left = F.col(time) + d.window_ms
        back += [(-k, F.when(F.col("_later") < left, F.col("_later"))), (k, F.when(F.col("_later") < left, left))]
    return [_marks(seen, entity, enters + leaves, last, {}), _marks(edges, entity, back, last, {})]


def chunked(
    rows: DataFrame,
    entity: str,
    time: str,
    additive: Sequence[Additive],
    distinct: Sequence[Distinct],
    asks: str,
    first: str,
) -> DataFrame:
    """(entity, time) of every asking row, with all aggregates, by chunked running totals.

    ``rows`` carry ``_chunk_ms``. ``first`` names one more output: the entity's first asking time. Marks are narrow
    when they are shuffled, once, by entity and chunk; what a mark adds to each output is worked out after that.
    """
    names = [s.name for s in (*additive, *distinct)]
    columns = sorted({a.column for a in additive})
    lengths = sorted({a.window_ms for a in additive if a.window_ms is not None})
    last = rows.filter(asks).agg(F.max(time)).first()[0]
    grid = rows.groupBy(entity, "_chunk_ms", time).agg(
        F.max(asks).alias("_asks"), *[F.sum(c).alias(c) for c in columns]
    )
    # Step 0 enters at the row's time, steps 1, 2, ... leave; further steps, of either sign, are those of values.
    steps = [(0, F.col(time)), *[(k, F.col(time) + w) for k, w in enumerate(lengths, start=1)]]
    values = {"_asks": F.col("_asks"), **{c: F.col(c) for c in columns}}
    parts = [_marks(grid, entity, steps, last, values)]
    codes = {d.name: k for k, d in enumerate(distinct, start=len(lengths) + 1)}
    for value in sorted({d.column for d in distinct}):
        mine = [(codes[d.name], d) for d in distinct if d.column == value]
        parts += _presence(rows, entity, value, time, mine, last)
    step = F.col("_step")

    def change(spec: Additive | Distinct) -> Column:
        if isinstance(spec, Distinct):
            code = codes[spec.name]
            out = F.when(step == code, 1).when(step == -code, -1)
        else:
            out = F.when(step == 0, F.col(spec.column))
            if spec.window_ms is not None:
                out = out.when(step == lengths.index(spec.window_ms) + 1, -F.col(spec.column))
        return out.otherwise(0).cast("bigint").alias(spec.name)

    marks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # Read twice: by chunk totals and inside chunks. Both use every column, so that the shuffle is made once.
    spread = marks.filter(F.col(entity).isNotNull() & F.col("_chunk").isNotNull()).repartition(entity, "_chunk")
    asked = F.col("_asks") & (step == 0)
    changes = [change(s) for s in (*additive, *distinct)]
    inside = Window.partitionBy(entity, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(entity)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        spread.select(entity, "_chunk", F.when(asked, F.col("_at")).alias("_asked_at"), *changes)
        .groupBy(entity, "_chunk")
        .agg(F.min("_asked_at").alias("_asked_at"), *[F.sum(n).alias(n) for n in names])
        .select(
            entity,
            "_chunk",
            "_asked_at",
            F.min("_asked_at").over(whole).alias(first),
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_base_{n}") for n in names],
        )
        .filter(F.col("_asked_at").isNotNull())
        .drop("_asked_at")
    )
    # Sorted while narrow.
    return (
        spread.sortWithinPartitions(entity, "_chunk", "_at")
        .select(entity, "_chunk", "_at", asked.alias("_asked"), *changes)
        .select(
            entity,
            "_chunk",
            "_at",
            "_asked",
            *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names],
        )
        .filter("_asked")
        .join(base, [entity, "_chunk"])
        .select(entity, F.col("_at").alias(time), first, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in names])
    )


def behaviour(
    rows: DataFrame,
    entity: str,
    time: str,
    additive: Sequence[Additive],
    distinct: Sequence[Distinct],
    *,
    asks: str,
    policy: SkewPolicy,
    busy: BusyKeys | None,
) -> DataFrame:
    """``rows`` where ``asks`` is true, plus one column per aggregate.

    Rows with ``asks`` false only contribute (arrived labels, for instance).
    """
    check_windows([*additive, *distinct])
    if busy is None:
        return plain(rows, entity, time, additive, distinct).filter(asks)
    quiet, hot = busy.split(rows, entity)
    asof = chunked(hot, entity, time, additive, distinct, asks, "_first")
    hot_out = hot.filter(asks).join(asof, [entity, time])
    quiet_out = plain(quiet, entity, time, additive, distinct).filter(asks)
    return quiet_out.unionByName(hot_out.select(*quiet_out.columns))


def first_seen(
    rows: DataFrame, firsts: dict[str, Sequence[str]], time: str, entity: str, busy: BusyKeys | None
) -> DataFrame:
    """Add the earliest ``time`` per key group.

    ``firsts`` maps an output name to key columns that include ``entity``, so the shuffle by entity
    serves them all. Busy entities get theirs from a map-side minimum joined back.
    """

    def windowed(df: DataFrame) -> DataFrame:
        return df.select(
            "*", *[F.min(time).over(Window.partitionBy(*k)).alias(n) for n, k in firsts.items()]
        )

    if busy is None:
        return windowed(rows)
    quiet = busy.restrict(rows, entity, "left_anti").select(*rows.columns)
    hot = materialize(busy.restrict(rows, entity, "left_semi").select(*rows.columns))
    out = hot
    for name, keys in firsts.items():
        minima = hot.groupBy(*keys).agg(F.min(time).alias(name))
        # Null key parts never reach a reader: their features are masked to null.
        out = out.join(minima, list(keys), "left")
    quiet_out = windowed(quiet)
    return quiet_out.unionByName(out.select(*quiet_out.columns))
