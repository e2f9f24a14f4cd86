"""Queries: streams over the event table, and their equality with the batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import EV_SQL, Query, draw_sql, ev, rounded, with_probability
from checks.features import EVERYTHING, table_sql
from tallyward.functions.columns import day_number, event_ms
from tallyward.operators.audit import parity
from tallyward.operators.decisions import encode_records
from tallyward.operators.features import compute_features
from tallyward.operators.prep import label_events
from tallyward.session import materialize, scratch_path
from tallyward.settings import CostModel
from tallyward.sources.contracts import event_to_json, labels_to_json
from tallyward.streaming.jobs import (
    MessageSource,
    build_features,
    checkpoint_path,
    decide_batches,
    ingest_events,
    ingest_labels,
    publish,
    read_batches,
    read_decisions,
    run_available,
    sink_decisions,
)
from tallyward.streaming.state import FeatureState

BATCH_DAYS = 10
COSTS = CostModel()


def _deliver(
    events: DataFrame, days: list[tuple[int, int]], handle: Callable[[DataFrame, int], None], name: str
) -> None:
    """Messages of one day range after the other, in the given order, each range one micro-batch.

    All tasks write a range's messages; the stream goes on from its checkpoint after each.
    """
    spark = events.sparkSession
    folder, checkpoint = scratch_path(spark, "events"), checkpoint_path(spark, name)
    for low, high in days:
        part = events.filter((day_number(event_ms()) >= low) & (day_number(event_ms()) < high))
        publish(event_to_json(part), path=folder)
        run_available(MessageSource(path=folder).read(spark), handle, checkpoint)


def _day_ranges(events: DataFrame) -> list[tuple[int, int]]:
    low, high = events.agg(F.min(day_number(event_ms())), F.max(day_number(event_ms()))).first()
    return [(d, d + BATCH_DAYS) for d in range(low, high + 1, BATCH_DAYS)]


def _state_with_labels(spark: SparkSession, events: DataFrame) -> tuple[FeatureState, DataFrame]:
    labels = materialize(label_events(events))
    inbox = scratch_path(spark, "labels")
    publish(labels_to_json(labels), path=inbox)
    state = FeatureState(scratch_path(spark, "state"))
    source = MessageSource(path=inbox).read(spark)
    run_available(source, ingest_labels(state), checkpoint_path(spark, "labels"))
    return state, labels


def stream_then_read(spark: SparkSession, sf: str) -> DataFrame:
    """Mode A: ingest all messages, latest days first and the last batch twice; then evaluate every
    event as of its own time from the state. Must equal the batch table."""
    events = materialize(ev(spark, sf))
    state, _ = _state_with_labels(spark, events)
    ranges = _day_ranges(events)
    _deliver(events, [*reversed(ranges), ranges[-1]], ingest_events(state), "events")
    return rounded(FeatureState(state.root, trim_history=False).features(events))


def stream_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Mode B: features written batch by batch, in event order, from trimmed history."""
    events = materialize(ev(spark, sf))
    state, _ = _state_with_labels(spark, events)
    out = scratch_path(spark, "features")
    _deliver(events, _day_ranges(events), build_features(state, out), "features")
    return rounded(read_batches(spark, out).select("txn_id", *EVERYTHING))


def stream_batch_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ between the interleaved stream and the batch table, exactly, both ways."""
    events = materialize(ev(spark, sf))
    state, labels = _state_with_labels(spark, events)
    out = scratch_path(spark, "features")
    _deliver(events, _day_ranges(events), build_features(state, out), "parity")
    batch = compute_features(events, labels)
    return parity(read_batches(spark, out).select(*batch.columns), batch)


PARITY_SQL = "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM (SELECT 1 FROM events LIMIT 1)"


def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows arrive in event order; the day's budget carries over between micro-batches."""
    inbox, out = scratch_path(spark, "scored"), scratch_path(spark, "decided")
    scored = with_probability(ev(spark, sf)).select("txn_id", "event_ts", "event_ms", "probability", "amount")
    cut = [1_704_844_800_000, 1_704_900_000_000, 1_705_300_000_000]  # two cuts fall inside a day
    bounds = [0, *cut, 1 << 62]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = scored.filter((F.col("event_ms") >= low) & (F.col("event_ms") < high))
        part.drop("event_ms").coalesce(1).write.mode("append").parquet(inbox)
    schema = scored.drop("event_ms").schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    ).withColumn("forced", F.lit(None).cast("string"))
    handler = decide_batches(out, COSTS, threshold=0.0, reviews_per_day=20)
    run_available(stream, handler, checkpoint_path(spark, "decide"))
    return read_batches(spark, out).select("txn_id", "action", "capped")


DECISIONS_SQL = f"""WITH {EV_SQL},
p AS (SELECT *, u * u * u * u AS probability FROM (SELECT *, {draw_sql('score', 'txn_id')} AS u FROM txns)),
c AS (SELECT *, probability * amount AS ca, 5.0 + probability * (1.0::DOUBLE - 0.9::DOUBLE) * amount AS cr,
        (1.0 - probability) * (0.1::DOUBLE * amount + 2.0) AS cb FROM p),
w AS (SELECT *, least(ca, cb) - cr > 0 AS wants FROM c),
g AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
        PARTITION BY ms // 86400000 ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= 20 AS granted FROM w)
SELECT txn_id, CASE WHEN granted THEN 'review' WHEN cb < ca THEN 'block' ELSE 'approve' END AS action,
  wants AND NOT granted AS capped FROM g"""


def decision_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Records through the sink, half of them delivered twice: one row per transaction."""
    from checks.console import records

    inbox, out = scratch_path(spark, "records"), scratch_path(spark, "store")
    messages = encode_records(records(spark, sf))
    checkpoint = checkpoint_path(spark, "sink")
    publish(messages, path=inbox)
    run_available(MessageSource(path=inbox).read(spark), sink_decisions(out), checkpoint)
    publish(spark.read.text(inbox).filter(F.xxhash64("value") % 2 == 0), path=inbox)
    run_available(MessageSource(path=inbox).read(spark), sink_decisions(out), checkpoint)
    return read_decisions(spark, out).groupBy(F.coalesce("action", F.lit("none")).alias("action")).agg(
        F.count(F.lit(1)).alias("n")
    )


SINK_SQL = f"""WITH {EV_SQL},
p AS (SELECT u * u * u * u AS p, CAST(regexp_extract(txn_id, '(\\d+)$', 1) AS BIGINT) AS n
  FROM (SELECT *, {draw_sql('score', 'txn_id')} AS u FROM txns))
SELECT CASE WHEN n % 11 = 0 THEN 'none' WHEN p >= 0.8 THEN 'block' WHEN p >= 0.5 THEN 'review'
  ELSE 'approve' END AS action, count(*) AS n FROM p GROUP BY 1"""

QUERIES: dict[str, Query] = {
    "stream_then_read": stream_then_read,
    "stream_interleaved": stream_interleaved,
    "stream_batch_parity": stream_batch_parity,
    "stream_decisions": stream_decisions,
    "decision_sink": decision_sink,
}
ORACLES: dict[str, str] = {
    "stream_then_read": table_sql(EV_SQL, EVERYTHING, True),
    "stream_interleaved": table_sql(EV_SQL, EVERYTHING, True),
    "stream_batch_parity": PARITY_SQL,
    "stream_decisions": DECISIONS_SQL,
    "decision_sink": SINK_SQL,
}
