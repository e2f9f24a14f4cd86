"""The event timeline and event-order holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import event_ms
from tallyward.operators.prep import label_events
from tallyward.operators.ranking import row_numbers
from tallyward.session import materialize
from tallyward.settings import LabelDelay

LABEL_KIND, TRANSACTION_KIND = 0, 1  # at equal times labels come first


def timeline(events: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Transactions at their event time and labels at their arrival, as one set of items.

    The order is ``(time_ms, kind, sequence)``. Sequences number each input in its own time order.
    """
    moved = row_numbers(
        events.select("txn_id", event_ms().alias("time_ms")), "time_ms", "time_ms", "txn_id", "_rn"
    )
    items = moved.select(
        "time_ms",
        F.lit(TRANSACTION_KIND).alias("kind"),
        (F.col("_rn") - 1).alias("sequence"),
        "txn_id",
    )
    if labels is None:
        return items
    arrived = row_numbers(
        labels.select("txn_id", event_ms("label_ts").alias("time_ms")),
        "time_ms",
        "time_ms",
        "txn_id",
        "_rn",
    )
    return items.unionByName(
        arrived.select(
            "time_ms",
            F.lit(LABEL_KIND).alias("kind"),
            (F.col("_rn") - 1).alias("sequence"),
            "txn_id",
        )
    )


def limit_transactions(items: DataFrame, limit: int | None) -> DataFrame:
    """Stop before transaction number ``limit``: later labels are not replayed either.

    The stopping point is one number, the time of the first transaction left out.
    """
    if limit is None:
        return items
    stop = (
        items.filter((F.col("kind") == TRANSACTION_KIND) & (F.col("sequence") == limit))
        .agg(F.min("time_ms"))
        .first()[0]
    )
    if stop is None:
        return items
    before = (F.col("time_ms") < stop) | (
        (F.col("time_ms") == stop)
        & ((F.col("kind") == LABEL_KIND) | (F.col("sequence") < limit))
    )
    return items.filter(before)


def replay_stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count_if(F.col("kind") == TRANSACTION_KIND).alias("transactions"),
        F.count_if(F.col("kind") == LABEL_KIND).alias("labels"),
        F.coalesce(F.max("time_ms") - F.min("time_ms"), F.lit(0)).alias("event_span_ms"),
    )


def holdout(
    events: DataFrame,
    *,
    request_share: float = 0.1,
    max_requests: int | None = None,
    delay: LabelDelay = LabelDelay(),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, known labels, requests): the last share of rows are requests, all of them unless a
    cap is asked for. Labels count as known if they arrived before the first request.
    """
    ordered = materialize(
        row_numbers(
            events.withColumn("_ms", event_ms()), "_ms", "_ms", "txn_id", "_rn"
        )
    )
    cutoff = int(ordered.count() * (1 - request_share))
    first = ordered.filter(F.col("_rn") == cutoff + 1).select("_ms").first()
    history = ordered.filter(F.col("_rn") <= cutoff).drop("_ms", "_rn")
    late = F.col("_rn") > cutoff
    if max_requests is not None:
        late &= F.col("_rn") <= cutoff + max_requests
    requests = ordered.filter(late).drop("_ms", "_rn")
    labels = label_events(history, delay)
    if first is not None:
        labels = labels.filter(event_ms("label_ts") < first[0])
    return history, labels, requests
