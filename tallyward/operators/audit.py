"""Checks that a feature table does not know the future, and that two tables agree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import event_ms


def differing_columns(
    left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """(column_name, differing): rows of shared keys whose values differ, nulls compared as equal."""
    pair = left.alias("l").join(right.alias("r"), key)
    counted = pair.agg(
        *[
            F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(c)
            for c in columns
        ]
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("differing"))
                for c in columns
            ]
        )
    )
    return counted.select(pairs.alias("_p")).select("_p.column_name", "_p.differing")


def leakage_audit(
    events: DataFrame, features: Callable[[DataFrame], DataFrame], cutoff_ms: int
) -> DataFrame:
    """Delete everything from ``cutoff_ms`` on, recompute, and count changed values before it.

    Point-in-time features change nowhere; a changed column reads the future.
    """
    past = events.filter(event_ms() < cutoff_ms)
    alone = features(past)
    columns = [c for c in alone.columns if c != "txn_id"]
    # rows after the cutoff meet no row of the past
    return differing_columns(features(events), alone, "txn_id", columns)


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows only on the left and only on the right, with multiplicity."""
    columns = left.columns
    sides = (
        left.select(*columns, F.lit(1).alias("_side"))
        .unionByName(right.select(*columns, F.lit(-1).alias("_side")))
        .groupBy(*columns)
        .agg(F.sum("_side").alias("_net"))
    )
    net = F.col("_net")
    return sides.agg(
        F.coalesce(F.sum(F.greatest(net, F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-net, F.lit(0))), F.lit(0)).alias("only_right"),
    )
