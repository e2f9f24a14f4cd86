"""Shared pieces of the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.columns import day_number, event_ms, unit_uniform
from tallyward.settings import split_layout
from tallyward.sources.tables import lineitem_transactions, stream_transactions

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
NUDGE = 1e-10

# A short layout for the 30-day event stream; order lines use the default layout.
STREAM_SPLITS = split_layout(
    ("train", 14), ("maturity_gap", 18), ("early_stopping", 21), ("calibration", 25), ("test", None)
)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles for comparison.

    Ties such as 0.0000005 have no exact binary form and engines break them differently, so a nudge
    far below the last digit moves them off the edge. Adding zero drops the sign of a zero.
    """
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded_sql(sql: str, doubles: Sequence[str], digits: int = DIGITS) -> str:
    swaps = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE!r}, {digits}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({swaps}) FROM ({sql}) AS result"


def draw_sql(seed: str, key: str) -> str:
    return (
        f"((CAST('0x' || substr(sha256('{seed}:' || {key}), 1, 13) AS BIGINT) + 0.5)"
        " / 4503599627370496.0)"
    )


LI_SQL = f"""
lines AS (
  SELECT l.*, o.o_custkey, CAST(round_even(l.l_extendedprice * 100, 0) AS BIGINT) AS cents
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
named AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS txn_id
  FROM lines
),
txns AS (
  SELECT txn_id,
         epoch_ms(l_shipdate) + ((l_orderkey * 7919 + l_linenumber * 104729) % 86400) * 1000 AS ms,
         'c_' || o_custkey AS card_id,
         CASE WHEN l_partkey % 20 <> 0 THEN 'd_' || (l_partkey % 4000) END AS device_id,
         'm_' || l_suppkey AS merchant_id,
         l_returnflag AS merchant_category,
         l_extendedprice AS amount,
         cents,
         CAST(round_even(l_extendedprice * 1000, 0) AS BIGINT) AS mu,
         {draw_sql('fraud', 'txn_id')} < CASE WHEN cents > 9000000 THEN 0.12 ELSE 0.015 END AS is_fraud,
         l_quantity AS attr_C1,
         CASE WHEN l_linenumber <> 7 THEN l_discount END AS attr_D1,
         CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS attr_M4,
         CASE WHEN l_linenumber = 1 THEN l_tax END AS attr_V1
  FROM named
)"""

EV_SQL = f"""
parsed AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'ev-' || event_id AS txn_id
  FROM events WHERE value > 0
),
txns AS (
  SELECT txn_id,
         CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms,
         'c_' || user_id AS card_id,
         CASE WHEN k % 20 <> 0 THEN 'd_' || k END AS device_id,
         'm_' || (event_id % 37) AS merchant_id,
         event_type AS merchant_category,
         value AS amount,
         CAST(round_even(value * 100, 0) AS BIGINT) AS cents,
         CAST(round_even(value * 1000, 0) AS BIGINT) AS mu,
         {draw_sql('fraud', 'txn_id')} < 0.04 AS is_fraud
  FROM parsed
)"""

SPLIT_SQL = """
placed AS (
  SELECT *, CASE WHEN d < 98 THEN 'train' WHEN d < 112 THEN 'maturity_gap'
                 WHEN d < 133 THEN 'early_stopping' WHEN d < 154 THEN 'calibration'
                 ELSE 'test' END AS split
  FROM (SELECT *, ms // 86400000 AS day, ms // 86400000 - min(ms // 86400000) OVER () AS d FROM txns)
)"""

# A deterministic stand-in for a calibrated probability: mostly small, sometimes large.
PROBABILITY_SQL = f"""
scored AS (
  SELECT *, u * u * u * u AS probability
  FROM (SELECT *, {draw_sql('score', 'txn_id')} AS u FROM placed)
)"""


def li(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_transactions(spark, sf)


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return stream_transactions(spark, sf)


def probability() -> Column:
    return F.col("_u") * F.col("_u") * F.col("_u") * F.col("_u")


def with_probability(df: DataFrame) -> DataFrame:
    """Add ``event_ms``, ``day`` and the stand-in probability."""
    return (
        df.withColumn("_u", unit_uniform("score", F.col("txn_id")))
        .withColumn("event_ms", event_ms())
        .withColumn("day", day_number(F.col("event_ms")))
        .withColumn("probability", probability())
        .drop("_u")
    )
