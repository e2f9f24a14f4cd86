"""Queries: point-in-time features, leaky features and the leakage audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import EV_SQL, LI_SQL, Query, ev, li, rounded, rounded_sql
from checks.preparation import DELAY_SQL
from tallyward.functions.columns import cents, milli_units
from tallyward.operators.audit import leakage_audit
from tallyward.operators.features import compute_features, feature_schema
from tallyward.operators.naive import compute_naive_features
from tallyward.operators.prep import label_events
from tallyward.settings import (
    DEVICE_COUNT_WINDOWS,
    DEVICE_DISTINCT_WINDOWS,
    DISTINCT_WINDOWS,
    WINDOWS_MS,
    SkewPolicy,
)

# Every entity of the provided tables counts as busy here, so the chunked way does all the work.
ALL_BUSY = SkewPolicy(rows_per_period=0)


def money_units(spark: SparkSession, sf: str) -> DataFrame:
    return li(spark, sf).select(
        "txn_id",
        milli_units(F.col("amount") * 1.0005).alias("milli"),
        cents(F.col("amount") * 1.0005).alias("cents"),
    )


MONEY_SQL = f"""
WITH {LI_SQL}
SELECT txn_id, CAST(round_even((amount * 1.0005) * 1000, 0) AS BIGINT) AS milli,
       CAST(round_even((amount * 1.0005) * 100, 0) AS BIGINT) AS cents FROM txns
"""


def _range(ms: int) -> str:
    return f"RANGE BETWEEN {ms} PRECEDING AND 1 PRECEDING"


def feature_ctes(with_labels: bool) -> str:
    """SQL for all features over a ``txns`` relation (and ``labels``)."""
    card = "PARTITION BY card_id ORDER BY ms"
    dev = "PARTITION BY device_id ORDER BY ms"
    out = []
    for w, ms in WINDOWS_MS.items():
        out.append(f"count(*) OVER ({card} {_range(ms)}) AS card_txn_count_{w}")
        out.append(
            f"CAST(coalesce(sum(mu) OVER ({card} {_range(ms)}), 0) AS BIGINT) / 1000.0"
            f" AS card_amount_sum_{w}"
        )
    for w in DISTINCT_WINDOWS:
        for kind, col in (("merchants", "merchant_id"), ("devices", "device_id")):
            out.append(
                f"count(DISTINCT {col}) OVER ({card} {_range(WINDOWS_MS[w])})"
                f" AS card_distinct_{kind}_{w}"
            )
    month = _range(30 * 86_400_000)
    out += [
        f"count(*) OVER ({card} {month}) AS n30",
        f"CAST(sum(cents) OVER ({card} {month}) AS DOUBLE) AS s1",
        f"CAST(sum(cents * cents) OVER ({card} {month}) AS DOUBLE) AS s2",
    ]
    for w in DEVICE_COUNT_WINDOWS:
        out.append(
            "CASE WHEN device_id IS NOT NULL THEN"
            f" count(*) OVER ({dev} {_range(WINDOWS_MS[w])}) END AS device_txn_count_{w}"
        )
    for w in DEVICE_DISTINCT_WINDOWS:
        out.append(
            "CASE WHEN device_id IS NOT NULL THEN"
            f" count(DISTINCT card_id) OVER ({dev} {_range(WINDOWS_MS[w])}) END"
            f" AS device_distinct_cards_{w}"
        )
    day = "86400000.0"
    out += [
        f"(ms - min(ms) OVER (PARTITION BY card_id)) / {day} AS card_age_days",
        "CASE WHEN device_id IS NOT NULL THEN"
        f" (ms - min(ms) OVER (PARTITION BY device_id)) / {day} END AS device_age_days",
        "CASE WHEN device_id IS NOT NULL THEN"
        " min(ms) OVER (PARTITION BY card_id, device_id) < ms END AS card_device_seen_before",
        "min(ms) OVER (PARTITION BY card_id, merchant_id) < ms AS card_merchant_seen_before",
        "CAST((ms // 3600000) % 24 AS TINYINT) AS hour_of_day",
        "CAST((ms // 86400000 + 3) % 7 + 1 AS TINYINT) AS day_of_week",
    ]
    sql = f"""
windowed AS (SELECT *, {', '.join(out)} FROM txns),
moments AS (
  SELECT *, CASE WHEN n30 >= 1 THEN s1 / n30 / 100 END AS card_amount_mean_30d,
         CASE WHEN n30 >= 2 THEN sqrt(greatest(s2 / n30 - (s1 / n30) * (s1 / n30), 0.0)) / 100 END
           AS card_amount_std_30d FROM windowed
),
features AS (
  SELECT *, amount / nullif(card_amount_mean_30d, 0) AS amount_to_card_mean_30d,
         CASE WHEN card_amount_std_30d > 0
              THEN (amount - card_amount_mean_30d) / card_amount_std_30d END AS amount_zscore_30d
  FROM moments
)"""
    if not with_labels:
        return sql
    return f"""{sql},
card_marks AS (
  SELECT card_id, ms AS t, 0 AS fraud, txn_id FROM txns
  UNION ALL SELECT card_id, label_ms, 1, NULL FROM labels WHERE is_fraud
),
card_known AS (
  SELECT txn_id, CAST(coalesce(sum(fraud) OVER (PARTITION BY card_id ORDER BY t
         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS card_prior_fraud_labels
  FROM card_marks
),
shop_marks AS (
  SELECT merchant_id, ms // 86400000 AS d, 0 AS n, 0 AS f, txn_id FROM txns
  UNION ALL SELECT merchant_id, label_ms // 86400000, 1, CAST(is_fraud AS INT), NULL FROM labels
),
shop_days AS (SELECT merchant_id, d, sum(n) AS n, sum(f) AS f FROM shop_marks GROUP BY ALL),
shop_sums AS (
  SELECT merchant_id, d,
    CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS merchant_known_labels,
    CAST(coalesce(sum(f) OVER w, 0) AS BIGINT) AS known_frauds
  FROM shop_days
  WINDOW w AS (PARTITION BY merchant_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
all_days AS (SELECT d, sum(n) AS n, sum(f) AS f FROM shop_marks GROUP BY d),
all_sums AS (
  SELECT d, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS all_n,
         CAST(coalesce(sum(f) OVER w, 0) AS BIGINT) AS all_f
  FROM all_days WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
shop_known AS (
  SELECT txn_id, merchant_known_labels, known_frauds, all_n, all_f
  FROM shop_marks JOIN shop_sums USING (merchant_id, d) JOIN all_sums USING (d)
  WHERE txn_id IS NOT NULL
),
labelled AS (
  SELECT features.*, card_prior_fraud_labels, merchant_known_labels,
         CASE WHEN all_n > 0 THEN (known_frauds + 100.0 * (all_f / CAST(all_n AS DOUBLE)))
                                  / (merchant_known_labels + 100.0) END AS merchant_known_fraud_rate
  FROM features
  JOIN (SELECT * FROM card_known WHERE txn_id IS NOT NULL) USING (txn_id)
  JOIN shop_known USING (txn_id)
)"""


def table_sql(base: str, columns: list[str], with_labels: bool) -> str:
    doubles = [c for c in columns if feature_schema(with_labels=True)[c] == "double"]
    labels = f", {DELAY_SQL}" if with_labels else ""
    source = "labelled" if with_labels else "features"
    sql = f"WITH {base}{labels}, {feature_ctes(with_labels)} SELECT txn_id, {', '.join(columns)} FROM {source}"
    return rounded_sql(sql, doubles) if doubles else sql


VELOCITY = [f"card_{k}_{w}" for w in WINDOWS_MS for k in ("txn_count", "amount_sum")]
DISTINCTS = [f"card_distinct_{k}_{w}" for k in ("merchants", "devices") for w in DISTINCT_WINDOWS]
DEVIATION = [
    "card_amount_mean_30d",
    "card_amount_std_30d",
    "amount_to_card_mean_30d",
    "amount_zscore_30d",
]
DEVICE = [
    *[f"device_txn_count_{w}" for w in DEVICE_COUNT_WINDOWS],
    *[f"device_distinct_cards_{w}" for w in DEVICE_DISTINCT_WINDOWS],
]
FAMILIARITY = [
    "card_age_days",
    "device_age_days",
    "card_device_seen_before",
    "card_merchant_seen_before",
]
CALENDAR = ["hour_of_day", "day_of_week"]
KNOWN_LABELS = ["card_prior_fraud_labels", "merchant_known_labels", "merchant_known_fraud_rate"]
EVERYTHING = list(feature_schema(with_labels=True))


def _stream_features(columns: list[str], *, with_labels: bool = False, policy=SkewPolicy()) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        events = ev(spark, sf)
        labels = label_events(events) if with_labels else None
        return rounded(compute_features(events, labels, policy=policy, only=columns).select("txn_id", *columns))

    return query


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    events = li(spark, sf)
    return rounded(compute_features(events, label_events(events)))


# ---------------------------------------------------------------- leaky twins


def naive_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compute_naive_features(li(spark, sf), with_labels=True))


def naive_stream_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compute_naive_features(ev(spark, sf)).select("txn_id", *VELOCITY, *DISTINCTS, *DEVICE))


def _naive_select(source: str, columns: list[str]) -> str:
    """The leaky features of the rows of ``source``, as one SELECT."""
    bucket = {
        w: f"(ms + {3 * 86_400_000 if w == '7d' else 0}) // {ms}" for w, ms in WINDOWS_MS.items()
    }
    out = []
    for w in WINDOWS_MS:
        part = f"PARTITION BY card_id, {bucket[w]}"
        out.append(f"count(*) OVER ({part}) AS card_txn_count_{w}")
        out.append(f"CAST(sum(mu) OVER ({part}) AS BIGINT) / 1000.0 AS card_amount_sum_{w}")
        if w in DISTINCT_WINDOWS:
            out.append(f"count(DISTINCT merchant_id) OVER ({part}) AS card_distinct_merchants_{w}")
            out.append(f"count(DISTINCT device_id) OVER ({part}) AS card_distinct_devices_{w}")
    for w in DEVICE_COUNT_WINDOWS:
        part = f"PARTITION BY device_id, {bucket[w]}"
        out.append(
            f"CASE WHEN device_id IS NOT NULL THEN count(*) OVER ({part}) END AS device_txn_count_{w}"
        )
    for w in DEVICE_DISTINCT_WINDOWS:
        part = f"PARTITION BY device_id, {bucket[w]}"
        out.append(
            "CASE WHEN device_id IS NOT NULL THEN"
            f" count(DISTINCT card_id) OVER ({part}) END AS device_distinct_cards_{w}"
        )
    card, shop = "PARTITION BY card_id", "PARTITION BY merchant_id"
    out += [
        f"count(*) OVER ({card}) AS n_card",
        f"CAST(sum(mu) OVER ({card}) AS DOUBLE) AS s1",
        f"CAST(sum(CAST(mu AS HUGEINT) * mu) OVER ({card}) AS DOUBLE) AS s2",
        f"(ms - min(ms) OVER ({card})) / 86400000.0 AS card_age_days",
        "CASE WHEN device_id IS NOT NULL THEN"
        " (ms - min(ms) OVER (PARTITION BY device_id)) / 86400000.0 END AS device_age_days",
        "CASE WHEN device_id IS NOT NULL THEN"
        " count(*) OVER (PARTITION BY card_id, device_id) > 1 END AS card_device_seen_before",
        "count(*) OVER (PARTITION BY card_id, merchant_id) > 1 AS card_merchant_seen_before",
        "CAST((ms // 3600000) % 24 AS TINYINT) AS hour_of_day",
        "CAST((ms // 86400000 + 3) % 7 + 1 AS TINYINT) AS day_of_week",
        f"CAST(sum(CAST(is_fraud AS INT)) OVER ({card}) AS BIGINT) AS card_prior_fraud_labels",
        f"count(*) OVER ({shop}) AS merchant_known_labels",
        f"avg(CAST(is_fraud AS INT)) OVER ({shop}) AS merchant_known_fraud_rate",
    ]
    return f"""
WITH w AS (SELECT *, {', '.join(out)} FROM {source}),
m AS (SELECT *, s1 / n_card / 1000 AS card_amount_mean_30d,
        sqrt(greatest(s2 / n_card - (s1 / n_card) * (s1 / n_card), 0.0)) / 1000 AS card_amount_std_30d
      FROM w),
z AS (SELECT *, amount / nullif(card_amount_mean_30d, 0) AS amount_to_card_mean_30d,
        CASE WHEN card_amount_std_30d > 0 THEN (amount - card_amount_mean_30d) / card_amount_std_30d
        END AS amount_zscore_30d FROM m)
SELECT txn_id, {', '.join(columns)} FROM z"""


def _naive_sql(base: str, columns: list[str]) -> str:
    sql = f"WITH {base} SELECT * FROM ({_naive_select('txns', columns)})"
    doubles = [c for c in columns if feature_schema(with_labels=True)[c] == "double"]
    return rounded_sql(sql, doubles)


# ---------------------------------------------------------------- audit

AUDIT_CUTOFF_MS = 1_705_320_000_000  # 2024-01-15 12:00 UTC, the middle of the stream


def audit_point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """No honest feature, those from labels included, changes when the second half of the stream is deleted."""
    return leakage_audit(ev(spark, sf), lambda e: compute_features(e, label_events(e)), AUDIT_CUTOFF_MS)


AUDIT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(0 AS BIGINT) AS differing FROM (SELECT 1 FROM events LIMIT 1)"
    for c in feature_schema(with_labels=True)
)


def audit_naive(spark: SparkSession, sf: str) -> DataFrame:
    """The leaky table fails the same audit, column by column."""
    return leakage_audit(ev(spark, sf), compute_naive_features, AUDIT_CUTOFF_MS)


_AUDITED = list(feature_schema(with_labels=False))
_DIFFERING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (a.{c} IS DISTINCT FROM b.{c}) AS differing"
    " FROM whole a JOIN alone b USING (txn_id)"
    for c in _AUDITED
)
AUDIT_NAIVE_SQL = f"""
WITH {EV_SQL},
past AS (SELECT * FROM txns WHERE ms < {AUDIT_CUTOFF_MS}),
whole AS MATERIALIZED (SELECT * FROM ({_naive_select('txns', _AUDITED)})),
alone AS MATERIALIZED (SELECT * FROM ({_naive_select('past', _AUDITED)}))
{_DIFFERING}
"""

QUERIES: dict[str, Query] = {
    "money_units": money_units,
    "card_velocity": _stream_features(VELOCITY),
    "card_distinct_counts": _stream_features(DISTINCTS),
    "card_deviation": _stream_features(DEVIATION),
    "device_activity": _stream_features(DEVICE),
    "familiarity": _stream_features(FAMILIARITY),
    "calendar_features": _stream_features(CALENDAR),
    "arrived_label_features": _stream_features(KNOWN_LABELS, with_labels=True),
    "feature_table": feature_table,
    "feature_table_stream": _stream_features(EVERYTHING, with_labels=True),
    "feature_table_busy_entities": _stream_features(EVERYTHING, with_labels=True, policy=ALL_BUSY),
    "naive_feature_table": naive_feature_table,
    "naive_stream_buckets": naive_stream_buckets,
    "audit_point_in_time": audit_point_in_time,
    "audit_naive": audit_naive,
}
ORACLES: dict[str, str] = {
    "money_units": MONEY_SQL,
    "card_velocity": table_sql(EV_SQL, VELOCITY, False),
    "card_distinct_counts": table_sql(EV_SQL, DISTINCTS, False),
    "card_deviation": table_sql(EV_SQL, DEVIATION, False),
    "device_activity": table_sql(EV_SQL, DEVICE, False),
    "familiarity": table_sql(EV_SQL, FAMILIARITY, False),
    "calendar_features": table_sql(EV_SQL, CALENDAR, False),
    "arrived_label_features": table_sql(EV_SQL, KNOWN_LABELS, True),
    "feature_table": table_sql(LI_SQL, EVERYTHING, True),
    "feature_table_stream": table_sql(EV_SQL, EVERYTHING, True),
    "feature_table_busy_entities": table_sql(EV_SQL, EVERYTHING, True),
    "naive_feature_table": _naive_sql(LI_SQL, EVERYTHING),
    "naive_stream_buckets": _naive_sql(EV_SQL, [*VELOCITY, *DISTINCTS, *DEVICE]),
    "audit_point_in_time": AUDIT_SQL,
    "audit_naive": AUDIT_NAIVE_SQL,
}
