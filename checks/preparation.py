"""Queries: sources, contracts, messages, canonical events, labels, splits, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import (
    EV_SQL,
    LI_SQL,
    SPLIT_SQL,
    STREAM_SPLITS,
    Query,
    draw_sql,
    ev,
    li,
    rounded,
    rounded_sql,
)
from tallyward.functions.columns import (
    AS241_CENTRE,
    AS241_MIDDLE,
    AS241_TAIL,
    composite_key,
    event_ms,
    stable_id,
    unit_uniform,
)
from tallyward.operators import history, prep
from tallyward.settings import DEFAULT_SPLITS, LabelDelay
from tallyward.sources import contracts
from tallyward.sources.tables import narrow_floats, read_events

# ---------------------------------------------------------------- sources and contracts


def scan_columns(spark: SparkSession, sf: str) -> DataFrame:
    return read_events(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey"])


def narrowed_floats(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"
    )
    narrow = narrow_floats(lines, keep=("l_extendedprice",))
    return narrow.select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.col("l_discount").cast("double").alias("l_discount"),
        F.col("l_tax").cast("double").alias("l_tax"),
    )


def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The raw stream, before non-positive values are dropped and with a duplicated day."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    table = raw.select(
        F.concat(F.lit("ev-"), (F.col("event_id") % 9_000).cast("string")).alias("txn_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.concat(F.lit("c_"), F.col("user_id").cast("string")).alias("card_id"),
        F.lit(None).cast("string").alias("device_id"),
        F.when(F.col("event_id") % 37 != 0, F.lit("m")).alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        F.lit(None).cast("string").alias("ip"),
        (F.col("value") - 1.0).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("ecom").alias("channel"),
        F.lit(None).cast("boolean").alias("is_fraud"),
    )
    return contracts.value_violations(table)


CONTRACT_SQL = """
WITH t AS (
  SELECT 'ev-' || (event_id % 9000) AS txn_id, ts AS event_ts, 'c_' || user_id AS card_id,
         CASE WHEN event_id % 37 <> 0 THEN 'm' END AS merchant_id, event_type AS merchant_category,
         value - 1.0 AS amount, 'USD' AS currency, 'ecom' AS channel FROM events
)
SELECT 'null_txn_id' AS rule, count(*) FILTER (txn_id IS NULL) AS n FROM t
UNION ALL SELECT 'null_event_ts', count(*) FILTER (event_ts IS NULL) FROM t
UNION ALL SELECT 'null_card_id', count(*) FILTER (card_id IS NULL) FROM t
UNION ALL SELECT 'null_merchant_id', count(*) FILTER (merchant_id IS NULL) FROM t
UNION ALL SELECT 'null_merchant_category', count(*) FILTER (merchant_category IS NULL) FROM t
UNION ALL SELECT 'null_amount', count(*) FILTER (amount IS NULL) FROM t
UNION ALL SELECT 'null_currency', count(*) FILTER (currency IS NULL) FROM t
UNION ALL SELECT 'null_channel', count(*) FILTER (channel IS NULL) FROM t
UNION ALL SELECT 'non_positive_amount', count(*) FILTER (amount <= 0) FROM t
UNION ALL SELECT 'repeated_txn_id', count(*) - count(DISTINCT txn_id) FROM t
"""


def message_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every event to JSON and back, checked on the way in."""
    decoded = contracts.decode_events(contracts.event_to_json(ev(spark, sf)))
    good = contracts.accepted(decoded)
    return good.select(
        "txn_id",
        event_ms().alias("ms"),
        "card_id",
        "device_id",
        "merchant_id",
        "merchant_category",
        "amount",
        "is_fraud",
    )


ROUND_TRIP_SQL = f"""
WITH {EV_SQL}
SELECT txn_id, ms, card_id, device_id, merchant_id, merchant_category, amount,
       CAST(NULL AS BOOLEAN) AS is_fraud FROM txns
"""


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with a different fault for every remainder of the event id."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 8
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    body = F.struct(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("txn_id"),
        F.when(k == 1, stamp).otherwise(F.concat(stamp, F.lit("Z"))).alias("event_ts"),
        F.concat(F.lit("c_"), F.col("user_id").cast("string")).alias("card_id"),
        F.lit("m_1").alias("merchant_id"),
        F.when(k == 2, F.lit("a category that is too long")).otherwise(F.col("event_type")).alias(
            "merchant_category"
        ),
        F.when(k == 3, -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.when(k == 4, F.lit("usd")).otherwise(F.lit("USD")).alias("currency"),
        F.when(k == 5, F.lit("phone")).otherwise(F.lit("pos")).alias("channel"),
        F.when(k == 6, F.lit(True)).alias("is_fraud"),
        F.when(k == 7, F.lit("x")).alias("surprise"),
    )
    return raw.select(F.to_json(body).alias("value"))


def _fault_counts(decoded: DataFrame) -> DataFrame:
    return (
        decoded.select(F.explode_outer("errors").alias("problem"))
        .groupBy(F.coalesce("problem", F.lit("none")).alias("problem"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def message_faults(spark: SparkSession, sf: str) -> DataFrame:
    return _fault_counts(contracts.decode_events(_damaged(spark, sf)))


def score_request_faults(spark: SparkSession, sf: str) -> DataFrame:
    return _fault_counts(contracts.decode_events(_damaged(spark, sf), for_scoring=True))


def _faults_sql(scoring: bool) -> str:
    label = "WHEN k = 6 THEN 'is_fraud'" if scoring else ""
    return f"""
WITH t AS (SELECT event_id % 8 AS k, value FROM events),
faults AS (
  SELECT CASE k WHEN 1 THEN 'event_ts' WHEN 2 THEN 'merchant_category' WHEN 3 THEN 'amount'
                WHEN 4 THEN 'currency' WHEN 5 THEN 'channel' WHEN 7 THEN 'unknown_field' END AS a,
         CASE WHEN value <= 0 AND k <> 3 THEN 'amount' END AS b,
         CASE {label or "WHEN false THEN ''"} END AS c
  FROM t
)
SELECT problem, count(*) AS n FROM (
  SELECT a AS problem FROM faults WHERE a IS NOT NULL
  UNION ALL SELECT b FROM faults WHERE b IS NOT NULL
  UNION ALL SELECT c FROM faults WHERE c IS NOT NULL
  UNION ALL SELECT 'none' FROM faults WHERE a IS NULL AND b IS NULL AND c IS NULL
) GROUP BY problem
"""


def label_message_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Labels moved before their transaction for every fifth event are quarantined."""
    labels = prep.label_events(ev(spark, sf))
    k = F.regexp_extract("txn_id", r"(\d+)$", 1).cast("bigint")
    moved = labels.withColumn(
        "label_ts",
        F.when(k % 5 == 0, F.col("event_ts") - F.expr("interval 1 second")).otherwise(
            F.col("label_ts")
        ),
    )
    return _fault_counts(contracts.decode_labels(contracts.labels_to_json(moved)))


LABEL_FAULT_SQL = f"""
WITH {EV_SQL}
SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN CAST(regexp_extract(txn_id, '(\\d+)$', 1) AS BIGINT) % 5 = 0
              THEN 'label_before_event' ELSE 'none' END AS problem FROM txns
) GROUP BY problem
"""


# ---------------------------------------------------------------- ids, labels, splits


def composite_ids(spark: SparkSession, sf: str) -> DataFrame:
    """A key with a null part keeps it; a null key has no id."""
    rows = li(spark, sf)
    key = composite_key(["card_id", "device_id", "merchant_category"])
    return rows.select(
        "txn_id",
        key.alias("entity_key"),
        stable_id("e", key).alias("entity_id"),
        F.when(F.col("device_id").isNotNull(), stable_id("d", F.col("device_id"))).alias("masked_id"),
    )


COMPOSITE_SQL = f"""
WITH {LI_SQL},
keyed AS (
  SELECT txn_id, device_id,
         concat_ws('|', card_id, coalesce(device_id, '<null>'), merchant_category) AS entity_key
  FROM txns
)
SELECT txn_id, entity_key, 'e_' || substr(sha256(entity_key), 1, 16) AS entity_id,
       'd_' || substr(sha256(device_id), 1, 16) AS masked_id FROM keyed
"""


def canonical_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as the raw transaction table and customers as its identity table, canonicalised."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    n = F.col("o_orderkey")
    transactions = orders.select(
        n.alias("TransactionID"),
        (n % 10 == 0).cast("bigint").alias("isFraud"),
        (F.lit(86_400) + n * 613).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_orderstatus").alias("ProductCD"),
        F.col("o_custkey").alias("card1"),
        (F.col("o_custkey") % 7).alias("card2"),
        F.lit(150).cast("bigint").alias("card3"),
        F.lit("visa").alias("card4"),
        F.when(n % 3 == 0, F.lit(226).cast("bigint")).alias("card5"),
        F.lit("debit").alias("card6"),
        (F.col("o_custkey") % 100).alias("addr1"),
        (n % 2).alias("D1"),
        F.when(n % 4 != 0, F.lit("mail.example")).alias("R_emaildomain"),
    )
    identity = customers.select(
        F.col("c_custkey").alias("TransactionID"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("phone")).alias("DeviceInfo"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("os 1")).alias("id_30"),
        F.lit(None).cast("string").alias("id_31"),
        F.lit(None).cast("string").alias("id_33"),
    )
    out = prep.to_canonical(transactions, identity)
    return out.select(
        "txn_id",
        event_ms().alias("ms"),
        "card_id",
        "device_id",
        "merchant_id",
        "amount",
        "is_fraud",
        "attr_card1",
        "attr_DeviceInfo",
    )


CANONICAL_SQL = """
WITH raw AS (
  SELECT o_orderkey AS n, o_custkey AS c, 86400 + o_orderkey * 613 AS dt, o_totalprice AS amount,
         o_orderstatus AS product,
         CASE WHEN c_custkey % 3 = 0 THEN 'phone' END AS device,
         CASE WHEN c_custkey % 5 = 0 THEN 'os 1' END AS os
  FROM orders LEFT JOIN customer ON o_orderkey = c_custkey
),
keyed AS (
  SELECT *, concat_ws('|', c, c % 7, 150, 'visa', CASE WHEN n % 3 = 0 THEN '226' ELSE '<null>' END,
                      'debit', c % 100, dt // 86400 - n % 2) AS card_key,
         concat_ws('|', coalesce(device, '<null>'), coalesce(os, '<null>'), '<null>', '<null>') AS dev_key,
         concat_ws('|', product, CASE WHEN n % 4 <> 0 THEN 'mail.example' ELSE '<null>' END) AS shop_key
  FROM raw
)
SELECT 'ieee-' || n AS txn_id, (1512000000 + dt) * 1000 AS ms,
       'c_' || substr(sha256(card_key), 1, 16) AS card_id,
       CASE WHEN device IS NOT NULL OR os IS NOT NULL
            THEN 'd_' || substr(sha256(dev_key), 1, 16) END AS device_id,
       'm_' || substr(sha256(shop_key), 1, 16) AS merchant_id,
       amount, n % 10 = 0 AS is_fraud, c AS "attr_card1", device AS "attr_DeviceInfo"
FROM keyed
"""


def hashed_draws(spark: SparkSession, sf: str) -> DataFrame:
    return li(spark, sf).select("txn_id", unit_uniform(11, F.col("txn_id")).alias("draw"))


HASHED_SQL = f"WITH {LI_SQL} SELECT txn_id, {draw_sql('11', 'txn_id')} AS draw FROM txns"


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def _rational(pair: tuple, x: str) -> str:
    return f"({_poly(pair[0], x)} / {_poly(pair[1], x)})"


DELAY_SQL = f"""
drawn AS (SELECT *, {draw_sql('11', 'txn_id')} AS u FROM txns),
shaped AS (SELECT *, u - 0.5 AS q, sqrt(-ln(least(u, 1 - u))) AS r FROM drawn),
normal AS (
  SELECT *, CASE
    WHEN abs(q) <= 0.425 THEN q * {_rational(AS241_CENTRE, '(0.180625 - q * q)')}
    ELSE sign(q) * CASE WHEN r <= 5 THEN {_rational(AS241_MIDDLE, '(r - 1.6)')}
                        ELSE {_rational(AS241_TAIL, '(r - 5.0)')} END
    END AS z FROM shaped
),
delayed AS (SELECT *, least(5.0 * exp(0.6 * z), 14.0) AS delay_days FROM normal),
labels AS (
  SELECT txn_id, card_id, merchant_id, ms, is_fraud,
         ms + CASE WHEN is_fraud THEN CAST(round_even(delay_days * 86400000, 0) AS BIGINT)
                   ELSE 1209600000 END AS label_ms
  FROM delayed
)"""


def fraud_delays(spark: SparkSession, sf: str) -> DataFrame:
    delayed = prep.with_fraud_delay(li(spark, sf), LabelDelay())
    return rounded(delayed.select("txn_id", "delay_days"))


DELAYS_SQL = rounded_sql(
    f"WITH {LI_SQL}, {DELAY_SQL} SELECT txn_id, delay_days FROM delayed", ["delay_days"]
)


def label_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """At second grain: the delay's last bits differ between math libraries."""
    labels = prep.label_events(li(spark, sf))
    return labels.select(
        "txn_id",
        "card_id",
        "merchant_id",
        event_ms().alias("ms"),
        F.floor((event_ms("label_ts") + 500) / 1000).alias("label_s"),
        "is_fraud",
    )


ARRIVALS_SQL = f"""
WITH {LI_SQL}, {DELAY_SQL}
SELECT txn_id, card_id, merchant_id, ms, (label_ms + 500) // 1000 AS label_s, is_fraud FROM labels
"""


def temporal_splits(spark: SparkSession, sf: str) -> DataFrame:
    return prep.assign_splits(li(spark, sf), DEFAULT_SPLITS).select("txn_id", "split")


def one_split(spark: SparkSession, sf: str) -> DataFrame:
    return prep.select_split(ev(spark, sf), STREAM_SPLITS, "calibration").select("txn_id", "amount")


ONE_SPLIT_SQL = f"""
WITH {EV_SQL}
SELECT txn_id, amount FROM (
  SELECT *, ms // 86400000 - min(ms // 86400000) OVER () AS d FROM txns
) WHERE d >= 21 AND d < 25
"""


def label_maturity(spark: SparkSession, sf: str) -> DataFrame:
    events = li(spark, sf)
    frame = prep.assign_splits(events, DEFAULT_SPLITS)
    out = prep.label_maturity(
        frame, prep.label_events(events), train_window="train", next_window="early_stopping"
    )
    return out.select(
        F.floor((F.col("latest_label_ms") + 500) / 1000).alias("latest_label_s"),
        "next_start_ms",
        "ok",
    )


MATURITY_SQL = f"""
WITH {LI_SQL}, {DELAY_SQL}, {SPLIT_SQL}
SELECT (a.m + 500) // 1000 AS latest_label_s, b.m AS next_start_ms, a.m < b.m AS ok
FROM (SELECT max(label_ms) AS m FROM labels WHERE txn_id IN
        (SELECT txn_id FROM placed WHERE split = 'train')) a,
     (SELECT min(ms) AS m FROM placed WHERE split = 'early_stopping') b
"""


def event_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Labels arrive at maturity here (a legitimate-only view), so times are exact."""
    events = ev(spark, sf)
    labels = prep.label_events(events.withColumn("is_fraud", F.lit(False)))
    return history.timeline(events, labels)


TIMELINE_SQL = f"""
WITH {EV_SQL}
SELECT ms AS time_ms, 1 AS kind, row_number() OVER (ORDER BY ms, txn_id) - 1 AS sequence, txn_id
FROM txns
UNION ALL
SELECT ms + 1209600000, 0, row_number() OVER (ORDER BY ms, txn_id) - 1, txn_id FROM txns
"""


def limited_replay(spark: SparkSession, sf: str) -> DataFrame:
    events = ev(spark, sf)
    labels = prep.label_events(events.withColumn("is_fraud", F.lit(False)))
    return history.replay_stats(
        history.limit_transactions(history.timeline(events, labels), 5_000)
    )


LIMITED_SQL = f"""
WITH {EV_SQL},
items AS (
  SELECT ms AS t, 1 AS kind, row_number() OVER (ORDER BY ms, txn_id) - 1 AS s FROM txns
  UNION ALL
  SELECT ms + 1209600000, 0, row_number() OVER (ORDER BY ms, txn_id) - 1 FROM txns
),
counted AS (
  SELECT *, sum(kind) OVER (ORDER BY t, kind, s ROWS UNBOUNDED PRECEDING) AS seen FROM items
)
SELECT count(*) FILTER (kind = 1) AS transactions, count(*) FILTER (kind = 0) AS labels,
       max(t) - min(t) AS event_span_ms
FROM counted WHERE seen <= 5000
"""


def table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return prep.data_fingerprint(li(spark, sf))


FINGERPRINT_SQL = f"""
WITH {LI_SQL},
s AS (
  SELECT count(*) AS n_rows, min(ms) AS first_ms, max(ms) AS last_ms,
         CAST(sum(cents) AS BIGINT) AS amount_cents,
         CAST(sum(CAST(is_fraud AS BIGINT)) AS BIGINT) AS frauds FROM txns
)
SELECT *, substr(sha256(concat_ws('|', n_rows, first_ms, last_ms, amount_cents, frauds)), 1, 16)
       AS fingerprint FROM s
"""


def event_order_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """The last tenth in event order against the history before it."""
    past, labels, requests = history.holdout(
        ev(spark, sf).withColumn("is_fraud", F.lit(False)), request_share=0.1
    )
    part = F.lit
    return (
        past.select("txn_id", part("history").alias("part"))
        .unionByName(labels.select("txn_id", part("label").alias("part")))
        .unionByName(requests.select("txn_id", part("request").alias("part")))
    )


HOLDOUT_SQL = f"""
WITH {EV_SQL},
ordered AS (
  SELECT *, row_number() OVER (ORDER BY ms, txn_id) AS rn, CAST(floor(count(*) OVER () * 0.9) AS BIGINT) AS cut
  FROM txns
)
SELECT txn_id, 'history' AS part FROM ordered WHERE rn <= cut
UNION ALL
SELECT txn_id, 'label' FROM ordered WHERE rn <= cut
  AND ms + 1209600000 < (SELECT min(ms) FROM ordered WHERE rn = cut + 1)
UNION ALL
SELECT txn_id, 'request' FROM ordered WHERE rn > cut
"""


def dictionary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their nation and region, by left dictionary joins."""
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    region = spark.read.parquet(f"{sf}/region.parquet")
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").withColumnRenamed(
        "s_nationkey", "n_nationkey"
    )
    named = prep.model_value_lookup(supplier, nation, "n_nationkey").withColumnRenamed(
        "n_regionkey", "r_regionkey"
    )
    out = prep.model_value_lookup(named, region, "r_regionkey")
    return out.select("s_suppkey", "n_name", "r_name")


DICTIONARY_SQL = """
SELECT s_suppkey, n_name, r_name FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
"""

QUERIES: dict[str, Query] = {
    "scan_columns": scan_columns,
    "narrowed_floats": narrowed_floats,
    "contract_violations": contract_violations,
    "message_round_trip": message_round_trip,
    "message_faults": message_faults,
    "score_request_faults": score_request_faults,
    "label_message_faults": label_message_faults,
    "composite_ids": composite_ids,
    "canonical_events": canonical_events,
    "hashed_draws": hashed_draws,
    "fraud_delays": fraud_delays,
    "label_arrivals": label_arrivals,
    "temporal_splits": temporal_splits,
    "one_split": one_split,
    "label_maturity": label_maturity,
    "event_timeline": event_timeline,
    "limited_replay": limited_replay,
    "table_fingerprint": table_fingerprint,
    "event_order_holdout": event_order_holdout,
    "dictionary_lookup": dictionary_lookup,
}
ORACLES: dict[str, str] = {
    "scan_columns": "SELECT o_orderkey, o_custkey FROM orders",
    "narrowed_floats": """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS l_discount,
       CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS l_tax FROM lineitem""",
    "contract_violations": CONTRACT_SQL,
    "message_round_trip": ROUND_TRIP_SQL,
    "message_faults": _faults_sql(False),
    "score_request_faults": _faults_sql(True),
    "label_message_faults": LABEL_FAULT_SQL,
    "composite_ids": COMPOSITE_SQL,
    "canonical_events": CANONICAL_SQL,
    "hashed_draws": HASHED_SQL,
    "fraud_delays": DELAYS_SQL,
    "label_arrivals": ARRIVALS_SQL,
    "temporal_splits": f"WITH {LI_SQL}, {SPLIT_SQL} SELECT txn_id, split FROM placed",
    "one_split": ONE_SPLIT_SQL,
    "label_maturity": MATURITY_SQL,
    "event_timeline": TIMELINE_SQL,
    "limited_replay": LIMITED_SQL,
    "table_fingerprint": FINGERPRINT_SQL,
    "event_order_holdout": HOLDOUT_SQL,
    "dictionary_lookup": DICTIONARY_SQL,
}
