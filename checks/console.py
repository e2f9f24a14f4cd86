"""Queries: decision records, verdicts, review queue, console views and the latency log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import EV_SQL, Query, draw_sql, ev, rounded, rounded_sql, with_probability
from tallyward.functions.columns import event_ms, unit_uniform
from tallyward.operators import decisions as d
from tallyward.operators import policy
from tallyward.settings import CostModel

COSTS = CostModel()
DAY = "2024-01-10"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Decision records over the stream: an untuned policy, stand-in scores, timings and features.

    Every eleventh record is an old one without a decision.
    """
    base = with_probability(ev(spark, sf)).withColumn("forced", F.lit(None).cast("string"))
    p = F.col("probability")
    action = F.when(p >= 0.8, F.lit("block")).when(p >= 0.5, F.lit("review")).otherwise(F.lit("approve"))
    decided = policy.with_expected_costs(base, COSTS).withColumn("action", action)
    n = F.regexp_extract("txn_id", r"(\d+)$", 1).cast("bigint")
    lag = F.floor(unit_uniform("lag", F.col("txn_id")) * 5_000).cast("bigint")
    reasons = F.when(
        F.col("action") != "approve",
        F.array(
            F.struct(
                F.lit("amount").alias("feature"),
                F.col("amount").cast("string").alias("value"),
                p.alias("contribution"),
                F.lit("Transaction amount").alias("description"),
            )
        ),
    ).otherwise(F.array().cast(d.REASON_LIST))
    decision = F.struct(
        F.col("action"),
        F.when(n % 50 == 0, F.lit("velocity_cap_1h")).alias("override"),
        (n % 9 == 0).alias("review_capped"),
        F.col("review_benefit"),
        F.lit(0.0).alias("review_threshold"),
        F.create_map(
            F.lit("approve"),
            F.col("cost_approve"),
            F.lit("review"),
            F.col("cost_review"),
            F.lit("block"),
            F.col("cost_block"),
        ).alias("expected_cost"),
        reasons.alias("reason_codes"),
    )
    k = (n % 7).cast("string")
    features = F.create_map(
        F.lit("card_amount_mean_30d"),
        F.when(n % 4 != 0, F.format_string("%.2f", F.col("amount") * 2)),
        F.lit("amount_zscore_30d"),
        F.when(n % 8 > 2, F.lit("1.25")),
        F.lit("card_txn_count_1h"),
        k,
        F.lit("card_txn_count_24h"),
        (n % 7 + 12).cast("string"),
        F.lit("card_distinct_devices_24h"),
        F.when(n % 5 != 0, F.lit("2")),
        F.lit("card_device_seen_before"),
        F.when(n % 3 == 0, F.lit("true")).when(n % 3 == 1, F.lit("0")),
        F.lit("card_merchant_seen_before"),
        F.when(n % 2 == 0, F.lit("false")),
        F.lit("card_age_days"),
        F.lit("3.5"),
    )
    stage = {s: unit_uniform(s, F.col("txn_id")) * (i + 1) for i, s in enumerate(d.STAGES)}
    timings = F.struct(
        *[
            (F.when(n % 11 != 0, v) if s in d.OPTIONAL_STAGES else v).alias(s)
            for s, v in stage.items()
        ]
    )
    return decided.select(
        "txn_id",
        "event_ts",
        F.timestamp_millis(F.col("event_ms") + lag).alias("scored_at"),
        "card_id",
        "merchant_id",
        "device_id",
        "amount",
        "currency",
        F.lit("v1").alias("model_version"),
        p.alias("fraud_probability"),
        p.alias("raw_score"),
        features.alias("features"),
        F.when(n % 11 != 0, decision).alias("decision"),
        timings.alias("timings"),
    )


def _stage_sql(name: str, i: int) -> str:
    draw = f"{draw_sql(name, 'txn_id')} * {i + 1}"
    if name in d.OPTIONAL_STAGES:
        draw = f"CASE WHEN n % 11 <> 0 THEN {draw} END"
    return f"{draw} AS {name}"


RECORDS_SQL = f"""{EV_SQL},
base AS (
  SELECT *, u * u * u * u AS p, CAST(regexp_extract(txn_id, '(\\d+)$', 1) AS BIGINT) AS n,
    ms + CAST(floor({draw_sql('lag', 'txn_id')} * 5000) AS BIGINT) AS scored_ms
  FROM (SELECT *, {draw_sql('score', 'txn_id')} AS u FROM txns)
),
decisions AS (
  SELECT *, CASE WHEN n % 11 <> 0 THEN CASE WHEN p >= 0.8 THEN 'block' WHEN p >= 0.5 THEN 'review'
           ELSE 'approve' END END AS action,
         CASE WHEN n % 11 <> 0 AND n % 50 = 0 THEN 'velocity_cap_1h' END AS override,
         CASE WHEN n % 11 <> 0 THEN n % 9 = 0 END AS review_capped,
         p * amount AS expected_fraud_loss,
         {', '.join(_stage_sql(s, i) for i, s in enumerate(d.STAGES))}
  FROM base
),
verdicts AS (
  SELECT txn_id, CASE WHEN n % 2 = 0 THEN 'fraud' ELSE 'legitimate' END AS verdict FROM decisions
  WHERE n % 3 = 0
)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return d.decision_rows(records(spark, sf))


def _number():
    return F.regexp_extract("txn_id", r"(\d+)$", 1).cast("bigint")


def verdicts(rows: DataFrame) -> DataFrame:
    return rows.filter(_number() % 3 == 0).select(
        "txn_id",
        F.when(_number() % 2 == 0, F.lit("fraud")).otherwise(F.lit("legitimate")).alias("verdict"),
        F.lit("checked").alias("note"),
        F.lit("ana").alias("analyst"),
    )


def record_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records to JSON and back: missing stages read as 0, missing decisions stay missing."""
    back = d.decode_records(d.encode_records(records(spark, sf)))
    return rounded(
        back.select(
            "txn_id",
            event_ms().alias("ms"),
            event_ms("scored_at").alias("scored_ms"),
            "fraud_probability",
            F.col("decision.action").alias("action"),
            F.size(d.record_problems(back)).cast("bigint").alias("problems"),
            F.col("timings.policy_ms").alias("policy_ms"),
            F.col("timings.total_ms").alias("total_ms"),
        )
    )


ROUND_TRIP_SQL = rounded_sql(
    f"""WITH {RECORDS_SQL} SELECT txn_id, ms, scored_ms, p AS fraud_probability, action,
    CAST(0 AS BIGINT) AS problems, coalesce(policy_ms, 0) AS policy_ms, total_ms FROM decisions""",
    ["fraud_probability", "policy_ms", "total_ms"],
)


def decision_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A second batch rewrites a third of the decisions and redelivers another third unchanged."""
    rows = decisions(spark, sf)
    first = rows.withColumn("batch", F.lit(1))
    second = rows.filter(_number() % 3 != 2).withColumn("batch", F.lit(2)).withColumn(
        "action", F.when(_number() % 3 == 0, F.lit("block")).otherwise(F.col("action"))
    )
    out = d.upsert_decisions(first, second)
    return out.select("txn_id", "action", "batch")


UPSERT_SQL = f"""WITH {RECORDS_SQL} SELECT txn_id, CASE WHEN n % 3 = 0 THEN 'block' ELSE action END AS action,
CAST(CASE WHEN n % 3 <> 2 THEN 2 ELSE 1 END AS INT) AS batch FROM decisions"""


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = decisions(spark, sf)
    out = d.review_queue(rows, verdicts(rows), limit=100)
    return rounded(out.select("txn_id", "card_id", "amount", "expected_fraud_loss"))


_OPEN = """SELECT * FROM decisions WHERE action = 'review' AND txn_id NOT IN (SELECT txn_id FROM verdicts)
ORDER BY expected_fraud_loss DESC, ms, txn_id LIMIT 100"""
QUEUE_SQL = rounded_sql(
    f"WITH {RECORDS_SQL}, q AS ({_OPEN}) SELECT txn_id, card_id, amount, expected_fraud_loss FROM q",
    ["amount", "expected_fraud_loss"],
)


def queue_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = decisions(spark, sf)
    return d.queue_rows(d.review_queue(rows, verdicts(rows), limit=100))


QUEUE_ROWS_SQL = f"""WITH {RECORDS_SQL}, q AS ({_OPEN})
SELECT txn_id AS "transaction", strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M') AS event_time,
  card_id AS card, merchant_id AS merchant, format('{{:,.2f}}', amount) || ' USD' AS amount,
  format('{{:.2f}}', p * 100) || '%' AS fraud_probability,
  format('{{:,.2f}}', expected_fraud_loss) || ' USD' AS expected_fraud_loss FROM q"""


def latest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return d.latest_decisions(decisions(spark, sf), 50).select("txn_id", event_ms("scored_at").alias("scored_ms"))


LATEST_SQL = f"WITH {RECORDS_SQL} SELECT txn_id, scored_ms FROM decisions ORDER BY scored_ms DESC, txn_id DESC LIMIT 50"


def find_decision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.find_decision(decisions(spark, sf), "ev-77").select("txn_id", "card_id", "amount", "action"))


FIND_SQL = rounded_sql(
    f"WITH {RECORDS_SQL} SELECT txn_id, card_id, amount, action FROM decisions WHERE txn_id = 'ev-77'", ["amount"]
)


def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    return d.action_counts(decisions(spark, sf), F.lit(f"{DAY} 00:00:00").cast("timestamp"))


ACTION_COUNTS_SQL = f"""WITH {RECORDS_SQL} SELECT coalesce(action, 'none') AS action, count(*) AS n FROM decisions
WHERE scored_ms >= epoch_ms(TIMESTAMP '{DAY} 00:00:00') GROUP BY 1"""


def reviews_per_event_day(spark: SparkSession, sf: str) -> DataFrame:
    out = d.reviews_per_event_day(decisions(spark, sf))
    return out.select(F.unix_date("event_day").cast("bigint").alias("event_day"), "reviews")


REVIEW_DAYS_SQL = f"""WITH {RECORDS_SQL} SELECT ms // 86400000 AS event_day, count(*) AS reviews
FROM decisions WHERE action = 'review' GROUP BY 1"""


def card_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The last three earlier decisions on the card, for every blocked transaction."""
    rows = decisions(spark, sf)
    cases = rows.filter(F.col("action") == "block").select(
        F.col("txn_id").alias("case_id"), "card_id", F.col("event_ts").alias("before_ts")
    )
    return d.card_history(rows, cases, 3).select("case_id", "txn_id", F.col("position").cast("bigint").alias("position"))


HISTORIES_SQL = f"""WITH {RECORDS_SQL}
SELECT case_id, txn_id, position FROM (
  SELECT c.txn_id AS case_id, h.txn_id,
    row_number() OVER (PARTITION BY c.txn_id ORDER BY h.ms DESC, h.txn_id DESC) AS position
  FROM decisions c JOIN decisions h ON c.card_id = h.card_id AND h.ms < c.ms WHERE c.action = 'block'
) WHERE position <= 3"""


def verdict_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts given twice, on unknown transactions and with a bad value; the good latest remain."""
    rows = decisions(spark, sf)
    given = verdicts(rows).withColumn("decided_at", F.lit(1))
    again = given.filter(_number() % 2 == 0).withColumn("verdict", F.lit("legitimate")).withColumn(
        "decided_at", F.lit(2)
    )
    bad = given.withColumn("verdict", F.lit("unsure")).withColumn("decided_at", F.lit(3))
    stray = given.withColumn("txn_id", F.concat(F.lit("x-"), F.col("txn_id")))
    every = given.unionByName(again).unionByName(bad).unionByName(stray)
    kept = d.accept_verdicts(every, rows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    refused = d.verdict_problems(every, rows).groupBy(F.col("problem").alias("verdict")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return kept.unionByName(refused)


VERDICTS_SQL = f"""WITH {RECORDS_SQL}
SELECT 'legitimate' AS verdict, count(*) AS n FROM verdicts
UNION ALL SELECT 'unknown_transaction', count(*) FROM verdicts
UNION ALL SELECT 'verdict', count(*) FROM verdicts"""


def feed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(d.feed_summary(decisions(spark, sf), today=DAY, review_budget=200))


FEED_SQL = rounded_sql(
    f"""WITH {RECORDS_SQL} SELECT count(*) AS decisions, count(*) FILTER (action = 'approve') AS n_approve,
    count(*) FILTER (action = 'review') AS n_review, count(*) FILTER (action = 'block') AS n_block,
    count(*) FILTER (action = 'block') / CAST(count(action) AS DOUBLE) AS block_rate,
    count(*) FILTER (action = 'review') / CAST(count(action) AS DOUBLE) AS review_rate,
    count(*) FILTER (action = 'review' AND strftime(make_timestamp(ms * 1000), '%Y-%m-%d') = '{DAY}') AS reviews_today,
    CAST(200 AS BIGINT) AS review_budget FROM decisions""",
    ["block_rate", "review_rate"],
)


def feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return d.feed_rows(records(spark, sf))


FEED_ROWS_SQL = f"""WITH {RECORDS_SQL}
SELECT strftime(make_timestamp(scored_ms * 1000), '%Y-%m-%d %H:%M:%S') AS scored_at, txn_id AS "transaction",
  strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M') AS event_time, format('{{:,.2f}}', amount) || ' USD' AS amount,
  format('{{:.2f}}', p * 100) || '%' AS fraud_probability, coalesce(action, 'none') AS decision,
  coalesce(override, '') AS override,
  CASE WHEN action IN ('review', 'block') THEN 'Transaction amount' ELSE '' END AS top_reason FROM decisions"""


def case_view(spark: SparkSession, sf: str) -> DataFrame:
    """The case page of every review, flattened to comparable columns."""
    rec = records(spark, sf)
    rows = d.decision_rows(rec)
    cases = rows.filter(F.col("action") == "review").select("txn_id")
    out = d.case_views(rec, cases, verdicts(rows), history=3)
    text = F.array_join(
        F.transform("baseline", lambda b: F.concat(b["measure"], F.lit("="), b["this"], F.lit("/"), b["before"])), ";"
    )
    return out.select(
        "txn_id",
        F.size("facts").cast("bigint").alias("facts"),
        F.array_join(F.transform("expected_costs", lambda e: e["action"]), ">").alias("cheapest_first"),
        F.size("reasons").cast("bigint").alias("reasons"),
        text.alias("baseline"),
        F.coalesce(F.array_join(F.transform("history", lambda h: h["txn_id"]), ","), F.lit("")).alias("history"),
        "verdict",
    )


CASE_SQL = f"""WITH {RECORDS_SQL},
h AS (
  SELECT case_id, string_agg(txn_id, ',' ORDER BY position) AS history FROM (
    SELECT c.txn_id AS case_id, h.txn_id,
      row_number() OVER (PARTITION BY c.txn_id ORDER BY h.ms DESC, h.txn_id DESC) AS position
    FROM decisions c JOIN decisions h ON c.card_id = h.card_id AND h.ms < c.ms WHERE c.action = 'review'
  ) WHERE position <= 3 GROUP BY case_id
),
costs AS (
  SELECT txn_id, string_agg(action, '>' ORDER BY cost, action) AS cheapest_first FROM (
    SELECT txn_id, 'approve' AS action, p * amount AS cost FROM decisions
    UNION ALL SELECT txn_id, 'review', 5.0 + p * (1.0::DOUBLE - 0.9::DOUBLE) * amount FROM decisions
    UNION ALL SELECT txn_id, 'block', (1.0 - p) * (0.1::DOUBLE * amount + 2.0) FROM decisions) GROUP BY txn_id
)
SELECT d.txn_id, CAST(16 AS BIGINT) AS facts, cheapest_first, CAST(1 AS BIGINT) AS reasons,
  'amount=' || format('{{:,.2f}}', amount) || ' USD/' || CASE WHEN n % 8 = 0 THEN 'nothing known'
    WHEN n % 4 = 0 THEN 'zscore +1.3'
    ELSE 'mean ' || format('{{:,.2f}}', CAST(format('{{:.2f}}', amount * 2) AS DOUBLE)) || ' USD'
      || CASE WHEN n % 8 > 2 THEN ', zscore +1.3' ELSE '' END END
  || ';txn count=' || (n % 7) || ' in 1h/' || (n % 7 + 12) || ' in 24h'
  || CASE n % 3 WHEN 0 THEN ';device=' || coalesce(device_id, '-') || '/seen before'
       WHEN 1 THEN ';device=' || coalesce(device_id, '-') || '/first time' ELSE '' END
  || CASE WHEN n % 2 = 0 THEN ';merchant=' || merchant_id || '/first time' ELSE '' END
  || ';card age=3.5 days/' AS baseline,
  coalesce(h.history, '') AS history, v.verdict
FROM decisions d JOIN costs USING (txn_id) LEFT JOIN h ON h.case_id = d.txn_id
LEFT JOIN verdicts v ON v.txn_id = d.txn_id WHERE d.action = 'review'"""


# ---------------------------------------------------------------- latency


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    rates = F.element_at(F.array(*[F.lit(r) for r in (25, 50, 100)]), (_number() % 3 + 1).cast("int"))
    return records(spark, sf).withColumn("rate", rates)


def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    decided = d.decode_records(d.encode_records(records(spark, sf)))
    rates = F.element_at(F.array(*[F.lit(r) for r in (25, 50, 100)]), (_number() % 3 + 1).cast("int"))
    return rounded(d.stage_latency(decided.withColumn("rate", rates)))


_STAGE_ROWS = " UNION ALL ".join(
    f"SELECT list_extract([25, 50, 100], CAST(n % 3 + 1 AS INT)) AS rate, '{s}' AS stage, coalesce({s}, 0) AS v"
    f" FROM decisions{chr(32) + 'WHERE action IN (' + repr('review') + ', ' + repr('block') + ')' if s == 'explain_ms' else ''}"
    for s in d.STAGES
)
STAGE_SQL = rounded_sql(
    f"""WITH {RECORDS_SQL}, s AS ({_STAGE_ROWS})
    SELECT rate, stage, count(*) AS n, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95,
      quantile_cont(v, 0.99) AS p99, max(v) AS max_ms FROM s GROUP BY rate, stage""",
    ["p50", "p95", "p99", "max_ms"],
)


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """Sustained rates: the fastest one here drops requests and gets errors."""
    log = _rated(spark, sf).select(
        "rate",
        F.when(F.col("rate") == 25, F.lit(100.0)).otherwise(F.lit(40.0)).alias("duration_s"),
        F.when((F.col("rate") == 100) & (_number() % 10 == 0), F.lit(503))
        .when((F.col("rate") == 100) & (_number() % 10 == 1), F.lit(-1))
        .otherwise(F.lit(200))
        .alias("status"),
    )
    return rounded(d.request_summary(log))


REQUESTS_SQL = rounded_sql(
    f"""WITH {RECORDS_SQL},
    log AS (SELECT list_extract([25, 50, 100], CAST(n % 3 + 1 AS INT)) AS rate, n FROM decisions),
    st AS (SELECT rate, CASE WHEN rate = 25 THEN 100.0 ELSE 40.0 END AS dur,
      CASE WHEN rate = 100 AND n % 10 = 0 THEN 503 WHEN rate = 100 AND n % 10 = 1 THEN -1 ELSE 200 END AS status FROM log),
    g AS (SELECT rate, count(*) FILTER (status >= 0) AS requests, count(*) FILTER (status < 0) AS dropped,
      count(*) FILTER (status >= 0 AND status <> 200) / CAST(count(*) FILTER (status >= 0) AS DOUBLE) AS failed_rate,
      count(*) FILTER (status >= 0) / CAST(max(dur) AS DOUBLE) AS achieved_rps FROM st GROUP BY rate)
    SELECT *, dropped = 0 AND failed_rate = 0 AND achieved_rps >= 0.98 * rate AS sustained FROM g""",
    ["failed_rate", "achieved_rps"],
)

QUERIES: dict[str, Query] = {
    "record_round_trip": record_round_trip,
    "decision_upsert": decision_upsert,
    "review_queue": review_queue,
    "queue_rows": queue_rows,
    "latest_decisions": latest_decisions,
    "find_decision": find_decision,
    "action_counts": action_counts,
    "reviews_per_event_day": reviews_per_event_day,
    "card_histories": card_histories,
    "verdict_merge": verdict_merge,
    "feed_summary": feed_summary,
    "feed_rows": feed_rows,
    "case_view": case_view,
    "stage_latency": stage_latency,
    "request_log": request_log,
}
ORACLES: dict[str, str] = {
    "record_round_trip": ROUND_TRIP_SQL,
    "decision_upsert": UPSERT_SQL,
    "review_queue": QUEUE_SQL,
    "queue_rows": QUEUE_ROWS_SQL,
    "latest_decisions": LATEST_SQL,
    "find_decision": FIND_SQL,
    "action_counts": ACTION_COUNTS_SQL,
    "reviews_per_event_day": REVIEW_DAYS_SQL,
    "card_histories": HISTORIES_SQL,
    "verdict_merge": VERDICTS_SQL,
    "feed_summary": FEED_SQL,
    "feed_rows": FEED_ROWS_SQL,
    "case_view": CASE_SQL,
    "stage_latency": STAGE_SQL,
    "request_log": REQUESTS_SQL,
}
