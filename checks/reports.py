"""Queries: table profile, rules baseline, decision, ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import (
    LI_SQL,
    PROBABILITY_SQL,
    SPLIT_SQL,
    Query,
    li,
    rounded,
    rounded_sql,
    with_probability,
)
from checks.features import feature_ctes
from tallyward.operators import calibration, eda, evaluation
from tallyward.operators.prep import assign_splits
from tallyward.operators.ranking import exact_quantiles
from tallyward.operators.rules import threshold_table
from tallyward.plans.rules_baseline import rule_frame, run_rules_baseline, score_rules
from tallyward.settings import DEFAULT_SPLITS, RULE_NAMES, CostModel, RuleLevels

COSTS = CostModel()

# ---------------------------------------------------------------- profile


def overview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.overview(li(spark, sf)))


OVERVIEW_SQL = rounded_sql(
    f"""WITH {LI_SQL} SELECT count(*) AS transactions, min(ms) AS first_ms, max(ms) AS last_ms,
    (max(ms) - min(ms)) / 86400000.0 AS span_days, 'USD' AS currencies,
    CAST(4 AS BIGINT) AS attribute_columns FROM txns""",
    ["span_days"],
)


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.class_balance(li(spark, sf)))


BALANCE_SQL = rounded_sql(
    f"""WITH {LI_SQL} SELECT count(*) AS labelled_transactions,
    CAST(0 AS BIGINT) AS unlabelled_transactions, count(*) FILTER (is_fraud) AS fraud_transactions,
    count(*) FILTER (is_fraud) / CAST(count(*) AS DOUBLE) AS fraud_rate,
    CAST(sum(mu) AS BIGINT) / 1000.0 AS total_amount,
    CAST(sum(mu) FILTER (is_fraud) AS BIGINT) / 1000.0 AS fraud_amount,
    (CAST(sum(mu) FILTER (is_fraud) AS BIGINT) / 1000.0) / (CAST(sum(mu) AS BIGINT) / 1000.0)
      AS fraud_amount_share FROM txns""",
    ["fraud_rate", "total_amount", "fraud_amount", "fraud_amount_share"],
)


def amount_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.amount_stats(li(spark, sf)))


_QUANTILES = " UNION ALL ".join(
    f"SELECT is_fraud, 'p{round(q * 100):02d}' AS statistic, quantile_cont(amount, {q}) AS value"
    " FROM txns GROUP BY is_fraud"
    for q in eda.AMOUNT_LEVELS
)
AMOUNTS_SQL = rounded_sql(
    f"""WITH {LI_SQL} SELECT is_fraud, 'count' AS statistic, CAST(count(*) AS DOUBLE) AS value
    FROM txns GROUP BY is_fraud
    UNION ALL SELECT is_fraud, 'mean', (CAST(sum(mu) AS BIGINT) / 1000.0) / count(*) FROM txns GROUP BY is_fraud
    UNION ALL SELECT is_fraud, 'max', max(amount) FROM txns GROUP BY is_fraud
    UNION ALL {_QUANTILES}""",
    ["value"],
)


def window_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.window_stats(li(spark, sf), DEFAULT_SPLITS))


WINDOWS_SQL = rounded_sql(
    f"""WITH {LI_SQL}, {SPLIT_SQL},
    wanted(split, start_day, end_day) AS (VALUES ('train', 0, 98), ('maturity_gap', 98, 112),
      ('early_stopping', 112, 133), ('calibration', 133, 154), ('test', 154, NULL))
    SELECT w.split, w.start_day, w.end_day, count(p.txn_id) AS transactions,
      count(*) FILTER (p.is_fraud) AS frauds,
      count(*) FILTER (p.is_fraud) / CAST(nullif(count(p.txn_id), 0) AS DOUBLE) AS fraud_rate,
      CAST(coalesce(sum(mu) FILTER (p.is_fraud), 0) AS BIGINT) / 1000.0 AS fraud_amount,
      min(ms) AS first_ms, max(ms) AS last_ms
    FROM wanted w LEFT JOIN placed p ON w.split = p.split GROUP BY ALL""",
    ["fraud_rate", "fraud_amount"],
)


def missing_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.missing_shares(li(spark, sf), ["device_id", "ip", "is_fraud"]))


MISSING_SQL = rounded_sql(
    f"""WITH {LI_SQL} SELECT 'device_id' AS column_name,
    count(*) FILTER (device_id IS NULL) / CAST(count(*) AS DOUBLE) AS missing_share FROM txns
    UNION ALL SELECT 'ip', 1.0 FROM (SELECT 1 FROM txns LIMIT 1)
    UNION ALL SELECT 'is_fraud', 0.0 FROM (SELECT 1 FROM txns LIMIT 1)""",
    ["missing_share"],
)

_ATTRIBUTES_SQL = f"""WITH {LI_SQL}, shares AS (
  SELECT 'C1' AS column_name, count(*) FILTER (attr_C1 IS NULL) / CAST(count(*) AS DOUBLE) AS missing_share FROM txns
  UNION ALL SELECT 'D1', count(*) FILTER (attr_D1 IS NULL) / CAST(count(*) AS DOUBLE) FROM txns
  UNION ALL SELECT 'M4', count(*) FILTER (attr_M4 IS NULL) / CAST(count(*) AS DOUBLE) FROM txns
  UNION ALL SELECT 'V1', count(*) FILTER (attr_V1 IS NULL) / CAST(count(*) AS DOUBLE) FROM txns)"""


def most_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.most_missing(li(spark, sf)))


MOST_MISSING_SQL = rounded_sql(
    f"""{_ATTRIBUTES_SQL} SELECT * FROM shares ORDER BY missing_share DESC, column_name LIMIT 15""",
    ["missing_share"],
)


def missing_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return eda.missing_buckets(li(spark, sf))


MISSING_BUCKETS_SQL = f"""{_ATTRIBUTES_SQL},
b AS (SELECT CASE WHEN missing_share = 0 THEN 'complete (0%)' WHEN missing_share <= 0.25 THEN 'up to 25%'
  WHEN missing_share <= 0.5 THEN '25-50%' WHEN missing_share <= 0.75 THEN '50-75%' ELSE 'over 75%' END
  AS bucket FROM shares)
SELECT e.bucket, count(b.bucket) AS n_columns
FROM (VALUES ('complete (0%)'), ('up to 25%'), ('25-50%'), ('50-75%'), ('over 75%')) e(bucket)
LEFT JOIN b ON e.bucket = b.bucket GROUP BY e.bucket"""


def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.cardinality(li(spark, sf)))


CARDINALITY_SQL = rounded_sql(
    f"""WITH {LI_SQL},
    c AS (SELECT count(*) AS n FROM txns GROUP BY card_id),
    m AS (SELECT count(*) AS n FROM txns GROUP BY merchant_id),
    d AS (SELECT count(DISTINCT card_id) AS n FROM txns WHERE device_id IS NOT NULL GROUP BY device_id)
    SELECT (SELECT count(*) FROM c) AS cards, (SELECT count(*) FROM d) AS devices,
      (SELECT count(*) FROM m) AS merchants,
      (SELECT count(device_id) / CAST(count(*) AS DOUBLE) FROM txns) AS device_coverage,
      (SELECT avg(CAST(n = 1 AS INT)) FROM c) AS single_transaction_card_share,
      (SELECT max(n) FROM m) / CAST((SELECT count(*) FROM txns) AS DOUBLE) AS largest_merchant_share,
      (SELECT avg(CAST(n > 1 AS INT)) FROM d) AS shared_device_share""",
    [
        "device_coverage",
        "single_transaction_card_share",
        "largest_merchant_share",
        "shared_device_share",
    ],
)


def transactions_per_card(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.count_distribution(eda.rows_per(li(spark, sf), "card_id")))


def cards_per_device(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.count_distribution(eda.cards_per_device(li(spark, sf))))


def _nearest_sql(counts: str) -> str:
    return rounded_sql(
        f"""WITH {LI_SQL}, c AS ({counts}),
        r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS size FROM c)
        SELECT level, CAST(n AS DOUBLE) AS value FROM r
        JOIN (VALUES (0.5), (0.9), (0.99), (1.0)) q(level)
          ON k = CAST(floor(CAST(level AS DOUBLE) * (size - 1) + 0.5) AS BIGINT)""",
        ["level", "value"],
    )


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.category_table(li(spark, sf)))


CATEGORIES_SQL = rounded_sql(
    f"""WITH {LI_SQL} SELECT merchant_category, count(*) AS transactions,
    count(*) FILTER (is_fraud) AS frauds,
    count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share,
    count(*) FILTER (is_fraud) / CAST(count(*) AS DOUBLE) AS fraud_rate
    FROM txns GROUP BY merchant_category ORDER BY transactions DESC, merchant_category LIMIT 15""",
    ["share", "fraud_rate"],
)


def daily_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        eda.daily_volume(li(spark, sf)).withColumn("day", F.unix_date("day").cast("bigint"))
    )


def hourly_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.hourly_volume(li(spark, sf)).withColumn("hour", F.col("hour").cast("bigint")))


def split_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.split_volume(assign_splits(li(spark, sf), DEFAULT_SPLITS)))


def _volume_sql(key: str, name: str) -> str:
    return rounded_sql(
        f"""WITH {LI_SQL}, {SPLIT_SQL} SELECT {key} AS {name}, count(*) AS transactions,
        count(*) FILTER (is_fraud) AS frauds,
        count(*) FILTER (is_fraud) / CAST(count(*) AS DOUBLE) AS fraud_rate FROM placed GROUP BY 1""",
        ["fraud_rate"],
    )


def amount_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(eda.amount_histogram(li(spark, sf)))


HISTOGRAM_SQL = rounded_sql(
    f"""WITH {LI_SQL}, r AS (SELECT min(log10(amount)) AS lo, max(log10(amount)) AS hi FROM txns),
    b AS (SELECT is_fraud, least(CAST(floor((log10(amount) - lo) / ((hi - lo) / 59)) AS BIGINT), 58) AS bin
          FROM txns, r)
    SELECT is_fraud, bin, count(*) AS n,
      count(*) / CAST(sum(count(*)) OVER (PARTITION BY is_fraud) AS DOUBLE) AS share
    FROM b GROUP BY is_fraud, bin""",
    ["share"],
)

# ---------------------------------------------------------------- rules

RULE_LEVELS = RuleLevels()


def rule_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    frame = rule_frame(li(spark, sf)).filter(F.col("split") == "train")
    return rounded(threshold_table(frame, RULE_LEVELS))


RULES_SQL = f"""
{LI_SQL}, {SPLIT_SQL}, {feature_ctes(False)},
frame AS (
  SELECT f.*, p.split FROM features f JOIN (SELECT txn_id, split FROM placed) p USING (txn_id)
),
legit AS (
  SELECT amount, card_txn_count_1h, row_number() OVER (ORDER BY amount) - 1 AS ka,
         row_number() OVER (ORDER BY card_txn_count_1h) - 1 AS kv, count(*) OVER () AS size
  FROM frame WHERE split = 'train' AND NOT is_fraud
),
thresholds AS (
  SELECT 'high_amount' AS threshold, amount AS value FROM legit
    WHERE ka = CAST(ceil(CAST(0.99 AS DOUBLE) * (size - 1)) AS BIGINT)
  UNION ALL SELECT 'new_device_amount', amount FROM legit
    WHERE ka = CAST(ceil(CAST(0.9 AS DOUBLE) * (size - 1)) AS BIGINT)
  UNION ALL SELECT 'no_history_amount', amount FROM legit
    WHERE ka = CAST(ceil(CAST(0.95 AS DOUBLE) * (size - 1)) AS BIGINT)
  UNION ALL SELECT 'velocity_1h', card_txn_count_1h FROM legit
    WHERE kv = CAST(ceil(CAST(0.995 AS DOUBLE) * (size - 1)) AS BIGINT)
),
t AS (
  SELECT max(value) FILTER (threshold = 'high_amount') AS high,
         max(value) FILTER (threshold = 'velocity_1h') AS fast,
         max(value) FILTER (threshold = 'new_device_amount') AS fresh,
         max(value) FILTER (threshold = 'no_history_amount') AS lone FROM thresholds
),
flagged AS (
  SELECT frame.*,
    coalesce(amount > high, false) AS rule_high_amount,
    coalesce(card_txn_count_1h > fast, false) AS rule_velocity_1h,
    coalesce(NOT card_device_seen_before AND amount > fresh, false) AS rule_new_device_high_amount,
    coalesce(card_txn_count_7d >= 3 AND amount > 5.0 * (card_amount_sum_7d / nullif(card_txn_count_7d, 0)), false)
      AS rule_amount_spike,
    coalesce(card_txn_count_7d = 0 AND amount > lone, false) AS rule_no_history_high_amount
  FROM frame, t
),
ruled AS (
  SELECT *, CAST(CAST(rule_high_amount AS INT) + CAST(rule_velocity_1h AS INT)
    + CAST(rule_new_device_high_amount AS INT) + CAST(rule_amount_spike AS INT)
    + CAST(rule_no_history_high_amount AS INT) AS TINYINT) AS rules_fired FROM flagged
)"""


def rule_flags(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = score_rules(li(spark, sf))
    return scored.select("txn_id", *[f"rule_{r}" for r in RULE_NAMES], "rules_fired", "action")


RULE_FLAGS_SQL = f"""WITH {RULES_SQL} SELECT txn_id, {', '.join(f'rule_{r}' for r in RULE_NAMES)},
rules_fired, CASE WHEN rules_fired > 0 THEN 'block' ELSE 'approve' END AS action FROM ruled"""


def report_sql(
    source: str, by: str, *, catch: str = "0.9", margin: str = "0.1", fixed: str = "2.0", case: str = "5.0"
) -> str:
    """The decision report over (action, is_fraud, mu) rows, grouped by one column; costs as expressions."""
    money = "CAST(coalesce(sum(mu) FILTER ({c}), 0) AS BIGINT) / 1000.0"

    def m(condition: str) -> str:
        return money.format(c=condition)

    def n(condition: str) -> str:
        return f"count(*) FILTER ({condition})"

    def share(a: str, b: str) -> str:
        return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"

    review_fraud, approve_fraud = "action = 'review' AND is_fraud", "action = 'approve' AND is_fraud"
    value, bf = m("is_fraud"), m("action = 'block' AND is_fraud")
    caught = f"({bf} + {catch} * ({m(review_fraud)}))"
    missed = f"({m(approve_fraud)} + (1.0::DOUBLE - {catch}::DOUBLE) * ({m(review_fraud)}))"
    wrong = "action = 'block' AND NOT is_fraud"
    declines = f"({margin} * ({m(wrong)}) + {fixed} * {n(wrong)})"
    reviews = f"({case} * " + n("action = 'review'") + ")"
    stepped = "action IN ('block', 'review')"
    return f"""SELECT {by}, count(*) AS n_transactions, {n('is_fraud')} AS n_fraud,
      {share(n("action = 'block'"), 'count(*)')} AS block_rate,
      {share(n("action = 'review'"), 'count(*)')} AS review_rate,
      {share(n(stepped + ' AND is_fraud'), n(stepped))} AS intervention_precision,
      {share(n(stepped + ' AND is_fraud'), n('is_fraud'))} AS fraud_recall,
      {value} AS fraud_value_total, {caught} AS fraud_value_caught,
      {share(caught, value)} AS fraud_value_caught_rate,
      {share(n(wrong), n('NOT is_fraud'))} AS false_decline_rate,
      {missed} AS loss_missed_fraud, {declines} AS loss_false_declines,
      {reviews} AS loss_review_cost, {missed} + {declines} + {reviews} AS loss_total
    FROM {source} GROUP BY {by}"""


REPORT_DOUBLES = [
    "block_rate",
    "review_rate",
    "intervention_precision",
    "fraud_recall",
    "fraud_value_total",
    "fraud_value_caught",
    "fraud_value_caught_rate",
    "false_decline_rate",
    "loss_missed_fraud",
    "loss_false_declines",
    "loss_review_cost",
    "loss_total",
]
REPORT_DIGITS = 4


def ranking_sql(source: str, by: str, score: str) -> str:
    """Average precision and ROC-AUC from one row per distinct score."""
    return f"""SELECT {by},
      CASE WHEN max(p) > 0 AND max(p) < max(total)
           THEN sum(pos * (CAST(tp AS DOUBLE) / seen)) / max(p) END AS pr_auc,
      CASE WHEN max(p) > 0 AND max(p) < max(total)
           THEN CAST(sum((n - pos) * (2 * (tp - pos) + pos)) AS DOUBLE)
                / (2.0 * max(p) * (max(total) - max(p))) END AS roc_auc,
      max(p) / CAST(max(total) AS DOUBLE) AS positive_rate
    FROM (SELECT {by}, score, n, pos,
            CAST(sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS BIGINT) AS tp,
            CAST(sum(n) OVER (PARTITION BY {by} ORDER BY score DESC) AS BIGINT) AS seen,
            CAST(sum(pos) OVER (PARTITION BY {by}) AS BIGINT) AS p,
            CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS total
          FROM (SELECT {by}, {score} AS score, count(*) AS n, count(*) FILTER (is_fraud) AS pos
                FROM {source} GROUP BY ALL)) GROUP BY {by}"""


def rules_report_by_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run_rules_baseline(li(spark, sf)).windows, REPORT_DIGITS)


WINDOW_REPORT_SQL = rounded_sql(
    f"""WITH {RULES_SQL},
    acted AS (SELECT *, CASE WHEN rules_fired > 0 THEN 'block' ELSE 'approve' END AS action FROM ruled)
    SELECT * FROM ({report_sql('acted', 'split')}) JOIN ({ranking_sql('acted', 'split', 'rules_fired')})
    USING (split)""",
    [*REPORT_DOUBLES, "pr_auc", "roc_auc", "positive_rate"],
    REPORT_DIGITS,
)


def rules_report_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(run_rules_baseline(li(spark, sf)).rules, REPORT_DIGITS)


_EACH_RULE = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, is_fraud, mu,"
    f" CASE WHEN rule_{r} THEN 'block' ELSE 'approve' END AS action FROM ruled WHERE split = 'test'"
    for r in RULE_NAMES
)
RULE_REPORT_SQL = rounded_sql(
    f"WITH {RULES_SQL}, each AS ({_EACH_RULE}) {report_sql('each', 'rule')}",
    REPORT_DOUBLES,
    REPORT_DIGITS,
)

# ---------------------------------------------------------------- metrics on stand-in scores


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_probability(assign_splits(li(spark, sf), DEFAULT_SPLITS))


def coarse(df: DataFrame) -> DataFrame:
    """Scores with many ties, so tie handling matters."""
    return df.withColumn("score", F.floor(F.col("probability") * 200) / 200)


SCORED_SQL = f"{LI_SQL}, {SPLIT_SQL}, {PROBABILITY_SQL}"


def acted(df: DataFrame) -> DataFrame:
    p = F.col("probability")
    action = F.when(p >= 0.8, F.lit("block")).when(p >= 0.4, F.lit("review")).otherwise(F.lit("approve"))
    return df.withColumn("action", action)


ACTED_SQL = f"""{SCORED_SQL},
acted AS (SELECT *, CASE WHEN probability >= 0.8 THEN 'block' WHEN probability >= 0.4 THEN 'review'
                         ELSE 'approve' END AS action FROM scored)"""


def decision_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.evaluate_decisions(acted(scored(spark, sf)), COSTS, ["split"]), REPORT_DIGITS)


def realized_loss(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        evaluation.realized_loss(acted(scored(spark, sf)), COSTS, ["merchant_category"]), REPORT_DIGITS
    )


_LOSSES = ["loss_missed_fraud", "loss_false_declines", "loss_review_cost", "loss_total"]
LOSS_SQL = rounded_sql(
    f"WITH {ACTED_SQL} SELECT merchant_category, {', '.join(_LOSSES)} FROM "
    f"({report_sql('acted', 'merchant_category')})",
    _LOSSES,
    REPORT_DIGITS,
)


def decision_input_problems(spark: SparkSession, sf: str) -> DataFrame:
    bad = acted(scored(spark, sf)).select(
        F.when(F.col("merchant_category") == "N", F.lit("hold")).otherwise(F.col("action")).alias("action"),
        (F.col("amount") - 1000.0).alias("amount"),
        F.when(F.col("device_id").isNotNull(), F.col("is_fraud")).alias("is_fraud"),
    )
    return evaluation.decision_problems(bad)


PROBLEMS_SQL = f"""WITH {LI_SQL}
SELECT 'unknown_action' AS problem, count(*) FILTER (merchant_category = 'N') AS n FROM txns
UNION ALL SELECT 'non_positive_amount', count(*) FILTER (amount - 1000.0 <= 0) FROM txns
UNION ALL SELECT 'missing_label', count(*) FILTER (device_id IS NULL) FROM txns"""


def ranking_by_window(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.ranking_metrics(scored(spark, sf), "probability", ["split"]))


def ranking_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.ranking_metrics(coarse(scored(spark, sf)), "score", ["split"]))


_RANKING = ["pr_auc", "roc_auc", "positive_rate"]
RANKING_SQL = rounded_sql(
    f"WITH {SCORED_SQL} {ranking_sql('scored', 'split', 'probability')}", _RANKING
)
RANKING_TIES_SQL = rounded_sql(
    f"WITH {SCORED_SQL} {ranking_sql('scored', 'split', 'floor(probability * 200) / 200')}", _RANKING
)


def precision_recall_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.precision_recall_points(coarse(scored(spark, sf)), "score", ["split"]))


PR_CURVE_SQL = rounded_sql(
    f"""WITH {SCORED_SQL},
    s AS (SELECT split, floor(probability * 200) / 200 AS score, count(*) AS n,
            count(*) FILTER (is_fraud) AS pos FROM scored GROUP BY ALL)
    SELECT split, score,
      CAST(sum(pos) OVER w AS DOUBLE) / sum(n) OVER w AS precision,
      CAST(sum(pos) OVER w AS DOUBLE) / nullif(sum(pos) OVER (PARTITION BY split), 0) AS recall
    FROM s WINDOW w AS (PARTITION BY split ORDER BY score DESC)""",
    ["score", "precision", "recall"],
)


def quantiles_three_ways(spark: SparkSession, sf: str) -> DataFrame:
    rows = li(spark, sf).select("merchant_category", "amount")
    out = None
    for method in ("linear", "higher", "nearest"):
        part = exact_quantiles(
            rows, "amount", (0.1, 0.5, 0.95), keys=["merchant_category"], method=method
        ).select(F.lit(method).alias("method"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


QUANTILES_SQL = rounded_sql(
    f"""WITH {LI_SQL}, o AS (
      SELECT merchant_category, amount, row_number() OVER (PARTITION BY merchant_category ORDER BY amount) - 1 AS k,
        count(*) OVER (PARTITION BY merchant_category) AS size FROM txns),
    q(level) AS (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE))
    SELECT 'linear' AS method, merchant_category, unnest([0.1, 0.5, 0.95])::DOUBLE AS level,
      unnest(quantile_cont(amount, [0.1, 0.5, 0.95])) AS value FROM txns GROUP BY merchant_category
    UNION ALL
    SELECT 'higher', merchant_category, level, amount FROM o JOIN q ON k = CAST(ceil(level * (size - 1)) AS BIGINT)
    UNION ALL
    SELECT 'nearest', merchant_category, level, amount FROM o
      JOIN q ON k = CAST(floor(level * (size - 1) + 0.5) AS BIGINT)""",
    ["level", "value"],
)


def probability_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.probability_scores(scored(spark, sf), "probability", ["split"]))


PROBABILITY_SCORES_SQL = rounded_sql(
    f"""WITH {SCORED_SQL}, c AS (SELECT *, CAST(is_fraud AS DOUBLE) AS y,
      greatest(least(probability, 1 - 1e-15), 1e-15) AS x FROM scored)
    SELECT split, avg((probability - y) * (probability - y)) AS brier,
      -avg(y * ln(x) + (1 - y) * ln(1 - x)) AS log_loss FROM c GROUP BY split""",
    ["brier", "log_loss"],
)


def equal_mass_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Tied scores, so the bins' borders fall inside ties."""
    rows = coarse(scored(spark, sf)).filter(F.col("split") == "test")
    return rounded(calibration.equal_mass_bins(rows, "score"))


BINS_SQL = f"""{SCORED_SQL},
binned AS (SELECT floor(probability * 200) / 200 AS score, CAST(is_fraud AS INT) AS y,
    ntile(15) OVER (ORDER BY floor(probability * 200) / 200, ms, txn_id) - 1 AS bin
  FROM scored WHERE split = 'test'),
bins AS (SELECT bin, avg(score) AS mean_predicted, avg(y) AS observed_rate, count(*) AS n
  FROM binned GROUP BY bin)"""
EQUAL_MASS_SQL = rounded_sql(f"WITH {BINS_SQL} SELECT * FROM bins", ["mean_predicted", "observed_rate"])


def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = coarse(scored(spark, sf)).filter(F.col("split") == "test")
    return rounded(calibration.expected_calibration_error(rows, "score"))


ECE_SQL = rounded_sql(
    f"WITH {BINS_SQL} SELECT sum(n * abs(mean_predicted - observed_rate)) / sum(n) AS ece FROM bins",
    ["ece"],
)


def log_spaced_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.log_bins(scored(spark, sf), "probability"))


_EDGES = calibration.log_edges()
_EDGE_CASE = " ".join(f"WHEN probability < {e!r} THEN {i}" for i, e in enumerate(_EDGES[1:-1]))
LOG_BINS_SQL = rounded_sql(
    f"""WITH {SCORED_SQL}, b AS (SELECT *, CAST(CASE {_EDGE_CASE} ELSE {len(_EDGES) - 2} END AS BIGINT) AS bin FROM scored)
    SELECT bin, avg(probability) AS mean_predicted, avg(CAST(is_fraud AS INT)) AS observed_rate,
      count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 50""",
    ["mean_predicted", "observed_rate"],
)


def probability_range(spark: SparkSession, sf: str) -> DataFrame:
    shifted = scored(spark, sf).withColumn("probability", F.col("probability") * 1.1 - 0.01)
    return calibration.probability_problems(shifted)


RANGE_SQL = f"""WITH {SCORED_SQL} SELECT 'probability_outside_unit_interval' AS problem,
count(*) FILTER (probability * 1.1 - 0.01 < 0 OR probability * 1.1 - 0.01 > 1) AS n FROM scored"""


def metrics_long_form(spark: SparkSession, sf: str) -> DataFrame:
    """The report as (split, metric, value), undefined values null."""
    report = evaluation.evaluate_decisions(acted(scored(spark, sf)), COSTS, ["split"])
    return rounded(evaluation.long_report(report, ["split"]), REPORT_DIGITS)


_LONG = ["n_transactions", "n_fraud", *REPORT_DOUBLES]
LONG_SQL = rounded_sql(
    f"WITH {ACTED_SQL}, r AS ({report_sql('acted', 'split')}) "
    + " UNION ALL ".join(
        f"SELECT split, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM r" for m in _LONG
    ),
    ["value"],
    REPORT_DIGITS,
)

QUERIES: dict[str, Query] = {
    "overview": overview,
    "class_balance": class_balance,
    "amount_stats": amount_stats,
    "window_stats": window_stats,
    "missing_shares": missing_shares,
    "most_missing": most_missing,
    "missing_buckets": missing_buckets,
    "cardinality": cardinality,
    "transactions_per_card": transactions_per_card,
    "cards_per_device": cards_per_device,
    "categories": categories,
    "daily_volume": daily_volume,
    "hourly_volume": hourly_volume,
    "split_volume": split_volume,
    "amount_histogram": amount_histogram,
    "rule_thresholds": rule_thresholds,
    "rule_flags": rule_flags,
    "rules_report_by_window": rules_report_by_window,
    "rules_report_by_rule": rules_report_by_rule,
    "decision_report": decision_report,
    "realized_loss": realized_loss,
    "decision_input_problems": decision_input_problems,
    "ranking_by_window": ranking_by_window,
    "ranking_with_ties": ranking_with_ties,
    "precision_recall_curve": precision_recall_curve,
    "quantiles_three_ways": quantiles_three_ways,
    "probability_scores": probability_scores,
    "equal_mass_bins": equal_mass_bins,
    "calibration_error": calibration_error,
    "log_spaced_bins": log_spaced_bins,
    "probability_range": probability_range,
    "metrics_long_form": metrics_long_form,
}
ORACLES: dict[str, str] = {
    "overview": OVERVIEW_SQL,
    "class_balance": BALANCE_SQL,
    "amount_stats": AMOUNTS_SQL,
    "window_stats": WINDOWS_SQL,
    "missing_shares": MISSING_SQL,
    "most_missing": MOST_MISSING_SQL,
    "missing_buckets": MISSING_BUCKETS_SQL,
    "cardinality": CARDINALITY_SQL,
    "transactions_per_card": _nearest_sql("SELECT count(*) AS n FROM txns GROUP BY card_id"),
    "cards_per_device": _nearest_sql(
        "SELECT count(DISTINCT card_id) AS n FROM txns WHERE device_id IS NOT NULL GROUP BY device_id"
    ),
    "categories": CATEGORIES_SQL,
    "daily_volume": _volume_sql("day", "day"),
    "hourly_volume": _volume_sql("(ms // 3600000) % 24", "hour"),
    "split_volume": _volume_sql("split", "split"),
    "amount_histogram": HISTOGRAM_SQL,
    "rule_thresholds": rounded_sql(
        f"WITH {RULES_SQL} SELECT threshold, CAST(value AS DOUBLE) AS value FROM thresholds", ["value"]
    ),
    "rule_flags": RULE_FLAGS_SQL,
    "rules_report_by_window": WINDOW_REPORT_SQL,
    "rules_report_by_rule": RULE_REPORT_SQL,
    "decision_report": rounded_sql(
        f"WITH {ACTED_SQL} {report_sql('acted', 'split')}", REPORT_DOUBLES, REPORT_DIGITS
    ),
    "realized_loss": LOSS_SQL,
    "decision_input_problems": PROBLEMS_SQL,
    "ranking_by_window": RANKING_SQL,
    "ranking_with_ties": RANKING_TIES_SQL,
    "precision_recall_curve": PR_CURVE_SQL,
    "quantiles_three_ways": QUANTILES_SQL,
    "probability_scores": PROBABILITY_SCORES_SQL,
    "equal_mass_bins": EQUAL_MASS_SQL,
    "calibration_error": ECE_SQL,
    "log_spaced_bins": LOG_BINS_SQL,
    "probability_range": RANGE_SQL,
    "metrics_long_form": LONG_SQL,
}
