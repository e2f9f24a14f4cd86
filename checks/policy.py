"""Queries: expected-cost policy, overrides, daily budget, tuning and outcomes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import LI_SQL, PROBABILITY_SQL, SPLIT_SQL, Query, li, rounded, rounded_sql, with_probability
from checks.reports import REPORT_DIGITS, REPORT_DOUBLES, RULE_FLAGS_SQL, report_sql, scored
from tallyward.operators import policy
from tallyward.operators.prep import assign_splits
from tallyward.operators.rules import apply_rules, fit_thresholds
from tallyward.plans.rules_baseline import EVENT_COLUMNS, RULE_INPUTS, rule_frame
from tallyward.plans.sweep import cost_sensitivity as tune_under_variants
from tallyward.plans.sweep import run_policy_sweep
from tallyward.session import materialize
from tallyward.settings import DEFAULT_SPLITS, CostModel, Overrides, PolicySettings

COSTS = CostModel()
BUDGET = 5
OVERRIDES = Overrides(
    blocked_card_ids=("c_1", "c_2", "c_3"),
    blocked_device_ids=("d_7", "d_11", "d_13"),
    blocked_merchant_ids=("m_5",),
    allowed_card_ids=("c_3", "c_10", "c_11", "c_12"),
    velocity_cap_1h=2,
)


def rows(spark: SparkSession, sf: str, *, overridden: bool = True) -> DataFrame:
    """Scored transactions with overrides; the velocity input is a stand-in count.

    Written once, as scores would be: otherwise every filter on a cost would draw them again.
    """
    return _rows_of(scored(spark, sf), overridden=overridden)


def _rows_of(found: DataFrame, *, overridden: bool = True) -> DataFrame:
    base = found.withColumn("card_txn_count_1h", (F.col("event_ms") / 1000 % 4).cast("bigint"))
    overrides = OVERRIDES if overridden else Overrides(velocity_cap_1h=None)
    return materialize(policy.with_overrides(base, overrides).select(*NEEDED))


NEEDED = (
    "txn_id",
    "event_ms",
    "day",
    "split",
    "probability",
    "amount",
    "is_fraud",
    "forced",
    "override_rule",
)

ROWS_SQL = f"""{LI_SQL}, {SPLIT_SQL}, {PROBABILITY_SQL},
ruled AS (
  SELECT *, CASE WHEN card_id IN ('c_1', 'c_2', 'c_3') THEN 'blocked_card'
      WHEN device_id IN ('d_7', 'd_11', 'd_13') THEN 'blocked_device'
      WHEN merchant_id = 'm_5' THEN 'blocked_merchant'
      WHEN card_id IN ('c_3', 'c_10', 'c_11', 'c_12') THEN 'allowed_card'
      WHEN (ms // 1000) % 4 >= 2 THEN 'velocity_cap_1h' END AS override_rule FROM scored
),
priced AS (
  SELECT *, CASE WHEN override_rule = 'allowed_card' THEN 'approve'
                 WHEN override_rule IS NOT NULL THEN 'block' END AS forced,
    probability * amount AS cost_approve,
    5.0 + probability * (1.0::DOUBLE - 0.9::DOUBLE) * amount AS cost_review,
    (1.0 - probability) * (0.1::DOUBLE * amount + 2.0) AS cost_block
  FROM ruled
),
costed AS (
  SELECT *, CASE WHEN cost_block < cost_approve THEN 'block' ELSE 'approve' END AS fallback,
    least(cost_approve, cost_block) - cost_review AS review_benefit FROM priced
)"""

COST_COLUMNS = ["cost_approve", "cost_review", "cost_block", "review_benefit"]


def expected_costs(spark: SparkSession, sf: str) -> DataFrame:
    priced = policy.with_expected_costs(rows(spark, sf), COSTS)
    return rounded(priced.select("txn_id", *COST_COLUMNS, "fallback"), REPORT_DIGITS)


def override_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf).select("txn_id", "forced", "override_rule")


def override_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return policy.override_counts(rows(spark, sf))


def override_long_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A blocklist as long as the data goes through a join; every card of an even number is on it."""
    base = li(spark, sf).withColumn("card_txn_count_1h", F.lit(0))
    holders = spark.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_custkey") % 2 == 0)
    listed = holders.select(F.concat(F.lit("c_"), F.col("o_custkey").cast("string")).alias("card_id")).distinct()
    out = policy.with_overrides(base, Overrides(velocity_cap_1h=None), {"blocked_card": listed})
    return out.select("txn_id", "forced", "override_rule")


LONG_LIST_SQL = f"""WITH {LI_SQL} SELECT txn_id,
CASE WHEN CAST(substr(card_id, 3) AS BIGINT) % 2 = 0 THEN 'block' END AS forced,
CASE WHEN CAST(substr(card_id, 3) AS BIGINT) % 2 = 0 THEN 'blocked_card' END AS override_rule FROM txns"""


def daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    asked = rows(spark, sf).withColumn("wants", F.col("probability") >= 0.05)
    return policy.within_daily_budget(asked, "wants", BUDGET).select("txn_id", "granted")


DAILY_SQL = f"""WITH {ROWS_SQL} SELECT txn_id, probability >= 0.05 AND
  sum(CAST(probability >= 0.05 AS INT)) OVER (PARTITION BY day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING)
    <= {BUDGET} AS granted FROM costed"""

DECISION_COLUMNS = ["action", "wanted_review", "capped"]


def decide_expected_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = policy.decide_by_expected_loss(rows(spark, sf), COSTS, threshold=250.0, reviews_per_day=BUDGET)
    return rounded(out.select("txn_id", *DECISION_COLUMNS, "expected_cost"), REPORT_DIGITS)


def decide_probability(spark: SparkSession, sf: str) -> DataFrame:
    out = policy.decide_by_probability(
        rows(spark, sf), COSTS, review_at=0.2, block_at=0.7, reviews_per_day=BUDGET
    )
    return rounded(out.select("txn_id", *DECISION_COLUMNS, "expected_cost"), REPORT_DIGITS)


def decided_sql(wants: str, fallback: str, source: str = "costed", budget: str = str(BUDGET)) -> str:
    return f"""
asked AS (SELECT *, ({wants}) AND forced IS NULL AS wanted_review, {fallback} AS fb FROM {source}),
seated AS (
  SELECT *, wanted_review AND sum(CAST(wanted_review AS INT)) OVER (
    PARTITION BY day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= {budget} AS granted FROM asked
),
settled AS (
  SELECT *, coalesce(forced, CASE WHEN granted THEN 'review' ELSE fb END) AS action,
    wanted_review AND NOT granted AS capped FROM seated
),
decided AS (
  SELECT *, CASE action WHEN 'approve' THEN cost_approve WHEN 'review' THEN cost_review
                        ELSE cost_block END AS expected_cost FROM settled
)"""


_PICK = f"SELECT txn_id, {', '.join(DECISION_COLUMNS)}, expected_cost FROM decided"
LOSS_RULE = ("review_benefit > 250.0", "fallback")
PROBABILITY_RULE = (
    "probability >= 0.2 AND probability < 0.7",
    "CASE WHEN probability >= 0.7 THEN 'block' ELSE 'approve' END",
)


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    out = policy.propose(rows(spark, sf), COSTS, threshold=250.0)
    return rounded(
        out.select(
            "txn_id",
            "proposed",
            "without_review",
            F.element_at("expected_cost", F.lit("review")).alias("review_cost"),
            F.size("expected_cost").cast("bigint").alias("n_costs"),
        ),
        REPORT_DIGITS,
    )


PROPOSALS_SQL = rounded_sql(
    f"""WITH {ROWS_SQL} SELECT txn_id,
    coalesce(forced, CASE WHEN review_benefit > 250.0 THEN 'review' ELSE fallback END) AS proposed,
    coalesce(forced, fallback) AS without_review, cost_review AS review_cost, CAST(3 AS BIGINT) AS n_costs
    FROM costed""",
    ["review_cost"],
    REPORT_DIGITS,
)

# ---------------------------------------------------------------- tuning

CANDIDATES, LEVELS = 200, 30
BUDGETS = (0, 5, 10, 20, 50, 100, 200, 500)


def _tuning_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The window that thresholds are tuned on."""
    return rows(spark, sf).filter(F.col("split") == "calibration")


def threshold_losses(spark: SparkSession, sf: str) -> DataFrame:
    priced = materialize(policy.with_expected_costs(_tuning_rows(spark, sf), COSTS))
    grid = policy.benefit_grid(priced, CANDIDATES)
    return rounded(policy.threshold_losses(priced, grid, BUDGETS), 3)


_LEVEL_LIST = ", ".join(repr(i / (CANDIDATES - 1)) for i in range(CANDIDATES))
_BUDGET_VALUES = ", ".join(f"({b})" for b in BUDGETS)
THRESHOLDS_SQL = rounded_sql(
    f"""WITH {ROWS_SQL},
    tune AS (SELECT * FROM costed WHERE split = 'calibration'),
    grid AS (SELECT DISTINCT threshold FROM (
      SELECT 0.0::DOUBLE AS threshold UNION ALL
      SELECT unnest(quantile_cont(review_benefit, [{_LEVEL_LIST}])) FROM tune
      WHERE forced IS NULL AND review_benefit > 0)),
    tried AS (
      SELECT budget, threshold, t.*, forced IS NULL AND review_benefit > threshold AS wants
      FROM tune t, grid, (VALUES {_BUDGET_VALUES}) b(budget)),
    ranked AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY budget, threshold, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= budget AS granted
      FROM tried)
    SELECT budget, threshold, sum(CASE WHEN granted THEN cost_review
      WHEN coalesce(forced, fallback) = 'approve' THEN cost_approve ELSE cost_block END) AS expected_loss
    FROM ranked GROUP BY budget, threshold""",
    ["threshold", "expected_loss"],
    3,
)


def probability_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Every ordered pair of thresholds; "never" is written as 2."""
    tune = materialize(_tuning_rows(spark, sf))
    grid = policy.probability_grid(tune, LEVELS)
    out = policy.probability_losses(tune, COSTS, grid, BUDGETS)
    return rounded(
        out.select(
            "budget",
            F.least("review_at", F.lit(2.0)).alias("review_at"),
            F.least("block_at", F.lit(2.0)).alias("block_at"),
            "expected_loss",
        ),
        3,
    )


_SHARES = ", ".join(repr(1.0 - 0.5 * (1e-5 / 0.5) ** (i / (LEVELS - 1))) for i in range(LEVELS))
PAIRS_SQL = rounded_sql(
    f"""WITH {ROWS_SQL},
    tune AS (SELECT * FROM costed WHERE split = 'calibration'),
    grid AS (SELECT DISTINCT v FROM (
      SELECT unnest(quantile_cont(probability, [{_SHARES}])) AS v FROM tune UNION ALL SELECT 2.0)),
    pairs AS (SELECT a.v AS review_at, b.v AS block_at FROM grid a JOIN grid b ON a.v <= b.v),
    tried AS (
      SELECT budget, review_at, block_at, t.*,
        forced IS NULL AND probability >= review_at AND probability < block_at AS wants
      FROM tune t, pairs, (VALUES {_BUDGET_VALUES}) b(budget)),
    ranked AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY budget, review_at, block_at, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= budget
      AS granted FROM tried)
    SELECT budget, review_at, block_at, sum(CASE WHEN granted THEN cost_review
      WHEN coalesce(forced, CASE WHEN probability >= block_at THEN 'block' ELSE 'approve' END) = 'approve'
      THEN cost_approve ELSE cost_block END) AS expected_loss
    FROM ranked GROUP BY budget, review_at, block_at""",
    ["review_at", "block_at", "expected_loss"],
    3,
)

# ---------------------------------------------------------------- outcomes


def policy_outcome(spark: SparkSession, sf: str) -> DataFrame:
    decided = policy.decide_by_expected_loss(
        rows(spark, sf), COSTS, threshold=250.0, reviews_per_day=BUDGET
    )
    return rounded(policy.policy_outcome(decided, COSTS, ["split"]), 3)


OUTCOME_SQL = rounded_sql(
    f"""WITH {ROWS_SQL}, {decided_sql(*LOSS_RULE)},
    days AS (SELECT split, day, count(*) FILTER (action = 'review') AS r FROM decided GROUP BY ALL),
    per AS (SELECT split, CAST(sum(r) AS DOUBLE) / count(*) AS reviews_per_day_mean,
              max(r) AS reviews_per_day_max FROM days GROUP BY split),
    extra AS (SELECT split, sum(expected_cost) AS expected_cost, count(*) FILTER (capped) AS capped,
                count(*) FILTER (forced IS NOT NULL) AS overridden FROM decided GROUP BY split)
    SELECT * FROM ({report_sql('decided', 'split')}) JOIN per USING (split) JOIN extra USING (split)""",
    [*REPORT_DOUBLES, "reviews_per_day_mean", "expected_cost"],
    3,
)


def window_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(policy.window_summary(rows(spark, sf), ["split"]))


SUMMARY_SQL = rounded_sql(
    f"""WITH {ROWS_SQL} SELECT split, count(*) AS n_rows, count(DISTINCT day) AS n_days,
    count(*) FILTER (is_fraud) / CAST(count(*) AS DOUBLE) AS fraud_rate,
    CAST(coalesce(sum(mu) FILTER (is_fraud), 0) AS BIGINT) / 1000.0 AS fraud_value,
    count(*) FILTER (forced IS NOT NULL) AS overridden FROM costed GROUP BY split""",
    ["fraud_rate", "fraud_value"],
)


def cost_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected cost of the decisions under every cost variant, at one threshold."""
    base = rows(spark, sf)
    parts = []
    for name, variant in policy.cost_variants(COSTS):
        decided = policy.decide_by_expected_loss(
            base, variant, threshold=250.0, reviews_per_day=BUDGET
        )
        parts.append(
            decided.groupBy(F.lit(name).alias("variant")).agg(
                F.sum("expected_cost").alias("expected_cost"),
                F.count_if(F.col("action") == "review").alias("reviews"),
                F.count_if(F.col("action") == "block").alias("blocks"),
            )
        )
    return rounded(reduce(DataFrame.unionByName, parts), 3)


_VARIANT_VALUES = ", ".join(
    f"('{name}', {c.false_decline_margin_rate!r}::DOUBLE, {c.review_cost_per_case!r}::DOUBLE,"
    f" {c.review_catch_rate!r}::DOUBLE)"
    for name, c in policy.cost_variants(COSTS)
)
SENSITIVITY_SQL = rounded_sql(
    f"""WITH {ROWS_SQL},
    varied AS (
      SELECT variant, txn_id, ms, day, forced, probability * amount AS cost_approve,
        rc + probability * (1.0 - catch) * amount AS cost_review,
        (1.0 - probability) * (margin * amount + 2.0) AS cost_block
      FROM costed, (VALUES {_VARIANT_VALUES}) v(variant, margin, rc, catch)),
    best AS (SELECT *, forced IS NULL AND least(cost_approve, cost_block) - cost_review > 250.0 AS wants,
      CASE WHEN cost_block < cost_approve THEN 'block' ELSE 'approve' END AS fb FROM varied),
    ranked AS (SELECT *, coalesce(forced, CASE WHEN wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY variant, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= {BUDGET}
      THEN 'review' ELSE fb END) AS action FROM best)
    SELECT variant, sum(CASE action WHEN 'approve' THEN cost_approve WHEN 'review' THEN cost_review
        ELSE cost_block END) AS expected_cost,
      count(*) FILTER (action = 'review') AS reviews, count(*) FILTER (action = 'block') AS blocks
    FROM ranked GROUP BY variant""",
    ["expected_cost"],
    3,
)


def policy_input_problems(spark: SparkSession, sf: str) -> DataFrame:
    bad = rows(spark, sf).select(
        (F.col("probability") * 1.2).alias("probability"),
        (F.col("amount") - 1500.0).alias("amount"),
        F.when(F.col("override_rule") == "blocked_card", F.lit("review"))
        .otherwise(F.col("forced"))
        .alias("forced"),
    )
    return policy.policy_problems(bad)


INPUT_PROBLEMS_SQL = f"""WITH {ROWS_SQL}
SELECT 'probability_outside_unit_interval' AS problem, count(*) FILTER (probability * 1.2 > 1) AS n FROM costed
UNION ALL SELECT 'non_positive_amount', count(*) FILTER (amount - 1500.0 <= 0) FROM costed
UNION ALL SELECT 'override_is_not_approve_or_block', count(*) FILTER (override_rule = 'blocked_card') FROM costed"""


def policy_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Budgets x policies, tuned on the calibration window and judged on the test window."""
    settings = PolicySettings(
        reviews_per_day=BUDGET, review_budget_sweep=BUDGETS, threshold_candidates=CANDIDATES
    )
    # Order lines meet their orders once, not for every reader; of the rules' frame only their inputs are written.
    events = materialize(li(spark, sf).select(*EVENT_COLUMNS))
    frame = materialize(rule_frame(events).select("txn_id", "amount", "is_fraud", "split", *RULE_INPUTS))
    flagged = apply_rules(frame, fit_thresholds(frame.filter(F.col("split") == "train")))
    found = with_probability(assign_splits(events, DEFAULT_SPLITS))
    fired = flagged.filter(F.col("split") == "test")
    result = run_policy_sweep(_rows_of(found), fired, costs=COSTS, policy=settings)
    return rounded(result.outcomes, 3)


def tuned_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """The operating budget tuned and judged again under every cost variant."""
    table = rows(spark, sf)
    settings = PolicySettings(reviews_per_day=BUDGET, threshold_candidates=CANDIDATES)
    tune, test = (table.filter(F.col("split") == name) for name in ("calibration", "test"))
    return rounded(tune_under_variants(tune, test, COSTS, settings), 3)


# The cheapest setting in SQL: lowest loss, and of those that tie with it the largest threshold.
_TIES = "expected_loss <= lowest + 1e-9 * greatest(1.0, abs(lowest))"
_OUTCOME_DOUBLES = [*REPORT_DOUBLES, "reviews_per_day_mean", "expected_cost"]


def outcome_sql(source: str, by: str, **costs: str) -> str:
    """``policy_outcome`` over decided rows, grouped by one column."""
    return f"""SELECT * FROM ({report_sql(source, by, **costs)})
    JOIN (SELECT {by}, CAST(sum(r) AS DOUBLE) / count(*) AS reviews_per_day_mean, max(r) AS reviews_per_day_max
      FROM (SELECT {by}, day, count(*) FILTER (action = 'review') AS r FROM {source} GROUP BY ALL) GROUP BY {by}) USING ({by})
    JOIN (SELECT {by}, sum(expected_cost) AS expected_cost, count(*) FILTER (capped) AS capped,
      count(*) FILTER (forced IS NOT NULL) AS overridden FROM {source} GROUP BY {by}) USING ({by})"""


TUNED_SQL = rounded_sql(
    f"""WITH {ROWS_SQL},
    varied AS (
      SELECT variant, margin, rc, catch, txn_id, ms, day, split, forced, is_fraud, mu,
        probability * amount AS cost_approve,
        rc + probability * (1.0 - catch) * amount AS cost_review,
        (1.0 - probability) * (margin * amount + 2.0) AS cost_block
      FROM costed, (VALUES {_VARIANT_VALUES}) v(variant, margin, rc, catch)),
    best AS (SELECT *, least(cost_approve, cost_block) - cost_review AS review_benefit,
      CASE WHEN cost_block < cost_approve THEN 'block' ELSE 'approve' END AS fallback FROM varied),
    grid AS (SELECT DISTINCT variant, threshold FROM (
      SELECT variant, 0.0::DOUBLE AS threshold FROM best UNION ALL
      SELECT variant, unnest(quantile_cont(review_benefit, [{_LEVEL_LIST}])) FROM best
      WHERE split = 'calibration' AND forced IS NULL AND review_benefit > 0 GROUP BY variant)),
    tried AS (SELECT b.*, threshold, forced IS NULL AND review_benefit > threshold AS wants
      FROM best b JOIN grid USING (variant) WHERE split = 'calibration'),
    granted AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY variant, threshold, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS fits FROM tried),
    losses AS (SELECT variant, threshold, sum(CASE WHEN fits THEN cost_review
      WHEN coalesce(forced, fallback) = 'approve' THEN cost_approve ELSE cost_block END) AS expected_loss
      FROM granted GROUP BY variant, threshold),
    picked AS (SELECT variant, max(threshold) AS review_threshold
      FROM (SELECT *, min(expected_loss) OVER (PARTITION BY variant) AS lowest FROM losses) WHERE {_TIES} GROUP BY variant),
    asked AS (SELECT b.*, forced IS NULL AND review_benefit > review_threshold AS wants
      FROM best b JOIN picked USING (variant) WHERE split = 'test'),
    seated AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY variant, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS fits FROM asked),
    settled AS (SELECT *, coalesce(forced, CASE WHEN fits THEN 'review' ELSE fallback END) AS action,
      wants AND NOT fits AS capped FROM seated),
    decided AS (SELECT *, CASE action WHEN 'approve' THEN cost_approve WHEN 'review' THEN cost_review
      ELSE cost_block END AS expected_cost FROM settled)
    SELECT * FROM ({outcome_sql('decided', 'variant', catch='any_value(catch)', margin='any_value(margin)', case='any_value(rc)')})
    JOIN picked USING (variant)""",
    [*_OUTCOME_DOUBLES, "review_threshold"],
    3,
)

SWEEP_SQL = rounded_sql(
    f"""WITH {ROWS_SQL},
    tune AS (SELECT * FROM costed WHERE split = 'calibration'),
    budgets AS (SELECT * FROM (VALUES {_BUDGET_VALUES}) b(budget)),
    grid AS (SELECT DISTINCT threshold FROM (
      SELECT 0.0::DOUBLE AS threshold UNION ALL
      SELECT unnest(quantile_cont(review_benefit, [{_LEVEL_LIST}])) FROM tune
      WHERE forced IS NULL AND review_benefit > 0)),
    t_granted AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY budget, threshold, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= budget AS fits
      FROM (SELECT budget, threshold, t.*, forced IS NULL AND review_benefit > threshold AS wants FROM tune t, grid, budgets)),
    t_losses AS (SELECT budget, threshold, sum(CASE WHEN fits THEN cost_review
      WHEN coalesce(forced, fallback) = 'approve' THEN cost_approve ELSE cost_block END) AS expected_loss
      FROM t_granted GROUP BY budget, threshold),
    t_picked AS (SELECT budget, max(threshold) AS review_threshold,
        arg_max(expected_loss, threshold) AS tuning_expected_loss
      FROM (SELECT *, min(expected_loss) OVER (PARTITION BY budget) AS lowest FROM t_losses) WHERE {_TIES} GROUP BY budget),
    values_of AS (SELECT DISTINCT v FROM (
      SELECT unnest(quantile_cont(probability, [{_SHARES}])) AS v FROM tune UNION ALL SELECT 'infinity'::DOUBLE)),
    p_granted AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY budget, review_at, block_at, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= budget AS fits
      FROM (SELECT budget, a.v AS review_at, b.v AS block_at, t.*,
          forced IS NULL AND probability >= a.v AND probability < b.v AS wants
        FROM tune t, values_of a JOIN values_of b ON a.v <= b.v, budgets)),
    p_losses AS (SELECT budget, review_at, block_at, sum(CASE WHEN fits THEN cost_review
      WHEN coalesce(forced, CASE WHEN probability >= block_at THEN 'block' ELSE 'approve' END) = 'approve'
      THEN cost_approve ELSE cost_block END) AS expected_loss FROM p_granted GROUP BY budget, review_at, block_at),
    p_picked AS (SELECT budget, max({{'block_at': block_at, 'review_at': review_at}}) AS pair,
        arg_max(expected_loss, {{'block_at': block_at, 'review_at': review_at}}) AS tuning_expected_loss
      FROM (SELECT *, min(expected_loss) OVER (PARTITION BY budget) AS lowest FROM p_losses) WHERE {_TIES} GROUP BY budget),
    settings AS (
      SELECT 'expected_loss' AS policy, CAST(budget AS BIGINT) AS reviews_per_day, review_threshold,
        CAST(NULL AS DOUBLE) AS review_at, CAST(NULL AS DOUBLE) AS block_at, tuning_expected_loss FROM t_picked
      UNION ALL SELECT 'probability_thresholds', budget, NULL, pair.review_at, pair.block_at, tuning_expected_loss FROM p_picked
      UNION ALL SELECT 'rules', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'approve_all', NULL, NULL, NULL, NULL, NULL),
    fired AS (SELECT txn_id, rules_fired FROM ({RULE_FLAGS_SQL})),
    asked AS (SELECT c.*, s.policy || '/' || coalesce(CAST(reviews_per_day AS VARCHAR), '') AS setting, reviews_per_day,
        coalesce(forced IS NULL AND CASE policy WHEN 'expected_loss' THEN review_benefit > review_threshold
          WHEN 'probability_thresholds' THEN probability >= review_at AND probability < block_at ELSE false END, false) AS wants,
        CASE policy WHEN 'expected_loss' THEN fallback
          WHEN 'probability_thresholds' THEN CASE WHEN probability >= block_at THEN 'block' ELSE 'approve' END
          WHEN 'rules' THEN CASE WHEN rules_fired > 0 THEN 'block' ELSE 'approve' END ELSE 'approve' END AS fb
      FROM costed c JOIN fired USING (txn_id), settings s WHERE split = 'test'),
    seated AS (SELECT *, wants AND sum(CAST(wants AS INT)) OVER (
      PARTITION BY setting, day ORDER BY ms, txn_id ROWS UNBOUNDED PRECEDING) <= reviews_per_day AS fits FROM asked),
    settled AS (SELECT *, coalesce(forced, CASE WHEN fits THEN 'review' ELSE fb END) AS action,
      wants AND NOT fits AS capped FROM seated),
    decided AS (SELECT *, CASE action WHEN 'approve' THEN cost_approve WHEN 'review' THEN cost_review
      ELSE cost_block END AS expected_cost FROM settled)
    SELECT s.*, o.* EXCLUDE (setting) FROM ({outcome_sql('decided', 'setting')}) o
    JOIN settings s ON s.policy || '/' || coalesce(CAST(s.reviews_per_day AS VARCHAR), '') = o.setting""",
    [*_OUTCOME_DOUBLES, "review_threshold", "review_at", "block_at", "tuning_expected_loss"],
    3,
)


def decide_many_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews and capped rows of several settings decided in one pass."""
    settings = [
        policy.Setting("expected_loss", b, review_threshold=t) for b, t in ((0, 0.0), (3, 250.0), (9, 900.0))
    ] + [
        policy.Setting("probability_thresholds", b, review_at=r, block_at=c)
        for b, r, c in ((3, 0.1, 0.5), (9, 0.2, math.inf))
    ]
    decided = policy.decide_settings(rows(spark, sf), COSTS, settings)
    return rounded(
        decided.groupBy("setting").agg(
            F.count_if(F.col("action") == "review").alias("reviews"),
            F.count_if("capped").alias("capped"),
            F.sum("expected_cost").alias("expected_cost"),
        ),
        3,
    )


_MANY = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INT) AS setting, * FROM (WITH {decided_sql(*rule, budget=str(b))}
    SELECT count(*) FILTER (action = 'review') AS reviews, count(*) FILTER (capped) AS capped,
    sum(expected_cost) AS expected_cost FROM decided)"""
    for i, (b, rule) in enumerate(
        [
            (0, ("review_benefit > 0.0", "fallback")),
            (3, ("review_benefit > 250.0", "fallback")),
            (9, ("review_benefit > 900.0", "fallback")),
            (
                3,
                (
                    "probability >= 0.1 AND probability < 0.5",
                    "CASE WHEN probability >= 0.5 THEN 'block' ELSE 'approve' END",
                ),
            ),
            (9, ("probability >= 0.2", "'approve'")),
        ]
    )
)
MANY_SQL = rounded_sql(f"WITH {ROWS_SQL} {_MANY}", ["expected_cost"], 3)

QUERIES: dict[str, Query] = {
    "decide_many_settings": decide_many_settings,
    "expected_costs": expected_costs,
    "override_rules": override_rules,
    "override_rule_counts": override_rule_counts,
    "override_long_lists": override_long_lists,
    "daily_budget": daily_budget,
    "decide_expected_loss": decide_expected_loss,
    "decide_probability": decide_probability,
    "proposals": proposals,
    "threshold_losses": threshold_losses,
    "probability_losses": probability_losses,
    "policy_outcome": policy_outcome,
    "window_summary": window_summary,
    "cost_sensitivity": cost_sensitivity,
    "policy_input_problems": policy_input_problems,
    "policy_sweep": policy_sweep,
    "tuned_sensitivity": tuned_sensitivity,
}
ORACLES: dict[str, str] = {
    "decide_many_settings": MANY_SQL,
    "expected_costs": rounded_sql(
        f"WITH {ROWS_SQL} SELECT txn_id, {', '.join(COST_COLUMNS)}, fallback FROM costed",
        COST_COLUMNS,
        REPORT_DIGITS,
    ),
    "override_rules": f"WITH {ROWS_SQL} SELECT txn_id, forced, override_rule FROM costed",
    "override_rule_counts": f"""WITH {ROWS_SQL} SELECT override_rule, count(*) AS n FROM costed
        WHERE override_rule IS NOT NULL GROUP BY override_rule""",
    "override_long_lists": LONG_LIST_SQL,
    "daily_budget": DAILY_SQL,
    "decide_expected_loss": rounded_sql(
        f"WITH {ROWS_SQL}, {decided_sql(*LOSS_RULE)} {_PICK}", ["expected_cost"], REPORT_DIGITS
    ),
    "decide_probability": rounded_sql(
        f"WITH {ROWS_SQL}, {decided_sql(*PROBABILITY_RULE)} {_PICK}", ["expected_cost"], REPORT_DIGITS
    ),
    "proposals": PROPOSALS_SQL,
    "threshold_losses": THRESHOLDS_SQL,
    "probability_losses": PAIRS_SQL,
    "policy_outcome": OUTCOME_SQL,
    "window_summary": SUMMARY_SQL,
    "cost_sensitivity": SENSITIVITY_SQL,
    "policy_input_problems": INPUT_PROBLEMS_SQL,
    "policy_sweep": SWEEP_SQL,
    "tuned_sensitivity": TUNED_SQL,
}
