"""Decision and ranking metrics. Money is added up in exact integer thousandths."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.columns import finite_or_null, milli_units, ratio
from tallyward.operators.ranking import running_totals, sorted_ranges
from tallyward.session import materialize, ship, small_side
from tallyward.settings import ACTIONS, APPROVE, BLOCK, REVIEW, CostModel


ship(__name__)


def money_sum(condition: Column, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(condition, milli_units(F.col(amount)))), F.lit(0)) / F.lit(1000.0)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def loss_columns(costs: CostModel) -> dict[str, Column]:
    """Realised loss by cause, as aggregates over ``action``, ``is_fraud`` and ``amount``."""
    action, fraud = F.col("action"), F.col("is_fraud")
    missed = money_sum((action == APPROVE) & fraud) + F.lit(
        1.0 - costs.review_catch_rate
    ) * money_sum((action == REVIEW) & fraud)
    wrongly_blocked = (action == BLOCK) & ~fraud
    declines = F.lit(costs.false_decline_margin_rate) * money_sum(wrongly_blocked) + F.lit(
        costs.false_decline_fixed_cost
    ) * count_where(wrongly_blocked)
    reviews = F.lit(costs.review_cost_per_case) * count_where(action == REVIEW)
    return {
        "loss_missed_fraud": missed,
        "loss_false_declines": declines,
        "loss_review_cost": reviews,
        "loss_total": missed + declines + reviews,
    }


def decision_columns(costs: CostModel) -> dict[str, Column]:
    """The decision report, as aggregates; an undefined ratio is null."""
    action, fraud = F.col("action"), F.col("is_fraud")
    n = F.count(F.lit(1))
    stepped_in = action.isin(BLOCK, REVIEW)
    value = money_sum(fraud)
    caught = money_sum((action == BLOCK) & fraud) + F.lit(costs.review_catch_rate) * money_sum(
        (action == REVIEW) & fraud
    )
    return {
        "n_transactions": n,
        "n_fraud": count_where(fraud),
        "block_rate": ratio(count_where(action == BLOCK), n),
        "review_rate": ratio(count_where(action == REVIEW), n),
        "intervention_precision": ratio(count_where(stepped_in & fraud), count_where(stepped_in)),
        "fraud_recall": ratio(count_where(stepped_in & fraud), count_where(fraud)),
        "fraud_value_total": value,
        "fraud_value_caught": caught,
        "fraud_value_caught_rate": ratio(caught, value),
        "false_decline_rate": ratio(count_where((action == BLOCK) & ~fraud), count_where(~fraud)),
        **loss_columns(costs),
    }


def evaluate_decisions(df: DataFrame, costs: CostModel, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: rates, value caught and realised loss, in one aggregation."""
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in decision_columns(costs).items()])


def realized_loss(df: DataFrame, costs: CostModel, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(name) for name, c in loss_columns(costs).items()])


def decision_problems(df: DataFrame) -> DataFrame:
    """(problem, n) of decision inputs: unknown actions, bad amounts, missing labels."""
    checks = {
        "unknown_action": ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)),
        "non_positive_amount": ~F.coalesce(F.col("amount") > 0, F.lit(False)),
        "missing_label": F.col("is_fraud").isNull(),
    }
    return problem_counts(df, checks)


def problem_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count each failed check in one pass, as (problem, n) rows."""
    counted = df.agg(*[count_where(c).alias(name) for name, c in checks.items()])
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(name).alias("problem"), F.col(name).alias("n")) for name in checks]
        )
    )
    return counted.select(pairs.alias("_p")).select("_p.problem", "_p.n")


def require_clean(problems: DataFrame, what: str) -> None:
    found = {r["problem"]: r["n"] for r in problems.filter("n > 0").collect()}
    if found:
        raise ValueError(f"{what}: {found}")


# ---------------------------------------------------------------- ranking


def score_steps(
    df: DataFrame, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per distinct score, highest first: counts at the score and above it."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    counted = df.select(
        *by,
        score,
        F.when(F.col("is_fraud"), w).otherwise(F.lit(0)).alias("pos"),
        w.alias("n"),
    )
    return running_totals(counted, score, ["pos", "n"], keys=by, descending=True)


def precision_recall_points(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(score, precision, recall) at every distinct threshold ``score >= t``."""
    steps = score_steps(df, score, by)
    totals = small_side(steps.groupBy(*by).agg(F.sum("pos").alias("_positives")))  # not from the rows again
    tp = F.col("before_pos") + F.col("pos")
    predicted = F.col("before_n") + F.col("n")
    return (
        steps.withColumn("_k", F.lit(1))
        .join(totals.withColumn("_k", F.lit(1)), [*by, "_k"])
        .select(
            *by,
            F.col(score).alias("score"),
            ratio(tp, predicted).alias("precision"),
            ratio(tp, F.col("_positives")).alias("recall"),
        )
    )


def ranking_metrics(
    df: DataFrame, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """PR-AUC (average precision), ROC-AUC with tie credit, and the positive rate, per group.

    Both areas are null when only one class is present. Everything is read off one table of distinct
    scores; nothing is sorted in one task.
    """
    return ranking_of_steps(score_steps(df, score, by, weight), by)


def ranking_of_steps(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ranking_metrics`` of ``score_steps``."""
    tp = F.col("before_pos") + F.col("pos")
    predicted = F.col("before_n") + F.col("n")
    neg = F.col("n") - F.col("pos")
    # Precision at each step weighted by the recall it adds; pairs ordered right, ties half.
    summed = steps.groupBy(*by).agg(
        F.sum(F.col("pos") * ratio(tp, predicted)).alias("_precision"),
        F.sum(neg * (F.col("before_pos") * 2 + F.col("pos"))).alias("_pairs2"),
        F.sum("pos").alias("_p"),
        F.sum("n").alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    negatives = F.col("_n") - F.col("_p")
    return summed.select(
        *by,
        F.when(both, F.col("_precision") / F.col("_p")).alias("pr_auc"),
        F.when(
            both, F.col("_pairs2") / (F.lit(2.0) * F.col("_p") * negatives)
        ).alias("roc_auc"),
        ratio(F.col("_p"), F.col("_n")).alias("positive_rate"),
    )


SCORES_PER_GROUP = 100_000
DRAW_BLOCK = 25


def _uniforms(score: np.ndarray, resample: int, label: int, seed: int) -> np.ndarray:
    """A draw in (0, 1) per score (its bits) that depends on seed, resample, score and label, and on nothing else."""
    x = score.copy()
    stem = (seed * 0x9E3779B97F4A7C15 + resample * 0xD1342543DE82EF95 + label * 0x632BE59BD9B4E019) % (1 << 64)
    for shift in (30, 27):
        x ^= np.uint64(stem)
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


#: Summed probabilities by mean, and where each cell of draws begins among them. Kept per task, in a plain table: a
#: wrapper of the standard library would be pickled by name.
POISSON_STEPS: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
DRAW_CELLS = 4_096


def _poisson_steps(mean: int) -> tuple[int, np.ndarray, np.ndarray]:
    if mean not in POISSON_STEPS:
        if len(POISSON_STEPS) >= 4096:
            POISSON_STEPS.clear()
        reach = int(12 * math.sqrt(mean) + 24)
        low = max(0, mean - reach)
        values = np.arange(low, mean + reach + 1)
        logs = values * math.log(mean) - mean - np.array([math.lgamma(v + 1) for v in values])
        steps = np.cumsum(np.exp(logs))
        ends = np.searchsorted(steps, np.arange(DRAW_CELLS + 1) / DRAW_CELLS)
        # the quantile of all draws in a cell, or -1 where a step lies inside
        cells = np.where(ends[:-1] == ends[1:], np.minimum(ends[:-1], len(steps) - 1), -1)
        POISSON_STEPS[mean] = low, steps, cells
    return POISSON_STEPS[mean]


def _poisson(mean: int, u: np.ndarray) -> np.ndarray:
    """Poisson quantiles of uniform draws, from the summed probabilities around the mean."""
    low, steps, cells = _poisson_steps(mean)
    found = cells[(u * DRAW_CELLS).astype(np.int64)]
    open_ = np.flatnonzero(found < 0)
    found[open_] = np.minimum(np.searchsorted(steps, u[open_]), len(steps) - 1)
    return low + found


def _resample_blocks(
    group: pd.DataFrame, resamples: int, seed: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first resample, positives, rows) blocks: Poisson weights of one score range, a line per resample.

    The weight of ``n`` equal rows is Poisson(n), the sum of one Poisson(1) per row. It is a quantile of
    a hash of (seed, resample, score, label): ranges and partitioning only balance the work.
    """
    score = (group["_score"].to_numpy(dtype=np.float64) + 0.0).view(np.uint64)
    pos = group["pos"].to_numpy()
    counts = (pos, group["n"].to_numpy() - pos)
    sizes = [[(int(m), np.flatnonzero(c == m)) for m in np.unique(c) if m > 0] for c in counts]
    for start in range(0, resamples, DRAW_BLOCK):
        block = range(start, min(resamples, start + DRAW_BLOCK))
        drawn = np.zeros((2, len(block), len(group)), dtype=np.int64)
        for label, by_size in enumerate(sizes):
            for mean, rows in by_size:  # drawn only where a score has rows of the label
                x = score[rows]
                for k, resample in enumerate(block):
                    drawn[label, k, rows] = _poisson(mean, _uniforms(x, resample, label, seed))
        yield start, drawn[0], drawn[0] + drawn[1]


def bootstrap_pr_auc(
    df: DataFrame, score: str, *, resamples: int, seed: int, by: Sequence[str] = (), counted: bool = False
) -> DataFrame:
    """95% percentile interval of PR-AUC over Poisson bootstrap resamples, per group.

    ``counted`` says that ``df`` has one row per group and score already, with ``pos`` and ``n`` (``score_steps``).

    Rows are first counted per distinct score, then cut into score ranges of a bounded number of
    scores. Weights are hashes drawn where a score lies: the shuffle carries scores, not resamples. One pass
    totals the ranges, a second adds each range's precision on top of the totals above it.
    Resamples with one class have no PR-AUC and drop out of the percentiles.
    """
    if resamples == 0:
        return df.groupBy(*by).agg(
            F.lit(None).cast("double").alias("pr_auc_ci_low"),
            F.lit(None).cast("double").alias("pr_auc_ci_high"),
        )
    value = F.col(score).cast("double").alias("_score")
    if counted:
        steps = df.select(*by, value, "pos", "n")
    else:
        steps = df.groupBy(*by, value).agg(count_where(F.col("is_fraud")).alias("pos"), F.count(F.lit(1)).alias("n"))
    placed = sorted_ranges(steps, *by, F.col("_score").desc())
    piece = F.floor(F.col("_row") / SCORES_PER_GROUP)
    # rises as scores fall, and holds a bounded number of them
    ranged = materialize(
        placed.withColumn("_range", F.shiftleft(F.col("_part").cast("bigint"), 32) + piece).drop("_part", "_row")
    )
    key = [*by, "_range"]
    key_types = [f"`{c}` {dict(ranged.dtypes)[c]}" for c in key]

    def totals_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_score", ascending=False)
        parts = [
            pd.DataFrame({"_b": np.arange(b, b + len(p)), "pos": p.sum(1), "n": n.sum(1)})
            for b, p, n in _resample_blocks(group, resamples, seed)
        ]
        out = pd.concat(parts, ignore_index=True)
        return out.assign(**{c: group[c].iloc[0] for c in key})[[*key, "_b", "pos", "n"]]

    totals = materialize(
        ranged.groupBy(*key).applyInPandas(
            totals_of, ", ".join([*key_types, "_b int", "pos bigint", "n bigint"])
        )
    )
    # One row per (group, resample, range): its size comes from settings, not from the table.
    above = (
        Window.partitionBy(*by, "_b")
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    base = totals.select(
        *key,
        "_b",
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("before_pos"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before_n"),
    )

    def areas_of(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_score", ascending=False)
        before = before.sort_values("_b")
        parts = []
        for b, p, n in _resample_blocks(group, resamples, seed):
            over = before.iloc[b : b + len(p)]
            area = np.zeros(len(p))
            for k, (tp0, n0) in enumerate(zip(over["before_pos"], over["before_n"], strict=True)):
                held = np.flatnonzero(p[k])  # only drawn positives add to the area, and they have rows above
                tp = p[k].cumsum()[held] + tp0
                seen = n[k].cumsum()[held] + n0
                area[k] = (p[k][held] * (tp / seen)).sum()
            parts.append(pd.DataFrame({"_b": over["_b"].to_numpy(), "area": area}))
        out = pd.concat(parts, ignore_index=True)
        return out.assign(**{c: group[c].iloc[0] for c in key})[[*key, "_b", "area"]]

    areas = (
        ranged.groupBy(*key)
        .cogroup(base.groupBy(*key))
        .applyInPandas(areas_of, ", ".join([*key_types, "_b int", "area double"]))
    )
    group_b = [*by, "_b"]
    sizes = totals.groupBy(*group_b).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    per = (
        areas.groupBy(*group_b)
        .agg(F.sum("area").alias("_area"))
        .join(sizes, group_b)
        .select(*group_b, F.when(both, F.col("_area") / F.col("_p")).alias("pr_auc"))
    )
    low, high = (F.percentile("pr_auc", F.lit(q)) for q in (0.025, 0.975))
    # At most ``resamples`` values per group reach the percentiles.
    return per.groupBy(*by).agg(low.alias("pr_auc_ci_low"), high.alias("pr_auc_ci_high"))


def long_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wide metric rows as (by..., metric, value); NaN and infinities become null."""
    metrics = [c for c in df.columns if c not in by]
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                for m in metrics
            ]
        )
    )
    return df.select(*by, pairs.alias("_m")).select(
        *by, F.col("_m.metric").alias("metric"), finite_or_null(F.col("_m.value")).alias("value")
    )


def write_report(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines. Null fields are written, so every row has the same keys."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def share_of_total(df: DataFrame, n: str, out: str) -> DataFrame:
    """A group's share of all rows; ``df`` has one row per group of a bounded number."""
    return df.withColumn(out, ratio(F.col(n), F.sum(n).over(Window.partitionBy(F.lit(0)))))
