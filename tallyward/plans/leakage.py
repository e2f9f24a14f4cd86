"""What leaky features and a shuffled split would have claimed, measured side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import event_ms, unit_uniform
from tallyward.operators.evaluation import bootstrap_pr_auc, ranking_metrics
from tallyward.operators.features import compute_features
from tallyward.operators.model import tree_scores
from tallyward.operators.naive import compute_naive_features
from tallyward.operators.prep import assign_splits, first_day, frame_columns, label_events
from tallyward.operators.ranking import row_numbers
from tallyward.plans.training import fit_on_frame, split_rows
from tallyward.session import materialize
from tallyward.settings import DEFAULT_SPLITS, LabelDelay, ModelSettings, SplitLayout


@dataclass(frozen=True)
class Variant:
    name: str
    train_features: str
    split: str
    test_features: str


# The five compared preparations.
VARIANTS = (
    Variant("naive_random", "naive", "random", "naive"),
    Variant("naive_temporal", "naive", "temporal", "naive"),
    Variant("naive_in_production", "naive", "temporal", "point_in_time"),
    Variant("pit_random", "point_in_time", "random", "point_in_time"),
    Variant("pit_temporal", "point_in_time", "temporal", "point_in_time"),
)
HONEST = "pit_temporal"


def shuffled_split(frame: DataFrame, seed: int) -> DataFrame:
    """(txn_id, split): window labels dealt to random rows, every window keeping its size.

    A deliberate mistake, kept to measure it. Rows are ordered by a hash of their id and cut at the
    windows' cumulative sizes; the sizes are one row per window.
    """
    dealt, bounds = _dealt(frame, seed)
    label = F.lit(None).cast("string")
    for name, low, high in bounds:
        if name is not None:
            label = F.when((F.col("_rn") > low) & (F.col("_rn") <= high), F.lit(name)).otherwise(label)
    return dealt.select("txn_id", label.alias("split"))


def _draw(seed: int) -> Column:
    return unit_uniform(f"shuffle-{seed}", F.col("txn_id"))


def _dealt(frame: DataFrame, seed: int) -> tuple[DataFrame, list[tuple[str | None, int, int]]]:
    """All ids numbered in the order of their draws, and (window, first place - 1, last place) per window."""
    sizes = frame.groupBy("split").agg(F.count(F.lit(1)).alias("n")).orderBy("split").collect()
    end, bounds = 0, []
    for r in sizes:
        bounds.append((r["split"], end, end + r["n"]))
        end += r["n"]
    return row_numbers(frame.select("txn_id", _draw(seed).alias("_u")), "_u", "_u", "txn_id", out="_rn"), bounds


def dealt_label(frame: DataFrame, seed: int) -> Column:
    """``shuffled_split`` as a column of ``txn_id``, so that wide rows need no join with it.

    A window ends at one draw and id; these come back, one per window.
    """
    dealt, bounds = _dealt(frame, seed)
    last = dealt.filter(F.col("_rn").isin([high for *_, high in bounds])).collect()
    ends = {r["_rn"]: F.struct(F.lit(r["_u"]).alias("u"), F.lit(r["txn_id"]).alias("id")) for r in last}
    here, label = F.struct(_draw(seed).alias("u"), F.col("txn_id").alias("id")), F.lit(None).cast("string")
    for name, _, high in reversed(bounds):
        label = F.when(here <= ends[high], F.lit(name).cast("string")).otherwise(label)
    return label


def leakage_frames(
    events: DataFrame, layout: SplitLayout, delay: LabelDelay, settings: ModelSettings
) -> dict[tuple[str, str], DataFrame]:
    """The model frame per (split, features). Rows are written once per features, with both splits."""
    origin, keep = first_day(events), frame_columns(events)
    dealt = dealt_label(assign_splits(events.select("txn_id", "event_ts"), layout, origin), settings.seed)
    tables = {
        "point_in_time": compute_features(
            events, label_events(events, delay), label_strength=settings.label_strength, keep=keep
        ),
        "naive": compute_naive_features(events, with_labels=True, keep=keep),
    }
    frames = {}
    for mode, table in tables.items():
        placed = assign_splits(table, layout, origin)
        written = materialize(placed.withColumns({"event_ms": event_ms(), "_dealt": dealt}))
        frames["temporal", mode] = written.drop("_dealt")
        frames["random", mode] = written.drop("split").withColumnRenamed("_dealt", "split")
    return frames


def run_leakage_experiment(
    events: DataFrame,
    layout: SplitLayout = DEFAULT_SPLITS,
    *,
    delay: LabelDelay = LabelDelay(),
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """(variant, test_rows, positive_rate, pr_auc, interval, roc_auc), one row per variant."""
    frames = leakage_frames(events, layout, delay, settings)
    fitted: dict[tuple[str, str], tuple] = {}
    scored = None
    for v in VARIANTS:
        key = (v.split, v.train_features)
        if key not in fitted:
            fitted[key] = fit_on_frame(frames[key], settings)
        model, spec = fitted[key]
        test = split_rows(frames[(v.split, v.test_features)], "test")
        part = tree_scores(model, test, spec, ["txn_id", "is_fraud"], "score").select(
            F.lit(v.name).alias("variant"), "*"
        )
        scored = part if scored is None else scored.unionByName(part)
    scored = materialize(scored)
    ranking = ranking_metrics(scored, "score", ["variant"])
    interval = bootstrap_pr_auc(
        scored,
        "score",
        resamples=settings.bootstrap_resamples,
        seed=settings.seed,
        by=["variant"],
    )
    rows = scored.groupBy("variant").agg(F.count(F.lit(1)).alias("test_rows"))
    return rows.join(ranking, "variant").join(interval, "variant", "left")


def leakage_differences(results: DataFrame) -> DataFrame:
    """(difference, pr_auc): how much each mistake adds to the claimed PR-AUC."""
    pairs = (
        ("leaky_features", "naive_temporal", HONEST),
        ("shuffled_split", "pit_random", HONEST),
        ("both_mistakes", "naive_random", HONEST),
        ("offline_claim_vs_production", "naive_temporal", "naive_in_production"),
    )
    found = results.agg(
        *[
            (
                F.max(F.when(F.col("variant") == a, F.col("pr_auc")))
                - F.max(F.when(F.col("variant") == b, F.col("pr_auc")))
            ).alias(name)
            for name, a, b in pairs
        ]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("difference"), F.col(n).alias("pr_auc")) for n, _, _ in pairs])
    )
    return found.select(rows.alias("_d")).select("_d.difference", "_d.pr_auc")
