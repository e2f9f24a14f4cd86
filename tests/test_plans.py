"""The jobs end to end on a small table: fit, save, score, sweep, serve, and the leakage experiment."""

import pytest
from pyspark.sql import functions as F

from checks.common import li
from tallyward.operators.calibration import expected_calibration_error
from tallyward.operators.evaluation import bootstrap_pr_auc, ranking_metrics
from tallyward.operators.model import ModelBundle
from tallyward.plans import rules_baseline, training
from tallyward.plans.leakage import leakage_frames, run_leakage_experiment, shuffled_split
from tallyward.plans.sweep import EXPECTED_LOSS, read_tuned_policy, run_policy_sweep, score_frame, tuned_policy, write_tuned_policy
from tallyward.plans.training import train_model
from tallyward.session import scratch_path
from tallyward.settings import DEFAULT_SPLITS, CostModel, LabelDelay, ModelSettings, Overrides, PolicySettings, serving_policy

SF = "/root/testdata/sf0.001"
SMALL = ModelSettings(max_iter=2, max_depth=2, bootstrap_resamples=5, calibration="platt")


@pytest.fixture(scope="module")
def trained(spark):
    return train_model(li(spark, SF), settings=SMALL)


def test_a_fitted_model_is_swept_tuned_and_served(spark, trained):
    metrics = trained.metrics.collect()
    assert len({r["scorer"] for r in metrics}) == len(metrics) >= 4
    events = li(spark, SF)
    path = scratch_path(spark, "bundle")
    trained.bundle.save(spark, path)
    bundle = ModelBundle.load(spark, path)
    scored = [score_frame(b, trained.frame, events, Overrides()) for b in (trained.bundle, bundle)]
    assert scored[0].exceptAll(scored[1]).isEmpty() and not scored[0].isEmpty()  # saved and unsaved agree
    fired = events.select("txn_id", F.lit(0).alias("rules_fired"))
    settings = PolicySettings(reviews_per_day=2, review_budget_sweep=(0, 2), threshold_candidates=6)
    result = run_policy_sweep(scored[0], fired, costs=CostModel(), policy=settings)
    outcomes = result.outcomes.collect()
    assert {r["reviews_per_day"] for r in outcomes if r["policy"] == EXPECTED_LOSS} == {0, 2}
    sensitivity = result.sensitivity().collect()
    assert [r["variant"] for r in sensitivity][0] == "as given" and len(sensitivity) == 7
    assert sensitivity[0]["review_threshold"] == result.tuned[2].review_threshold
    tuned = tuned_policy(result, bundle, "v1", CostModel(), 2)
    where = scratch_path(spark, "tuned")
    write_tuned_policy(spark, tuned, where)
    assert read_tuned_policy(spark, where) == tuned
    here = {"model_version": "v1", "spec_fingerprint": bundle.spec.fingerprint()}
    served = serving_policy(settings, CostModel(), tuned=tuned, **here)
    assert served.tuned and served.review_threshold == tuned.review_threshold
    with pytest.raises(ValueError, match="another setting: model version$"):
        serving_policy(settings, CostModel(), tuned=tuned, **here | {"model_version": "v2"})


def test_leakage_variants_are_judged_on_equal_windows(spark):
    results = run_leakage_experiment(li(spark, SF), settings=SMALL).collect()
    assert len(results) == 5 and len({r["variant"] for r in results}) == 5
    by = {r["variant"]: r for r in results}
    assert all(0 <= r["pr_auc"] <= 1 for r in results if r["pr_auc"] is not None), by


def test_training_makes_features_once(spark, monkeypatch):
    """Rules are scored on the model frame, labels of the maturity check come from it."""
    calls = []
    for module in (training, rules_baseline):
        made = module.compute_features
        monkeypatch.setattr(module, "compute_features", lambda *a, _made=made, **k: calls.append(1) or _made(*a, **k))
    result = train_model(li(spark, SF), settings=SMALL)
    assert len(calls) == 1
    rules, _ = rules_baseline.score_rules(li(spark, SF))
    want = rules.filter("split = 'test'").select("txn_id", F.col("rules_fired").cast("double"))
    got = result.scores.filter("scorer = 'rules'").select("txn_id", "score")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty() and not got.isEmpty()


def test_metrics_from_one_table_of_steps(spark):
    """Equal to the metrics of each scorer's rows, ties over the edges of bins included."""
    rows = [
        (name, f"t{i}", (i * 7919) % 100, i % 3 == 0 or (i % 7 == 0 and i > n // 2), score(i, n))
        for name, n, score in (
            ("logistic", 311, lambda i, n: ((i * 37) % n) / n),
            ("trees_raw", 200, lambda i, n: ((i * 37) % 4) / 8),
            ("trees_isotonic", 47, lambda i, n: 0.25),
            ("trees_platt", 9, lambda i, n: i / 9),
            ("rules", 60, lambda i, n: float(i % 3)),
        )
        for i in range(n)
    ]
    scores = spark.createDataFrame(rows, "scorer string, txn_id string, event_ms long, is_fraud boolean, score double")
    got = {r["scorer"]: r for r in training.scorer_metrics(scores, SMALL).collect()}
    assert set(got) == set(training.SCORERS) and got["rules"]["ece"] is None
    for name in training.PROBABILITY_SCORERS:
        one = scores.filter(F.col("scorer") == name)
        assert got[name]["ece"] == pytest.approx(expected_calibration_error(one, "score").first()["ece"]), name
    ranking = {r["scorer"]: r for r in ranking_metrics(scores, "score", ["scorer"]).collect()}
    interval = {r["scorer"]: r for r in bootstrap_pr_auc(scores, "score", resamples=5, seed=7, by=["scorer"]).collect()}
    for name in got:
        assert got[name]["pr_auc"] == ranking[name]["pr_auc"]
        assert got[name]["pr_auc_ci_low"] == interval[name]["pr_auc_ci_low"]


def test_leakage_frames_need_no_join(spark):
    """Each row is written once per features with both splits; the dealt one is that of ``shuffled_split``."""
    events = li(spark, SF)
    frames = leakage_frames(events, DEFAULT_SPLITS, LabelDelay(), SMALL)
    want = shuffled_split(frames["temporal", "naive"], SMALL.seed)
    for mode in ("point_in_time", "naive"):
        frame = frames["random", mode]
        assert "Join" not in frame._jdf.queryExecution().toString()
        got = frame.select("txn_id", "split")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        base = ["txn_id", "event_ts", "amount", "is_fraud", "attr_C1"]
        assert frame.select(base).exceptAll(events.select(base)).isEmpty() and frame.count() == events.count()
