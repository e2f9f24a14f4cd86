import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.operators import calibration as cal
from tallyward.operators import evaluation as ev
from tallyward.operators import ranking
from tallyward.operators.ranking import exact_quantiles, row_numbers, running_totals
from tallyward.operators.rules import RuleThresholds, apply_rules, fit_thresholds
from tallyward.settings import RULE_NAMES, CostModel, RuleLevels

COSTS = CostModel()


def decided(spark):
    rows = zip(
        ["block", "block", "approve", "review", "review"],
        [True, False, True, False, True],
        [100.0, 200.0, 50.0, 400.0, 1000.0],
        strict=True,
    )
    return spark.createDataFrame(list(rows), "action string, is_fraud boolean, amount double")


def test_worked_example(spark):
    row = ev.evaluate_decisions(decided(spark), COSTS).first()
    assert row["loss_missed_fraud"] == pytest.approx(150)
    assert row["loss_false_declines"] == pytest.approx(22)
    assert row["loss_review_cost"] == 10
    assert row["loss_total"] == pytest.approx(182)
    assert row["fraud_value_caught"] == pytest.approx(1000) and row["fraud_value_total"] == 1150
    assert row["intervention_precision"] == 0.5 and row["fraud_recall"] == pytest.approx(2 / 3)
    none = ev.evaluate_decisions(decided(spark).filter("not is_fraud and action = 'approve'"), COSTS)
    assert none.count() == 1 and none.first()["fraud_recall"] is None


def test_decision_inputs_are_checked(spark):
    bad = spark.createDataFrame(
        [("hold", None, 0.0)], "action string, is_fraud boolean, amount double"
    )
    with pytest.raises(ValueError, match="unknown_action.*non_positive_amount.*missing_label"):
        ev.require_clean(ev.decision_problems(bad), "rows")
    ev.require_clean(ev.decision_problems(decided(spark)), "rows")


def scores(spark, labels, values):
    rows = [(f"t{i}", i, bool(y), float(s)) for i, (y, s) in enumerate(zip(labels, values, strict=True))]
    return spark.createDataFrame(rows, "txn_id string, event_ms long, is_fraud boolean, score double")


def test_ranking_with_ties_and_one_class(spark):
    row = ev.ranking_metrics(scores(spark, [0, 0, 1, 0, 1], [0.3] * 5), "score").first()
    assert (row["pr_auc"], row["roc_auc"], row["positive_rate"]) == (0.4, 0.5, 0.4)
    row = ev.ranking_metrics(scores(spark, [0, 0], [0.1, 0.2]), "score").first()
    assert (row["pr_auc"], row["roc_auc"], row["positive_rate"]) == (None, None, 0.0)


def test_roc_auc_equals_pair_counting(spark):
    rng = random.Random(5)
    labels = [rng.random() < 0.3 for _ in range(80)]
    values = [round(rng.random(), 1) for _ in labels]
    pos = [v for v, y in zip(values, labels, strict=True) if y]
    neg = [v for v, y in zip(values, labels, strict=True) if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = ev.ranking_metrics(scores(spark, labels, values), "score").first()["roc_auc"]
    assert got == pytest.approx(want)


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    labels = rng.random(400) < 0.3
    values = np.round(labels * 0.3 + rng.random(400), 2)
    df = scores(spark, labels, values)
    first = ev.bootstrap_pr_auc(df, "score", resamples=60, seed=1).first()
    again = ev.bootstrap_pr_auc(df.repartition(3), "score", resamples=60, seed=1).first()
    point = ev.ranking_metrics(df, "score").first()["pr_auc"]
    assert first == again
    assert first[0] < point < first[1] and first[1] - first[0] < 0.25
    assert ev.bootstrap_pr_auc(df, "score", resamples=0, seed=1).first()[0] is None


def test_row_numbers_when_one_score_holds_most_rows(spark):
    rng = random.Random(1)
    rows = [(f"t{i:04d}", rng.randint(0, 50), 0.25 if i % 3 else rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "txn_id string, event_ms long, score double")
    got = [r["txn_id"] for r in row_numbers(df, "score", "event_ms", "txn_id").orderBy("rn").collect()]
    assert got == [t for t, _, _ in sorted(rows, key=lambda r: (r[2], r[1], r[0]))]


def test_quantile_methods(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.5, 2.5, 7.0, rng.random() * 9]) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for method in ("linear", "higher", "nearest"):
        got = {r["level"]: r["value"] for r in exact_quantiles(df, "v", [0.0, 0.1, 0.333, 0.9, 1.0], method=method).collect()}
        for q, value in got.items():
            want = float(np.quantile(values, q, method=method))
            assert value == pytest.approx(want), (method, q)


RULE_ROW = "amount double, is_fraud boolean, card_txn_count_1h long, card_txn_count_7d long, card_amount_sum_7d double, card_device_seen_before boolean"


def test_each_rule_fires_alone(spark):
    t = RuleThresholds(1000, 5, 500, 800, 5.0, 3)
    rows = [
        (1500.0, False, 0, 3, 3000.0, True),
        (10.0, False, 6, 3, 3000.0, True),
        (600.0, False, 0, 3, 3000.0, False),
        (100.0, False, 0, 3, 30.0, True),
        (900.0, False, 0, 0, 0.0, True),
        (10.0, False, 0, 3, 3000.0, None),
    ]
    out = apply_rules(spark.createDataFrame(rows, RULE_ROW), t).collect()
    for i, name in enumerate(RULE_NAMES):
        assert [out[i][f"rule_{r}"] for r in RULE_NAMES] == [r == name for r in RULE_NAMES]
    assert out[5]["rules_fired"] == 0 and out[5]["action"] == "approve"


def test_thresholds_ignore_fraud(spark):
    rows = [(float(i), False, i % 4, 1, 1.0, True) for i in range(1, 101)]
    fraud = [(9999.0, True, 99, 1, 1.0, True)] * 20
    with_fraud = fit_thresholds(spark.createDataFrame(rows + fraud, RULE_ROW))
    assert with_fraud == fit_thresholds(spark.createDataFrame(rows, RULE_ROW))
    assert with_fraud.high_amount == 100.0 and with_fraud.new_device_amount == 91.0
    with pytest.raises(ValueError, match="no legitimate"):
        fit_thresholds(spark.createDataFrame(fraud, RULE_ROW), RuleLevels())


def test_brier_and_log_loss(spark):
    row = cal.probability_scores(scores(spark, [1, 0, 1, 0], [0.9, 0.2, 0.6, 0.1]), "score").first()
    assert row["brier"] == pytest.approx(0.055)
    want = -(math.log(0.9) + math.log(0.8) + math.log(0.6) + math.log(0.9)) / 4
    assert row["log_loss"] == pytest.approx(want)


def test_perfect_calibration_has_no_error(spark):
    labels = [1, 1] + [0] * 8 + [1] * 8 + [0] * 2
    df = scores(spark, labels, [0.2] * 10 + [0.8] * 10)
    assert cal.expected_calibration_error(df, "score", 2).first()["ece"] == pytest.approx(0)


def test_calibrators(spark):
    rng = np.random.default_rng(7)
    raw = rng.random(4_000)
    df = scores(spark, rng.random(4_000) < raw**2, raw)
    before = cal.probability_scores(df, "score").first()["log_loss"]
    for method in ("platt", "isotonic"):
        fitted = cal.fit_calibrator(method, df, "score")
        assert cal.calibrator_from_json(cal.calibrator_to_json(fitted)) == fitted
        out = fitted.apply(df, "score", "p")
        assert out.filter("p < 0 or p > 1 or p is null").count() == 0
        assert cal.probability_scores(out, "p").first()["log_loss"] < before
        ordered = [r["p"] for r in out.orderBy("score").select("p").collect()]
        assert all(b >= a - 1e-12 for a, b in zip(ordered, ordered[1:], strict=False))
    method, losses = cal.select_calibration(df, "score", holdout_fraction=0.3)
    assert losses[method] == min(losses.values())
    with pytest.raises(ValueError, match="need fraud"):
        cal.select_calibration(df.withColumn("is_fraud", df.event_ms < 5), "score", holdout_fraction=0.3)
    with pytest.raises(ValueError, match="unknown calibration"):
        cal.fit_calibrator("magic", df, "score")


@pytest.mark.parametrize("share", [0.0, 0.31, 0.5, 0.75, 1.0])
def test_split_by_time(spark, share):
    """Only the day of the cut is put in order; null times come first and ties go by id."""
    times = [None, 5, 86_400_000, 86_400_000, 86_400_007, 90_000_000, 86_400_000 * 2, 86_400_000 * 2]
    rows = [(f"t{9 - i}", t, bool(i % 2), 0.1 * i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "txn_id string, event_ms long, is_fraud boolean, score double")
    early, late = cal.split_by_time(df, share)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    cut = round(len(rows) * share)
    assert {r["txn_id"] for r in early.collect()} == set(order[:cut])
    assert sorted(r["txn_id"] for r in late.collect()) == sorted(order[cut:])


def test_precision_recall_reads_the_rows_once(spark):
    """The positives come from the counted steps; they came from a second pass over the rows."""
    df = scores(spark, [1, 0, 1, 0], [0.9, 0.9, 0.4, 0.2])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    out = ev.precision_recall_points(df.repartition(2).mapInPandas(count, df.schema), "score")
    got = {r["score"]: (r["precision"], r["recall"]) for r in out.collect()}
    assert got == {0.9: (0.5, 0.5), 0.4: (pytest.approx(2 / 3), 1.0), 0.2: (0.5, 1.0)}
    assert seen.value == 4


def test_isotonic_interpolates_and_clips(spark):
    curve = cal.isotonic_curve(spark.createDataFrame([(0.2, 0.1), (0.6, 0.5)], "x double, y double"))
    df = scores(spark, [0] * 6, [0.0, 0.4, 0.6, 1.0, float("nan"), 0.4]).union(
        spark.createDataFrame([("none", 9, False, None)], scores(spark, [0], [0.1]).schema)
    )
    out = {r["txn_id"]: r["p"] for r in curve.apply(df, "score", "p").collect()}
    by_score = {r["txn_id"]: r["score"] for r in df.collect()}
    want = {0.0: 0.1, 0.4: 0.3, 0.6: 0.5, 1.0: 0.5}
    assert len(out) == 7
    for txn, p in out.items():
        assert p == (pytest.approx(want[by_score[txn]]) if by_score[txn] in want else None)


def pooled_by_hand(x, y):
    """Isotonic values per distinct x by the min-max formula of running means."""
    xs = np.unique(x)
    w = np.array([(x == v).sum() for v in xs], dtype=float)
    s = np.array([y[x == v].sum() for v in xs], dtype=float)
    cw, cs = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(s)])
    out = np.empty(len(xs))
    for i in range(len(xs)):
        means = (cs[i + 1 :][None, :] - cs[: i + 1][:, None]) / (cw[i + 1 :][None, :] - cw[: i + 1][:, None])
        out[i] = means.min(axis=1).max()
    return dict(zip(xs.tolist(), out.tolist(), strict=True))


@pytest.fixture
def many_ranges(spark):
    """Small tables in as many ranges as the session says: adaptive merging off."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "flat", "ties"])
def test_isotonic_equals_the_min_max_formula(spark, many_ranges, kind, monkeypatch):
    monkeypatch.setattr(cal, "FAN_IN", 3)  # several levels of merging over 40 ranges
    rng = np.random.default_rng(9)
    x = rng.permutation(400) / 400 * 1e-7
    chance = {"noise": x * 1e7, "rising": (x > 5e-8) * 1.0, "falling": 1 - x * 1e7, "flat": 0 * x + 0.3, "ties": x * 1e7}[kind]
    if kind == "ties":
        x = np.round(x, 9)
    y = rng.random(400) < chance
    df = scores(spark, y, x.tolist())
    assert df.select("score").distinct().count() == len(set(x.tolist()))
    got = cal.fit_isotonic(df, "score").apply(df, "score", "p").collect()
    want = pooled_by_hand(x, y)
    assert len(got) == 400
    assert {r["score"]: r["p"] for r in got} == pytest.approx(want, abs=1e-12)


def test_isotonic_of_many_scores_below_a_millionth(spark, many_ranges):
    rng = np.random.default_rng(10)
    n = 100_000
    x = (np.arange(n) + 1) * 1e-11  # all below 1e-6
    y = rng.random(n) < np.linspace(0, 0.6, n) ** 2
    rows = pd.DataFrame({"txn_id": np.arange(n).astype(str), "event_ms": np.arange(n), "is_fraud": y, "score": x})
    df = spark.createDataFrame(rows).repartition(5)
    fitted = cal.fit_isotonic(df, "score")
    out = fitted.apply(df, "score", "p").toPandas().sort_values("score")
    stack = []  # one pass of pooling over all rows
    for v in y:
        a, b = int(v), 1
        while stack and stack[-1][0] * b >= a * stack[-1][1]:
            a, b = a + stack[-1][0], b + stack.pop()[1]
        stack.append((a, b))
    assert np.abs(out["p"].to_numpy() - np.concatenate([[a / b] * b for a, b in stack])).max() < 1e-12
    assert fitted.knots(spark).count() > 50
    plan = fitted.apply(df, "score", "p")._jdf.queryExecution().toString()
    assert len(plan) < 100_000  # no list of knots in the plan
    tiny = cal.fit_isotonic(scores(spark, [0] * 5 + [1] * 4, [k * 1e-7 for k in range(1, 10)]), "score")
    got = tiny.apply(scores(spark, [0] * 9, [k * 1e-7 for k in range(1, 10)]), "score", "p").orderBy("score").collect()
    assert [r["p"] for r in got] == [0.0] * 5 + [1.0] * 4


def test_platt_solves_its_score_equations(spark):
    rng = np.random.default_rng(12)
    raw = np.round(rng.random(3_000), 2).clip(0.01, 0.99)
    y = rng.random(3_000) < raw**2
    fitted = cal.fit_platt(scores(spark, y, raw), "score")
    z = np.log(raw / (1 - raw))
    gap = y - 1 / (1 + np.exp(-(fitted.slope * z + fitted.intercept)))
    assert abs(gap.sum()) < 1e-8 and abs((gap * z).sum()) < 1e-8
    apart = cal.fit_platt(scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), "score")
    assert apart.slope > 5 and math.isfinite(apart.slope)
    one = cal.fit_platt(scores(spark, [1, 1], [0.3, 0.3]), "score")
    assert math.isfinite(one.slope) and math.isfinite(one.intercept)


def test_running_totals_in_many_ranges(spark, many_ranges):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), 0.5 if i % 3 else rng.randint(0, 90) / 10, rng.randint(0, 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double, m long").repartition(6)
    for descending in (False, True):
        for keys in ((), ("k",)):
            got = {
                (r["k"] if keys else None, r["v"]): (r["m"], r["before_m"])
                for r in running_totals(df, "v", ["m"], keys=keys, descending=descending).collect()
            }
            seen = {(k if keys else None, v) for k, v, _ in rows}
            assert set(got) == seen
            for k, v in seen:
                own = [r for r in rows if not keys or r[0] == k]
                before = sum(m for _, x, m in own if (x > v if descending else x < v))
                assert got[(k, v)] == (sum(m for _, x, m in own if x == v), before)


def test_row_numbers_in_many_ranges(spark, many_ranges):
    rows = [(f"t{(i * 7919) % 1000:04d}", 7 if i % 4 else i) for i in range(1000)]  # one heavy time
    df = spark.createDataFrame(rows, "txn_id string, ms long")
    numbered = row_numbers(df, "ms", "ms", "txn_id", total="all").collect()
    assert [r["txn_id"] for r in sorted(numbered, key=lambda r: r["rn"])] == [
        t for t, _ in sorted(rows, key=lambda r: (r[1], r[0]))
    ]
    assert sorted(r["rn"] for r in numbered) == list(range(1, 1001)) and {r["all"] for r in numbered} == {1000}
    parts = ranking.sorted_ranges(df, "ms", "txn_id").groupBy("_part").count().collect()
    assert len(parts) > 20 and max(r["count"] for r in parts) < 200  # the heavy time is cut along the id
    assert row_numbers(df.limit(0), "ms", "ms", "txn_id").count() == 0


def test_quantiles_in_many_ranges(spark, many_ranges):
    values = [float(i % 97) for i in range(800)]
    found = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.1, 0.5]).collect()
    assert {r["level"]: r["value"] for r in found} == {q: float(np.quantile(values, q)) for q in (0.1, 0.5)}


def test_bootstrap_does_not_depend_on_partitions_or_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    raw = np.round(rng.random(3_000), 3)
    df = scores(spark, rng.random(3_000) < raw**3, raw)

    def interval(d):
        return tuple(ev.bootstrap_pr_auc(d, "score", resamples=20, seed=7).first())

    first = interval(df.repartition(1))
    assert interval(df.repartition(7)) == pytest.approx(first, abs=1e-12)
    monkeypatch.setattr(ev, "SCORES_PER_GROUP", 40)
    assert interval(df.repartition(40)) == pytest.approx(first, abs=1e-12)
    assert tuple(ev.bootstrap_pr_auc(df, "score", resamples=20, seed=8).first()) != first


def test_poisson_weights_have_their_mean():
    u = (np.arange(20_000) + 0.5) / 20_000
    for mean in (1, 3, 40, 5_000):
        drawn = ev._poisson(mean, u)
        assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(mean, rel=0.05)


def test_money_below_a_cent_is_kept(spark):
    rows = [(0.125, True, "approve"), (117.123, True, "approve"), (0.125, False, "approve")]
    df = spark.createDataFrame(rows, "amount double, is_fraud boolean, action string")
    report = df.agg(ev.money_sum(F.col("is_fraud")).alias("lost"), *[c.alias(n) for n, c in ev.loss_columns(CostModel()).items()])
    assert report.first()["lost"] == 117.248 and report.first()["loss_missed_fraud"] == 117.248


def test_report_rows_are_json_lines_with_all_keys(spark, tmp_path):
    df = spark.createDataFrame([("test", 1.5, None)], "split string, a double, b double")
    ev.write_report(ev.long_report(df, ["split"]), str(tmp_path / "report"))
    lines = [json.loads(x) for f in (tmp_path / "report").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["metric"]) == [
        {"split": "test", "metric": "a", "value": 1.5},
        {"split": "test", "metric": "b", "value": None},
    ]


def test_bootstrap_draws_only_where_rows_are(monkeypatch):
    """One draw per score, label that it has, and resample; as many draws as scores for both labels before."""
    drawn = []
    draw = ev._uniforms
    monkeypatch.setattr(ev, "_uniforms", lambda x, *a: drawn.append(len(x)) or draw(x, *a))
    group = pd.DataFrame({"_score": [0.9, 0.5, 0.1], "pos": [1, 0, 0], "n": [1, 1, 2]})
    list(ev._resample_blocks(group, 4, 7))
    assert sum(drawn) == 4 * 3
