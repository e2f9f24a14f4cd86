import itertools
import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyward.operators import budget
from tallyward.operators import policy as pol
from tallyward.settings import (
    CostModel,
    Overrides,
    PolicySettings,
    SettingsError,
    TunedPolicy,
    from_mapping,
    serving_policy,
)

COSTS = CostModel()
SCHEMA = "txn_id string, event_ms long, day long, probability double, amount double, forced string, is_fraud boolean"
DAY = 86_400_000


def rows(spark, data):
    """(probability, amount, day, forced) in event order."""
    return spark.createDataFrame(
        [
            (f"t{i:03d}", d * DAY + i * 1000, d, float(p), float(a), f, False)
            for i, (p, a, d, f) in enumerate(data)
        ],
        SCHEMA,
    )


def col(df, name):
    return [r[name] for r in df.orderBy("txn_id").collect()]


def test_review_band_depends_on_amount(spark):
    def actions(amount, *ps):
        df = rows(spark, [(p, amount, 0, None) for p in ps])
        return col(pol.decide_by_expected_loss(df, COSTS, threshold=0, reviews_per_day=99), "action")

    assert set(actions(20, 0.01, 0.1)) == {"approve"}
    assert "review" not in actions(20, 0.05, 0.5, 0.9)
    assert actions(5_000, 0.0005, 0.05, 0.999) == ["approve", "review", "block"]


def test_block_must_be_strictly_cheaper(spark):
    free = CostModel(false_decline_margin_rate=1.0, false_decline_fixed_cost=0.0)
    out = pol.with_expected_costs(rows(spark, [(0.5, 100, 0, None)]), free)
    assert col(out, "fallback") == ["approve"]


def test_budget_is_first_come_per_day(spark):
    wants = [True, False, True, True, True, True, False, True]
    days = [0, 0, 0, 0, 1, 1, 1, 2]
    df = rows(spark, [(0.1, 1, d, None) for d in days]).withColumn(
        "wants", F.element_at(F.lit(wants), F.substring("txn_id", 2, 3).cast("int") + 1)
    )
    got = col(pol.within_daily_budget(df, "wants", 2), "granted")
    assert got == [True, False, True, False, True, True, False, True]
    assert not any(col(pol.within_daily_budget(df, "wants", 0), "granted"))
    used = spark.createDataFrame([(0, 1), (1, 9)], "day long, used long")
    got = col(pol.within_daily_budget(df, "wants", 2, used=used), "granted")
    assert got == [True] + [False] * 6 + [True]
    with pytest.raises(ValueError, match="negative"):
        pol.within_daily_budget(df, "wants", -1)


@pytest.mark.parametrize("reviews", [1, 7, 40, 200])
def test_budget_against_brute_force(spark, reviews):
    rng = random.Random(reviews)
    data = [(f"t{rng.random()}", rng.choice([0, 5, 899_999, 900_000, 40_000_000]) + DAY * rng.randint(0, 2)) for _ in range(300)]
    df = spark.createDataFrame([(t, ms, ms // DAY, rng.random() < 0.7) for t, ms in data], "txn_id string, event_ms long, day long, wants boolean")
    seen, want = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["event_ms"], r["txn_id"])):
        seen[r["day"]] = seen.get(r["day"], 0) + r["wants"]
        want[r["txn_id"]] = r["wants"] and seen[r["day"]] <= reviews
    got = {r["txn_id"]: r["granted"] for r in pol.within_daily_budget(df, "wants", reviews).collect()}
    assert got == want


def granted_by_hand(rows, arms, used=None):
    """Per (variant, arm): number and gain of the rows that fit; per day: the ids that fit."""
    totals, ids = {}, {}
    for a in arms:
        key = (a.variant, a.arm)
        totals[key] = [0, 0.0]
        left = {}
        for variant, day, ms, txn, level, gain in sorted(rows, key=lambda r: (r[2], r[3])):
            if variant != a.variant or not a.low <= level < a.high:
                continue
            room = left.setdefault(day, a.budget - (used or {}).get(day, 0))
            left[day] = room - 1
            if room > 0:
                totals[key] = [totals[key][0] + 1, totals[key][1] + gain]
                ids.setdefault(key, set()).add(txn)
    return totals, ids


@pytest.mark.parametrize("crowd", ["spread", "minute", "millisecond", "prefixes"])
def test_radix_selection_equals_ranks(spark, monkeypatch, crowd):
    monkeypatch.setattr(budget, "CELL_ROWS", 3)
    rng = random.Random(crowd)
    data = []
    for i in range(700):
        day = rng.randint(0, 2)
        ms = {"spread": rng.randint(0, 86_399_999), "minute": 7_200_000 + rng.randint(0, 59_999)}.get(crowd, 5_000)
        txn = f"{'shared-prefix-' if i % 3 else 'z'}{'' if crowd == 'prefixes' and i % 7 else 'x'}{i * 7919 % 997:03d}"
        data.append((rng.randint(0, 1), day, day * 86_400_000 + ms, txn, rng.randint(0, 4), rng.random()))
    df = spark.createDataFrame(data, "variant int, day long, event_ms long, txn_id string, level int, gain double")
    sizes = (0, 1, 5, 40, 1_200, 5_000)
    arms = [budget.Arm(n, low, 5, b, v) for v in (0, 1) for n, (low, b) in enumerate(itertools.product((0, 2, 4), sizes))]
    arms.append(budget.Arm(99, 1, 3, 17, 1))
    for used in (None, {0: 3, 1: 100}) if crowd == "spread" else (None,):
        table = spark.createDataFrame(list(used.items()), "day long, used long") if used else None
        totals, ids = granted_by_hand(data, arms, used)
        if not used:
            got = {(r["variant"], r["arm"]): (r["granted"], r["gain"]) for r in budget.budget_gain(df, arms, 5).collect()}
            assert set(got) == {k for k, v in totals.items() if v[0]}
            for k, (n, gain) in got.items():
                assert n == totals[k][0] and gain == pytest.approx(totals[k][1])
        cuts = {(r["variant"], r["arm"], r["day"]): r for r in budget.budget_cuts(df, arms, 5, table).collect()}
        for a in arms:
            fit = set()
            for variant, day, ms, txn, level, _ in data:
                if variant == a.variant and a.low <= level < a.high:
                    cut = cuts.get((variant, a.arm, day))
                    if cut is None or ms < cut["cut_ms"] or ms == cut["cut_ms"] and (cut["cut_txn"] is None or txn <= cut["cut_txn"]):
                        fit.add(txn)
            assert fit == ids.get((a.variant, a.arm), set()), a
    assert budget.budget_gain(df.limit(0), arms, 5).count() == 0


def test_repeated_rows_at_the_cut_take_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(budget, "CELL_ROWS", 3)
    same = [(0, 10, "a", 0, 1.0)] * 40 + [(0, 10, "b", 0, 5.0)]
    df = spark.createDataFrame(same, "day long, event_ms long, txn_id string, level int, gain double")
    got = {r["arm"]: (r["granted"], r["gain"]) for r in budget.budget_gain(df, [budget.Arm(0, 0, 1, 25), budget.Arm(1, 0, 1, 41)], 1).collect()}
    assert got == {0: (25, 25.0), 1: (41, 45.0)}


def test_tuned_threshold_waits_for_the_large_payment(spark):
    df = rows(spark, [(0.3, 200, 0, None)] * 5 + [(0.3, 5_000, 0, None)])
    greedy = pol.decide_by_expected_loss(df, COSTS, threshold=0, reviews_per_day=1)
    tuned = pol.tune_review_thresholds(df, COSTS, budgets=[1], candidates=20)[1]
    chosen = pol.decide_by_expected_loss(df, COSTS, threshold=tuned.review_threshold, reviews_per_day=1)
    greedy_cost = greedy.agg(F.sum("expected_cost")).first()[0]
    cost = chosen.agg(F.sum("expected_cost")).first()[0]
    assert round(greedy_cost) == 424 and round(cost) == 232
    assert cost == pytest.approx(tuned.expected_loss)
    assert col(chosen, "action")[-1] == "review"


def test_probability_policy(spark):
    df = rows(spark, [(0.95, 50, 0, None), (0.5, 50, 0, None), (0.5, 50, 0, None), (0.1, 50, 0, None)])
    out = pol.decide_by_probability(df, COSTS, review_at=0.4, block_at=0.9, reviews_per_day=1)
    assert col(out, "action") == ["block", "review", "approve", "approve"]
    assert col(out, "capped") == [False, False, True, False]
    with pytest.raises(ValueError, match="thresholds"):
        pol.decide_by_probability(df, COSTS, review_at=0.9, block_at=0.4, reviews_per_day=1)


def _random(spark, n=120, seed=3):
    rng = random.Random(seed)
    return rows(
        spark,
        [
            (rng.random() ** 3, rng.choice([20, 300, 4_000]), i // 40, rng.choice([None] * 8 + ["block", "approve"]))
            for i in range(n)
        ],
    )


def test_losses_equal_deciding_row_by_row(spark):
    df = _random(spark)
    priced = pol.with_expected_costs(df, COSTS)
    grid = pol.benefit_grid(priced, 6)
    for r in pol.threshold_losses(priced, grid, [0, 3]).collect():
        direct = pol.decide_by_expected_loss(df, COSTS, threshold=r["threshold"], reviews_per_day=r["budget"])
        assert direct.agg(F.sum("expected_cost")).first()[0] == pytest.approx(r["expected_loss"])


def test_tuning_never_costs_more_than_approving_all(spark):
    df = _random(spark)
    free = pol.with_expected_costs(df, COSTS)
    everything = free.agg(F.sum(pol.cost_of_action(F.coalesce("forced", F.lit("approve"))))).first()[0]
    for t in pol.tune_review_thresholds(df, COSTS, budgets=[0, 5], candidates=10).values():
        assert t.expected_loss <= everything
    for t in pol.tune_probability_thresholds(df, COSTS, budgets=[0, 5], levels=5).values():
        assert t.expected_loss <= everything + 1e-9 and t.review_at <= t.block_at


def test_settings_in_one_pass_equal_one_by_one(spark):
    df = _random(spark, seed=9)
    settings = [
        pol.Setting("a", 2, review_threshold=10.0),
        pol.Setting("b", 4, review_at=0.05, block_at=math.inf),
        pol.Setting("c", 0, review_threshold=0.0),
    ]
    together = pol.decide_settings(df, COSTS, settings)
    singles = [
        pol.decide_by_expected_loss(df, COSTS, threshold=10.0, reviews_per_day=2),
        pol.decide_by_probability(df, COSTS, review_at=0.05, block_at=math.inf, reviews_per_day=4),
        pol.decide_by_expected_loss(df, COSTS, threshold=0.0, reviews_per_day=0),
    ]
    for i, one in enumerate(singles):
        part = together.filter(F.col("setting") == i)
        for name in ("action", "capped", "wanted_review"):
            assert col(part, name) == col(one, name)


def test_override_order(spark):
    o = Overrides(
        blocked_card_ids=("bad",), blocked_device_ids=("dx",), blocked_merchant_ids=("mx",),
        allowed_card_ids=("vip", "bad"), velocity_cap_1h=10,
    )
    data = [
        ("bad", "dx", "mx", 99), ("vip", "dx", "mx", 0), ("vip", None, "mx", 0), ("vip", "d", "m", 99),
        ("c", None, "m", 10), ("c", None, "m", 9), ("c", None, "m", None),
    ]
    df = spark.createDataFrame(
        [(f"t{i}", *r) for i, r in enumerate(data)],
        "txn_id string, card_id string, device_id string, merchant_id string, card_txn_count_1h long",
    )
    out = pol.with_overrides(df, o)
    assert col(out, "override_rule") == [
        "blocked_card", "blocked_device", "blocked_merchant", "allowed_card", "velocity_cap_1h", None, None,
    ]
    assert col(out, "forced") == ["block", "block", "block", "approve", "block", None, None]


def test_overridden_rows_use_no_budget(spark):
    df = rows(spark, [(0.3, 5_000, 0, "block"), (0.3, 5_000, 0, None)])
    out = pol.decide_by_expected_loss(df, COSTS, threshold=0, reviews_per_day=1)
    assert col(out, "action") == ["block", "review"] and col(out, "wanted_review") == [False, True]


def test_expected_cost_is_the_weighted_realized_loss(spark):
    from tallyward.operators.evaluation import realized_loss

    p, a = 0.3, 250.0
    for action in ("approve", "review", "block"):
        out = pol.with_expected_costs(rows(spark, [(p, a, 0, None)]), COSTS)
        want = 0.0
        for fraud, weight in ((True, p), (False, 1 - p)):
            df = spark.createDataFrame([(action, fraud, a)], "action string, is_fraud boolean, amount double")
            want += weight * realized_loss(df, COSTS).first()["loss_total"]
        assert out.first()[f"cost_{action}"] == pytest.approx(want)


def test_tuned_policy_is_refused_elsewhere():
    tuned = TunedPolicy("v1", "abc", 200, 12.5, COSTS.as_dict())
    assert TunedPolicy.from_json(tuned.to_json()) == tuned
    same = dict(model_version="v1", spec_fingerprint="abc")
    assert serving_policy(PolicySettings(), COSTS, tuned=tuned, **same).review_threshold == 12.5
    assert serving_policy(PolicySettings(), COSTS, tuned=None, **same).tuned is False
    with pytest.raises(SettingsError, match="model version, review budget, costs"):
        serving_policy(
            PolicySettings(reviews_per_day=5), CostModel(review_cost_per_case=9), tuned=tuned,
            model_version="v2", spec_fingerprint="abc",
        )
    with pytest.raises(SettingsError, match="unknown keys"):
        from_mapping(CostModel, {"colour": 1})
    with pytest.raises(SettingsError, match="catch rate"):
        CostModel(review_catch_rate=2)


def test_a_blocklist_as_long_as_the_data(spark, tmp_path):
    """Cards numbered beyond any fixed list are blocked too."""
    from checks.policy import override_long_lists

    sf = "/root/testdata/sf0.001"
    shift = 7_000_000
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_custkey", F.col("o_custkey") + shift).write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    from checks.common import li

    even = F.substring("card_id", 3, 20).cast("bigint") % 2 == 0
    want = li(spark, str(tmp_path)).filter(even).count()
    out = override_long_lists(spark, str(tmp_path))
    assert out.filter(F.col("forced") == "block").count() == want > 0


@pytest.mark.parametrize("query", ["policy_sweep", "tuned_sensitivity"])
def test_order_lines_meet_their_orders_once(spark, monkeypatch, query):
    """The sweeps read one written table; each part of them joined the orders by itself before."""
    from checks import common
    from checks import policy as queries

    made = []
    read = common.lineitem_transactions
    monkeypatch.setattr(common, "lineitem_transactions", lambda *a: made.append(a) or read(*a))
    monkeypatch.setattr(queries, "run_policy_sweep", lambda rows, fired, **_: SimpleNamespace(outcomes=rows))
    monkeypatch.setattr(queries, "tune_under_variants", lambda tune, test, *_: test)
    assert queries.QUERIES[query](spark, "/root/testdata/sf0.001").columns
    assert len(made) == 1
