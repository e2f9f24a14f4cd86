import random

import pytest
from helpers import LABELS, at, column, events
from pyspark.sql import functions as F

from tallyward.functions.columns import packed, unpacked
from tallyward.operators import features, timeline
from tallyward.operators.audit import leakage_audit, parity
from tallyward.operators.features import compute_features, feature_names, smoothed_rate
from tallyward.operators.naive import compute_naive_features
from tallyward.operators.timeline import Additive, check_windows
from tallyward.operators.prep import with_fraud_delay
from tallyward.session import materialize
from tallyward.settings import DAY_MS, WINDOWS_MS, LabelDelay, SkewPolicy

BUSY = SkewPolicy(rows_per_period=0)
WAYS = [SkewPolicy(enabled=False), BUSY]


@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_half_open_minute(spark, policy):
    out = compute_features(events(spark, [("c", s, 1) for s in (0, 30, 60, 120)]), policy=policy)
    assert column(out, "card_txn_count_1m") == [0, 1, 2, 1]


@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_ties_do_not_see_each_other(spark, policy):
    out = compute_features(events(spark, [("c", 10, 5), ("c", 10, 7), ("c", 11, 1)]), policy=policy)
    assert column(out, "card_txn_count_1h") == [0, 0, 2]
    assert column(out, "card_amount_sum_1h") == [0.0, 0.0, 12.0]


def test_money_is_exact(spark):
    out = compute_features(events(spark, [("c", 0, 0.1), ("c", 1, 0.2), ("c", 2, 9.99)]))
    assert column(out, "card_amount_sum_1h")[2] == 0.3


@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_distinct_values(spark, policy):
    rows = [("c", 0, 1, "A", "m1"), ("c", 10, 1, "B", "m2"), ("c", 20, 1, None, "m1"), ("c", 30, 1, "A", "m3")]
    out = compute_features(events(spark, rows), policy=policy)
    assert column(out, "card_distinct_merchants_1h") == [0, 1, 2, 2]
    assert column(out, "card_distinct_devices_1h") == [0, 1, 2, 2]


def test_deviation(spark):
    out = compute_features(events(spark, [("c", s, 10 * (s + 1)) for s in range(4)]))
    assert column(out, "card_amount_mean_30d") == [None, 10.0, 15.0, 20.0]
    assert column(out, "card_amount_std_30d")[1] is None
    assert column(out, "amount_to_card_mean_30d")[3] == 2.0
    flat = compute_features(events(spark, [("c", 0, 10), ("c", 1, 10), ("c", 2, 50)]))
    assert column(flat, "amount_zscore_30d")[2] is None


def test_deviation_forgets_after_thirty_days(spark):
    day = 86_400
    out = compute_features(events(spark, [("c", 0, 1000), ("c", 31 * day, 10), ("c", 31 * day + 1, 10)]))
    assert column(out, "card_amount_mean_30d")[2] == 10.0


def test_no_device_is_null(spark):
    rows = [("c1", 0, 1, "dX"), ("c2", 1, 1, "dX"), ("c3", 2, 1, "dX"), ("c1", 3, 1, None)]
    out = compute_features(events(spark, rows))
    assert column(out, "device_distinct_cards_24h") == [0, 1, 2, None]


@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_device_familiarity(spark, policy):
    rows = [("c", 0, 1, "d1"), ("c", 5, 1, "d1"), ("c", 5, 1, "d2"), ("c", 5, 1, "d2"), ("c", 9, 1, None), ("k", 10, 1, "d1")]
    out = compute_features(events(spark, rows), policy=policy)
    assert column(out, "card_device_seen_before") == [False, True, False, False, None, False]


@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_arrived_chargeback(spark, policy):
    table = events(spark, [("c", 0, 1), ("c", 100, 1), ("c", 200, 1)])
    labels = spark.createDataFrame([("t000", "c", "m1", at(0), at(150), True)], LABELS)
    out = compute_features(table, labels, policy=policy)
    assert column(out, "card_prior_fraud_labels") == [0, 0, 1]


def test_merchant_rate_refreshes_daily(spark):
    hour = 3_600
    table = events(spark, [("c", 13 * hour, 1), ("c", 24 * hour, 1)])
    labels = spark.createDataFrame(
        [("a", "x", "m1", at(0), at(12 * hour), False), ("b", "x", "m2", at(0), at(6 * hour), True)], LABELS
    )
    out = compute_features(table, labels)
    assert column(out, "merchant_known_labels") == [0, 1]
    assert column(out, "merchant_known_fraud_rate") == [None, (0 + 100 * 0.5) / 101]


def _random_rows(seed, n=60):
    rng = random.Random(seed)
    return [
        (
            rng.choice("abc"),
            rng.choice([0, 1, 30, 60, 3_600, 86_400]) * rng.randint(0, 40),
            rng.choice([0.1, 9.99, 20]),
            rng.choice(["d1", "d2", None]),
            rng.choice(["m1", "m2", "m3"]),
        )
        for _ in range(n)
    ]


def _brute(rows):
    out = []
    for card, t, _amount, device, _shop in rows:
        mine = [r for r in rows if r[0] == card and r[1] < t]
        row = {}
        for w, ms in WINDOWS_MS.items():
            inside = [r for r in mine if t - ms / 1000 <= r[1]]
            row[f"card_txn_count_{w}"] = len(inside)
            row[f"card_amount_sum_{w}"] = round(sum(r[2] for r in inside), 3)
            row[f"card_distinct_merchants_{w}"] = len({r[4] for r in inside})
            row[f"card_distinct_devices_{w}"] = len({r[3] for r in inside} - {None})
        same = [r for r in rows if device and r[3] == device and t - 86_400 <= r[1] < t]
        row["device_txn_count_24h"] = len(same) if device else None
        row["device_distinct_cards_24h"] = len({r[0] for r in same}) if device else None
        out.append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("policy", WAYS, ids=["plain", "chunked"])
def test_against_brute_force(spark, seed, policy):
    rows = _random_rows(seed)
    out = compute_features(events(spark, rows), policy=policy).orderBy("txn_id").collect()
    for got, want in zip(out, _brute(rows), strict=True):
        for name, value in want.items():
            if name in got.asDict():
                assert got[name] == value, name


def test_one_hot_entity_among_others(spark):
    """A third of all rows on one card: only that card is chunked, and nothing changes."""
    rows = [("hot", s * 7, 1 + s % 3, "d1", f"m{s % 5}") for s in range(120)]
    rows += [(f"c{s}", s, 2, "d1" if s % 3 else None, "m1") for s in range(240)]
    table = events(spark, rows)
    mixed = compute_features(table, policy=SkewPolicy(rows_per_period=100))
    plain = compute_features(table, policy=SkewPolicy(enabled=False))
    assert parity(mixed, plain).first().asDict() == {"only_left": 0, "only_right": 0}


def test_busy_keys_without_broadcast(spark):
    table = events(spark, _random_rows(3))
    shuffled = compute_features(table, policy=SkewPolicy(rows_per_period=0, max_broadcast_keys=1))
    plain = compute_features(table, policy=SkewPolicy(enabled=False))
    assert parity(shuffled, plain).first().asDict() == {"only_left": 0, "only_right": 0}


def test_honest_features_do_not_know_the_future(spark):
    table = events(spark, _random_rows(4))
    cutoff = int(at(86_400).timestamp() * 1000)
    assert {r["differing"] for r in leakage_audit(table, compute_features, cutoff).collect()} == {0}
    naive = leakage_audit(table, compute_naive_features, cutoff).collect()
    assert any(r["differing"] for r in naive)


def test_naive_counts_itself_and_later_rows(spark):
    table = events(spark, [("c", 0, 1), ("c", 30, 1)])
    assert column(compute_naive_features(table), "card_txn_count_1h") == [2, 2]
    assert column(compute_naive_features(table.filter("txn_id = 't000'")), "card_txn_count_1h") == [1]
    assert column(compute_features(table), "card_txn_count_1h")[0] == 0
    assert compute_naive_features(table, with_labels=True).columns == ["txn_id", *feature_names(with_labels=True)]


def test_guards(spark):
    with pytest.raises(ValueError, match="needs columns"):
        compute_features(events(spark, [("c", 0, 1)]).drop("merchant_id"))
    with pytest.raises(ValueError, match="strength must be positive"):
        smoothed_rate(None, None, None, None, 0)
    with pytest.raises(ValueError, match="window lengths"):
        check_windows([Additive("x", "y", 0)])
    assert DAY_MS == WINDOWS_MS["24h"]


def test_naive_sums_keep_money_below_a_cent_and_unknown_labels_count_zero(spark):
    rows = events(spark, [("c", 0, 0.125), ("c", 60, 0.125)]).withColumn("is_fraud", F.lit(None).cast("boolean"))
    out = compute_naive_features(rows, with_labels=True).first()
    assert (out["card_amount_sum_1h"], out["card_amount_mean_30d"]) == (0.25, 0.125)
    assert out["card_prior_fraud_labels"] == 0


def test_kept_columns_travel_with_the_features(spark):
    """One shuffle per entity and none by transaction: the frame's columns need no join."""
    df = events(spark, [("c", 0, 5, "d"), ("c", 1, 7, None), ("e", 2, 1, "d")])
    labels = spark.createDataFrame([], LABELS)
    out = compute_features(df, labels, policy=SkewPolicy(enabled=False), keep=["event_ts", "amount", "is_fraud"])
    assert column(out, "amount") == [5.0, 7.0, 1.0]
    assert column(out, "event_ts") == [r["event_ts"] for r in df.orderBy("txn_id").collect()]
    assert parity(out.select("txn_id", *feature_names(with_labels=True)), compute_features(df, labels)).first()[:] == (0, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(txn_id" not in plan
    wanted = ["card_txn_count_1h", "device_age_days"]
    assert compute_features(df, only=wanted).columns == ["txn_id", *wanted]


def test_naive_windows_equal_joins_of_busy_entities(spark):
    """Both ways agree, and the quiet way shuffles rows once per entity instead of joining every group."""
    rng = random.Random(5)
    rows = [
        (f"c{rng.randrange(3)}", rng.randrange(9 * 86_400), rng.randrange(1, 99), rng.choice(["d1", "d2", None]), f"m{rng.randrange(4)}")
        for _ in range(120)
    ]
    df = events(spark, rows)
    quiet = compute_naive_features(df, with_labels=True, policy=SkewPolicy(enabled=False))
    busy = compute_naive_features(df, with_labels=True, policy=BUSY)
    assert parity(quiet, busy).first()[:] == (0, 0)
    plan = quiet._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") <= 4


def test_audit_joins_the_tables_only(spark, capsys):
    """What lies after the cutoff meets nothing of the past: no join of its own takes it out."""
    table = events(spark, [("c1", 0, 5.0), ("c1", 60, 7.0), ("c1", 120, 9.0)])
    audit = leakage_audit(table, lambda e: e.select("txn_id", "amount"), 10**15)
    audit.explain()
    assert "LeftSemi" not in capsys.readouterr().out
    assert [tuple(r) for r in audit.collect()] == [("amount", 0)]


def _months(spark, seed, n=150):
    """Rows of few cards over 80 days, with ties, and labels of a third of them."""
    rng = random.Random(seed)
    rows = [
        (rng.choice("abc"), rng.randrange(80 * 24) * 3_600 + rng.choice([0, 0, 1, 1_800]), rng.choice([0.1, 9.99]),
         rng.choice(["d1", "d2", None]), rng.choice(["m1", "m2", "m3"]))
        for _ in range(n)
    ]
    rows += [(c, s + rng.choice([0, 1, 86_400]), *more) for c, s, *more in rows[: n // 3]]
    labels = [(f"t{i:03d}", c, m, at(s), at(s + rng.randrange(20 * 86_400)), i % 2 == 0) for i, (c, s, _, _, m) in enumerate(rows[::3])]
    return events(spark, rows), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("rows_per_chunk", [0, 2_000], ids=["hours", "periods"])
def test_chunks_of_either_length_equal_plain_windows(spark, rows_per_chunk):
    table, labels = _months(spark, 6)
    busy = compute_features(table, labels, policy=SkewPolicy(rows_per_period=0, rows_per_chunk=rows_per_chunk))
    plain = compute_features(table, labels, policy=SkewPolicy(enabled=False))
    assert parity(busy, plain).first()[:] == (0, 0)


def test_busy_entities_write_rows_once_per_stage(spark, monkeypatch):
    """Marks of windows are not written: the tables that are hold about one row per event and stage."""
    written = []

    def counting(df):
        out = materialize(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(features, "materialize", counting)
    monkeypatch.setattr(timeline, "materialize", counting)
    table, labels = _months(spark, 7)
    compute_features(table, labels, policy=BUSY).count()
    assert sum(written) <= 5 * table.count()


def test_many_busy_keys_are_counted_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(timeline, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    keys = timeline.busy_entities(
        features._narrow(_months(spark, 8)[0], []), ["card_id", "device_id"], "_ms", SkewPolicy(rows_per_period=0, max_broadcast_keys=1)
    )
    assert len(written) == 1
    assert {e: (k.keys.count(), k.small) for e, k in keys.items()} == {"card_id": (3, False), "device_id": (2, False)}


def test_busy_cards_total_only_what_is_wanted(spark, monkeypatch):
    made = []

    def recording(rows, entity, time, additive, distinct, *more):
        made.extend(s.name for s in (*additive, *distinct))
        return timeline.chunked(rows, entity, time, additive, distinct, *more)

    monkeypatch.setattr(features, "chunked", recording)
    table, labels = _months(spark, 9)
    wanted = ["card_prior_fraud_labels", "merchant_known_labels", "merchant_known_fraud_rate"]
    out = compute_features(table, labels, policy=BUSY, only=wanted)
    assert made == ["card_prior_fraud_labels"]
    assert parity(out, compute_features(table, labels, policy=SkewPolicy(enabled=False)).select(*out.columns)).first()[:] == (0, 0)


def test_every_feature_alone_equals_the_table(spark):
    table, labels = _months(spark, 10, n=40)
    whole = compute_features(table, labels, policy=SkewPolicy(enabled=False)).cache()
    for wanted in (["card_amount_sum_7d"], ["amount_zscore_30d"], ["card_merchant_seen_before", "device_age_days"], ["device_distinct_cards_7d"]):
        out = compute_features(table, labels, policy=BUSY, only=wanted)
        assert parity(out, whole.select("txn_id", *wanted)).first()[:] == (0, 0)


def test_delays_are_drawn_for_frauds_only(spark):
    rows = events(spark, [("c", s, 1) for s in range(4)]).withColumn("is_fraud", F.col("event_ts") < F.lit(at(2)))
    drawn = with_fraud_delay(rows, LabelDelay(), where=F.col("is_fraud"))
    every = with_fraud_delay(rows, LabelDelay())
    assert column(drawn, "delay_days") == [*column(every, "delay_days")[:2], None, None]


def test_ids_and_kept_columns_travel_packed(spark):
    """Ids of digits and dashes take half a byte each; any text, time and amount comes back as it was."""
    texts = ["", "-", "0", "00", "-1-", "123-4-567", "12a", "f", "ff", "FA", "é", "\x00", "\x000", "0\n", " 1", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("p"))
    rows = df.select("t", F.length("p").alias("n"), unpacked(F.col("p")).alias("u")).collect()
    assert [r["u"] for r in rows] == texts
    assert {r["t"]: r["n"] for r in rows}["123-4-567"] == 5
    made = events(spark, [("c1", 0.0, 5.25, "d1", "m1"), ("c1", 1.000001, 7.5, None, "m2"), ("c2", -1.5, 0.1)])
    made = made.withColumn("txn_id", F.when(F.col("card_id") == "c2", "x y").otherwise(F.regexp_replace("txn_id", "t", "8-")))
    keep = ["txn_id", "event_ts", "amount", "is_fraud", "card_id"]
    for table in (features.compute_features(made, keep=keep), compute_naive_features(made, keep=keep)):
        assert sorted(table.select(*keep).collect()) == sorted(made.select(*keep).collect())
