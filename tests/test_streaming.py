import pytest
from helpers import LABELS, at, column, events
from pyspark.sql import functions as F

from tallyward.operators.audit import parity
from tallyward.operators.features import compute_features
from tallyward.session import scratch_path
from tallyward.settings import CostModel
from tallyward.streaming.jobs import append_jsonl, decide_batches, read_batches
from tallyward.streaming.ledger import BudgetLedger, drop_folder, numbered_folders
from tallyward.streaming.state import CARD_DEVICE, FeatureState, once


def _labels(spark):
    return spark.createDataFrame(
        [("t000", "c", "m1", at(0), at(50), True), ("t001", "c", "m1", at(10), at(90_000), False)], LABELS
    )


def _table(spark):
    rows = [("c", s, 1 + s % 7, "d1" if s % 2 else "d2", f"m{s % 3}") for s in range(0, 200_000, 7_001)]
    rows += [("k", s + 5, 2, "d1", "m1") for s in range(0, 200_000, 21_000)]
    return events(spark, rows)


def test_any_order_and_redelivery_give_the_batch_table(spark):
    table, labels = _table(spark), _labels(spark)
    state = FeatureState(scratch_path(spark, "state"), trim_history=False)
    late, early = table.filter("txn_id > 't020'"), table.filter("txn_id <= 't020'")
    state.add_events(late, 0)
    state.add_events(early, 1)
    state.add_events(late, 2)  # redelivered as a new batch
    state.add_events(early, 1)  # a retried batch overwrites itself
    state.add_labels(labels, 0)
    state.add_labels(labels, 1)
    assert state.labels(spark).count() == 2
    out = state.features(table)
    want = compute_features(table, labels)
    assert parity(out, want).first().asDict() == {"only_left": 0, "only_right": 0}


def test_first_seen_survives_late_events_and_compaction(spark):
    state = FeatureState(scratch_path(spark, "state"), lifetime_days=400)
    state.add_events(events(spark, [("c", 7_200, 1, "d")]), 0)
    state.add_events(events(spark, [("c", 0, 1, "d")]).withColumn("txn_id", F.lit("old")), 1)

    def first():
        return state.first_seen(spark, CARD_DEVICE).first()["first_ms"]

    assert first() == int(at(0).timestamp() * 1000)
    state.compact_first_seen(spark, 1)
    assert first() == int(at(0).timestamp() * 1000)
    day = 86_400_000
    start = int(at(0).timestamp() * 1000)
    state.compact_first_seen(spark, 1, as_of_ms=start + 300 * day)
    assert first() == start
    state.compact_first_seen(spark, 1, as_of_ms=start + 500 * day)
    assert state.first_seen(spark, CARD_DEVICE).count() == 0


def test_scoring_between_batches_in_order_equals_batch(spark):
    table = _table(spark)
    state = FeatureState(scratch_path(spark, "state"))
    cut = at(90_000)
    parts = []
    for n, part in enumerate((table.filter(F.col("event_ts") < cut), table.filter(F.col("event_ts") >= cut))):
        state.add_events(part, n)
        parts.append(state.features(part, upto=n))
    names = [c for c in parts[0].columns if c not in ("card_prior_fraud_labels", "merchant_known_labels", "merchant_known_fraud_rate")]
    both = parts[0].unionByName(parts[1]).select(*names)
    assert parity(both, compute_features(table).select(*names)).first().asDict() == {"only_left": 0, "only_right": 0}


def test_batches_out_of_order_do_not_revise_but_never_leak(spark):
    """The negative control: late rows change nothing already scored, so totals fall short."""
    table = events(spark, [("c", s, 1) for s in (0, 30, 60)])
    state = FeatureState(scratch_path(spark, "state"))
    late, early = table.filter("txn_id = 't002'"), table.filter("txn_id <> 't002'")
    state.add_events(late, 0)
    assert column(state.features(late, upto=0), "card_txn_count_1h") == [0]
    state.add_events(early, 1)
    assert column(state.features(early, upto=1), "card_txn_count_1h") == [0, 1]


def test_streaming_budget_carries_over_and_retries_agree(spark):
    out = scratch_path(spark, "decided")
    base = events(spark, [("c", s, 5_000) for s in range(6)]).withColumn("probability", F.lit(0.3)).withColumn(
        "forced", F.lit(None).cast("string")
    )
    handle = decide_batches(out, CostModel(), threshold=0.0, reviews_per_day=3)
    handle(base.filter("txn_id < 't002'"), 0)
    handle(base.filter("txn_id >= 't001'"), 1)
    handle(base.filter("txn_id >= 't001'"), 1)
    got = column(read_batches(spark, out), "action")
    assert got[:3] == ["review"] * 3 and "review" not in got[3:]


def test_a_restarted_query_does_not_overwrite_later_batches(spark):
    out = scratch_path(spark, "decided")
    base = events(spark, [("c", s, 5_000) for s in range(3)]).withColumn("probability", F.lit(0.3)).withColumn(
        "forced", F.lit(None).cast("string")
    )
    handle = decide_batches(out, CostModel(), threshold=0.0, reviews_per_day=3)
    handle(base.limit(1), 0)
    handle(base, 1)
    with pytest.raises(ValueError, match="later than 0"):
        handle(base, 0)


def test_redelivered_rows_that_differ_have_one_survivor(spark):
    rows = events(spark, [("c", 0, 5), ("c", 0, 3)]).withColumn("txn_id", F.lit("t"))
    for n in (1, 3):
        assert [r["amount"] for r in once(rows.repartition(n)).collect()] == [3.0]


def test_messages_are_appended_as_lines(spark, tmp_path):
    sent = spark.createDataFrame([("k", '{"a": 1}')], "key string, value string")
    append_jsonl(sent, str(tmp_path / "out"))
    append_jsonl(sent, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a": 1}'] * 2


def test_ledger_reads_no_more_after_many_batches(spark):
    ledger = BudgetLedger(scratch_path(spark, "ledger"), fold_every=3)

    def spent(n):
        return spark.createDataFrame([(n % 2, n), (7, 1)], "day long, used long")

    def used(n):
        return {r["day"]: r["used"] for r in ledger.used(spark, n).collect()}

    most = 0
    for n in range(14):
        want = {d: s for d in (0, 1) if (s := sum(k for k in range(n) if k % 2 == d))} | ({7: n} if n else {})
        got = {d: v for d, v in used(n).items() if v}
        assert got == want
        most = max(most, len(ledger.pieces(spark, n)))
        ledger.commit(spent(n), n)
        ledger.commit(spent(n), n)  # a retry writes the same again
    assert most <= 1 + 3
    assert len(numbered_folders(spark, f"{ledger.root}/delta", "batch_id")) <= 6
    assert len(numbered_folders(spark, f"{ledger.root}/fold", "upto")) <= 2
    # batch 11 folded; tried once more, it still finds what it found
    assert used(11) == {0: 30, 1: 25, 7: 11}


def test_a_batch_that_stops_before_its_ledger_entry_is_decided_the_same_way_again(spark):
    out = scratch_path(spark, "decided")
    base = events(spark, [("c", s, 5_000) for s in range(8)]).withColumn("probability", F.lit(0.3)).withColumn(
        "forced", F.lit(None).cast("string")
    )
    handle = decide_batches(out, CostModel(), threshold=0.0, reviews_per_day=4, fold_every=2)
    for n in range(4):
        part = base.filter(F.col("txn_id").isin([f"t00{2 * n}", f"t00{2 * n + 1}", "t000"]))
        handle(part, n)
        before = sorted(map(tuple, read_batches(spark, out).collect()))
        drop_folder(spark, f"{out}/_budget/delta/batch_id={n}")  # lost between the decisions and the entry
        handle(part, n)
        assert sorted(map(tuple, read_batches(spark, out).collect())) == before
    got = column(read_batches(spark, out), "action")
    assert got[:4] == ["review"] * 4 and "review" not in got[4:]


def test_all_tasks_write_and_each_delivery_is_one_batch(spark, monkeypatch):
    from checks import streams
    from tallyward.streaming.jobs import publish

    wrote, batches = [], []
    monkeypatch.setattr(streams, "publish", lambda m, path: (wrote.append(m.rdd.getNumPartitions()), publish(m, path=path)))
    rows = events(spark, [("c", 86_400 * i, 5) for i in range(20)]).repartition(4)
    rows = rows.withColumns({"ip": F.lit(None).cast("string"), "currency": F.lit("USD"), "channel": F.lit("ecom")})
    streams._deliver(rows, streams._day_ranges(rows), lambda b, n: batches.append((n, b.count())), "test")
    assert wrote == [4, 4] and batches == [(0, 10), (1, 10)]
