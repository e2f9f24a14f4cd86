import json
from statistics import NormalDist

import pytest
from helpers import at, column, events
from pyspark.sql import functions as F

from tallyward.functions.columns import with_inverse_normal
from tallyward.operators import prep
from tallyward.operators.history import limit_transactions, replay_stats, timeline
from tallyward.session import scratch_path
from tallyward.settings import LabelDelay, SettingsError, SplitLayout, SplitWindow, split_layout
from tallyward.sources import contracts
from tallyward.sources.tables import CANONICAL_SCHEMA, read_events, read_raw_csv, write_events


def test_inverse_normal(spark):
    points = [1e-12, 1e-6, 0.01, 0.074, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-9]
    df = with_inverse_normal(spark.createDataFrame([(p,) for p in points], "p double"), "p", "z")
    for p, z in df.select("p", "z").collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-14, rel=1e-14)


def test_splits(spark):
    days = [0.63, 1.9999, 2, 3, 59]
    table = events(spark, [("c", d * 86_400, 1) for d in days])
    layout = split_layout(("train", 2), ("gap", 3), ("test", None))
    assert column(prep.assign_splits(table, layout), "split") == ["train", "train", "gap", "test", "test"]
    bounded = split_layout(("train", 2), ("gap", 3))
    assert column(prep.assign_splits(table, bounded), "split")[3:] == [None, None]
    assert prep.select_split(table, layout, "gap").count() == 1
    with pytest.raises(KeyError, match="unknown split"):
        prep.select_split(table, layout, "nope")


@pytest.mark.parametrize(
    "windows, message",
    [
        ((SplitWindow("a", 1, 2),), "start at day 0"),
        ((SplitWindow("a", 0, 2), SplitWindow("a", 2, 3)), "duplicate"),
        ((SplitWindow("a", 0, 2), SplitWindow("b", 3, 4)), "contiguous"),
        ((SplitWindow("a", 0, None), SplitWindow("b", 2, 4)), "open"),
        ((SplitWindow("a", 0, 0),), "empty"),
    ],
)
def test_bad_layouts(windows, message):
    with pytest.raises(SettingsError, match=message):
        SplitLayout(windows)


def _labelled(spark):
    rows = [(f"t{i}", at(60 * i), f"c{i % 7}", f"m{i % 5}", i % 3 == 0) for i in range(90)]
    rows.append(("unlabelled", at(0), "c0", "m0", None))
    return spark.createDataFrame(
        rows, "txn_id string, event_ts timestamp, card_id string, merchant_id string, is_fraud boolean"
    )


def test_label_arrival(spark):
    table = _labelled(spark)
    labels = prep.label_events(table)
    delay = (F.unix_millis("label_ts") - F.unix_millis("event_ts")) / 86_400_000
    got = {r["txn_id"]: (r["is_fraud"], r["d"]) for r in labels.withColumn("d", delay).collect()}
    assert len(got) == 90
    assert {d for fraud, d in got.values() if not fraud} == {14.0}
    frauds = [d for fraud, d in got.values() if fraud]
    assert all(0 < d <= 14 for d in frauds) and len(set(frauds)) > 20
    alone = prep.label_events(table.filter("txn_id = 't0'")).first()["label_ts"]
    assert alone == labels.filter("txn_id = 't0'").first()["label_ts"]
    with pytest.raises(SettingsError, match="median"):
        LabelDelay(fraud_median_days=20)


def test_label_maturity_guard(spark):
    table = _labelled(spark)
    labels = prep.label_events(table)
    frame = table.withColumn("split", F.when(F.col("txn_id") == "t89", "next").otherwise("train"))
    with pytest.raises(ValueError, match="widen the gap"):
        prep.check_label_maturity(frame, labels, train_window="train", next_window="next")


def test_canonical_ids(spark):
    transactions = spark.createDataFrame(
        [
            (1, 0, 86_400, 10.0, "W", 100, 1.0, "visa", None, 0.0),
            (2, 1, 172_800, 20.0, "W", 100, 1.0, "visa", None, 1.0),
            (3, 0, 172_900, 30.0, "C", 100, 1.0, "visa", None, 0.0),
        ],
        "TransactionID long, isFraud long, TransactionDT long, TransactionAmt double, ProductCD string, "
        "card1 long, card2 double, card4 string, card3 double, D1 double",
    )
    for c in ("card5", "card6", "addr1", "R_emaildomain"):
        transactions = transactions.withColumn(c, F.lit(None).cast("string"))
    identity = spark.createDataFrame(
        [(1, None, None, None, None), (2, "phone", None, None, None)],
        "TransactionID long, DeviceInfo string, id_30 string, id_31 string, id_33 string",
    )
    out = prep.to_canonical(transactions, identity)
    cards = column(out, "card_id")
    assert cards[0] == cards[1] != cards[2]
    assert [d is None for d in column(out, "device_id")] == [True, False, True]
    assert column(out, "is_fraud") == [False, True, False]
    assert out.columns[:11] == CANONICAL_SCHEMA.names and "attr_D1" in out.columns
    with pytest.raises(prep.DuplicateKeyError, match="right side"):
        prep.to_canonical(transactions, identity.unionByName(identity))


def _canonical(spark):
    base = events(spark, [("c", 0, 1, "d"), ("c", 86_400, 2)])
    return base.withColumn("ip", F.lit(None).cast("string")).withColumn("currency", F.lit("USD")).withColumn(
        "channel", F.lit("pos")
    ).select(*CANONICAL_SCHEMA.names)


def test_table_contract(spark):
    good = _canonical(spark)
    contracts.validate_event_table(good)
    with pytest.raises(contracts.EventTableError) as error:
        contracts.validate_event_table(
            good.drop("ip").withColumn("amount", F.lit("x")).withColumn("vendor", F.lit(1))
        )
    for part in ("missing_column ip", "wrong_type amount", "unexpected_column vendor"):
        assert part in str(error.value)
    with pytest.raises(contracts.EventTableError) as error:
        contracts.validate_event_table(
            good.unionByName(good).withColumn("amount", F.lit(0.0)).withColumn("card_id", F.lit(None).cast("string"))
        )
    for part in ("null_card_id: 4", "non_positive_amount: 4", "repeated_txn_id: 2"):
        assert part in str(error.value)


def test_messages(spark):
    wide = _canonical(spark).withColumn("attr_C1", F.lit(float("nan"))).withColumn("attr_M1", F.lit("T"))
    values = [json.loads(r["value"]) for r in contracts.event_to_json(wide).collect()]
    assert all("is_fraud" not in v for v in values)
    assert values[0]["attributes"] == {"C1": None, "M1": "T"}
    kept = [json.loads(r["value"]) for r in contracts.event_to_json(wide, include_label=True).collect()]
    assert kept[0]["is_fraud"] is False
    decoded = contracts.decode_events(contracts.event_to_json(wide, include_label=True), for_scoring=True)
    assert {tuple(r["errors"]) for r in decoded.collect()} == {("is_fraud",)}


@pytest.mark.parametrize(
    "change, error",
    [
        ({"event_ts": "2026-01-01T00:00:00"}, "event_ts"),
        ({"event_ts": "soon"}, "event_ts"),
        ({"card_id": ""}, "card_id"),
        ({"device_id": "x" * 129}, "device_id"),
        ({"amount": 0}, "amount"),
        ({"currency": "usd"}, "currency"),
        ({"channel": "phone"}, "channel"),
        ({"attributes": {"C1": "NaN"}}, "attributes"),
        ({"extra": 1}, "unknown_field"),
        ({}, None),
        ({"event_ts": "2026-01-01T02:00:00+02:00"}, None),
    ],
)
def test_message_faults(spark, change, error):
    message = {
        "txn_id": "t", "event_ts": "2026-01-01T00:00:00Z", "card_id": "c", "merchant_id": "m",
        "merchant_category": "food", "amount": 1.5, "currency": "USD", "channel": "pos", **change,
    }
    row = contracts.decode_events(spark.createDataFrame([(json.dumps(message),)], "value string")).first()
    assert row["errors"] == ([error] if error else [])
    if error is None:
        assert row["event_ts"].timestamp() == at(0).timestamp()


def test_malformed_messages_are_quarantined(spark):
    rows = spark.createDataFrame([("{not json",), ("",)], "value string")
    assert contracts.quarantined(contracts.decode_events(rows)).count() == 2
    late = {"txn_id": "t", "card_id": "c", "merchant_id": "m", "event_ts": "2026-01-02T00:00:00Z",
            "label_ts": "2026-01-01T00:00:00Z", "is_fraud": True}
    row = contracts.decode_labels(spark.createDataFrame([(json.dumps(late),)], "value string")).first()
    assert row["errors"] == ["label_before_event"]


def test_messages_are_parsed_once(spark, capsys):
    """A filter on parsed fields stays above the parsing: below it, each field would parse the message again."""
    events = _canonical(spark)
    contracts.accepted(contracts.decode_events(contracts.event_to_json(events))).select("txn_id").explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json(") == 1


def test_timeline_puts_labels_first_and_stops(spark):
    table = events(spark, [("c", 0, 1), ("c", 10, 1), ("c", 20, 1)])
    labels = table.select("txn_id", F.col("event_ts").alias("label_ts")).filter("txn_id = 't001'")
    items = timeline(table, labels)
    order = [(r["kind"], r["txn_id"]) for r in items.orderBy("time_ms", "kind", "sequence").collect()]
    assert order == [(1, "t000"), (0, "t001"), (1, "t001"), (1, "t002")]
    stats = replay_stats(limit_transactions(items, 1)).first()
    assert (stats["transactions"], stats["labels"], stats["event_span_ms"]) == (1, 1, 10_000)


def test_parquet_and_csv(spark):
    path = scratch_path(spark, "table")
    write_events(_canonical(spark), path)
    back = read_events(spark, path)
    assert back.count() == 2 and "event_date" in back.columns
    csv = scratch_path(spark, "raw")
    raw = spark.createDataFrame(
        [(1, 7.25, "007", 1.5)], "TransactionID long, TransactionAmt double, id_30 string, D1 double"
    )
    raw.write.option("header", True).csv(csv)
    loaded = read_raw_csv(spark, csv)
    assert dict(loaded.dtypes) == {
        "TransactionID": "bigint", "TransactionAmt": "double", "id_30": "string", "D1": "float",
    }
    assert loaded.first()["id_30"] == "007"


def test_fingerprint_follows_content(spark):
    table = events(spark, [("c", 0, 1), ("c", 1, 2)])
    first = prep.data_fingerprint(table).first()["fingerprint"]
    assert first == prep.data_fingerprint(table.repartition(3)).first()["fingerprint"]
    assert first != prep.data_fingerprint(table.withColumn("amount", F.col("amount") + 1)).first()["fingerprint"]
