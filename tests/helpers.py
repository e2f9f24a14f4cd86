"""Small event tables written as (card, seconds, amount, device, merchant) rows."""

from datetime import UTC, datetime, timedelta

T0 = datetime(2026, 1, 1, tzinfo=UTC)  # a Thursday

EVENTS = (
    "txn_id string, event_ts timestamp, card_id string, device_id string, merchant_id string, "
    "merchant_category string, amount double, is_fraud boolean"
)
LABELS = (
    "txn_id string, card_id string, merchant_id string, event_ts timestamp, label_ts timestamp, "
    "is_fraud boolean"
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def events(spark, rows):
    data = []
    for i, row in enumerate(rows):
        card, seconds, amount, device, merchant = (*row, *(None, "m1")[len(row) - 3 :])
        data.append((f"t{i:03d}", at(seconds), card, device, merchant, "food", float(amount), False))
    return spark.createDataFrame(data, EVENTS)


def column(df, name, key="txn_id"):
    return [r[name] for r in df.orderBy(key).select(name).collect()]
