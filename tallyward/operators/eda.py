"""Profile of an event table: every number of the exploratory report, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.columns import event_ms, ratio
from tallyward.operators.evaluation import count_where, money_sum, share_of_total
from tallyward.operators.prep import assign_splits
from tallyward.operators.ranking import exact_quantiles
from tallyward.settings import ATTRIBUTE_PREFIX, DAY_MS, SplitLayout

# Quantile levels of the amount table, report sizes and missing-share buckets.
AMOUNT_LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
COUNT_LEVELS = (0.5, 0.9, 0.99)
TOP_ROWS = 15
HISTOGRAM_EDGES = 60
MISSING_BUCKETS = ("complete (0%)", "up to 25%", "25-50%", "50-75%", "over 75%")


def labelled(events: DataFrame) -> DataFrame:
    return events.filter(F.col("is_fraud").isNotNull())


def overview(events: DataFrame) -> DataFrame:
    first, last = F.min(event_ms()), F.max(event_ms())
    attributes = sum(c.startswith(ATTRIBUTE_PREFIX) for c in events.columns)
    return events.agg(
        F.count(F.lit(1)).alias("transactions"),
        first.alias("first_ms"),
        last.alias("last_ms"),
        ((last - first) / F.lit(float(DAY_MS))).alias("span_days"),
        F.array_join(F.sort_array(F.collect_set("currency")), "/").alias("currencies"),
        F.lit(attributes).cast("bigint").alias("attribute_columns"),
    )


def class_balance(events: DataFrame) -> DataFrame:
    known, fraud = F.col("is_fraud").isNotNull(), F.col("is_fraud")
    total, bad = money_sum(known), money_sum(fraud)
    n = count_where(known)
    return events.agg(
        n.alias("labelled_transactions"),
        count_where(~known).alias("unlabelled_transactions"),
        count_where(fraud).alias("fraud_transactions"),
        ratio(count_where(fraud), n).alias("fraud_rate"),
        total.alias("total_amount"),
        bad.alias("fraud_amount"),
        ratio(bad, total).alias("fraud_amount_share"),
    )


def amount_stats(events: DataFrame) -> DataFrame:
    """(is_fraud, statistic, value): count, mean, max and linear quantiles per class."""
    known = labelled(events)
    base = known.groupBy("is_fraud").agg(
        F.count(F.lit(1)).cast("double").alias("count"),
        ratio(money_sum(F.lit(True)), F.count(F.lit(1))).alias("mean"),
        F.max("amount").alias("max"),
    )
    wide = base.select(
        "is_fraud",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value"))
                    for s in ("count", "mean", "max")
                ]
            )
        ).alias("_s"),
    ).select("is_fraud", "_s.statistic", "_s.value")
    quantiles = exact_quantiles(known, "amount", AMOUNT_LEVELS, keys=["is_fraud"]).select(
        "is_fraud",
        F.format_string("p%02d", F.round(F.col("level") * 100).cast("int")).alias("statistic"),
        "value",
    )
    return wide.unionByName(quantiles)


def window_stats(
    events: DataFrame, layout: SplitLayout, origin_day: int | None = None
) -> DataFrame:
    """One row per configured window, also for windows without any row."""
    spark = events.sparkSession
    windows = spark.createDataFrame(
        [(w.name, w.start_day, w.end_day) for w in layout.windows],
        "split string, start_day int, end_day int",
    )
    found = (
        assign_splits(labelled(events), layout, origin_day)
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            count_where(F.col("is_fraud")).alias("frauds"),
            money_sum(F.col("is_fraud")).alias("fraud_amount"),
            F.min(event_ms()).alias("first_ms"),
            F.max(event_ms()).alias("last_ms"),
        )
    )
    zero = F.lit(0)
    return windows.join(found, "split", "left").select(
        "split",
        "start_day",
        "end_day",
        F.coalesce("transactions", zero).alias("transactions"),
        F.coalesce("frauds", zero).alias("frauds"),
        ratio(F.col("frauds"), F.col("transactions")).alias("fraud_rate"),
        F.coalesce("fraud_amount", F.lit(0.0)).alias("fraud_amount"),
        "first_ms",
        "last_ms",
    )


def missing_shares(events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing_share): all columns counted in one pass."""
    names = list(columns or events.columns)
    counted = events.agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_where(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(names)],
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("missing"))
                for i, c in enumerate(names)
            ]
        )
    )
    return counted.select("_n", pairs.alias("_p")).select(
        "_p.column_name", ratio(F.col("_p.missing"), F.col("_n")).alias("missing_share")
    )


def _attributes(events: DataFrame) -> DataFrame:
    names = [c for c in events.columns if c.startswith(ATTRIBUTE_PREFIX)]
    return missing_shares(events, names).withColumn(
        "column_name", F.regexp_replace("column_name", "^" + ATTRIBUTE_PREFIX, "")
    )


def most_missing(events: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    return (
        _attributes(events).orderBy(F.col("missing_share").desc(), "column_name").limit(limit)
    )


def missing_bucket(share: Column) -> Column:
    return (
        F.when(share == 0, F.lit(MISSING_BUCKETS[0]))
        .when(share <= 0.25, F.lit(MISSING_BUCKETS[1]))
        .when(share <= 0.5, F.lit(MISSING_BUCKETS[2]))
        .when(share <= 0.75, F.lit(MISSING_BUCKETS[3]))
        .otherwise(F.lit(MISSING_BUCKETS[4]))
    )


def missing_buckets(events: DataFrame) -> DataFrame:
    found = _attributes(events).groupBy(missing_bucket(F.col("missing_share")).alias("bucket")).count()
    every = events.sparkSession.createDataFrame([(b,) for b in MISSING_BUCKETS], "bucket string")
    return every.join(found, "bucket", "left").select(
        "bucket", F.coalesce("count", F.lit(0)).alias("n_columns")
    )


def rows_per(events: DataFrame, key: str) -> DataFrame:
    return events.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def cards_per_device(events: DataFrame) -> DataFrame:
    """Distinct cards per device, counted in two map-side steps."""
    pairs = events.filter(F.col("device_id").isNotNull()).select("device_id", "card_id").distinct()
    return pairs.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"))


def count_distribution(counts: DataFrame) -> DataFrame:
    """(level, value) with nearest-rank p50, p90, p99 and the maximum as level 1."""
    return exact_quantiles(counts, "n", (*COUNT_LEVELS, 1.0), method="nearest")


def cardinality(events: DataFrame) -> DataFrame:
    """One row of entity counts and shares."""
    cards = rows_per(events, "card_id").agg(
        F.count(F.lit(1)).alias("cards"),
        F.avg((F.col("n") == 1).cast("double")).alias("single_transaction_card_share"),
    )
    shops = rows_per(events, "merchant_id").agg(
        F.count(F.lit(1)).alias("merchants"),
        F.max("n").alias("_largest"),
        F.sum("n").alias("_with_merchant"),
    )
    devices = cards_per_device(events).agg(
        F.count(F.lit(1)).alias("devices"),
        F.avg((F.col("n") > 1).cast("double")).alias("shared_device_share"),
    )
    rows = events.agg(
        F.count(F.lit(1)).alias("_n"),
        ratio(F.count("device_id"), F.count(F.lit(1))).alias("device_coverage"),
    )
    out = rows.withColumn("_k", F.lit(1))
    for part in (cards, shops, devices):  # one row each
        out = out.join(F.broadcast(part.withColumn("_k", F.lit(1))), "_k")
    return out.select(
        "cards",
        "devices",
        "merchants",
        "device_coverage",
        "single_transaction_card_share",
        ratio(F.col("_largest"), F.col("_n")).alias("largest_merchant_share"),
        "shared_device_share",
    )


def category_table(events: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    counted = (
        labelled(events)
        .groupBy("merchant_category")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            count_where(F.col("is_fraud")).alias("frauds"),
        )
    )
    return (
        share_of_total(counted, "transactions", "share")
        .withColumn("fraud_rate", ratio(F.col("frauds"), F.col("transactions")))
        .orderBy(F.col("transactions").desc(), "merchant_category")
        .limit(limit)
    )


def _volume(events: DataFrame, key: Column, name: str) -> DataFrame:
    return (
        labelled(events)
        .groupBy(key.alias(name))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            count_where(F.col("is_fraud")).alias("frauds"),
        )
        .withColumn("fraud_rate", ratio(F.col("frauds"), F.col("transactions")))
    )


def daily_volume(events: DataFrame) -> DataFrame:
    return _volume(events, F.to_date("event_ts"), "day")


def hourly_volume(events: DataFrame) -> DataFrame:
    return _volume(events, F.hour("event_ts"), "hour")


def split_volume(frame: DataFrame) -> DataFrame:
    return _volume(frame, F.col("split"), "split")


def amount_histogram(events: DataFrame, edges: int = HISTOGRAM_EDGES) -> DataFrame:
    """(is_fraud, bin, n, share): log-spaced bins over the amount range, share within its class.

    The range is two numbers, fetched first; the last bin includes the maximum.
    """
    known = labelled(events)
    low, high = known.agg(F.min(F.log10("amount")), F.max(F.log10("amount"))).first()
    bins = edges - 1
    if low is None or high is None:
        return known.groupBy("is_fraud").agg(
            F.lit(0).cast("bigint").alias("bin"),
            F.count(F.lit(1)).alias("n"),
            F.lit(None).cast("double").alias("share"),
        )
    width = (high - low) / bins if high > low else 1.0
    index = F.least(F.floor((F.log10("amount") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counted = known.groupBy("is_fraud", index.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = known.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("_size"))
    return counted.join(sizes, "is_fraud").select(
        "is_fraud", "bin", "n", ratio(F.col("n"), F.col("_size")).alias("share")
    )
