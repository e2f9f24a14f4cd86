"""The point-in-time feature table: 30 features per transaction, 33 with arrived labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.columns import cents, day_number, event_ms, milli_units, packed, ratio, unpacked
from tallyward.operators.timeline import Additive, BusyKeys, Distinct, busy_entities, chunked, plain
from tallyward.session import materialize, small_side
from tallyward.settings import (
    DAY_MS,
    DEVIATION_WINDOW_MS,
    DEVICE_COUNT_WINDOWS,
    DEVICE_DISTINCT_WINDOWS,
    DISTINCT_WINDOWS,
    WINDOWS_MS,
    SkewPolicy,
)

REQUIRED_COLUMNS = ("txn_id", "event_ts", "card_id", "device_id", "merchant_id", "amount")

# Feature columns in order, with their types.
FEATURE_TYPES = {
    "card_txn_count_1m": "bigint",
    "card_amount_sum_1m": "double",
    "card_txn_count_10m": "bigint",
    "card_amount_sum_10m": "double",
    "card_txn_count_1h": "bigint",
    "card_amount_sum_1h": "double",
    "card_txn_count_24h": "bigint",
    "card_amount_sum_24h": "double",
    "card_txn_count_7d": "bigint",
    "card_amount_sum_7d": "double",
    "card_distinct_merchants_1h": "bigint",
    "card_distinct_merchants_24h": "bigint",
    "card_distinct_merchants_7d": "bigint",
    "card_distinct_devices_1h": "bigint",
    "card_distinct_devices_24h": "bigint",
    "card_distinct_devices_7d": "bigint",
    "card_amount_mean_30d": "double",
    "card_amount_std_30d": "double",
    "amount_to_card_mean_30d": "double",
    "amount_zscore_30d": "double",
    "device_txn_count_1h": "bigint",
    "device_txn_count_24h": "bigint",
    "device_distinct_cards_24h": "bigint",
    "device_distinct_cards_7d": "bigint",
    "card_age_days": "double",
    "device_age_days": "double",
    "card_device_seen_before": "boolean",
    "card_merchant_seen_before": "boolean",
    "hour_of_day": "tinyint",
    "day_of_week": "tinyint",
}
LABEL_FEATURE_TYPES = {
    "card_prior_fraud_labels": "bigint",
    "merchant_known_labels": "bigint",
    "merchant_known_fraud_rate": "double",
}

CARD_SUMS = [
    *[Additive(f"_n_{w}", "_one", ms) for w, ms in WINDOWS_MS.items()],
    *[Additive(f"_mu_{w}", "_mu", ms) for w, ms in WINDOWS_MS.items()],
    Additive("_n_30d", "_one", DEVIATION_WINDOW_MS),
    Additive("_s1_30d", "_cents", DEVIATION_WINDOW_MS),
    Additive("_s2_30d", "_cents2", DEVIATION_WINDOW_MS),
]
CARD_LABEL_SUM = Additive("card_prior_fraud_labels", "_fraud_label", None)
CARD_SETS = [
    *[
        Distinct(f"card_distinct_merchants_{w}", "merchant_id", WINDOWS_MS[w])
        for w in DISTINCT_WINDOWS
    ],
    *[Distinct(f"card_distinct_devices_{w}", "device_id", WINDOWS_MS[w]) for w in DISTINCT_WINDOWS],
]
DEVICE_SUMS = [
    Additive(f"_dn_{w}", "_one", WINDOWS_MS[w]) for w in DEVICE_COUNT_WINDOWS
]
DEVICE_SETS = [Distinct(f"_dc_{w}", "card_id", WINDOWS_MS[w]) for w in DEVICE_DISTINCT_WINDOWS]


def feature_names(*, with_labels: bool) -> list[str]:
    return list(feature_schema(with_labels=with_labels))


def feature_schema(*, with_labels: bool) -> dict[str, str]:
    return {**FEATURE_TYPES, **(LABEL_FEATURE_TYPES if with_labels else {})}


def require_columns(df: DataFrame, needed: tuple[str, ...], who: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{who} needs columns {missing}")


def _rows(events: DataFrame) -> DataFrame:
    return events.select(
        "txn_id",
        event_ms().alias("_ms"),
        "card_id",
        "device_id",
        "merchant_id",
        F.col("amount").cast("double").alias("_amount"),
        milli_units(F.col("amount")).alias("_mu"),
        cents(F.col("amount")).alias("_cents"),
        F.lit(1).alias("_one"),
        F.lit(True).alias("_asks"),
    ).withColumn("_cents2", F.col("_cents") * F.col("_cents"))


def _with_fraud_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add chargeback arrivals as contributing rows on the card's timeline."""
    arrivals = labels.filter("is_fraud").select(
        "card_id",
        event_ms("label_ts").alias("_ms"),
        F.lit(1).alias("_fraud_label"),
        F.lit(False).alias("_asks"),
        *[F.lit(0).alias(c) for c in ("_mu", "_cents", "_one", "_cents2")],
    )
    return rows.withColumn("_fraud_label", F.lit(0)).unionByName(
        arrivals, allowMissingColumns=True
    )


#: What every stage carries; amounts in other units are worked out where they are summed, after the shuffle.
CARRIED = ("txn_id", "_ms", "card_id", "device_id", "merchant_id", "_amount")
ENTITIES = ("card_id", "device_id", "merchant_id")


def carries(events: DataFrame, name: str) -> tuple[Column, Column]:
    """How a kept event column travels, and how it is had back: what other carried columns tell is left out."""
    kind, held = dict(events.dtypes)[name], F.col(f"_keep_{name}")
    if name == "amount" and kind == "double":
        return F.lit(None).cast("boolean"), F.col("_amount")
    if name == "event_ts" and kind == "timestamp":  # mostly nothing below the millisecond
        rest = F.unix_micros("event_ts") - event_ms() * 1000
        return rest, F.timestamp_micros(F.col("_ms") * 1000 + held)
    return F.col(name), held


def _narrow(events: DataFrame, keep: Sequence[str]) -> DataFrame:
    return events.select(
        packed(F.col("txn_id")).alias("txn_id"),
        event_ms().alias("_ms"),
        "card_id",
        "device_id",
        "merchant_id",
        F.col("amount").cast("double").alias("_amount"),
        *[carries(events, c)[0].alias(f"_keep_{c}") for c in keep if c not in CARRIED],
    )


def _with_units(rows: DataFrame) -> DataFrame:
    """The summed columns. Rows without an id are arrived fraud labels: they do not ask and count nothing else."""
    asks, in_cents = F.col("txn_id").isNotNull(), cents(F.col("_amount"))
    return rows.withColumns(
        {
            "_asks": asks,
            "_fraud_label": (~asks).cast("int"),
            "_mu": milli_units(F.col("_amount")),
            "_cents": in_cents,
            "_cents2": in_cents * in_cents,
            "_one": asks.cast("int"),
        }
    )


def _specs(specs: Sequence[Additive | Distinct], wanted: Sequence[str]) -> list[Additive | Distinct]:
    """Those of ``specs`` that the wanted features are made of: a busy entity's totals cost what they hold."""
    used = set(wanted)
    used |= {f"_n_{c.rsplit('_', 1)[1]}" for c in wanted if c.startswith("card_txn_count_")}
    used |= {f"_mu_{c.rsplit('_', 1)[1]}" for c in wanted if c.startswith("card_amount_sum_")}
    used |= {f"_dn_{c.rsplit('_', 1)[1]}" for c in wanted if c.startswith("device_txn_count_")}
    used |= {f"_dc_{c.rsplit('_', 1)[1]}" for c in wanted if c.startswith("device_distinct_cards_")}
    if any(c.endswith("_30d") for c in wanted):
        used |= {"_n_30d", "_s1_30d", "_s2_30d"}
    return [s for s in specs if s.name in used]


def card_stage(
    rows: DataFrame, known: DataFrame | None, wanted: Sequence[str], busy: BusyKeys | None
) -> DataFrame:
    """What the wanted features take that is keyed by card, in one shuffle of narrow rows.

    First-seen times come before the window features, so that what is sorted again is still narrow.
    """
    specs = [*CARD_SUMS, *CARD_SETS]
    if known is not None:
        arrivals = known.filter("is_fraud").select("card_id", "_ms")
        rows = rows.unionByName(arrivals, allowMissingColumns=True)
        specs.append(CARD_LABEL_SUM)
    specs = _specs(specs, wanted)
    sums = [s for s in specs if isinstance(s, Additive)]
    sets = [s for s in specs if isinstance(s, Distinct)]
    seen = {"_pair_first": ["card_id", "device_id"], "_shop_first": ["card_id", "merchant_id"]}
    makes = {"_pair_first": "card_device_seen_before", "_shop_first": "card_merchant_seen_before"}
    seen = {name: keys for name, keys in seen.items() if makes[name] in wanted}
    asks = F.col("txn_id").isNotNull()
    first = F.min(F.when(asks, F.col("_ms")))

    def quiet(mine: DataFrame) -> DataFrame:
        out = mine.repartition("card_id")
        for name, keys in seen.items():
            out = out.select("*", first.over(Window.partitionBy(*keys)).alias(name))
        out = plain(_with_units(out), "card_id", "_ms", sums, sets)
        return out.select("*", first.over(Window.partitionBy("card_id")).alias("_card_first")).filter(asks)

    if busy is None:
        return quiet(rows)
    few, hot = busy.split(rows, "card_id")
    few = quiet(few)
    asof = chunked(_with_units(hot), "card_id", "_ms", sums, sets, "_asks", "_card_first")
    out = hot.filter(asks).drop("_chunk_ms")
    for name, keys in seen.items():
        # Null key parts never reach a reader: their features are masked to null.
        out = out.join(small_side(hot.filter(asks).groupBy(*keys).agg(F.min("_ms").alias(name))), keys, "left")
    return few.unionByName(_with_units(out.join(asof, ["card_id", "_ms"])).select(*few.columns))


def device_stage(rows: DataFrame, wanted: Sequence[str], busy: BusyKeys | None) -> DataFrame:
    """What the wanted features take that is keyed by device, in one shuffle.

    A row without a device gets a key of its own, so the null device is spread out and not a group.
    """
    key = F.coalesce("device_id", F.concat(F.lit("none:"), F.col("txn_id")))
    sums, sets = _specs(DEVICE_SUMS, wanted), _specs(DEVICE_SETS, wanted)

    def quiet(mine: DataFrame) -> DataFrame:
        keyed = mine.repartition(key).withColumns({"_device": key, "_one": F.lit(1)})
        out = plain(keyed, "_device", "_ms", sums, sets)
        first = F.min("_ms").over(Window.partitionBy("_device"))
        return out.select("*", first.alias("_device_first")).drop("_device", "_one")

    if busy is None:
        return quiet(rows)
    few, hot = busy.split(rows, "device_id")
    few = quiet(few)
    marked = hot.withColumns({"_asks": F.lit(True), "_one": F.lit(1)})
    asof = chunked(marked, "device_id", "_ms", sums, sets, "_asks", "_device_first")
    out = hot.join(asof, ["device_id", "_ms"])
    return few.unionByName(out.select(*few.columns))


def merchant_stage(rows: DataFrame, known: DataFrame, busy: BusyKeys | None) -> DataFrame:
    """Add what was known of the merchant before the row's day: one shuffle, by merchant.

    Labels join a merchant's rows as contributing rows. A busy merchant is met by its days instead: one row per day.
    """
    day = day_number(F.col("_ms"))
    known = known.select("merchant_id", "_ms", F.coalesce("is_fraud", F.lit(False)).alias("_f"))

    def quiet(mine: DataFrame, labels: DataFrame) -> DataFrame:
        both = mine.withColumn("_f", F.lit(None).cast("boolean")).unionByName(labels, allowMissingColumns=True)
        before = Window.partitionBy("merchant_id").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
        return (
            both.repartition("merchant_id")
            .withColumns({"_day": day, "_frauds": F.col("_f").cast("int")})
            .select(
                "*",
                F.count("_f").over(before).alias("_known_labels"),
                F.coalesce(F.sum("_frauds").over(before), F.lit(0)).alias("_known_frauds"),
            )
            .filter(F.col("txn_id").isNotNull())
            .drop("_f", "_day", "_frauds")
        )

    if busy is None:
        return quiet(rows, known)
    few = quiet(
        busy.restrict(rows, "merchant_id", "left_anti").select(*rows.columns),
        busy.restrict(known, "merchant_id", "left_anti").select(*known.columns),
    )
    hot = busy.restrict(rows, "merchant_id", "left_semi").select(*rows.columns, day.alias("_day"))
    mine = busy.restrict(known, "merchant_id", "left_semi")
    grid = small_side(_label_days(hot, mine.select("merchant_id", day.alias("_day"), F.col("_f").cast("int").alias("_f"))))
    return few.unionByName(hot.join(grid, ["merchant_id", "_day"], "left").select(*few.columns))


def with_all_labels(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Add what was known of all merchants before the row's day, by a join with one row per calendar day."""
    days = known.groupBy(day_number(F.col("_ms")).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("is_fraud").cast("bigint")).alias("_f")
    )
    low, high = days.agg(F.min("_day"), F.max("_day")).first()
    if low is None:
        return rows.withColumns({"_all_labels": F.lit(0), "_all_frauds": F.lit(0)})
    earlier = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    everyone = (
        rows.sparkSession.range(low, high + 2)  # to the day after the last label's
        .select(F.col("id").alias("_day"))
        .join(days, "_day", "left")
        .select(
            F.col("_day").alias("_upto"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_all_labels"),
            F.coalesce(F.sum("_f").over(earlier), F.lit(0)).alias("_all_frauds"),
        )
    )
    upto = F.least(day_number(F.col("_ms")), F.lit(high + 1))
    return rows.join(small_side(everyone), upto == F.col("_upto"), "left").drop("_upto")


def _label_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """(merchant_id, _day, _known_labels, _known_frauds) for each merchant and day that has a row."""
    both = days.select("merchant_id", "_day", "_f").unionByName(
        rows.select("merchant_id", "_day", F.lit(None).cast("int").alias("_f"))
    )
    earlier = Window.partitionBy("merchant_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return (
        both.groupBy("merchant_id", "_day")
        .agg(F.count("_f").alias("_n"), F.sum("_f").alias("_f"))
        .select(
            "merchant_id",
            "_day",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_known_labels"),
            F.coalesce(F.sum("_f").over(earlier), F.lit(0)).alias("_known_frauds"),
        )
    )


def merchant_label_days(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels known before each (merchant, day) that has a transaction, and known overall.

    Day grain, like a nightly job: only labels that arrived on an earlier day count. Both sides are
    reduced to one row per merchant and day before anything is sorted; the overall history has one
    row per day.
    """
    arrived = labels.groupBy(
        "merchant_id", day_number(event_ms("label_ts")).alias("_day")
    ).agg(
        F.count(F.lit(1)).alias("_labels"),
        F.sum(F.col("is_fraud").cast("bigint")).alias("_frauds"),
    )
    asked = rows.groupBy("merchant_id", day_number(F.col("_ms")).alias("_day")).agg(
        F.lit(0).cast("bigint").alias("_labels"), F.lit(0).cast("bigint").alias("_frauds")
    )
    grid = (
        arrived.unionByName(asked)
        .groupBy("merchant_id", "_day")
        .agg(F.sum("_labels").alias("_labels"), F.sum("_frauds").alias("_frauds"))
    )
    earlier = (
        Window.partitionBy("merchant_id")
        .orderBy("_day")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    overall = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everyone = (
        grid.groupBy("_day")
        .agg(F.sum("_labels").alias("_labels"), F.sum("_frauds").alias("_frauds"))
        .select(
            "_day",
            F.coalesce(F.sum("_labels").over(overall), F.lit(0)).alias("_all_labels"),
            F.coalesce(F.sum("_frauds").over(overall), F.lit(0)).alias("_all_frauds"),
        )
    )
    return grid.select(
        "merchant_id",
        "_day",
        F.coalesce(F.sum("_labels").over(earlier), F.lit(0)).alias("_known_labels"),
        F.coalesce(F.sum("_frauds").over(earlier), F.lit(0)).alias("_known_frauds"),
    ).join(everyone, "_day")


def smoothed_rate(
    positives: Column, total: Column, prior_positives: Column, prior_total: Column, strength: float
) -> Column:
    """Shrink a rate toward the overall rate; null while no label is known at all."""
    if strength <= 0:
        raise ValueError("strength must be positive")
    prior = ratio(prior_positives, prior_total)
    return (positives + F.lit(float(strength)) * prior) / (total + F.lit(float(strength)))


def mean_and_std(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and population deviation in currency units, from exact integer moments in cents."""
    count = n.cast("double")
    mean_cents = F.when(n >= 1, s1 / count)
    variance = F.greatest(F.when(n >= 1, s2 / count) - mean_cents * mean_cents, F.lit(0.0))
    return mean_cents / 100, F.when(n >= 2, F.sqrt(variance) / 100)


def _age_days(first: Column, now: Column) -> Column:
    return F.when(first < now, (now - first) / F.lit(float(DAY_MS))).otherwise(F.lit(0.0))


def compute_features(
    events: DataFrame,
    labels: DataFrame | None = None,
    *,
    label_strength: float = 100.0,
    policy: SkewPolicy = SkewPolicy(),
    only: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``txn_id`` and every feature, one row per event.

    ``labels`` is the label-arrival table; without it the three label features are left out. ``only`` names the
    features that are wanted, and ``keep`` event columns that travel with the rows, which saves a join of wide rows.
    """
    require_columns(events, REQUIRED_COLUMNS, "compute_features")
    names = feature_names(with_labels=labels is not None)
    wanted = names if only is None else [c for c in names if c in set(only)]
    keep = [c for c in keep if c != "txn_id"]
    extra = [c for c in keep if c not in CARRIED]
    raw = _narrow(events, extra)
    if "device_id" not in keep and not any("device" in c for c in wanted):
        raw = raw.drop("device_id")  # written tables would hold it
    about = {e: [c for c in wanted if c.startswith(f"{e[:-3]}_")] for e in ENTITIES}
    about["card_id"] += [c for c in wanted if c.startswith("amount_")]
    busy = busy_entities(raw, [e for e in ENTITIES if about[e]], "_ms", policy)
    known = None
    if labels is not None and (about["merchant_id"] or CARD_LABEL_SUM.name in wanted):
        # read by cards, merchants and days
        known = materialize(labels.select("card_id", "merchant_id", event_ms("label_ts").alias("_ms"), "is_fraud"))
    rows = raw
    if about["merchant_id"]:
        rows = merchant_stage(rows, known, busy["merchant_id"])
    if about["device_id"]:
        rows = device_stage(rows, about["device_id"], busy["device_id"])
    if about["card_id"]:
        labelled = known if CARD_LABEL_SUM.name in wanted else None
        rows = card_stage(rows, labelled, about["card_id"], busy["card_id"])
    if about["merchant_id"]:
        rows = with_all_labels(rows, known)
    kept = [(carries(events, c)[1] if c in extra else F.col(c)).alias(c) for c in keep]
    made = feature_columns(label_strength if labels is not None else None, set(wanted))
    return rows.select(unpacked(F.col("txn_id")).alias("txn_id"), *kept, *made)


def feature_columns(label_strength: float | None, only: set[str] | None = None) -> list[Column]:
    """The declared features, in order and type, from the raw as-of aggregates."""
    ms, amount = F.col("_ms"), F.col("_amount")
    has_device = F.col("device_id").isNotNull()
    mean, std = mean_and_std(F.col("_n_30d"), F.col("_s1_30d"), F.col("_s2_30d"))
    moment = F.timestamp_millis(ms)
    made: dict[str, Column] = {}
    for w in WINDOWS_MS:
        made[f"card_txn_count_{w}"] = F.col(f"_n_{w}")
        made[f"card_amount_sum_{w}"] = F.col(f"_mu_{w}") / F.lit(1000.0)
    made["card_amount_mean_30d"] = mean
    made["card_amount_std_30d"] = std
    made["amount_to_card_mean_30d"] = ratio(amount, mean)
    made["amount_zscore_30d"] = F.when(std > 0, (amount - mean) / std)
    for w in DEVICE_COUNT_WINDOWS:
        made[f"device_txn_count_{w}"] = F.when(has_device, F.col(f"_dn_{w}"))
    for w in DEVICE_DISTINCT_WINDOWS:
        made[f"device_distinct_cards_{w}"] = F.when(has_device, F.col(f"_dc_{w}"))
    made["card_age_days"] = _age_days(F.col("_card_first"), ms)
    made["device_age_days"] = F.when(has_device, _age_days(F.col("_device_first"), ms))
    made["card_device_seen_before"] = F.when(has_device, F.col("_pair_first") < ms)
    made["card_merchant_seen_before"] = F.col("_shop_first") < ms
    made["hour_of_day"] = F.hour(moment)
    made["day_of_week"] = F.weekday(moment) + 1
    if label_strength is not None:
        known = F.coalesce("_known_labels", F.lit(0))
        made["merchant_known_labels"] = known
        made["merchant_known_fraud_rate"] = smoothed_rate(
            F.coalesce("_known_frauds", F.lit(0)),
            known,
            F.coalesce("_all_frauds", F.lit(0)),
            F.coalesce("_all_labels", F.lit(0)),
            label_strength,
        )
    schema = feature_schema(with_labels=label_strength is not None)
    return [
        made.get(name, F.col(name)).cast(kind).alias(name)
        for name, kind in schema.items()
        if only is None or name in only
    ]
