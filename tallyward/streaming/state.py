"""State tables kept current by a stream: events, labels and first-seen times.

A micro-batch writes one folder per table, named by its batch id and overwritten on a retry, so
redelivery changes nothing. Readers drop repeated transaction ids, take minima of first-seen times
and count each label once, so the order of arrival does not matter either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.columns import day_number, event_ms
from tallyward.operators.features import (
    CARD_LABEL_SUM,
    CARD_SETS,
    CARD_SUMS,
    DEVICE_SETS,
    DEVICE_SUMS,
    _rows,
    _with_fraud_labels,
    feature_columns,
    merchant_label_days,
)
from tallyward.operators.timeline import behaviour, busy_keys
from tallyward.session import materialize
from tallyward.settings import DAY_MS, DEVIATION_WINDOW_MS, SkewPolicy
from tallyward.streaming.ledger import numbered_folders

EVENT_STATE = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("event_day", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
LABEL_STATE = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("label_ts", T.TimestampType()),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
FIRST_STATE = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("other", T.StringType()),
        T.StructField("first_ms", T.LongType()),
        T.StructField("last_ms", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
FOLDED_STATE = T.StructType([T.StructField("upto", T.LongType()), T.StructField("batch_id", T.LongType())])
# What a first-seen time belongs to.
CARD, DEVICE, CARD_DEVICE, CARD_MERCHANT = "card", "device", "card_device", "card_merchant"


def first_times(events: DataFrame) -> DataFrame:
    """(owner, other, kind, first_ms, last_ms): sightings in ``events``, combined map-side."""
    def key(kind: str, owner: str, other: str | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(owner).alias("owner"),
            (F.col(other) if other else F.lit("")).alias("other"),
        )

    keys = F.explode(
        F.array(
            key(CARD, "card_id"),
            key(DEVICE, "device_id"),
            key(CARD_DEVICE, "card_id", "device_id"),
            key(CARD_MERCHANT, "card_id", "merchant_id"),
        )
    )
    return (
        events.select(event_ms().alias("_ms"), keys.alias("_k"))
        .select("_ms", "_k.*")
        .filter(F.col("owner").isNotNull() & F.col("other").isNotNull())
        .groupBy("owner", "other", "kind")
        .agg(F.min("_ms").alias("first_ms"), F.max("_ms").alias("last_ms"))
    )


def once(df: DataFrame) -> DataFrame:
    """One row per transaction: of redelivered rows that differ, the smallest by all other columns in order."""
    rest = [c for c in df.columns if c != "txn_id"]
    return df.groupBy("txn_id").agg(F.min(F.struct(*rest)).alias("_row")).select("txn_id", "_row.*").select(*df.columns)


def refuse_rewind(spark: SparkSession, path: str, batch_id: int) -> None:
    """Fail where ``path`` already holds a later batch: a query that lost its checkpoint starts again at
    batch 0, and would overwrite other data than its own. Writing the last batch again is a retry."""
    last = max(numbered_folders(spark, path, "batch_id"), default=None)
    if last is not None and last > batch_id:
        raise ValueError(f"{path} holds batch {last}, later than {batch_id}: give a restarted query a folder of its own")


@dataclass(frozen=True)
class FeatureState:
    """Folders of one feature state under ``root``, which every executor must reach."""

    root: str
    trim_history: bool = True
    lifetime_days: int | None = None  # with a number, compaction forgets keys idle for longer

    # ------------------------------------------------------------ write path

    def _put(self, df: DataFrame, table: str, batch_id: int, *partitions: str) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(f"{self.root}/{table}/batch_id={batch_id}")

    def add_events(self, events: DataFrame, batch_id: int) -> None:
        kept = once(events.select("txn_id", "event_ts", "card_id", "device_id", "merchant_id", "amount"))
        self._put(
            kept.withColumn("event_day", day_number(event_ms())), "events", batch_id, "event_day"
        )
        self._put(first_times(events), "first_seen", batch_id, "kind")

    def add_labels(self, labels: DataFrame, batch_id: int) -> None:
        kept = once(labels.select("label_ts", *[n for n in LABEL_STATE.names[:-1] if n != "label_ts"]))
        self._put(kept, "labels", batch_id)

    # ------------------------------------------------------------ read path

    def _table(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{table}"
        try:
            return spark.read.schema(schema).option("basePath", path).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def events(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        df = self._table(spark, "events", EVENT_STATE)
        return df if upto is None else df.filter(F.col("batch_id") <= upto)

    def labels(
        self, spark: SparkSession, upto: int | None = None, only: DataFrame | None = None
    ) -> DataFrame:
        """Every label once, by its earliest arrival; ``only`` (one column) keeps those of its keys.

        Keys are met before repeated labels are dropped, so only the labels asked for are shuffled.
        """
        df = self._table(spark, "labels", LABEL_STATE)
        df = df if upto is None else df.filter(F.col("batch_id") <= upto)
        df = df if only is None else df.join(only, only.columns[0], "left_semi")
        names = LABEL_STATE.names[1:-1]
        once = df.groupBy("txn_id").agg(F.min_by(F.struct(*names), "label_ts").alias("_l"))
        return once.select("txn_id", "_l.*")

    def first_seen(self, spark: SparkSession, kind: str, upto: int | None = None) -> DataFrame:
        df = self._sightings(spark).filter(F.col("kind") == kind)
        df = df if upto is None else df.filter(F.col("batch_id") <= upto)
        return df.groupBy("owner", "other").agg(F.min("first_ms").alias("first_ms"))

    def _sightings(self, spark: SparkSession) -> DataFrame:
        """First-seen folders, from the last folded one on."""
        folded = self._table(spark, "folded", FOLDED_STATE).agg(F.max("upto")).first()[0]
        df = self._table(spark, "first_seen", FIRST_STATE)
        return df if folded is None else df.filter(F.col("batch_id") >= folded)

    def compact_first_seen(self, spark: SparkSession, upto: int, as_of_ms: int | None = None) -> None:
        """Fold batches up to ``upto`` into one folder; forget keys not seen for the lifetime.

        Call between batches. Folded times go in as batch ``upto``; then a marker tells readers to
        skip older folders, which may be deleted. Folding again, or failing in between, is harmless.
        """
        df = self._sightings(spark).filter(F.col("batch_id") <= upto)
        folded = df.groupBy("owner", "other", "kind").agg(
            F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
        )
        if as_of_ms is not None and self.lifetime_days is not None:
            folded = folded.filter(F.col("last_ms") >= as_of_ms - self.lifetime_days * DAY_MS)
        self._put(materialize(folded), "first_seen", upto, "kind")
        self._put(spark.createDataFrame([(upto,)], "upto long"), "folded", upto)

    # ------------------------------------------------------------ evaluation

    def features(
        self,
        rows: DataFrame,
        *,
        upto: int | None = None,
        label_strength: float = 100.0,
        policy: SkewPolicy = SkewPolicy(),
    ) -> DataFrame:
        """All features of ``rows`` as of their own event times, from the state alone.

        The window features run through the same operators as the batch table. History is read by
        event-day partitions reaching 30 days back from the earliest row, and only for cards and
        devices that occur in ``rows``.
        """
        spark = rows.sparkSession
        asked = materialize(once(rows.select(*EVENT_STATE.names[:6])))
        first = asked.agg(F.min(event_ms())).first()[0]
        past = self.events(spark, upto)
        if self.trim_history and first is not None:
            past = past.filter(F.col("event_day") >= (first - DEVIATION_WINDOW_MS) // DAY_MS)
        past = past.select(*EVENT_STATE.names[:6]).join(asked.select("txn_id"), "txn_id", "left_anti")
        raw = _rows(asked)

        def context(keys: DataFrame) -> DataFrame:
            """History of some keys: met first, repeated rows dropped after, in a table of their size."""
            met = once(past.join(keys, keys.columns[0], "left_semi"))
            return _rows(met).withColumn("_asks", F.lit(False))

        cards = asked.select("card_id").distinct()
        mine = raw.unionByName(context(cards).select(*raw.columns))
        with_labels = _with_fraud_labels(mine, self.labels(spark, upto, cards))
        staged = behaviour(
            with_labels,
            "card_id",
            "_ms",
            [*CARD_SUMS, CARD_LABEL_SUM],
            CARD_SETS,
            asks="_asks",
            policy=policy,
            busy=busy_keys(mine, "card_id", "_ms", policy),
        )
        devices = asked.filter(F.col("device_id").isNotNull()).select("device_id").distinct()
        near = context(devices)
        keyed = staged.unionByName(near, allowMissingColumns=True).withColumn(
            "_device", F.coalesce("device_id", F.concat(F.lit("none:"), F.col("txn_id")))
        )
        staged = behaviour(
            keyed,
            "_device",
            "_ms",
            DEVICE_SUMS,
            DEVICE_SETS,
            asks="_asks",
            policy=policy,
            busy=busy_keys(raw.unionByName(near), "device_id", "_ms", policy),
        )
        staged = self._with_first_seen(staged, upto)
        shops = asked.select("merchant_id").distinct()
        known = merchant_label_days(raw, self.labels(spark, upto, shops))
        staged = staged.withColumn("_day", day_number(F.col("_ms"))).join(
            known, ["merchant_id", "_day"], "left"
        )
        return staged.select("txn_id", *feature_columns(label_strength))

    def _with_first_seen(self, rows: DataFrame, upto: int | None) -> DataFrame:
        spark = rows.sparkSession
        nothing = F.lit("")
        wanted = {
            "_card_first": (CARD, F.col("card_id"), nothing),
            "_device_first": (DEVICE, F.col("device_id"), nothing),
            "_pair_first": (CARD_DEVICE, F.col("card_id"), F.col("device_id")),
            "_shop_first": (CARD_MERCHANT, F.col("card_id"), F.col("merchant_id")),
        }
        out = rows
        for name, (kind, owner, other) in wanted.items():
            firsts = self.first_seen(spark, kind, upto).withColumnRenamed("first_ms", name)
            out = (
                out.withColumn("owner", owner)
                .withColumn("other", other)
                .join(firsts, ["owner", "other"], "left")
                .drop("owner", "other")
            )
            out = out.withColumn(name, F.least(F.col(name), F.col("_ms")))
        return out
