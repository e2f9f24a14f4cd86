"""Reading and writing event tables, and the transaction views over the provided star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.columns import cents, event_ms, unit_uniform

# The canonical event columns.
CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.StringType(), False),
        T.StructField("event_ts", T.TimestampType(), False),
        T.StructField("card_id", T.StringType(), False),
        T.StructField("device_id", T.StringType(), True),
        T.StructField("merchant_id", T.StringType(), False),
        T.StructField("merchant_category", T.StringType(), False),
        T.StructField("ip", T.StringType(), True),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("is_fraud", T.BooleanType(), True),
    ]
)
REQUIRED_NOT_NULL = tuple(f.name for f in CANONICAL_SCHEMA.fields if not f.nullable)

# Raw CSV columns that are text even when they look like numbers.
RAW_TEXT_COLUMNS = (
    "ProductCD",
    "card4",
    "card6",
    "P_emaildomain",
    "R_emaildomain",
    *(f"M{i}" for i in range(1, 10)),
    *(f"id_{i}" for i in (12, 15, 16, 23, 27, 28, 29, 30, 31, 33, 34, 35, 36, 37, 38)),
    "DeviceType",
    "DeviceInfo",
)
RAW_INTEGER_COLUMNS = ("TransactionID", "isFraud", "TransactionDT")
MONEY_COLUMNS = ("TransactionAmt",)


def read_events(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; only the selected columns reach the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_events(events: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Zstd Parquet, one folder per UTC event date, so a date range prunes files.

    A date's rows are spread over several writers by ``txn_id``: a busy day is not one task.
    """
    dated = events.withColumn("event_date", F.to_date("event_ts"))
    spread = F.pmod(F.xxhash64("txn_id"), F.lit(32))
    (
        dated.repartition("event_date", spread)
        .sortWithinPartitions("event_date", "event_ts", "txn_id")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("event_date")
        .parquet(path)
    )


def raw_schema(header: Sequence[str]) -> T.StructType:
    """An explicit CSV schema: inference would read the whole input twice."""

    def kind(name: str) -> T.DataType:
        if name in RAW_TEXT_COLUMNS:
            return T.StringType()
        if name in RAW_INTEGER_COLUMNS:
            return T.LongType()
        return T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in header])


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw CSV with text columns kept as text and all float columns but money narrowed."""
    header = spark.read.option("header", True).csv(path).columns
    return narrow_floats(spark.read.schema(raw_schema(header)).option("header", True).csv(path))


def narrow_floats(df: DataFrame, keep: Sequence[str] = MONEY_COLUMNS) -> DataFrame:
    """Cast every double column to float, except money."""
    return df.select(
        *[
            F.col(f.name).cast("float").alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _draw(key: Column) -> Column:
    return unit_uniform("fraud", key)


def lineitem_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as card transactions: one card per customer, one merchant per supplier."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    money = cents(F.col("l_extendedprice"))
    second = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(86400))
    txn = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        money.cast("string"),
    )
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = joined.select(
        txn.alias("txn_id"),
        F.timestamp_millis(event_ms("l_shipdate") + second.cast("bigint") * 1000).alias("event_ts"),
        F.concat(F.lit("c_"), F.col("o_custkey").cast("string")).alias("card_id"),
        F.when(
            F.col("l_partkey") % 20 != 0,
            F.concat(F.lit("d_"), (F.col("l_partkey") % 4000).cast("string")),
        ).alias("device_id"),
        F.concat(F.lit("m_"), F.col("l_suppkey").cast("string")).alias("merchant_id"),
        F.col("l_returnflag").alias("merchant_category"),
        F.lit(None).cast("string").alias("ip"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("ecom").alias("channel"),
        money.alias("_cents"),
        F.col("l_quantity").alias("attr_C1"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("attr_D1"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("attr_M4"),
        F.when(F.col("l_linenumber") == 1, F.col("l_tax")).alias("attr_V1"),
    )
    rate = F.when(F.col("_cents") > 9_000_000, 0.12).otherwise(0.015)
    return base.select(
        *CANONICAL_SCHEMA.names[:-1],
        (_draw(F.col("txn_id")) < rate).alias("is_fraud"),
        "attr_C1",
        "attr_D1",
        "attr_M4",
        "attr_V1",
    )


def stream_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as card transactions: one card per user."""
    return event_transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_transactions(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    txn = F.concat(F.lit("ev-"), F.col("event_id").cast("string"))
    return events.filter(F.col("value") > 0).select(
        txn.alias("txn_id"),
        F.timestamp_millis(event_ms("ts")).alias("event_ts"),
        F.concat(F.lit("c_"), F.col("user_id").cast("string")).alias("card_id"),
        F.when(k % 20 != 0, F.concat(F.lit("d_"), k.cast("string"))).alias("device_id"),
        F.concat(F.lit("m_"), (F.col("event_id") % 37).cast("string")).alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        F.lit(None).cast("string").alias("ip"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("ecom").alias("channel"),
        (_draw(txn) < 0.04).alias("is_fraud"),
    )
