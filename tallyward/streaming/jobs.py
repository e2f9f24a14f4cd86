"""Structured Streaming jobs: feature builder, decisions under a daily budget, decision sink."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyward.functions.columns import day_number, event_ms
from tallyward.operators.decisions import decision_rows, decode_records
from tallyward.operators.policy import decide_by_expected_loss
from tallyward.operators.prep import latest_by_key
from tallyward.session import materialize, scratch_path
from tallyward.settings import REVIEW, CostModel
from tallyward.sources.contracts import accepted, decode_events, decode_labels, quarantined
from tallyward.streaming.ledger import BudgetLedger, numbered_folders
from tallyward.streaming.state import FeatureState, once, refuse_rewind


@dataclass(frozen=True)
class MessageSource:
    """Where messages come from: a Kafka topic, or JSON lines in a folder."""

    format: str = "text"
    path: str | None = None
    topic: str | None = None
    bootstrap: str | None = None
    max_files_per_batch: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        """A stream with a text column ``value``."""
        if self.format == "kafka":
            return (
                spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", self.bootstrap)
                .option("subscribe", self.topic)
                .option("startingOffsets", "earliest")
                .load()
                .select(F.col("value").cast("string").alias("value"))
            )
        reader = spark.readStream.format("text")
        if self.max_files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_batch)
        return reader.load(self.path).select("value")


def publish(messages: DataFrame, *, format: str = "text", path: str | None = None, **options: str) -> None:
    """Write ``(card_id, value)`` messages, keyed by card for Kafka."""
    if format == "kafka":
        keyed = messages.select(F.col("card_id").alias("key"), "value")
        keyed.write.format("kafka").options(**options).save()
    else:
        messages.select("value").write.mode("append").text(path)


def run_available(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything there is, batch by batch; offsets are committed after each write."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# ---------------------------------------------------------------- features


def ingest_events(state: FeatureState, quarantine: str | None = None) -> Callable:
    """A batch handler that keeps the feature state current from event messages."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        refuse_rewind(batch.sparkSession, f"{state.root}/events", batch_id)
        decoded = decode_events(batch)
        state.add_events(accepted(decoded), batch_id)
        if quarantine:
            quarantined(decoded).write.mode("overwrite").json(f"{quarantine}/batch_id={batch_id}")

    return handle


def ingest_labels(state: FeatureState, quarantine: str | None = None) -> Callable:
    def handle(batch: DataFrame, batch_id: int) -> None:
        refuse_rewind(batch.sparkSession, f"{state.root}/labels", batch_id)
        decoded = decode_labels(batch)
        state.add_labels(accepted(decoded), batch_id)
        if quarantine:
            quarantined(decoded).write.mode("overwrite").json(f"{quarantine}/batch_id={batch_id}")

    return handle


def build_features(state: FeatureState, output: str) -> Callable:
    """A batch handler that writes the state, then every new row's features as of its time.

    Rows are scored with what has arrived so far: late events are added to the state but never
    revise an earlier row's features.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        refuse_rewind(batch.sparkSession, f"{state.root}/events", batch_id)
        events = materialize(accepted(decode_events(batch)))
        state.add_events(events, batch_id)
        features = state.features(events, upto=batch_id)
        features.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return handle


def read_batches(spark: SparkSession, output: str, key: str = "txn_id") -> DataFrame:
    """All batches of a job's output; a redelivered row counts once, from its first batch."""
    df = spark.read.option("basePath", output).parquet(output)
    if "day" in df.columns:  # read from folder names
        df = df.withColumn("day", F.col("day").cast("bigint"))
    first = F.struct((-F.col("batch_id")).alias("_b"))
    rest = [c for c in df.columns if c not in (key, "batch_id")]
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*rest), first).alias("_r"))
        .select(key, "_r.*")
    )


# ---------------------------------------------------------------- decisions


def decide_batches(
    output: str, costs: CostModel, *, threshold: float, reviews_per_day: int, fold_every: int = 20
) -> Callable:
    """A batch handler that decides scored rows under the day's remaining review budget.

    Budget goes to micro-batches in order, then to rows in event order: the same as one batch run
    if batches arrive in event order. Batches after this one do not count as used, so a retry
    decides the same way. What was granted before comes from a ledger of small folds and deltas, and redelivered rows
    are found among the earlier decisions of the batch's own event days (a redelivered row keeps its event time): neither
    grows with the length of the stream.
    """
    ledger = BudgetLedger(f"{output}/_budget", fold_every)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        refuse_rewind(spark, output, batch_id)
        rows = materialize(
            once(batch)
            .withColumn("event_ms", event_ms())
            .withColumn("day", day_number(F.col("event_ms")))
        )
        days = [r["day"] for r in rows.select("day").distinct().limit(BATCH_DAYS + 1).collect()]
        earlier = _earlier_decisions(spark, output, batch_id, days)
        fresh = rows.join(earlier.select("txn_id"), "txn_id", "left_anti")
        decided = decide_by_expected_loss(
            fresh,
            costs,
            threshold=threshold,
            reviews_per_day=reviews_per_day,
            used=ledger.used(spark, batch_id),
        )
        path = f"{output}/batch_id={batch_id}"
        decided.select("txn_id", "day", "action", "capped", "expected_cost").write.mode("overwrite").partitionBy(
            "day"
        ).parquet(path)
        granted = spark.read.schema(DECIDED).option("basePath", output).parquet(path)
        spent = granted.filter(F.col("action") == REVIEW).groupBy("day").agg(F.count(F.lit(1)).alias("used"))
        ledger.commit(spent, batch_id)

    return handle


#: Event days of one batch whose folders are named to the reader; a batch of more days reads all days.
BATCH_DAYS = 400

DECIDED = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("capped", T.BooleanType()),
        T.StructField("expected_cost", T.DoubleType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("day", T.LongType()),
    ]
)


def _earlier_decisions(spark: SparkSession, output: str, batch_id: int, days: list[int]) -> DataFrame:
    if not any(n < batch_id for n in numbered_folders(spark, output, "batch_id")):
        return spark.createDataFrame([], DECIDED)
    df = spark.read.schema(DECIDED).option("basePath", output).parquet(output)
    df = df.filter(F.col("batch_id") < batch_id)
    return df.filter(F.col("day").isin(days)) if len(days) <= BATCH_DAYS else df


def sink_decisions(output: str) -> Callable:
    """A batch handler that stores decision records; a later batch overwrites by transaction."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        refuse_rewind(batch.sparkSession, output, batch_id)
        decision_rows(decode_records(batch)).write.mode("overwrite").parquet(
            f"{output}/batch_id={batch_id}"
        )

    return handle


def read_decisions(spark: SparkSession, output: str) -> DataFrame:
    df = spark.read.option("basePath", output).parquet(output)
    return latest_by_key(df, "txn_id", [F.col("batch_id"), F.col("scored_at")]).drop("batch_id")


def append_jsonl(messages: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    messages.select("value").write.mode("append").text(path)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"offsets-{name}")
