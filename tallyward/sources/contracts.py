"""Contracts for event tables and JSON messages; problems are reported together, not one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.columns import finite_or_null
from tallyward.operators.evaluation import count_where
from tallyward.settings import ATTRIBUTE_PREFIX, CHANNELS
from tallyward.sources.tables import CANONICAL_SCHEMA, REQUIRED_NOT_NULL


class EventTableError(ValueError):
    """The table breaks the contract; the message lists every violation."""


def schema_violations(df: DataFrame) -> list[tuple[str, str]]:
    """Missing columns, wrong types, and extra columns without the vendor prefix."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    expected = {f.name: f.dataType for f in CANONICAL_SCHEMA.fields}
    found = [("missing_column", c) for c in expected if c not in kinds]
    found += [("wrong_type", c) for c, t in expected.items() if c in kinds and kinds[c] != t]
    found += [
        ("unexpected_column", c)
        for c in kinds
        if c not in expected and not c.startswith(ATTRIBUTE_PREFIX)
    ]
    return found


def value_violations(df: DataFrame) -> DataFrame:
    """(rule, n): nulls per required column, repeated ids and non-positive amounts.

    Row order is not a property of a distributed table, so sortedness is not part of the contract:
    every operator orders inside its own window.
    """
    rules = {
        **{f"null_{c}": count_where(F.col(c).isNull()) for c in REQUIRED_NOT_NULL},
        "non_positive_amount": count_where(F.col("amount") <= 0),
    }
    # Ids are counted by their own map-side aggregation, not as a set in one task.
    ids = df.groupBy("txn_id").agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    counted = df.agg(*[c.alias(name) for name, c in rules.items()])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])
    )
    return (
        counted.select(pairs.alias("_p"))
        .select("_p.rule", "_p.n")
        .unionByName(repeated.select(F.lit("repeated_txn_id").alias("rule"), "n"))
    )


def validate_event_table(df: DataFrame) -> None:
    problems = [f"{rule} {column}" for rule, column in schema_violations(df)]
    if not problems:
        bad = value_violations(df).filter("n > 0").collect()
        problems = [f"{r['rule']}: {r['n']}" for r in bad]
    if problems:
        raise EventTableError("; ".join(sorted(problems)))


# ---------------------------------------------------------------- messages

# Timestamps travel as text, so a missing zone can be told apart from UTC.
EVENT_MESSAGE = T.StructType(
    [
        *[
            T.StructField(f.name, T.StringType() if f.name == "event_ts" else f.dataType, True)
            for f in CANONICAL_SCHEMA.fields
        ],
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("_corrupt_record", T.StringType(), True),
    ]
)
LABEL_MESSAGE = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("card_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("event_ts", T.StringType()),
        T.StructField("label_ts", T.StringType()),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
# Text patterns of the wire format.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"
CURRENCY = r"^[A-Z]{3}$"
NOT_FINITE = r"^[+-]?(NaN|Infinity|inf)$"
MAX_ID = 128
MAX_CATEGORY = 16


def event_to_json(events: DataFrame, *, include_label: bool = False) -> DataFrame:
    """(card_id, value): one JSON message per row, keyed by card.

    The label is left out unless asked for; vendor attributes lose their prefix and go into a map,
    with NaN as null.
    """
    columns = [c for c in CANONICAL_SCHEMA.names if include_label or c != "is_fraud"]
    kinds = dict(events.dtypes)

    def attribute(name: str) -> Column:
        col = F.col(name)
        col = finite_or_null(col) if kinds[name] in ("double", "float") else col
        return col.cast("string")

    attributes = [c for c in events.columns if c.startswith(ATTRIBUTE_PREFIX)]
    if attributes:
        pairs = [
            x
            for c in attributes
            for x in (F.lit(c[len(ATTRIBUTE_PREFIX):]), attribute(c))
        ]
        packed = F.create_map(*pairs)
    else:
        packed = F.create_map().cast("map<string,string>")
    body = F.struct(
        *[
            F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)
            if c == "event_ts"
            else F.col(c)
            for c in columns
        ],
        packed.alias("attributes"),
    )
    return events.select("card_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def _id_ok(name: str) -> Column:
    return F.coalesce(F.length(name).between(1, MAX_ID), F.lit(False))


def _zoned(name: str) -> Column:
    text = F.col(name)
    ok = F.coalesce(text.rlike(ZONED), F.lit(False))
    return ok & F.try_to_timestamp(F.when(ok, text)).isNotNull()


def _moment(name: str) -> Column:
    return F.try_to_timestamp(F.when(_zoned(name), F.col(name)))


def _errors(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))


def _unknown_keys(value: str, schema: T.StructType) -> Column:
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    known = F.array(*[F.lit(f.name) for f in schema.fields if f.name != "_corrupt_record"])
    return F.size(F.array_except(keys, known)) == 0


def parsed_once(messages: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """``value`` and its fields.

    The parsed message leaves a generator: a later filter stays above it, where it would else be carried below the
    parsing and parse (and encode) the message again for every field that it names.
    """
    one = F.explode(F.array(F.from_json("value", schema, options)))
    return messages.select("value", one.alias("_m")).select("value", "_m.*")


def decode_events(messages: DataFrame, *, for_scoring: bool = False) -> DataFrame:
    """Parse and check messages: typed columns plus ``errors``, empty for a good message.

    ``for_scoring`` also refuses a label, which cannot exist yet at decision time.
    """
    parsed = parsed_once(messages, EVENT_MESSAGE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    amount = F.col("amount")
    values = F.coalesce(F.map_values("attributes"), F.array().cast("array<string>"))
    checks = {
        "malformed": F.col("_corrupt_record").isNull(),
        "unknown_field": _unknown_keys("value", EVENT_MESSAGE),
        "txn_id": _id_ok("txn_id"),
        "event_ts": _zoned("event_ts"),
        "card_id": _id_ok("card_id"),
        "device_id": F.col("device_id").isNull() | _id_ok("device_id"),
        "merchant_id": _id_ok("merchant_id"),
        "merchant_category": F.coalesce(
            F.length("merchant_category").between(1, MAX_CATEGORY), F.lit(False)
        ),
        "amount": F.coalesce(
            (amount > 0) & ~F.isnan(amount) & (amount < float("inf")), F.lit(False)
        ),
        "currency": F.coalesce(F.col("currency").rlike(CURRENCY), F.lit(False)),
        "channel": F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False)),
        "attributes": ~F.exists(values, lambda v: F.coalesce(v.rlike(NOT_FINITE), F.lit(False))),
    }
    if for_scoring:
        checks["is_fraud"] = F.col("is_fraud").isNull()
    return parsed.withColumn("errors", _errors(checks)).select(
        "value",
        *[
            _moment(c).alias(c) if c == "event_ts" else F.col(c)
            for c in CANONICAL_SCHEMA.names
        ],
        "attributes",
        "errors",
    )


def decode_labels(messages: DataFrame) -> DataFrame:
    """Parse and check label messages; a label may not precede its transaction."""
    parsed = parsed_once(messages, LABEL_MESSAGE, {"columnNameOfCorruptRecord": "_corrupt_record"})
    checks = {
        "malformed": F.col("_corrupt_record").isNull(),
        "unknown_field": _unknown_keys("value", LABEL_MESSAGE),
        "txn_id": _id_ok("txn_id"),
        "card_id": _id_ok("card_id"),
        "merchant_id": _id_ok("merchant_id"),
        "event_ts": _zoned("event_ts"),
        "label_ts": _zoned("label_ts"),
        "is_fraud": F.col("is_fraud").isNotNull(),
        "label_before_event": F.coalesce(_moment("label_ts") >= _moment("event_ts"), F.lit(True)),
    }
    return parsed.withColumn("errors", _errors(checks)).select(
        "value",
        "txn_id",
        "card_id",
        "merchant_id",
        _moment("event_ts").alias("event_ts"),
        _moment("label_ts").alias("label_ts"),
        "is_fraud",
        "errors",
    )


def labels_to_json(labels: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    body = F.struct(
        "txn_id",
        "card_id",
        "merchant_id",
        F.date_format("event_ts", stamp).alias("event_ts"),
        F.date_format("label_ts", stamp).alias("label_ts"),
        "is_fraud",
    )
    return labels.select("card_id", F.to_json(body).alias("value"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.size("errors") == 0).drop("errors", "value")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.size("errors") > 0).select("value", "errors")
