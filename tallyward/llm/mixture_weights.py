"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted into cells (source x language x topic) with their tokens. The cell weights are raked in turn
to the target marginals of source, language and topic until all three hold, and every document is kept with a
probability in proportion to its cell's weight over its tokens, decided by a keyed hash of its id.

Defined results: nulls in source, lang or the topic form a value of their own; a document without tokens weighs
nothing and is never drawn; an empty table gives an empty result; rows without id share one draw per text;
repeated rows share their draw. A target that names no existing value is rescaled away. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyward.session import materialize

DIMENSIONS = ("source", "lang", "topic")
MISSING = "<none>"


@dataclass(frozen=True)
class MixSettings:
    """``targets``: share of tokens by dimension and value; values that are not named share what is left in
    proportion to ``tokens ** flatten``; with 1 they keep their natural shares, with 0 they become equal."""

    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    flatten: Mapping[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})
    keep: float = 0.5  # expected share of all tokens to keep; less if a cell would need more than it has
    sweeps: int = 8
    seed: str = "mix-1"


def topic_of(text: Column) -> Column:
    """A coarse topic by content form: table, list of marks, credentials, short note or prose."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("&&&")), "markup")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("token = ")), "contact")
        .when(F.length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0))


def _measures(seed: str) -> list[Column]:
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("bigint")
    return [
        F.coalesce("source", F.lit(MISSING)).alias("source"),
        F.coalesce("lang", F.lit(MISSING)).alias("lang"),
        F.coalesce(topic_of(F.col("text")), F.lit(MISSING)).alias("topic"),
        tokens_of(F.col("text")).cast("bigint").alias("tokens"),
        ((hashed + 0.5) / F.lit(float(1 << 48))).alias("draw"),
    ]


def weighed(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id``, the three dimensions, ``tokens`` and ``draw`` in (0, 1), without the text."""
    return docs.select("doc_id", *_measures(seed))


def marginal(cells: DataFrame, dimension: str, settings: MixSettings) -> DataFrame:
    """``dimension``, ``target``: the share of weight that each existing value is to get."""
    named = settings.targets.get(dimension, {})
    power = settings.flatten.get(dimension, 1.0)
    value = F.col(dimension)
    given = F.lit(None).cast("double")
    for name, share in sorted(named.items()):
        given = F.when(value == name, float(share)).otherwise(given)
    by_value = (
        cells.groupBy(dimension)
        .agg(F.sum("tokens").alias("tokens"))
        .select(dimension, given.alias("given"), F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("flat"))
    )
    total = by_value.agg(
        F.coalesce(F.sum("given"), F.lit(0.0)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("given").isNull(), F.col("flat"))), F.lit(0.0)).alias("flat"),
    ).first()  # one row of totals
    rest = max(0.0, 1 - total["given"])
    whole = total["given"] + (rest if total["flat"] else 0.0)
    raw = F.coalesce("given", F.lit(rest) * F.col("flat") / F.lit(total["flat"] or 1.0))
    return by_value.select(dimension, (raw / F.lit(whole or 1.0)).alias("target"))


def rake(cells: DataFrame, settings: MixSettings) -> DataFrame:
    """Cells with ``weight`` that meets the target marginals; weights add up to 1.

    Cells are counts, one row per combination that occurs, so a dimension's value is a small group here even
    where it holds a third of all documents.
    """
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        current = current.join(marginal(cells, d, settings).withColumnRenamed("target", f"target_{d}"), d)
    current = materialize(current)
    for _ in range(settings.sweeps):
        for d in DIMENSIONS:
            have = F.sum("weight").over(W.partitionBy(d))
            current = current.withColumn("weight", F.col("weight") * (F.col(f"target_{d}") / have))
        current = materialize(current)
    return current.drop(*[f"target_{d}" for d in DIMENSIONS])


def chances(rows: DataFrame, settings: MixSettings) -> DataFrame:
    """Per cell of ``rows``: ``probability`` of a document and ``cell_weight`` (the raked share of the cell)."""
    cells = materialize(rows.where("tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, settings).withColumn("density", F.col("weight") / F.col("tokens"))
    # kept tokens of a cell: scale * weight, never more than the cell has
    total = raked.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"), F.max("density").alias("d")).first()
    scale = min(settings.keep * total["t"] / total["w"], 1 / total["d"]) if total["t"] else 0.0
    return raked.select(
        *DIMENSIONS, (F.col("density") * F.lit(scale)).alias("probability"), F.col("weight").alias("cell_weight")
    )


def mix(docs: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """Drawn documents: ``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``, ``probability``, ``cell_weight``."""
    settings = settings or MixSettings()
    rows = materialize(weighed(docs, settings.seed).where("tokens > 0"))
    return (
        rows.join(chances(rows, settings), list(DIMENSIONS))
        .where(F.col("draw") < F.col("probability"))
        .select("doc_id", *DIMENSIONS, "tokens", "probability", "cell_weight")
    )


def mixed_documents(docs: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """Drawn rows of ``docs`` with all columns and ``mix_topic``, ``mix_tokens``, ``mix_probability``,
    ``mix_weight``; columns of these names are replaced."""
    settings = settings or MixSettings()
    added = ("mix_topic", "mix_tokens", "mix_probability", "mix_weight")
    columns = [F.col(c) for c in docs.columns if c not in added]
    cell = chances(weighed(docs, settings.seed), settings)
    marked = docs.select(*columns, F.struct(*_measures(settings.seed)).alias("_mix")).alias("d")
    same = [F.col(f"_mix.{d}") == cell[d] for d in DIMENSIONS]
    return (
        marked.join(cell, same)
        .where((F.col("_mix.tokens") > 0) & (F.col("_mix.draw") < F.col("probability")))
        .select(
            "d.*",
            F.col("_mix.topic").alias("mix_topic"),
            F.col("_mix.tokens").alias("mix_tokens"),
            F.col("probability").alias("mix_probability"),
            F.col("cell_weight").alias("mix_weight"),
        )
        .drop("_mix")
    )
