"""A training corpus from raw documents: language, near copies, benchmark leaks, personal data, mixture.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns the columns of
``documents``; the last one adds topic, tokens, probability and weight. ``run`` writes each result as Parquet and
reads it again. Nulls, empty texts, repeated rows and extra columns have the results that the operators define;
rows that share an id are one document and stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import lang_mixture, leak_index, minhash_forest, mixture_weights, surrogates
from tallyward.llm.queries import DEMO_KEY
from tallyward.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which mixture inference names a language, which fills a missing ``lang``; texts without a letter
    go."""
    model = lang_mixture.fit(docs, lang_mixture.fold("doc_id", 3) != 1)
    return lang_mixture.keep_determined(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies (five-word shingles, similarity 0.8)."""
    found = minhash_forest.near_duplicates(docs, minhash_forest.ForestSettings(words=5, percent=80))
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leak_index.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; all documents stay."""
    count = "n_chars" if "n_chars" in docs.columns else None
    return surrogates.replace(docs, surrogates.SurrogateSettings(DEMO_KEY), count).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    return mixture_weights.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near copies", near_copies),
    ("benchmark leaks", leaks),
    ("personal data", personal_data),
    ("mixture", mixture),
]

#: Not expressible: language inference and the leak index are trained, surrogates resolve collisions in rounds.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
