"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import (
    hamming_index,
    html_blocks,
    lang_mixture,
    leak_index,
    minhash_forest,
    mixture_weights,
    quality_net,
    repeated_lines,
    substring_dedup,
    surrogates,
    toxic_spans,
    whitening,
    word_runs,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_hamming_index(spark: SparkSession, sf: str) -> DataFrame:
    return hamming_index.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_minhash_forest(spark: SparkSession, sf: str) -> DataFrame:
    settings = minhash_forest.ForestSettings(words=2)
    return minhash_forest.near_duplicates(table(spark, sf, "documents"), settings)


def op3_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = lang_mixture.fold("doc_id", 3)
    found = lang_mixture.detect(docs, lang_mixture.fit(docs, part != 1))
    return found.select(
        "doc_id",
        F.coalesce(part == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        F.transform("languages", lambda x: x["lang"]).alias("languages"),
    )


def op4_leak_index(spark: SparkSession, sf: str) -> DataFrame:
    return leak_index.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_mixture_weights(spark: SparkSession, sf: str) -> DataFrame:
    drawn = mixture_weights.mix(table(spark, sf, "documents"))
    return drawn.withColumns({c: F.round(c, 9) for c in ("probability", "cell_weight")})


#: The registered queries' key; a production run takes its own from a secret store.
DEMO_KEY = "demonstration key"


def op6_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    settings = surrogates.SurrogateSettings(DEMO_KEY)
    done = surrogates.replace(table(spark, sf, "documents"), settings, count="n_chars")
    return done.select("doc_id", "text", "n_chars", "pii_replaced")


def op7_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    done = repeated_lines.deduplicate(table(spark, sf, "documents"))
    return done.withColumn("n_spans", F.size("removed").cast("long"))


def op8_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = html_blocks.extract(table(spark, sf, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_toxic_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = lang_mixture.fold("doc_id", 5)
    model = toxic_spans.fit(docs.where(part != 0), table(spark, sf, "labels"))
    return toxic_spans.score(docs, model).select(
        "doc_id",
        F.coalesce(part == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_tokens",
        "spans",
    )


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substring_dedup.deduplicate(table(spark, sf, "documents"))
    removed = F.transform("removed", lambda r: r["end"] - r["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one document in ten repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = split.withColumn("a", F.when(n > 0, (g % F.greatest(n, F.lit(1))).cast("int"))).withColumn(
        "p", (F.floor((n - F.col("a")) / (g % 8 + 3)) + 1).cast("int")
    )
    repeated = F.transform(
        "words",
        lambda w, i: F.when(i < F.col("a"), w).otherwise(
            F.get("words", F.col("a") + (i - F.col("a")) % F.greatest(F.col("p"), F.lit(1)))
        ),
    )
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", repeated)).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = word_runs.with_longest(word_runs.find_runs(made_periodic(table(spark, sf, "documents"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_net(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    part = lang_mixture.fold("doc_id", 3)
    model = quality_net.fit(docs, docs.where(part != 1), table(spark, sf, "labels"))
    return quality_net.score(docs, model).select(
        "doc_id",
        F.coalesce(part == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_index": op1_hamming_index,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_language_mixture": op3_language_mixture,
    "op4_leak_index": op4_leak_index,
    "op5_mixture_weights": op5_mixture_weights,
    "op6_surrogates": op6_surrogates,
    "op7_repeated_lines": op7_repeated_lines,
    "op8_html_blocks": op8_html_blocks,
    "op9_toxic_spans": op9_toxic_spans,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_word_runs": op12_word_runs,
    "op13_quality_net": op13_quality_net,
}

def _mix_sql(settings: mixture_weights.MixSettings) -> str:
    """The raking of ``mixture_weights`` unrolled into one WITH chain."""
    steps = [
        f"""rows AS (
  SELECT doc_id, coalesce(source, '<none>') AS source, coalesce(lang, '<none>') AS lang,
         CASE WHEN coalesce(length(text), 0) = 0 THEN '<none>' WHEN contains(text, ' | ') THEN 'table'
              WHEN contains(text, '###') OR contains(text, '&&&') THEN 'markup'
              WHEN contains(text, '@') OR contains(text, 'token = ') THEN 'contact'
              WHEN length(text) < 400 THEN 'note' ELSE 'prose' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS tokens,
         (CAST('0x' || substr(md5('{settings.seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))),
                              1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS draw
  FROM documents
),
kept AS (SELECT * FROM rows WHERE tokens > 0),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM kept GROUP BY ALL),
w0 AS (SELECT *, tokens AS weight FROM cells)"""
    ]
    for d in mixture_weights.DIMENSIONS:
        power = settings.flatten.get(d, 1.0)
        steps.append(
            f"""t_{d} AS (SELECT {d}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target
  FROM cells GROUP BY {d})"""
        )
    n = 0
    for _ in range(settings.sweeps):
        for d in mixture_weights.DIMENSIONS:
            steps.append(
                f"""w{n + 1} AS MATERIALIZED (
  SELECT w{n}.* EXCLUDE (weight), weight * (target / sum(weight) OVER (PARTITION BY w{n}.{d})) AS weight
  FROM w{n} JOIN t_{d} ON w{n}.{d} = t_{d}.{d})"""
            )
            n += 1
    return "WITH " + ",\n".join(steps) + f""",
scale AS (SELECT least({settings.keep} * sum(tokens) / sum(weight), 1 / max(weight / tokens)) AS scale FROM w{n})
SELECT doc_id, kept.source, kept.lang, kept.topic, kept.tokens,
       round(weight / w{n}.tokens * scale, 9) AS probability, round(weight, 9) AS cell_weight
FROM kept JOIN w{n} ON kept.source = w{n}.source AND kept.lang = w{n}.lang AND kept.topic = w{n}.topic, scale
WHERE draw < weight / w{n}.tokens * scale"""


#: DuckDB SQL where it can express the query on whole tables.
ORACLES: dict[str, str] = {
    "op1_hamming_index": """
WITH signs AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(list_zip(q.bits, x.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
  FROM signs q JOIN signs x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10""",
    "op5_mixture_weights": _mix_sql(mixture_weights.MixSettings()),
}
