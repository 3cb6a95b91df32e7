"""Languages told by a classifier that is fitted on four fifths of the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.seeded import uniform_duckdb, uniform_sql
from corpusloom.operators import languages as M
from corpusloom.plans.common import table

SEED, TRAINING = 77, 0.8


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumn("held_out", F.expr(uniform_sql(f"concat('{SEED}-language-', doc_id)")) >= TRAINING)
    model = M.fit(docs.filter(~F.col("held_out")), "text", "lang")
    return docs.withColumn("d", M.detected(F.col("text"), model)).select("doc_id", "source", F.col("lang").alias("stated"), "held_out", F.col("d.lang").alias("lang"), "d.confidence")


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and how sure that is."""
    return _detected(spark, sf_dir).select("doc_id", "held_out", "lang", F.round("confidence", 6).alias("confidence"))


def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by stated language, whether the model was fitted on them, and the share that it tells right."""
    right = F.avg((F.col("lang") == F.col("stated")).cast("double"))
    return _detected(spark, sf_dir).filter("stated IS NOT NULL").groupBy("stated", "held_out").agg(F.count("*").alias("files"), F.round(right, 9).alias("right"))


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean confidence by language, for each source and for all."""
    d = _detected(spark, sf_dir)
    return d.rollup("lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("files"), F.round(F.avg("confidence"), 6).alias("confidence"))


_B = M.BUCKETS
_D = rf"""
t AS MATERIALIZED (
  SELECT doc_id, source, lang AS stated, {uniform_duckdb(f"'{SEED}-language-' || doc_id")} >= {TRAINING} AS held_out,
         list_transform(string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '\P{{L}}+', ' ', 'g')) || ' ', ''), lambda x: unicode(x)::BIGINT) AS c
  FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, (c[i] * {M.HASH[0]} + c[i + 1] * {M.HASH[1]} + c[i + 2]) % {_B} AS b, count(*) AS n
  FROM (SELECT doc_id, c, unnest(range(1, len(c) - 1)) AS i FROM t) GROUP BY ALL),
k AS (SELECT stated AS lang, b, sum(n) AS n FROM g JOIN t USING (doc_id) WHERE NOT held_out AND stated IS NOT NULL GROUP BY ALL),
p AS (SELECT stated AS lang, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM t WHERE NOT held_out AND stated IS NOT NULL GROUP BY 1),
s AS (SELECT lang, sum(n) AS total FROM k GROUP BY 1),
w AS MATERIALIZED (SELECT s.lang, x.b, ln((coalesce(k.n, 0) + {M.SMOOTH}) / (total + {M.SMOOTH * _B})) AS w FROM s, (SELECT unnest(range({_B})) AS b) x LEFT JOIN k ON k.lang = s.lang AND k.b = x.b),
f AS (
  SELECT doc_id, lang, sum(n * w) / sum(n) * least(sum(n), {M.EVIDENCE}) + any_value(prior) AS score FROM g JOIN w USING (b) JOIN p USING (lang) GROUP BY ALL),
d AS (
  SELECT t.doc_id, source, stated, held_out, coalesce(l, '{M.UNKNOWN}') AS lang, coalesce(sure, 0) AS confidence
  FROM t LEFT JOIN (SELECT doc_id, arg_min(lang, struct_pack(a := -score, b := lang)) AS l, 1 / sum(exp(score - top)) AS sure
                    FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM f) GROUP BY doc_id) USING (doc_id))
"""

QUERIES = {f.__name__: f for f in (language_model, language_accuracy, language_histogram)}
ORACLES = {
    "language_model": f"WITH {_D} SELECT doc_id, held_out, lang, round(confidence, 6)::DOUBLE AS confidence FROM d",
    "language_accuracy": f"WITH {_D} SELECT stated, held_out, count(*) AS files, round(avg((lang = stated)::INT), 9) AS right FROM d WHERE stated IS NOT NULL GROUP BY ALL",
    "language_histogram": f"WITH {_D} SELECT lang, source, level::BIGINT AS level, files, confidence FROM (SELECT lang, source, grouping(lang, source) AS level, count(*) AS files, round(avg(confidence), 6)::DOUBLE AS confidence FROM d GROUP BY ROLLUP (lang, source))",
}
