"""Queries of reports: grades, validation, projections, rankings by other measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L
from corpusloom.functions import text as X
from corpusloom.functions.text import SQL
from corpusloom.operators import lexicon
from corpusloom.operators import report as R
from corpusloom.plans.common import long, rows, sql_rows, table

_VALUES = [(m, float(v)) for m, grades in R.GRADES.items() for g in grades[:-1] for v in (g[2] - 0.00001, g[2], g[2] + 0.00001)] + [("other", 1.0)]


def report_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grades of values just below, at and above every bound."""
    return rows(spark, "measure value", _VALUES).select("measure", "value", R.grade(F.col("measure"), F.col("value")).alias("grade"))


_TOTALS = [
    ("good", 10, 2, 1000, 200, 10, 10, 9, 500, 300), ("empty", 0, 0, 0, 0, 0, 0, 0, 0, 0), ("missing", None, None, None, None, None, None, None, None, None), ("other language", 10, 2, 1000, 200, 10, 10, 0, 0, 300),
    ("little", 10, 2, 1000, 200, 10, 10, 4, 99, None), ("just enough", 10, 2, 1000, 0, 10, 10, 5, 100, 1),
]
_NAMES = "name " + " ".join(R.TOTALS)


def _totals(spark: SparkSession) -> DataFrame:
    made = rows(spark, _NAMES, _TOTALS)
    return made.select("name", *[long(c).alias(c) for c in R.TOTALS])


def validation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of validation over totals made for them."""
    return R.validated(_totals(spark))


def validation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.verdicts(_totals(spark))


def analysis_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the analysis of the documents is valid, and what it is warned of; one pass over the texts."""
    t = F.col("text")
    d = table(spark, sf_dir, "documents").select("source", "lang", long(F.length(t)).alias("c"), X.word_count(t).alias("w"), lexicon.hits(F.lower(t), L.REGIONAL_TERMS).alias("found")).withColumn("h", lexicon.totals("found"))
    total = lambda c: long(F.coalesce(F.sum(c), F.lit(0)))
    a = d.agg(F.count("*").alias("files"), F.count_distinct("source").alias("dirs"), total("c").alias("chars"), total("w").alias("words"), F.count("*").alias("analysed"), F.count("lang").alias("detected"), F.count_if(F.col("lang") == "es").alias("wanted"), total("h").alias("terms"), total("w").alias("tokens"))
    return R.verdicts(a)


def training_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of each language come to in tokens, gigabytes and optimizer steps."""
    t = F.col("text")
    n = table(spark, sf_dir, "documents").select("lang", long(F.length(t)).alias("c"), X.word_count(t).alias("w")).groupBy("lang").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    p = R.projection(F.col("c"), F.coalesce(F.try_divide("w", "c"), F.lit(0.0)), 4, 16, 64, 2)
    return n.select("lang", *[F.round(v, 6).alias(k) if k not in ("tokens_per_step", "training_steps") else v.alias(k) for k, v in p.items() if k != "training_steps"], (F.col("w") * 2 / (4 * 16 * 64)).cast("long").alias("training_steps"))


def top_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sources with most words and the ten with most characters, ties by name."""
    t = F.col("text")
    n = table(spark, sf_dir, "documents").select("source", X.word_count(t).alias("words"), long(F.length(t)).alias("chars")).groupBy("source").agg(long(F.sum("words")).alias("words"), long(F.sum("chars")).alias("chars"))
    each = n.select("source", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("total")) for m in ("words", "chars")])))
    rank = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("total"), "source"))  # over sources, not documents
    return each.withColumn("rank", long(rank)).filter("rank <= 10")


def top_lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten regional terms found most often, and how many others were found."""
    hits = lexicon.by_term(table(spark, sf_dir, "documents"), F.lower("text"), L.REGIONAL_TERMS)
    more = hits.agg(F.greatest(F.count("*") - 10, F.lit(0)).alias("more"))
    return hits.orderBy(F.desc("hits"), "term").limit(10).join(F.broadcast(more))


_FOLDED = [(1, "ÀÉÎõü Ñandú"), (2, "ẤỒ ǻ ḗ"), (3, "ΆΈ ώ"), (4, "Ёлка й"), (5, "plain"), (6, "éä"), (7, "Ω ß ø ł"), (8, None)]


def folded_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case without marks, over several scripts."""
    return rows(spark, "case_id text", _FOLDED).select("case_id", X.fold(F.col("text")).alias("folded"))


QUERIES = {f.__name__: f for f in (report_grades, validation_cases, validation_verdicts, analysis_verdict, training_projection, top_by_measure, top_lexicon_terms, folded_cases)}


def _graded(grades: tuple) -> str:
    return " ".join(f"WHEN value {g[1]} {g[2]} THEN '{g[0]}'" for g in grades[:-1]) + f" ELSE '{grades[-1][0]}'"


_MADE = f"(SELECT name, {', '.join(f'{c}::BIGINT AS {c}' for c in R.TOTALS)} FROM {sql_rows(_NAMES, _TOTALS)})"


def _verdict(source: str, kept: str) -> str:
    listed = lambda s: f"array_to_string(list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, k, c in R.RULES if k == s)}], lambda x: x IS NOT NULL), ',')"
    issues = listed("issue")
    return f"SELECT {kept}{issues} AS issues, {listed('warning')} AS warnings, {issues} = '' AS valid FROM {source}"


_HITS = " + ".join(SQL.occurrences("lower(text)", t) for t in L.REGIONAL_TERMS)

ORACLES = {
    "report_grades": f"SELECT measure, value::DOUBLE AS value, CASE measure {' '.join(f'''WHEN '{m}' THEN CASE {_graded(g)} END''' for m, g in R.GRADES.items())} END AS grade FROM (SELECT measure, value::DOUBLE AS value FROM {sql_rows('measure value', _VALUES)})",
    "validation_cases": " UNION ALL ".join(f"SELECT name, '{n}' AS rule, '{s}' AS severity, coalesce({c}, false) AS raised FROM {_MADE}" for n, s, c in R.RULES),
    "validation_verdicts": _verdict(_MADE, "name, "),
    "analysis_verdict": _verdict(f"(SELECT count(*) AS files, count(DISTINCT source) AS dirs, coalesce(sum(length(text)), 0) AS chars, coalesce(sum(len({SQL.words('text')})), 0) AS words, count(*) AS analysed, count(lang) AS detected, count(*) FILTER (lang = 'es') AS wanted, coalesce(sum({_HITS}), 0) AS terms, coalesce(sum(len({SQL.words('text')})), 0) AS tokens FROM documents)", ""),
    "training_projection": f"WITH n AS (SELECT lang, sum(length(text)) AS c, sum(len({SQL.words('text')})) AS w FROM documents GROUP BY 1), p AS (SELECT lang, c, w, c * (w / c) AS t FROM n) SELECT lang, round(t, 6)::DOUBLE AS total_tokens, round(c / 1073741824, 6)::DOUBLE AS size_gb, round(t / (c / 1073741824), 6)::DOUBLE AS tokens_per_gb, 4096::BIGINT AS tokens_per_step, floor(w * 2 / 4096)::BIGINT AS training_steps, round(t * 2, 6)::DOUBLE AS exposures FROM p",
    "top_by_measure": f"WITH n AS (SELECT source, sum(len({SQL.words('text')}))::BIGINT AS words, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1), e AS (SELECT source, 'words' AS measure, words AS total FROM n UNION ALL SELECT source, 'chars', chars FROM n) SELECT source, measure, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY total DESC, source) AS rank FROM e) WHERE rank <= 10",
    "top_lexicon_terms": f"WITH h AS (SELECT term, sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term))::BIGINT AS hits FROM documents, (VALUES {', '.join(f'''('{t}')''' for t in L.REGIONAL_TERMS)}) v(term) GROUP BY 1 HAVING hits > 0) SELECT term, hits, greatest((SELECT count(*) FROM h) - 10, 0)::BIGINT AS more FROM h ORDER BY hits DESC, term LIMIT 10",
    "folded_cases": f"SELECT case_id, strip_accents(lower(text)) AS folded FROM {sql_rows('case_id text', _FOLDED)}",
}
