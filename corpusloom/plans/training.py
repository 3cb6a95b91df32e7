"""Queries of training telemetry, conversion and reports that need more than a rate: token rates, utilisation, times, progress, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L
from corpusloom.functions import text as X
from corpusloom.functions.text import SQL
from corpusloom.operators import checkpoints as P
from corpusloom.operators import telemetry as T
from corpusloom.plans.common import long, rows, sql_rows, table
from corpusloom.plans.runs import _IT, _W, _iterations

WINDOW, WORLD, AVAILABLE = 2, 4, 312e12


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterations with cumulative samples, seconds and tokens, and the operations of each batch."""
    it = _iterations(spark, sf_dir).withColumns({"samples": F.col("iter") * 8, "clock": F.col("us") / 1e6, "own": F.floor(F.col("loss") * 1000).cast("long") + 1})
    it = T.running_total(it, "user_id", "iter", "own", "lengths")
    return it.withColumn("flops", F.col("own") * F.lit(1e9))


def rolling_token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second of all devices, and tokens so far, over full windows."""
    out = T.rolling(_run(spark, sf_dir), "user_id", "iter", "samples", "clock", WINDOW, lengths="lengths", world=WORLD)
    return out.select("user_id", "iter", F.round("batches_per_sec", 9).alias("batches_per_sec"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"), F.round("total_tokens", 6).alias("total_tokens"))


def rolling_flops_mfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations a second of all devices, and the share of what one of them could do."""
    out = T.rolling(_run(spark, sf_dir), "user_id", "iter", "samples", "clock", WINDOW, flops="flops", world=WORLD, available=AVAILABLE)
    return out.select("user_id", "iter", F.round("flops_per_sec", 3).alias("flops_per_sec"), F.round("mfu", 15).alias("mfu"))


def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of training and validation (every third iteration counts as one) so far, in each unit."""
    third = F.col("iter") % 3 == 0
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("loss"))), F.lit(0.0))
    out = _iterations(spark, sf_dir).groupBy("user_id").agg(total(~third).alias("t"), total(third).alias("v"))
    units = [F.struct(F.lit(u).alias("unit"), *[F.round(c, 9).alias(n) for n, c in T.elapsed(F.col("t"), F.col("v"), u).items()]) for u in T.UNITS]
    return out.select("user_id", F.inline(F.array(*units)))


_EPOCHS = [(1000, 1, 2, 40), (1000, 1, 0, 62), (7, 1, 1, 1), (1000, 2, 3, 25), (1000, 4, 1, 1)]


def epoch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its epoch a checkpoint's step lies, and how its name tells it."""
    c = rows(spark, "n epoch accumulate step", _EPOCHS)
    pct = T.epoch_progress(F.col("n"), 8, 2, F.col("accumulate"), F.col("epoch"), F.col("step"))
    return c.select(long("n").alias("n"), long("epoch").alias("epoch"), long("step").alias("step"), F.round(pct, 9).alias("percent"), T.position_label(pct, F.col("epoch")).alias("label"))


def expected_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that masking is expected to choose in each language's rows of 64, as rows times length times probability."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("rows"))
    return n.select("lang", "rows", F.round(F.col("rows") * 64 * F.lit(0.15), 6).alias("expected"))


_MODELS = ["gpt2-xl", "meta-Llama-3-8B", "t5-small", "bert-base", "roberta-large", "facebook/opt-1.3b", "bigscience/bloom", "tiiuae/Falcon-7b", "Mistral-7B", "mamba", ""]


def layer_class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer class that a model's name leads to; the first fragment wins, so roberta counts as bert."""
    return rows(spark, "model", [(m,) for m in _MODELS]).select("model", T.layer_class(F.col("model")).alias("layer_class"))


def tpu_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "generation flops", [(k, float(v)) for k, v in L.TPU_FLOPS.items()])


def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints (here orders) of each run that could be converted: how many, which failed, the share."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") != "P").alias("ok"))
    return P.conversion_summary(o, "run", "ok")


def sample_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest and number of the word lengths of the first 100 documents by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(100)
    sizes = F.transform(X.words(F.col("text")), lambda w: long(F.length(w)))
    return d.select("doc_id", F.array_min(sizes).alias("least"), F.array_max(sizes).alias("largest"), long(F.size(sizes)).alias("size"))


def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the extension of their path, none as such, with shares."""
    ext = F.lower(F.regexp_extract(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), r"\.([A-Za-z0-9]+)/*$", 1))
    n = table(spark, sf_dir, "pages").select(F.when(ext == "", F.lit("none")).otherwise(ext).alias("ext")).groupBy("ext").agg(F.count("*").alias("files"))
    return n.select("ext", "files", (F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(0)))).alias("share"))


def tokens_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, characters and lines against each other for each language, and how the efficiency is called."""
    t = F.col("text")
    n = table(spark, sf_dir, "documents").select("lang", X.word_count(t).alias("w"), long(F.length(t)).alias("c"), X.line_count(t).alias("l"))
    a = n.groupBy("lang").agg(F.sum("w").alias("w"), F.sum("c").alias("c"), F.sum("l").alias("l"))
    per = F.coalesce(F.try_divide("w", "c"), F.lit(0.0))
    label = F.when(per < 0.3, "efficient").when(per < 0.4, "good").when(per < 0.5, "moderate").otherwise("poor")
    return a.select("lang", F.round(per, 9).alias("tokens_per_char"), F.round(F.coalesce(F.try_divide("w", "l"), F.lit(0.0)), 9).alias("tokens_per_line"), F.expr("w div 1024").alias("chunks"), label.alias("efficiency"))


def over_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language with more than 512 words: how many, and the percentage."""
    w = X.word_count(F.col("text"))
    n = table(spark, sf_dir, "documents").select("lang", (w > 512).alias("over"))
    return n.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if("over").alias("over"), F.round(F.count_if("over") * 100 / F.count("*"), 9).alias("pct"))


def key_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows of each key as a percentage of all rows that came through, which can be over 100."""
    d = table(spark, sf_dir, "documents").select("lang", (X.word_count(F.col("text")) >= 50).alias("ok"))
    n = d.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if("ok").alias("kept"))
    whole = F.sum("kept").over(Window.partitionBy(F.lit(0)))
    return n.select("lang", "rows", "kept", F.round(F.coalesce(F.try_divide(F.col("rows") * 100, whole), F.lit(0.0)), 9).alias("pct"))


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as reports show them: thousands with commas, percent, fixed decimals."""
    o = table(spark, sf_dir, "nation").select(long("n_nationkey").alias("k"))
    n = (F.col("k") * F.col("k") * 12345 + 678).cast("long")
    return o.select("k", F.format_number(n, 0).alias("thousands"), F.format_string("%.1f%%", (F.col("k") * 100 / 37).cast("double")).alias("percent"), F.format_string("%.3f", (n / 1024).cast("double")).alias("fixed"))


#: Texts that each quality rule is about, and some that just don't reach it.
_CASES = [
    (1, "empty", ""), (2, "blank", " \n\t "), (3, "digits", "1 " * 60), (4, "few letters", "a" + "1 " * 60), (5, "short digits", "12345"),
    (6, "foreign run", "text " + "д" * 50 + " text"), (7, "short foreign run", "text " + "д" * 49 + " text"), (8, "symbol run", "text " + "=" * 50), (9, "repeat", "text " + "z" * 51),
    (10, "short repeat", "text " + "z" * 50), (11, "replacement", "text � here"), (12, "y with dots", "text ÿ here"), (13, "thorn", "text þ here"), (14, "clean", "a usual text of some words"),
]


def quality_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules over texts made for them."""
    t = F.col("text")
    return rows(spark, "case_id name text", _CASES).select("case_id", "name", F.coalesce(X.quality_category(t), F.lit("clean")).alias("category"), X.title(F.coalesce(X.quality_category(t), F.lit("clean"))).alias("title"))


def problem_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The problem report over the same texts, five to a source: how many of each category, which ones, the first."""
    bad = rows(spark, "case_id name text", _CASES).select(F.concat(F.lit("src"), F.expr("case_id div 5").cast("string")).alias("source"), "name", X.quality_category(F.col("text")).alias("category")).filter("category IS NOT NULL")
    return bad.groupBy("category", "source").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


_JSONS = [(1, '{"text": "hello \\u00e9", "n": 1}'), (2, '{"text": 7}'), (3, '{"text": ["a"]}'), (4, '{"other": "x"}'), (5, "[1, 2]"), (6, "not json"), (7, '{"text": ""}'), (8, None), (9, '{"text": null}')]


def json_text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text at a key over rows of every kind: only strings count."""
    from corpusloom.sources.files import json_text

    return rows(spark, "row_id value", _JSONS).select("row_id", json_text(F.col("value"), "text").alias("text"))


def language_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that each document's function words show, for each stated language: documents and mean confidence."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("stated"), X.language(F.col("text")).alias("l"))
    return d.groupBy("stated", F.col("l.lang").alias("detected")).agg(F.count("*").alias("files"), F.round(F.avg("l.confidence"), 9).alias("confidence"))


QUERIES = {f.__name__: f for f in (rolling_token_rate, rolling_flops_mfu, elapsed_times, epoch_progress, expected_masked, layer_class_lookup, tpu_flops, conversion_summary, sample_extremes, extension_histogram, tokens_per_unit, over_length, key_contribution, number_formats, quality_cases, problem_cases, json_text_cases, language_detected)}

_RUN = f"{_IT}, r AS (SELECT *, iter * 8 AS samples, us / 1e6::DOUBLE AS clock, floor(loss * 1000)::BIGINT + 1 AS own FROM it), u AS (SELECT *, sum(own) OVER (PARTITION BY user_id ORDER BY iter ROWS UNBOUNDED PRECEDING)::BIGINT AS lengths, own * 1e9::DOUBLE AS flops FROM r)"
_FULL = _W.format(WINDOW)
_LAYER = "CASE " + " ".join(f"WHEN contains(lower(model), '{f}') THEN '{n}'" for f, n in L.LAYER_CLASSES) + " END"
_ALL_CASES = sql_rows("case_id name text", _CASES)
_PER = "greatest(1, (n // 16) // greatest(accumulate, 1))"

ORACLES = {
    "rolling_token_rate": f"WITH {_RUN}, w AS (SELECT *, count(*) {_FULL} AS c, samples - first_value(samples) {_FULL} AS ds, clock - first_value(clock) {_FULL} AS dt, (lengths - first_value(lengths) {_FULL}) / {WINDOW} AS each FROM u) "
    f"SELECT user_id, iter, round({WINDOW} / nullif(dt, 0), 9) AS batches_per_sec, round(ds * {WORLD} / nullif(dt, 0) * each, 6) AS tokens_per_sec, round(each * {WORLD} * samples, 6) AS total_tokens FROM w WHERE c = {WINDOW + 1}",
    "rolling_flops_mfu": f"WITH {_RUN}, w AS (SELECT *, count(*) {_FULL} AS c, clock - first_value(clock) {_FULL} AS dt, (sum(flops) {_FULL} - first_value(flops) {_FULL}) * {WORLD} AS done FROM u) "
    f"SELECT user_id, iter, round(done / nullif(dt, 0), 3) AS flops_per_sec, round(done / nullif(dt, 0) / {WORLD} / {AVAILABLE}::DOUBLE, 15) AS mfu FROM w WHERE c = {WINDOW + 1}",
    "elapsed_times": f"WITH {_IT}, s AS (SELECT user_id, coalesce(sum(loss) FILTER (iter % 3 <> 0), 0) AS t, coalesce(sum(loss) FILTER (iter % 3 = 0), 0) AS v FROM it GROUP BY 1) "
    "SELECT user_id, unit, round(t / d, 9)::DOUBLE AS time_train, round(v / d, 9)::DOUBLE AS time_val, round((t + v) / d, 9)::DOUBLE AS time_total FROM s, (VALUES ('seconds', 1), ('minutes', 60), ('hours', 3600), ('days', 86400)) u(unit, d)",
    "epoch_progress": f"SELECT n::BIGINT AS n, epoch::BIGINT AS epoch, step::BIGINT AS step, round((step - (epoch - 1) * {_PER}) / {_PER} * 100, 9)::DOUBLE AS percent, format('{{:.1f}}% of epoch {{}}', ((step - (epoch - 1) * {_PER}) / {_PER} * 100)::DOUBLE, epoch) AS label FROM {sql_rows('n epoch accumulate step', _EPOCHS)}",
    "expected_masked": "SELECT lang, count(*) AS rows, round(count(*) * 64 * 0.15::DOUBLE, 6) AS expected FROM documents GROUP BY 1",
    "layer_class_lookup": f"SELECT model, {_LAYER} AS layer_class FROM {sql_rows('model', [(m,) for m in _MODELS])}",
    "tpu_flops": "SELECT generation, flops::DOUBLE AS flops FROM (VALUES ('v2', 45000000000000), ('v3', 123000000000000), ('v4', 275000000000000)) v(generation, flops)",
    "conversion_summary": "SELECT o_orderpriority AS run, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'P') AS failed, round(count(*) FILTER (o_orderstatus <> 'P') * 100 / count(*), 9)::DOUBLE AS ok_pct FROM orders GROUP BY 1",
    "sample_extremes": f"SELECT doc_id, list_min(s) AS least, list_max(s) AS largest, len(s)::BIGINT AS size FROM (SELECT doc_id, list_transform({SQL.words('text')}, lambda w: length(w)::BIGINT) AS s FROM documents ORDER BY doc_id LIMIT 100)",
    "extension_histogram": r"WITH n AS (SELECT CASE WHEN e = '' THEN 'none' ELSE e END AS ext, count(*) AS files FROM (SELECT lower(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)/*$', 1)) AS e FROM pages) GROUP BY 1) SELECT ext, files, (files / sum(files) OVER ())::DOUBLE AS share FROM n",
    "tokens_per_unit": f"WITH a AS (SELECT lang, sum(len({SQL.words('text')})) AS w, sum(length(text)) AS c, sum({SQL.lines('text')}) AS l FROM documents GROUP BY 1) SELECT lang, round(coalesce(w / nullif(c, 0), 0), 9)::DOUBLE AS tokens_per_char, round(coalesce(w / nullif(l, 0), 0), 9)::DOUBLE AS tokens_per_line, (w // 1024)::BIGINT AS chunks, "
    "CASE WHEN coalesce(w / nullif(c, 0), 0) < 0.3 THEN 'efficient' WHEN w / c < 0.4 THEN 'good' WHEN w / c < 0.5 THEN 'moderate' ELSE 'poor' END AS efficiency FROM a",
    "over_length": f"SELECT lang, count(*) AS rows, count(*) FILTER (len({SQL.words('text')}) > 512) AS over, round(count(*) FILTER (len({SQL.words('text')}) > 512) * 100 / count(*), 9)::DOUBLE AS pct FROM documents GROUP BY 1",
    "key_contribution": f"WITH n AS (SELECT lang, count(*) AS rows, count(*) FILTER (len({SQL.words('text')}) >= 50) AS kept FROM documents GROUP BY 1) SELECT lang, rows, kept, round(coalesce(rows * 100 / nullif(sum(kept) OVER (), 0), 0), 9)::DOUBLE AS pct FROM n",
    "number_formats": "SELECT n_nationkey::BIGINT AS k, format('{:,}', n_nationkey::BIGINT * n_nationkey * 12345 + 678) AS thousands, printf('%.1f%%', n_nationkey * 100 / 37::DOUBLE) AS percent, printf('%.3f', (n_nationkey::BIGINT * n_nationkey * 12345 + 678) / 1024::DOUBLE) AS fixed FROM nation",
    "quality_cases": f"SELECT case_id, name, c AS category, CASE c WHEN 'empty_files' THEN 'Empty Files' WHEN 'clean' THEN 'Clean' ELSE 'Garbled Content' END AS title FROM (SELECT case_id, name, coalesce({SQL.category('text')}, 'clean') AS c FROM {_ALL_CASES})",
    "problem_cases": f"SELECT category, source, count(*) AS files, array_to_string(list_sort(list(name)), ', ') AS names FROM (SELECT 'src' || (case_id // 5) AS source, name, {SQL.category('text')} AS category FROM {_ALL_CASES}) WHERE category IS NOT NULL GROUP BY 1, 2",
    "json_text_cases": f"SELECT row_id, CASE WHEN json_valid(value) AND json_type(value, '$.text') = 'VARCHAR' THEN json_extract_string(value, '$.text') END AS text FROM {sql_rows('row_id value', _JSONS)}",
    "language_detected": f"WITH d AS (SELECT coalesce(lang, 'none') AS stated, {SQL.language('text')} AS l FROM documents) SELECT stated, l.lang AS detected, count(*) AS files, round(avg(l.confidence), 9) AS confidence FROM d GROUP BY 1, 2",
}
