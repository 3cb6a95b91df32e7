"""Corpus profile: structure, content, words, languages, lexicon, quality, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L
from corpusloom.functions import text as X
from corpusloom.functions.text import SQL
from corpusloom.operators import lexicon
from corpusloom.plans.common import long, rows, sql_rows, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def features(docs: DataFrame) -> DataFrame:
    """One pass over the texts: category, characters, words and lines of each document."""
    t = F.col("text")
    return docs.select("source", "lang", X.quality_category(t).alias("category"), long(F.length(t)).alias("chars"), X.word_count(t).alias("words"), X.line_count(t).alias("lines"))


_F = f"f AS (SELECT doc_id, source, lang, {SQL.category('text')} AS category, length(text) AS chars, len({SQL.words('text')}) AS words, {SQL.lines('text')} AS lines FROM documents)"


def _content(f: DataFrame) -> list:
    ok = F.col("category").isNull()
    kept = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).cast("long")
    return [long(F.count_if(ok)).alias("files"), kept("chars").alias("chars"), kept("words").alias("words"), kept("lines").alias("lines"), F.coalesce(F.avg(F.when(ok, F.col("chars"))), F.lit(0.0)).alias("mean_chars")]


_CONTENT = (
    "count(*) FILTER (category IS NULL)::BIGINT AS files, coalesce(sum(chars) FILTER (category IS NULL), 0)::BIGINT AS chars, coalesce(sum(words) FILTER (category IS NULL), 0)::BIGINT AS words, "
    "coalesce(sum(lines) FILTER (category IS NULL), 0)::BIGINT AS lines, coalesce(avg(chars) FILTER (category IS NULL), 0)::DOUBLE AS mean_chars"
)


def content_profile_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of clean documents for each source; sources without any show zeros."""
    f = features(_docs(spark, sf_dir))
    return f.groupBy("source").agg(*_content(f))


def content_profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each source and for all, in one pass."""
    f = features(_docs(spark, sf_dir))
    return f.rollup("source").agg(F.grouping("source").cast("long").alias("is_total"), *_content(f))


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, their share, and their rank (ties by name)."""
    n = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"))
    whole = Window.partitionBy(F.lit(0))
    return n.select("source", "files", (F.col("files") / F.sum("files").over(whole)).alias("share"), long(F.row_number().over(whole.orderBy(F.desc("files"), "source"))).alias("rank"))


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 sources with most documents, with how many are not shown."""
    n = _docs(spark, sf_dir).groupBy(F.col("source")).agg(F.count("*").alias("files"))
    more = n.agg(F.greatest(F.count("*") - 15, F.lit(0)).alias("more"))
    top = n.orderBy(F.desc("files"), "source").limit(15)
    return top.join(F.broadcast(more)).select(X.shortened(F.col("source"), 25).alias("label"), "files", "more")


def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"))
    return n.agg(long(F.count("*")).alias("sources"), F.try_divide(F.max("files"), F.min("files")).alias("balance"))


def char_histogram(spark: SparkSession, sf_dir: str, first: int | None = 1000) -> DataFrame:
    """Characters in the ``first`` of each document, as the SQL has it; None: in all."""
    text = F.col("text") if first is None else F.substring("text", 1, first)
    chars = _docs(spark, sf_dir).select(F.explode(F.split(text, "")).alias("char")).filter("char <> ''")
    return chars.groupBy("char").agg(F.count("*").alias("n"))


def char_histogram_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of whole documents."""
    return char_histogram(spark, sf_dir, None)


def word_length_hist(spark: SparkSession, sf_dir: str, first: int | None = 100) -> DataFrame:
    """Lengths of the ``first`` words of each document, as the SQL has it; None: of all."""
    words = X.words(F.col("text"))
    words = words if first is None else F.slice(words, 1, first)
    lengths = _docs(spark, sf_dir).select(F.explode(F.transform(words, lambda w: long(F.length(w)))).alias("length"))
    return lengths.groupBy("length").agg(F.count("*").alias("n"))


def word_length_hist_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of all words of each document."""
    return word_length_hist(spark, sf_dir, None)


def file_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.length("text")
    return _docs(spark, sf_dir).agg(long(F.count("*")).alias("files"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), long(F.max(c)).alias("longest"))


def file_size_hist50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 equal bins of the lengths; the last one is closed."""
    sizes = _docs(spark, sf_dir).select(F.length("text").cast("double").alias("c"))
    ends = sizes.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    bins = sizes.join(F.broadcast(ends)).select(F.least(F.floor((F.col("c") - F.col("lo")) * 50 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))), F.lit(49)).cast("long").alias("bin"))
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


def word_freq_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent folded words over two letters that aren't stop words, with rank; ties by word."""
    tokens = _docs(spark, sf_dir).select(F.explode(X.latin_words(X.fold(F.col("text")))).alias("word"))
    kept = tokens.filter((F.length("word") > 2) & ~F.col("word").isin(L.STOP_WORDS))
    top = kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)
    return top.select("word", "n", long(F.row_number().over(Window.orderBy(F.desc("n"), "word"))).alias("rank"))


def _language_name(code: str):
    out = F.upper(F.col(code))
    for k, v in L.LANGUAGE_NAMES.items():
        out = F.when(F.col(code) == k, F.lit(v)).otherwise(out)
    return out


_LANGUAGE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANGUAGE_NAMES.items()) + " ELSE upper(lang) END"


def language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language; those under 1 % together as Other."""
    n = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"))
    total = F.sum("files").over(Window.partitionBy(F.lit(0)))
    named = n.select(F.when(F.col("files") / total >= 0.01, _language_name("lang")).otherwise(F.lit("Other")).alias("language"), "files", total.alias("total"))
    return named.groupBy("language").agg(long(F.sum("files")).alias("files"), (F.sum("files") / F.max("total")).alias("share"))


def language_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("files"))
    return n.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy("source")))


def primary_language_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent language of each source; ties by code."""
    n = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("files"))
    best = n.groupBy("source").agg(F.min(F.struct((-F.col("files")).alias("n"), "lang")).alias("b"))
    return best.select("source", F.col("b.lang").alias("lang"), (-F.col("b.n")).alias("files"))


def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each regional term in lower-case texts, by source; terms without any are left out."""
    return lexicon.by_term(_docs(spark, sf_dir), F.lower("text"), L.REGIONAL_TERMS, "source")


def register_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formal and informal terms in all texts, and the register they show."""
    found = _docs(spark, sf_dir).select(lexicon.hits(F.lower("text"), L.FORMAL_TERMS + L.INFORMAL_TERMS).alias("h"))
    each = found.select(lexicon.totals("h", L.FORMAL_TERMS).alias("formal"), lexicon.totals("h", L.INFORMAL_TERMS).alias("informal"))
    n = each.agg(*[long(F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in ("formal", "informal")])
    share = F.try_divide(F.col("formal") * 100, F.col("formal") + F.col("informal"))
    label = F.when(share.isNull(), "none").when(share > 70, "formal").when(100 - share > 70, "informal").otherwise("mixed")
    return n.select("formal", "informal", F.round(share, 6).alias("formal_pct"), label.alias("register"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their words for each source; the mean is a ratio of sums."""
    s = _docs(spark, sf_dir).select("source", X.sentences(F.col("text")).alias("s"))
    n = s.select("source", long(F.size("s")).alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + X.word_count(x)).alias("words"))
    out = n.groupBy("source").agg(long(F.sum("sentences")).alias("sentences"), long(F.sum("words")).alias("words"))
    mean = F.coalesce(F.try_divide(F.col("words"), F.col("sentences")), F.lit(0.0))
    label = F.when(mean > 20, "high").when(mean > 15, "moderate").when(mean > 10, "lower").otherwise("simple")
    return out.select("source", "sentences", "words", mean.alias("mean_words"), label.alias("complexity"))


def char_quality_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the documents' share of special characters, and characters outside Latin, for each source."""
    t = F.col("text")
    d = _docs(spark, sf_dir).select("source", F.try_divide(X.special_count(t), F.length(t)).alias("ratio"), X.non_latin_count(t).alias("other"))
    return d.groupBy("source").agg(F.round(F.coalesce(F.avg("ratio"), F.lit(0.0)), 9).alias("special_ratio"), long(F.coalesce(F.sum("other"), F.lit(0))).alias("non_latin"))


def quality_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each category and source, with totals."""
    f = features(_docs(spark, sf_dir)).select("source", F.coalesce("category", F.lit("clean")).alias("category"))
    return f.rollup("category", "source").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("files"))


def problem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem documents for each category and source: how many, and a digest of their sorted ids."""
    t = F.col("text")
    bad = _docs(spark, sf_dir).select("source", long("doc_id").alias("doc_id"), X.quality_category(t).alias("category")).filter("category IS NOT NULL")
    return bad.groupBy("category", "source").agg(F.count("*").alias("files"), long(F.min("doc_id")).alias("first"), long(F.sum("doc_id")).alias("ids"), X.title(F.first("category")).alias("title"))


def repeated_char_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a character, other than a line feed, 51 or more times in a row."""
    return _docs(spark, sf_dir).select("doc_id", F.col("text").rlike(r"(.)\1{50,}").alias("repeated"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report ratios of the clean documents, with their labels."""
    f = features(_docs(spark, sf_dir)).filter("category IS NULL")
    a = f.agg(F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum("lines").alias("lines"))
    ratio = F.try_divide("chars", "words")
    lexical = F.when(ratio < 4, "short words").when(ratio < 6, "balanced").when(ratio < 8, "long words").otherwise("very long words")
    size = F.expr("chars div files")
    return a.select(long(size).alias("mean_chars"), F.round(ratio, 6).alias("chars_per_word"), F.round(F.try_divide("chars", "lines"), 6).alias("chars_per_line"), lexical.alias("lexical"), size.between(500, 50000).alias("size_ok"), F.round(ratio, 6).between(3, 8).alias("density_ok"))


def domain_description_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description for each source, by its name in lower case without slashes; a default where there is none."""
    known = {**L.DOMAIN_DESCRIPTIONS, "src0": "General web text", "src1": "News"}
    dim = rows(spark, "name description", list(known.items()))
    s = _docs(spark, sf_dir).select("source").distinct().withColumn("name", X.strip(F.replace(F.lower("source"), F.lit("/"), F.lit(""))))
    return s.join(F.broadcast(dim), "name", "left").select("source", F.coalesce("description", F.lit(L.DEFAULT_DESCRIPTION)).alias("description"))


def analysis_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues (fatal) and warnings that the profile's totals raise."""
    t = F.col("text")
    low = _docs(spark, sf_dir).select("source", "lang", long(F.length(t)).alias("chars"), X.word_count(t).alias("words"), lexicon.hits(F.lower(t), L.REGIONAL_TERMS).alias("h"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = low.withColumn("hits", lexicon.totals("h")).agg(F.count("*").alias("files"), F.count_distinct("source").alias("dirs"), total("chars").alias("chars"), total("words").alias("words"), F.count("lang").alias("detected"), F.count_if(F.col("lang") == "es").alias("spanish"), total("hits").alias("terms"))
    rules = [
        ("no_files", "issue", F.col("files") == 0),
        ("no_directories", "issue", F.col("dirs") == 0),
        ("no_content", "issue", F.col("chars") == 0),
        ("no_words", "warning", F.col("words") == 0),
        ("no_language", "warning", F.col("detected") == 0),
        ("no_spanish", "warning", (F.col("detected") > 0) & (F.col("spanish") == 0)),
        ("little_spanish", "warning", (F.col("spanish") > 0) & (F.col("spanish") * 2 < F.col("detected"))),
        ("no_terms", "warning", F.col("terms") == 0),
        ("few_terms", "warning", (F.col("terms") > 0) & (F.col("terms") < 100)),
    ]
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), c.alias("raised")) for n, s, c in rules])
    return a.select(F.inline(found))


_HITS = " + ".join(f"coalesce(sum({SQL.occurrences('lower(text)', t)}), 0)" for t in L.REGIONAL_TERMS)
_FORMAL = " + ".join(SQL.occurrences("low", t) for t in L.FORMAL_TERMS)
_INFORMAL = " + ".join(SQL.occurrences("low", t) for t in L.INFORMAL_TERMS)
_TERMS = ", ".join(f"('{t}')" for t in L.REGIONAL_TERMS)

QUERIES = {f.__name__: f for f in (content_profile_by_source, content_profile_rollup, structure_counts, top_sources, source_balance, char_histogram, char_histogram_whole, word_length_hist, word_length_hist_whole, file_size_stats, file_size_hist50, word_freq_top100, language_share, language_by_source, primary_language_per_source, lexicon_hits, register_balance, sentence_stats, char_quality_ratios, quality_category_counts, problem_report, repeated_char_flag, quality_labels, domain_description_join, analysis_validation)}

ORACLES = {
    "content_profile_by_source": f"WITH {_F} SELECT source, {_CONTENT} FROM f GROUP BY source",
    "content_profile_rollup": f"WITH {_F} SELECT source, grouping(source)::BIGINT AS is_total, {_CONTENT} FROM f GROUP BY ROLLUP (source)",
    "structure_counts": "SELECT source, n AS files, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, source) AS rank FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "top_sources": "WITH n AS (SELECT source, count(*) AS files FROM documents GROUP BY 1) SELECT CASE WHEN length(source) > 25 THEN left(source, 25) || '...' ELSE source END AS label, files, greatest((SELECT count(*) FROM n) - 15, 0)::BIGINT AS more FROM n ORDER BY files DESC, source LIMIT 15",
    "source_balance": "SELECT count(*) AS sources, max(n) / min(n) AS balance FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
    "char_histogram": "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(left(text, 1000), '')) AS char FROM documents) WHERE char <> '' GROUP BY 1",
    "char_histogram_whole": "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY 1",
    "word_length_hist_whole": f"SELECT length(w)::BIGINT AS length, count(*) AS n FROM (SELECT unnest({SQL.words('text')}) AS w FROM documents) GROUP BY 1",
    "word_length_hist": f"SELECT length(w)::BIGINT AS length, count(*) AS n FROM (SELECT unnest(({SQL.words('text')})[1:100]) AS w FROM documents) GROUP BY 1",
    "file_size_stats": "SELECT count(*) AS files, avg(length(text)) AS mean, quantile_cont(length(text), 0.5)::DOUBLE AS median, max(length(text))::BIGINT AS longest FROM documents",
    "file_size_hist50": "WITH s AS (SELECT length(text)::DOUBLE AS c FROM documents), e AS (SELECT min(c) AS lo, max(c) AS hi FROM s) SELECT least(floor((c - lo) * 50 / greatest(hi - lo, 1.0)), 49)::BIGINT AS bin, count(*) AS n FROM s, e GROUP BY 1",
    "word_freq_top100": rf"SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({SQL.fold('text')}, '[\p{{L}}\p{{N}}_\p{{Mn}}]+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]+') AND length(word) > 2 AND word NOT IN ({', '.join(repr(w) for w in L.STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 100)",
    "language_share": f"WITH n AS (SELECT lang, count(*) AS files FROM documents GROUP BY 1), t AS (SELECT *, sum(files) OVER () AS total FROM n) SELECT CASE WHEN files / total >= 0.01 THEN {_LANGUAGE} ELSE 'Other' END AS language, sum(files)::BIGINT AS files, (sum(files) / max(total))::DOUBLE AS share FROM t GROUP BY 1",
    "language_by_source": "SELECT source, lang, n AS files, (n / sum(n) OVER (PARTITION BY source))::DOUBLE AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)",
    "primary_language_per_source": "SELECT source, lang, n AS files FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1",
    "lexicon_hits": f"SELECT source, term, sum(k)::BIGINT AS hits FROM (SELECT source, term, (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) AS k FROM documents, (VALUES {_TERMS}) v(term)) WHERE k > 0 GROUP BY 1, 2",
    "register_balance": f"SELECT formal, informal, round(p, 6) AS formal_pct, CASE WHEN p IS NULL THEN 'none' WHEN p > 70 THEN 'formal' WHEN 100 - p > 70 THEN 'informal' ELSE 'mixed' END AS register FROM (SELECT formal, informal, CASE WHEN formal + informal > 0 THEN formal * 100 / (formal + informal) END AS p FROM (SELECT coalesce(sum({_FORMAL}), 0)::BIGINT AS formal, coalesce(sum({_INFORMAL}), 0)::BIGINT AS informal FROM (SELECT lower(text) AS low FROM documents)))",
    "sentence_stats": f"SELECT source, sentences, words, m AS mean_words, CASE WHEN m > 20 THEN 'high' WHEN m > 15 THEN 'moderate' WHEN m > 10 THEN 'lower' ELSE 'simple' END AS complexity FROM (SELECT source, sum(len(s))::BIGINT AS sentences, sum(coalesce(list_sum(list_transform(s, lambda x: len({SQL.words('x')}))), 0))::BIGINT AS words, coalesce(sum(coalesce(list_sum(list_transform(s, lambda x: len({SQL.words('x')}))), 0)) / nullif(sum(len(s)), 0), 0)::DOUBLE AS m FROM (SELECT source, {SQL.sentences('text')} AS s FROM documents) GROUP BY source)",
    "char_quality_ratios": f"SELECT source, round(coalesce(avg({SQL.special('text')} / nullif(length(text), 0)), 0), 9) AS special_ratio, coalesce(sum({SQL.non_latin('text')}), 0)::BIGINT AS non_latin FROM documents GROUP BY source",
    "quality_category_counts": f"WITH {_F} SELECT category, source, level::BIGINT AS level, files FROM (SELECT c AS category, source, grouping(c, source) AS level, count(*) AS files FROM (SELECT coalesce(category, 'clean') AS c, source FROM f) GROUP BY ROLLUP (c, source))",
    "problem_report": f"WITH {_F} SELECT category, source, count(*) AS files, min(doc_id) AS first, sum(doc_id)::BIGINT AS ids, CASE category WHEN 'empty_files' THEN 'Empty Files' ELSE 'Garbled Content' END AS title FROM f WHERE category IS NOT NULL GROUP BY 1, 2",
    "repeated_char_flag": "SELECT doc_id, len(list_filter(list_distinct(string_split(text, '')), lambda c: c <> chr(10) AND c <> '' AND contains(text, repeat(c, 51)))) > 0 AS repeated FROM documents",
    "quality_labels": f"WITH {_F}, a AS (SELECT count(*) AS files, sum(chars) AS chars, sum(words) AS words, sum(lines) AS lines FROM f WHERE category IS NULL) SELECT (chars // files)::BIGINT AS mean_chars, round(chars / words, 6) AS chars_per_word, round(chars / lines, 6) AS chars_per_line, CASE WHEN chars / words < 4 THEN 'short words' WHEN chars / words < 6 THEN 'balanced' WHEN chars / words < 8 THEN 'long words' ELSE 'very long words' END AS lexical, (chars // files) BETWEEN 500 AND 50000 AS size_ok, round(chars / words, 6) BETWEEN 3 AND 8 AS density_ok FROM a",
    "domain_description_join": f"SELECT s.source, coalesce(v.description, '{L.DEFAULT_DESCRIPTION}') AS description FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN {sql_rows('name description', [*L.DOMAIN_DESCRIPTIONS.items(), ('src0', 'General web text'), ('src1', 'News')])} ON trim(replace(lower(s.source), '/', '')) = v.name",
    "analysis_validation": f"WITH a AS (SELECT count(*) AS files, count(DISTINCT source) AS dirs, sum(length(text)) AS chars, sum(len({SQL.words('text')})) AS words, count(lang) AS detected, count(*) FILTER (lang = 'es') AS spanish, ({_HITS}) AS terms FROM documents) "
    "SELECT unnest(['no_files','no_directories','no_content','no_words','no_language','no_spanish','little_spanish','no_terms','few_terms']) AS rule, unnest(['issue','issue','issue','warning','warning','warning','warning','warning','warning']) AS severity, "
    "unnest([files = 0, dirs = 0, chars = 0, words = 0, detected = 0, detected > 0 AND spanish = 0, spanish > 0 AND spanish * 2 < detected, terms = 0, terms > 0 AND terms < 100]) AS raised FROM a",
}
