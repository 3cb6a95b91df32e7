"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every document gets its features (lengths, symbols, stop words, lines) and a
verdict in one narrow pass: no shuffle, no user functions.

Defined results: a null or empty text has no words, every count is 0 and the
document fails the length rule; repeated rows are judged alike, one by one;
columns of the input named like a feature give way to the feature; the rule of
stop words holds only where the text is said to be in a language whose words are
listed, so no text in another language, or in one that isn't told, fails it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, words

# The stop words looked for, frequent function words of four languages.
STOP_WORDS = (
    "the be to of and that have with in is for it on as was "
    "der die und den von das mit sich des ist "
    "de la le et les en un une du que dans "
    "el los las y por con para una"
).split()
#: Codes of the languages that the words are from.
STOP_LANGUAGES = ("de", "en", "es", "fr")


@dataclass(frozen=True)
class Rule:
    """Fails if ``100 * feature`` is over (or under) ``limit * per`` in whole numbers; per None: the limit itself. languages: only texts in these."""

    name: str
    feature: str
    per: str | None
    least: int | None = None
    most: int | None = None
    languages: tuple[str, ...] | None = None


# Thresholds as published for web-text filters; the ratios are in percent.
THRESHOLDS = (
    Rule("too_short", "n_words", None, least=50),
    Rule("too_long", "n_words", None, most=100_000),
    Rule("repeats", "n_repeat_words", "n_words", most=50),
    Rule("short_words", "word_chars", "n_words", least=200),
    Rule("long_words", "word_chars", "n_words", most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("no_letters", "n_letter_words", "n_words", least=60),
    Rule("stop_words", "n_stop_words", None, least=2, languages=STOP_LANGUAGES),
    Rule("bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipses", "n_ellipsis_lines", "n_lines", most=30),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=50),
)

#: The rules of the contract's base verdict.
BASE_RULES = ("too_short", "repeats")


def _failed(rule: Rule, lang: Column | None = None) -> Column:
    value, per = F.col(rule.feature), F.lit(1) if rule.per is None else F.col(rule.per)
    scale = 1 if rule.per is None else 100
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value * scale < per * rule.least)
    if rule.most is not None:
        out = out | (value * scale > per * rule.most)
    if rule.languages is not None:
        out = out & (F.lit(False) if lang is None else F.coalesce(F.lower(lang).isin(*rule.languages), F.lit(False)))
    return out


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the features that :data:`THRESHOLDS` names, as longs.

    n_repeat_words counts the words that lie in a 3-word window found twice or
    more in the text. Windows are compared by a 64-bit hash, sorted with their
    positions only where a hash occurs twice.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stop = F.array(*[F.lit(x) for w in STOP_WORDS for x in (w, w.capitalize())])
    # Columns have names of ours on the way, so that none clashes.
    names = {c: f"_k_{k}" for k, c in enumerate(docs.columns) if c not in FEATURES}
    kept = list(names.values())
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], words(body).alias("_q_w"), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_q_l"), F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    out = out.select(
        *kept,
        "n_symbols",
        F.size("_q_w").cast("long").alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(F.transform(F.array_intersect("_q_w", stop), F.lower))).cast("long").alias("n_stop_words"),
        F.size(F.filter("_q_w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size("_q_l").cast("long").alias("n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_q_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_q_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.expr("CASE WHEN size(_q_w) < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_q_w) - 3), i -> xxhash64(get(_q_w, i), get(_q_w, i + 1), get(_q_w, i + 2))) END").alias("_q_h"),
    )
    sorted_windows = F.expr("CASE WHEN size(array_distinct(_q_h)) < size(_q_h) THEN array_sort(transform(_q_h, (h, i) -> struct(h, i))) END")
    out = out.withColumn("_q_s", sorted_windows)
    starts = F.expr(
        "CASE WHEN _q_s IS NOT NULL THEN array_sort(transform(filter(sequence(0, size(_q_s) - 1), k -> "
        "coalesce(get(_q_s, k).h = get(_q_s, k - 1).h, false) OR coalesce(get(_q_s, k).h = get(_q_s, k + 1).h, false)), k -> get(_q_s, k).i)) END"
    )
    out = out.withColumn("_q_p", starts)
    covered = F.expr("coalesce(aggregate(_q_p, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n), 0L)")
    out = out.withColumn("n_repeat_words", covered)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *COUNTS)


COUNTS = ("n_symbols", "n_words", "word_chars", "n_stop_words", "n_letter_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words")
FEATURES = (*COUNTS, "base_failed", "kept", "failed_rules")


def quality_rules(docs: DataFrame, text: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS, lang: str = "lang") -> DataFrame:
    """``docs`` with features, the names of the rules failed, base_failed and kept.

    ``base_failed`` follows from the base rules whether or not ``thresholds`` have
    them. ``lang`` names the column of language codes; without it no rule that is
    about some languages holds.
    """
    told = F.col(f"`{lang}`") if lang in docs.columns else None
    verdicts = F.array_compact(F.array(*[F.when(_failed(r, told), F.lit(r.name)) for r in thresholds]))
    base = F.lit(False)
    for rule in THRESHOLDS:
        if rule.name in BASE_RULES:
            base = base | _failed(rule)
    return features(docs, text).withColumns({"failed_rules": verdicts, "base_failed": base}).withColumn("kept", F.size("failed_rules") == 0)


def keep_good(docs: DataFrame, text: str = "text", thresholds: tuple[Rule, ...] = THRESHOLDS, lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their columns as they were."""
    names = {c: f"_k{k}" for k, c in enumerate(docs.columns)}
    judged = quality_rules(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[text], thresholds, names.get(lang, lang))
    # An id that can't be moved keeps the filter above the projection: pushed below, it would hold all features anew, each many times over.
    kept = judged.withColumn("_q_at", F.monotonically_increasing_id()).filter("kept AND _q_at >= 0")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in STOP_WORDS)


def _sql_failed(r: Rule) -> str:
    per, scale = ("1", 1) if r.per is None else (r.per, 100)
    parts = [f"{r.feature} * {scale} < {per} * {r.least}"] * (r.least is not None) + [f"{r.feature} * {scale} > {per} * {r.most}"] * (r.most is not None)
    only = "" if r.languages is None else f" AND coalesce(lower(lang) IN ({', '.join(repr(x) for x in r.languages)}), false)"
    return f"(({' OR '.join(parts)}){only})"


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_W}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l
  FROM documents),
win AS (
  SELECT rid, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
f AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(l) AS n_lines,
         len(list_distinct(list_transform(list_filter(w, lambda x: x IN ({_STOP})), lambda x: lower(x)))) AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN cov USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT ({" OR ".join(_sql_failed(r) for r in THRESHOLDS)}) AS kept
FROM f
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": OP10_SQL}
