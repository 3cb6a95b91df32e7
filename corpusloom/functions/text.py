"""Text scalars and the ordered quality rules; all built-in functions.

The SQL twins for the oracles stand beside each function's name in ``SQL``.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` has it, which is wider than the regex class.
WS = r"(?U)[\s\x1c-\x1f]+"
_SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode decomposition; those with other decompositions stay."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and unicodedata.category(a) != "Mn"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def fold(text: Column) -> Column:
    """Lower case without marks: NFD and dropping category Mn; only a text with such letters is translated."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x{0}-\x{7F}]"), F.regexp_replace(F.translate(low, *_folding()), r"\p{Mn}+", "")).otherwise(low)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs, not overlapping, also inside words; 0 for a null text.

    Bytes are compared, whose number is known; a text without the term is searched once and not copied.
    """
    less = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    return F.when(F.contains(text, F.lit(term)), (less / len(term.encode())).cast("long")).otherwise(F.lit(0).cast("long"))


def sentences(text: Column) -> Column:
    """Parts between runs of ``.!?`` with more than 10 characters when stripped."""
    return F.filter(F.split(text, "[.!?]+"), lambda s: F.length(strip(s)) > 10)


def alpha_ratio(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(text))


def non_latin_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x{0}-\x{7F}\x{C0}-\x{24F}]+", "")).cast("long")


def special_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]+", "")).cast("long")


def latin_words(text: Column) -> Column:
    """Whole words of a-z only, in folded text."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b[a-z]+\b"), F.lit(0))


def display_clean(text: Column) -> Column:
    kept = strip(F.regexp_replace(text, r"[^\x{20}-\x{7E}\x{C0}-\x{24F}]+", ""))
    return F.when(kept == "", F.lit("Unknown")).otherwise(kept)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def markdown_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def quality_category(text: Column) -> Column:
    """empty_files, garbled_content or null for clean; the first rule that holds."""
    bad = (F.length(text) > 100) & (alpha_ratio(text) < 0.10)
    bad = bad | text.rlike(r"(?U)[^a-zA-Z0-9\s]{50,}") | text.rlike(r"(.)\1{50,}")
    for c in ("\x00", "�", "ÿ", "þ"):
        bad = bad | F.contains(text, F.lit(c))
    return F.when(F.length(strip(text)) == 0, F.lit("empty_files")).when(bad, F.lit("garbled_content"))


#: Function words by which a language shows; ours, and few on purpose: each is frequent in its language.
FUNCTION_WORDS = {
    "de": "der die das und ist von mit nicht ein eine den zu".split(),
    "en": "the of and to is that with was for it on".split(),
    "es": "el los las y que en por con una del se su".split(),
    "fr": "le les des et est que dans pour une du pas qui".split(),
}


def language(text: Column) -> Column:
    """The language with most function words among the words of a text, and its share of all those found; unknown without any.

    Ties go to the first code. A word that two languages list counts for both.
    """
    own = words(F.lower(F.coalesce(text, F.lit(""))))
    hits = F.array(*[F.struct(F.size(F.filter(own, _listed(ws))).alias("n"), F.lit(code).alias("lang")) for code, ws in FUNCTION_WORDS.items()])
    return F.transform(F.array(hits), _best)[0]


def _listed(ws: list[str]):
    return lambda w: w.isin(ws)


def _best(hits: Column) -> Column:
    total = F.aggregate(hits, F.lit(0), lambda a, h: a + h["n"])
    most = F.array_max(F.transform(hits, lambda h: h["n"]))
    first = F.filter(hits, lambda h: h["n"] == most)[0]
    return F.struct(F.when(total > 0, first["lang"]).otherwise(F.lit("unknown")).alias("lang"), F.when(total > 0, most / total).otherwise(F.lit(0.0)).alias("confidence"))


class SQL:
    """The same in SQL, over a column name or expression."""

    @staticmethod
    def words(t: str) -> str:
        return f"list_filter(regexp_split_to_array({t}, '{_SQL_WS}+'), lambda x: x <> '')"

    @staticmethod
    def strip(t: str) -> str:
        return f"regexp_replace({t}, '^{_SQL_WS}+|{_SQL_WS}+$', '', 'g')"

    @staticmethod
    def lines(t: str) -> str:
        return f"(length({t}) - length(replace({t}, chr(10), '')) + 1)"

    @staticmethod
    def fold(t: str) -> str:
        return f"strip_accents(lower({t}))"

    @staticmethod
    def occurrences(t: str, term: str) -> str:
        return f"((length({t}) - length(replace({t}, '{term}', ''))) // {len(term)})"

    @staticmethod
    def sentences(t: str) -> str:
        return f"list_filter(regexp_split_to_array({t}, '[.!?]+'), lambda s: length({SQL.strip('s')}) > 10)"

    @staticmethod
    def non_latin(t: str) -> str:
        return rf"length(regexp_replace({t}, '[\x{{0}}-\x{{7F}}\x{{C0}}-\x{{24F}}]+', '', 'g'))"

    @staticmethod
    def special(t: str) -> str:
        return rf"length(regexp_replace({t}, '[\p{{L}}\p{{N}}]+|{_SQL_WS}+', '', 'g'))"

    @staticmethod
    def language(t: str) -> str:
        counts = ", ".join("{{'n': len(list_filter({0}, lambda w: w IN ({1}))), 'lang': '{2}'}}".format(SQL.words(f"lower(coalesce({t}, ''))"), ", ".join(f"'{w}'" for w in ws), code) for code, ws in FUNCTION_WORDS.items())
        # most hits first, then by code
        best = f"list_sort(list_transform([{counts}], lambda h: {{'n': -h.n, 'lang': h.lang}}))"
        total = f"list_sum(list_transform({best}, lambda h: -h.n))"
        return f"CASE WHEN {total} > 0 THEN {{'lang': {best}[1].lang, 'confidence': (-{best}[1].n / {total})::DOUBLE}} ELSE {{'lang': 'unknown', 'confidence': 0.0::DOUBLE}} END"

    @staticmethod
    def category(t: str) -> str:
        return (
            rf"CASE WHEN length({SQL.strip(t)}) = 0 THEN 'empty_files' WHEN length({t}) > 100 AND length(regexp_replace({t}, '\P{{L}}+', '', 'g')) / length({t}) < 0.10 "
            rf"OR regexp_matches({t}, '[^a-zA-Z0-9\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}]{{50,}}') "
            f"OR len(list_filter(list_distinct(string_split({t}, '')), lambda c: c <> chr(10) AND c <> '' AND contains({t}, repeat(c, 51)))) > 0 "
            f"OR contains({t}, chr(65533)) OR contains({t}, 'ÿ') OR contains({t}, 'þ') THEN 'garbled_content' END"
        )
