"""What reports say about totals: grades by threshold, validation of results, projections of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each measure the grades in order, each with the comparison and the bound that it needs; the last one is the rest.
GRADES: dict[str, tuple[tuple[str, str, float] | tuple[str], ...]] = {
    "confidence": (("high", ">", 0.9), ("moderate", ">", 0.7), ("low",)),
    "sentence_length": (("high", ">", 20), ("moderate", ">", 15), ("lower", ">", 10), ("simple",)),
    "chars_per_word": (("short", "<", 4), ("balanced", "<", 6), ("long", "<", 8), ("very long",)),
    "tokens_per_char": (("excellent", "<", 0.3), ("good", "<", 0.4), ("moderate", "<", 0.5), ("poor",)),
    "padding_ratio": (("efficient", "<", 0.2), ("acceptable", "<", 0.4), ("wasteful",)),
    "learning_rate": (("conservative", "<", 0.0001), ("moderate", "<", 0.0003), ("aggressive",)),
    "batch_size": (("large", ">=", 32), ("medium", ">=", 16), ("small",)),
    "language_share": (("dominant", ">", 0.9), ("strong", ">", 0.8), ("mixed",)),
    "lexicon_hits": (("high", ">", 1000), ("moderate", ">", 100), ("low",)),
    "encoding_issues": (("excellent", "<=", 0), ("good", "<", 5), ("needs attention",)),
    "source_balance": (("balanced", "<", 10), ("unbalanced",)),
    "training_steps": (("good", ">", 1000), ("limited",)),
}


def grade(measure: Column, value: Column) -> Column:
    """The grade of a value by the name of its measure; null for a name that isn't known and for a null value."""
    out = F.lit(None).cast("string")
    for name, grades in GRADES.items():
        own = F.lit(grades[-1][0])
        for g in reversed(grades[:-1]):
            label, sign, bound = g
            test = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound}[sign]
            own = F.when(test, F.lit(label)).otherwise(own)
        out = F.when((measure == name) & value.isNotNull(), own).otherwise(out)
    return out


#: Totals that are validated; a null one means that its part of the analysis is missing.
TOTALS = ("files", "dirs", "chars", "words", "analysed", "detected", "wanted", "terms", "tokens")
#: Name, severity and condition of each rule, in SQL over the totals. An issue makes a result invalid, a warning doesn't.
RULES = (
    ("missing_structure", "issue", "files IS NULL"),
    ("no_files", "issue", "files = 0"),
    ("no_directories", "issue", "dirs = 0"),
    ("missing_content", "issue", "chars IS NULL"),
    ("no_content", "issue", "chars = 0"),
    ("no_words", "warning", "words = 0"),
    ("missing_language", "issue", "analysed IS NULL"),
    ("none_analysed", "issue", "analysed = 0"),
    ("no_language", "warning", "detected = 0"),
    ("no_spanish", "warning", "detected > 0 AND wanted = 0"),
    ("little_spanish", "warning", "wanted > 0 AND wanted * 2 < detected"),
    ("no_terms", "warning", "terms = 0"),
    ("few_terms", "warning", "terms > 0 AND terms < 100"),
    ("missing_tokens", "warning", "tokens IS NULL"),
    ("no_tokens", "issue", "tokens = 0"),
)


def validated(totals: DataFrame) -> DataFrame:
    """The other columns of ``totals`` (with :data:`TOTALS`) by rule: severity and whether it is raised."""
    kept = [c for c in totals.columns if c not in TOTALS]
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(F.expr(c), F.lit(False)).alias("raised")) for n, s, c in RULES])
    return totals.select(*kept, F.inline(found))


def verdicts(totals: DataFrame) -> DataFrame:
    """The other columns of ``totals`` with issues, warnings (names, in order) and whether the result is valid."""
    kept = [c for c in totals.columns if c not in TOTALS]

    def raised(severity: str) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, s, c in RULES if s == severity]))

    return totals.select(*kept, F.array_join(raised("issue"), ",").alias("issues"), F.array_join(raised("warning"), ",").alias("warnings"), (F.size(raised("issue")) == 0).alias("valid"))


def projection(chars: Column, tokens_per_char: Column, batch: int, accumulate: int, context: int, epochs: int) -> dict[str, Column]:
    """Tokens, size and optimizer steps that a corpus comes to; 0 where a part is 0."""
    tokens, each = chars * tokens_per_char, batch * accumulate * context
    size = chars / (1 << 30)
    return {
        "total_tokens": tokens, "size_gb": size, "tokens_per_gb": F.coalesce(F.try_divide(tokens, size), F.lit(0.0)), "tokens_per_step": F.lit(each).cast("long"),
        "training_steps": (F.floor(tokens * epochs / each) if each else F.lit(0)).cast("long"), "exposures": tokens * epochs,
    }
