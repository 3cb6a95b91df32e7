"""Rule-based anonymisation: a table of labels and patterns, folded into one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labels; those without a pattern here need a recogniser of their own.
LABELS = "CARD EMAIL FINANCIAL ID LOC MISC ORG PER TELEPHONE VEHICLE ZIP CODE DATE".split()
METHODS = ("label", "random", "intelligent", "none")

#: Default rules, in order of priority: a text changed by one is seen by the next.
RULES = (
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("CARD", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("TELEPHONE", r"\+[0-9][0-9 ().-]{7,}[0-9]"),
    ("DATE", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
)


def chosen(rules: tuple[tuple[str, str], ...], labels: list[str] | None) -> list[tuple[str, str]]:
    """The rules of the labels asked for; none asked for means all."""
    if unknown := set(labels or ()) - set(LABELS):
        raise ValueError(f"unknown labels: {', '.join(sorted(unknown))}")
    if without := set(labels or ()) - {r[0] for r in rules}:
        raise ValueError(f"no rule for labels: {', '.join(sorted(without))}")
    return [r for r in rules if not labels or r[0] in labels]


def rules_from_csv(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """Rules of a user's CSV with the columns label and regex, in its order; raises for labels or patterns that can't be used."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if missing := {"label", "regex"} - set(rows.columns):
        raise ValueError(f"{path} lacks the columns {', '.join(sorted(missing))}")
    out = tuple((r["label"].strip().upper(), r["regex"]) for r in rows.select("label", "regex").na.drop().collect())
    for label, pattern in out:
        if label not in LABELS:
            raise ValueError(f"{path}: unknown label {label}")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{path}: the pattern of {label} can't be read: {e}") from e
    return out


def located(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All matches as label, start and end (code points), in order of the rules, then of the text."""
    parts = []
    for label, pattern in rules:
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
        parts.append(F.aggregate(sizes, _start(), _adding(label), lambda a: a["out"]))
    return F.flatten(F.array(*parts))


def _start() -> Column:
    return F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("out"))


def _adding(label: str):
    def add(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["gap"], a["at"] + x["gap"] + x["size"]
        more = F.concat(a["out"], F.array(F.struct(F.lit(label).alias("label"), start.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["size"] > 0, more).otherwise(a["out"]).alias("out"))

    return add


#: Output formats: texts alone, objects with their path, or texts with labelled spans for annotation.
FORMATS = ("plain", "jsonl", "doccano")


def write(df: DataFrame, path: str, form: str, text: str = "text") -> None:
    """Writes rows as lines of text, as JSON lines, or as JSON lines of ``text`` and ``label`` ([start, end, label]).

    doccano takes the column ``spans`` that :func:`located` gives.
    """
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}; known are {', '.join(FORMATS)}")
    if form == "plain":
        df.select(text).write.mode("append").text(path)
    elif form == "jsonl":
        df.drop("spans").write.mode("append").json(path)
    else:
        triple = lambda s: F.array(s["start"].cast("string"), s["end"].cast("string"), F.to_json(F.array(s["label"])))
        label = F.concat(F.lit("["), F.array_join(F.transform("spans", lambda s: F.concat(F.lit("["), triple(s)[0], F.lit(","), triple(s)[1], F.lit(","), F.regexp_replace(triple(s)[2], r"^\[|\]$", ""), F.lit("]"))), ","), F.lit("]"))
        body = F.regexp_replace(F.to_json(F.array(F.col(text))), r"^\[|\]$", "")
        df.select(F.concat(F.lit('{"text":'), body, F.lit(',"label":'), label, F.lit("}")).alias("value")).write.mode("append").text(path)


def anonymised(text: Column, method: str, rules: list[tuple[str, str]], seed: int = 0) -> Column:
    """``text`` with each match replaced: by its label; by a seeded surrogate; by one of the same shape; or not at all."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known are {', '.join(METHODS)}")
    out = text
    for label, pattern in rules:
        if method == "label":
            out = F.regexp_replace(out, pattern, f"[{label}]")
        elif method in ("random", "intelligent"):
            # A variable of transform is the text as the rules before left it: named there, it is worked out once, not once for each mention.
            out = F.transform(F.array(out), _replaced(label, pattern, method, seed))[0]
    return out


def _replaced(label: str, pattern: str, method: str, seed: int):
    def replace(text: Column) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        return F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps, found, _replacing(label, method, seed)), "")).otherwise(text)

    return replace


def _replacing(label: str, method: str, seed: int):
    return lambda gap, match: F.concat(gap, F.coalesce(_surrogate(match, label, method, seed), F.lit("")))


def _tagged(label: str):
    return lambda match: F.struct(F.lit(label).alias("label"), match.alias("value"))


def _surrogate(value: Column, label: str, method: str, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}-{label}-"), value).cast("binary"))
    if method == "random":
        return F.concat(F.lit(f"{label}-"), F.substring(digest, 1, 8))
    # Digits and letters become others of their kind, drawn from the digest at their place; all else stays.
    digit = lambda i: (F.ascii(F.substr(digest, F.pmod(i, F.lit(32)) + 1, F.lit(1))) % 10).cast("string")
    letter = lambda i: F.chr(F.lit(97) + F.ascii(F.substr(digest, F.pmod(i * 7, F.lit(32)) + 1, F.lit(1))) % 26)
    shape = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[A-Za-z]"), letter(i)).otherwise(c))
    return F.array_join(shape, "")


def spans(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All matches as label and value, for reports and annotation files."""
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _tagged(label)) for label, p in rules]))


def anonymise(df: DataFrame, text: str, method: str = "label", labels: list[str] | None = None, rules: tuple[tuple[str, str], ...] = RULES, store_original: bool = False, seed: int = 0, done: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """``df`` with ``text`` anonymised; ``store_original`` keeps it beside; rows whose ``key`` is in ``done`` are skipped."""
    if done is not None and key:
        df = df.join(done.select(key), key, "left_anti")
    out = df.withColumn(f"{text}_original", F.col(text)) if store_original else df
    return out.withColumn(text, anonymised(F.col(text), method, chosen(rules, labels), seed))
