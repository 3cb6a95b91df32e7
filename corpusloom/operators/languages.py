"""A language classifier that learns from labelled rows: naive Bayes over hashed letter trigrams.

Fitting counts the trigrams of every labelled text by language and bucket, summed
up in each task before they are shuffled; the weights follow in closed form. They
are a table of languages x :data:`BUCKETS` numbers, whose size is a parameter, and
go to the workers with the function that scores whole texts a batch at a time. A
worker holds one bounded batch, and the trigrams of about :data:`CHARS_AT_ONCE`
characters of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.shared import at_a_time, small_arrow_batches

#: Buckets of trigrams; multipliers of their hash; what is added to each count.
BUCKETS, HASH, SMOOTH = 8192, (1_000_003, 1_009), 0.5
#: Neighbouring trigrams tell much the same, so a text counts as this many of them at most.
EVIDENCE = 50
UNKNOWN = "unknown"
#: Characters whose trigrams are held at a time, about, some 80 bytes each; a longer text is taken alone.
CHARS_AT_ONCE = 1 << 18


def letters(text: Column) -> Column:
    """Lower-case words of letters, with one blank between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")), F.lit(" "))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each trigram."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = owner[:-2] == owner[2:]
    return ((codes[:-2] * HASH[0] + codes[1:-1] * HASH[1] + codes[2:]) % BUCKETS)[own], owner[:-2][own]


@dataclass(frozen=True)
class Model:
    """weights[k, bucket] and priors[k] of languages[k], in the order of their codes; all logarithms."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray

    def detect(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text, the first of equal ones, and its probability."""
        told = [self._detect(run) for run in at_a_time(texts, CHARS_AT_ONCE)]
        return [x for names, _ in told for x in names], np.concatenate([np.zeros(0), *[sure for _, sure in told]])

    def _detect(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bucket, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.stack([np.bincount(owner, weights=w[bucket], minlength=len(texts)) for w in self.weights])
        scores = sums / np.maximum(n, 1) * np.minimum(n, EVIDENCE) + self.priors[:, None]
        best = scores.argmax(axis=0)
        sure = 1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)
        return [self.languages[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, sure, 0.0)


def fit(docs: DataFrame, text: str, label: str) -> Model:
    """The model of all rows of ``docs`` that have a label."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), letters(F.col(text)).alias("letters"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, at = batch.column("label").to_pylist(), 0
            for texts in at_a_time(batch.column("letters").to_pylist(), CHARS_AT_ONCE):
                own = labels[at : at + len(texts)]
                at += len(texts)
                names = {x: k for k, x in enumerate(dict.fromkeys(own))}
                bucket, owner = trigrams(texts)
                mine = np.array([names[x] for x in own], np.int64)
                counts = np.bincount(mine[owner] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, k in names.items():
                    # One more place for the number of texts.
                    held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[:-1] += counts[k]
                    held[name][-1] += int((mine == k).sum())
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["label", "bucket", "n"])

    told = rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()  # languages x buckets at most
    names = tuple(sorted({r["label"] for r in told}, key=lambda s: s.encode()))
    counts = np.zeros((len(names), BUCKETS + 1))
    for r in told:
        counts[names.index(r["label"]), r["bucket"]] = r["n"]
    grams = counts[:, :-1]
    return Model(names, np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)), np.log(counts[:, -1] / max(1.0, counts[:, -1].sum())))


def detected(text: Column, model: Model) -> Column:
    """A struct of lang and confidence; texts without three letters and blanks in a row are unknown."""

    def detect(texts: pa.Array) -> pa.Array:
        names, sure = model.detect(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["lang", "confidence"])

    return F.arrow_udf(detect, "lang string, confidence double").asNondeterministic()(letters(text))
