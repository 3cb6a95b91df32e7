"""Word-level vocabulary, encoding, chunking, masking and padding."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.functions import tokens as K
from corpusloom.shared import small_arrow_batches

PAD, UNK, EOS, MASK = 0, 1, 2, 3
SPECIAL = [PAD, UNK, EOS, MASK]


def vocabulary(docs: DataFrame, text: str, size: int) -> DataFrame:
    """token_id, word and n of the ``size`` most frequent folded words; ids follow the special ones, ties by word."""
    counted = docs.select(F.explode(X.words(F.lower(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # over at most ``size`` rows
    return top.select((rank + len(SPECIAL) - 1).cast("int").alias("token_id"), "word", "n")


def encode(docs: DataFrame, text: str, vocab: DataFrame, first: int | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids``, of all words or of the ``first`` ones, without the text itself unless ``keep_text``.

    The vocabulary's size is a parameter, so workers hold all of it, and one bounded batch of rows.
    """
    small_arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast({r["word"]: r["token_id"] for r in vocab.select("word", "token_id").collect()})
    words = X.words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in fields], (words if first is None else F.slice(words, 1, first)).alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            words = batch.column("_words")
            # A word is looked up once a batch.
            coded = words.flatten().dictionary_encode()
            known_ids = np.fromiter((get(w, UNK) for w in coded.dictionary.to_pylist()), dtype=np.int32, count=len(coded.dictionary))
            flat = known_ids[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int32)
            offsets = words.offsets.to_numpy()
            ids = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat, pa.int32()))
            kept = [c for c in batch.schema.names if c != "_words"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], names=[*kept, "ids"])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocab: DataFrame, name: str = "words", unknown: str = "[UNK]") -> DataFrame:
    """``encoded`` with the word of each of its ``ids``, looked up in place: ids count the vocabulary's rows behind the special ones."""
    listed = vocab.agg(F.array_sort(F.collect_list(F.struct("token_id", "word"))).alias("_vocab"))  # one row of a size that is a parameter
    words = F.transform("ids", lambda i: F.coalesce(F.get(F.col("_vocab.word"), i - len(SPECIAL)), F.lit(unknown)))
    return encoded.join(F.broadcast(listed)).withColumn(name, words).drop("_vocab")


def causal_chunks(encoded: DataFrame, length: int, overlap: int, pad: int = PAD) -> DataFrame:
    """A row for each window: chunk, start, input_ids, attention_mask and labels of ``length``."""
    kept = [c for c in encoded.columns if c != "ids"]
    # A row has the ids of its window alone: with all of the text's, long texts would grow by the square.
    parts = F.transform(K.window_starts("ids", length, overlap), lambda start: F.struct(start.alias("start"), F.slice("ids", start + 1, F.lit(length)).alias("part")))
    out = encoded.select(*kept, F.posexplode(parts).alias("chunk", "_window")).withColumn("_part", F.col("_window.part"))
    out = out.select(*kept, F.col("chunk").cast("long").alias("chunk"), F.col("_window.start").cast("long").alias("start"), K.padded("_part", str(length), pad).alias("input_ids"), K.attention("_part", str(length)).alias("attention_mask"))
    return out.withColumn("labels", K.causal_labels("input_ids", "attention_mask"))


def mlm(encoded: DataFrame, key: str, length: int, vocab_size: int, seed: int, overflow: bool = False, overlap: int = 0, **choices) -> DataFrame:
    """Masked rows: input_ids, attention_mask and labels; only the first window of each document, or all with ``overflow``."""
    shares = choices.pop("shares", (0.8, 0.1, 0.1))
    mask_id, pad, special = choices.pop("mask_id", MASK), choices.pop("pad", PAD), choices.pop("special", SPECIAL)
    if overflow:
        out = causal_chunks(encoded, length, overlap, pad).drop("labels")
        unit = f"concat({key}, '-', chunk)"
    else:
        kept = [c for c in encoded.columns if c != "ids"]
        out = encoded.select(*kept, F.expr(f"slice(ids, 1, {length})").alias("_part"))
        out = out.select(*kept, K.padded("_part", str(length), pad).alias("input_ids"), K.attention("_part", str(length)).alias("attention_mask"))
        unit = f"cast({key} AS string)"
    out = out.withColumn("_unit", F.expr(unit))
    out = out.withColumn("_chosen", K.mlm_choices("input_ids", "attention_mask", "_unit", seed, list(special), **choices))
    labels = F.expr(f"zip_with(input_ids, _chosen, (t, c) -> CASE WHEN c THEN t ELSE {K.IGNORE} END)")
    return out.withColumn("labels", labels).withColumn("input_ids", K.mlm_replaced("input_ids", "_chosen", "_unit", seed, mask_id, vocab_size, shares)).drop("_unit", "_chosen")


#: What is left out of the loss: the prompt's labels, or its attention as well.
STRATEGIES = ("context_aware", "response_only")


def instruction_rows(pairs: DataFrame, prompt: str, full: str, length: int, strategy: str = "context_aware", mask_prompt: bool = True, pad: int = PAD, end: int = EOS) -> DataFrame:
    """Fixed rows of ``length`` from the ids of a prompt and of prompt and response; ``n`` is the untruncated length with the end.

    An unknown strategy counts as context_aware, with a warning.
    """
    if strategy not in STRATEGIES:
        warnings.warn(f"unknown masking strategy {strategy}; context_aware is taken", stacklevel=2)
    kept = [c for c in pairs.columns if c not in (prompt, full)]
    out = pairs.select(*kept, F.expr(f"concat(slice({full}, 1, {length - 1}), array({end}))").alias("_ids"), F.expr(f"least(size({prompt}), {length})").alias("_m"), (F.size(full) + 1).cast("long").alias("n"))
    out = out.withColumn("_m", F.col("_m") if mask_prompt else F.lit(0))
    masked = strategy == "response_only" and mask_prompt
    attention = F.expr("transform(_ids, (t, i) -> CASE WHEN i < _m THEN 0 ELSE 1 END)") if masked else F.expr("array_repeat(1, size(_ids))")
    out = out.withColumns({"_labels": K.instruction_labels("_ids", "_m"), "_mask": attention})
    return out.select(*kept, "n", K.padded("_ids", str(length), pad).alias("input_ids"), K.padded("_mask", str(length), 0).alias("attention_mask"), K.padded("_labels", str(length), K.IGNORE).alias("labels"))


def shortened_rows(rows: DataFrame, most: int, percentile: float | None = None) -> DataFrame:
    """Rows of :func:`instruction_rows` cut to one common length, which :func:`dynamic_target` finds from ``n``."""
    target = F.broadcast(dynamic_target(rows, "n", most, percentile))
    out = rows.join(target)
    cut = {c: F.expr(f"slice({c}, 1, cast(greatest(target, 1) AS int))") for c in ("input_ids", "attention_mask", "labels")}
    return out.withColumns(cut).drop("target")


def dynamic_target(lengths: DataFrame, column: str, most: int, percentile: float | None = None) -> DataFrame:
    """One row, ``target``: a percentile if given; else the 95th if any length reaches ``most``; else the longest."""
    if percentile is not None:
        target = F.least(F.floor(F.percentile(column, F.lit(percentile / 100))), F.lit(most))
    else:
        target = F.when(F.max(column) >= most, F.least(F.floor(F.percentile(column, F.lit(0.95))), F.lit(most))).otherwise(F.max(column))
    return lengths.agg(target.cast("long").alias("target"))
