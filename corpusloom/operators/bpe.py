"""Byte-level byte-pair encoding with a public table of ranks, a frequent word's merges done once for the corpus.

Texts are split into words by the model's pattern, with built-in functions. The
words of the corpus are counted; the most frequent ones, of a number that is a
parameter, are merged once and go to the workers, which put their ids in place:
neighbours with the lowest rank first, the leftmost of equal ones, from a heap. A
rare word is merged where it stands, once a batch: it hardly comes again, and to
bring its ids there by a join would shuffle all texts. A worker holds what was
broadcast and one bounded batch of rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.shared import small_arrow_batches

# The pattern that splits texts before the merges of the rank files.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids are broadcast, some 100 bytes each.
RESIDENT = 200_000


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64 rank``, loaded once a process."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of a word."""
    if word in table:
        return [table[word]]
    n = len(word)
    ends, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # by where a part begins: its end, and where the part before begins
    heap = [(table[word[k : k + 2]], k, k + 2) for k in range(n - 1) if word[k : k + 2] in table]
    heapq.heapify(heap)
    while heap:
        _, a, end = heapq.heappop(heap)
        b = ends[a]
        if b >= n or b < 0 or ends[b] != end:
            continue  # one of the two has been merged meanwhile
        ends[a], ends[b] = end, -1
        if end < n:
            before[end] = a
            if (r := table.get(word[a : ends[end]])) is not None:
                heapq.heappush(heap, (r, a, ends[end]))
        if (p := before[a]) >= 0 and (r := table.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, k = [], 0
    while k < n:
        out.append(table[word[k : ends[k]]])
        k = ends[k]
    return out


def pieces(text: Column) -> Column:
    """The words of a text (null: none); joined, they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """How often each distinct word occurs, as n."""
    return docs.select(F.explode(pieces(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _with_ids(words: DataFrame, path: str) -> DataFrame:
    """The columns word and n with the ids of each word."""
    small_arrow_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            ids = [merged(w.encode(), table) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids array<int>")


def vocabulary(docs: DataFrame, text: str, path: str) -> DataFrame:
    """word, n (how often) and ids of all distinct words; the rank file must lie at ``path`` on every worker."""
    return _with_ids(_counted(docs, text), path)


def encode(docs: DataFrame, text: str, path: str, name: str = "ids", resident: int = RESIDENT, keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text``, without the text itself unless ``keep_text``."""
    spark = docs.sparkSession
    ranks(path)  # tells a missing file here
    small_arrow_batches(spark)
    often = _counted(docs, text).orderBy(F.desc("n"), "word").limit(resident).repartition(spark.sparkContext.defaultParallelism)
    known = spark.sparkContext.broadcast(_Known.of([(r["word"], r["ids"]) for r in _with_ids(often, path).collect()]))  # at most ``resident`` rows
    kept = [f for f in docs.schema.fields if f.name != name and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, table = known.value, ranks(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], _placed(batch.column("_pieces"), use, table)], names=[*[f.name for f in kept], name])

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], pieces(F.col(text)).alias("_pieces"))
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.ArrayType(T.IntegerType()))]))


@dataclass(frozen=True)
class _Known:
    """Where each word stands in starts and widths, which tell its ids in flat."""

    at: dict[str, int]
    starts: np.ndarray
    widths: np.ndarray
    flat: np.ndarray

    @staticmethod
    def of(words: list[tuple[str, list[int]]]) -> _Known:
        widths = np.array([len(ids) for _, ids in words], np.int64)
        return _Known({w: k for k, (w, _) in enumerate(words)}, np.cumsum(widths) - widths, widths, np.array([i for _, ids in words for i in ids], np.int32))


def _placed(words: pa.ListArray, known: _Known, table: dict[bytes, int]) -> pa.ListArray:
    """The ids of each text; words that are not ``known`` are merged here."""
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    place = np.fromiter((known.at.get(w, -1) for w in distinct), np.int64, len(distinct))
    rare = np.flatnonzero(place < 0)
    more = _Known.of([(distinct[k], merged(distinct[k].encode(), table)) for k in rare.tolist()])
    place[rare] = len(known.at) + np.arange(len(rare))
    starts = np.concatenate([known.starts, len(known.flat) + more.starts])[place]
    widths = np.concatenate([known.widths, more.widths])[place]
    flat = np.concatenate([known.flat, more.flat])
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    per = widths[code]
    ends = np.cumsum(per)
    ids = flat[np.repeat(starts[code] - (ends - per), per) + np.arange(ends[-1])] if len(code) else np.zeros(0, np.int32)
    cuts = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))


@lru_cache(maxsize=4)
def parts(path: str) -> pa.Array:
    """The bytes of each id."""
    by_id = {i: b for b, i in ranks(path).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())


def _joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The text of each row's ids; raises for an id that the table lacks."""
    flat = table.take(ids.flatten())
    if flat.null_count:
        raise KeyError("ids beyond the rank file")
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat), b"")
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:  # some bytes are no UTF-8
        return pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.string())


def decode(rows: DataFrame, ids: str, path: str, name: str = "decoded") -> DataFrame:
    """``rows`` with the text of all ``ids`` (null: empty); bytes that are no UTF-8 show as replacement characters."""
    small_arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = parts(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _joined(batch.column(ids), table)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
