"""Document fingerprints from prefix polynomial hashes.

``P[i]`` is the sum of the first i code points, each times a power of a base,
modulo a prime. Two such arrays tell whether any two spans are equal (up to a
collision of two 31-bit hashes) without looking at them again, and a binary
search over span lengths finds longest common extensions.

A fingerprint is the length, the hash of the whole text under both primes and a
sketch: the :data:`KEPT` smallest mixed hashes of all windows of :data:`SPAN`
code points, which the prefix arrays give. The likeness of two fingerprints
(:func:`likeness`) is the share of windows that both texts have, told by their
sketches alone and alike from either side; its error is about 0.06 at the most
uncertain. Where the prefix arrays of two texts are at hand, as here, the exact
share of equal spans is told beside it: they are found in order, and each is
extended as far as it goes by binary search (:func:`span_likeness`).

The next document's text is needed beside each text. Rows are dealt into ranges
of ids and sorted; each range pairs its own rows and gives out its first and its
last text, and these, two a range, are paired by a join on the range's number.

Defined results: a null text counts as empty; an empty text has the fingerprint
of no windows and is like an empty text only; repeated ids follow each other by
text, null ids come first; a single row is its own next document; columns but
the id and the text are not used, whatever their names. Rows with one id, or none, whose
texts begin alike stay in one range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import small_arrow_batches, stored, table

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
#: Code points in a window of the sketch, and windows kept.
SPAN, KEPT = 12, 64
#: Code points that an equal span has at least, but for those at the beginning.
ANCHOR = 32
#: Rows in a range: at least where there are few, at most where there are many.
FEW_ROWS, MANY_ROWS = 2_000, 20_000


TOPS = np.array([1 << k for k in range(64)], dtype=np.uint64)


@lru_cache(maxsize=8)
def _powers(which: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of a base; n is a power of two."""
    p, out, step = PRIMES[which], np.ones(1, dtype=np.uint64), BASES[which] % PRIMES[which]
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(p)])
        step = step * step % p
    return out


def powers(which: int, n: int) -> np.ndarray:
    return _powers(which, 1 << max(12, (max(n, 1) - 1).bit_length()))[:n]


class PrefixHash:
    """Prefix arrays of one text under both primes."""

    def __init__(self, codes: np.ndarray):
        self.n, self.sums, self.held = len(codes), [], {}
        wide = codes.astype(np.uint64) + np.uint64(1)
        for which, p in enumerate(PRIMES):
            terms = wide * powers(which, self.n) % np.uint64(p)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(code_points(text))

    @classmethod
    def spliced(cls, a: PrefixHash, keep: int, b: PrefixHash, take: int) -> PrefixHash:
        """The arrays of the first ``keep`` code points of a and the first ``take`` of b, from their arrays alone."""
        out = cls.__new__(cls)
        out.n, out.sums, out.held = keep + take, [], None
        for which, p in enumerate(PRIMES):
            shift = np.uint64(pow(BASES[which], keep, p))
            tail = (b.sums[which][1 : take + 1] * shift + a.sums[which][keep]) % np.uint64(p)
            out.sums.append(np.concatenate([a.sums[which][: keep + 1], tail]))
        return out

    def span(self, begin: int, end: int, at: int) -> tuple[int, int]:
        """Hash of [begin, end) as if it began at ``at``, which is begin or later."""
        return tuple((int(s[end]) - int(s[begin])) % p * pow(b, at - begin, p) % p for s, p, b in zip(self.sums, PRIMES, BASES, strict=True))

    def whole(self) -> tuple[int, int]:
        return int(self.sums[0][-1]), int(self.sums[1][-1])

    def windows(self, begin: int = 0, end: int | None = None, span: int = SPAN) -> np.ndarray:
        """Hashes of the windows that lie in [begin, end), independent of where they lie, mixed to 64 bits."""
        end = self.n if end is None else end
        count = end - begin - span + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        if self.held is not None:  # all windows of a size, made once
            if span not in self.held:
                self.held[span] = self._windows(0, self.n - span + 1, span)
            return self.held[span][begin : begin + count]
        return self._windows(begin, count, span)

    def _windows(self, begin: int, count: int, span: int) -> np.ndarray:
        p, s = np.uint64(PRIMES[0]), self.sums[0]
        own = (s[begin + span : begin + span + count] + p - s[begin : begin + count]) % p
        # brought to a common power of the base
        own = own * _lifts(begin, count) % p
        own *= np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        return own ^ (own >> np.uint64(32))


def _lifts(begin: int, count: int) -> np.ndarray:
    """Inverse powers of the first base for windows at begin, begin+1, ..."""
    return _inverse(1 << max(12, (begin + count - 1).bit_length()))[begin : begin + count]


@lru_cache(maxsize=8)
def _inverse(n: int) -> np.ndarray:
    p = PRIMES[0]
    step = pow(BASES[0], p - 2, p)
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(p)])
        step = step * step % p
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def equal_spans(a: PrefixHash, i: int, b: PrefixHash, j: int, n: int) -> bool:
    """Whether a[i:i+n] equals b[j:j+n]; false where one of them runs over the end."""
    at = max(i, j)
    return i + n <= a.n and j + n <= b.n and a.span(i, i + n, at) == b.span(j, j + n, at)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The longest n with a[i:i+n] equal to b[j:j+n], by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def span_likeness(a: PrefixHash, b: PrefixHash) -> float:
    """Twice the code points in equal spans over those of both texts: 1 for equal texts, 0 for strangers.

    Spans are taken in order from the beginning: each is extended as far as it
    goes; the next one begins at the first window of :data:`ANCHOR` code points of
    a behind it whose first place in b lies behind it, too. Windows are met by
    their hash, and a place counts if the prefix arrays say that the spans are equal.
    """
    return spans(a, b)[0]


def spans(a: PrefixHash, b: PrefixHash) -> tuple[float, int]:
    """:func:`span_likeness`, and the length of the common beginning."""
    if not a.n or not b.n:
        return float(a.n == b.n), 0
    covered = i = j = begun = common_extension(a, 0, b, 0)
    if min(a.n - i, b.n - j) >= ANCHOR:
        own, other = a.windows(i, span=ANCHOR), b.windows(j, span=ANCHOR)
        froms, tos = _first_places(own, other)
        froms, tos = froms + i, tos + j
        k = 0
        while k < len(froms):
            ahead = np.flatnonzero((froms[k : k + 512] >= i) & (tos[k : k + 512] >= j))
            if not len(ahead):
                k += 512
                continue
            k += int(ahead[0])
            x, y = int(froms[k]), int(tos[k])
            size = common_extension(a, x, b, y)
            if size < ANCHOR:
                k += 1
                continue
            covered += size
            i, j = x + size, y + size
            k += size - ANCHOR + 1 if k + size - ANCHOR + 1 <= len(froms) and froms[k + size - ANCHOR] == x + size - ANCHOR else 1
    return 2 * covered / (a.n + b.n), begun


def _first_places(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``own`` stand hashes that ``other`` has, and where each of them stands first there."""
    x, y = np.sort(own), np.sort(other)
    if not (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).any():  # as usual
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(other, kind="stable")
    place = order[np.minimum(np.searchsorted(other, own, sorter=order), len(other) - 1)]
    met = np.flatnonzero(other[place] == own)
    return met, place[met]


def smallest(*hashes: np.ndarray) -> np.ndarray:
    """The :data:`KEPT` smallest distinct ones of all, in order."""
    parts = []
    for h in hashes:
        k = KEPT
        while len(h) > k:
            some = np.unique(np.partition(h, k - 1)[:k])
            if len(some) >= KEPT:
                h = some
                break
            k *= 4
        parts.append(h)
    return np.unique(np.concatenate(parts))[:KEPT] if parts else np.zeros(0, np.uint64)


def short(h: np.ndarray) -> np.ndarray:
    """64-bit hashes in 32 bits, in the same order: where the highest bit stands, and the 26 behind it.

    So the smallest hashes of a text keep as many telling bits however long it is.
    """
    high = np.searchsorted(TOPS, h, side="right").astype(np.uint64) - np.uint64(1)
    behind = h << (np.uint64(63) - high) << np.uint64(1) >> np.uint64(38)
    return (high << np.uint64(26) | behind).astype(np.uint32)


def fingerprint(n: int, whole: tuple[int, int], sketch: np.ndarray) -> str:
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}." + short(sketch).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of windows in common that two fingerprints show, from 0 to 1: twice those in both over those of either."""
    return 1.0 if a == b else _shared(*(set(f[k : k + 8] for k in range(f.rindex(".") + 1, len(f), 8)) for f in (a, b)))


def _shared(x: set[str], y: set[str]) -> float:
    if not x or not y:
        return 0.0
    both = x & y
    if not both:
        return 0.0
    least = sorted(x | y)[:KEPT]  # hexadecimal digits of one length are in the order of their numbers
    shared = sum(h in both for h in least) / len(least)
    return 2 * shared / (1 + shared)


def sketch_edited(a: PrefixHash, keep: int, b: PrefixHash, take: int, edited: PrefixHash) -> np.ndarray:
    """The sketch of a[:keep] + b[:take]: windows within either part, and those over the seam."""
    seam = edited.windows(max(0, keep - SPAN + 1), min(edited.n, keep + SPAN - 1))
    return smallest(a.windows(0, keep), b.windows(0, take), seam)


FIELDS = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()), T.StructField("span_edited", T.DoubleType()), T.StructField("span_next", T.DoubleType()), T.StructField("common_edited", T.LongType()), T.StructField("common_next", T.LongType())]


class _Document:
    def __init__(self, text: str):
        self.text, self.hash = text, PrefixHash.of(text)
        self.print = fingerprint(self.hash.n, self.hash.whole(), smallest(self.hash.windows()))


def _beside(doc: _Document, nxt: _Document) -> tuple:
    take = min(doc.hash.n // 2, nxt.hash.n)
    keep = doc.hash.n - doc.hash.n // 2
    edited = PrefixHash.spliced(doc.hash, keep, nxt.hash, take)
    mark = fingerprint(edited.n, edited.whole(), sketch_edited(doc.hash, keep, nxt.hash, take, edited))
    sha = hashlib.sha256((doc.text[:keep] + nxt.text[:take]).encode()).hexdigest()
    (span_edited, begun_edited), (span_next, begun_next) = spans(doc.hash, edited), spans(doc.hash, nxt.hash)
    return doc.hash.n, sha, doc.print, mark, likeness(doc.print, mark), likeness(doc.print, nxt.print), span_edited, span_next, begun_edited, begun_next


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with the fingerprints of each text and of its edited text, and how alike they are.

    near_*: by the fingerprints alone; span_*: exact, by equal spans; common_*: lengths of the common beginnings.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    n = rows.count()
    ranges = max(1, math.ceil(n / MANY_ROWS), min(math.ceil(n / FEW_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Rows of one id can still be dealt apart, by how their texts begin.
    dealt = rows.repartitionByRange(ranges, F.asc_nulls_first("id"), F.substring("body", 1, 32)).sortWithinPartitions(F.asc_nulls_first("id"), "body")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    fields = [T.StructField(doc_id, kind), *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_id, part, id_type = None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            id_type = batch.schema.field("id").type
            for i, body, p in zip(*(batch.column(c).to_pylist() for c in ("id", "body", "part")), strict=True):
                if held is None:
                    doc, part = _Document(body), p
                    yield _edge("first", part, i, body, doc_id, id_type)
                else:
                    doc = held if body == held.text else _Document(body)
                    out.append((held_id, *_beside(held, doc), None, None, None))
                held, held_id = doc, i
            if out:
                yield _record(out, doc_id, id_type, True)
        if held is not None:
            yield _edge("last", part, held_id, held.text, doc_id, id_type)

    got = stored(dealt.mapInArrow(run, T.StructType([*fields, T.StructField("edge", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("body", T.StringType())])), "fp-ranges", "zstd")
    names = [f.name for f in fields]
    # The numbers of the ranges that have rows, each with that of the next; behind the last comes the first.
    parts = got.filter("edge = 'first'").select("part")
    order = Window.orderBy("part")
    nexts = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    lasts = got.filter("edge = 'last'").select(F.col(f"`{doc_id}`").alias("id"), "part", "body").join(nexts, "part")
    pairs = lasts.join(got.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("body").alias("other")), "next").select("id", "body", "other")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *_beside(_Document(a), _Document(b))) for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "body", "other")), strict=True)]
            if out:
                yield _record(out, doc_id, batch.schema.field("id").type)

    closing = pairs.mapInArrow(close, T.StructType(fields))
    return got.filter("edge IS NULL").select(*[F.col(f"`{c}`") for c in names]).unionByName(closing)


def _edge(which: str, part: int, i, body: str, doc_id: str, id_type: pa.DataType) -> pa.RecordBatch:
    return _record([(i, *[None] * len(FIELDS), which, part, body)], doc_id, id_type, True)


def _record(rows: list[tuple], doc_id: str, id_type: pa.DataType, with_edge: bool = False) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[pa.string(), pa.int32(), pa.string()] * with_edge]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[doc_id, *[f.name for f in FIELDS], *["edge", "part", "body"] * with_edge])


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
