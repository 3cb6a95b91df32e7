"""Removal of word sequences that an earlier document has, by level-wise doubling.

A window of the wanted length can only stand in two documents if its halves do.
So windows are first looked at with a quarter of the length, at every word of the
corpus; those that are repeated, and they alone, are extended to twice that
length, and so on up to the wanted one, or until no candidates survive.

Texts are packed into runs of some megabytes, written once; a run has a name that
later passes can refer to. At each level a run sends each of its distinct windows
once, as a short hash, to one of many buckets, all windows of a bucket in one binary;
a bucket finds what more than one run has sent and answers with a bit for each.
Only bits go back to the texts. A short hash that agrees by chance merely
survives to the next level. The last level compares 64 further bits within a
bucket, together with the smallest document a run has for the window, and answers
whether another run has a smaller one. Among 10^13 windows about half a pair
agrees by chance there.

However often a window is repeated, a run sends it once, and a bucket holds
about :data:`BUCKET_WORDS` windows; nothing is cut off.

Defined results: a null or empty text has no words; texts shorter than a window
keep all; a document with a null id neither loses words nor makes others lose
theirs; rows with one id don't take from each other; a window that is repeated within
one document alone stays; an empty table gives no rows; columns but the id (a
whole number) and the text are not used, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_arrow_batches, stored, table, tidied
from corpusloom.llm.word_hashes import MIX_A, U, _Powers, hashed, mix

LENGTH, START = 50, 13
#: Bytes of texts in a run, about; a longer text is a run of its own.
PACK_BYTES = 4 << 20
#: Windows that a bucket receives, about.
BUCKET_WORDS = 1 << 20
#: Bytes of answers that may be broadcast; beyond, they are joined with the runs by a shuffle.
BROADCAST_BYTES = 64 << 20


def lengths(length: int = LENGTH, start: int = START) -> list[int]:
    """The lengths of the levels: each is twice the one before, less one where that is odd."""
    out = [length]
    while out[0] > start:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """The word hashes of a run, with the document of each word and where its text ends."""

    def __init__(self, ids: list, sizes: list[int], body: bytes):
        ends = np.cumsum(sizes)
        self.run = hashed([body[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)], lower=False)
        self.n = self.run.sizes
        self.last = np.repeat(np.cumsum(self.n), self.n)
        self.ids = np.repeat(np.array([0 if i is None else i for i in ids], np.int64), self.n)
        self.named = np.repeat(np.array([i is not None for i in ids], bool), self.n)

    def begins(self, length: int) -> np.ndarray:
        """Where windows of named documents begin, as flags."""
        return self.named & (np.arange(len(self.last)) + length <= self.last)

    def hashes(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        h = mix(self.run.hashes ^ MIX_A) if second else self.run.hashes
        up, down = _Powers.of(len(h))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up, out=sums[1:])
        return mix((sums[at + length] - sums[at]) * down[at] + U(length))


class Level:
    """The distinct windows of one length at some places of a run, in the order in which they are sent."""

    def __init__(self, words: Words, candidates: np.ndarray, length: int, buckets: int):
        self.at = np.flatnonzero(candidates)
        h = words.hashes(self.at, length)
        order = np.argsort(h, kind="stable")
        new = np.diff(h[order], prepend=~h[order[:1]]) != 0
        firsts = np.flatnonzero(new)
        self.hashes, self.leads = h[order][firsts], self.at[order][firsts]
        ids = words.ids[self.at]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.least, self.most = (f.reduceat(ids[order], firsts) if len(firsts) else ids for f in (np.minimum, np.maximum))
        # Buckets rise with the hash.
        bucket = ((self.hashes >> U(32)) * U(buckets)) >> U(32)
        self.buckets, cuts = np.unique(bucket, return_index=True)
        self.cuts = np.append(cuts, len(self.hashes))

    def flags(self, told: list[dict]) -> np.ndarray:
        """What the buckets have answered, for each place."""
        out, by = np.zeros(len(self.hashes), bool), {x["bucket"]: x["bits"] for x in told}
        for k, b in enumerate(self.buckets.tolist()):
            if b in by:
                lo, hi = self.cuts[k], self.cuts[k + 1]
                out[lo:hi] = np.unpackbits(np.frombuffer(zlib.decompress(by[b]), np.uint8), count=hi - lo)
        return out[self.which]


def packed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (run, ids, sizes, body, words): the texts of some documents, one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bodies, size = [], [], 0
        for batch in batches:
            for i, body in zip(batch.column("id").to_pylist(), batch.column("body"), strict=True):
                body = body.as_py()
                if bodies and size + len(body) > PACK_BYTES:
                    yield _pack(ids, bodies)
                    ids, bodies, size = [], [], 0
                ids.append(i)
                bodies.append(body)
                size += len(body)
        if bodies:
            yield _pack(ids, bodies)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(run, "run string, ids array<long>, sizes array<int>, body binary, words long")


def _pack(ids: list, bodies: list[bytes]) -> pa.RecordBatch:
    n = sum(len(b.split()) for b in bodies)
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(b) for b in bodies]], pa.list_(pa.int32())), pa.array([b"".join(bodies)], pa.binary()), pa.array([n], pa.int64())], names=["run", "ids", "sizes", "body", "words"]
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _survivors(words: Words, told: list[dict], levels: list[int], k: int, buckets: int) -> np.ndarray:
    """Where windows of level k may be repeated, as flags, by the answers to level k-1."""
    if not k:
        return words.begins(levels[0])
    before = np.zeros(len(words.last), bool)
    level = Level(words, _candidates(words, told, levels, k - 1), levels[k - 1], buckets)
    before[level.at] = level.flags(told) | (level.least != level.most)[level.which]
    out = words.begins(levels[k])
    step = levels[k] - levels[k - 1]
    return out & before & np.append(before[step:], np.zeros(min(step, len(before)), bool))


def _candidates(words: Words, told: list[dict], levels: list[int], k: int) -> np.ndarray:
    """The places that were sent at level k: all at the first, else as the run has noted them."""
    if not k:
        return words.begins(levels[0])
    noted = next(x["bits"] for x in told if x["bucket"] == -1)
    return np.unpackbits(np.frombuffer(zlib.decompress(noted), np.uint8), count=len(words.last)).astype(bool)


def _bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _asked(runs: DataFrame, levels: list[int], k: int, buckets: int) -> DataFrame:
    """Each run's windows of level k by bucket, and where they are (bucket -1, dealt out by the run's name)."""
    last = k == len(levels) - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if k > 1 and not row["told"]:  # nothing was sent
                continue
            words = Words(row["ids"], row["sizes"], row["body"])
            level = Level(words, flags := _survivors(words, row.get("told") or [], levels, k, buckets), levels[k], buckets)
            if not len(level.at):
                continue
            values = words.hashes(level.leads, levels[k], True) if last else level.hashes.astype(np.uint32)
            base = int(level.least.min())
            wide = int(level.least.max()) - base >= 1 << 32
            ids = (level.least - base).astype(np.uint64 if wide else np.uint32)
            parts = [(values[a:b].tobytes(), ids[a:b].tobytes() if last else None) for a, b in zip(level.cuts[:-1], level.cuts[1:], strict=True)]
            to = level.buckets.tolist()
            if k:
                parts.append((_bits(flags), None))
                to = [*to, -1]
            group = [b if b >= 0 else -1 - zlib.crc32(row["run"].encode()) % buckets for b in to]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["run"]] * len(to)), pa.array(group, pa.int32()), pa.array(to, pa.int32()), pa.array([base] * len(to), pa.int64()), pa.array([wide] * len(to)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())],
                names=["run", "group", "bucket", "base", "wide", "sent", "ids"],
            )

    return runs.mapInArrow(ask, "run string, group int, bucket int, base long, wide boolean, sent binary, ids binary")


def _answered(asked: DataFrame, last: bool) -> DataFrame:
    """For each run and bucket a bit for each window: whether another run has it, in the end with a smaller document."""

    def answer(rows: pa.Table) -> pa.Table:
        runs, to = rows.column("run").to_pylist(), rows.column("bucket").to_pylist()
        sent = rows.column("sent").to_pylist()
        if to[0] < 0:
            return pa.table({"run": runs, "bucket": pa.array(to, pa.int32()), "bits": pa.array(sent, pa.binary())})
        values = [np.frombuffer(x, np.uint64 if last else np.uint32) for x in sent]
        together = np.concatenate(values)
        if last:
            ids = np.concatenate([np.frombuffer(x, np.uint64 if w else np.uint32).astype(np.int64) + b for x, w, b in zip(*(rows.column(c).to_pylist() for c in ("ids", "wide", "base")), strict=True)])
            order = np.argsort(together, kind="stable")
            new = np.diff(together[order], prepend=~together[order[:1]]) != 0
            least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
            flags = np.empty(len(order), bool)
            flags[order] = least[np.cumsum(new) - 1] < ids[order]
        else:
            ordered = np.sort(together)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            flags = twice[np.minimum(np.searchsorted(twice, together), len(twice) - 1)] == together if len(twice) else np.zeros(len(together), bool)
        cuts = np.cumsum([0, *map(len, values)])
        told = [(r, b, _bits(part)) for r, b, x, y in zip(runs, to, cuts[:-1], cuts[1:], strict=True) if (part := flags[x:y]).any()]
        return pa.table({"run": pa.array([t[0] for t in told], pa.string()), "bucket": pa.array([t[1] for t in told], pa.int32()), "bits": pa.array([t[2] for t in told], pa.binary())})

    return asked.groupBy("group").applyInArrow(answer, "run string, bucket int, bits binary")


def _told(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """``runs`` with what all buckets have told each."""
    told = stored(answers.groupBy("run").agg(F.collect_list(F.struct("bucket", "bits")).alias("told")), "repeats-told")
    size = told.agg(F.sum(F.aggregate("told", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["bits"]) + 16))).first()[0] or 0
    return runs.join(F.broadcast(told) if size <= BROADCAST_BYTES else told.hint("merge"), "run", "left")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by blanks) and spans (first and, exclusive, last word of each part removed).

    A word goes if a window of ``length`` words that covers it also begins in a document with a smaller id.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    kind = docs.schema[doc_id].dataType
    # Row groups of a few runs, as readers hold one whole.
    runs = stored(packed(docs, doc_id, text), "repeats-runs", "zstd", **{"parquet.block.row.count.limit": "4"})
    words = runs.agg(F.sum("words")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_WORDS))
    levels = lengths(length, start)
    rows = runs.select("run", "ids", "sizes", "body")
    for k in range(len(levels)):
        last = k == len(levels) - 1
        asked = _asked(rows, levels, k, buckets)
        rows = _told(runs.select("run", "ids", "sizes", "body"), _answered(asked, last))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if row["told"] or len(levels) == 1:
                told = row["told"] or []
                found = Words(row["ids"], row["sizes"], row["body"])
                level = Level(found, _candidates(found, told, levels, len(levels) - 1), length, buckets)
                gone = level.flags(told) | (level.least[level.which] < found.ids[level.at])
                yield _cut(row["ids"], found, level.at[gone], length)
            else:
                yield _whole(row["ids"], row["sizes"], row["body"])

    out = rows.mapInArrow(remove, "id long, n_words long, n_removed long, kept string, spans array<struct<first:long,upto:long>>")
    return out.select(F.col("id").cast(kind).alias(doc_id), "n_words", "n_removed", "kept", "spans")


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("upto", pa.int64())]))


def _result(ids: list, n: list, gone: list, kept: list[bytes], spans: list) -> pa.RecordBatch:
    texts = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), texts, pa.array(spans, SPANS)], names=["id", "n_words", "n_removed", "kept", "spans"])


def _whole(ids: list, sizes: list[int], body: bytes) -> pa.RecordBatch:
    ends = np.cumsum(sizes).tolist()
    words = [body[e - s : e].split() for e, s in zip(ends, sizes, strict=True)]
    return _result(ids, [len(w) for w in words], [0] * len(ids), [b" ".join(w) for w in words], [[] for _ in ids])


def _cut(ids: list, found: Words, starts: np.ndarray, length: int) -> pa.RecordBatch:
    run, cover = found.run, np.zeros(len(found.last) + 1, np.int64)
    cover[starts] += 1
    np.subtract.at(cover, starts + length, 1)
    gone = np.cumsum(cover)[:-1] > 0
    firsts = np.concatenate([[0], np.cumsum(found.n)]).tolist()
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    # A part removed may run on into the next text: it is cut there.
    kept, spans, removed = [], [], []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        own = edge[np.searchsorted(edge, a, side="right") : np.searchsorted(edge, b, side="left")].tolist()
        points = [a, *own, b]
        dead = bool(gone[a]) if a < b else False
        words, cut = [], []
        for x, y in zip(points[:-1], points[1:], strict=True):
            if dead:
                cut.append({"first": x - a, "upto": y - a})
            elif x < y:
                words += run.data[run.begins[x] : run.ends[y - 1]].split()
            dead = not dead
        kept.append(b" ".join(words))
        spans.append(cut)
        removed.append(sum(c["upto"] - c["first"] for c in cut))
    return _result(ids, found.n.tolist(), removed, kept, spans)


@tidied
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, sha256(array_to_string(w[i : i + {LENGTH} - 1], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS i FROM d)),
gone AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id),
cov AS MATERIALIZED (SELECT DISTINCT rid, i + j AS i FROM gone, (SELECT unnest(range({LENGTH})) AS j)),
kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN cov USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLES = {"op11_substring_dedup": OP11_SQL}
