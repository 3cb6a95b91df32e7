"""Language-model scores from log-frequency Bloom filters.

Training counts tokens exactly and counts pairs of adjacent tokens by a 64-bit
hash. A count c is quantised to the level 1 + floor(log2 c); an n-gram is put
into a Bloom filter once for each level up to its own, and a reader probes level
after level until one misses: the last hit gives the count back as the middle
of its class. Filters are built in shards, one task each, from counts that the
shard's tasks have shuffled once; shards go to the workers as broadcasts.

The model interpolates: P(w|v) = LAMBDA * c(v,w)/c(v) + (1 - LAMBDA) * P1(w),
P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), with every c read from a filter and
c(v,w) at most c(v) and c(w). The base score takes the exact counts: tokens
frequent enough to fit a broadcast of at most :data:`COMMON` terms (16 bytes
each) are looked up in the worker by their hash, all others by a join on the
term itself. Frequent means frequent in all documents, held-out ones included,
so no term of the join is hot.

Beside the score stand its mean over the tokens and seen_elsewhere, the share of
the text's pairs that training has beyond the text itself: twice for a training
document, once for a held-out one. It is 1 for a text that occurs again.

Broadcasts are bounded by :data:`RESIDENT_BYTES` (or ``resident``), some 10 bits
being needed for each level of each distinct n-gram. Larger filters are held in
rounds. Terms fall into groups and pairs into cells of a group for the left and
one for the right token, so that a round that holds two groups of terms and
some shards of their cell has all that its pairs need; each pair is scored in
one round and the rounds' sums add up. A round reads the documents again and
writes a key and a sum for each, never the texts.

Defined results: a null text counts as empty and has one token, the end; a null
id counts as training; repeated rows count and are scored one by one; without
training tokens N and V are 0. Columns but the id and the text are not used,
whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_arrow_batches, stored, table, tidied
from corpusloom.llm.word_hashes import Run, hashed, mix, runs

FOLDS, HELD_OUT = 5, 1
#: Weight of the pair's relative frequency.
LAMBDA = 0.6
#: Probes for each level, and bits for each level of an n-gram: about 1 % false hits.
PROBES, BITS_PER_LEVEL = 6, 9
#: Terms in the broadcast of exact counts at most, and occurrences that each of them has at least.
#: Rarer terms always go through the join, so that small and large corpora take the same way.
COMMON, LEAST_COMMON = 1_000_000, 4
#: Pairs (before summing up) that one shard's task gets, about.
PAIRS_PER_SHARD = 3_000_000
#: Bytes of filters that a worker holds at a time.
RESIDENT_BYTES = 160 << 20
#: Bytes of texts whose terms are summed up at a time, and pairs that a worker sums up at least.
TERM_RUN, HELD_PAIRS = 8 << 20, 800_000
END = b"\n"  # no word can be this

U = np.uint64
PAIR, LEVEL = U(0xD6E8FEB86659FD93), 0xC2B2AE3D27D4EB4F
START_HASH, END_HASH = mix(np.array([1, 2], dtype=np.uint64))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * PAIR + right)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), exactly, for c from 1."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0 for 0, else the middle of [2^(l-1), 2^l)."""
    return np.where(levels > 0, 0.75 * 2.0**levels, 0.0) + np.where(levels == 1, -0.5, 0.0)


def _spots(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes for a level begin, and how far apart they are."""
    h = mix(hashes + U(level * LEVEL & 0xFFFFFFFFFFFFFFFF))
    return h, (h >> U(32)) | U(1)


def _spot(h: np.ndarray, bits: int) -> np.ndarray:
    return (((h & U(0xFFFFFFFF)) * U(bits)) >> U(32)).astype(np.int64)


class LogFrequencyFilter:
    """Bits in which an n-gram of level l was put for the levels 1 to l; fewer than 2^32 bits."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, bits_per_level: int = BITS_PER_LEVEL) -> LogFrequencyFilter:
        levels = levels_of(counts)
        bits = max(64, int(levels.sum()) * bits_per_level)
        flags = np.zeros(bits, dtype=bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            h, step = _spots(hashes[levels >= level], level)
            for _ in range(PROBES):
                flags[_spot(h, bits)] = True
                h = h + step
        return cls(bits, np.packbits(flags, bitorder="little"))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The last level that hits, going up from 1 until one misses."""
        out = np.zeros(len(hashes), dtype=np.int64)
        live, level = np.arange(len(hashes)), 0
        while len(live):
            level += 1
            h, step = _spots(hashes[live], level)
            for _ in range(PROBES):
                at = _spot(h, self.bits)
                hit = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, h, step = live[hit], h[hit] + step[hit], step[hit]
            out[live] = level
        return out


class Layout:
    """Where n-grams lie: groups of terms, ``per_group`` shards each; cells of pairs, ``per_cell`` shards each."""

    def __init__(self, groups: int, per_group: int, per_cell: int):
        self.groups, self.per_group, self.per_cell = groups, per_group, per_cell

    def group(self, terms: np.ndarray) -> np.ndarray:
        return ((terms & U(0xFFFFFFFF)) * U(self.groups) >> U(32)).astype(np.int64)

    def term_shard(self, terms: np.ndarray) -> np.ndarray:
        return self.group(terms) * self.per_group + _part(terms, self.per_group)

    def pair_shard(self, left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        return (self.group(left) * self.groups + self.group(right)) * self.per_cell + _part(pairs, self.per_cell)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a range of hashes that each lies in, from its upper half: sorted hashes have sorted parts."""
    return ((hashes >> U(32)) * U(parts) >> U(32)).astype(np.int64)


class ShardedFilter:
    """Some shards; hashes of shards that aren't held get -1."""

    def __init__(self, held: dict[int, LogFrequencyFilter]):
        self.held = held

    def levels(self, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
        if len(self.held) == 1 and not own.any() and 0 in self.held:
            return self.held[0].levels(hashes)
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(hashes):
            return out
        order = np.argsort(own, kind="stable")
        names, begins = np.unique(own[order], return_index=True)
        for s, at in zip(names.tolist(), np.split(order, begins[1:]), strict=True):
            if s in self.held:
                out[at] = self.held[s].levels(hashes[at])
        return out


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def count_terms(docs: DataFrame) -> DataFrame:
    """term (binary), n over the tokens of training documents and n_all over all, the end among them; summed in the worker before the shuffle.

    docs: body and training (boolean).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(np.int64)
            for r in runs(batch.column("body"), TERM_RUN):
                own = training[r.first : r.first + len(r.sizes)]
                _, first, at, n_all = np.unique(r.hashes, return_index=True, return_inverse=True, return_counts=True)
                n = np.bincount(at, weights=np.repeat(own, r.sizes), minlength=len(first)).astype(np.int64)
                sizes = (r.ends - r.begins)[first]
                edges = np.concatenate([[0], np.cumsum(sizes)])
                every = np.frombuffer(r.data, dtype=np.uint8)[np.arange(edges[-1]) + np.repeat(r.begins[first] - edges[:-1], sizes)]
                terms = _binary(every.tobytes() + END, np.append(edges, edges[-1] + 1))
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.append(n, own.sum())), pa.array(np.append(n_all, len(own)).astype(np.int64))], names=["term", "n", "n_all"])

    return docs.select("body", "training").mapInArrow(run, "term binary, n long, n_all long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def tokens_of(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens before and at each place (the start before, the end after each text), and the text each belongs to."""
    sizes = run.sizes + 1
    ends = np.cumsum(sizes) - 1
    right = np.full(int(sizes.sum()), END_HASH)
    inner = np.ones(len(right), dtype=bool)
    inner[ends] = False
    right[inner] = run.hashes
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[ends - sizes + 1] = START_HASH
    return left, right, np.repeat(np.arange(len(sizes)), sizes)


def _home(left: np.ndarray) -> np.ndarray:
    """The hashes by which groups are chosen: the start, as often as the end, lies with it."""
    return np.where(left == START_HASH, END_HASH, left)


def count_pairs(docs: DataFrame, layout: Layout) -> DataFrame:
    """Hashes and counts of adjacent tokens by shard, packed, summed within the worker but not between workers.

    A worker holds more pairs where there are more shards, so that what it writes for one of them doesn't become tiny.
    """
    most = min(max(HELD_PAIRS, 4 * layout.groups**2 * layout.per_cell), 8 * HELD_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in runs(batch.column("body")):
                left, right, _ = tokens_of(r)
                pairs = pair_hash(left, right)
                held.append((pairs, layout.pair_shard(_home(left), right, pairs) if layout.groups > 1 else None))
                size += len(pairs)
                if size > most:
                    yield _counted(held)
                    held, size = [], 0
        if size:
            yield _counted(held)

    def _counted(held: list[tuple]) -> pa.RecordBatch:
        every = np.concatenate([x for x, _ in held])
        if layout.groups == 1:
            pairs, n = np.unique(every, return_counts=True)
            return _blobs(_part(pairs, layout.per_cell), pairs, n)
        pairs, first, n = np.unique(every, return_index=True, return_counts=True)
        return _blobs(np.concatenate([x for _, x in held])[first], pairs, n)

    return docs.select("body").mapInArrow(run, BLOBS)


BLOBS = "shard int, hashes binary, counts binary"


def _blobs(own: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its hashes, and their counts in as few bytes each as hold the largest."""
    order = np.argsort(own, kind="stable")  # in linear time where shards come in order
    own, hashes, n = own[order], hashes[order], n[order].astype(np.min_scalar_type(int(n.max(initial=0))))
    begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    edges = np.append(begins, len(own))
    packed = [_binary(x.tobytes(), edges * x.dtype.itemsize) for x in (hashes, n)]
    return pa.RecordBatch.from_arrays([pa.array(own[begins].astype(np.int32)), *packed], names=["shard", "hashes", "counts"])


def _binary(data: bytes, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _counts_of(hashes: bytes, counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(counts) * 8 // max(len(hashes), 1) or 1}").astype(np.int64)


def build_filter(counts: DataFrame) -> DataFrame:
    """A row for each shard with its filter; a shard's counts are bounded by the number of shards that the caller took."""
    bits_per_level = BITS_PER_LEVEL

    def build(table: pa.Table) -> pa.Table:
        parts = [(x.as_py(), y.as_py()) for x, y in zip(table.column("hashes"), table.column("counts"), strict=True)]
        hashes, n = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in parts]), np.concatenate([_counts_of(x, y) for x, y in parts])
        order = np.argsort(hashes, kind="stable")
        hashes, n = hashes[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        got = LogFrequencyFilter.build(hashes[first], np.add.reduceat(n, first), bits_per_level)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "bits": pa.array([got.bits], pa.int64()), "data": pa.array([got.data.tobytes()], pa.binary())})

    return counts.groupBy("shard").applyInArrow(build, "shard int, bits long, data binary")


def _broadcast(context: SparkContext, rows: list) -> object:
    """Shards of collected rows, whose sizes the caller has checked; a row is given up once its bytes are taken."""
    return context.broadcast([(r["shard"], r["bits"], bytes(r["data"])) for r in (rows.pop() for _ in range(len(rows)))])


def _held(value: list) -> ShardedFilter:
    return ShardedFilter({s: LogFrequencyFilter(bits, np.frombuffer(data, dtype=np.uint8)) for s, bits, data in value})


@tidied
def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", resident: int | None = None) -> DataFrame:
    """The id with held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token and seen_elsewhere.

    resident: bytes of filters that a worker holds at a time, :data:`RESIDENT_BYTES` by default; a
    cluster with more memory takes fewer rounds with a larger number, to the same results.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    small_arrow_batches(spark)
    resident = resident or RESIDENT_BYTES
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"))
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS))
    docs = docs.withColumn("training", F.coalesce(fold != HELD_OUT, F.lit(True)))

    terms = stored(count_terms(docs).mapInArrow(_with_hash, "term binary, n long, n_all long, hash long"), "lm-terms")
    found = terms.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("distinct"), F.count("*").alias("every")).first()
    total, distinct = found["total"] or 0, found["distinct"]
    common = _is_common(terms, found["every"])
    exact = terms.filter(common).select("hash", "n").toArrow()
    keys, counts = exact.column("hash").to_numpy().view(np.uint64), exact.column("n").to_numpy()
    order = np.argsort(keys)
    lookup = context.broadcast((keys[order], counts[order]))

    # The number of tokens bounds what a shard's task gets. Two groups of terms take a quarter of the room together at most.
    trained = terms.filter("n > 0")
    term_bytes = (trained.agg(F.sum(F.floor(F.log2("n")) + 1)).first()[0] or 0) * BITS_PER_LEVEL / 8
    groups = 1 if term_bytes <= resident / 4 else math.ceil(term_bytes / (resident / 8))
    layout = Layout(groups, max(1, math.ceil(distinct / PAIRS_PER_SHARD / groups)), max(1, math.ceil(total / PAIRS_PER_SHARD / groups**2)))
    unigrams = stored(build_filter(trained.select("hash", "n").mapInArrow(_packed(layout), BLOBS)), "lm-unigrams")
    bigrams = stored(build_filter(count_pairs(docs.filter("training"), layout)), "lm-bigrams")

    norm = total + 0.5 * (distinct + 1)
    plan = _rounds({r["shard"]: r["bits"] // 8 + 1 for r in bigrams.select("shard", "bits").toLocalIterator()}, layout, resident * 3 // 4)
    passes = []
    for k, (cell, shards) in enumerate(plan):
        held = sorted({*divmod(cell, groups)})
        ones = _broadcast(context, unigrams.filter(F.floor(F.col("shard") / layout.per_group).isin(held)).collect())
        twos = _broadcast(context, bigrams.filter(F.col("shard").between(shards[0], shards[-1])).collect() if shards else [])
        got = stored(_round(docs, lookup if k == 0 else None, ones, twos, layout, cell, (shards[0], shards[-1]) if shards else (0, -1), norm), "lm-rows" if k == 0 else "lm-round")
        ones.destroy()
        twos.destroy()
        passes.append(got)
    lookup.destroy()
    rows = passes[0].withColumn("row", F.monotonically_increasing_id())
    if len(passes) > 1:
        # Rows with one key have one text, so each round has one sum for all of them.
        later = [p.withColumn("round", F.lit(k)) for k, p in enumerate(passes[1:])]
        sums = later[0]
        for p in later[1:]:
            sums = sums.union(p)
        sums = sums.groupBy("key", "round").agg(F.max("part").alias("part"), F.max("elsewhere").alias("elsewhere")).groupBy("key").agg(F.sum("part").alias("rest"), F.sum("elsewhere").alias("more"))
        rows = rows.join(sums, "key").withColumns({"part": F.col("part") + F.col("rest"), "elsewhere": F.col("elsewhere") + F.col("more")})
        rows = stored(rows.drop("rest", "more"), "lm-summed")
    return _with_rare(rows.withColumnRenamed("part", "score"), terms.filter(~common).select("term", "n"), norm, doc_id, total)


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = hashed(batch.column("term").to_pylist())
        h = np.full(len(r.sizes), END_HASH)
        h[r.sizes == 1] = r.hashes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "hash"])


def _packed(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("n").to_numpy(zero_copy_only=False)
            yield _blobs(layout.term_shard(h), h, n)

    return run


def _is_common(terms: DataFrame, every: int):
    """Whether a term is looked up in the broadcast: at least :data:`LEAST_COMMON` occurrences in all documents, and
    as many sixteenths of an octave as leave at most :data:`COMMON` such terms."""
    level = F.floor(F.log2("n_all") * 16)
    enough = F.col("n_all") >= LEAST_COMMON
    if every <= COMMON:
        return enough
    held, least = 0, 1 << 20
    for r in sorted(terms.filter(enough).groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):  # at most 16 * 64 rows
        held += r["k"]
        if held > COMMON:
            break
        least = r["level"]
    return enough & (level >= least)


def _rounds(sizes: dict[int, int], layout: Layout, most: int) -> list[tuple[int, list[int]]]:
    """Cells with shards in order, whose filters together fit ``most`` bytes; every cell has a round, if only of an empty list."""
    out = []
    for cell in range(layout.groups**2):
        run, held = [], 0
        for s in range(cell * layout.per_cell, (cell + 1) * layout.per_cell):
            if run and held + sizes.get(s, 0) > most:
                out.append((cell, run))
                run, held = [], 0
            run.append(s)
            held += sizes.get(s, 0)
        out.append((cell, run))
    return out


FIRST = "key string, id {0}, n_tokens long, known long, base double, rare array<binary>, times array<long>, part double, elsewhere long"


def _round(docs: DataFrame, lookup, uni, pairs, layout: Layout, cell: int, shards: tuple[int, int], norm: float) -> DataFrame:
    """One pass over the texts: the sums over the pairs of the shards in question, and with ``lookup`` the base counts of common terms."""
    kind = docs.schema["id"].dataType.simpleString()
    groups = divmod(cell, layout.groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = _held(uni.value), _held(pairs.value)
        exact = lookup.value if lookup is not None else None
        every = shards == (cell * layout.per_cell, (cell + 1) * layout.per_cell - 1)
        texts = count_of(ones.levels(np.array([END_HASH]), layout.term_shard(np.array([END_HASH]))))[0]
        for batch in batches:
            ids, training = batch.column("id"), batch.column("training").to_numpy(zero_copy_only=False).astype(np.int64)
            for r in runs(batch.column("body")):
                left, right, owner = tokens_of(r)
                n = len(r.sizes)
                seen, at = np.unique(right, return_inverse=True)
                after = count_of(ones.levels(seen, layout.term_shard(seen)))[at]
                before = np.append(texts, after[:-1])
                before[left == START_HASH] = texts  # as many texts begin as end
                begins = np.concatenate([[0], np.cumsum(r.sizes + 1)])
                digests = (xxhash.xxh3_128_hexdigest(right[a:b].tobytes()) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False))
                columns = {"key": pa.array([f"{i}:{d}" for i, d in zip(ids.slice(r.first, n).to_pylist(), digests, strict=True)], pa.string())}
                if exact is not None:
                    columns |= {"id": ids.slice(r.first, n)} | _base(r, at, owner, *_base_values(seen, exact, norm))
                hashes = pair_hash(left, right)
                if not every or layout.groups > 1:
                    here = np.arange(len(left)) if layout.groups == 1 else np.flatnonzero((layout.group(_home(left)) == groups[0]) & (layout.group(seen)[at] == groups[1]))
                    if not every:
                        own = layout.pair_shard(_home(left[here]), right[here], hashes[here])
                        here = here[(own >= shards[0]) & (own <= shards[1])]
                    left, right, hashes, owner, before, after = (x[here] for x in (left, right, hashes, owner, before, after))
                asked, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                level = twos.levels(asked, layout.pair_shard(_home(left[first]), right[first], asked) if layout.groups > 1 else _part(asked, layout.per_cell))[which]
                single = (after + 0.5) / norm if norm else 1.0
                both = np.minimum(np.minimum(count_of(np.maximum(level, 0)), after), before)
                p = LAMBDA * np.divide(both, before, out=np.zeros_like(both), where=before > 0) + (1 - LAMBDA) * single
                columns["part"] = pa.array(np.bincount(owner, weights=np.log10(p), minlength=n), pa.float64())
                columns["elsewhere"] = pa.array(np.bincount(owner, weights=level > training[r.first + owner], minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select("id", "body", "training").mapInArrow(run, FIRST.format(kind) if lookup is not None else "key string, part double, elsewhere long")


def _base_values(hashes: np.ndarray, exact: tuple[np.ndarray, np.ndarray], norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether ``exact`` has each hash, whether with training occurrences, and what it adds to the base score."""
    keys, counts = exact
    if not len(keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), bool), np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    found = keys[at] == hashes
    return found, found & (counts[at] > 0), np.where(found, np.log10((counts[at] + 0.5) / (norm or 1)), 0.0)


def _base(r: Run, at: np.ndarray, owner: np.ndarray, found: np.ndarray, trained: np.ndarray, value: np.ndarray) -> dict[str, pa.Array]:
    """Counts and log sums of the tokens that the broadcast has; the others with their number in the text.

    at: for each token the place of its facts; the ends are the last token of each text.
    """
    n = len(r.sizes)
    places = np.arange(len(at)) - owner  # of the word, if it isn't an end
    rest = np.flatnonzero(~found[at])
    # Each text's rare tokens, equal ones side by side.
    order = rest[np.lexsort((at[rest], owner[rest]))]
    firsts = np.flatnonzero(np.concatenate([[True], (at[order][1:] != at[order][:-1]) | (owner[order][1:] != owner[order][:-1])])) if len(order) else np.zeros(0, np.int64)
    ends = np.cumsum(r.sizes + 1) - 1
    told = [END if k == ends[i] else r.word(p) for k, i, p in zip(*(x[order[firsts]].tolist() for x in (np.arange(len(at)), owner, places)), strict=True)]
    edges = pa.array(np.searchsorted(owner[order[firsts]], np.arange(n + 1)).astype(np.int32))
    return {
        "n_tokens": pa.array(r.sizes + 1, pa.int64()),
        "known": pa.array(np.bincount(owner, weights=trained[at], minlength=n).astype(np.int64), pa.int64()),
        "base": pa.array(np.bincount(owner, weights=value[at], minlength=n), pa.float64()),
        "rare": pa.ListArray.from_arrays(edges, pa.array(told, pa.binary())),
        "times": pa.ListArray.from_arrays(edges, pa.array(np.diff(np.append(firsts, len(order))), pa.int64())),
    }


def _with_rare(rows: DataFrame, rare_counts: DataFrame, norm: float, doc_id: str, total: int) -> DataFrame:
    """Adds what the tokens outside the broadcast contribute, looked up by a join on the term."""
    told = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("term"), F.col("x.times").alias("k"))
    c = F.coalesce(F.col("n"), F.lit(0))
    met = told.join(rare_counts, "term", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + F.lit(0.5)) / F.lit(float(norm or 1)))).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("also")
    )
    out = rows.select("row", "id", "n_tokens", "known", "base", "score", "elsewhere").join(met, "row", "left")
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(FOLDS))
    return out.select(
        F.col("id").alias(doc_id),
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"),
        (F.col("elsewhere") / F.col("n_tokens")).alias("seen_elsewhere"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    out = op5_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


#: The fold is CRC-32 of the id as text, here from its table of 256 entries, which is made by rule.
LM_BASE_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w,
         coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                      lambda a, x: xor(t[1 + xor(a % 256, x)], a // 256)), 4294967295) % {FOLDS} = {HELD_OUT}, false) AS held_out
  FROM documents, crc),
tok AS MATERIALIZED (SELECT rid, held_out, w, count(*) AS k FROM (SELECT rid, held_out, unnest(w) AS w FROM d) GROUP BY ALL),
c AS MATERIALIZED (SELECT w, sum(k)::BIGINT AS n FROM tok WHERE NOT held_out GROUP BY w),
z AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, coalesce(sum(n), 0) + 0.5 * (count(*) + 1) AS norm FROM c),
s AS (SELECT rid, sum(k)::BIGINT AS n_tokens, coalesce(sum(k) FILTER (n > 0), 0)::BIGINT AS n_known, sum(k * log10((coalesce(n, 0) + 0.5)::DOUBLE / norm::DOUBLE)) AS base
      FROM tok LEFT JOIN c USING (w), z GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, total AS train_tokens, round(base, 3) AS base_score FROM d JOIN s USING (rid), z
"""

QUERIES = {"op5_lm_scoring": op5_lm_scoring, "lm_base_scores": lm_base_scores}
ORACLES = {"lm_base_scores": LM_BASE_SQL}
