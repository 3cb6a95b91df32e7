"""Similarity join of documents on word shingles, complete for a Jaccard threshold.

Each document becomes the set of its shingles' 64-bit hashes. Documents with
equal sets form a class; only classes are compared. Two sets reach the threshold
only if they share one of their first few elements in a common order (prefix
filter), so classes meet in groups by such elements. The order is that of the
hashes, but elements that several documents have in their prefix come last and
thereby leave nearly all prefixes. A broadcast bitmap of fixed size tells them,
by a hash; whom it takes along by chance comes last, too, in every document.

Groups are cut by size band, since sets of too different sizes can't reach the
threshold, and large ones into tiles; each pair of tiles is a unit of work.
In a unit hashed bitmaps bound the overlap from above: bits of one that the
other lacks each stand for a shingle that isn't shared. Bitmaps are as wide as
their set asks for, and a wider one is folded to meet a narrower one. What
passes the bound is linked to a candidate cluster, written as a spanning forest,
never as all pairs. Clusters are few and small; their classes' sorted arrays are
then compared exactly, again in tiles, and again only a spanning forest is
written. Connected components of these true links are the result.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; a text with fewer words than a shingle is one
shingle; repeated rows are one class; a null id takes part, but is the smallest
id of a component only where there is no other; rows that share an id but not
the text are told apart by their texts; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, broadcast_if_small, small_arrow_batches, stored, table, tidied
from corpusloom.llm.word_hashes import mix, runs, sorted_distinct

U = np.uint64
#: Bits of a signature at least and at most, each a power of two.
BITS, MOST_BITS = 256, 1 << 14
#: Classes in a tile, about.
TILE = 1024
#: Elements at the head of a prefix by which most classes that belong together are found first.
EARLY = 4
#: Documents with an element in their prefix from which it comes last in the order.
FREQUENT = 8
#: Bits of a map of elements (4 MB), and frequent elements that one takes at most; of more, those that most documents have
#: are moved, and the groups of the others are cut into tiles like all groups.
MAP_BITS, SLICE_BITS = 1 << 25, 1 << 20
MOST_FREQUENT = MAP_BITS // 2


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for run in runs(texts):
        sizes, h = run.sizes, run.hashes
        starts = np.cumsum(sizes) - sizes
        whole = _folded(h, np.arange(max(len(h) - width + 1, 0)), width)
        for size, start in zip(sizes.tolist(), starts.tolist(), strict=True):
            if size >= width:
                yield sorted_distinct(whole[start : start + size - width + 1])
            else:
                yield _folded(h, np.array([start]), size) if size else h[:0]


def _folded(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place on."""
    out = np.full(len(at), U(width))
    for k in range(width):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at + k])
    return out


def prefix_size(n: int, percent: int) -> int:
    """Elements of a set of n, one of which any set with at least that Jaccard likeness has in its prefix, too."""
    return n - -(-n * percent // 100) + 1


def bits_for(n: int) -> int:
    """A width at which the bound of strangers stays well below the usual thresholds: a bit for each element at least."""
    return min(max(BITS, 1 << max(n - 1, 0).bit_length()), MOST_BITS)


def bitmap(hashes: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, dtype=bool)
    flags[(hashes & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of words, each folded to the width of the narrowest: a bit stands where it would have stood there."""
    width = min(map(len, maps))
    if all(len(m) == width for m in maps):
        return np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(len(maps), -1)
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, width // 8), axis=0) for m in maps])


def _map_place(hashes: np.ndarray) -> np.ndarray:
    """The bit of a hash in a map of elements."""
    return (hashes * U(0x9E3779B97F4A7C15) >> U(64 - (MAP_BITS - 1).bit_length())).astype(np.int64)


def _in_map(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _map_place(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def prefix_of(s: np.ndarray, percent: int, last: np.ndarray | None = None) -> np.ndarray:
    """The prefix of a sorted set in the order in which elements with a bit in ``last`` come last."""
    size = prefix_size(len(s), percent) if len(s) else 0
    if last is None or not size:
        return s[:size].view(np.int64)
    is_last = _in_map(s, last)
    return np.concatenate([s[~is_last], s[is_last]])[:size].view(np.int64)


def _frequent(docs: DataFrame, width: int, percent: int):
    """A broadcast of the map of elements that at least :data:`FREQUENT` documents have in their prefix, or None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_of(s, percent) for s in shingle_sets(batch.column("body"), width)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["e"])

    counts = docs.select("body").mapInArrow(run, "e long").groupBy("e").agg(F.count("*").alias("k")).filter(F.col("k") >= FREQUENT)
    often = stored(counts, "ng-frequent")
    n = often.count()
    if not n:
        return None
    if n > MOST_FREQUENT:
        level, held, least = F.floor(F.log2("k") * 16), 0, 1 << 20
        for r in sorted(often.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):  # at most 16 * 64 rows
            held += r["k"]
            if held > MOST_FREQUENT:
                break
            least = r["level"]
        often = often.filter(level >= least)

    return _element_map(often.select("e"))


def _element_map(elements: DataFrame):
    """A broadcast of the map of the elements e; its size is fixed, whatever their number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _map_place(batch.column("e").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((at // SLICE_BITS).astype(np.int32)), pa.array((at % SLICE_BITS).astype(np.int32))], names=["slice", "bit"])

    def build(t: pa.Table) -> pa.Table:
        flags = np.zeros(SLICE_BITS, dtype=bool)
        flags[t.column("bit").to_numpy()] = True
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    slices = elements.mapInArrow(places, "slice int, bit int").distinct().groupBy("slice").applyInArrow(build, "slice int, bits binary")
    out = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in slices.toLocalIterator():  # MAP_BITS / SLICE_BITS rows at most
        out[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return elements.sparkSession.sparkContext.broadcast(out)


def _elements_in(classes: DataFrame, wanted) -> DataFrame:
    """A row (e, class, n, label) for each element of the prefixes that the broadcast map has, and for few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            lists = batch.column("prefix")
            e = lists.flatten().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(_in_map(e.view(np.uint64), bits))
            row = pa.array(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[kept])
            yield pa.RecordBatch.from_arrays([pa.array(e[kept]), *(batch.column(c).take(row) for c in ("class", "n", "label"))], names=["e", "class", "n", "label"])

    return classes.select("class", "n", "label", "prefix").mapInArrow(run, "e long, class long, n int, label long")


def _sketches(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """id, set size, a digest of the set, its bitmap and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value if frequent is not None else None
        for batch in batches:
            ns, digests, maps, prefixes = [], [], [], []
            for s in shingle_sets(batch.column("body"), width):
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                maps.append(bitmap(s, bits_for(len(s))))
                prefixes.append(prefix_of(s, percent, last))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ns, pa.int32()), pa.array(digests, pa.string()), pa.array(maps, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "n", "digest", "bits", "prefix"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n int, digest string, bits binary, prefix array<long>")


def _sets(texts: DataFrame, chosen: DataFrame, extra: tuple[str, ...], width: int) -> DataFrame:
    """digest, ``extra`` and set for the rows of ``chosen`` (id, digest, extra), each from a text with that id and digest.

    Ids are unique only by intention, so a text is taken by the digest of its set; rows of a class are alike.
    """
    rows = chosen.withColumnRenamed("id", "_id")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    found = texts.join(rows, texts["id"].eqNullSafe(rows["_id"])).select("body", "digest", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("body"), width)]
            kept = [k for k, (s, d) in enumerate(zip(sets, batch.column("digest").to_pylist(), strict=True)) if xxhash.xxh3_128_hexdigest(s) == d]
            arrays = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("digest", *extra)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([sets[k] for k in kept], pa.binary())], names=["digest", *extra, "set"])

    return found.mapInArrow(run, f"digest string, {''.join(f'{c} {chosen.schema[c].dataType.simpleString()}, ' for c in extra)}set binary")


def _with_units(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """``rows`` (with ``key``, ``class``, ``n`` and ``label``) given to units of work, of which each pair that may reach the threshold has one.

    A key's rows fall into size bands so wide that such pairs lie in one band or
    in neighbours. Each band with the one above it is a unit, unless it has but
    one label or no row of its own band. Of a unit with more than :data:`TILE`
    rows, both bands are cut into parts by a hash of the class, and each pair of
    parts that is to be compared is a unit. Adds ``unit`` and ``side``: rows of
    different sides are compared, and rows of side -1 with all.
    """
    step = -math.log(percent / 100 * 0.999)
    band = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    kinds = "array(named_struct('band', {0}, 'upper', 0), named_struct('band', {0} - 1, 'upper', 1))"
    out = rows.withColumn("_band", band).withColumn("_w", F.explode(F.expr(kinds.format("_band")))).select("*", "_w.upper", F.xxhash64(key, "_w.band").alias("_unit")).drop("_w", "_band")
    lower = F.count_if(F.col("upper") == 0)
    sizes = out.groupBy("_unit").agg(lower.alias("_k0"), (F.count("*") - lower).alias("_k1"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    sizes = sizes.filter("_k0 > 0 AND _lo <> _hi").select("_unit", *[F.when(F.col("_k0") + F.col("_k1") > TILE, F.ceil(F.col(k) / TILE)).otherwise(0).cast("int").alias(p) for k, p in (("_k0", "_p0"), ("_k1", "_p1"))])
    out = out.join(sizes, "_unit")
    own0, own1 = "cast(pmod(xxhash64(class, 7), _p0) AS int)", "cast(pmod(xxhash64(class, 7), _p1) AS int)"
    small = "array(named_struct('unit', _unit, 'side', CASE WHEN upper = 0 THEN -1 ELSE 1 END))"
    within = f"transform(sequence(0, _p0 - 1), o -> named_struct('unit', xxhash64(_unit, 0, least({own0}, o), greatest({own0}, o)), 'side', CASE WHEN o = {own0} THEN -1 WHEN {own0} < o THEN 0 ELSE 1 END))"
    across = f"CASE WHEN _p1 = 0 THEN array() ELSE transform(sequence(0, _p1 - 1), o -> named_struct('unit', xxhash64(_unit, 1, {own0}, o), 'side', 0)) END"
    above = f"transform(sequence(0, _p0 - 1), o -> named_struct('unit', xxhash64(_unit, 1, o, {own1}), 'side', 1))"
    dealt = F.expr(f"CASE WHEN _p0 = 0 THEN {small} WHEN upper = 0 THEN concat({within}, {across}) ELSE {above} END")
    return out.withColumn("_u", F.explode(dealt)).select("*", "_u.unit", "_u.side").drop("_u", "_unit", "upper", "_p0", "_p1")


class _Forest:
    """Labels of a unit's rows; merging writes an edge between two of their classes."""

    def __init__(self, classes: list, labels: np.ndarray):
        self.classes, self.edges = classes, []
        self.label = np.unique(labels, return_inverse=True)[1]

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if self.label[j] != self.label[i]:
                self.edges.append((self.classes[i], self.classes[j]))
                self.label[self.label == self.label[j]] = self.label[i]


def _candidates(i: int, n: np.ndarray, bits: np.ndarray, side: np.ndarray, forest: _Forest, percent: int) -> np.ndarray:
    """Later rows that may reach the threshold with row i, by size and by the bitmaps' bound, and aren't connected with it yet; rows are sorted by size."""
    upto = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
    open_ = forest.label[i + 1 : upto] != forest.label[i]
    if side[i] >= 0:
        open_ &= side[i + 1 : upto] != side[i]
    at = np.flatnonzero(open_) + i + 1
    if not len(at):
        return at
    some = bits[at]
    lack_i = np.bitwise_count(bits[i] & ~some).sum(axis=1, dtype=np.int64)
    lack_j = np.bitwise_count(some & ~bits[i]).sum(axis=1, dtype=np.int64)
    bound = np.minimum(n[i] - lack_i, n[at] - lack_j)
    return at[100 * bound >= percent * (n[i] + n[at] - bound)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit after the other, from batches sorted by unit; a unit is bounded by two tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        units = batch.column("unit").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if held and held[-1].column("unit")[0].as_py() != units[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _bitmap_links(rows: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the pairs of a unit that the bitmaps don't rule out; rows: unit, side, class, n, bits, label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in _units(batches):
            if t.num_rows < 2:
                continue
            n = t.column("n").to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            n, side = n[order], t.column("side").to_numpy()[order]
            raw = t.column("bits").combine_chunks().to_pylist()
            bits = folded([raw[k] for k in order])
            classes = t.column("class").to_pylist()
            forest = _Forest([classes[k] for k in order], t.column("label").to_numpy()[order])
            if forest.label.max() > 0:
                for i in range(len(n) - 1):
                    forest.link(i, _candidates(i, n, bits, side, forest, percent))
            out += forest.edges
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return rows.mapInArrow(run, EDGES)


def _exact_links(rows: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the pairs of a unit that reach the threshold; rows: unit, side, class, n, set (sorted hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            if t.num_rows < 2:
                continue
            n = t.column("n").to_numpy().astype(np.int64)
            order = np.argsort(n, kind="stable")
            raw, classes = t.column("set").to_pylist(), t.column("class").to_pylist()
            sets = [np.frombuffer(raw[k], dtype=np.uint64) for k in order]
            n, side = n[order], t.column("side").to_numpy()[order]
            width = min(4 * bits_for(int(n[-1])), MOST_BITS)
            bits = folded([bitmap(s, width) for s in sets])
            forest = _Forest([classes[k] for k in order], np.arange(len(n)))
            for i in range(len(n) - 1):
                at = _candidates(i, n, bits, side, forest, percent)
                while len(at):
                    some, at = at[:64], at[64:]
                    both = _overlaps(sets[i], [sets[j] for j in some])
                    forest.link(i, some[100 * both >= percent * (n[i] + n[some] - both)])
                    at = at[forest.label[at] != forest.label[i]]
            if forest.edges:
                yield _edges(forest.edges)

    return rows.mapInArrow(run, EDGES)


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted array with others."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    starts = np.cumsum([0, *[len(x) for x in others[:-1]]])
    return np.add.reduceat((one[at] == every).astype(np.int64), starts)


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "unit").sortWithinPartitions("unit")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of the edges a-b.

    Alternates large-star and small-star steps until the edges are stars; each
    step groups, so a hub's edges are summed up before the shuffle, and is
    written out.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.expr("array(named_struct('a', b, 'b', m), named_struct('a', a, 'b', m))")).alias("e")).select("e.*")
        now = stored(small.filter("a <> b").distinct(), "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = tuple(state)


@tidied
def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest id reachable over links of at least ``percent`` % Jaccard likeness.

    One row for each row of ``docs``. Classes are known by the 128-bit digest of their set, and numbered where they are written.
    """
    small_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("body"))
    sketches = stored(_sketches(texts, width, percent, _frequent(texts, width, percent)), "ng-sketches")

    # The sketches of a class are alike, whichever row they come from.
    classes = sketches.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    classes = _numbered(stored(classes.withColumn("_row", F.monotonically_increasing_id()), "ng-classes"))
    maps = classes.select("class", "bits")

    # First the head of the prefix alone, as good as that many minimum hashes: most classes that belong together meet there.
    firsts = classes.select(F.explode(F.slice("prefix", 1, EARLY)).alias("e"), "class", "n", F.col("class").alias("label"))
    early = components(_bitmap_links(_dealt(_with_units(firsts.join(_of_two_labels(firsts), "e", "left_semi"), "e", percent).join(maps, "class")), percent))
    labelled = classes.select("class", "n", "prefix").join(early.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("root", "class"))
    labelled = stored(labelled.select("class", "n", "prefix", "label"), "ng-labelled")
    # Few elements have classes of two labels; a map of them spares the others the way to their groups.
    mixed = stored(_of_two_labels(labelled.select(F.explode("prefix").alias("e"), "label")), "ng-mixed")
    wanted = stored(_with_units(_elements_in(labelled, _element_map(mixed)), "e", percent), "ng-wanted").join(maps, "class")
    late = _bitmap_links(_dealt(wanted), percent)
    clusters = components(early.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late))
    clusters = clusters.groupBy("node").agg(F.min("root").alias("root"))

    # Sorted arrays are made anew, for one row of each class in a cluster.
    chosen = clusters.join(classes.select(F.col("class").alias("node"), "digest", "n", F.col("least").alias("id")), "node")
    chosen = stored(chosen.select("id", "digest", F.col("node").alias("class"), F.col("root").alias("cluster"), "n"), "ng-chosen")
    sets = _sets(texts, chosen.select("id", "digest", "class"), ("class",), width).groupBy("class").agg(F.first("set").alias("set"))
    units = stored(_with_units(chosen.select("class", "cluster", "n", F.col("class").alias("label")), "cluster", percent), "ng-units")
    links = _exact_links(_dealt(units.join(sets, "class")), percent)
    roots = components(links).withColumnRenamed("node", "class")
    named = classes.select("class", "digest", "least").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("digest", "component")
    out = sketches.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Written ``rows`` with ``class``, whole numbers from 0 on, in place of the wide numbers ``_row``."""
    part = F.shiftright("_row", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_k"))  # a row for each file that was written
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(sizes.select("_part", before.alias("_before")), "ng-offsets")
    out = rows.join(F.broadcast(offsets), part == F.col("_part"))
    return out.withColumn("class", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row", "_part", "_before")


def _of_two_labels(rows: DataFrame) -> DataFrame:
    """The elements that have two labels or more."""
    return rows.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("e")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; of rows alike in id and text one."""
    found = similarity_classes(docs, doc_id, text, width, percent).filter(F.col(doc_id).eqNullSafe(F.col("component_id")))
    kept = stored(found.groupBy(F.col(doc_id).alias("_id")).agg(F.count("*").alias("_times")), "ng-kept")
    out = docs.join(broadcast_if_small(kept), F.col(f"`{doc_id}`").eqNullSafe(F.col("_id"))).drop("_id")
    if not kept.filter("_times > 1").limit(1).count():
        return out.drop("_times")
    again = out.filter("_times > 1").withColumn("_text", F.xxhash64(text)).dropDuplicates([doc_id, "_text"]).drop("_text")
    return out.filter("_times = 1").unionByName(again).drop("_times")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=3, percent=90)


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT rid, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE 100 * k >= 90 * (u.n + v.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(doc_id) AS component FROM r JOIN d ON d.rid = r.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN m ON m.a = d.rid
"""

QUERIES = {"op6_ngram_join": op6_ngram_join}
ORACLES = {"op6_ngram_join": OP6_SQL}
