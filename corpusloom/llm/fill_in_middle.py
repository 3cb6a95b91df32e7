"""Fill-in-the-middle: texts cut into prefix, middle and suffix at the borders of lines, by a parallel scan of automata.

Two automata read each text (:mod:`corpusloom.llm.automata`): one counts lines,
one looks for the markers. Their chunks' transition functions are composed; the
counts tell in which chunk a cut lies. Texts up to :data:`GIANT` bytes are
scanned where they are, a batch at a time. Longer ones are dealt out as blocks
over all tasks: each block gives its function, the functions of a text are
composed, which gives each block its entry state and the number of lines before
it, and only the blocks that hold a cut are run again. Texts never leave their
rows otherwise; outputs are put together by built-in functions.

A text is left plain if it is empty, has one of the markers, or isn't chosen.

Defined results: a null text counts as empty; a null id is drawn from like an
empty one; repeated rows get equal results, one each; an empty table gives none;
extra columns ride along, and those that are named like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import automata
from corpusloom.llm.common import broadcast_if_small, small_arrow_batches, stored, table, tidied

# The contract's markers of prefix, suffix and middle, and its seed.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Bytes of a text that is dealt out in blocks, and of a block.
GIANT, BLOCK = 1 << 16, 1 << 15
#: Blocks in a group of the composition; a text of 2 GB has 65,536 blocks.
GROUP = 256
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")
CUTS = "n long, marked boolean, cut1 long, cut2 long"


def _bytes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binaries, and where each ends."""
    bodies = bodies.cast(pa.large_binary())
    offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    data = bodies.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _chosen(n: np.ndarray, draw1: np.ndarray, draw2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = draw1 % (n + 1), draw2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _scanned(bodies: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
    """Lines, whether there is a marker, and the two cuts in bytes, of whole texts."""
    data, ends = _bytes(bodies)
    line, marker = automata.lines(), automata.finder(MARKERS)
    lines, marks = automata.scan(line, data, ends), automata.scan(marker, data, ends)
    n, marked = lines.counts[lines.firsts[1:] - 1, 0], marks.exits[marks.firsts[1:] - 1, 0] == marker.states - 1
    cuts = _chosen(n, *(np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (draw1, draw2)))
    sizes, which, zeros = np.diff(ends, prepend=0), np.arange(len(ends)), np.zeros(len(ends), np.int64)
    at = [automata.places(line, lines, which, c, zeros, zeros) for c in cuts]
    cut1, cut2 = (np.where(x < 0, sizes, x) for x in at)  # behind the last line
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(marked), pa.array(cut1), pa.array(cut2)], names=["n", "marked", "cut1", "cut2"])


def _by_bytes(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a column."""
    _, ends = _bytes(batch.column(name))
    k = 0
    while k < len(ends):
        base = ends[k - 1] if k else 0
        upto = max(k + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(k, upto - k)
        k = upto


def _near_cuts(body: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([body, draw1, draw2], names=["body", "draw1", "draw2"])
    parts = [_scanned(*b.columns) for b in _by_bytes(batch, "body", 4 << 20)]
    return pa.concat_arrays(parts) if parts else _scanned(body, draw1, draw2)


def _giant_cuts(giants: DataFrame) -> DataFrame:
    """(_row, n, marked, cut1, cut2) of ``giants`` (_row, _body, _d1, _d2), whose blocks are dealt out over all tasks."""
    spark = giants.sparkSession
    line, marker = automata.lines(), automata.finder(MARKERS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in zip(batch.column("_row").to_pylist(), batch.column("_body"), strict=True):
                whole = body.as_py()
                for first in range(0, len(whole), 64 * BLOCK):
                    parts = [whole[k : k + BLOCK] for k in range(first, min(len(whole), first + 64 * BLOCK), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(first // BLOCK, first // BLOCK + len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["_row", "block", "part"])

    blocks = stored(giants.select("_row", "_body").mapInArrow(cut, "_row long, block long, part binary").repartition("_row", "block"), "fim-blocks", "zstd")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_bytes(batch, "part", 4 << 20):
                data, ends = _bytes(some.column("part"))
                lines, marks = automata.scan(line, data, ends), automata.scan(marker, data, ends)
                last = lines.firsts[1:] - 1
                yield pa.RecordBatch.from_arrays([some.column("_row"), some.column("block"), *(pa.array(list(x), pa.list_(pa.int64())) for x in (lines.exits[last], lines.counts[last], marks.exits[last]))], names=["_row", "block", "exits", "counts", "marks"])

    each = stored(blocks.mapInArrow(functions, "_row long, block long, exits array<long>, counts array<long>, marks array<long>"), "fim-functions")
    each = each.withColumn("part_of", F.expr(f"block div {GROUP}"))

    # Neighbours are composed in groups, then the groups of a text: both are associative.
    def composed(df: DataFrame, by: list[str], order: str) -> DataFrame:
        start = f"named_struct('exits', transform(sequence(0, {line.states - 1}), i -> cast(i AS bigint)), 'counts', transform(sequence(0, {line.states - 1}), i -> 0L), 'marks', transform(sequence(0, {marker.states - 1}), i -> cast(i AS bigint)))"
        step = "named_struct('exits', transform(a.exits, s -> get(x.exits, cast(s AS int))), 'counts', transform(a.counts, (c, i) -> c + get(x.counts, cast(get(a.exits, i) AS int))), 'marks', transform(a.marks, s -> get(x.marks, cast(s AS int))))"
        rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "exits", "counts", "marks"))).alias("xs"))
        return rows.select(*by, F.expr(f"aggregate(xs, {start}, (a, x) -> {step})").alias("f")).select(*by, "f.*")

    groups = stored(composed(each, ["_row", "part_of"], "block"), "fim-groups")
    wholes = composed(groups, ["_row"], "part_of").select("_row", F.expr("counts[0]").alias("n"), (F.expr("marks[0]") == marker.states - 1).alias("marked"))
    wholes = stored(wholes.join(giants.select("_row", "_d1", "_d2"), "_row").select("_row", "n", "marked", F.expr("least(_d1 % (n + 1), _d2 % (n + 1))").alias("unit1"), F.expr("greatest(_d1 % (n + 1), _d2 % (n + 1))").alias("unit2")), "fim-wholes")

    # Entry state and lines before: first of each group of blocks, then of the blocks in the groups.
    def entered(df: DataFrame, by: list[str], order: str, state: str, before: str) -> DataFrame:
        rows = df.groupBy(*by, state, before).agg(F.array_sort(F.collect_list(F.struct(order, "exits", "counts"))).alias("xs"))
        step = "named_struct('s', get(x.exits, cast(a.s AS int)), 'n', a.n + get(x.counts, cast(a.s AS int)), 'out', concat(a.out, array(named_struct('at', x." + order + ", 's', a.s, 'n', a.n, 'upto', a.n + get(x.counts, cast(a.s AS int))))))"
        start = f"named_struct('s', {state}, 'n', {before}, 'out', cast(array() AS array<struct<at:bigint,s:bigint,n:bigint,upto:bigint>>))"
        return rows.select(*by, F.explode(F.expr(f"aggregate(xs, {start}, (a, x) -> {step}, a -> a.out)")).alias("e")).select(*by, F.col("e.at").alias(order), F.col("e.s").alias("state"), F.col("e.n").alias("before"), "e.upto")

    zero = F.lit(0).cast("long")
    by_group = entered(groups.withColumns({"s0": zero, "n0": zero}), ["_row"], "part_of", "s0", "n0").select("_row", "part_of", F.col("state").alias("s0"), F.col("before").alias("n0"))
    by_block = entered(each.join(by_group, ["_row", "part_of"]), ["_row", "part_of"], "block", "s0", "n0")
    units = wholes.select("_row", F.explode(F.array(F.struct(F.lit(1).alias("cut"), F.col("unit1").alias("unit")), F.struct(F.lit(2).alias("cut"), F.col("unit2").alias("unit")))).alias("u")).select("_row", "u.*")
    held = by_block.join(units, "_row").filter("before <= unit AND unit < upto").select("_row", "block", "cut", "unit", "state", "before")

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_bytes(batch, "part", 4 << 20):
                data, ends = _bytes(some.column("part"))
                unit, state, before = (some.column(c).to_numpy() for c in ("unit", "state", "before"))
                at = automata.places(line, automata.scan(line, data, ends), np.arange(len(ends)), unit, state, before)
                yield pa.RecordBatch.from_arrays([some.column("_row"), some.column("cut"), pa.array(some.column("block").to_numpy() * BLOCK + at)], names=["_row", "cut", "at"])

    at = blocks.join(broadcast_if_small(held := stored(held, "fim-held")), ["_row", "block"]).select("_row", "block", "cut", "part", "unit", "state", "before").mapInArrow(located, "_row long, cut int, at long")
    both = at.groupBy("_row").agg(F.max(F.when(F.col("cut") == 1, F.col("at"))).alias("cut1"), F.max(F.when(F.col("cut") == 2, F.col("at"))).alias("cut2"))
    size = giants.select("_row", F.octet_length("_body").cast("long").alias("size"))
    return wholes.join(size, "_row").join(both, "_row", "left").select("_row", "n", "marked", F.coalesce("cut1", "size").alias("cut1"), F.coalesce("cut2", "size").alias("cut2"))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars and output.

    ``percent`` of the texts are transformed, ``spm_percent`` of these with the suffix first; both, and the cuts, are drawn from a digest of seed and id.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    kept = {c: f"_k{k}" for k, c in enumerate(docs.columns) if c.lower() not in OUTPUTS}
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_body"), digest.alias("_h"))
    rows = rows.select(*kept.values(), "_body", *[F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"_d{k + 1}") for k in range(4)])
    columns = [*kept.values(), "_body", "_d3", "_d4"]

    def cuts(body: pa.Array, draw1: pa.Array, draw2: pa.Array) -> pa.Array:
        return _near_cuts(body, draw1, draw2)

    # Not deterministic for the optimiser, so that no expression above it runs it anew.
    near_cuts = F.arrow_udf(cuts, CUTS).asNondeterministic()
    near = rows.filter(F.octet_length("_body") <= GIANT).withColumn("_c", near_cuts("_body", "_d1", "_d2")).select(*columns, "_c.*")
    giants = stored(rows.filter(F.octet_length("_body") > GIANT).withColumn("_row", F.monotonically_increasing_id()), "fim-giants", "zstd")
    out = near
    if not giants.isEmpty():
        out = near.unionByName(giants.join(broadcast_if_small(stored(_giant_cuts(giants), "fim-cuts")), "_row").select(*columns, "n", "marked", "cut1", "cut2"))
    piece = lambda begin, size: F.substring("_body", begin, size).cast("string")
    longest = F.lit(2**31 - 1)
    out = out.select(
        *kept.values(), "n", piece(F.lit(1), F.col("cut1").cast("int")).alias("_p"), piece((F.col("cut1") + 1).cast("int"), (F.col("cut2") - F.col("cut1")).cast("int")).alias("_m"), piece((F.col("cut2") + 1).cast("int"), longest).alias("_s"), F.col("_body").cast("string").alias("_t"),
        F.when((F.octet_length("_body") == 0) | F.col("marked") | (F.col("_d3") % 100 >= percent), "plain").when(F.col("_d4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    p, s, m = (F.lit(x) for x in MARKERS)
    plain = F.col("form") == "plain"
    return out.select(
        *[F.col(n).alias(c) for c, n in kept.items()], "n", "form", F.when(~plain, F.length("_p")).cast("long").alias("prefix_chars"), F.when(~plain, F.length("_m")).cast("long").alias("middle_chars"),
        F.when(plain, F.col("_t")).when(F.col("form") == "psm", F.concat(p, "_p", s, "_s", m, "_m")).otherwise(F.concat(s, "_s", p, "_p", m, "_m")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form. No marker stands in a text that was cut, nor can one arise where parts meet, as each begins with its only ``<``."""
    parts = {x: F.locate(x, output) for x in MARKERS}
    p, s, m = MARKERS
    between = lambda a, b: F.substring(output, parts[a] + len(a), parts[b] - parts[a] - len(a))
    middle = F.substring(output, parts[m] + len(m), F.lit(2**31 - 1))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


@tidied
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT *, len(l)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (
  SELECT *, array_to_string(list_slice(l, 1, least(a, b)), '') AS p, array_to_string(list_slice(l, least(a, b) + 1, greatest(a, b)), '') AS m, array_to_string(list_slice(l, greatest(a, b) + 1, n), '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""

QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op13_fill_in_middle": OP13_SQL}
