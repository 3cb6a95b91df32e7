"""A Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups.

Leaves of a group stand in the order of their key; each run of :data:`FANOUT`
neighbours becomes the digest of their digests. Positions come from one range
shuffle of leaves (digests, no texts), counted by group and range. The leaves of a
group are dealt out in aligned blocks of a power of the fanout, so
that a block's levels need nothing from outside: its digests are one contiguous
matrix of 64-byte rows, which is reshaped by the fanout and hashed row by row
from level to level, and a sibling's place follows from a leaf's number alone.
The blocks' digests are the leaves of the next, 729 times smaller tree, and so on.
A second visit to each block adds the way from there to the root to its leaves'
own. No task holds more than a block and the way above it.

Defined results: null values are part of a leaf as ``-``; groups and keys may be
null and come first; repeated rows are leaves of their own, side by side; an empty
table has no leaves and no root; columns are only hashed and carried, whatever their
names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, stored, table, tidied

FANOUT = 3
#: Levels of a block's tree, which has FANOUT**LEVELS leaves.
LEVELS = 6
WAY = "array<struct<left:string,right:string>>"


def hashed(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def part(value: Column) -> Column:
    """A value's part of a leaf: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def depth(n: int) -> int:
    """Levels above n leaves: none above a lone one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def matrices(leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """The digests of each level as a matrix of 64-byte rows, from the leaves up."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        full = len(below) // FANOUT
        runs = [r.tobytes() for r in below[: full * FANOUT].reshape(full, FANOUT * 64)]
        if len(below) > full * FANOUT:
            runs.append(below[full * FANOUT :].tobytes())
        digests = b"".join(hashlib.sha256(r).hexdigest().encode() for r in runs)
        out.append(np.frombuffer(digests, np.uint8).reshape(-1, 64))
    return out


def siblings(level: np.ndarray, nodes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each of ``nodes``, numbers in ``level``: the digests in its run to its left and to its right, run together."""
    begin = nodes // FANOUT * FANOUT
    slots = begin[:, None] + np.arange(FANOUT)
    return _joined(level, slots, slots < nodes[:, None]), _joined(level, slots, (slots > nodes[:, None]) & (slots < len(level)))


def _joined(level: np.ndarray, slots: np.ndarray, which: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(which.sum(axis=1) * 64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(slots), pa.py_buffer(ends), pa.py_buffer(level[slots[which]].tobytes()))


def _block(digests: pa.ChunkedArray, n: int, levels: int) -> list[np.ndarray]:
    """Levels of a block whose group has ``n`` nodes."""
    rows = np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)
    return matrices(rows, min(levels, depth(n)))


def _sorted(nodes: pa.Table) -> pa.Table:
    return nodes.sort_by("pos")


def _of_blocks(df: DataFrame, levels: int):
    return df.withColumn("block", F.expr(f"pos div {FANOUT**levels}")).groupBy("key", "block")


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, pos, n, digest) of the blocks of nodes (key, pos, n, digest)."""

    def top(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows.column("n")[0].as_py()
        digest = _block(_sorted(rows).column("digest"), n, levels)[-1][0].tobytes().decode()
        return pa.table({"key": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // FANOUT**levels)], "digest": [digest]})

    return stored(_of_blocks(nodes.select("key", "pos", "n", "digest"), levels).applyInArrow(top, "key string, pos long, n long, digest string"), "merkle-blocks")


def _ways(nodes: DataFrame, most: int, levels: int, above: DataFrame | None = None) -> DataFrame:
    """nodes with way, the siblings on their way up, and root, each group's top digest.

    ``most``: nodes of the largest group. ``above``: (key, way, root) to go on with at each group's top.
    """
    if most <= 1:
        out = nodes.withColumns({"way": F.array().cast(WAY), "root": F.col("digest"), "subroot": F.col("digest")})
        if above is None:
            return out
        tops = above.select("key", F.col("way").alias("_way"), F.col("root").alias("_root"))
        return out.join(broadcast_if_small(tops, most=10_000), "key").withColumns({"way": F.concat("way", "_way"), "root": F.col("_root")}).drop("_way", "_root")
    blocks = _climbed(nodes, levels)
    upper = _ways(blocks, -(-most // FANOUT**levels), levels, above).select("key", F.col("pos").alias("block"), "way", "root", "subroot")
    kept = nodes.columns

    def down(rows: pa.Table, tops: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out_type.empty_table()
        rows = _sorted(rows)
        n = rows.column("n")[0].as_py()
        matrices = _block(rows.column("digest"), n, levels)[:-1]
        leaves = np.arange(rows.num_rows)
        pairs = [siblings(level, leaves // FANOUT**k) for k, level in enumerate(matrices)]
        rest = tops.column("way").combine_chunks().flatten()
        size = len(pairs) + len(rest)
        # One struct for each leaf and level: the leaf's own levels, then those of its block.
        order = np.concatenate([(np.arange(len(pairs)) * len(leaves))[None, :] + leaves[:, None], np.broadcast_to(len(pairs) * len(leaves) + np.arange(len(rest)), (len(leaves), len(rest)))], axis=1).ravel()
        left, right = (pa.concat_arrays([*(p[side] for p in pairs), rest.field(side)]).take(pa.array(order)) for side in (0, 1))
        way = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * size), pa.StructArray.from_arrays([left, right], names=["left", "right"]))
        out = rows.select(kept).append_column("way", way)
        for c in ("root", "subroot"):
            out = out.append_column(c, pa.array([tops.column(c)[0].as_py()] * len(leaves), pa.string()))
        return out

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = nodes.withColumns({"way": F.array().cast(WAY), "root": F.lit(""), "subroot": F.lit("")}).schema
    out_type = to_arrow_schema(schema)
    return _of_blocks(nodes, levels).cogroup(upper.groupBy("key", "block")).applyInArrow(down, schema)


def _positioned(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """rows (key, digest, ...) with pos, the place in their key's ``order``, and n, the number of its rows; and the largest n."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions("key", *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-ordered")
    dealt = dealt.withColumn("range", F.expr("shiftright(at, 33)"))
    counts = dealt.groupBy("key", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(Window.partitionBy("key"))}), "merkle-ranges")
    most = counts.agg(F.max("n")).first()[0] or 0
    out = dealt.join(broadcast_if_small(counts), ["key", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    return out.select(*rows.columns, "pos", "n"), most


def merkle_manifest(rows: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``group`` and ``order`` of each row with leaf, subroot, root and way.

    way has for each level, from the leaf's up to the root's, the digests to the
    left and to the right in its run; :func:`folded` recomputes the root from it.
    ``carry``: further columns of the result, told by expressions over rows; ``levels``: of a block's tree.
    """
    carry = carry or {}
    # A null group comes first, and differs from the group named by its letter.
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = stored(rows.select(key.alias("key"), leaf.alias("digest"), F.col(f"`{group}`").alias("_group"), F.col(f"`{order}`").alias("_order"), *[x.alias(f"_c{k}") for k, x in enumerate(carry.values())]), "merkle-leaves")
    leaves = leaves.withColumn("_id", F.monotonically_increasing_id())
    nodes, most = _positioned(leaves, [F.asc_nulls_first("_order"), F.col("digest"), F.col("_id")])
    nodes = stored(nodes.drop("_id"), "merkle-nodes")
    subroots = _tops(nodes, most, levels)
    groups, many = _positioned(subroots.select(F.lit("").alias("key"), "digest", F.col("key").alias("name")), [F.col("name")])
    tops = stored(_ways(groups, many, levels).select(F.col("name").alias("key"), "way", "root"), "merkle-tops")
    out = _ways(nodes, most, levels, tops)
    return out.select(F.col("_group").alias(group), F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "way", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)])


def _tops(nodes: DataFrame, most: int, levels: int) -> DataFrame:
    """(key, digest) of each group's tree."""
    while most > 1:
        nodes, most = _climbed(nodes, levels), -(-most // FANOUT**levels)
    return nodes.select("key", "digest")


def folded(leaf: Column, way: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(way, leaf, lambda a, x: hashed(x["left"], a, x["right"]))


def proof(way: Column) -> Column:
    """The siblings, level by level and left to right, run together."""
    return F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), "")


@tidied
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: hashed(*[part(x) for x in [*fields, text]])
    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = leaf(F.when(tampering, F.regexp_replace("text", "\n", "")).otherwise(F.col("text")))
    out = merkle_manifest(docs, leaf(F.col("text")), "source", "doc_id", {"found": tampered})
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("way")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("found"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_part(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


#: Trees climb a level a step; CRC-32 comes from its table of 256 entries, which is made by rule.
OP12_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda a, x: xor(t[1 + xor(a % 256, x)], a // 256)), 4294967295) % 2 = 0, false) AS tamper
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || source, '0') AS key, sha256(head || {_sql_part("text")}) AS leaf,
         sha256(head || {_sql_part("CASE WHEN tamper THEN replace(text, chr(10), '') ELSE text END")}) AS found
  FROM (SELECT *, {" || ".join(_sql_part(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM d)),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
g AS (
  SELECT 0 AS lvl, key, pos, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM l
  UNION ALL
  SELECT any_value(lvl) + 1, key, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM g WHERE n > 1 GROUP BY key, pos // 3),
gs AS MATERIALIZED (SELECT * FROM g),
subs AS MATERIALIZED (SELECT key, h AS subroot, lvl AS tall, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM gs WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subs
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY pos // 3),
us AS MATERIALIZED (SELECT * FROM u),
way AS MATERIALIZED (
  SELECT l.doc_id, l.key, l.pos, gs.lvl, gs.h, gs.pos AS at, gs.pos > l.pos // (3 ** gs.lvl)::BIGINT AS is_right
  FROM l JOIN gs ON gs.key = l.key AND gs.n > 1 AND gs.pos // 3 = l.pos // (3 ** (gs.lvl + 1))::BIGINT AND gs.pos <> l.pos // (3 ** gs.lvl)::BIGINT
  UNION ALL
  SELECT l.doc_id, l.key, l.pos, us.lvl + subs.tall, us.h, us.pos, us.pos > subs.pos // (3 ** us.lvl)::BIGINT
  FROM l JOIN subs USING (key) JOIN us ON us.n > 1 AND us.pos // 3 = subs.pos // (3 ** (us.lvl + 1))::BIGINT AND us.pos <> subs.pos // (3 ** us.lvl)::BIGINT),
sides AS MATERIALIZED (
  SELECT key, pos, list({{'a': coalesce(a, ''), 'b': coalesce(b, '')}} ORDER BY lvl) AS xs
  FROM (SELECT l.key, l.pos, x.lvl, string_agg(h, '' ORDER BY w.at) FILTER (NOT is_right) AS a, string_agg(h, '' ORDER BY w.at) FILTER (is_right) AS b
        FROM l JOIN subs USING (key), LATERAL (SELECT unnest(range(tall + (SELECT max(lvl) FROM us))) AS lvl) x
        LEFT JOIN way w ON w.key = l.key AND w.pos = l.pos AND w.lvl = x.lvl
        GROUP BY ALL)
  GROUP BY key, pos),
f AS (
  SELECT l.doc_id, l.leaf, l.found, l.key, coalesce(xs, []) AS xs FROM l LEFT JOIN sides USING (key, pos)),
r AS (SELECT h AS root FROM us WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(xs, lambda x: x.a || x.b)), lambda p, q: p || q)) AS proof_sha256,
       list_reduce(list_prepend({{'a': found, 'b': ''}}, xs), lambda p, q: {{'a': sha256(q.a || p.a || q.b), 'b': ''}}).a AS folded_root,
       list_reduce(list_prepend({{'a': found, 'b': ''}}, xs), lambda p, q: {{'a': sha256(q.a || p.a || q.b), 'b': ''}}).a = root AS verified
FROM f JOIN subs USING (key), r
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": OP12_SQL}
