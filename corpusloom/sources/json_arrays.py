"""JSON files of any length, read by many tasks: an array's elements are found without a task for a whole file.

Files are read as text that is cut behind every closing brace, so a split of a
file is a run of pieces. What a piece means depends on what stands before its
split: whether it begins within a string, and how deep. So each split is scanned
once for either beginning and tells how it would end and how the depth changes;
these are composed in the order of a file's splits, which gives each split its
beginning. A second pass then cuts elements where the depth returns to the
array's. What runs over the end of a split is put together by the split in which
it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.shared import written

#: Splits whose beginnings may be broadcast, some 100 bytes each.
BROADCAST_SPLITS = 200_000
# The rest of a string, and what matters outside of strings.
_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_MARKS = re.compile(r'["{}\[\]]')
STEP = {"{": 1, "[": 1, "}": -1, "]": -1}


def scanned(text: str, inside: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Whether ``text``, which begins ``inside`` a string or not, ends in one; and (place, change) of the brackets outside of strings.

    A text doesn't end behind a backslash, as none stands before a brace outside of one.
    """
    out, at = [], 0
    while True:
        if inside:
            m = _STRING.match(text, at)
            if m is None:
                return True, out
            at = m.end()
        inside = False
        m = _MARKS.search(text, at)
        if m is None:
            return False, out
        at = m.end()
        if m.group() == '"':
            inside = True
        else:
            out.append((m.start(), STEP[m.group()]))


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("lineSep", "}").text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    """(path, begin, ...) and text of each piece, in the order of the file."""
    for batch in batches:
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != "value"]
        yield from zip(zip(*others, strict=True), batch.column("value").to_pylist(), strict=True)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split ends for either beginning: in a string or not, the change of depth; and its first character."""
    held: dict[tuple, list] = {}
    for (path, begin, *_), text in _runs(batches):
        state = held.setdefault((path, begin), [False, True, 0, 0, ""])
        state[4] = state[4] or text.lstrip()[:1]
        for k in (0, 1):
            state[k], marks = scanned(text + "}", state[k])
            state[2 + k] += sum(step for _, step in marks)
    rows = [(*key, *state) for key, state in held.items()]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "begin", "end0", "end1", "depth0", "depth1", "head"]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and begin of each split, whether it begins within a string (inside), how deep (depth), and the depth of elements (base)."""
    told = _pieces(spark, paths).select("path", "begin", "value").mapInArrow(_told, "path string, begin long, end0 boolean, end1 boolean, depth0 long, depth1 long, head string")
    split = "struct<begin:bigint,inside:boolean,depth:bigint>"
    step = (
        "(a, x) -> named_struct('inside', CASE WHEN a.inside THEN x.end1 ELSE x.end0 END, 'depth', a.depth + CASE WHEN a.inside THEN x.depth1 ELSE x.depth0 END, "
        "'out', concat(a.out, array(named_struct('begin', x.begin, 'inside', a.inside, 'depth', a.depth))))"
    )
    # A file has a split for each 128 MB or so.
    files = told.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("begin", "end0", "end1", "depth0", "depth1"))).alias("xs"), F.min_by("head", F.when(F.col("head") != "", F.col("begin"))).alias("head"))
    files = files.select("path", F.when(F.col("head") == "[", 1).otherwise(0).cast("long").alias("base"), F.explode(F.expr(f"aggregate(xs, named_struct('inside', false, 'depth', 0L, 'out', cast(array() AS array<{split}>)), {step}, a -> a.out)")).alias("e"))
    return files.select("path", "base", "e.begin", "e.inside", "e.depth")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each split that end with an element: kind 'whole', or 'head' for the first, which an earlier split has begun; and what is left ('tail')."""
    now, rows, size = None, [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "begin", "kind", "text"])

    parts: list[str] = []
    for (path, begin, inside, depth, base), text in _runs(batches):
        if now is None or (now[0], now[1]) != (path, begin):
            if now:
                rows.append((now[0], now[1], "tail" if now[2] else "middle", "".join(parts)))
            now, parts, string, deep = [path, begin, False], [], inside, depth
        string, marks = scanned(text + "}", string)
        parts.append(text + "}")
        for _, step in marks:
            deep += step
        if marks and marks[-1][1] < 0 and deep == base and not string and marks[-1][0] == len(text):
            rows.append((path, begin, "whole" if now[2] else "head", "".join(parts)))
            now[2], parts = True, []
            size += len(rows[-1][3])
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
    if now:
        rows.append((now[0], now[1], "tail" if now[2] else "middle", "".join(parts)))
    if rows:
        yield batch_of(rows)


def elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value (JSON text) and path of the elements of all .json files: an array's, or a file's one object. What isn't JSON is left out."""
    entry = written(entries(spark, paths), "json-entries")
    pieces = _pieces(spark, paths).select("path", "begin", "value")
    if entry.count() <= BROADCAST_SPLITS:
        pieces = pieces.join(F.broadcast(entry), ["path", "begin"])
    else:  # a shuffle takes the pieces out of their order
        pieces = pieces.withColumn("at", F.monotonically_increasing_id()).join(entry, ["path", "begin"]).repartition("path", "begin").sortWithinPartitions("path", "begin", "at")
    cut = pieces.select("path", "begin", "inside", "depth", "base", "value").mapInArrow(_cut, "path string, begin long, kind string, text string")
    loose = written(cut.filter("kind <> 'whole'"), "json-loose")
    # A head, or a split in which no element ends, goes on with what the last split before it in which one does has left over.
    marks = loose.groupBy("path", "begin").agg(F.max(F.col("kind") == "head").alias("ended"))
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("owner", F.coalesce(F.max(F.when(F.col("ended"), F.col("begin"))).over(before), F.lit(-1).cast("long")))
    joined = loose.join(marks.drop("ended"), ["path", "begin"]).withColumn("owner", F.when(F.col("kind") == "tail", F.col("begin")).otherwise(F.col("owner")))
    order = F.struct("begin", "text")
    joined = joined.groupBy("path", "owner").agg(F.max(F.col("kind") == "head").alias("ended"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), "").alias("text"))
    # Where a file ends, there is no element's end, but the array's and the brace that every piece was given.
    last = F.regexp_replace("text", r"\]?\s*\}$", "")
    segments = cut.filter("kind = 'whole'").select("path", "text").unionByName(joined.select("path", F.when(F.col("ended"), F.col("text")).otherwise(last).alias("text")))
    # Elements that are no objects come with the next object, or the end: a segment is read as an array of its own.
    inner = F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]?", "")
    rows = segments.select("path", F.explode(F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>")).alias("value"))
    return rows.filter("value IS NOT NULL").select("value", "path")
