"""Splits, samples, merges and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.seeded import place
from corpusloom.operators import sampling as S
from corpusloom.plans.common import long, rows, table

SEED = 42
TABLES = "documents benchmark labels pages conversations".split()


def _ids(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *more)


def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each source: as many as a sample of 100 allows each, one at least."""
    docs = _ids(spark, sf_dir, "source")
    share = docs.agg(F.greatest(F.lit(1), F.floor(F.lit(100) / F.count_distinct("source"))).alias("k"))
    ranked = S.first_per_group(docs, "source", F.col("doc_id"), 100)
    counted = ranked.join(F.broadcast(share))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= k").select("source", "doc_id")


def seeded_shuffle_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first int(n * 0.15) documents in seeded order."""
    return S.sample(_ids(spark, sf_dir), "doc_id", 0.15, SEED).select("doc_id")


def shuffle_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty in seeded order, with their place."""
    return _ids(spark, sf_dir).select("doc_id", place(SEED, F.col("doc_id")).alias("place")).orderBy("place", "doc_id").limit(20)


def permuted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in a seeded permutation, told from its number alone."""
    return S.with_place(_ids(spark, sf_dir), "doc_id", SEED).select("doc_id", "place")


def train_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first int(n * 0.29) documents by id, with the double arithmetic of the ratio."""
    docs = _ids(spark, sf_dir)
    edge = docs.agg(F.expr("cast(floor(count(*) * 0.29D) AS bigint)").alias("k"))
    # A prefix by id: how many ids lie below is counted by range, so no global rank is needed.
    step = docs.agg(F.min("doc_id").alias("lo"), (F.greatest(F.max("doc_id") - F.min("doc_id") + 1, F.lit(1)) / 1024.0).alias("w"))
    binned = docs.join(F.broadcast(step)).withColumn("bin", F.floor((F.col("doc_id") - F.col("lo")) / F.col("w")).cast("int")).drop("lo", "w")
    counts = binned.groupBy("bin").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("before", upto - F.col("c")).join(F.broadcast(edge))
    met = binned.join(F.broadcast(counts), "bin").filter("before < k")
    # Only the bin in which the size is met is ranked.
    edge = met.filter("before + c > k").withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy("doc_id"))).filter("before + r <= k")
    return met.filter("before + c <= k").select("doc_id").unionByName(edge.select("doc_id"))


def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.train_valid_split(_ids(spark, sf_dir), "doc_id", 0.1, 1234).select("doc_id", "split")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.train_valid_split(_ids(spark, sf_dir, "lang"), "doc_id", 0.3, 1234, ("lang",)).select("lang", "doc_id", "split")


def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(_ids(spark, sf_dir, "lang"), "doc_id", 0.29, SEED, ("lang",)).select("lang", "doc_id")


def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample(_ids(spark, sf_dir), "doc_id", 2.3, SEED).groupBy("doc_id").agg(F.count("*").alias("times"))


def _two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    a = S.train_valid_split(table(spark, sf_dir, "documents").select(long("doc_id").alias("row_id"), "text"), "row_id", 0.1, SEED)
    b = S.train_valid_split(table(spark, sf_dir, "benchmark").select(long("item_id").alias("row_id"), "text"), "row_id", 0.5, SEED)
    return [a, b.withColumn("split", F.when(F.col("split") == "valid", F.lit("test")).otherwise(F.lit("train")))]


def merge_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents' splits and one and a half of the benchmark's, in one table."""
    out = S.merge(_two(spark, sf_dir), "row_id", [0.5, 1.5], SEED)
    return out.groupBy(long("dataset_id").alias("dataset_id"), "split", "row_id").agg(F.count("*").alias("times"), long(F.max(F.length("text"))).alias("chars"))


def merge_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each dataset gives to each split, and the share of its own rows that they are."""
    two = _two(spark, sf_dir)
    out = S.merge(two, "row_id", [0.5, 1.5], SEED).groupBy(long("dataset_id").alias("dataset_id"), "split").agg(F.count("*").alias("rows"))
    sizes = [d.groupBy("split").agg(F.count("*").alias("rows_in")).withColumn("dataset_id", F.lit(k).cast("long")) for k, d in enumerate(two)]
    return out.join(sizes[0].unionByName(sizes[1]), ["dataset_id", "split"], "left").select("dataset_id", "split", "rows", "rows_in", (F.col("rows") / F.col("rows_in")).alias("efficiency"))


def schema_compat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of tables: columns that only one has, and common ones whose types differ."""
    columns = [(t, f.name, f.dataType.simpleString().upper()) for t in TABLES for f in table(spark, sf_dir, t).schema]
    s = rows(spark, "t c k", columns)
    pairs = rows(spark, "a b", [(a, b) for a in TABLES for b in TABLES if a < b])
    left, right = s.select(F.col("t").alias("a"), "c", F.col("k").alias("ka")), s.select(F.col("t").alias("b"), "c", F.col("k").alias("kb"))
    both = pairs.join(left, "a").join(pairs.join(right, "b"), ["a", "b", "c"], "full")
    return both.groupBy("a", "b").agg(long(F.count_if(F.col("ka").isNull() | F.col("kb").isNull())).alias("one_sided"), long(F.count_if(F.col("ka") != F.col("kb"))).alias("retyped"), F.count_if(F.col("ka").eqNullSafe(F.col("kb"))).cast("long").alias("alike"))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each language and their share of all rows."""
    n = _ids(spark, sf_dir, "lang").groupBy("lang").agg(F.count("*").alias("rows"))
    return n.withColumn("pct", F.col("rows") * 100 / F.sum("rows").over(Window.partitionBy(F.lit(0))))


def incremental_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no label row yet: what a run that skips existing output would still do."""
    return _ids(spark, sf_dir, "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def _ranked(key: str, frm: str, seed: int, by: str = "", more: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"(SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}-' || {key}), {key}) AS r, count(*) OVER ({part.strip()}) AS n FROM {frm} {more})"


_A = f"(SELECT row_id, text, CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM {_ranked('row_id', '(SELECT doc_id AS row_id, text FROM documents)', SEED)})"
_B = f"(SELECT row_id, text, CASE WHEN r <= ceil(n * 0.5::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {_ranked('row_id', '(SELECT item_id AS row_id, text FROM benchmark)', SEED)})"
_MERGED = (
    f"m AS (SELECT 0 AS dataset_id, split, row_id, text, 1 AS times, n FROM {_ranked('row_id', _A, SEED, 'split')} WHERE r <= floor(n * 0.5::DOUBLE) "
    f"UNION ALL SELECT 1, split, row_id, text, (floor(n * 1.5::DOUBLE)::BIGINT // n) + CASE WHEN r <= floor(n * 1.5::DOUBLE)::BIGINT % n THEN 1 ELSE 0 END, n FROM {_ranked('row_id', _B, SEED + 1, 'split')})"
)
_SCHEMA = {
    "documents": {"doc_id": "BIGINT", "text": "STRING", "lang": "STRING", "source": "STRING", "n_chars": "BIGINT"},
    "benchmark": {"item_id": "BIGINT", "text": "STRING"},
    "labels": {"doc_id": "BIGINT", "quality": "INT", "toxic": "INT"},
    "pages": {"page_id": "BIGINT", "url": "STRING", "html": "STRING"},
    "conversations": {"conv_id": "BIGINT", "turn": "BIGINT", "role": "STRING", "text": "STRING"},
}

def _permuted_sql() -> str:
    """Rounds as nested expressions; what lands beyond goes through again, at most as often as there are numbers beyond."""
    mixed = lambda x, k: f"list_transform([({x} * {S.MULTIPLIERS[0]} + {k}) % 2147483648], lambda y: xor((xor(y, y >> 15) * {S.MULTIPLIERS[1]}) % 2147483648, ((xor(y, y >> 15) * {S.MULTIPLIERS[1]}) % 2147483648) >> 13))[1]"
    steps, names = [], ("l", "r")
    for k, key in enumerate(S.round_keys(SEED)):
        new = {"l": "l", "r": "r"}
        own, other, size = ("r", "l", "b") if k % 2 else ("l", "r", "a")
        new[own] = f"({own} + {mixed(other, key)}) % {size}"
        steps.append(f"s{k + 1} AS (SELECT doc_id, pos, n, a, b, {', '.join(f'{new[x]} AS {x}' for x in names)} FROM s{k})")
    last = f"s{S.ROUNDS}"
    return f"""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
q AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM p), z AS (SELECT *, CASE WHEN n % a = 0 THEN n // a ELSE n // a + 1 END AS b FROM q),
w AS (
  SELECT 0 AS step, doc_id, pos, n, a, b FROM z
  UNION ALL
  SELECT * FROM (WITH s0 AS (SELECT step, doc_id, pos, n, a, b, pos // b AS l, pos % b AS r FROM w WHERE step = 0 OR pos >= n), {", ".join(x.replace("SELECT doc_id", "SELECT step, doc_id") for x in steps)}
                 SELECT step + 1, doc_id, l * b + r, n, a, b FROM {last}))
SELECT doc_id, pos::BIGINT AS place FROM w WHERE step > 0 AND pos < n"""


QUERIES = {f.__name__: f for f in (sample_per_source, seeded_shuffle_prefix, shuffle_top20, permuted_places, train_prefix, train_valid_split, stratified_split, undersample, oversample, merge_datasets, merge_contributions, schema_compat_matrix, distinct_keys, incremental_skip_existing)}

ORACLES = {
    "permuted_places": _permuted_sql(),
    "sample_per_source": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= greatest(1, 100 // (SELECT count(DISTINCT source) FROM documents))",
    "seeded_shuffle_prefix": f"SELECT doc_id FROM {_ranked('doc_id', 'documents', SEED)} WHERE r <= floor(n * 0.15::DOUBLE)",
    "shuffle_top20": f"SELECT doc_id, md5('{SEED}-' || doc_id) AS place FROM documents ORDER BY 2, 1 LIMIT 20",
    "train_prefix": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.29::DOUBLE)",
    "train_valid_split": f"SELECT doc_id, CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM {_ranked('doc_id', 'documents', 1234)}",
    "stratified_split": f"SELECT lang, doc_id, CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM {_ranked('doc_id', 'documents', 1234, 'lang')}",
    "undersample": f"SELECT lang, doc_id FROM {_ranked('doc_id', 'documents', SEED, 'lang')} WHERE r <= floor(n * 0.29::DOUBLE)",
    "oversample": f"SELECT doc_id, (floor(n * 2.3::DOUBLE)::BIGINT // n) + CASE WHEN r <= floor(n * 2.3::DOUBLE)::BIGINT % n THEN 1 ELSE 0 END AS times FROM {_ranked('doc_id', 'documents', SEED)}",
    "merge_datasets": f"WITH {_MERGED} SELECT dataset_id::BIGINT AS dataset_id, split, row_id, times::BIGINT AS times, length(text)::BIGINT AS chars FROM m",
    "merge_contributions": f"WITH {_MERGED} SELECT dataset_id::BIGINT AS dataset_id, split, sum(times)::BIGINT AS rows, max(n) AS rows_in, (sum(times) / max(n))::DOUBLE AS efficiency FROM m GROUP BY 1, 2",
    "schema_compat_matrix": "WITH s AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in _SCHEMA.items() for c, k in cs.items())
    + ") v(t, c, k)), p AS (SELECT a.t AS a, b.t AS b FROM (SELECT DISTINCT t FROM s) a, (SELECT DISTINCT t FROM s) b WHERE a.t < b.t), "
    "j AS (SELECT p.a, p.b, c.c, x.k AS ka, y.k AS kb FROM p, (SELECT DISTINCT c FROM s) c LEFT JOIN s x ON x.t = p.a AND x.c = c.c LEFT JOIN s y ON y.t = p.b AND y.c = c.c WHERE x.k IS NOT NULL OR y.k IS NOT NULL) "
    "SELECT a, b, count(*) FILTER (ka IS NULL OR kb IS NULL) AS one_sided, count(*) FILTER (ka <> kb) AS retyped, count(*) FILTER (ka = kb) AS alike FROM j GROUP BY a, b",
    "distinct_keys": "SELECT lang, n AS rows, (n * 100 / sum(n) OVER ())::DOUBLE AS pct FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)",
    "incremental_skip_existing": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
}
