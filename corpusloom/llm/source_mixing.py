"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (say domain, language, source) gets a budget of tokens. At each
node it is split among the children by weight; a child that can't use its share
(all its tokens, in all epochs allowed) takes what it can, and the rest goes to
its siblings by weight. Shortages are so made up among siblings before they
reach an ancestor, whose own share is bounded by what all its leaves can give.
All shares are whole tokens: a level's rest is dealt by running totals.

A leaf's target is served from seeded epochs: whole epochs first, then the
prefix of one more, in the order of a seeded digest of the document's id. Where
the prefix ends is found without sorting a leaf: tokens are summed by the first
two digits of the digest, then by the next two of those in the bucket in which
the target is met, until that bucket is small; only its rows are ranked.

Defined results: null level values are nodes of their own; a null text has no
tokens, and such documents are only chosen in whole epochs or below the end of
a prefix; repeated rows are chosen alike up to the end of the prefix, where ties
are broken by their size; an empty table gives an empty mix; weights not listed
are 1, weights of 0 get nothing unless all siblings have 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, stored, table, words

SEED = 17
#: Epochs in which a leaf's tokens may be used.
MAX_EPOCHS = 3
#: Hex digits of the digest by which tokens are summed at a time (256 buckets), and rows of a bucket that one task ranks.
DIGITS, RANKED_ROWS = 2, 10_000

#: Weights of the production query: paths of level values, whole numbers, others 1.
WEIGHTS: dict[tuple[str, ...], int] = {("d0",): 4, ("d1",): 2, ("d2",): 2, ("d0", "en"): 3, ("d1", "fr"): 5, ("d2", "es"): 6, ("d0", "en", "src0"): 2}


def domain_of(source: Column) -> Column:
    """The production query's domain: the number at the end of the source's name, modulo 4; else ``other``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(4)).cast("string"))).otherwise(F.lit("other"))


def _weight(levels: list[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of the node that the level columns name."""
    own = [(k, w) for k, w in weights.items() if len(k) == len(levels)]
    out = F.lit(1)
    for key, w in own:
        out = F.when(_all([F.col(c) == v for c, v in zip(levels, key, strict=True)]), F.lit(int(w))).otherwise(out)
    return out.cast("decimal(20,0)")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[tuple[str, ...], int], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels and tokens) with ``target``: the leaf's share of the budget in whole tokens.

    One window over the children of each parent at each level; the rows are nodes of the tree, never documents.
    """
    whole = "decimal(38,0)"
    nodes = {len(levels): leaves.select(*levels, (F.col("tokens") * max_epochs).cast(whole).alias("cap"))}
    for k in range(len(levels) - 1, 0, -1):
        nodes[k] = nodes[k + 1].groupBy(*levels[:k]).agg(F.sum("cap").cast(whole).alias("cap"))
    shares = leaves.agg(F.least(budget, F.coalesce(F.sum("tokens"), F.lit(0)) * max_epochs).cast(whole).alias("share"))
    parents = shares.select(F.lit(0).alias("root"), "share")
    for k in range(1, len(levels) + 1):
        above, own = (["root"] if k == 1 else levels[: k - 1]), levels[:k]
        children = nodes[k].withColumn("root", F.lit(0)).withColumn("w", _weight(own, weights))
        children = children.join(parents.select(*above, "share").withColumnsRenamed({c: f"_{c}" for c in above}), _all_null_safe(above), "inner").drop(*[f"_{c}" for c in above])
        # Siblings by how soon they are full; a weight of 0 fills last, and takes part only when all have 0.
        siblings = Window.partitionBy(*above)
        children = children.withColumn("w", F.when(F.max("w").over(siblings) == 0, F.lit(1).cast("decimal(20,0)")).otherwise(F.col("w")))
        full_at = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf")))
        children = children.withColumn("full_at", full_at)
        order = siblings.orderBy("full_at", *[F.asc_nulls_first(c) for c in own])
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        children = children.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(whole), "open": F.coalesce(F.sum("w").over(after), F.lit(0)).cast(whole)})
        # Full if its share of what its predecessors left, all of them full, is more than it can use.
        is_full = (F.col("w") > 0) & ((F.col("share") - F.col("taken")) * F.col("w") >= F.col("cap") * F.col("open"))
        children = children.withColumn("full", F.when(is_full, 1).otherwise(0)).withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rest = F.col("share") - F.coalesce(F.sum(F.when(F.col("full") == 1, F.col("cap"))).over(siblings), F.lit(0))
        open_w = F.when(F.col("full") == 0, F.col("w")).otherwise(0)
        total = F.coalesce(F.sum(open_w).over(siblings), F.lit(0))
        upto = F.coalesce(F.sum(open_w).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        children = children.withColumns({"rest": rest.cast(whole), "total": total.cast(whole), "upto": upto.cast(whole), "own_w": open_w.cast(whole)})
        dealt = F.expr("CASE WHEN full = 1 THEN cap WHEN total = 0 THEN 0 ELSE rest * upto div total - rest * (upto - own_w) div total END")
        parents = children.select(*own, dealt.cast(whole).alias("share"))
    return parents.select(*levels, F.col("share").cast("long").alias("target"))


def _all_null_safe(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _digest(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, levels: list[str], key: str, tokens: Column, weights: Mapping[tuple[str, ...], int], share: float | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Chosen documents: levels, key, n_tokens, epochs (whole ones), and take_tokens of one more epoch (0: none).

    budget: tokens wanted, or ``share`` of the tokens that there are. The
    documents' ids and token counts are written out once; the text isn't read again.
    """
    kept = [F.col(f"`{c}`") for c in levels]
    rows = stored(docs.select(*kept, F.col(f"`{key}`").alias("key"), tokens.cast("long").alias("n_tokens")), "mix-rows")
    leaves = stored(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    if budget is not None:
        wanted = F.lit(budget)
    else:
        wanted = F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(1.0 if share is None else share))
    plan = budgets(leaves, levels, weights, wanted, max_epochs).withColumnsRenamed({c: f"_{c}" for c in levels})
    plan = leaves.join(plan, _all_null_safe(levels)).select(*levels, "target", F.expr("CASE WHEN tokens > 0 THEN target div tokens ELSE 0L END").alias("epochs"), F.expr("CASE WHEN tokens > 0 THEN target % tokens ELSE 0L END").alias("rest"))
    plan = stored(plan, "mix-plan").withColumnsRenamed({c: f"_{c}" for c in levels})
    n_leaves = plan.count()
    dealt = rows.join(broadcast_if_small(plan, n_leaves), _all_null_safe(levels)).drop(*[f"_{c}" for c in levels])
    dealt = dealt.withColumn("place", F.concat(_digest(seed, F.col("epochs"), F.col("key")), F.lpad(F.col("n_tokens").cast("string"), 20, "0")))
    # The bucket of the digest in which each leaf's rest is met, with ever more digits.
    open_rows, depth = dealt.filter("rest > 0"), 0
    at = plan.filter("rest > 0").select(*[f"_{c}" for c in levels], F.lit("").alias("last_bucket"), F.lit(0).cast("long").alias("before"))
    while True:
        near = open_rows.join(broadcast_if_small(at, n_leaves), _all_null_safe(levels)).filter(F.startswith("place", F.col("last_bucket")))
        bucket = F.substring("place", depth + 1, DIGITS).alias("bucket")
        summed = near.groupBy(*levels, "rest", "last_bucket", "before", bucket).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
        running = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        met = summed.withColumn("upto", F.sum("n").over(running) + F.col("before")).filter("upto >= rest AND upto - n < rest")
        met = stored(met.select(*levels, F.concat("last_bucket", "bucket").alias("last_bucket"), (F.col("upto") - F.col("n")).alias("before"), "k"), "mix-met")
        at = met.drop("k").withColumnsRenamed({c: f"_{c}" for c in levels})
        depth += DIGITS
        if (met.agg(F.max("k")).first()[0] or 0) <= RANKED_ROWS or depth >= 32:
            break
    near = dealt.join(broadcast_if_small(at, n_leaves), _all_null_safe(levels), "left").drop(*[f"_{c}" for c in levels])
    bucket = F.substring("place", 1, depth)
    whole = near.filter(F.coalesce(bucket != F.col("last_bucket"), F.lit(True)))
    whole = whole.withColumn("take_tokens", F.when(bucket < F.col("last_bucket"), F.col("n_tokens")).otherwise(F.lit(0)))
    edge = near.filter(bucket == F.col("last_bucket"))
    rank = Window.partitionBy(*levels).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("n_tokens").over(rank) + F.col("before"))
    edge = edge.withColumn("take_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - (F.col("upto") - F.col("n_tokens"))))).drop("upto")
    out = whole.unionByName(edge).filter("epochs > 0 OR take_tokens > 0")
    return out.select(*levels, F.col("key").alias(key), "n_tokens", "epochs", F.col("take_tokens").cast("long").alias("take_tokens"))


def mixed_documents(docs: DataFrame, levels: dict[str, Column], key: str, tokens: Column, weights: Mapping[tuple[str, ...], int], share: float, max_epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` chosen by :func:`mix`, whole, as often as epochs have them; the document that meets the target stays whole.

    Rows with the same id and token count are chosen alike.
    """
    named = docs.withColumns({f"_m_{k}": c for k, c in levels.items()})
    sized = named.withColumn("_m_tokens", tokens.cast("long"))
    chosen = mix(sized, [f"_m_{k}" for k in levels], key, F.col("_m_tokens"), weights, share=share, max_epochs=max_epochs, seed=seed)
    times = chosen.select(F.col(key).alias("_m_key"), F.col("n_tokens").alias("_m_n"), (F.col("epochs") + F.when(F.col("take_tokens") > 0, 1).otherwise(0)).alias("_m_times"))
    times = stored(times.groupBy("_m_key", "_m_n").agg(F.max("_m_times").alias("_m_times")), "mix-times")
    out = sized.join(broadcast_if_small(times), F.col(key).eqNullSafe(F.col("_m_key")) & (F.col("_m_tokens") == F.col("_m_n")))
    return out.withColumn("_m_again", F.explode(F.sequence(F.lit(1), F.col("_m_times").cast("int")))).select(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("domain", domain_of(F.col("source")))
    return mix(docs, ["domain", "lang", "source"], "doc_id", F.size(words(F.col("text"))), WEIGHTS, share=1.0)


def _sql() -> str:
    """The mix of the production query in SQL, level by level."""
    levels = ["domain", "lang", "source"]

    def weight(k: int) -> str:
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(levels, key, strict=False)) + f" THEN {w}" for key, w in reversed(WEIGHTS.items()) if len(key) == k)
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    parts = [
        "d AS (SELECT doc_id, lang, source, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{1,9})$', 1)::INT % 4) ELSE 'other' END AS domain, "
        r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        "leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
        "p0 AS (SELECT 0 AS root, sum(tokens)::HUGEINT AS share FROM leaves)",
    ]
    for k in range(1, 4):
        own, above = levels[:k], (["root"] if k == 1 else levels[: k - 1])
        keys, up = ", ".join(own), ", ".join(above)
        on = " AND ".join(f"c.{c} IS NOT DISTINCT FROM p.{c}" for c in above)
        parts += [
            f"c{k} AS (SELECT {', '.join('c.' + c for c in own)}, {'c.root, ' if k == 1 else ''}cap, {weight(k).replace('domain', 'c.domain').replace('lang', 'c.lang').replace('source', 'c.source')} AS w, p.share FROM (SELECT 0 AS root, {keys}, (sum(tokens) * {MAX_EPOCHS})::HUGEINT AS cap FROM leaves GROUP BY {keys}) c JOIN p{k - 1} p ON {on})",
            f"o{k} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {up} ORDER BY cap::DOUBLE / w, {', '.join(c + ' NULLS FIRST' for c in own)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS taken, "
            f"sum(w) OVER (PARTITION BY {up} ORDER BY cap::DOUBLE / w, {', '.join(c + ' NULLS FIRST' for c in own)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS open FROM c{k})",
            f"f{k} AS (SELECT *, min(CASE WHEN (share - taken) * w >= cap * open THEN 1 ELSE 0 END) OVER (PARTITION BY {up} ORDER BY cap::DOUBLE / w, {', '.join(c + ' NULLS FIRST' for c in own)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS full_ FROM o{k})",
            f"r{k} AS (SELECT *, share - coalesce(sum(cap) FILTER (full_ = 1) OVER (PARTITION BY {up}), 0)::HUGEINT AS rest, coalesce(sum(w) FILTER (full_ = 0) OVER (PARTITION BY {up}), 0)::HUGEINT AS total, "
            f"coalesce(sum(w) FILTER (full_ = 0) OVER (PARTITION BY {up} ORDER BY cap::DOUBLE / w, {', '.join(c + ' NULLS FIRST' for c in own)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::HUGEINT AS upto FROM f{k})",
            f"p{k} AS (SELECT {keys}, CASE WHEN full_ = 1 THEN cap WHEN total = 0 THEN 0 ELSE rest * upto // total - rest * (upto - w) // total END AS share FROM r{k})",
        ]
    eq = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in levels)
    parts += [
        f"plan AS (SELECT a.domain, a.lang, a.source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest FROM leaves a JOIN p3 b ON {eq})",
        f"placed AS (SELECT a.*, b.epochs, b.rest, md5('{SEED}-' || b.epochs || '-' || coalesce(a.doc_id::VARCHAR, '')) || lpad(n_tokens::VARCHAR, 20, '0') AS place FROM d a JOIN plan b ON {eq})",
        "ranked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)",
        "taken AS (SELECT *, greatest(0, least(n_tokens, rest - (upto - n_tokens))) AS take_tokens FROM ranked)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT domain, lang, source, doc_id, n_tokens, epochs::BIGINT AS epochs, take_tokens::BIGINT AS take_tokens FROM taken WHERE epochs > 0 OR take_tokens > 0"


QUERIES = {"op1_source_mixing": op1_source_mixing}
ORACLES = {"op1_source_mixing": _sql()}
