"""Personal data: spans by pattern, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers, and
secrets: access keys, and values given to a name like password or token. Each
such value is a protected entity. Over the whole corpus, a term in the documents that
mention an entity discloses it by their pointwise mutual information; where that
reaches a share of the entity's information content, all occurrences of the term
in documents that mention the entity are generalised, and above a second share
removed; a generalised term becomes the class of its shape. A document holds a
term where it stands outside of the pattern's spans. All of it is built from SQL functions; patterns carry look-behinds and possessive
quantifiers that change no match, but keep long texts linear and off the stack.

Defined results: a null or empty text has no spans and stays as it is; repeated
rows are handled one by one and count one by one; documents without a mention
are never changed; extra columns ride along (names beginning with ``_p_`` are
ours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, broadcast_if_small, stored, table

# The contract's patterns, in the order of its kinds.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
# Public forms of access keys, and names of secrets with the value behind them.
PATTERNS["secret"] = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}+|\bxox[abprs]-[0-9A-Za-z-]{10,}+|\bsk-[0-9A-Za-z_-]{20,}+|\beyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]++"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)['\x22]?[\x20]?[=:][\x20]?['\x22]?(?=[^\s'\x22]*[0-9])[^\s'\x22]{8,}+"
)
#: What a text must hold, or match, before a pattern is tried on it.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
HINT_PATTERNS = {"card": "[0-9]", "secret": "[=:_]|AKIA|ASIA|xox|sk-|eyJ|-----BEGIN"}
KINDS = (*PATTERNS, "term")

#: Documents in which a term and an entity must meet before they are judged: what occurs once is no evidence of going together.
MIN_SUPPORT = 2
#: Shares of an entity's information content from which a term is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.99
TERM = r"\p{L}{3,}"

_SPAN = "struct<start:int,kord:int,end:int,kind:string,value:string>"


def _matches(out: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds _p_m_<kind> and _p_g_<kind>: the matches of a kind and the gaps around them."""
    there = F.contains(F.col(text), F.lit(HINTS[kind])) if kind in HINTS else F.col(text).rlike(HINT_PATTERNS[kind])
    empty = F.array().cast("array<string>")
    found = F.when(there, F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))).otherwise(empty)
    out = out.withColumn(f"_p_m_{kind}", found)
    return out.withColumn(f"_p_g_{kind}", F.when(F.size(f"_p_m_{kind}") > 0, F.split(F.col(text), PATTERNS[kind], -1)).otherwise(empty))


def _located(m: str, g: str, kind: str) -> Column:
    """Spans of the matches m between the gaps g, in code points."""
    k = KINDS.index(kind)
    return F.expr(
        f"CASE WHEN size({m}) = 0 THEN cast(array() AS array<{_SPAN}>) ELSE aggregate(sequence(0, size({m}) - 1), "
        f"named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)), "
        f"(a, i) -> named_struct('at', a.at + length({g}[i]) + length({m}[i]), 'out', concat(a.out, array(named_struct("
        f"'start', a.at + length({g}[i]), 'kord', {k}, 'end', a.at + length({g}[i]) + length({m}[i]), 'kind', '{kind}', 'value', {m}[i])))), a -> a.out) END"
    )


def _valid(kind: str) -> str:
    if kind == "ip":
        return "forall(split(x.value, '[.]'), p -> coalesce(try_cast(p AS bigint) <= 255, false))"
    if kind == "card":
        digits = "reverse(replace(replace(x.value, ' ', ''), '-', ''))"
        return (
            f"pmod(aggregate(transform(split({digits}, ''), (c, i) -> coalesce(try_cast(c AS int), 0) * (1 + pmod(i, 2))), 0, "
            "(a, v) -> a + CASE WHEN v > 9 THEN v - 9 ELSE v END), 10) = 0"
        )
    if kind == "phone":
        return "length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 9 AND 15"
    return "true"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_p_base``: the spans that the patterns find, by start, then kind."""
    out = docs.withColumn("_p_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for kind in PATTERNS:
        out = _matches(out, "_p_text", kind)
    out = out.withColumns({f"_p_s_{k}": _located(f"_p_m_{k}", f"_p_g_{k}", k) for k in PATTERNS})
    every = F.concat(*[F.expr(f"filter(_p_s_{k}, x -> {_valid(k)})") for k in PATTERNS])
    out = out.withColumn("_p_base", F.array_sort(every))
    return out.drop("_p_text", *[f"_p_{x}_{k}" for x in "mgs" for k in PATTERNS])


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_p_base``, ``_p_entities`` (distinct keys), ``_p_terms`` (distinct, lower case) and, where there is a mention, ``_p_open``: the text with base spans blanked."""
    plain = "CASE WHEN x.kind IN ('card', 'phone') THEN regexp_replace(x.value, '[^0-9]', '') ELSE lower(x.value) END"
    slim = "transform(_p_base, x -> named_struct('start', x.start, 'kord', x.kord, 'end', x.end, 'kind', x.kind))"
    name = f"`{text}`"
    blanked = (
        "CASE WHEN size(_p_base) > 0 THEN aggregate(_p_base, named_struct('at', 0, 'out', cast(array() AS array<string>)), "
        "(a, s) -> named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.end <= a.at THEN a.out ELSE concat(a.out, "
        f"array(substring({name}, a.at + 1, s.start - a.at), repeat(' ', s.end - greatest(a.at, s.start)))) END), "
        f"a -> concat(array_join(a.out, ''), substring({name}, a.at + 1))) END"
    )
    out = base_spans(docs, text).withColumn("_p_entities", F.expr(f"array_distinct(transform(_p_base, x -> xxhash64(x.kind, {plain})))"))
    out = out.withColumn("_p_base", F.expr(slim)).withColumn("_p_open", F.expr(blanked))
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("_p_open"), F.col(name), F.lit(""))), F.lit(TERM), F.lit(0)))
    return out.withColumn("_p_terms", held)


def disclosing_terms(found: DataFrame, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows (``_p_row``) and terms in which a term discloses an entity that the row mentions, with ``removed``.

    found: what :func:`mentions` gives, written out. All counts are documents,
    over whole texts. A pair meets in at most as many documents as its rarer
    side has, so terms and pairs that must fail with that many drop out, exactly,
    before pairs are counted, and all texts are asked only for the terms left.
    """
    n = float(found.count())
    entities = found.select(F.explode("_p_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = stored(entities.filter(F.col("n_entity") >= min_support), "pii-entities")
    most = entities.agg(F.max("n_entity")).first()[0] or 1

    def reach(n_entity: Column) -> Column:
        # both <= n_entity in both * n / (n_term * n_entity) >= (n / n_entity) ** generalise; a little more for rounding
        return F.pow(F.lit(n) / n_entity, F.lit(-generalise)) * n * (1 + 1e-9)

    # Terms of documents without a mention raise n_term alone, so counts over the others bound it from below.
    told = found.filter("size(_p_entities) > 0").select("_p_row", "_p_entities", "_p_terms")
    beside = told.select(F.explode("_p_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_beside"))
    beside = stored(beside.filter((F.col("n_beside") >= min_support) & (F.col("n_beside") <= reach(F.lit(float(most))))), "pii-beside")
    known = told.select("_p_row", F.explode("_p_entities").alias("entity")).join(broadcast_if_small(entities), "entity")
    known = stored(known, "pii-known")
    held = told.join(broadcast_if_small(known.select("_p_row").distinct()), "_p_row", "left_semi")
    held = held.select("_p_row", F.explode("_p_terms").alias("term")).join(broadcast_if_small(beside), "term")
    met = stored(known.join(held, "_p_row").filter(F.col("n_beside") <= reach(F.col("n_entity"))), "pii-met")
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("n_beside").alias("n_beside"), F.first("n_entity").alias("n_entity"))
    pairs = pairs.filter((F.col("both") >= min_support) & (F.col("n_beside") <= reach(F.col("n_entity")) * F.col("both") / F.col("n_entity")))
    pairs = stored(pairs.drop("n_beside"), "pii-pairs")
    wanted = stored(pairs.select("term").distinct(), "pii-terms")
    n_wanted = wanted.count()
    tokens = found.select(F.explode("_p_terms").alias("term"))
    if n_wanted <= BROADCAST_ROWS:
        tokens = tokens.join(F.broadcast(wanted), "term", "left_semi")
    # A common word beside many entities would be hot in a shuffled join; that of a small table has no such task.
    counts = stored(tokens.groupBy("term").agg(F.count("*").alias("n_term")), "pii-counts")
    pairs = pairs.join(broadcast_if_small(counts, n_wanted if n_wanted <= BROADCAST_ROWS else None), "term").withColumn("known", F.log2(F.lit(n) / F.col("n_entity")))
    pairs = pairs.withColumn("shared", F.log2(F.col("both") * n / (F.col("n_term") * F.col("n_entity"))))
    risky = pairs.filter(F.col("shared") >= F.col("known") * generalise).select("entity", "term", (F.col("shared") >= F.col("known") * remove).alias("removed"))
    risky = stored(risky, "pii-risky")
    return met.select("_p_row", "entity", "term").join(broadcast_if_small(risky), ["entity", "term"]).groupBy("_p_row", "term").agg(F.max("removed").alias("removed"))


def _occurrences(told: DataFrame) -> DataFrame:
    """``_p_row`` and ``_p_added``: all places of the terms ``_p_risky`` in ``_p_open``, in code points."""
    out = told.withColumns({"_p_m": F.regexp_extract_all("_p_open", F.lit(TERM), F.lit(0)), "_p_g": F.split("_p_open", TERM, -1)})
    out = out.withColumn("_p_hit", F.expr("transform(_p_m, m -> element_at(_p_risky, lower(m)))"))
    span = "struct<start:int,end:int,removed:boolean>"
    places = (
        f"aggregate(sequence(0, size(_p_m) - 1), named_struct('at', 0, 'out', cast(array() AS array<{span}>)), (a, i) -> named_struct("
        "'at', a.at + length(_p_g[i]) + length(_p_m[i]), 'out', CASE WHEN _p_hit[i] IS NULL THEN a.out ELSE concat(a.out, array(named_struct("
        "'start', a.at + length(_p_g[i]), 'end', a.at + length(_p_g[i]) + length(_p_m[i]), 'removed', _p_hit[i]))) END), a -> a.out)"
    )
    return out.select("_p_row", F.expr(places).alias("_p_added"))


def sanitise(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **thresholds: float) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``_p_base`` and ``_p_added``: base and added spans.

    Added spans are structs of start, end and removed; none overlaps a base span.
    """
    keep = docs.columns if keep is None else keep
    found = mentions(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]), text)
    found = found.select(*[F.col(f"`{c}`") for c in keep], "_p_base", "_p_entities", "_p_terms", "_p_open", F.monotonically_increasing_id().alias("_p_row"))
    found = stored(found, "pii-found")
    risky = disclosing_terms(found, **thresholds).groupBy("_p_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("_p_risky"))
    told = found.filter("size(_p_entities) > 0").select("_p_row", "_p_open")
    added = stored(_occurrences(told.join(risky, "_p_row")), "pii-added")
    nothing = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    out = found.join(added, "_p_row", "left").withColumn("_p_added", F.coalesce("_p_added", nothing))
    return out.drop("_p_entities", "_p_terms", "_p_open", "_p_row")


def masked(body: str) -> Column:
    """The column ``body`` with every span of ``_p_base`` and ``_p_added`` replaced; overlapping ones become one, named by the first.

    Base spans become their kind in brackets, generalised terms the class of their shape
    (acronym, name or word), removed ones nothing.
    """
    every = (
        "array_sort(concat(transform(_p_base, b -> named_struct('start', b.start, 'kord', b.kord, 'end', b.end, 'by', concat('[', upper(b.kind), ']'))), "
        f"transform(_p_added, t -> named_struct('start', t.start, 'kord', {len(PATTERNS)}, 'end', t.end, 'by', CASE WHEN t.removed THEN '' "
        f"WHEN rlike(substring({body}, t.start + 1, t.end - t.start), '^\\\\p{{Lu}}+$') THEN '[ACRONYM]' WHEN rlike(substring({body}, t.start + 1, 1), '\\\\p{{Lu}}') THEN '[NAME]' ELSE '[WORD]' END))))"
    )
    return F.expr(
        f"CASE WHEN size(_p_base) = 0 THEN {body} ELSE aggregate({every}, named_struct('at', 0, 'out', cast(array() AS array<string>)), "
        f"(a, s) -> named_struct('at', greatest(a.at, s.end), 'out', CASE WHEN s.start < a.at THEN a.out ELSE concat(a.out, array(substring({body}, a.at + 1, s.start - a.at), s.by)) END), "
        f"a -> concat(array_join(a.out, ''), substring({body}, a.at + 1))) END"
    )


def sanitised(docs: DataFrame, text: str = "text", n_chars: str | None = None, **thresholds: float) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; ``n_chars`` names a length column to renew."""
    out = sanitise(docs, text, **thresholds).withColumn("_p_whole", F.col(f"`{text}`"))
    out = out.withColumn(text, masked("_p_whole"))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.coalesce(F.length(F.col(f"`{text}`")).cast("long"), F.col(n_chars)))
    return out.select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = "transform(filter(_p_base, b -> b.kind <> 'secret'), b -> concat_ws(':', b.kind, b.start, b.end))"
    every = (
        "array_sort(concat(transform(_p_base, b -> named_struct('start', b.start, 'kord', b.kord, 'end', b.end, 'kind', b.kind)), "
        f"transform(_p_added, t -> named_struct('start', t.start, 'kord', {len(PATTERNS)}, 'end', t.end, 'kind', 'term'))))"
    )
    return out.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(_p_base, b -> b.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(f"array_join({base}, ',')").cast("binary"), 256).alias("base_sha256"),
        F.expr(f"array_join(transform({every}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')").alias("spans"),
        F.expr("cast(size(filter(_p_base, b -> b.kind = 'secret')) AS bigint)").alias("n_secret"),
        F.size("_p_added").cast("long").alias("n_term"),
        (F.size("_p_base") + F.size("_p_added")).cast("long").alias("n_spans"),
    )


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
