"""URL filters: host and path rules, and association rules mined from labels.

FP-growth finds combinations of URL tokens that go with a blocking label. A rule
is kept if its support reaches a fixed share of the labelled URLs, if the lower
end of its confidence's 95 % interval reaches both a threshold and the share of
blocked URLs as a whole, and if no rule on fewer of its tokens is as confident.
The interval alone keeps chance out where labels are few. Rules are indexed by
their rarest token: a URL's tokens are joined with that index and the other
tokens checked by set inclusion, so a URL meets only the rules that it may fit.

Written rules of host and path come first: a rule fits its host and subdomains
where the path starts with the rule's; of several the longest decides.

Defined results: a null URL or one without ``://`` has an empty host and path
and no tokens, no rule fits, and it is allowed; repeated rows are judged alike;
very long URLs are taken whole; labels that are null don't block, and of several
labels of one page any that blocks does; URLs without a label aren't mined;
columns of the input named like a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import broadcast_if_small, stored, table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The contract's rules.
RULES = (HostRule("block", "com", "/en/"), HostRule("allow", "example.com", "/en/7"), HostRule("allow", "net", "/de/"), HostRule("block", "example.net", "/de/8"), HostRule("block", "org", "/es/"))

#: Share of the labelled URLs that a combination with the blocking label must reach, at every size.
MIN_SUPPORT = 0.002
#: What the lower end of a confidence's interval must reach, and how many standard deviations below the middle it lies.
MIN_CONFIDENCE, DEVIATIONS = 0.5, 1.96
LABEL = "\x00block"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if null or without."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> Column:
    """Name and verdict of the longest rule that fits, as a struct; null if none does. Equal lengths: the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, each domain the host lies in, path segments with numbers made alike, names of query fields."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(F.lower(s), "[0-9]+", "0")))
    fields = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda q: F.concat(F.lit("field="), F.lower(q)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    every = F.array_distinct(F.concat(scheme, domains, segments, fields))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def lower_end(share: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """The lower end of Wilson's interval for a share seen n times."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """items, index_item, confidence and support of the kept rules; labelled: tokens (array) and blocked (boolean).

    All tokens take part. Frequent ones number at most tokens in a URL / ``min_support``, and
    rules at most 2^(most frequent tokens in a URL) / ``min_support``, whatever the number of URLs.
    """
    labelled = stored(labelled.select("tokens", "blocked"), "url-labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    if not bad:
        return labelled.sparkSession.createDataFrame([], "items array<string>, index_item string, confidence double, support double")
    baskets = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(LABEL))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.array_contains("consequent", LABEL))
    rules = stored(rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-rules")
    # Spark gives a rule's support as the share with its consequent; how often its tokens occur follows.
    lowest = lower_end(F.col("confidence"), F.col("support") * n / F.col("confidence"))
    rules = rules.filter((lowest >= min_confidence) & (lowest > bad / n))
    # A rule falls if one on some of its tokens is as confident: looked up by what is left without each one of them.
    less = rules.select(F.col("items").alias("own"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"), F.col("confidence").alias("c"))
    needless = less.join(rules, "items").filter("confidence >= c").select(F.col("own").alias("items")).distinct()
    kept = rules.join(needless, "items", "left_anti")
    counts = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("k"))
    rarest = kept.select("items", F.explode("items").alias("token")).join(counts, "token").groupBy("items").agg(F.min_by("token", F.struct("k", "token")).alias("index_item"))
    return kept.join(rarest, "items").select("items", "index_item", "confidence", "support")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of ``urls`` (url, tokens) the distinct ones that some rule fits, with the confidence and the items of the best.

    Only tokens that index a rule go on; the index is broadcast when counted
    small, which its bound makes usual, and else joined by shuffle.
    """
    met = urls.select("url", "tokens", F.explode("tokens").alias("index_item")).join(broadcast_if_small(rules), "index_item").filter(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", "support", "items")).alias("best")).select("url", F.col("best.confidence").alias("confidence"), F.array_join("best.items", " ").alias("mined_rule"))


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", written: tuple[HostRule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined_rule and confidence.

    URLs that a mined rule fits are broadcast when counted small; else rows meet
    them by shuffle, where those without a URL have keys of their own.
    """
    own = ("host", "path", "rule", "verdict", "mined_rule", "confidence")
    kept = [c for c in pages.columns if c not in own]
    address = F.col(f"`{url}`")
    out = pages.select(*[F.col(f"`{c}`") for c in kept], address.alias("_url"), F.coalesce(host_of(address), F.lit("")).alias("host"), F.coalesce(path_of(address), F.lit("")).alias("path"))
    rules = stored(rules, "url-index")
    urls = out.filter(F.col("host") != "").select(F.col("_url").alias("url"), tokens_of(F.col("_url"), F.col("host"), F.col("path")).alias("tokens"))
    hits = stored(match_rules(urls, rules), "url-hits").withColumnRenamed("url", "_hit")
    alone = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_url", F.when(F.col("host") != "", F.col("_url")).otherwise(alone))
    out = out.join(broadcast_if_small(hits), F.col("_url") == F.col("_hit"), "left").withColumn("_rule", rule_of(F.col("host"), F.col("path"), written))
    mined = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", mined).alias("verdict"), "mined_rule", "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and blocked of the pages that have a label; blocked: bad quality or toxic, by any of its labels."""
    blocked = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    by_id = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(blocked).alias("blocked"))
    sized = pages.select("page_id", F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    return sized.select("page_id", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).join(by_id, "page_id").select("tokens", "blocked")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine_rules(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES: dict[str, str] = {}
