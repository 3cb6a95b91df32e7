"""Telemetry, schedules, checkpoints, anonymisation, JSON and path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L
from corpusloom.operators import anonymise as A
from corpusloom.operators import checkpoints as P
from corpusloom.operators import telemetry as T
from corpusloom.plans.common import joined, long, rows, sql_rows, table
from corpusloom.sources.files import pretty_json


#: Microseconds of a time without zone, whatever the session's zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def _iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as iterations of runs: the user is the run, cumulative samples and seconds, the value as loss."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(MICROS).alias("us"), (F.col("value") / 100).alias("loss"))
    # Ranges of an hour
    return T.positions(e, "user_id", "us", 3_600_000_000, ("event_id",)).select("user_id", "event_id", long(F.col("pos") + 1).alias("iter"), "us", "loss")


def rolling_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = _iterations(spark, sf_dir).withColumns({"samples": F.col("iter") * 8, "clock": F.col("us") / 1e6})
    out = T.rolling(it, "user_id", "iter", "samples", "clock", 2)
    return out.select("user_id", "iter", F.round("samples_per_sec", 9).alias("samples_per_sec"))


def rolling_loss_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = _iterations(spark, sf_dir).withColumns({"samples": F.col("iter") * 8, "clock": F.col("us") / 1e6})
    out = T.rolling(it, "user_id", "iter", "samples", "clock", 2, "loss", 3).filter(F.pmod("iter", F.lit(2)) == 0)
    return out.select("user_id", "iter", F.round("mean_loss", 9).alias("mean_loss"), F.round(F.log("perplexity"), 9).alias("log_perplexity"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.running_total(_iterations(spark, sf_dir), "user_id", "iter", "loss", "total")
    return out.select("user_id", "iter", F.round("total", 6).alias("total"), F.expr("iter div 4").alias("optimizer_step"))


def metric_merge_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse metric rows merged by step, the last value of each kind; here events by the hour, their kind as the metric's name."""
    e = table(spark, sf_dir, "events").select(F.expr(f"{MICROS} div 3600000000").alias("step"), "event_id", "event_type", "value")
    kinds = ["click", "view", "purchase", "signup", "login", "logout"]
    wide = e.select("step", "event_id", *[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])
    return T.merged_by_step(wide, "step", "event_id", kinds)


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a column for each kind that occurs."""
    e = table(spark, sf_dir, "events").select(F.expr(f"{MICROS} div 3600000000").alias("step"), "event_id", "event_type", "value")
    return T.merged_by_step(T.wide(e, "event_type", "value"), "step", "event_id", T.metric_names(e, "event_type"))


def validation_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.col("value") / 100).alias("m"))
    return e.select("event_type", F.round("m", 9).alias("val_loss"), F.round(F.log(F.exp("m")), 9).alias("log_perplexity"))


def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 of each source by id, the last one kept, and the optimizer step of each with 4 to accumulate."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    out = T.positions(docs, "source", "doc_id")
    return out.select("source", "doc_id", F.expr("cast(pos div 8 AS bigint)").alias("batch"), F.expr("cast((pos div 8 + 1) div 4 AS bigint)").alias("step"))


def resume_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each source's epoch after 3 batches of 8."""
    return batch_assignment(spark, sf_dir).filter("batch >= 3").groupBy("source").agg(F.count("*").alias("rows"), long(F.min("batch")).alias("first_batch"))


_SCHEDULES = ("fixed", "cosine", "warmup_constant", "warmup_linear", "warmup_cosine", "warmup_cosine_restart")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in _SCHEDULES:
        s = T.schedule(spark, kind, 100, 10, 3e-4).select(F.lit(kind).alias("kind"), "step", F.round("lr", 12).alias("lr"))
        out = s if out is None else out.unionByName(s)
    return out


_CASES = [(s, k) for s in (1, 7, 10, 100, 186) for k in (1, 3, 4, 10)]


def validation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = rows(spark, "steps times", _CASES)
    at = F.expr("array_sort(array_distinct(transform(sequence(1, times), i -> greatest(1, cast(floor(cast(i AS double) / times * steps) AS int)))))")
    return cases.select(long("steps").alias("steps"), long("times").alias("times"), joined(at).alias("at"))


_PLANS = [(1000, 8, 2, 3, 4, 0.06), (999, 16, 1, 1, 1, 0.1), (5, 8, 1, 2, 1, 0.5)]


def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rows(spark, "n batch world epochs accumulate warmup", _PLANS)
    return c.select(long("n").alias("n"), F.expr("n div (batch * world)").alias("steps_per_epoch"), F.expr("(n div (batch * world)) * epochs div accumulate").alias("total_steps"), F.expr("cast(floor(((n div (batch * world)) * epochs div accumulate) * cast(warmup AS double)) AS bigint)").alias("warmup_steps"))


_DEVICES = ["NVIDIA H100 80GB HBM3", "NVIDIA H100 PCIe", "NVIDIA A100-SXM4-40GB", "NVIDIA A10G", "Tesla V100-SXM2-16GB", "Tesla T4", "Quadro RTX 5000", "GeForce RTX 3090"]
_FLOPS = [(d, p, float(v)) for d, ps in L.DEVICE_FLOPS.items() for p, v in ps.items()]


def flops_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak operations of devices by name and precision; null for an unknown device or precision."""
    d = rows(spark, "device", [(x,) for x in _DEVICES]).withColumn("key", T.device_key(F.col("device")))
    p = rows(spark, "precision", [("32-true",), ("bf16-true",), ("16-mixed",)])
    return d.crossJoin(F.broadcast(p)).join(F.broadcast(rows(spark, "key precision flops", _FLOPS)), ["key", "precision"], "left").select("device", "precision", "flops")


def defaults_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default settings under a user's: values of known keys that aren't null win."""
    d = rows(spark, "key value", [("sharding_strategy", "FULL_SHARD"), ("state_dict_type", "full"), ("cpu_offload", "false")])
    u = rows(spark, "key own", [("cpu_offload", "true"), ("unknown", "x"), ("state_dict_type", None)])
    return d.join(F.broadcast(u), "key", "left").select("key", F.coalesce("own", "value").alias("value"))


_CKPT = [f"model.model.layers.{i}.self_attn.{p}_proj.weight" for i in range(4) for p in "qkvo"] + ["model.embed_tokens.weight", "model.lm_head.weight", "optimizer.step"]
_MODEL = [f"model.layers.{i}.self_attn.{p}_proj.weight" for i in range(4) for p in "qkvo"] + ["model.embed_tokens.weight", "lm_head.weight", "model.norm.weight"]


def _params(spark: SparkSession, names: list[str]) -> DataFrame:
    return rows(spark, "param", [(n,) for n in names])


def ckpt_key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_map(_params(spark, _CKPT), _params(spark, _MODEL))


def ckpt_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage(_params(spark, _CKPT), _params(spark, _MODEL))


def ckpt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "benchmark").select("item_id")
    name = P.file_name(F.expr("item_id div 10"), F.expr("item_id * 100"))
    return d.select("item_id", name.alias("name"), P.output_folder(F.concat(F.lit("/runs/a/b."), name), "/runs").alias("folder"))


_KEYS = ["src1", "src3", "fr", "none"]


def path_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each key the last path, in id order, that has it as a directory."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit("/data"), F.col("lang"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))
    keys = rows(spark, "key", [(k,) for k in _KEYS])
    met = p.join(F.broadcast(keys), F.contains("path", F.concat(F.lit("/"), F.col("key"), F.lit("/"))))
    return met.groupBy("key").agg(F.max_by("path", "doc_id").alias("path"), F.count("*").alias("paths"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension and first directory of page paths, ``root`` where there is none."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"://[^/?#]*/?([^?#]*)", 1), "/+$", "").alias("rel"))
    ext = F.when(F.contains("rel", F.lit(".")), F.lower(F.substring_index("rel", ".", -1))).otherwise(F.lit(""))
    return p.select("page_id", ext.alias("ext"), F.when(F.contains("rel", F.lit("/")), F.split_part("rel", F.lit("/"), F.lit(1))).otherwise(F.lit("root")).alias("first"))


def json_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a JSON row's key: only strings count; numbers, arrays and bad JSON give null."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    v = e.withColumn("v", F.try_parse_json("props"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.k", "variant"))
    return v.select("event_id", F.when(kind == "STRING", F.try_variant_get("v", "$.k", "string")).alias("text"), F.try_variant_get("v", "$.k", "bigint").alias("number"))


def json_pretty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole object, indented by two, keys in order: no built-in prints it so."""
    return table(spark, sf_dir, "events").select("event_id", pretty_json(F.col("props")).alias("text"))


def pii_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "label")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.explode(A.spans(F.col("text"), list(A.RULES))).alias("s")).select("s.*")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def pii_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded surrogates; the same value gets the same one everywhere."""
    out = A.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "random", seed=7)
    return out.select("doc_id", F.length("text").alias("n_chars"), F.size(F.regexp_extract_all("text", F.lit("(?:EMAIL|CARD|TELEPHONE|DATE)-[0-9a-f]{8}"), F.lit(0))).alias("surrogates"))


def html_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: words of the pages' text without scripts, styles, comments and tags."""
    t = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", long(F.size(F.array_remove(F.split(t, r"[ \t\n\r]+"), ""))).alias("words"))


_IT = "it AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter, epoch_us(ts) AS us, value / 100 AS loss FROM events)"
_W = "OVER (PARTITION BY user_id ORDER BY iter ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_KINDS = ("click", "view", "purchase", "signup", "login", "logout")
_B = "b AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents)"
_LR = {
    "fixed": "1.0::DOUBLE",
    "cosine": "(1 + cos(pi() * s / 100)) / 2",
    "warmup_constant": "CASE WHEN s < 10 THEN s / 10 ELSE 1 END",
    "warmup_linear": "CASE WHEN s < 10 THEN s / 10 ELSE greatest(0, 1 - (s - 10) / 90) END",
    "warmup_cosine": "CASE WHEN s < 10 THEN s / 10 ELSE greatest(0, (1 + cos(pi() * ((s - 10) / 90))) / 2) END",
    "warmup_cosine_restart": "CASE WHEN s < 10 THEN s / 10 WHEN (s - 10) / 90 >= 1 THEN 0 ELSE (1 + cos(pi() * ((s - 10) / 90))) / 2 END",
}
_KEY = "CASE " + " ".join(f"WHEN contains(lower(device), '{f}') AND ({' OR '.join(f'''contains(lower(device), '{p}')''' for p in ps)}) THEN '{k}'" for f, ps, k in L.DEVICE_ROUTES) + " END"
_NEW = r"CASE WHEN starts_with(param, 'model.model.') THEN regexp_replace(param, '^model\.model\.', 'model.') WHEN param = 'model.lm_head.weight' THEN 'lm_head.weight' ELSE param END"
_CK = f"c AS (SELECT param, {_NEW} AS new_key FROM {sql_rows('param', [(n,) for n in _CKPT])}), m AS (SELECT param FROM {sql_rows('param', [(n,) for n in _MODEL])})"
_LABELLED = "text"
for _label, _pattern in A.RULES:
    _LABELLED = f"regexp_replace({_LABELLED}, '{_pattern}', '[{_label}]', 'g')"

QUERIES = {f.__name__: f for f in (rolling_throughput, rolling_loss_ppl, running_totals, metric_merge_by_step, metric_table, validation_perplexity, batch_assignment, resume_slice, lr_schedule, validation_steps, step_plan, flops_lookup, defaults_overlay, ckpt_key_map, ckpt_coverage, ckpt_names, path_key_match, path_parts, json_text_extract, json_pretty_text, pii_label, pii_counts, pii_random, html_text_profile)}

ORACLES = {
    "rolling_throughput": f"WITH {_IT}, w AS (SELECT *, count(*) {_W.format(2)} AS n, iter * 8 - first_value(iter * 8) {_W.format(2)} AS ds, us / 1e6::DOUBLE - first_value(us / 1e6::DOUBLE) {_W.format(2)} AS dt FROM it) SELECT user_id, iter, round(ds / nullif(dt, 0), 9) AS samples_per_sec FROM w WHERE n = 3",
    "rolling_loss_ppl": f"WITH {_IT}, w AS (SELECT *, count(*) {_W.format(2)} AS n, avg(loss) {_W.format(2)} AS m FROM it) SELECT user_id, iter, round(m, 9) AS mean_loss, round(ln(exp(m)), 9) AS log_perplexity FROM w WHERE n = 3 AND iter % 2 = 0",
    "running_totals": f"WITH {_IT} SELECT user_id, iter, round(sum(loss) OVER (PARTITION BY user_id ORDER BY iter ROWS UNBOUNDED PRECEDING), 6) AS total, iter // 4 AS optimizer_step FROM it",
    "metric_table": "SELECT * FROM (PIVOT (SELECT epoch_us(ts) // 3600000000 AS step, event_id, event_type, value FROM events) ON event_type USING max_by(value, event_id) GROUP BY step)",
    "metric_merge_by_step": "SELECT epoch_us(ts) // 3600000000 AS step, " + ", ".join(f"max_by(value, event_id) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY 1",
    "validation_perplexity": "SELECT event_type, round(avg(value / 100), 9) AS val_loss, round(ln(exp(avg(value / 100))), 9) AS log_perplexity FROM events GROUP BY 1",
    "batch_assignment": f"WITH {_B} SELECT source, doc_id, batch, (batch + 1) // 4 AS step FROM b",
    "resume_slice": f"WITH {_B} SELECT source, count(*) AS rows, min(batch) AS first_batch FROM b WHERE batch >= 3 GROUP BY 1",
    "lr_schedule": " UNION ALL ".join(f"SELECT '{k}' AS kind, s AS step, round(({v}) * 3e-4::DOUBLE, 12)::DOUBLE AS lr FROM range(0, 101) r(s)" for k, v in _LR.items()),
    "validation_steps": f"SELECT steps::BIGINT AS steps, times::BIGINT AS times, array_to_string(list_sort(list_distinct(list_transform(range(1, times + 1), lambda i: greatest(1, floor(i::DOUBLE / times * steps)::BIGINT)))), ',') AS at FROM {sql_rows('steps times', _CASES)}",
    "step_plan": f"SELECT n::BIGINT AS n, (n // (batch * world))::BIGINT AS steps_per_epoch, ((n // (batch * world)) * epochs // accumulate)::BIGINT AS total_steps, floor(((n // (batch * world)) * epochs // accumulate) * warmup::DOUBLE)::BIGINT AS warmup_steps FROM {sql_rows('n batch world epochs accumulate warmup', _PLANS)}",
    "flops_lookup": f"SELECT device, p.precision, f.flops FROM (SELECT device, {_KEY} AS key FROM {sql_rows('device', [(x,) for x in _DEVICES])}) d CROSS JOIN (SELECT unnest(['32-true', 'bf16-true', '16-mixed']) AS precision) p LEFT JOIN (SELECT key, precision, flops::DOUBLE AS flops FROM {sql_rows('key precision flops', _FLOPS)}) f ON f.key = d.key AND f.precision = p.precision",
    "defaults_overlay": "SELECT * FROM (VALUES ('sharding_strategy', 'FULL_SHARD'), ('state_dict_type', 'full'), ('cpu_offload', 'true')) v(key, value)",
    "ckpt_key_map": f"WITH {_CK} SELECT c.param, new_key, CASE WHEN m.param IS NOT NULL THEN 'mapped' WHEN new_key = 'lm_head.weight' THEN 'tied' ELSE 'unmapped' END AS status FROM c LEFT JOIN m ON m.param = c.new_key",
    "ckpt_coverage": f"WITH {_CK} SELECT count(*) AS params, count(c.new_key) AS loaded, count(*) - count(c.new_key) AS missing, count(c.new_key) * 100 / count(*) AS coverage_pct, count(c.new_key) * 100 / count(*) >= 95 AS enough FROM m LEFT JOIN (SELECT DISTINCT new_key FROM c) c ON m.param = c.new_key",
    "ckpt_names": "SELECT item_id, format('e-{:03d}-gs-{:06d}.pth', item_id // 10, item_id * 100) AS name, replace(regexp_replace('a/b.' || format('e-{:03d}-gs-{:06d}.pth', item_id // 10, item_id * 100), '\\.[^./]*$', ''), '/', '_') AS folder FROM benchmark",
    "path_key_match": f"SELECT key, max_by(path, doc_id) AS path, count(*) AS paths FROM (SELECT doc_id, '/data/' || lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents) p JOIN {sql_rows('key', [(k,) for k in _KEYS])} ON contains(path, '/' || key || '/') GROUP BY 1",
    "path_parts": "SELECT page_id, CASE WHEN contains(rel, '.') THEN lower(string_split(rel, '.')[-1]) ELSE '' END AS ext, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE 'root' END AS first FROM (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), '/+$', '') AS rel FROM pages)",
    "json_text_extract": "SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS number FROM events",
    "pii_label": f"SELECT doc_id, md5({_LABELLED}) AS text_md5 FROM documents",
    "pii_counts": "SELECT label, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (" + " UNION ALL ".join(f"SELECT '{lab}' AS label, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for lab, p in A.RULES) + ") GROUP BY 1",
    "html_text_profile": r"SELECT page_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+'), lambda x: x <> ''))::BIGINT AS words FROM pages",
}
