"""The tasks of a configuration, from source to saved dataset."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import sequence_length
from corpusloom.operators import anonymise, checkpoints, conversations, sampling, subword, telemetry, tokenise
from corpusloom.sources import files


def _seed(value: int | None) -> int:
    """A seed as given, or one drawn and told, so that the run can be repeated."""
    if value is None:
        value = random.randrange(2**31)
        print(f"seed drawn: {value}")
    return value


def _encoded(rows: DataFrame, text: str, t: dict, name: str = "ids", vocab: DataFrame | None = None) -> DataFrame:
    """Ids by the subword model at ``tokenizer_path``, or else by the words of ``vocab``."""
    if t.get("tokenizer_path"):
        return subword.encode(rows, text, t["tokenizer_path"], name)
    return tokenise.encode(rows, text, vocab).withColumnRenamed("ids", name)


def _specials(t: dict) -> dict:
    """pad, end, mask, special and size of the model in use."""
    if t.get("tokenizer_path"):
        m = subword.tokenizer(t["tokenizer_path"])
        return {"pad": m.pad, "end": m.pad if m.end is None else m.end, "mask": m.mask, "special": m.special, "size": m.size}
    return {"pad": tokenise.PAD, "end": tokenise.EOS, "mask": tokenise.MASK, "special": tuple(tokenise.SPECIAL), "size": (t.get("vocab_size") or 32000) + len(tokenise.SPECIAL)}


def tokenization(spark: SparkSession, config: dict) -> DataFrame:
    """Reads texts, splits, encodes and writes fixed rows for causal, masked or instruction training."""
    t, d = config["tokenizer"], config["dataset"]
    if d["source"] != "local":
        raise NotImplementedError("only local sources can be read here")
    if t["task"] == "instruction":
        return instruction(spark, config)
    own = d.get("file_config") or {}
    rows = files.load(spark, d["nameOrPath"]) if d.get("format") == "dataset" else files.read_directory(spark, d["nameOrPath"], own.get("format"), own.get("text_key"), own.get("text_column"))
    has_split = d.get("format") == "dataset" and rows.select("split").distinct().limit(2).count() > 1
    rows = rows.select(F.sha2(F.concat_ws("\n", "path", "text") if "path" in rows.columns else F.col("text"), 256).alias("row_id"), "text", *["split"] * has_split)
    seed, length, model = _seed(config.get("seed")), sequence_length(t), _specials(t)
    if not has_split:
        rows = sampling.train_valid_split(rows, "row_id", config.get("test_size") or 0, seed)
    vocab = None if t.get("tokenizer_path") else tokenise.vocabulary(rows, "text", t.get("vocab_size") or 32000)
    encoded = _encoded(rows, "text", t, vocab=vocab).drop("text")
    if t["task"] == "clm_training":
        out = tokenise.causal_chunks(encoded, length, t["overlap"], model["pad"])
    else:
        if model["mask"] is None:
            raise ValueError("the tokenizer has no mask token; masked training needs one")
        shares = t.get("masking_strategy") if isinstance(t.get("masking_strategy"), dict) else {}
        out = tokenise.mlm(encoded, "row_id", length, model["size"], seed, probability=t.get("mlm_probability") or 0.15, mask_id=model["mask"], pad=model["pad"], special=model["special"], shares=(shares.get("mask", 0.8), shares.get("random", 0.1), shares.get("unchanged", 0.1)))
    files.save(out, config["output"]["path"], shard_bytes=config["output"].get("max_shard_bytes"))
    return out


def instruction(spark: SparkSession, config: dict) -> DataFrame:
    """Instruction rows from files: repaired, rendered, encoded, masked, padded to one length, split by key, and written."""
    t, d = config["tokenizer"], config["dataset"]
    rows = files.read_instructions(spark, d["nameOrPath"], d.get("format") or "files", d.get("specific_keys"), d.get("languages"))
    files.required_columns(rows, ["system", "input", "assistance", "target"])
    tags = [c for c in ("key", "file", "language", "split") if c in rows.columns]
    pairs = conversations.prompt_pairs(rows, t.get("date_string")).select(*tags, F.sha2(F.concat_ws("\n", *tags, "prompt_and_response"), 256).alias("row_id"), "prompt", "prompt_and_response")
    length, model = sequence_length(t), _specials(t)
    vocab = None if t.get("tokenizer_path") else tokenise.vocabulary(pairs, "prompt_and_response", t.get("vocab_size") or 32000)
    both = _encoded(_encoded(pairs, "prompt", t, "_asked", vocab), "prompt_and_response", t, "_full", vocab).drop("prompt", "prompt_and_response")
    out = tokenise.instruction_rows(both, "_asked", "_full", length, t.get("masking_strategy") or "context_aware", t.get("mask_prompt", True), model["pad"], model["end"])
    if t.get("padding_strategy") == "dynamic":
        out = tokenise.shortened_rows(out, length, t.get("dynamic_padding_percentile"))
    if "split" not in tags:
        size = config.get("test_size")
        by = ("key",) if "key" in tags else ()
        out = sampling.train_valid_split(out.withColumnRenamed("n", "_n"), "row_id", 0.3 if size is None else size, 1234 if config.get("seed") is None else config["seed"], by).withColumnRenamed("_n", "n")
    files.save(out, config["output"]["path"], shard_bytes=config["output"].get("max_shard_bytes"))
    return out


def dataset_merge(spark: SparkSession, config: dict) -> DataFrame:
    """Samples datasets by percentage, each with its own seed, and writes them as one in a seeded order."""
    sets = [files.load(spark, d["path"]) for d in config["datasets"]]
    seed = _seed(config.get("shuffle_seed"))
    keyed = [d.withColumn("row_id", F.sha2(F.to_json(F.struct(*d.columns)), 256)) for d in sets]
    out = sampling.merge(keyed, "row_id", [d["percentage"] for d in config["datasets"]], seed)
    final = config.get("final_shuffle_seed")
    final = seed + 999 if final is None else final
    out = sampling.shuffled_splits(out, "row_id", final) if "split" in out.columns else sampling.shuffled(out, "row_id", final, exact_order=False)
    files.save(out, config["output_path"])
    return out


def anonymization(spark: SparkSession, config: dict) -> DataFrame:
    """Reads texts, replaces what the rules find and writes rows with their path, in the format asked for.

    ``skip_existing`` leaves files out whose path the output (Parquet or jsonl) already has.
    """
    rows = files.read_directory(spark, config["source"])
    rules = anonymise.rules_from_csv(spark, config["regexes"]) if config.get("regexes") else anonymise.RULES
    form = config.get("format")
    if config.get("skip_existing"):
        if form in ("plain", "doccano"):
            raise ValueError(f"skip_existing needs paths in the output, which {form} doesn't keep")
        done = _existing(spark, config["output"], form)
        rows = rows if done is None else rows.join(done, "path", "left_anti")
    out = anonymise.anonymise(rows, "text", config.get("method") or "label", config.get("labels"), rules, store_original=bool(config.get("store_original")))
    if form == "doccano":
        out = rows.withColumn("spans", anonymise.located(F.col("text"), anonymise.chosen(rules, config.get("labels"))))
    written = out.coalesce(1) if config.get("aggregate_output") else out
    if form:
        anonymise.write(written, config["output"], form)
    elif config.get("skip_existing"):
        written.write.mode("append").parquet(config["output"])
    else:
        files.save(written, config["output"])
    return out


def _existing(spark: SparkSession, path: str, form: str | None) -> DataFrame | None:
    """The paths that an output has, or None if there is no output yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    found = spark.read.json(path) if form == "jsonl" else spark.read.parquet(path)
    return found.select("path").distinct() if "path" in found.columns else None


def convert(spark: SparkSession, config: dict) -> DataFrame:
    """Finds checkpoints, reads their parameter names, maps them to the model's and writes what came of each, with a summary.

    Tensors themselves are not converted.
    """
    found = checkpoints.discover(spark, config["source"])
    model = spark.read.text(config["model_parameters"]).select(F.trim("value").alias("param")).filter("param <> ''")
    out = checkpoints.converted(checkpoints.parameters(spark, config["source"]), model, config["source"])
    out.write.mode("errorifexists").parquet(f"{config['output'].rstrip('/')}/checkpoints")
    done = spark.read.parquet(f"{config['output'].rstrip('/')}/checkpoints")
    total = checkpoints.conversion_summary(done.withColumn("all", F.lit("all")), "all", "ok").first().asDict()
    files.write_summary(spark, f"{config['output'].rstrip('/')}/summary.json", {"source": config["source"], "found": found.count(), **{k: total[k] for k in ("total", "ok", "failed", "ok_pct")}})
    return done


def training(spark: SparkSession, config: dict) -> DataFrame:
    """Plans a training without running it: checks the saved set, counts its steps, and gives the learning rate of each; written if there is an output."""
    data = files.load_training(spark, config["dataset"]["nameOrPath"])
    sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    if not sizes.get("train"):
        raise ValueError("the set has no train split")
    ratio = config.get("train_ratio")
    n = sizes["train"] if ratio is None else int(sizes["train"] * ratio)
    if not n:
        raise ValueError(f"a train_ratio of {ratio} leaves no rows")
    accumulate = max(1, config.get("gradient_accumulation_steps") or 1)
    plan = telemetry.step_plan(n, config["batch_size"], config.get("world_size") or 1, config["number_epochs"], accumulate, config.get("warmup_ratio") or 0.0)
    rates = telemetry.schedule(spark, config.get("lr_scheduler") or "fixed", plan["total_steps"], plan["warmup_steps"], config["lr"])
    times = config.get("validations_per_epoch") or 0
    validated = telemetry.validation_steps(plan["steps_per_epoch"], times) if times else []
    if config.get("output"):
        base = config["output"].rstrip("/")
        rates.write.mode("errorifexists").parquet(f"{base}/schedule")
        names = list(sizes)
        files.write_summary(spark, f"{base}/summary.json", {"model": config["model_name"], "rows": sizes, "train_rows": n, **plan, "validation_steps": validated, "validation_split": files.validation_split(names), "strategy": config.get("parallelization_strategy") or "fsdp"})
    return rates


RUN = {"tokenization": tokenization, "dataset_merge": dataset_merge, "anonymization": anonymization, "convert": convert, **dict.fromkeys(("training", "clm_training", "mlm_training", "instruction"), training)}
