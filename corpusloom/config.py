"""Task configurations: read, completed and checked on the driver; all faults are told at once."""

from __future__ import annotations

import json
from pathlib import Path

#: For each task its sections, and for each key the kinds, bounds or values it may have; ``!`` marks required ones.
RULES: dict[str, dict[str, dict[str, object]]] = {
    "tokenization": {
        "tokenizer": {"task!": ("clm_training", "instruction", "mlm_training"), "tokenizer_path": str, "date_string": str, "max_sequence_length": (1, None), "context_length": (1, None), "overlap": (0, None), "ignore_index": int, "mlm_probability": (0.0, 1.0), "masking_strategy": object, "padding_strategy": ("fixed", "dynamic"), "dynamic_padding_percentile": (0.0, 100.0), "mask_prompt": bool},
        "dataset": {"source!": ("local", "huggingface"), "nameOrPath!": str, "format": ("dataset", "files", "multilanguage_files"), "file_config": dict, "specific_keys": list, "languages": list},
        "output": {"path!": str, "max_shard_bytes": (1, None)},
    },
    "dataset_merge": {"datasets!": {"path!": str, "percentage!": (0.01, 10.0), "name": str}, "": {"output_path!": str, "shuffle_seed": int, "final_shuffle_seed": int}},
    "anonymization": {"": {"source!": str, "output!": str, "method": ("label", "random", "intelligent", "none"), "format": ("plain", "jsonl", "doccano"), "labels": list, "store_original": bool, "aggregate_output": bool, "skip_existing": bool, "regexes": str}},
    "convert": {"": {"source!": str, "output!": str, "model_parameters!": str}},
    "training": {
        "": {"model_name!": str, "number_epochs!": (1, None), "batch_size!": (1, None), "lr!": (0.0, None), "gradient_accumulation_steps": (1, None), "warmup_ratio": (0.0, 1.0), "lr_scheduler": ("fixed", "cosine", "warmup_constant", "warmup_linear", "warmup_cosine", "warmup_cosine_restart"), "validations_per_epoch": (0, None), "train_ratio": (0.0, 1.0), "precision": str, "seed": int, "world_size": (1, None), "output": str, "parallelization_strategy": ("fsdp", "ddp", "deep_speed", "dp"), "optimizer": ("adam", "adamw", "sgd", "adamax", "adagrad", "adadelta", "rmsprop")},
        "dataset": {"nameOrPath!": str},
    },
}
#: What the kinds of a task add to its rules.
NESTED: dict[str, dict[str, dict[str, object]]] = {
    "tokenization.clm_training": {"tokenizer": {"overlap!": (0, None)}},
    "tokenization.mlm_training": {"tokenizer": {"mlm_probability": (0.0, 1.0)}},
    "tokenization.instruction": {"tokenizer": {"masking_strategy": str}},
}
#: Training tasks have the rules of training.
TRAINING = ("clm_training", "mlm_training", "instruction")


def rules_for(config: dict) -> dict[str, dict[str, object]]:
    """The rules of a configuration: those of its task with those of the task's kind, or the task's alone; raises if there are none."""
    task = "training" if config.get("task") in TRAINING else config.get("task")
    if task not in RULES:
        raise LookupError(f"no rules for task {config.get('task')!r}; there are rules for {', '.join([*RULES, *NESTED])}")
    kind = config.get("tokenizer", {}).get("task") if isinstance(config.get("tokenizer"), dict) else None
    out = {section: dict(rules) for section, rules in RULES[task].items()}
    for section, more in NESTED.get(f"{task}.{kind}", {}).items():
        out[section] = {k: r for k, r in out[section].items() if k.rstrip("!") not in {m.rstrip("!") for m in more}} | more
    return out


def read_rules(folder: str) -> dict[str, dict]:
    """Rules of one's own from ``*.schema.json`` and ``*.schema.yaml`` below a folder, by full path, by path below it and by name."""
    out: dict[str, dict] = {}
    for path in sorted(p for p in Path(folder).rglob("*.schema.*") if p.suffix in (".json", ".yaml")):
        rules = read(str(path))
        for key in (f"file://{path.resolve()}", str(path.relative_to(folder)), path.name.split(".schema.")[0]):
            out[key] = rules
    return out


def training_settings(*paths: str) -> dict:
    """Settings of several files, each of which may be missing; later ones win."""
    out: dict = {}
    for path in paths:
        if Path(path).exists():
            out |= read(path) or {}
    return out


def read(path: str) -> dict:
    """A configuration from JSON, or from YAML where a reader for it is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def faults(config: dict) -> list[str]:
    """All that is wrong with a configuration, each as ``[path] message``."""
    task = config.get("task")
    if task not in RULES and task not in TRAINING:
        return [f"[task] must be one of {', '.join(RULES)}, not {task!r}"]
    out: list[str] = []
    for section, rules in rules_for(config).items():
        name = section.rstrip("!")
        value = config.get(name) if name else config
        if name and value is None:
            out += [f"[{name}] is missing"]
            continue
        for k, part in enumerate(value) if isinstance(value, list) else [("", value)]:
            at = f"{name}/{k}".strip("/") if isinstance(value, list) else name
            out += _section(at, part, rules)
    if task == "dataset_merge" and len(config.get("datasets") or ()) < 2:
        out.append("[datasets] needs at least two")
    if task == "tokenization" and not out:
        t = config["tokenizer"]
        length = sequence_length(t)
        if length is None:
            out.append("[tokenizer] needs max_sequence_length or context_length")
        elif t["task"] == "clm_training" and t.get("overlap") is None:
            out.append("[tokenizer/overlap] is missing")
        elif (t.get("overlap") or 0) >= length:
            out.append("[tokenizer/overlap] must be less than the sequence length")
    return out


def _section(at: str, value: object, rules: dict[str, object]) -> list[str]:
    if not isinstance(value, dict):
        return [f"[{at}] must be an object"]
    out = []
    for key, rule in rules.items():
        name = key.rstrip("!")
        got, where = value.get(name), f"[{at}/{name}]".replace("[/", "[")
        if got is None:
            out += [f"{where} is missing"] * key.endswith("!")
        elif isinstance(rule, tuple) and all(isinstance(x, str) for x in rule):
            out += [f"{where} must be one of {', '.join(rule)}"] * (got not in rule)
        elif isinstance(rule, tuple):
            low, high = rule
            good = isinstance(got, (int, float)) and not isinstance(got, bool) and got >= low and (high is None or got <= high)
            out += [f"{where} must be a number from {low}" + (f" to {high}" if high is not None else "")] * (not good)
        elif not isinstance(got, rule):
            out.append(f"{where} must be of type {rule.__name__}")
    return out


def sequence_length(tokenizer: dict) -> int | None:
    own = tokenizer.get("max_sequence_length")
    return own if own is not None else tokenizer.get("context_length")
