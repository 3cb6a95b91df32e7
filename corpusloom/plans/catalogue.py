"""All named queries of the reference's operators."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with ``QUERIES`` and ``ORACLES``.
MODULES: tuple[str, ...] = ("profile", "tokens", "samples", "dialogues", "runs", "training", "report", "subwords", "languages", "streams")


#: Queries over rows written in code: they read no table, so they aren't registered; tests hold them against their SQL.
CASES = frozenset(
    "lr_schedule validation_steps step_plan flops_lookup defaults_overlay ckpt_key_map ckpt_coverage epoch_progress layer_class_lookup tpu_flops quality_cases problem_cases json_text_cases "
    "report_grades validation_cases validation_verdicts folded_cases".split()
)


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"corpusloom.plans.{m}"), what).items()}


def queries() -> dict:
    return {k: f for k, f in _all("QUERIES").items() if k not in CASES}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, sql in _all("ORACLES").items() if k not in CASES}


def cases() -> dict:
    """Query and SQL of each of :data:`CASES`."""
    made, sql = _all("QUERIES"), _all("ORACLES")
    return {k: (made[k], sql[k]) for k in sorted(CASES)}
