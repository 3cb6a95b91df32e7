"""Functions over token arrays: windows, padding, labels, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.seeded import uniform_sql

IGNORE = -100


def window_starts(ids: str, length: int, overlap: int) -> Column:
    """Starts of the windows of ``length`` with ``overlap``: one for an array that fits, an empty one too."""
    if not 0 <= overlap < length:
        raise ValueError(f"overlap must be at least 0 and less than the window of {length}, not {overlap}")
    step = length - overlap
    return F.expr(f"sequence(0, CASE WHEN size({ids}) <= {length} THEN 0 ELSE cast(ceil((size({ids}) - {length}) / {step}) AS int) * {step} END, {step})")


def padded(ids: str, length: str, value: int) -> Column:
    return F.expr(f"concat({ids}, array_repeat({value}, greatest(0, cast({length} AS int) - size({ids}))))")


def attention(ids: str, length: str) -> Column:
    return F.expr(f"concat(array_repeat(1, size({ids})), array_repeat(0, greatest(0, cast({length} AS int) - size({ids}))))")


def causal_labels(ids: str, mask: str, ignore: int = IGNORE) -> Column:
    return F.expr(f"zip_with({ids}, {mask}, (i, m) -> CASE WHEN m = 1 THEN i ELSE {ignore} END)")


def mlm_choices(ids: str, mask: str, key: str, seed: int, special: list[int], probability: float = 0.15, excluded: tuple[int, ...] = (), mask_special: bool = False) -> Column:
    """True where a token is chosen for masking: by a uniform below ``probability``, among attended tokens that may be."""
    never = [*excluded, *([] if mask_special else special)]
    may = " AND ".join([f"NOT array_contains(array({', '.join(map(str, never))}), t)"] if never else ["true"])
    u = uniform_sql(f"concat('{seed}-select-', {key}, '-', i)")
    return F.expr(f"transform({ids}, (t, i) -> {mask}[i] = 1 AND {may} AND {u} < {probability}D)")


def mlm_replaced(ids: str, chosen: str, key: str, seed: int, mask_id: int, vocab_size: int, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> Column:
    """Ids after masking: of the chosen ones a share becomes the mask, a share any token, the rest stays."""
    total = sum(shares)
    masked, random = (shares[0] / total, shares[1] / total) if abs(total - 1) > 1e-6 else shares[:2]
    u = uniform_sql(f"concat('{seed}-kind-', {key}, '-', i)")
    v = uniform_sql(f"concat('{seed}-token-', {key}, '-', i)")
    return F.expr(
        f"transform({ids}, (t, i) -> CASE WHEN NOT {chosen}[i] THEN t WHEN {u} < {masked}D THEN {mask_id} WHEN {u} < {masked + random}D THEN cast(floor({v} * {vocab_size}) AS int) ELSE t END)"
    )


def instruction_labels(ids: str, prompt_size: str, ignore: int = IGNORE) -> Column:
    return F.expr(f"transform({ids}, (t, i) -> CASE WHEN i < {prompt_size} THEN {ignore} ELSE t END)")
