"""64-bit hashes of the words of many texts at once, without an object for each word.

Words are what the ASCII blanks leave, with A-Z lower-cased or as they are. A word's hash is a
polynomial in its bytes, each replaced by a fixed 64-bit number, taken from a
prefix array of its block, and then mixed with its length. Texts are taken apart
a run at a time, so that arrays stay in proportion to a run or to its one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of texts in a run, about, and bytes that are hashed at a time.
RUN_BYTES = 1 << 20
BASE = U(0x5851F42D4C957F2D)
MIX_A, MIX_B = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * MIX_A
    h = (h ^ (h >> U(33))) * MIX_B
    return h ^ (h >> U(33))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were ever asked for."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            k = len(cls.up)
            step, back = pow(int(BASE), k, 1 << 64), pow(int(BASE), -k, 1 << 64)
            cls.up, cls.down = np.concatenate([cls.up, cls.up * U(step)]), np.concatenate([cls.down, cls.down * U(back)])
        return cls.up[:n], cls.down[:n]


@dataclass
class Run:
    """The words of some texts, one text after the other; ``data`` from begin to end is a word's bytes."""

    first: int
    data: bytes
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.begins[k] : self.ends[k]]


def runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[Run]:
    """The texts (nulls: empty) in runs of about ``most`` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bodies = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    held, first, size = [], 0, 0
    for k, body in enumerate(bodies):
        body = body.as_py() or b""
        if held and size + len(body) > most:
            yield hashed(held, first)
            held, first, size = [], k, 0
        held.append(body)
        size += len(body) + 1
    if held:
        yield hashed(held, first)


def hashed(bodies: list[bytes], first: int = 0, lower: bool = True) -> Run:
    data = b"\n".join([*bodies, b""])
    data = data.lower() if lower else data
    codes = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff((codes != 32) & (codes - np.uint8(9) > 4), prepend=False))  # a text ends with a line break here
    begins, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(begins), dtype=np.uint64)
    k = 0
    while k < len(begins):
        low = int(begins[k])
        upto = max(int(np.searchsorted(ends, low + RUN_BYTES, side="right")), k + 1)
        up, down = _Powers.of(int(ends[upto - 1]) - low)
        sums = np.zeros(len(up) + 1, dtype=np.uint64)
        np.cumsum(BYTES[codes[low : int(ends[upto - 1])]] * up, out=sums[1:])
        a, b = begins[k:upto] - low, ends[k:upto] - low
        hashes[k:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        k = upto
    offsets = np.cumsum([0, *[len(x) + 1 for x in bodies]])
    return Run(first, data, hashes, begins, ends, np.diff(np.searchsorted(begins, offsets)))


def word_hash(word: bytes) -> int:
    """The hash of one word, as :func:`runs` gives it."""
    return int(hashed([word]).hashes[0])


def sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h
