"""Subword tokenizers from public model files, as back-ends that every worker loads by path.

A back-end is chosen by the file's suffix; :func:`register` adds others. The
padding id is the model's own, else that of its end, else one past the last id.
A worker holds one bounded batch of rows, and what the library makes of about
:data:`CHARS_AT_ONCE` characters of it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.shared import at_a_time, small_arrow_batches

#: Characters of texts that are encoded at a time, about: the library keeps some 50 bytes for each.
CHARS_AT_ONCE = 1 << 18


class Tokenizer(Protocol):
    """What a back-end offers. ``special`` has the ids that are never masked."""

    size: int
    pad: int
    end: int | None
    mask: int | None
    special: tuple[int, ...]

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[int]) -> str: ...

    def piece(self, i: int) -> str: ...


def _padding(size: int, *candidates: int | None) -> int:
    return next((c for c in candidates if c is not None and c >= 0), size)


class JsonTokenizer:
    """A model of the tokenizers library. Strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.lib = Library.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.lib.encode_special_tokens = True
        self.size = self.lib.get_vocab_size()
        first = lambda *names: next((i for i in map(self.lib.token_to_id, names) if i is not None), None)
        self.end = first("</s>", "<|endoftext|>", "[SEP]", "<eos>")
        self.mask = first("[MASK]", "<mask>")
        self.pad = _padding(self.size, first("<pad>", "[PAD]"), self.end)
        self.special = tuple(sorted(i for i, t in self.lib.get_added_tokens_decoder().items() if t.special))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]  # the ids of encode_batch, without their offsets

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids, skip_special_tokens=False)

    def piece(self, i: int) -> str:
        return self.lib.id_to_token(i) or ""


class PieceTokenizer:
    """A model of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        self.end = self.lib.eos_id() if self.lib.eos_id() >= 0 else None
        mask = self.lib.piece_to_id("<mask>")
        self.mask = mask if mask != self.lib.unk_id() else None
        self.pad = _padding(self.size, self.lib.pad_id(), self.end)
        self.special = tuple(i for i in range(min(self.size, 1000)) if self.lib.is_control(i) or self.lib.is_unknown(i))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.lib.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)

    def piece(self, i: int) -> str:
        return self.lib.id_to_piece(i)


BACKENDS: dict[str, Callable[[str], Tokenizer]] = {".json": JsonTokenizer, ".model": PieceTokenizer}


def register(suffix: str, backend: Callable[[str], Tokenizer]) -> None:
    """A back-end for files with a suffix; it must be importable on the workers."""
    BACKENDS[suffix] = backend


@lru_cache(maxsize=4)
def tokenizer(path: str, backend: Callable[[str], Tokenizer] | None = None) -> Tokenizer:
    """The tokenizer of a model file, loaded once a process; raises for a suffix without a back-end."""
    suffix = os.path.splitext(path)[1]
    if backend is None and suffix not in BACKENDS:
        raise ValueError(f"no tokenizer for {suffix or path}; known are {', '.join(BACKENDS)}")
    return (backend or BACKENDS[suffix])(path)


def encode(docs: DataFrame, text: str, path: str, name: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the ids of ``text`` (null: none), without the text itself unless ``keep_text``; the model file must lie at ``path`` on every worker."""
    small_arrow_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != name and (keep_text or f.name != text)]
    kept = [f.name for f in fields]
    backend = BACKENDS.get(os.path.splitext(path)[1])
    tokenizer(path, backend)  # tells a missing file here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        use = tokenizer(path, backend)
        for batch in batches:
            ids = [np.array(x, np.int32) for texts in at_a_time([t or "" for t in batch.column(text).to_pylist()], CHARS_AT_ONCE) for x in use.encode(texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(ids, pa.list_(pa.int32()))], names=[*kept, name])

    return docs.drop(name).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row (null: none), one row's numbers at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True))


def decode(rows: DataFrame, ids: str, path: str, name: str = "decoded", pieces: str | None = None) -> DataFrame:
    """``rows`` with the text of all ``ids`` and, under ``pieces``, the piece of each."""
    backend = BACKENDS.get(os.path.splitext(path)[1])
    small_arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = tokenizer(path, backend)
        for batch in batches:
            made = [pa.array([use.decode(x) for x in _lists(batch.column(ids))], pa.string())]
            if pieces:
                made.append(pa.array([[use.piece(i) for i in x] for x in _lists(batch.column(ids))], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, name, *[pieces] * bool(pieces)])

    fields = [T.StructField(name, T.StringType()), *(T.StructField(c, T.ArrayType(T.StringType())) for c in [pieces] if c)]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def partitions_for(cores: int, wanted: int | None, batched: bool) -> int | None:
    """Partitions for encoding: none asked for where the library takes batches itself, else the number wanted up to the cores, else half of them."""
    if batched:
        return None
    return min(wanted, cores) if wanted else max(1, cores // 2)


def labelled(df: DataFrame, ids: str, mask: str, labels: str) -> DataFrame:
    """A row for each token: place, id, and whether it is attended and trained on, for all tokens of a sample."""
    zipped = F.expr(f"transform({ids}, (t, i) -> named_struct('place', i, 'token_id', t, 'attended', coalesce(get({mask}, i), 1) = 1, 'trained', coalesce(get({labels}, i), t) <> -100))")
    kept = [c for c in df.columns if c not in (ids, mask, labels)]
    return df.select(*kept, F.inline(zipped))
