"""SentencePiece encoding with offsets, and decoding.

The model file holds a compiled character map: a double-array trie whose longest
matching prefix at each position is replaced. :class:`Normaliser` walks it and
notes, for every byte of the normalised text, which byte of the source it came
from; the pieces, laid end to end over the normalised text, are so projected to
byte spans of the original. Ids are those of the sentencepiece library.

Decoding hands all ids of a text to the library's decode(ids); nothing of the
source text is used for it.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded one by one; very long texts are held one at a time; extra columns are
passed through by :func:`encode`, and columns named like its outputs give way.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import small_arrow_batches, table

BLANK = "▁"
#: Characters of texts that are encoded at a time, about; a longer text is taken alone, and whole.
CHARS_AT_ONCE = 1 << 20


def default_model() -> str:
    """The public 32k model that every worker has as a package file; its path is a parameter everywhere."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and a block of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at ``at`` and their replacement, or None."""
        units = self.units
        if not units:
            return None
        node, best = units[0], None
        pos = (node >> 10) << ((node & 0x200) >> 6)
        for k in range(at, len(data)):
            pos ^= data[k]
            if pos >= len(units):
                break
            node = units[pos]
            if node & 0x800000FF != data[k]:
                break
            pos ^= (node >> 10) << ((node & 0x200) >> 6)
            if (node >> 8) & 1:
                value = units[pos] & 0x7FFFFFFF
                best = (k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return best


class Normaliser:
    """Normalises a text as the model's specification says, with the source offset of every byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def identity(self) -> bool:
        """Whether only blanks change, so that offsets follow from character widths."""
        return not self.map.units and not self.squeeze and self.escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text in UTF-8, and the source offset where each of its bytes begins, with the end appended."""
        data = text.encode()
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                width = _width(data[at])
                parts.append((data[at : at + width], at, at + width))
            else:
                width = found[0]
                parts.append((found[1], at, at + width))
            at += width
        if self.squeeze:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
            while parts and parts[-1][0] in (b" ", b""):
                parts.pop()
        out, source, blank = bytearray(), [], False
        mark = BLANK.encode() if self.escape else b" "
        end = parts[-1][2] if parts else len(data)
        if self.dummy_prefix and parts:
            out += mark
            source += [parts[0][1]] * len(mark)
        for got, begin, _ in parts:
            for c in got.decode():
                if c == " ":
                    if self.squeeze and blank:
                        continue
                    piece = mark
                else:
                    piece = c.encode()
                blank = c == " "
                out += piece
                source += [begin] * len(piece)
        return bytes(out), np.array([*source, end], dtype=np.int64)


def _width(byte: int) -> int:
    return 1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Codec:
    """Encodes with offsets and decodes; one for each worker and model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(proto.normalizer_spec)
        kinds = proto.SentencePiece
        self.widths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        spec = proto.trainer_spec
        #: Whether each piece stands for its own bytes of the source, but for the blank put before the text.
        self.literal = self.normaliser.identity and self.normaliser.dummy_prefix and spec.byte_fallback and not spec.treat_whitespace_as_suffix
        self.decimal = [str(i) for i in range(len(proto.pieces))]
        #: Bytes of the source below each piece, where no blank mark stands in the source itself.
        self.source_widths = np.array([1 if p.type == kinds.BYTE else len(p.piece.replace(BLANK, " ").encode()) for p in proto.pieces], dtype=np.int64)
        self.inner_byte = self.byte & np.array([p.type == kinds.BYTE and int(p.piece[1:-1], 16) >= 0x80 for p in proto.pieces])

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.array(ids, dtype="<i4") for ids in self.lib.encode(texts, num_threads=1)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def joined(self, ids: np.ndarray) -> str:
        """Ids in decimal, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each id's piece in the UTF-8 bytes of ``text``.

        The pieces of a character's bytes all have the span of the character;
        the blank put before the text has an empty span.
        """
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.literal and BLANK not in text and not self.inner_byte[ids].any():
            ends = np.cumsum(self.source_widths[ids])
            return np.maximum(ends - self.source_widths[ids] - 1, 0), ends - 1
        if self.normaliser.identity:
            source = self._identity_source(text)
        else:
            source = self.normaliser(text)[1]
        ends = np.cumsum(self.widths[ids])
        if ends[-1] != len(source) - 1:
            ends = np.cumsum(self._unknown_widths(text, ids))
        begins = ends - np.diff(ends, prepend=0)
        begin, end = source[begins], source[ends]
        if self.byte[ids].any():
            inside = end == begin  # bytes of a character before its last one
            nexts = np.append(source, source[-1])[np.searchsorted(source, begin, side="right")]
            end = np.where(inside & self.byte[ids], nexts, end)
        return begin, end

    def _identity_source(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        own = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        starts = np.cumsum(own) - own
        wide = np.where(codes == 0x20, 3, own)
        return np.concatenate([np.zeros(3 * self.normaliser.dummy_prefix, np.int64), np.repeat(starts, wide), [int(own.sum())]])

    def _unknown_widths(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Widths of the pieces as the library reports them, for unknown pieces without bytes of their own."""
        pieces = [self.lib.id_to_piece(i) for i in ids.tolist()]
        return np.array([1 if b else len(p.encode()) for p, b in zip(pieces, self.byte[ids], strict=True)], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids), over all of them."""
        return self.lib.decode(ids.tolist())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _at_a_time(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about :data:`CHARS_AT_ONCE` characters."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHARS_AT_ONCE:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


SCHEMA = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, text: str = "text", model: str | None = None, outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """``docs`` with ids, begins and ends (spans in the UTF-8 bytes of the text) and the decoded text, or some of these."""
    path = model or default_model()
    small_arrow_batches(docs.sparkSession)
    docs = docs.drop(*[f.name for f in SCHEMA if f.name != text])
    ints, spans = pa.list_(pa.int32()), "begins" in outputs or "ends" in outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            ids, begins, ends, decoded = [], [], [], []
            for texts in _at_a_time([t or "" for t in batch.column(text).to_pylist()]):
                for t, got in zip(texts, use.encode_many(texts), strict=True):
                    if spans:
                        begin, end = use.spans(t, got)
                        begins.append(begin.astype(np.int32))
                        ends.append(end.astype(np.int32))
                    ids.append(got.astype(np.int32))
                    if "decoded" in outputs:
                        decoded.append(use.decode(got))
            made = {"ids": (ids, ints), "begins": (begins, ints), "ends": (ends, ints), "decoded": (decoded, pa.string())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(*made[c]) for c in outputs]], names=[*batch.schema.names, *outputs])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[SCHEMA[c] for c in outputs]]))


def digests(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` without its text, with the digests of what :class:`Codec` gives; ids and decoded texts stay in the workers.

    n_bytes is where the last span ends: the bytes of the source that pieces cover.
    """
    path = model or default_model()
    small_arrow_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes")]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, sha = codec(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            n, digest, decoded, covered = [], [], [], []
            for texts in _at_a_time([t or "" for t in batch.column(text).to_pylist()]):
                for t, ids in zip(texts, use.encode_many(texts), strict=True):
                    ends = use.spans(t, ids)[1]
                    n.append(len(ids))
                    digest.append(sha(use.joined(ids)))
                    decoded.append(sha(use.decode(ids)))
                    covered.append(int(ends[-1]) if len(ends) else 0)
            arrays = [*[batch.column(c) for c in names], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[f.name for f in fields]])

    schema = T.StructType([*[docs.schema[c] for c in names], *fields])
    return docs.select(*names, F.col(f"`{text}`")).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
