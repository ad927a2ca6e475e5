"""Byte-level BPE encoding and decoding through a sentencepiece model that is serialised straight from a rank vocabulary.

Every token becomes a piece: its bytes, each mapped to one character, scored by its negative rank, under an identity
normaliser. Merging the best-scored pair first (ties: the leftmost) is then merging the lowest rank first. A text is cut
into pre-tokens by the vocabulary's pattern; a pre-token that is a token itself is that token, the others are encoded by
the model. Decoding maps ids to pieces and their characters back to bytes.

Each task encodes a distinct pre-token once and remembers it until ``REMEMBERED`` characters are held, so that work and
memory stay level for any text. There is no shuffle; the model is sent to the tasks, its size is checked.

Defined results: null and empty texts have no ids; null ids decode to null, no ids to no bytes; ids outside the vocabulary
and null ids inside an array decode to no bytes; equal rows get equal answers; other columns pass through, one with the
name of the result is replaced by it; an empty table stays empty.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
VOCABULARY_LIMIT = 32 << 20
#: Characters of pre-tokens a task remembers before it starts anew (a speed bound, never a bound on what is encoded).
REMEMBERED = 16 << 20
#: Bytes of texts or ids handed to numpy at a time; decoding needs a few numbers for each byte it gives.
TEXT_BYTES, ID_BYTES = 2 << 20, 512 << 10
#: Byte b is written as the character FIRST + b.
FIRST = 0x100
_TO_PIECE = {b: FIRST + b for b in range(256)}
_TO_BYTE = {FIRST + b: b for b in range(256)}
UNKNOWN = "<unk>"
# Fixed values of the sentencepiece model format: field numbers and enumeration values.
NORMAL, UNKNOWN_TYPE, BPE = 1, 2, 2


def load_ranks(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > VOCABULARY_LIMIT:
        raise ValueError("the vocabulary is too large to send to the tasks")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def to_piece(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_PIECE)


def to_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTE).encode("latin-1")


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The model, and the rank of each of its pieces; the last piece stands for unknown input and never occurs."""
    order = sorted(ranks.items(), key=lambda item: item[1])
    if order and order[-1][1] >= 1 << 24:
        raise ValueError("ranks from 2 ** 24 are not exact as scores")
    pieces = [_piece(to_piece(token), -float(rank), NORMAL) for token, rank in order] + [_piece(UNKNOWN, 0.0, UNKNOWN_TYPE)]
    trainer = _number(3, BPE) + _number(4, len(pieces)) + _number(40, len(order)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser), np.array([rank for _, rank in order], dtype=np.int32)


class Encoder:
    """Ids of texts in one task."""

    def __init__(self, model: bytes, ranks: np.ndarray, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks.tolist()
        self.cut = regex.compile(pattern).findall
        self.seen: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _learn(self, tokens: Iterable[str]) -> None:
        merge = []
        for token in tokens:
            piece = to_piece(token.encode())
            whole = self.model.piece_to_id(piece)
            if whole < len(self.ranks):
                self.seen[token] = (self.ranks[whole],)
            else:
                merge.append((token, piece))
            self.held += len(token) + 40
        if merge:
            ranks = self.ranks
            for (token, _), ids in zip(merge, self.model.encode([p for _, p in merge], out_type=int, num_threads=1), strict=True):
                self.seen[token] = tuple(ranks[i] for i in ids)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.held > REMEMBERED:
            self.seen.clear()
            self.held = 0
        tokens = self.cut(text)
        new = set(tokens).difference(self.seen)
        if new:
            self._learn(new)
        return np.fromiter(chain.from_iterable(map(self.seen.__getitem__, tokens)), np.int32)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), values], names=[*kept, name])


def encode(docs: DataFrame, text: str = "text", to: str = "ids", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All columns of ``docs`` and ``to``, the array of token ids of column ``text``."""
    model, ranks = serialise(load_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    sent = docs.sparkSession.sparkContext.broadcast((model, ranks))  # bounded by VOCABULARY_LIMIT
    schema = docs.drop(to).select("*", F.array(F.lit(0)).alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value, pattern)
        for batch in small_batches(batches, text, TEXT_BYTES):
            ids = [encoder.encode(t) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield _with_column(batch, to, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())))

    return docs.mapInArrow(run, schema)


class Decoder:
    """Bytes of ids in one task: all tokens stand in one array, an id is its place there."""

    def __init__(self, model: bytes, ranks: np.ndarray):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = [to_bytes(pieces.id_to_piece(i)) for i in range(len(ranks))]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        self.length = np.zeros(len(self.start), np.int64)
        self.length[ranks] = [len(t) for t in tokens]
        self.start[ranks] = np.cumsum(self.length[ranks]) - self.length[ranks]

    def decode(self, ids: np.ndarray, per_row: np.ndarray) -> list[bytes]:
        known = (ids >= 0) & (ids < len(self.length))
        at = np.where(known, ids, 0)
        n = np.where(known, self.length[at], 0) if len(self.length) else np.zeros(len(ids), np.int64)
        ends = np.cumsum(n)
        shift = self.start[at] - (ends - n) if len(n) else n
        data = self.bytes[np.arange(int(n.sum())) + np.repeat(shift, n)].tobytes()
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_row)])].tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def decode(tokens: DataFrame, ids: str = "ids", to: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """All columns of ``tokens`` and ``to``, the bytes that column ``ids`` stands for."""
    model, ranks = serialise(load_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))
    sent = tokens.sparkSession.sparkContext.broadcast((model, ranks))  # bounded by VOCABULARY_LIMIT
    schema = tokens.drop(to).select("*", F.lit(b"").alias(to)).schema
    schema[to].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*sent.value)
        for batch in small_batches(batches, ids, ID_BYTES):
            lists = batch.column(ids)
            values = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            found = decoder.decode(values, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            some = lists.is_valid().to_pylist()
            yield _with_column(batch, to, pa.array([f if s else None for f, s in zip(found, some, strict=True)], pa.binary()))

    return tokens.mapInArrow(run, schema)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return decode(ids).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
