"""Token ids in training order: packed sequences, a keyed permutation, and fixed-stride shards.

1. Texts are encoded once; every task writes its token stream in chunks to a staged table in the shared folder.
2. The streams stand one after another and are cut into sequences of ``length`` tokens, whose index is dense.
3. A keyed Feistel network with cycle walking maps the index to a global slot, a bijection on 0..n-1.
4. Pieces of sequences are dealt by range of slots; each shard is sorted by slot, so that record ``slot`` stands at byte
   ``(slot - first_slot) * stride`` of its shard and a reader can resume at any slot.

Defined results: null and empty texts are a lone end token; the last sequence is padded with end tokens; equal rows are
separate texts; an empty table gives no rows; other columns are ignored. The vocabulary's path is a parameter; the file
is read on the driver and sent to the tasks (its size is checked).
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import checkpoint_dir, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY_LIMIT = 32 << 20
LENGTH = 1024
SHARD_RECORDS = 4096
CHUNK_TOKENS = 1 << 18
KEY = 0x5DEECE66D
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the indexes 0..n-1: a balanced Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    walk = np.ones(len(out), dtype=bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for k in keys:
            x = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            left, right = right, left ^ (x & mask)
        out[walk] = left << np.uint64(half) | right
        walk[walk] = out[walk] >= np.uint64(n)
    return out.astype(np.int64)


def load_vocabulary(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > VOCABULARY_LIMIT:
        raise ValueError("the vocabulary is too large to send to the tasks")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def stage(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> tuple[DataFrame, int]:
    """Written table ``part, start, n, ids`` of token streams, one stream per task, and the end token."""
    ranks = load_vocabulary(vocabulary)
    end = max(ranks.values()) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        part, start = TaskContext.get().partitionId(), 0
        waiting, size = [], 0

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(waiting)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary())}
            )

        for batch in small_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                ids = encoder.encode_ordinary(text) if text else []
                waiting.append(np.array([*ids, end], dtype=kind))
                size += len(ids) + 1
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    start, waiting, size = start + size, [], 0
        if waiting:
            yield chunk()

    staged = docs.select("text").mapInArrow(run, "part int, start bigint, n bigint, ids binary")
    staged.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder), end


def in_training_order(
    docs: DataFrame, length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = KEY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per sequence: slot, sequence, shard, byte_offset, n_tokens (without padding) and ids (``stride`` bytes)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    staged, end = stage(docs, folder, vocabulary)
    width = 2 if end < 1 << 16 else 4
    kind = f"<u{width}"
    # One count per writing task, as many as the tasks themselves.
    parts = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in parts:
        base[part] = total
        total += n
    count = -(-total // length)
    shards = max(1, -(-count // shard_records))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids"):
            for part, start, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n", "ids")), strict=True):
                first = base[part] + start
                edges = np.unique(np.concatenate([[first], np.arange(-(-first // length) * length, first + n, length), [first + n]]))
                sequence, at = edges[:-1] // length, edges[:-1] % length
                bounds = ((edges - first) * width).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "slot": pa.array(permute(sequence, count, key), pa.int64()), "sequence": pa.array(sequence, pa.int64()), "at": pa.array(at, pa.int32()),
                        "ids": pa.array([ids[b:e] for b, e in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                    }
                )

    pieces = staged.mapInArrow(cut, "slot bigint, sequence bigint, at int, ids binary").withColumn(
        "shard", F.floor(F.col("slot") / shard_records).cast("int")
    )
    padding = np.array([end], dtype=kind).tobytes()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        rows: list[tuple] = []
        slot, sequence, shard, ids = None, 0, 0, bytearray()

        def close() -> None:
            n = len(ids) // width
            rows.append((slot, sequence, shard, slot % shard_records * length * width, n, bytes(ids) + padding * (length - n)))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for s, q, k, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "shard", "ids")), strict=True):
                if s != slot:
                    if slot is not None:
                        close()
                    if len(rows) >= 1024:
                        yield packed()
                        rows.clear()
                    slot, sequence, shard, ids = s, q, k, bytearray()
                ids += piece
        if slot is not None:
            close()
        if rows:
            yield packed()

    dealt = pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "at").select("slot", "sequence", "shard", "ids")
    return dealt.mapInArrow(join, "slot bigint, sequence bigint, shard int, byte_offset bigint, n_tokens int, ids binary")


def write_shards(records: DataFrame, folder: str) -> DataFrame:
    """Raw shard files ``shard-%06d.bin`` in a folder that pyarrow's file systems reach (shared mount, object store);
    each file appears by a rename when it is complete, so a lost task leaves nothing half written. Returns the manifest
    ``shard, path, first_slot, records, sha256``; nothing is written before the manifest is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        current, out, digest, rows = None, None, None, []

        def close() -> None:
            out.close()
            store.move(f"{root}/{current}.{mark}", rows[-1]["path"])
            rows[-1]["sha256"] = digest.hexdigest()

        mark = uuid.uuid4().hex
        for batch in batches:
            for slot, shard, ids in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "ids")), strict=True):
                if shard != current:
                    if out:
                        close()
                    current, digest = shard, hashlib.sha256()
                    out = store.open_output_stream(f"{root}/{current}.{mark}")
                    rows.append({"shard": shard, "path": f"{root}/shard-{shard:06d}.bin", "first_slot": slot, "records": 0})
                out.write(ids)
                digest.update(ids)
                rows[-1]["records"] += 1
        if out:
            close()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_slot", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    return records.mapInArrow(run, "shard int, path string, first_slot bigint, records bigint, sha256 string")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))
