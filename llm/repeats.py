"""Exact removal of long repeated byte strings by suffix order (two-stage sorting).

A byte goes when a string of ``LENGTH`` bytes over it also starts anywhere else in the corpus. Window starts are dealt to
content anchors (``anchors``): equal windows share an anchor. Runs with equal bytes collapse to one text with a count;
a run that occurs twice is repeated as a whole. Where an anchor has several different runs, or one that may repeat
inside itself, the runs' bytes are gathered in shards of bounded size, and each shard is suffix sorted: only suffixes
smaller than their successor are sorted directly, the others are induced by bucket scans, and neighbours in the order
with a common prefix of ``LENGTH`` mark each other's starts. A hot anchor is split by the content of its windows.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` keep everything; equal rows repeat each other
(long ones lose everything); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.anchors import LENGTH, Hasher
from llm.common import cut, pieces_for, row_keys, small_batches, stored

#: Bytes of runs in one suffix-sorted shard, and runs of one anchor that stay together.
SHARD_BYTES = 1 << 19
RUNS_TOGETHER = 128
BATCH_BYTES = 2 << 20


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number (zeros beyond the end)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)]).astype(np.uint64)
    out = np.zeros(n + LENGTH + 8, dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + n + LENGTH + 8]
    return out


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` in the order of their suffixes' first ``LENGTH`` bytes, and the packed words."""
    n, words = len(text), _words(text)
    value = text.astype(np.int64)
    step = np.diff(value, append=-1)
    decided = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(decided[::-1])[::-1]] > 0  # smaller than its successor
    # Directly sorted: refine groups of equal prefixes, eight bytes at a time.
    order = np.flatnonzero(smaller)
    order = order[np.argsort(words[order], kind="stable")]
    group = np.zeros(len(order), dtype=np.int64)
    if len(order):
        group[1:] = np.cumsum(words[order][1:] != words[order][:-1])
    open_ = np.arange(len(order))
    for at in range(8, LENGTH, 8):
        same = group[open_[1:]] == group[open_[:-1]]
        tied = np.zeros(len(open_), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        open_ = open_[tied]
        if not len(open_):
            break
        place, own = order[open_], group[open_]
        new = np.lexsort((words[place + at], own))
        place = place[new]
        order[open_] = place
        key = words[place + at]
        fresh = np.zeros(len(open_), dtype=np.int64)
        fresh[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        # Positions inside the open part are unique, so a group may be named by where it begins.
        begin = np.ones(len(open_), dtype=bool)
        begin[1:] = (own[1:] != own[:-1]) | (fresh[1:] == 1)
        group[open_] = open_[np.maximum.accumulate(np.where(begin, np.arange(len(open_)), 0))]
    sorted_part = np.split(order, np.cumsum(np.bincount(value[order], minlength=256))[:-1]) if len(order) else [order] * 256
    # Induced: a suffix larger than its successor follows the order of that successor.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[value[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts = [found]
        while len(found):
            before = found[found > 0] - 1
            found = before[value[before] == c]
            parts.append(found)
        bucket = np.concatenate([*parts, sorted_part[c]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[value[before] > c]
        by = np.argsort(value[before], kind="stable")
        before = before[by]
        symbols, first = np.unique(value[before], return_index=True)
        for symbol, part in zip(symbols.tolist(), np.split(before, first[1:]), strict=False):
            waiting[symbol].append(part)
    return np.concatenate(out), words


def repeated_starts(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the flagged starts have a ``LENGTH``-byte string that another flagged start has too."""
    order, words = suffix_order(text)
    order = order[start[order]]
    pair = np.arange(len(order) - 1) if len(order) > 1 else np.zeros(0, np.int64)
    for at in range(0, LENGTH, 8):
        pair = pair[words[order[pair] + at] == words[order[pair + 1] + at]]
    out = np.zeros(len(text), dtype=bool)
    out[order[pair]] = True
    out[order[pair + 1]] = True
    return out


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _ranges(flags: np.ndarray) -> list[int]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().tolist()


def occurrences(texts: DataFrame) -> DataFrame:
    """Runs of every text: k1, k2, first, last, anchor, content, again."""
    names = ["k1", "k2", "first", "last", "anchor", "content", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in small_batches(batches, "text", BATCH_BYTES):
            which, first, last, anchor, content, again = hasher.runs([_bytes(t) for t in batch.column("text").to_pylist()])
            if len(which):
                keys = [batch.column(k).to_numpy()[which] for k in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, first, last, anchor, content, again)], names=names)

    return texts.where(F.octet_length("text") >= LENGTH).mapInArrow(
        run, "k1 bigint, k2 bigint, first bigint, last bigint, anchor bigint, content bigint, again boolean"
    )


def _cut_runs(rows: DataFrame, shards: int, together: int) -> DataFrame:
    """Bytes of the listed runs of each text, with the shard they are sorted in. Runs of a hot anchor (``runs`` over
    ``together``) go to as many shards as their windows' hashes name, each with the starts it is to look at."""
    names = ["shard", "anchor", "content", "data", "starts"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        for batch in small_batches(batches, "text", BATCH_BYTES):
            out: list[tuple] = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = _bytes(text)
                for r in runs:
                    piece = data[r["first"] : r["last"] + LENGTH]
                    parts = -(-r["runs"] // together)
                    spot = (r["anchor"] * 0x9E3779B97F4A7C15 & mask) >> 20
                    if parts == 1:
                        out.append((spot % shards, r["anchor"], r["content"], piece, None))
                        continue
                    dealt: dict[int, list[int]] = {}
                    for s in range(len(piece) - LENGTH + 1):
                        part = int.from_bytes(hashlib.blake2b(piece[s : s + LENGTH], digest_size=8).digest(), "little") % parts
                        dealt.setdefault(part, []).append(s)
                    out += [((spot + part * 0xC2B2AE3D) % shards, r["anchor"], r["content"], piece, at) for part, at in dealt.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, "shard int, anchor bigint, content bigint, data binary, starts array<bigint>")


def _sort_shard(part: pd.DataFrame) -> pd.DataFrame:
    sizes = part["data"].map(len).to_numpy(dtype=np.int64)
    text = np.frombuffer(b"".join(part["data"]), dtype=np.uint8)
    offset = np.cumsum(sizes) - sizes
    start = np.zeros(len(text), dtype=bool)
    for b, size, at in zip(offset, sizes, part["starts"], strict=True):
        if at is None:
            start[b : b + size - LENGTH + 1] = True
        else:
            start[b + np.asarray(at, dtype=np.int64)] = True
    found = repeated_starts(text, start)
    rows = [
        (anchor, content, _ranges(found[b : b + size]))
        for b, size, anchor, content in zip(offset, sizes, part["anchor"], part["content"], strict=True)
        if found[b : b + size].any()
    ]
    return pd.DataFrame(rows, columns=["anchor", "content", "ranges"])


def repeated_ranges(docs: DataFrame, together: int = RUNS_TOGETHER) -> DataFrame:
    """``k1, k2, ranges``: first and last repeated window start, again and again, of every text that has any."""
    k1, k2 = row_keys("text")
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), "text")
    found = occurrences(texts)
    busy = stored(
        found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor"), "anchors"
    )
    runs = stored(found.join(busy, "anchor"), "runs")
    kinds = runs.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min(F.struct("k1", "k2", "first", "last")).alias("w")
    )
    kinds = stored(kinds, "kinds")
    several = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs"), F.max("again").alias("any")).where("runs > 1 or any").drop("any"))
    sort = kinds.join(several, "anchor").select("w.k1", "w.k2", F.struct(F.col("w.first").alias("first"), F.col("w.last").alias("last"), "anchor", "content", "runs").alias("run"))
    size = kinds.agg(F.coalesce(F.sum(F.col("w.last") - F.col("w.first") + LENGTH), F.lit(0))).first()[0]
    shards = pieces_for(docs, int(size), SHARD_BYTES)
    listed = sort.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))
    one_each = texts.where(F.octet_length("text") >= LENGTH).dropDuplicates(["k1", "k2"])
    cut_runs = _cut_runs(one_each.join(listed, ["k1", "k2"]).select("text", "runs"), shards, together)
    inside = cut_runs.groupBy("shard").applyInPandas(_sort_shard, "anchor bigint, content bigint, ranges array<bigint>")
    whole = kinds.where("n > 1").select("anchor", "content", F.array(F.lit(0).cast("long"), F.col("w.last") - F.col("w.first")).alias("ranges"))
    known = kinds.where("n = 1").select("anchor", "content")
    marked = stored(inside.join(known, ["anchor", "content"]).unionByName(whole), "marked")
    placed = runs.join(marked, ["anchor", "content"]).select("k1", "k2", F.transform("ranges", lambda x: x + F.col("first")).alias("ranges")).distinct()
    return placed.groupBy("k1", "k2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, keep: list[str], together: int = RUNS_TOGETHER) -> DataFrame:
    """``keep`` columns (none named like a result) with n_bytes, removed byte ``spans`` and ``kept_bytes``."""
    k1, k2 = row_keys("text")
    ranges = stored(repeated_ranges(docs, together), "ranges")
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]), k1.alias("__k1"), k2.alias("__k2"))
    joined = rows.join(ranges.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("ranges").alias("__ranges")), ["__k1", "__k2"], "left")
    work = joined.select(*keep, F.col("text").alias("__text"), "__ranges")
    schema = work.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.array(F.lit(0).cast("long")).alias("spans"), F.lit(b"").alias("kept_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text"):
            sizes, spans, kept = [], [], []
            for text, starts in zip(batch.column("__text").to_pylist(), batch.column("__ranges").to_pylist(), strict=True):
                data = _bytes(text)
                gone: list[int] = []
                for b, e in sorted(zip(starts[::2], starts[1::2], strict=True)) if starts else ():
                    if gone and b <= gone[-1]:
                        gone[-1] = max(gone[-1], e + LENGTH)
                    else:
                        gone += [b, e + LENGTH]
                sizes.append(len(data))
                spans.append(gone)
                kept.append(b"".join(data[b:e] for b, e in zip([0, *gone[1::2]], [*gone[::2], len(data)], strict=True)))
            made = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "n_bytes", "spans", "kept_bytes"])

    return work.mapInArrow(run, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, ["doc_id"]).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
