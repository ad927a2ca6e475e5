"""Language-model scores from a probabilistic suffix tree over words.

Contexts are the last one or two words. A context is kept when its next-word distribution diverges from that of its
suffix by more than it costs to write down: the sum over next words x of n(x|s) ln(P(x|s) / P(x|suffix)), less
-ln P(x|suffix) for each x that the node lists, must reach ``GAIN``. Distributions are smoothed by the next shorter kept
context in proportion to the number of different next words (Witten-Bell), and in the end by the add-one word
distribution. A token is scored in the longest kept suffix of what stands before it in its text.

Nothing of the model is sent whole to any task. Documents are hashed into blocks; a block names the word strings it
holds (sorted 64-bit hashes with its training counts, packed) to hash ranges, which add up the counts of all blocks and
answer each block for its own strings; a second exchange adds up the divergence terms and answers which contexts stay.
Hashes of strings of two or three words keep enough bits for one false match in 2^26 (``n_known`` and ``base_score`` use
whole hashes).

Defined results: a null or empty text is a single end token; a null doc_id counts as training; equal rows are scored
alike and each count in training; other columns are ignored; with no training text every token is unknown.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import held_out, pieces_for, text_bytes

#: Longest context; the code below is general in it.
DEPTH = 2
#: Nats by which a context must pay for itself, and training occurrences it needs.
GAIN = 1.0
LEAST = 2
#: Text of one block; about 20 times as much memory is used for it.
BLOCK_BYTES = 8 << 20

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(int.from_bytes(hashlib.blake2b(b"end of text", digest_size=8, person=b"end").digest(), "little"))
_TOP = 1 << 64


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Block:
    """Token strings of the texts of one block.

    ``unique[k]`` are the distinct hashes of strings of k + 1 tokens in order, ``at[k]`` the place in it for every token
    (the string that ends there; -1 where the text is too short), ``first[k]`` a token where each stands.
    """

    def __init__(self, texts: list[str | None], train: np.ndarray, bits: int):
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        look, parts, sizes = ids.__getitem__, [], []
        for text in texts:
            words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            parts.append(np.fromiter(map(look, words), dtype=np.int64, count=len(words)))
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        hashes = np.fromiter((int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in ids), dtype=np.uint64, count=len(ids))
        hashes = np.append(hashes, _END)
        end = np.array([len(ids)], dtype=np.int64)
        word = hashes[np.concatenate([x for p in parts for x in (p, end)])]
        self.is_end = word == _END
        depth = np.arange(len(word)) - np.repeat(self.start, self.sizes)
        trained = np.repeat(train, self.sizes)
        mask = np.uint64(_TOP - (1 << (64 - bits)))
        self.unique, self.at, self.first, self.count = [], [], [], []
        string = word
        for k in range(DEPTH + 1):
            if k:
                string = np.concatenate([np.zeros(1, np.uint64), _stir(string[:-1] * _MULTIPLY + word[1:])])
            usable = np.flatnonzero(depth >= k)
            own = string[usable] if k == 0 else string[usable] & mask
            unique, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            at = np.full(len(word), -1, dtype=np.int32)
            at[usable] = inverse
            self.unique.append(unique)
            self.first.append(usable[first])
            self.at.append(at)
            self.count.append(np.bincount(inverse, weights=trained[usable], minlength=len(unique)).astype(np.uint64))


def _bounds(ranges: int) -> np.ndarray:
    return np.array([-(-(r << 32) // ranges) << 32 for r in range(1, ranges)], dtype=np.uint64)


def _request(block: int, ranges: int, columns: list[list[np.ndarray]]) -> pd.DataFrame:
    """One row per range with the packed part of every list of columns; the first of each list are sorted hashes."""
    cuts = [np.concatenate([[0], np.searchsorted(c[0], _bounds(ranges)), [len(c[0])]]) for c in columns]
    rows = []
    for r in range(ranges):
        data = []
        for c, cut in zip(columns, cuts, strict=True):
            part = slice(cut[r], cut[r + 1])
            data += [pack_sorted(c[0][part]), *(pack(x[part]) for x in c[1:])]
        rows.append((block, r, data))
    return pd.DataFrame(rows, columns=["block", "range", "data"])


def _named(ranges: int, bits: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = Block(part["text"].tolist(), part["train"].to_numpy(dtype=bool), bits)
        return _request(key[0], ranges, [[u, c] for u, c in zip(own.unique, own.count, strict=True)])

    return run


def _added(part: pd.DataFrame) -> pd.DataFrame:
    """Total training count of every string of a range, for each block that named it, and who answers for it."""
    part = part.sort_values("block")
    answers: list[list[bytes]] = [[] for _ in range(len(part))]
    tokens = kinds = 0
    for k in range(DEPTH + 1):
        names = [unpack_sorted(d[2 * k]) for d in part["data"]]
        counts = np.concatenate([unpack(d[2 * k + 1]) for d in part["data"]])
        _, first, inverse = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts.astype(np.float64), minlength=len(first)).astype(np.uint64)
        if k == 0:
            tokens, kinds = int(total.sum()), int((total > 0).sum())
        own = np.zeros(len(inverse), dtype=np.uint64)
        own[first] = 1
        cuts = np.cumsum([len(n) for n in names])[:-1]
        # The lowest bit says whether the block answers for the string in the divergence sums.
        for answer, value in zip(answers, np.split(total[inverse] * np.uint64(2) + own, cuts), strict=True):
            answer.append(pack(value))
    return pd.DataFrame({"to": part["block"], "range": part["range"], "kind": 0, "data": answers, "tokens": tokens, "kinds": kinds})


def _totals(own: Block, answers: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
    first = answers[answers["kind"] == 0].sort_values("range")
    counts, owns = [], []
    for k in range(DEPTH + 1):
        value = np.concatenate([unpack(d[k]) for d in first["data"]])
        counts.append((value >> np.uint64(1)).astype(np.int64))
        owns.append((value & np.uint64(1)) == 1)
    return counts, owns, int(first["tokens"].sum()), int(first["kinds"].sum())


def _contexts(own: Block, counts: list[np.ndarray]) -> list[np.ndarray]:
    """Which strings of 1..DEPTH tokens can be contexts."""
    return [(counts[k] >= LEAST) & ~own.is_end[own.first[k]] for k in range(DEPTH)]


def _diverged(ranges: int, bits: int):
    def run(key: tuple, part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"block": [], "range": [], "data": []})
        own = Block(part["text"].tolist(), part["train"].to_numpy(dtype=bool), bits)
        counts, owns, tokens, kinds = _totals(own, answers)
        usable = _contexts(own, counts)
        columns = []
        for k in range(1, DEPTH + 1):
            pick = np.flatnonzero(owns[k] & (counts[k] > 0))
            end = own.first[k][pick]
            context = own.at[k - 1][end - 1]
            keep = usable[k - 1][context]
            pick, end, context = pick[keep], end[keep], context[keep]
            n, n_context, n_suffix = counts[k][pick], counts[k - 1][context], counts[k - 1][own.at[k - 1][end]]
            if k == 1:
                below = (n_suffix + 1) / (tokens + kinds + 1)
            else:
                below = n_suffix / counts[k - 2][own.at[k - 2][end - 1]]
            gain = n * np.log(n / n_context / below) + np.log(below)
            size = len(own.unique[k - 1])
            # Sums are sent as whole 1/1024 nats, shifted to be positive: the same whatever the order of addition.
            total = np.round(np.bincount(context, weights=gain, minlength=size) * 1024).astype(np.int64)
            different = np.bincount(context, minlength=size).astype(np.uint64)
            at = usable[k - 1]
            columns.append([own.unique[k - 1][at], (total[at] << 1 ^ total[at] >> 63).astype(np.uint64), different[at]])
        return _request(key[0], ranges, columns)

    return run


def _decided(part: pd.DataFrame) -> pd.DataFrame:
    """For every context a block named: its number of different next words if it stays, else 0."""
    part = part.sort_values("block")
    answers: list[list[bytes]] = [[] for _ in range(len(part))]
    for k in range(DEPTH):
        names = [unpack_sorted(d[3 * k]) for d in part["data"]]
        gain = np.concatenate([unpack(d[3 * k + 1]) for d in part["data"]])
        gain = (gain >> np.uint64(1)).astype(np.int64) ^ -(gain & np.uint64(1)).astype(np.int64)
        different = np.concatenate([unpack(d[3 * k + 2]) for d in part["data"]])
        unique, inverse = np.unique(np.concatenate(names), return_inverse=True)
        total = np.zeros(len(unique), dtype=np.int64)
        np.add.at(total, inverse, gain)
        kept = np.bincount(inverse, weights=different.astype(np.float64), minlength=len(unique)).astype(np.uint64)
        kept[total < GAIN * 1024] = 0
        for answer, value in zip(answers, np.split(kept[inverse], np.cumsum([len(n) for n in names])[:-1]), strict=True):
            answer.append(pack(value))
    return pd.DataFrame({"to": part["block"], "range": part["range"], "kind": 1, "data": answers, "tokens": 0, "kinds": 0})


def _scored(bits: int):
    def run(key: tuple, part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_contexts"]
        if part.empty:
            return pd.DataFrame({n: [] for n in names})
        own = Block(part["text"].tolist(), part["train"].to_numpy(dtype=bool), bits)
        counts, _, tokens, kinds = _totals(own, answers)
        second = answers[answers["kind"] == 1].sort_values("range")
        usable = _contexts(own, counts)
        n = counts[0][own.at[0]]
        chance = (n + 1) / (tokens + kinds + 1)
        base, used = np.log10(chance), np.zeros(len(n), dtype=np.int64)
        for k in range(1, DEPTH + 1):
            different = np.zeros(len(own.unique[k - 1]), dtype=np.int64)
            different[usable[k - 1]] = np.concatenate([unpack(d[k - 1]) for d in second["data"]]).astype(np.int64)
            end = np.flatnonzero(own.at[k] >= 0)
            context = own.at[k - 1][end - 1]
            kept = different[context] > 0
            end, context = end[kept], context[kept]
            seen = counts[k][own.at[k][end]]
            chance[end] = (seen + different[context] * chance[end]) / (counts[k - 1][context] + different[context])
            used[end] = k
        add = lambda x: np.add.reduceat(x, own.start)
        return pd.DataFrame(
            {"doc_id": part["doc_id"], "train": part["train"], "n_tokens": own.sizes, "n_known": add((n > 0).astype(np.int64)), "train_tokens": tokens,
             "base_score": add(base), "score": add(np.log10(chance)), "n_contexts": add((used > 0).astype(np.int64))}
        )

    return run


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score and n_contexts (tokens scored in a context)."""
    _, size = text_bytes(docs)
    blocks = pieces_for(docs, size, BLOCK_BYTES)
    bits = min(64, math.ceil(math.log2(size / 4 + 2)) + 26)
    rows = docs.select("doc_id", "text", train.alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    answer = "to int, range int, kind int, data array<binary>, tokens bigint, kinds bigint"
    request = "block int, range int, data array<binary>"
    # One plan: the documents are dealt to their blocks once, and each exchange is used by all that follows.
    counted = rows.groupBy("block").applyInPandas(_named(blocks, bits), request).groupBy("range").applyInPandas(_added, answer)
    terms = rows.groupBy("block").cogroup(counted.groupBy("to")).applyInPandas(_diverged(blocks, bits), request)
    answers = counted.union(terms.groupBy("range").applyInPandas(_decided, answer))
    schema = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_contexts bigint"
    return rows.groupBy("block").cogroup(answers.groupBy("to")).applyInPandas(_scored(bits), schema)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, ~held_out(F.col("doc_id"), 7))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_contexts")
