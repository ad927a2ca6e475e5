"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents inside one task. Its words become symbols (ids of benchmark words, 0 for all
others); runs of known words too short for any window are left out, since no window can occur there. Over the rest
the task builds a suffix order, the Burrows-Wheeler column, a wavelet matrix for ranks and sampled suffix
positions; all windows are searched backwards at once, occurrences are located by walking to a sample, and
overlapping spans are merged.

The benchmark is handled in blocks of at most ``BLOCK_BYTES`` of text; every block is one more narrow pass over the
documents, so what is sent to a task is bounded whatever the benchmark's size.

Defined results: null and empty texts have no words, no hits and are clean; benchmark rows with a null id or
without words are ignored; equal ids count once; equal document rows are each reported; other columns are ignored;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 8

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT or 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of digits, Latin letters and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


class Phrases:
    """The windows of one benchmark block: word ids, distinct windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for start in range(max(1, len(symbols) - WINDOW + 1)):
                window = tuple(symbols[start : start + WINDOW])
                if window:
                    owners.setdefault(window, set()).add(item)
        self.groups = []
        for length in sorted({len(w) for w in owners}):
            windows = [w for w in owners if len(w) == length]
            self.groups.append((length, np.array(windows, dtype=np.int64), [sorted(owners[w]) for w in windows]))
        self.shortest = self.groups[0][0] if self.groups else 0


class FMIndex:
    """Backward search over runs of symbols; 0 ends every run."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray, alphabet: int):
        n = len(text)
        rank = np.where(text == 0, np.cumsum(text == 0) - 1, (text == 0).sum() + text).astype(np.int64)
        step, order = 1, np.argsort(rank, kind="stable")
        while True:
            follow = np.zeros(n, dtype=np.int64)
            follow[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 3) + follow
            order = np.argsort(key, kind="stable")
            changed = np.empty(n, dtype=np.int64)
            changed[0] = 0
            np.not_equal(key[order][1:], key[order][:-1], out=changed[1:], casting="unsafe")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(changed)
            step *= 2
            if rank.max() == n - 1 or step >= n:
                break
        bwt = np.where(run_start[order], 0, text[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.bwt = bwt
        self.levels = []
        column = bwt
        for bit in reversed(range(max(1, int(alphabet).bit_length()))):
            ones = (column >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(n - ones.sum())))
            column = np.concatenate([column[ones == 0], column[ones == 1]])
        self.sampled = run_start[order] | (order % SAMPLE == 0)
        self.position = order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the column before each row, through the wavelet levels."""
        start = np.zeros_like(row)
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            row_ones, start_ones = ones[row], ones[start]
            row = np.where(up, zeros + row_ones, row - row_ones)
            start = np.where(up, zeros + start_ones, start - start_ones)
        return row - start

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), len(self.bwt), dtype=np.int64)
        for at in reversed(range(windows.shape[1])):
            symbol = windows[:, at]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        while len(open_ := np.flatnonzero(~self.sampled[at])):
            symbol = self.bwt[at[open_]]
            at[open_] = self.first[symbol] + self.rank(symbol, at[open_])
            steps[open_] += 1
        return self.position[at] + steps


def _kept_runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of known words of at least ``shortest``: their symbols with a closing 0, their old positions, run starts."""
    known = np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])
    edge = np.diff(known)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= shortest
    begin, length = begin[long], (end - begin)[long] + 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    offset = np.cumsum(length) - length
    old = np.arange(length.sum()) - np.repeat(offset - begin, length)
    text = np.append(symbols, 0)[old]
    start = np.zeros(len(old), dtype=bool)
    start[offset] = True
    return text, old, start


def find(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[int], set[str]]]:
    """Per text: number of words, merged hit spans ``[start, end, start, end, ...]`` in words, items that occur."""
    get, sizes, stream = phrases.ids.get, [], []
    for text in texts:
        words = words_of(text)
        sizes.append(len(words))
        stream.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        stream.append(np.zeros(1, dtype=np.int64))
    spans: list[list[int]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    symbols = np.concatenate(stream) if stream else np.zeros(0, np.int64)
    text, old, start = _kept_runs(symbols, phrases.shortest) if phrases.groups else ((), (), ())
    if len(text):
        first_word = np.cumsum([0] + [s + 1 for s in sizes])
        index = FMIndex(text, start, len(phrases.ids))
        mark = np.zeros(len(symbols) + 1, dtype=np.int64)
        for length, windows, owners in phrases.groups:
            low, high = index.search(windows)
            count = high - low
            if not count.any():
                continue
            which = np.repeat(np.arange(len(windows)), count)
            rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = old[index.locate(rows)]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + length, -1)
            doc = np.searchsorted(first_word, at, side="right") - 1
            for pair in np.unique(doc * len(windows) + which):
                items[pair // len(windows)].update(owners[pair % len(windows)])
        edge = np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(first_word, begin, side="right") - 1
        for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
            spans[d] += [b - int(first_word[d]), e - int(first_word[d])]
    return list(zip(sizes, spans, items, strict=True))


def merge(one: list[int], two: list[int]) -> list[int]:
    """Union of two sorted lists of disjoint spans."""
    out: list[int] = []
    for b, e in sorted([*zip(one[::2], one[1::2], strict=True), *zip(two[::2], two[1::2], strict=True)]):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", SHARD_BYTES):
            found = find(batch.column("text").to_pylist(), phrases)
            spans, items = batch.column("__spans").to_pylist(), batch.column("__items").to_pylist()
            made = {
                "__n_words": [f[0] for f in found],
                "__spans": [merge(s, f[1]) if s else f[1] for s, f in zip(spans, found, strict=True)],
                "__items": [sorted(set(i) | f[2]) for i, f in zip(items, found, strict=True)],
            }
            columns = [pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name) for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def _found(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int) -> DataFrame:
    """``keep`` columns with the words, merged spans and items found, and the number of words hit."""
    test = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = int(test.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0])
    blocks = max(1, -(-size // block_bytes))
    work = docs.select(
        *keep, *([] if "text" in keep else ["text"]), F.lit(0).cast("long").alias("__n_words"), F.array().cast("array<bigint>").alias("__spans"),
        F.array().cast("array<string>").alias("__items"),
    )
    for block in range(blocks):
        rows = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        work = _pass(work, Phrases([(r[0], r[1]) for r in rows]))
    ends = F.aggregate("__spans", F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(
        F.when(a["s"] < 0, x).otherwise(F.lit(-1)).alias("s"), F.when(a["s"] < 0, a["n"]).otherwise(a["n"] + x - a["s"]).alias("n")
    ), lambda a: a["n"])
    return work.withColumn("__n_hit", ends)


def _contaminated():
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (none named like a result) of every document with n_words, merged word ``spans`` to remove,
    ``items``, n_hit, n_items, items_sha256 and contaminated."""
    return _found(docs, benchmark, keep, block_bytes).select(
        *keep, F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"), F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("__items"), ","), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    return _found(docs, benchmark, docs.columns, BLOCK_BYTES).where(~_contaminated()).select(*docs.columns)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, test = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, test, ["doc_id"]).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS k
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM d, lens,
  LATERAL (SELECT unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS p)),
hits AS (SELECT DISTINCT rid, p, n, k FROM dw WHERE (n, k) IN (SELECT (n, k) FROM bw)),
hit_words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hits, LATERAL (SELECT unnest(range(p, p + n)) AS q) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits JOIN bw USING (n, k)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
