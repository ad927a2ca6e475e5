"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Every document becomes a sequence of lower-cased words and its five-word shingles. A shingle is labelled with its
occurrence number, so repeats count. A sketch takes the ``KEPT`` smallest hashes of the labelled shingles and keeps
those shingles in text order; two sketches make a band. Documents that agree on a band and on ``SHARED`` sketches in all are
candidates. That favours documents with the same shingles in the same order, that is, a high edit similarity.

Equal word sequences collapse to one node first. Inside a band's bucket a leader is compared with the other members.
Then candidates of a bucket that lie in different components are aligned too, some members of each component first and
more in every round until none is left, so that no link of a bucket is lost where its ends do not align with the same
leader. A link is
``1 - edit distance / longer length >= 0.8`` in words, exactly computed. Connected nodes are one class, named by its
smallest doc_id.

Defined results: a null text and an empty one is alone (class is its own id); a text without words counts as one word;
fewer than five words make one shingle; equal rows share a class; rows with a null doc_id take part and get the class
of their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, row_keys, small_batches, stored
from llm.decontam import words_of
from skyloom.functions.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
KEPT = 2
SKETCHES = 32
BANDS = 64
#: Sketches two texts must share before they are aligned (of ``SKETCHES``; at the similarity wanted about eight agree).
SHARED = 3
#: Members of each component of a bucket aligned in the first closing round; each later round takes so many times more.
CLOSING = 8
PAIRS_PER_TASK = 256
REMEMBERED = 300_000
#: Shingles hashed together.
SLICE = 2048

_RNG = np.random.default_rng(97)
_ODD = (_RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
#: The pairs of sketches that make the bands: neighbours at growing distances.
_PAIRS = [(i, (i + 1 + 4 * (b // SKETCHES)) % SKETCHES) for b in range(BANDS) for i in [b % SKETCHES]]
#: A sketch keeps seven bits in a lane of a number when texts are compared; the top lane stays empty.
LANES = 7
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hash of every five-word shingle in text order (one for a shorter text)."""
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(w))
    out = np.zeros(len(w) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + w[k : len(w) - size + 1 + k]
    return _stir(out)


def sketches_of(grams: np.ndarray) -> list[int]:
    """The sketches of a text; all of them are made together, long texts in slices."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    labelled = np.empty_like(grams)
    labelled[order] = _stir(ranked + (np.arange(len(ranked)) - begin).astype(np.uint64) * _BASE)
    every = np.arange(len(_ODD))
    at = np.zeros((0, len(_ODD)), dtype=np.int64)
    least = np.zeros((0, len(_ODD)), dtype=np.uint64)
    for start in range(0, len(labelled), SLICE):
        value = _stir(labelled[start : start + SLICE] * _ODD[:, None] + _ADD[:, None])
        for _ in range(min(KEPT, value.shape[1])):
            low = value.argmin(axis=1)
            at, least = np.vstack([at, low + start]), np.vstack([least, value[every, low]])
            value[every, low] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if len(at) > KEPT:
            best = np.argsort(least, axis=0, kind="stable")[:KEPT]
            at, least = at[best, every], least[best, every]
    out = every.astype(np.uint64)
    for row in np.sort(at, axis=0):
        out = _stir(out * _BASE + grams[row])
    return out.astype(np.int64).tolist()


def _within_band(a: list, b: list, band: int) -> int:
    """Edit distance of a and b (a not shorter) if it is at most ``band``, else some larger number.

    Bit vectors over the diagonals -band..band: bit i of a column stands for the row ``column - band + i``.
    """
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    window = (1 << 2 * band + 1) - 1
    rises, falls = window ^ ((1 << band) - 1), 0
    distance = len(a) - len(b)
    final = 1 << band + distance
    for column, word in enumerate(b):
        shift = column - band
        equal = places.get(word, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & window
        level = ((((equal & rises) + rises) ^ rises) | equal | falls) & window
        if not level & final:
            distance += 1
            if distance > band:
                return distance
        across_up = falls | (window & ~(level | rises))
        across_down = level & rises
        below = level >> 1
        rises = across_down | (window & ~(below | across_up))
        falls = below & across_up
    return distance


def edit_distance(a: list, b: list, limit: int) -> int:
    """Exact edit distance up to ``limit`` (larger values only say "more"); the band doubles until it holds the result."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return limit + 1
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a)
    band = min(limit, len(a) - len(b) + 8)
    while True:
        distance = _within_band(a, b, band)
        if distance <= band or band == limit:
            return distance
        band = min(limit, 2 * band)


def similar(a: list, b: list) -> bool:
    longest = max(len(a), len(b))
    limit = int(longest * (1 - SIMILARITY) + 1e-9)
    return edit_distance(a, b, limit) <= limit


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (text key), node (hash of the word sequence), n_words, sketch; rows without text are left out."""
    k1, k2 = row_keys("text")
    rows = docs.where("text is not null and text != ''").select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("node", pa.int64()), ("n_words", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, "text"):
            nodes, sizes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text) or [text.encode("utf-8", "surrogatepass")]
                nodes.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(words))
                bands.append(sketches_of(shingles(words, hashes)))
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.int64()) for c in ("doc_id", "k1", "k2")), *made], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, node bigint, n_words bigint, sketch array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, ok`` for node pairs. A leader with many partners is dealt out in parts of ``PAIRS_PER_TASK``."""
    parts = F.ceil(F.count(F.lit(1)) / PAIRS_PER_TASK).cast("int")
    counted = cut(pairs.groupBy("a").agg(parts.alias("parts")))
    left = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(counted, "a")
        .withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .drop("parts")
    )
    right = counted.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select(
        F.col("a").alias("leader"), "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("share")
    )

    def check(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "ok": []})
        text = y["ta"].iloc[0]
        leader = words_of(text) or [text.encode("utf-8", "surrogatepass")]
        ok = [similar(leader, words_of(t) or [t.encode("utf-8", "surrogatepass")]) for t in x["tb"]]
        return pd.DataFrame({"a": x["a"], "b": x["b"], "ok": ok})

    return left.groupBy("a", "part").cogroup(right.groupBy("leader", "share")).applyInPandas(check, "a bigint, b bigint, ok boolean")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written table of one text for each node; the documents are shuffled once for all rounds."""
    k1, k2 = row_keys("text")
    raw = docs.where("text is not null and text != ''").select(k1.alias("k1"), k2.alias("k2"), "text")
    pointer = cut(nodes.select("node", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")))
    return stored(raw.join(pointer, ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text")), "texts")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links ``a, b`` that connect all candidates of every bucket that align."""
    bands = F.array(*[F.xxhash64(F.lit(b), F.col("sketch")[i], F.col("sketch")[j]) for b, (i, j) in enumerate(_PAIRS)])
    member = nodes.select("node", F.posexplode(bands).alias("band", "value"))
    buckets = member.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    in_buckets = stored(member.join(stored(buckets, "buckets"), ["band", "value"]), "members")
    lanes = [
        F.aggregate(F.slice("sketch", k + 1, LANES), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 8).bitwiseOR(x.bitwiseAND(127)))
        for k in range(0, SKETCHES, LANES)
    ]
    details = nodes.select("node", "n_words", F.xxhash64("node").alias("order"), *[x.alias(f"lane{i}") for i, x in enumerate(lanes)])
    open_ = stored(in_buckets.join(details, "node"), "open")
    texts = _texts(docs, nodes.join(cut(open_.select("node").distinct()), "node"))
    count = len(lanes)
    ones, tops = int("7f" * LANES, 16), int("80" * LANES, 16)

    def agreeing():
        """Sketches that agree: lanes whose difference is zero."""
        total = F.lit(-(LANES * count - SKETCHES))
        for i in range(count):
            apart = F.col(f"o.lane{i}").bitwiseXOR(F.col(f"h.lane{i}"))
            total = total + LANES - F.bit_count((apart + F.lit(ones)).bitwiseAND(F.lit(tops)))
        return total

    head = open_.groupBy("band", "value").agg(F.min(F.struct("order", "node", "n_words", *[f"lane{i}" for i in range(count)])).alias("h"))
    head = stored(head.select("band", "value", "h.order", F.col("h.node").alias("leader"), F.col("h.n_words").alias("m"), *[f"h.lane{i}" for i in range(count)]), "leaders")
    near = (F.least("m", "n_words") >= F.lit(SIMILARITY) * F.greatest("m", "n_words") - 1e-6)
    met = open_.alias("o").join(head.alias("h"), ["band", "value"]).where((F.col("node") != F.col("leader")) & near & (agreeing() >= SHARED))
    slim = stored(met.select("node", "leader", F.col("h.order").alias("first")).distinct(), "met")
    # Every member is aligned with its first leader; a pair whose ends then share that leader is connected already.
    start = cut(slim.groupBy("node").agg(F.min_by("leader", F.struct("first", "leader")).alias("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")))
    one = cut(_verified(start, texts).where("ok").select("a", "b"))
    root = lambda name: one.select(F.col("b").alias(name), F.col("a").alias(f"{name}_root"))
    rooted = slim.join(root("node"), "node", "left").join(root("leader"), "leader", "left")
    same = F.coalesce("node_root", "node") == F.coalesce("leader_root", "leader")
    rest = rooted.where(~same).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    wanted = cut(rest.join(start.select("a", "b"), ["a", "b"], "left_anti"))
    two = cut(_verified(wanted, texts).where("ok").select("a", "b"))
    return _closing_links(open_, one.union(two), start.select("a", "b").union(wanted.select("a", "b")), texts, agreeing())


def _closing_links(members: DataFrame, links: DataFrame, tried: DataFrame, texts: DataFrame, agreeing: Column) -> DataFrame:
    """``links``, and what connects candidates of one bucket in different components.

    A round aligns the first members of a bucket's components with each other, and the next one more of them, until all
    have been. Components that a link has joined are one from then on, so a large group of copies meets itself no more.
    """
    component = cut(connected_components(members.select("node").distinct(), links, "node"))
    near = F.least("o.n_words", "h.n_words") >= F.lit(SIMILARITY) * F.greatest("o.n_words", "h.n_words") - 1e-6
    apart = (F.col("o.component") != F.col("h.component")) & (F.col("o.node") > F.col("h.node"))
    at = lambda name: component.select(F.col("node").alias(name), F.col("component").alias(f"{name}_root"))
    tried = cut(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    most = CLOSING
    while True:
        placed = members.join(component, "node")
        mixed = placed.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        members = stored(placed.join(cut(mixed.select("band", "value")), ["band", "value"]), "mixed")
        largest = members.groupBy("band", "value", "component").count().agg(F.max("count")).first()[0]
        if largest is None:
            return links
        place = F.row_number().over(Window.partitionBy("band", "value", "component").orderBy("order", "node"))
        first = stored(members.withColumn("place", place).where(F.col("place") <= most).drop("place"), "first")
        met = first.alias("o").join(first.alias("h"), ["band", "value"]).where(apart & near & (agreeing >= SHARED))
        pairs = met.select(F.col("h.node").alias("a"), F.col("o.node").alias("b")).distinct()
        fresh = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        good = cut(_verified(fresh, texts).where("ok").select("a", "b"))
        links = links.union(good)
        if largest <= most:
            return links
        if not good.isEmpty():
            joined = good.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            before = component.select("node", F.col("component").alias("before"))
            component = cut(before.join(connected_components(before.select("before").distinct(), joined, "before"), "before").select("node", "component"))
        tried, members = tried.union(fresh), members.drop("component")
        most *= CLOSING


def classes(docs: DataFrame) -> DataFrame:
    """``k1, k2, node, class_id`` of every distinct text, and ``class_node``: the node that stands for the class."""
    sketched = cut(sketch(docs))
    nodes = cut(sketched.groupBy("node").agg(
        F.min("doc_id").alias("id"), F.first("n_words").alias("n_words"), F.min_by("sketch", F.struct("k1", "k2")).alias("sketch"), F.min(F.struct("k1", "k2")).alias("k")
    ))
    component = cut(connected_components(nodes, links(nodes, docs), "node"))
    named = nodes.join(component, "node").groupBy("component").agg(
        F.min("id").alias("class_id"), F.coalesce(F.min_by("node", "id"), F.min("node")).alias("class_node")
    )
    known = sketched.select("k1", "k2", "node").distinct()
    return known.join(component, "node").join(cut(named), "component").select("k1", "k2", "node", "class_id", "class_node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, kept (the document that stays), in any order."""
    k1, k2 = row_keys("text")
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(cut(classes(docs)), ["k1", "k2"], "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each class, rows without text as they are."""
    k1, k2 = row_keys("text")
    columns = docs.columns
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    chosen = classes(docs).where("node = class_node").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("class_id").alias("__class"), F.col("class_node").alias("__node"))
    empty = docs.where("text is null or text = ''")
    mine = keyed.join(cut(chosen), ["__k1", "__k2"]).where(F.col("doc_id").eqNullSafe(F.col("__class")))
    # Several rows are left only where an id and its words are repeated.
    repeated = cut(mine.groupBy("__node").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__node"))
    single = mine.join(repeated, "__node", "left_anti").select(*columns)
    row = F.struct(*columns)
    picked = mine.join(repeated, "__node", "left_semi").groupBy("__node").agg(F.first(row).alias("__row")).select("__row.*")
    return single.unionByName(picked).unionByName(empty.select(*columns))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
