"""Product codes of vectors by dual-tree Lloyd.

Components become integers ``floor(scale * x)``; vectors are cut into equal consecutive parts and every part position gets
a codebook by Lloyd's rounds. Blocks of rows hold, for each part position, a tree over their parts with a box, a count and
a cached sum in every node; a round walks this tree together with a tree over the codebook's entries. Distance bounds of a
pair of nodes prune combinations, a node with one entry left is assigned whole by its cached sum, and leaves that stay
uncertain are decided by integer distances (ties: the lower index), so that the result is exact.

Blocks are built once and kept as a table in the shared folder. A round sends the codebooks (``entries`` times the vector's
length) to the tasks and brings back one sum per part, entry and component, added up by Spark. Rows are never shuffled.

Defined results: rows with a null vector, with null or non-finite components, or with components from ``LIMIT / scale`` on
are dropped, as are vectors whose length is not that of the first kept row, in the order of ids (then components, null ids
last), with a positive multiple of ``parts`` components. Fewer rows than entries make a smaller codebook; equal rows stay
apart; errors beyond a long stay at its maximum; other columns pass through, ``code``, ``error`` and ``_q`` of the
input are dropped or replaced; no kept row gives no rows.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are below this size in scaled integers.
LIMIT = 1 << 40
#: Integer distances fit 64 bits while components are below this size; larger ones use unbounded integers.
NARROW = 1 << 27
BLOCK_ROWS = 1 << 14
LEAF_ROWS = 16
LONG_MAX = (1 << 63) - 1
#: Bounds are computed in doubles; a decision by bounds needs this relative margin.
MARGIN = 1e-9


def _exact(values: np.ndarray) -> np.ndarray:
    """The same integers in a type whose squared distances cannot overflow."""
    return values if values.size == 0 or np.abs(values).max() < NARROW else values.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return ((_exact(a) - _exact(b)) ** 2).sum(axis=1)


@dataclass
class Tree:
    """A balanced tree: node i has children 2i+1 and 2i+2; its rows are ``points[start[i]:end[i]]``."""

    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @property
    def inner(self) -> int:
        """Number of nodes with children; they come first."""
        return len(self.start) // 2

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth = max(0, (-(-n // leaf) - 1).bit_length())
        order = np.arange(n)
        edges = [np.array([0, n])]
        for _ in range(depth):
            e = edges[-1]
            middle = (e[:-1] + e[1:]) // 2
            for a, m, b in zip(e[:-1].tolist(), middle.tolist(), e[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                rows = points[order[a:b]]
                axis = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
                order[a:b] = order[a:b][np.argpartition(rows[:, axis], m - a)]
            edges.append(np.sort(np.concatenate([e, middle])))
        start = np.concatenate([e[:-1] for e in edges])
        end = np.concatenate([e[1:] for e in edges])
        sorted_points = points[order]
        parts = [[f(sorted_points, e[:-1], axis=0) for e in edges] for f in (np.minimum.reduceat, np.maximum.reduceat, np.add.reduceat)]
        return cls(order, sorted_points, start, end, *(np.concatenate(p) for p in parts))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**arrays)


class Codebook:
    """The entries of one part position and the tree over them; an entry equal to a lower one never wins and is left out."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, dtype=np.int64)
        first = sorted(np.unique(self.entries, axis=0, return_index=True)[1].tolist())
        tree = Tree.build(self.entries[first], 1)
        self.low, self.high, self.inner = tree.low.astype(float), tree.high.astype(float), tree.inner
        self.single = np.full(len(tree.start), -1)
        for node in range(len(tree.start)):
            if tree.end[node] - tree.start[node] == 1:
                self.single[node] = first[tree.order[tree.start[node]]]

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and nodes after a step down; single entries stay."""
        split = self.single[nodes] < 0
        places = np.repeat(np.arange(len(nodes)), 1 + split)
        out = np.repeat(nodes, 1 + split)
        second = np.concatenate([[False], places[1:] == places[:-1]]) if len(places) else np.zeros(0, bool)
        out = np.where(split[places], 2 * out + 1 + second, out)
        return places, out


def assign(tree: Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry of every point in the tree's order; counts and component sums per entry."""
    codes = np.full(len(tree.points), -1)
    count = np.zeros(len(book.entries), dtype=np.int64)
    total = np.zeros(book.entries.shape, dtype=np.int64)
    low, high = tree.low.astype(float), tree.high.astype(float)
    p, e = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # pairs of nodes, those of a point node together
    while len(p):
        p, e = _prune(p, e, low, high, book)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        alone = np.diff(np.append(first, len(p))) == 1
        whole = alone & (book.single[e[first]] >= 0)
        nodes, winners = p[first[whole]], book.single[e[first[whole]]]
        for a, b, w in zip(tree.start[nodes].tolist(), tree.end[nodes].tolist(), winners.tolist(), strict=True):
            codes[a:b] = w
        np.add.at(count, winners, tree.end[nodes] - tree.start[nodes])
        np.add.at(total, winners, tree.total[nodes])
        open_ = ~whole[group]
        p, e = p[open_], e[open_]
        ready = (p >= tree.inner) & _all_of_group(p, book.single[e] >= 0)
        if ready.any():
            _decide(tree, book, p[ready], book.single[e[ready]], codes, count, total)
            p, e = p[~ready], e[~ready]
        places, e = book.expand(e)
        p = p[places]
        split = p < tree.inner
        p, e = np.concatenate([p[~split], 2 * p[split] + 1, 2 * p[split] + 2]), np.concatenate([e[~split], e[split], e[split]])
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
    return codes, count, total


def _all_of_group(keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Whether all flags of the run of equal keys are set."""
    if not len(keys):
        return flags
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.repeat(np.logical_and.reduceat(flags, first), np.diff(np.append(first, len(keys))))


def _prune(p: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Drop pairs whose least distance is beyond another pair's greatest, and single entries that another beats in all of the box."""
    gap = np.maximum(0, np.maximum(low[p] - book.high[e], book.low[e] - high[p]))
    reach = np.maximum(high[p] - book.low[e], book.high[e] - low[p])
    least, most = (gap**2).sum(axis=1), (reach**2).sum(axis=1)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    sizes = np.diff(np.append(first, len(p)))
    keep = least <= np.repeat(np.minimum.reduceat(most, first), sizes) * (1 + MARGIN) + MARGIN
    # The single entry nearest to the middle of the box, if there is one, against each other single entry.
    single = book.single[e] >= 0
    middle = (((low[p] + high[p]) / 2 - book.low[e]) ** 2).sum(axis=1)
    middle[~single] = np.inf
    best = np.lexsort((middle, p))[first]
    rival = np.repeat(best, sizes)
    a, b = book.low[e[rival]], book.low[e]
    slope = 2 * (b - a)
    size = (a**2 + b**2 + np.maximum(np.abs(low[p]), np.abs(high[p])) ** 2).sum(axis=1)
    worst = (a**2 - b**2 + np.maximum(slope * low[p], slope * high[p])).sum(axis=1)  # greatest d(x, a) - d(x, b) in the box
    keep &= ~(single & single[rival] & (e != e[rival]) & (worst < -MARGIN * (size + 1)))
    return p[keep], e[keep]


def _decide(tree: Tree, book: Codebook, p: np.ndarray, entry: np.ndarray, codes: np.ndarray, count: np.ndarray, total: np.ndarray) -> None:
    """Integer distances of the points of uncertain leaves to their remaining entries."""
    order = np.lexsort((entry, p))
    p, entry = p[order], entry[order]
    size = tree.end[p] - tree.start[p]
    row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(tree.start[p], size)
    choice = np.repeat(entry, size)
    order = np.lexsort((choice, row))
    row, choice = row[order], choice[order]
    distance = squared(tree.points[row], book.entries[choice])
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    nearest = np.repeat(np.minimum.reduceat(distance, first), np.diff(np.append(first, len(row))))
    hit = np.flatnonzero(distance == nearest)
    hit = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
    codes[row[hit]] = choice[hit]
    np.add.at(count, choice[hit], 1)
    np.add.at(total, choice[hit], tree.points[row[hit]])


def scaled(vectors: DataFrame, vector: str, order: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """Usable rows with ``_q``, their scaled integers, and the length of all of them (0: no usable row)."""
    x = F.col(vector)
    usable = F.coalesce(F.forall(x, lambda v: F.abs(v.cast("double") * scale) < float(LIMIT)), F.lit(False))
    rows = vectors.where(usable).withColumn("_q", F.transform(x, lambda v: F.floor(v.cast("double") * scale)))
    fits = rows.where((F.size("_q") > 0) & (F.size("_q") % parts == 0))
    first = fits.orderBy(F.col(order).asc_nulls_last(), "_q").select(F.size("_q")).first()
    length = first[0] if first else 0
    return rows.where(F.size("_q") == length), length


def blocks_of(rows: DataFrame, parts: int, length: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Table ``rows, trees``: a block's other columns as an Arrow stream, and a packed tree for each part position."""
    width = length // parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat = batch.column("_q").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            trees = [Tree.build(np.ascontiguousarray(flat[:, k * width : (k + 1) * width]), LEAF_ROWS).pack() for k in range(parts)]
            kept = batch.drop_columns(["_q"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, kept.schema) as writer:
                writer.write_batch(kept)
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["rows", "trees"])

        for batch in batches:
            while batch.num_rows:
                room = block_rows - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) == block_rows:
                    yield block(pa.concat_batches(waiting))
                    waiting = []
        if waiting:
            yield block(pa.concat_batches(waiting))

    return rows.mapInArrow(build, "rows binary, trees array<binary>")


def refine(blocks: DataFrame, codebooks: list[list[list[int]]]) -> list[list[list[int]]]:
    """One round: the floored mean of the parts of each entry; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for trees in batch.column("trees"):
                for part, (data, book) in enumerate(zip(trees, books, strict=True)):
                    _, count, total = assign(Tree.unpack(data.as_py()), book)
                    for entry in np.flatnonzero(count).tolist():
                        for at, value in enumerate([*total[entry].tolist(), int(count[entry])]):
                            sums[part, entry, at] = sums.get((part, entry, at), 0) + value
        keys = list(zip(*sums, strict=True)) if sums else [(), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array([str(v) for v in sums.values()], pa.string())], names=["part", "entry", "at", "total"])

    found = (
        blocks.select("trees").mapInArrow(run, "part int, entry int, at int, total string")
        .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    sums = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in found.collect()}  # parts x entries x components at most

    def entry_after(part: int, k: int, entry: list[int]) -> list[int]:
        n = sums.get((part, k, len(entry)), 0)
        return [sums[part, k, at] // n for at in range(len(entry))] if n else entry

    return [[entry_after(part, k, entry) for k, entry in enumerate(book)] for part, book in enumerate(codebooks)]


def label_codes(blocks: DataFrame, codebooks: list[list[list[int]]], schema) -> DataFrame:
    """The rows of the blocks with ``code`` and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in codebooks]
        for batch in batches:
            for rows, trees in zip(batch.column("rows"), batch.column("trees"), strict=True):
                (kept,) = pa.ipc.open_stream(rows.as_py())
                codes = np.zeros((kept.num_rows, len(books)), dtype=np.uint8)
                error = np.zeros(kept.num_rows, dtype=object)
                for part, (data, book) in enumerate(zip(trees, books, strict=True)):
                    tree = Tree.unpack(data.as_py())
                    found, _, _ = assign(tree, book)
                    codes[tree.order, part] = found
                    error[tree.order] += squared(tree.points, book.entries[found]).astype(object)
                new = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(np.minimum(error, LONG_MAX).tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept.schema.names, "code", "error"])

    return blocks.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Kept rows with ``code`` (two hex digits per part) and ``error``, and the codebooks by part, entry, component."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part")
    vectors = vectors.drop("code", "error", "_q")
    rows, length = scaled(vectors, vector, order, parts, scale)
    schema = vectors.select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema
    if not length:
        return vectors.sparkSession.createDataFrame([], schema), [[] for _ in range(parts)]
    width = length // parts
    start = [r["_q"] for r in rows.orderBy(F.col(order).asc_nulls_last(), "_q").limit(entries).select("_q").collect()]
    codebooks = [[list(q[k * width : (k + 1) * width]) for q in start] for k in range(parts)]
    blocks = stored(blocks_of(rows, parts, length), "part-trees")
    for _ in range(rounds):
        codebooks = refine(blocks, codebooks)
    return label_codes(blocks, codebooks, schema), codebooks


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()
    coded = coded.select("vec_id", "label", "code", "error")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _oracle() -> str:
    steps = [
        """WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS id, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
        FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS MATERIALIZED (SELECT id, vec_id, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, range(8) AS r(p)),
        e0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS w FROM parts QUALIFY k < 16)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT id, p, v, min([d, k]) AS best FROM (
            SELECT id, p, v, k, list_sum([(v[i] - w[i]) * (v[i] - w[i]) FOR i IN range(1, len(v) + 1)])::BIGINT AS d FROM parts JOIN e{r} USING (p)
            ) GROUP BY id, p, v)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""e{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m, w) AS w FROM e{r} LEFT JOIN (
                SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
                SELECT p, best[2] AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL
                ) GROUP BY p, k) USING (p, k))"""
            )
    return ",\n".join(steps) + f""",
    coded AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, k)) FROM e{ROUNDS}) AS codebooks_sha256
    FROM kept JOIN coded USING (id)"""


ORACLE = _oracle()
