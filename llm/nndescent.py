"""Near-duplicate embeddings by NN-descent within each label.

1. Equal vectors of a label collapse to one node with a count.
2. Neighbour lists start from cells of random hyperplanes (large cells are split by hash) and are refined: every node
   compares its neighbours and reverse neighbours with each other, and each of them keeps its best. Lists that hold only
   links are saturated and grow. Rounds end when few entries change.
3. Threshold edges give components. A list that once was full of links may have pushed out others, so crowded nodes
   (``K`` links or more) of different components are compared exactly: cells by the angle to a pivot, of which only those
   that the triangle inequality leaves open are multiplied out, and one edge of each joins its components.
4. A hashed sample of vectors (with links, nearly with links, any) is compared with all rows of its label in blocks: the
   audit, after every list length. Too low a recall starts further rounds with longer lists; where those are at
   ``K_MOST`` already, all nodes are compared exactly as in 3.
5. Links are then counted exactly inside every component by the same cells: the triangle inequality settles most pairs
   of cells without looking at vectors; only the others are multiplied out, cell by cell in double precision. Pairs are
   never emitted.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label, link
with nothing (n_links 0, component their own vec_id); equal rows link with each other; a vec_id may be null or repeated;
vectors of different lengths do not link; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, stored
from skyloom.functions.components import connected_components

COSINE = 0.93
K = 12
K_MOST = 48
REVERSE = 12
TABLES = 5
BITS = 14
CELL = 96
ROUNDS = 6
CHANGED = 0.002
AUDIT = 200
#: Below the threshold by this much, a best neighbour still makes a node one of the audit's second sample.
NEAR = 0.1
RECALL = 0.99
BLOCK = 512
#: Pivots compared with each other in one task.
PIVOTS = 4096
BIN_DEGREES = 2.0
SEED = 77


def _unit(rows: pa.Array | list) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that neither tiny nor huge numbers lose the norm
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``node, group (label and length), copies, vec_id (smallest), vector`` of the usable rows."""
    usable = (
        vectors.where("label is not null and embedding is not null")
        .withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .where(F.exists("vector", lambda x: x != 0))
    )
    group = F.xxhash64(F.col("label").cast("string"), F.size("vector"))
    same = usable.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    return same.withColumn("group", group).withColumn("node", F.monotonically_increasing_id())


def _signed(nodes: DataFrame) -> DataFrame:
    """Adds ``x`` (unit vector, double) and ``bits``: one hyperplane signature per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            signature, unit = np.zeros((len(vectors), TABLES), dtype=np.int64), [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                x = _unit([vectors[i] for i in at])
                planes = np.random.default_rng(SEED).normal(size=(size, TABLES * BITS))
                sides = (x @ planes > 0).reshape(len(at), TABLES, BITS)
                signature[at] = (sides << np.arange(BITS)).sum(axis=2)
                for i, row in zip(at, x, strict=True):
                    unit[i] = row.tobytes()
            columns = [batch.column(c) for c in ("node", "group", "copies", "vec_id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(unit, pa.binary()), pa.array(signature.tolist(), pa.list_(pa.int64()))], names=["node", "group", "copies", "vec_id", "x", "bits"])

    frame = nodes.select("node", "group", F.col("copies").cast("long").alias("copies"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return frame.mapInArrow(run, "node bigint, group bigint, copies bigint, vec_id bigint, x binary, bits array<bigint>")


def _matrix(x: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=np.float64).reshape(len(x), -1).astype(kind, copy=False)


def _cells(vectors: DataFrame) -> DataFrame:
    """``table, cell, part`` of every node: enough signature bits for cells of about ``CELL``, larger ones split by hash."""
    sizes = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / CELL)).cast("int")))
    spread = vectors.join(sizes, "group").select("node", "group", F.posexplode("bits").alias("table", "b"), bits.alias("n"))
    spread = spread.withColumn("cell", F.expr("b & (shiftleft(1L, n) - 1)"))
    parts = F.ceil(F.count(F.lit(1)) / (2 * CELL)).cast("int")
    counts = cut(spread.groupBy("group", "table", "cell").agg(parts.alias("parts")))
    return spread.join(counts, ["group", "table", "cell"]).select(
        "node", F.xxhash64("group", "table", "cell", F.pmod(F.xxhash64("node", "table"), F.col("parts"))).alias("cell"), "table"
    )


def _best(u: np.ndarray, v: np.ndarray, c: np.ndarray, most: int) -> pd.DataFrame:
    """The ``most`` best partners of each u, once each."""
    out = pd.DataFrame({"node": u, "other": v, "cosine": c}).drop_duplicates(["node", "other"])
    out = out.sort_values(["node", "cosine", "other"], ascending=[True, False, True])
    return out[out.groupby("node").cumcount() < most]


def _cell_lists(part: pd.DataFrame) -> pd.DataFrame:
    node, x = part["node"].to_numpy(), _matrix(part["x"], np.float32)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    k = min(K, len(node) - 1)
    if k < 1:
        return pd.DataFrame({"node": [], "other": [], "cosine": []})
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"node": np.repeat(node, k), "other": node[top.ravel()], "cosine": np.take_along_axis(cosine, top, 1).ravel().astype(float)})


def _local_join(edges: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """Neighbours of the same node compared with each other where at least one is new to it."""
    if edges.empty or near.empty:
        return pd.DataFrame({"node": [], "other": [], "cosine": []})
    node, x, floor = near["node"].to_numpy(), _matrix(near["x"], np.float32), near["floor"].to_numpy()
    place = pd.Series(np.arange(len(node)), index=node)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _, own in edges.groupby("center"):
        at, new = place[own["member"]].to_numpy(), own["new"].to_numpy(dtype=bool)
        cosine = x[at] @ x[at].T
        good = (cosine > floor[at][:, None]) & (new[:, None] | new[None, :])
        np.fill_diagonal(good, False)
        i, j = np.nonzero(good)
        found.append((node[at[i]], node[at[j]], cosine[i, j]))
    u, v, c = (np.concatenate(z) for z in zip(*found, strict=True))
    return _best(u, v, c.astype(float), K_MOST)


def _kept(entries: DataFrame, limits: DataFrame | None, most: int) -> DataFrame:
    """The best entries of every list; ``limits`` has the list length of nodes whose list was saturated."""
    once = entries.groupBy("node", "other").agg(F.max("cosine").alias("cosine"), F.min("new").alias("new"))
    if limits is not None:
        once = once.join(limits, "node", "left")
    limit = F.coalesce(F.col("limit"), F.lit(most)) if limits is not None else F.lit(most)
    lists = once.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cosine", "other", "new")), asc=False).alias("e"), F.max(limit).alias("limit"))
    return lists.select("node", "limit", F.explode(F.slice("e", 1, F.col("limit").cast("int"))).alias("e")).select("node", "limit", "e.other", "e.cosine", "e.new")


def _round(vectors: DataFrame, lists: DataFrame, turn: int, most: int) -> DataFrame:
    entering = lists.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(turn), "node", "other"), 11) / float(1 << 53)
    reverse = lists.join(entering, "other").where(chance < F.lit(float(REVERSE)) / F.col("n")).select(F.col("other").alias("center"), F.col("node").alias("member"), "new")
    edges = lists.select(F.col("node").alias("center"), F.col("other").alias("member"), "new").union(reverse)
    edges = edges.groupBy("center", "member").agg(F.max("new").alias("new"))
    chunk = vectors.select(F.col("node").alias("center"), "chunk")
    edges = cut(edges.join(chunk, "center"))
    full = lists.groupBy("node").agg(F.min("cosine").alias("low"), F.count(F.lit(1)).alias("n"), F.max("limit").alias("limit"), F.min((F.col("cosine") >= COSINE).cast("int")).alias("links"))
    state = cut(full.select("node", F.when(F.col("n") < F.col("limit"), F.lit(-2.0)).when(F.col("links") == 1, F.lit(-2.0)).otherwise(F.col("low")).alias("floor"),
                            F.when((F.col("links") == 1) & (F.col("n") >= F.col("limit")), F.least(F.lit(K_MOST), 2 * F.col("limit"))).otherwise(F.greatest(F.col("limit"), F.lit(most))).alias("limit")))
    needed = edges.select("chunk", F.col("member").alias("node")).distinct()
    near = needed.join(vectors.select("node", "x"), "node").join(state.select("node", "floor"), "node", "left").select(
        F.col("chunk").alias("place"), "node", "x", F.coalesce("floor", F.lit(-2.0)).alias("floor")
    )
    found = edges.groupBy("chunk").cogroup(near.groupBy("place")).applyInPandas(_local_join, "node bigint, other bigint, cosine double")
    entries = lists.select("node", "other", "cosine", F.lit(False).alias("new")).union(found.select("node", "other", "cosine", F.lit(True).alias("new")))
    return cut(_kept(entries, state.select("node", "limit"), most))


def _audit(vectors: DataFrame, component: DataFrame, lists: DataFrame) -> float:
    """Share of true links that lie inside one component, over all links or as a mean over nodes (the smaller one).

    Three hashed samples are compared with all rows: nodes with a link in their list, nodes that nearly have one, others.
    """
    best = lists.groupBy("node").agg(F.max("cosine").alias("best"))
    level = F.when(F.col("best") >= COSINE, 0).when(F.col("best") >= COSINE - NEAR, 1).otherwise(2)
    placed = vectors.select("node", "group", "x").join(component, "node")
    levelled = vectors.select("node").join(best, "node", "left").select("node", level.alias("level"))
    chosen = [levelled.where(F.col("level") == n).orderBy(F.xxhash64(F.lit(SEED), "node")).limit(AUDIT).select("node") for n in range(3)]
    sample = placed.join(chosen[0].union(chosen[1]).union(chosen[2]), "node").collect()
    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in {r["group"] for r in sample}:
        own = [r for r in sample if r["group"] == g]
        by[g] = np.array([r["node"] for r in own]), np.array([r["component"] for r in own]), np.stack([np.frombuffer(r["x"]) for r in own])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, own in part.groupby("group"):
                if g in by:
                    query, named, x = by[g]
                    true = x @ _matrix(own["x"]).T >= COSINE
                    true &= query[:, None] != own["node"].to_numpy()[None, :]
                    inside = true & (named[:, None] == own["component"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": query, "n": true.sum(1), "inside": inside.sum(1)})

    counted = placed.mapInPandas(run, "node bigint, n bigint, inside bigint").groupBy("node").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    rows = [(r["n"], r["inside"]) for r in counted.where("n > 0").collect()]
    if not rows:
        return 1.0
    return min(sum(i for _, i in rows) / sum(t for t, _ in rows), sum(i / t for t, i in rows) / len(rows))


def _pivot_pairs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Pairs of components whose balls around their pivots come as near as a link reaches."""
    limit = float(np.degrees(np.arccos(COSINE))) + 1e-3
    found = []
    y, wide, name = _matrix(right["p"]), right["high"].to_numpy(), right["component"].to_numpy()
    for start in range(0, len(left), BLOCK):
        part = left.iloc[start : start + BLOCK]
        own = part["component"].to_numpy()
        apart = np.degrees(np.arccos(np.clip(_matrix(part["p"]) @ y.T, -1, 1)))
        i, j = np.nonzero((apart <= part["high"].to_numpy()[:, None] + wide[None, :] + limit) & (own[:, None] < name[None, :]))
        found.append(pd.DataFrame({"a": own[i], "b": name[j], "apart": apart[i, j]}))
    return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "apart": []})


def _first_link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The components of two cells as an edge if any of their vectors link."""
    none = pd.DataFrame({"a": [], "b": []})
    if left.empty or right.empty or not (_matrix(left["x"]) @ _matrix(right["x"]).T >= COSINE).any():
        return none
    return pd.DataFrame({"a": [left["component"].iloc[0]], "b": [right["component"].iloc[0]]})


def across_components(vectors: DataFrame, component: DataFrame, crowded: DataFrame) -> DataFrame:
    """``node, component`` after all links between crowded nodes of different components, found exactly."""
    member = vectors.select("node", "group", "copies", "x").join(component, "node").join(crowded, "node")
    celled, cells = _celled(member)
    reach = celled.groupBy("component").agg(F.max("angle").alias("high"))
    pivot = _pivots(member).join(reach, "component")
    shares = cut(pivot.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PIVOTS).alias("parts")))
    block = F.xxhash64("group", F.pmod(F.xxhash64("component"), F.col("parts")))
    parted = stored(pivot.join(shares, "group").select("group", block.alias("block"), "component", "p", "high"), "pivots")
    blocks = cut(parted.select("group", "block").distinct())
    two = cut(blocks.select("group", F.col("block").alias("one")).join(blocks.select("group", F.col("block").alias("two")), "group").select("one", "two"))
    left = two.join(parted, F.col("one") == F.col("block")).select("one", "two", "component", "p", "high")
    right = _renamed(two.join(parted, F.col("two") == F.col("block")).select(F.col("one").alias("from"), F.col("two").alias("to"), "component", "p", "high"))
    near = cut(cut(left).groupBy("one", "two").cogroup(right.groupBy("from", "to")).applyInPandas(_pivot_pairs, "a bigint, b bigint, apart double"))
    if near.isEmpty():
        return component
    limit = float(np.degrees(np.arccos(COSINE))) + 1e-3
    a, b = (cells.select(F.col("component").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high")]) for s in "ab")
    open_ = near.join(a, "a").join(b, "b").where(
        (F.col("apart") - F.col("high_a") - F.col("high_b") <= limit)
        & (F.col("low_a") - F.col("apart") - F.col("high_b") <= limit)
        & (F.col("low_b") - F.col("apart") - F.col("high_a") <= limit)
    )
    open_ = cut(open_.select("cell_a", "cell_b"))
    left = celled.join(open_, F.col("cell") == F.col("cell_a")).select("cell_a", "cell_b", "component", "x")
    right = _renamed(celled.join(open_, F.col("cell") == F.col("cell_b")).select(F.col("cell_a").alias("one"), F.col("cell_b").alias("two"), "component", "x"))
    edges = cut(cut(left).groupBy("cell_a", "cell_b").cogroup(right.groupBy("one", "two")).applyInPandas(_first_link, "a bigint, b bigint").distinct())
    if edges.isEmpty():
        return component
    joined = connected_components(component.select(F.col("component").alias("before")).distinct(), edges, "before")
    return cut(component.select("node", F.col("component").alias("before")).join(joined, "before").select("node", "component"))


def neighbour_components(vectors: DataFrame) -> DataFrame:
    """``node, component`` from the refined neighbour graph."""
    cells = _cells(vectors).join(vectors.select("node", "x"), "node")
    start = cells.groupBy("cell").applyInPandas(_cell_lists, "node bigint, other bigint, cosine double")
    lists = cut(_kept(start.withColumn("new", F.lit(True)), None, K))
    count, most, turn = vectors.count(), K, 0
    while True:
        for _ in range(ROUNDS):
            turn += 1
            lists = _round(vectors, lists, turn, most)
            if lists.where("new").count() <= CHANGED * count * K:
                break
        edges = lists.where(F.col("cosine") >= COSINE - 1e-4).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        component = cut(connected_components(vectors, _checked(edges, vectors), "node"))
        links = lists.where(F.col("cosine") >= COSINE - 1e-4).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        component = across_components(vectors, component, cut(links.where(F.col("n") >= K).select("node")))
        if _audit(vectors, component, lists) >= RECALL:
            return component
        if most >= K_MOST:
            return across_components(vectors, component, vectors.select("node"))
        most *= 2
        lists = cut(lists.withColumn("limit", F.greatest("limit", F.lit(most))).withColumn("new", F.lit(True)))


def _checked(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges whose cosine reaches the threshold in double precision."""
    both = edges.join(vectors.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(vectors.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                lengths = p["xa"].map(len)
                for _, own in p.groupby(lengths):
                    good = np.einsum("ij,ij->i", _matrix(own["xa"]), _matrix(own["xb"])) >= COSINE
                    yield own.loc[good, ["a", "b"]]

    return both.mapInPandas(run, "a bigint, b bigint")


def _block_counts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"node": [], "n": []})
    weight = right["copies"].to_numpy()
    linked = _matrix(left["x"]) @ _matrix(right["x"]).T >= COSINE
    linked &= left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None, :]
    return pd.DataFrame({"node": left["node"], "n": linked @ weight})


def _pivots(member: DataFrame) -> DataFrame:
    """``group, component, p``: the vector of each component's smallest member."""
    return member.groupBy("component").agg(F.first("group").alias("group"), F.min_by("x", "node").alias("p"))


def _celled(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with ``angle`` (to the pivot of their component) and ``cell``, and the cells with ``low, high, mass``."""
    sized = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    pivot = _pivots(member).select("component", "p")

    def angles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                part = part.copy()
                part["angle"] = 0.0
                for _, own in part.groupby(part["x"].map(len)):
                    cosine = np.einsum("ij,ij->i", _matrix(own["x"]), _matrix(own["p"]))
                    part.loc[own.index, "angle"] = np.degrees(np.arccos(np.clip(cosine, -1, 1)))
                yield part[["node", "component", "copies", "x", "angle"]]

    placed = member.select("node", "component", "copies", "x").join(pivot, "component").mapInPandas(angles, "node bigint, component bigint, copies bigint, x binary, angle double")
    placed = placed.withColumn("bin", F.floor(F.col("angle") / BIN_DEGREES).cast("int"))
    # A small component is a single cell.
    small = F.col("size") <= BLOCK
    placed = stored(placed.join(sized, "component").withColumn("bin", F.when(small, F.lit(-1)).otherwise(F.col("bin"))).drop("size"), "placed")
    parts = cut(placed.groupBy("component", "bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    celled = placed.join(parts, ["component", "bin"]).withColumn("cell", F.xxhash64("component", "bin", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")
    celled = stored(celled, "cells")
    return celled, cut(celled.groupBy("component", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("mass")))


def count_links(vectors: DataFrame, component: DataFrame) -> DataFrame:
    """``node, n_links``: vectors of the same component at the threshold or above, copies counted."""
    sized = component.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    celled, cells = _celled(vectors.join(component.join(sized.select("component"), "component"), "node"))
    limit, slack = float(np.degrees(np.arccos(COSINE))), 1e-3
    a, b = (cells.select("component", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "low", "high", "mass")]) for s in "ab")
    pairs = cut(a.join(b, "component").where((F.col("low_b") - F.col("high_a") <= limit + slack) & (F.col("low_a") - F.col("high_b") <= limit + slack)))
    sure = F.col("high_a") + F.col("high_b") <= limit - slack
    settled = pairs.where(sure).groupBy("cell_a").agg(F.sum("mass_b").alias("sure"), F.max((F.col("cell_a") == F.col("cell_b")).cast("int")).alias("own"))
    from_cells = celled.select("node", "cell", "copies").join(settled, F.col("cell") == F.col("cell_a")).select(
        "node", (F.col("sure") - F.when(F.col("own") == 1, F.col("copies")).otherwise(0)).cast("long").alias("n")
    )
    open_ = cut(pairs.where(~sure).select("cell_a", "cell_b"))
    left = celled.join(open_, F.col("cell") == F.col("cell_a")).select("cell_a", "cell_b", "node", "x")
    right = celled.join(open_, F.col("cell") == F.col("cell_b")).select(F.col("cell_a").alias("one"), F.col("cell_b").alias("two"), "node", "x", "copies")
    right = right.select("one", "two", F.col("node").alias("node"), "x", "copies")
    counted = cut(left).groupBy("cell_a", "cell_b").cogroup(_renamed(right).groupBy("one", "two")).applyInPandas(_block_counts, "node bigint, n bigint")
    return from_cells.union(counted).groupBy("node").agg(F.sum("n").alias("n_links"))


def _renamed(df: DataFrame) -> DataFrame:
    """The same rows under new attributes, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    plain = vectors.select("vec_id", "embedding", "label")
    nodes = stored(nodes_of(plain), "nodes")
    signed = _signed(nodes)
    chunk = F.xxhash64("group", F.expr(f"bits[0] % {1 << 5}"), F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.lit(nodes.count()) / 8192))))
    units = stored(signed.withColumn("chunk", chunk), "units")
    component = neighbour_components(units)
    counted = count_links(units, component)
    named = component.join(units.select("node", "vec_id"), "node")
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    result = cut(
        named.join(smallest, "component").join(counted, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("others"))
    )
    usable = nodes.select("node", "label", "vector", "copies").join(result, "node")
    keyed = plain.withColumn("vector", F.transform("embedding", lambda x: x.cast("double")))
    keys = lambda: (F.xxhash64(F.lit(1), "label", "vector").alias("h1"), F.xxhash64(F.lit(2), "label", "vector").alias("h2"))
    rows = keyed.select("vec_id", *keys())
    joined = rows.join(cut(usable.select(*keys(), "component_id", (F.col("others") + F.col("copies") - 1).alias("n_links"))), ["h1", "h2"], "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id
"""
