"""The divided forms for large groups give what the plain forms give."""

import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import groups
from skyloom.functions.components import connected_components


def _rows(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(50)), i * 700.0, i) for i in range(400)]
    rows += [("cold", rng.random(), i * 90000.0, i) for i in range(7)] + [("one", 2.5, 1.0, 0)]
    return spark.createDataFrame(rows, "k string, v double, t double, i long")


def test_quantiles_of_large_groups(spark):
    df = _rows(spark)
    probs = {"p10": 0.1, "p50": 0.5, "p93": 0.93}
    small = {r["k"]: r for r in groups.group_quantiles(df, ["k"], F.col("v"), probs, fits=True).collect()}
    large = {r["k"]: r for r in groups.group_quantiles(df, ["k"], F.col("v"), probs, fits=False).collect()}
    local = df.toPandas()
    for k in small:
        for name, p in probs.items():
            expect = np.percentile(local[local.k == k].v, p * 100)
            assert abs(small[k][name] - expect) < 1e-12
            assert abs(large[k][name] - expect) < 1e-12


def test_size_check(spark):
    df = _rows(spark)
    assert groups.groups_fit(df, ["k"])
    assert not groups.groups_fit(df, ["k"], limit=100)


def test_row_numbers_and_neighbours(spark):
    df = _rows(spark)
    for fn, name in (
        (lambda f: groups.numbered(df, ["k"], "t", ["i"], "out", f), "numbers"),
        (lambda f: groups.neighbours(df, ["k"], "t", ["i"], F.col("v"), 2, 2, "out", f), "neighbours"),
        (lambda f: groups.with_previous(df, ["k"], "t", ["i"], {"out": "v"}, f), "previous"),
    ):
        plain = {(r["k"], r["i"]): r["out"] for r in fn(True).collect()}
        divided = {(r["k"], r["i"]): r["out"] for r in fn(False).collect()}
        assert plain == divided, name


def test_robust_scale(spark):
    df = _rows(spark)
    a = {(r["k"], r["i"]): (r["c"], r["s"]) for r in groups.with_robust_scale(df, ["k"], F.col("v"), "c", "s", True).collect()}
    b = {(r["k"], r["i"]): (r["c"], r["s"]) for r in groups.with_robust_scale(df, ["k"], F.col("v"), "c", "s", False).collect()}
    assert a == b
    assert a[("one", 0)][1] is None


def test_components_match_closure(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + j) for j in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {n: n for n in range(300)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.range(300).withColumnRenamed("id", "n"), spark.createDataFrame(edges, "a long, b long"), "n")
    assert {r["n"]: r["component"] for r in got.collect()} == {n: root(n) for n in range(300)}


def test_rows_without_a_time_number_alike(spark):
    rows = [("a", None, i) for i in range(3)] + [("a", float(i * 50000), 10 + i) for i in range(4)] + [("b", None, 20)]
    df = spark.createDataFrame(rows, "k string, t double, i long")
    for make in (
        lambda f: groups.numbered(df, ["k"], "t", ["i"], "out", f),
        lambda f: groups.neighbours(df, ["k"], "t", ["i"], F.col("i"), 1, 1, "out", f),
        lambda f: groups.with_previous(df, ["k"], "t", ["i"], {"out": "i"}, f),
    ):
        plain, divided = ({r["i"]: r["out"] for r in make(f).collect()} for f in (True, False))
        assert plain == divided
    assert {r["i"]: r["out"] for r in groups.numbered(df, ["k"], "t", ["i"], "out", False).collect()}[10] == 4
