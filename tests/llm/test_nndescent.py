"""Links and components against all pairs."""

import numpy as np

from llm import nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows):
    usable = {}
    for i, (_, e, label, _) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e):
            v = np.array(e, dtype=np.float32).astype(float)
            usable[i] = (label, v / np.linalg.norm(v))
    link = {i: [j for j, (l2, w) in usable.items() if j != i and l2 == l and len(w) == len(v) and v @ w >= nndescent.COSINE] for i, (l, v) in usable.items()}
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((row[0], len(link.get(i, [])), min(ids) if ids else None))
    return sorted(out, key=str)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    base = rng.normal(size=(40, 16))
    for k in range(1100):  # a hot label with a large group of near copies around one vector
        v = base[0] + 0.08 * rng.normal(size=16) if k < 700 else rng.normal(size=16)
        rows.append((k, v.tolist(), 1, "x"))
    for k in range(300):
        v = base[k % 40] + rng.choice([0.02, 0.1, 0.2, 0.3]) * rng.normal(size=16)
        rows.append((5000 + k, (v * 10.0 ** rng.integers(-6, 6)).tolist(), int(k % 3), "x"))
    same = [1.0] * 16
    rows += [(7000, same, 2, "x")] * 3 + [(7001, same, None, "x"), (7002, None, 1, "x"), (7003, [0.0] * 16, 1, "x"), (7004, [float("nan")] * 16, 1, "x")]
    rows += [(7005, [None, 1.0], 1, "x"), (7006, [], 1, "x"), (None, same, 2, "x"), (7007, [1.0, 1.0], 2, "x"), (7008, [float("inf"), 1.0], 2, "x")]
    got = nndescent.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_empty_and_single(spark):
    assert nndescent.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = nndescent.near_duplicate_vectors(spark.createDataFrame([(4, [1.0, 0.0], 2, "x")], SCHEMA)).first()
    assert (one["n_links"], one["component_id"], one["kept"]) == (0, 4, True)


def test_full_lists_lose_no_link_between_groups(spark):
    rng = np.random.default_rng(8)

    def group(center, n, first):
        """Vectors at 0.995 of the center, so that members are nearer to each other than to the other group."""
        out = []
        for k in range(n):
            side = rng.normal(size=32)
            side[:2] = 0
            v = 0.995 * center + np.sqrt(1 - 0.995**2) * side / np.linalg.norm(side)
            out.append((first + k, v.tolist(), 1, "x"))
        return out

    one, two = np.eye(32)[0], np.zeros(32)
    two[:2] = 0.95, np.sqrt(1 - 0.95**2)
    rows = group(one, 70, 0) + group(two, 70, 1000)
    got = nndescent.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert {c for _, _, c in want} == {0}
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want


def test_audit_sees_rare_links(spark):
    """A lone link among many vectors without one, split by its components."""
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=16).tolist(), 1, "x") for k in range(1500)]
    rows.append((9000, (np.array(rows[4][1]) + 0.01 * rng.normal(size=16)).tolist(), 1, "x"))
    units = nndescent._signed(nndescent.nodes_of(spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label"))).cache()
    node = {r["vec_id"]: r["node"] for r in units.select("vec_id", "node").collect()}
    lists = spark.createDataFrame([(node[4], node[9000], 0.99), (node[9000], node[4], 0.99)], "node long, other long, cosine double")
    apart = units.selectExpr("node", "node AS component")
    assert nndescent._audit(units, apart, lists) < nndescent.RECALL
