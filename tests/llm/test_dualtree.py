"""Codes and codebooks equal to plain Lloyd rounds in unbounded integers."""

import hashlib
import math

import numpy as np
import pytest

from llm import dualtree


def _nearest(point, entries):
    return min((sum((a - b) ** 2 for a, b in zip(point, e, strict=True)), k) for k, e in enumerate(entries))


def _plain(rows, parts, entries, rounds, scale):
    """rows: (id, vector); returns {id: (code, error)} and the codebooks."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort()
    width = len(kept[0][1]) // parts
    cut = lambda q: [q[k * width : (k + 1) * width] for k in range(parts)]
    books = [[cut(q)[k] for _, q in kept[:entries]] for k in range(parts)]
    for _ in range(rounds):
        for k, book in enumerate(books):
            members = {}
            for _, q in kept:
                members.setdefault(_nearest(cut(q)[k], book)[1], []).append(cut(q)[k])
            books[k] = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else e for j, e in enumerate(book)]
    out = []
    for i, q in kept:
        found = [_nearest(p, b) for p, b in zip(cut(q), books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out), books


def _vectors(n, length, seed, spread=0.3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (5, length))
    return (centres[draw.integers(0, 5, n)] + draw.normal(0, spread, (n, length))).astype(float)


def _rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("spread", [0.01, 0.5])
def test_trees_assign_as_integers_do(spread):
    points = np.floor(_vectors(3_000, 8, 3, spread) * 4096).astype(np.int64)
    points[1_000:2_000] = points[5]  # a pile in one place
    entries = points[:13].tolist() + [points[2].tolist()] + [[0] * 8, [1] * 8]
    tree, book = dualtree.Tree.build(points, 16), dualtree.Codebook(entries)
    codes, count, total = dualtree.assign(dualtree.Tree.unpack(tree.pack()), book)
    want = [_nearest(points[i].tolist(), entries)[1] for i in tree.order]
    assert codes.tolist() == want
    for k in range(16):
        members = tree.points[codes == k]
        assert count[k] == len(members) and total[k].tolist() == members.sum(axis=0).tolist()


def test_ties_go_to_the_lower_entry():
    points = np.array([[0, 0], [1, 1], [5, 5], [4, 6]] * 30, dtype=np.int64)
    entries = [[2, 0], [0, 2], [0, 2], [5, 5], [3, 5], [5, 7]]
    tree = dualtree.Tree.build(points, 4)
    codes, _, _ = dualtree.assign(tree, dualtree.Codebook(entries))
    assert codes.tolist() == [_nearest(p.tolist(), entries)[1] for p in tree.points]


def test_large_components_stay_exact():
    big = dualtree.LIMIT - 10
    points = np.array([[big, -big], [big - 1, -big], [-big, big], [3, 4]], dtype=np.int64)
    entries = [[-big, big - 1], [big, -big + 1], [0, 0]]
    tree = dualtree.Tree.build(points, 16)
    codes, _, _ = dualtree.assign(tree, dualtree.Codebook(entries))
    assert codes.tolist() == [_nearest(p.tolist(), entries)[1] for p in tree.points]
    assert dualtree.squared(points[:1], points[2:3])[0] == 8 * big**2


def test_equal_to_plain_rounds_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "BLOCK_ROWS", 64)
    vectors = _vectors(400, 16, 7)
    rows = [(i, v.tolist(), i % 3 or None) for i, v in enumerate(vectors)]
    rows += [(1_000 + i, vectors[9].tolist(), 1) for i in range(200)]  # a third in one place
    rows += [(2_000, None, 1), (2_001, [None] + [0.0] * 15, 1), (2_002, [math.nan] + [0.0] * 15, 2), (2_003, [math.inf] + [0.0] * 15, 2), (2_004, [-math.inf] * 16, None)]
    rows += [(3, vectors[3].tolist(), 7), (3, vectors[3].tolist(), 7)]  # repeated rows
    coded, books = dualtree.compress(_rows(spark, rows), parts=4, entries=16, rounds=6)
    want, want_books = _plain([(i, v) for i, v, _ in rows], 4, 16, 6, 4096)
    assert books == want_books
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == want


def test_few_rows_other_lengths_and_clashing_columns(spark):
    rows = [(None, [1.0] * 8, 1), (2, [0.5] * 8, 1), (5, [0.25] * 7, 1), (6, [], 1), (7, [2.0] * 16, 1), (8, [1e300] * 8, 1)]
    frame = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<double>, label int, code string, _q int")
    coded, books = dualtree.compress(frame)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in coded.collect()}
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
    assert got == {None: ("01" * 8, 0), 2: ("00" * 8, 0)}
    assert books == [[[2048], [4096]]] * 8


def test_empty_table(spark, tmp_path):
    empty = _rows(spark, [(1, None, 1)])
    assert dualtree.compress(empty)[0].collect() == []
    empty.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert dualtree.op12_vector_codes(spark, str(tmp_path)).collect() == []


def test_query_digests(spark, tmp_path):
    rows = [(i, v.tolist(), (None, 1, 2)[i % 3]) for i, v in enumerate(_vectors(120, 16, 1))]
    _rows(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = _plain([(i, v) for i, v, _ in rows], 8, 16, 6, 4096)
    label = {i: x for i, _, x in rows}
    sums = {x: sum(e for i, _, e in want if label[i] == x) for x in (None, 1, 2)}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = sorted(tuple(r) for r in dualtree.op12_vector_codes(spark, str(tmp_path)).collect())
    assert got == [(i, c, e, sums[label[i]], digest) for i, c, e in want]
