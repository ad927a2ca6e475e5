"""Alignment against plain dynamic programming, and classes against all pairs."""

import random
from collections import Counter

from llm import orderminhash as om
from llm.decontam import words_of
from tests.conftest import DATA


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("abcdef")] * rng.randrange(2)
        limit, want = rng.randrange(0, 30), plain(a, b)
        got = om.edit_distance(a, b, limit)
        assert got == want if want <= limit else got > limit


def brute(rows):
    texts = {d: words_of(t) or [t.encode()] for d, t in rows if t}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if om.similar(texts[x], texts[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {d: find(d) for d in texts} | {d: d for d, t in rows if not t}


def test_classes_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    base = rows[3][1].split()
    near = []
    for k in range(40):  # a group that is larger than one round of leaders
        words = list(base)
        words[(7 * k) % len(words)] = f"x{k}"
        near.append((5000 + k, " ".join(words)))
    rows += near + [(6000, None), (6001, ""), (6002, "!!"), (6003, "!!"), (6004, "a b"), (6005, "a b c")] + [rows[7]]
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    wrong = {r["doc_id"]: (r["class_id"], want[r["doc_id"]]) for r in got if r["class_id"] != want[r["doc_id"]]}
    assert not wrong
    assert all(r["kept"] == (r["class_id"] == r["doc_id"]) for r in got)
    out = om.deduplicate(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, node string"))
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, c in want.items() if d == c)


def test_chains_through_a_member_that_left_the_bucket(spark):
    rows = []
    for k in range(40):  # b links a and c, a and c do not link; where a leads, b leaves with it
        b = [f"k{k}w{i}" for i in range(100)]
        c = b[:80] + [f"k{k}c{i}" for i in range(20)]
        rows += [(10 * k, " ".join(["x", *b[1:]])), (10 * k + 1, " ".join(b)), (10 * k + 2, " ".join(c))]
    want = brute(rows)
    assert set(want.values()) == {10 * k for k in range(40)}
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert om.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three four five six"), (4, "one two three four five six"), (None, None)]
    got = sorted(om.near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted(r["class_id"] or 0 for r in got) == [0, 4, 4]
    assert om.deduplicate(spark.createDataFrame(rows, schema)).count() == 2


def test_rows_of_a_large_group_of_copies_grow_with_its_members(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(500):  # about half of the pairs are within the limit
        words = list(base)
        for at in rng.sample(range(150), 16):
            words[at] = f"k{k}x{at}"
        rows.append((k, " ".join(words)))
    sizes = {}

    def counted(df, name):
        out = plain_stored(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    plain_stored = om.stored
    monkeypatch.setattr(om, "stored", counted)
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert max(Counter(r["class_id"] for r in got).values()) >= 450  # scattered changes leave some without a common band
    assert sizes["met"] <= sizes["members"], sizes  # a member meets the leader of each of its buckets, then only other components
