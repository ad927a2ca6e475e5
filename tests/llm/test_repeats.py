"""Suffix order against Python's sort, and removal against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm import repeats
from llm.anchors import LENGTH
from tests.conftest import DATA


def test_order_equals_sorting():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 2), (2, 1), (50, 2), (700, 1), (3000, 3), (2000, 200)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        if size == 3000:
            text[1000:1600] = text[200:800]
        data = text.tobytes()
        order, _ = repeats.suffix_order(text)
        assert sorted(order.tolist()) == list(range(size))
        keys = [data[p : p + LENGTH] for p in order]
        assert keys == sorted(keys)


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + LENGTH] for _, t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - LENGTH + 1):
            if count[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    out = repeats.remove_repeats(docs.select("doc_id", "text"), ["doc_id"], **more).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")), (F.size("spans") / 2).cast("long"), F.sha2("kept_bytes", 256)
    )
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_all_windows(spark):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = say(330), say(90) + "\n"
    rows = [(k, say(rng.randrange(0, 400)) + passage[rng.randrange(90) : 330 - rng.randrange(90)] + say(rng.randrange(300))) for k in range(60)]
    rows += [(100 + k, say(120) + line * k + say(50)) for k in range(6)]
    rows += [(200, "a" * 199), (201, "a" * 200), (202, "b" * 201), (203, "xy" * 900), (204, None), (205, ""), (206, say(700)), (None, say(250))]
    rows += [rows[3], rows[3], (207, rows[5][1])]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, together=4) == want  # the passage's anchors are now hot and split


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
