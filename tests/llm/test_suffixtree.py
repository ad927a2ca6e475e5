"""Counts, kept contexts and scores against a plain dictionary model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import suffixtree
from llm.common import held_out
from tests.conftest import DATA


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows):
    train = [tokens(t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    count = [Counter(tuple(s[i : i + k + 1]) for s in train for i in range(len(s) - k)) for k in range(3)]
    n, v = sum(count[0].values()), len(count[0])
    word = lambda x: (count[0][(x,)] + 1) / (n + v + 1)
    gain, different = defaultdict(float), Counter()
    for k in (1, 2):
        for g, c in count[k].items():
            s = g[:-1]
            if count[k - 1][s] >= suffixtree.LEAST:
                below = word(g[-1]) if k == 1 else count[1][g[1:]] / count[0][g[1:-1]]
                gain[s] += c * math.log(c / count[k - 1][s] / below) + math.log(below)
                different[s] += 1
    kept = {s for s, x in gain.items() if x >= suffixtree.GAIN}
    out = []
    for d, text in rows:
        s, base, score, used = tokens(text), 0.0, 0.0, 0
        for i, x in enumerate(s):
            p = word(x)
            base += math.log10(p)
            deep = 0
            for k in (1, 2):
                c = tuple(s[i - k : i])
                if i >= k and c in kept:
                    p = (count[k][(*c, x)] + different[c] * p) / (count[k - 1][c] + different[c])
                    deep = 1
            score += math.log10(p)
            used += deep
        out.append((d, len(s), sum(count[0][(x,)] > 0 for x in s), n, base, score, used))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, train boolean")
    got = suffixtree.score(docs, ~held_out(F.col("doc_id"), 7)).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6), round(r[5], 3))
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["n_contexts"]) for r in got), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert [r[4] for r in mine] == pytest.approx([r[4] for r in want], rel=1e-9)
    assert np.mean([r[6] == w[6] for r, w in zip(mine, want, strict=True)]) > 0.999  # a gain just at the limit may round
    assert [r[5] for r in mine] == pytest.approx([r[5] for r in want], rel=1e-6)


def test_equals_dictionary_model(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(7001, None), (7002, ""), (7003, " \n\t"), (None, "Über \x00 x\xa0y ÀB ab"), (7004, "the of " * 9000), rows[3], rows[3]]
    check(spark, rows)


def test_held_out_only_and_empty(spark):
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    check(spark, [(only, "a b c a b")])
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixtree.score(docs, F.lit(True)).count() == 0


def test_held_out_text_is_scored_better_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffixtree.score(docs, ~held_out(F.col("doc_id"), 7)).where("not train").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > 0.97 * got[0]


def test_packing():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (suffixtree.unpack_sorted(suffixtree.pack_sorted(values)) == values).all()
    assert len(suffixtree.unpack(suffixtree.pack(values[:0]))) == 0
