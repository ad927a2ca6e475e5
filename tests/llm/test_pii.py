"""Rules against plain patterns, the gradient against differences, and held-out tagging."""

import random
import re

import numpy as np

from llm import pii
from tests.conftest import DATA

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {0: lambda: True, 1: lambda: all(int(p) <= 255 for p in m[0].split(".")), 2: lambda: 13 <= len(d) <= 19 and pii.luhn(d), 3: lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_rules_equal_patterns(spark):
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab@@..-+() 01259é%") for _ in range(rng.randrange(60)))
        assert pii.rule_spans(text) == plain(text), text
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        assert pii.rule_spans(r["text"]) == plain(r["text"])


def test_gradient():
    rng = np.random.default_rng(1)
    model = pii.Tagger()
    model.w["A"] = rng.normal(0, 0.3, model.w["A"].shape)
    symbols = rng.integers(0, pii.SYMBOLS, (3, pii.WINDOW))
    tags = rng.integers(0, model.TAGS, (3, pii.WINDOW))
    _, grad = model.gradient(symbols, tags)
    for name, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name != "E" else (symbols[0, 3], 2)
        kept = w[at]
        w[at] = kept + 1e-5
        up, _ = model.gradient(symbols, tags)
        w[at] = kept - 1e-5
        down, _ = model.gradient(symbols, tags)
        w[at] = kept
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-4 * max(1, abs(grad[name][at])), name


def test_tagger_learns_and_base_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame(
        [(9001, None), (9002, ""), (9003, "ana.b(at)mail.example.org and 0049 301 234567 or so"), (9004, "1" * 30000), (None, "x@y.zz " * 3000)], docs.schema
    )
    weights = pii.train(docs)
    rows = {r["doc_id"]: r for r in pii.find(docs.unionByName(odd), weights, ["doc_id"]).collect()}
    assert len(rows) == docs.count() + 5
    assert rows[9001]["spans"] == rows[9002]["spans"] == rows[9004]["base"] == []
    assert len(rows[None]["base"]) == 3000
    assert all(set(r["base"]) <= set(r["spans"]) for r in rows.values())
    added = sum(len(r["spans"]) - len(r["base"]) for d, r in rows.items() if d is not None and d < 9000)
    assert added <= 0.05 * sum(len(r["base"]) for r in rows.values())
    model = pii.Tagger(__import__("pickle").loads(weights))
    right = total = 0
    for r in docs.where("doc_id % 3 = 1").collect():
        spans, starts = pii.rule_spans(r["text"]), pii.windows_of(r["text"])
        for s, found in zip(starts, model.decode(pii.encode(r["text"], starts)) if starts else [], strict=True):
            inside = {(k, b - s, e - s) for k, b, e in spans if b >= s and e <= s + pii.WINDOW}
            total += len(inside)
            right += len(inside & {f[0] for f in found})
    assert right / total > 0.7, (right, total)


def test_reconcile_prefers_whole_spans():
    text = "x" * 50 + "0049 301 234567" + "y" * 60
    whole = [((3, 10, 25), 0.99)]
    half = [((3, 0, 5), 0.99)]
    assert pii.reconcile(text, [40, 60], [whole, half], []) == [(3, 50, 65)]
    assert pii.reconcile(text, [40, 60], [whole, half], [(2, 52, 58)]) == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.train(docs) == b""
    assert pii.find(docs, b"", ["doc_id"]).count() == 0
