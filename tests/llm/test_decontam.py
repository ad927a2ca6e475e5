"""The FM-index against plain window search."""

import hashlib
import random

from llm import decontam

DOCS = "doc_id long, text string, items string"


def brute(docs, bench):
    windows: dict = {}
    for item, text in bench:
        words = decontam.words_of(text)
        if item is None:
            continue
        for p in range(max(1, len(words) - 12)):
            if words:
                windows.setdefault(tuple(words[p : p + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words, hit, items = decontam.words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if (w := tuple(words[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    items |= windows[w]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def run(spark, docs, bench, **more):
    d = spark.createDataFrame([(*r, "clash") for r in docs], DOCS)
    b = spark.createDataFrame(bench, "item_id long, text string")
    out = decontam.decontaminate(d, b, ["doc_id"], **more).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "Of", "é1", "x9", "über", "and-so", "q", "z", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(k, say(rng.choice([2, 5, 13, 14, 40]))) for k in range(25)] + [(3, say(20)), (90, None), (91, ""), (92, "--"), (None, "the q")]
    docs = [(k, say(rng.randrange(0, 120))) for k in range(60)]
    docs += [(100, " ".join(t for _, t in bench[:6])), (101, None), (102, ""), (None, bench[0][1].upper()), (103, bench[3][1] * 30), (103, bench[3][1] * 30)]
    want = brute(docs, bench)
    assert run(spark, docs, bench) == want
    assert run(spark, docs, bench, block_bytes=300) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_long_repeated_text(spark):
    docs = [(1, "the q " * 30000), (2, "q the " * 10 + "z " * 5)]
    bench = [(1, "the q " * 10), (2, "the q " * 10)]
    assert run(spark, docs, bench) == brute(docs, bench)
