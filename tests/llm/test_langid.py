"""The automaton against substring search, and held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from llm import langid
from llm.common import held_out
from tests.conftest import DATA


def naive(word: str, sample: list[str]) -> int:
    text, phrases, at = f"_{word}_", 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and any(text[at:end] in f"_{s}_" for s in sample):
            end += 1
        at = max(end - 1, at + 1)
        phrases += 1
    return phrases


def test_phrases_equal_substring_search():
    rng = random.Random(1)
    for _ in range(60):
        sample = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 12))]
        keys, targets = langid.build_automaton(list(dict.fromkeys(sample)))
        step = dict(zip(keys.tolist(), targets.tolist(), strict=True))
        for _ in range(30):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert langid.count_phrases(word, step) == naive(word, sample)


def test_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", "en"), (9003, "12 ½ --", "fr"), (9004, "ça " * 20000, None), (None, "the of and", None)], docs.schema)
    learned = langid.learn(docs.unionByName(odd), ~held_out(F.col("doc_id"), 4))
    rows = langid.classify(docs.unionByName(odd), learned).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() + 5
    assert [by[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and by[9001]["score"] == 0
    assert by[9004]["lang_pred"] == "fr"
    known = [r for r in rows if r["lang"] and r["doc_id"] < 9000]
    assert np.mean([r["lang"] == r["lang_pred"] for r in known]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    learned = langid.learn(docs, F.lit(True))
    assert learned == []
    assert langid.classify(docs, learned).first()["lang_pred"] == "und"
    assert langid.classify(docs.limit(0), learned).count() == 0
