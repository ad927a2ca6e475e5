"""Near pairs equal to all pairs compared, words and forms equal to plain code."""

import random
import re
import zlib
from collections import Counter

import pytest

from llm import spelling
from tests.conftest import DATA


def _near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), len(u))
    return u[p + 1 :] == v[p + 1 :] if len(u) == len(v) else u[p:] == v[p + 1 :]


def _words(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def _grouped(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(size, ()) if _near(w, v)]
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def _frame(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n bigint")


@pytest.mark.parametrize("alphabet, size, least, at_once", [("ab", 7, 7, 4096), ("ab", 9, 3, 8), ("abcé", 8, 2, 4), ("aÿ", 6, 1, 2)])
def test_equal_to_all_pairs(spark, alphabet, size, least, at_once):
    draw = random.Random(size)
    words = {}
    for _ in range(600):
        w = "".join(draw.choices(alphabet, k=draw.randint(least, size + 2)))
        words[w] = draw.choice([2, 3, 20, 40, 400, 5_000])
    got = sorted(tuple(r) for r in spelling.group_variants(_frame(spark, words), least, 10, at_once).collect())
    assert got == _grouped(words)


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"walking", "talking", "walked", "talked", "walk", "talk", ""})
    acceptor = spelling.Acceptor(words)
    found, todo = [], [(acceptor.root, "")]
    while todo:
        state, text = todo.pop()
        found += [text] * acceptor.final[state]
        todo += [(s, text + c) for c, s in acceptor.arcs[state].items()]
    assert sorted(found) == words
    assert len({(f, tuple(sorted(a.items()))) for f, a in zip(acceptor.final, acceptor.arcs, strict=True)}) == len(acceptor.arcs) == 9  # the root, a, l, k, the branch, i-n-g and e-d share their end


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaaab": 2, "aaaaaaa": 30, "aaaaaaaa": 30, "aaaaaac": 400, "aaaaacc": 4_000, "aaaaccc": 50_000, "zzzzzzz": 9, "zzzzzzy": 80}
    got = {r["word"]: r for r in spelling.group_variants(_frame(spark, words)).collect()}
    assert [tuple(got[r[0]]) for r in _grouped(words)] == _grouped(words)
    assert got["aaaaaaab"]["form"] == "aaaaaaa" and got["aaaaaaab"]["root"] == "aaaaccc"
    assert got["zzzzzzz"]["form"] is None and got["zzzzzzz"]["n_near"] == 1


def test_long_words(spark):
    base = "xyz" * 5_000
    words = {base: 40, base[:9_000] + base[9_001:]: 3, base[:-1]: 2, "q" + base: 4, base[:7_000] + "ÿ" + base[7_001:]: 5}
    got = sorted(tuple(r) for r in spelling.group_variants(_frame(spark, words)).collect())
    assert got == _grouped(words)


def test_words_of_documents(spark):
    texts = ["Straße Größenordnung größenordnung ÀÉÎÕÜßÿ×÷ ÀÉÎÕÜßÿ×÷", None, "", "short Lettering lettering LETTERING_lettering9lettering", "中文lettering中文 letterings"] * 40
    docs = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    docs += [(7, "mississippi mississippi", "x")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()} == _words([d[:2] for d in docs])


def test_query_equals_plain_code(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in spelling.op13_spelling_variants(spark, DATA).collect())
    assert got == _grouped(_words(docs))


def test_empty_tables(spark):
    assert spelling.group_variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    lone = spelling.group_variants(_frame(spark, {"alonealone": 5})).collect()
    assert [tuple(r) for r in lone] == [("alonealone", None, "alonealone", 5, 0, None)]
