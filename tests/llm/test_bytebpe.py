"""Ids equal to tiktoken's over given and odd texts, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from llm import bytebpe
from tests.conftest import DATA

ODD = [
    None, "", " ", "\n\n \t x", "don't'll 'Re", "áë 日本語 текст עברית", "\x00\x1c\x85  y", "🙂🙂 👩‍👩‍👧", "<unk> <s> </s>", "▁a ▁",
    "x" * 20_000, " " * 5_000 + "z", "ab" * 3_000, "1234567890" * 50, "ĀāĂăǿ", "same", "same",
]


def _tiktoken(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return bytebpe.load_ranks(public_tokenizers.path(bytebpe.VOCABULARY))


def test_ids_equal_tiktoken(ranks):
    encoder, plain = bytebpe.Encoder(*bytebpe.serialise(ranks), public_tokenizers.PATTERN), _tiktoken(ranks)
    draw = random.Random(5)
    alphabet = "abcdeéßжя日本  \n'.,-0123ABC­́🙂"
    texts = [t for t in ODD if t] + ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(3_000)]
    texts += [bytes(draw.choices(range(256), k=30)).decode("latin-1") for _ in range(500)]
    for text in texts:
        assert encoder.encode(text).tolist() == plain.encode_ordinary(text)


def test_unreachable_token_is_taken_whole_only_as_a_pre_token():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 300, b" abcd": 301}
    encoder, plain = bytebpe.Encoder(*bytebpe.serialise(ranks), public_tokenizers.PATTERN), _tiktoken(ranks)
    for text in ("abcd", "abcde", " abcd abcd", "ababab"):
        assert encoder.encode(text).tolist() == plain.encode_ordinary(text)
    assert encoder.encode("abcd").tolist() == [300]


def test_forgetting_changes_nothing(ranks, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 100)
    encoder, plain = bytebpe.Encoder(*bytebpe.serialise(ranks), public_tokenizers.PATTERN), _tiktoken(ranks)
    for text in [f"word{i} other words {i % 7}" for i in range(300)]:
        assert encoder.encode(text).tolist() == plain.encode_ordinary(text)


def test_round_trip_and_other_columns(spark, ranks):
    rows = [(i, t, "kept", i) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, decoded string, ids int")
    got = bytebpe.decode(bytebpe.encode(docs))
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    plain = _tiktoken(ranks)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_decoding_odd_ids(spark, ranks):
    a = ranks[b"a"]
    rows = [(1, None), (2, []), (3, [a, None, -5, 10**6, a])]
    got = {r["k"]: r["decoded"] for r in bytebpe.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == b"aa"


def test_empty_table(spark):
    assert bytebpe.decode(bytebpe.encode(spark.createDataFrame([], "text string"))).collect() == []


def test_query_over_all_documents(spark, ranks):
    plain = _tiktoken(ranks)
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.op11_byte_bpe(spark, DATA).collect()}
    assert got == want
