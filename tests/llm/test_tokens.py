"""The permutation, and exact round trips through records and shard files."""

import tempfile

import numpy as np
import pytest
import tiktoken

from llm import tokens
from tests.conftest import DATA


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    slots = tokens.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 10:
        assert slots.tolist() != list(range(n)) and slots.tolist() != tokens.permute(np.arange(n), n, key=7).tolist()


def _texts(stream, end, encoder):
    cut = np.flatnonzero(stream == end)
    return [encoder.decode(p[:-1].tolist()) for p in np.split(stream, cut + 1) if len(p)]


def test_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    odd = spark.createDataFrame([(None,), ("",), ("a  b \n\n c é日本",), ("same",), ("same",), ("long " * 60000,)], "text string")
    both = docs.union(odd)
    records = tokens.in_training_order(both, length=128, shard_records=100)
    rows = sorted(records.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(len(r["ids"]) == 256 and r["shard"] == r["slot"] // 100 and r["byte_offset"] == r["slot"] % 100 * 256 for r in rows)
    ranks = tokens.load_vocabulary(tokens.VOCABULARY)
    end = max(ranks.values()) + 1
    encoder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    stream = np.concatenate([np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]] for r in sorted(rows, key=lambda r: r["sequence"])])
    assert sorted(_texts(stream, end, encoder)) == sorted(r["text"] or "" for r in both.collect())
    folder = tempfile.mkdtemp(prefix="spark-")
    manifest = tokens.write_shards(records, f"file://{folder}").collect()
    assert sum(m["records"] for m in manifest) == len(rows)
    for m in manifest:
        data = open(m["path"], "rb").read()
        again = b"".join(r["ids"] for r in rows if r["shard"] == m["shard"])
        assert m["first_slot"] == m["shard"] * 100 and data.count(b"") - 1 == len(again)
    order = tokens.in_training_order(both, length=128, shard_records=100).select("slot", "n_tokens").collect()
    assert len(order) == len(rows)


def test_empty_table(spark):
    assert tokens.in_training_order(spark.createDataFrame([], "text string, slot int")).count() == 0
