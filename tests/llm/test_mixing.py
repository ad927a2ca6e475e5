"""Targets, exact quotas and placement of the mix."""

import numpy as np
from pyspark.sql import functions as F

from llm import mixing

SCHEMA = "doc_id long, source string, text string, n_chars long, lang string"


def expected_targets(sizes: dict) -> dict:
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, t, len(t or ""), "en") for i, s, t in rows], SCHEMA)


def test_targets_caps_and_taken(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * int(rng.integers(0, 90)))) for i in range(600)]
    rows += [(None, None, "a b c"), (7, None, None), (7, "s1", ""), (7, "s1", ""), (8, "empty", "  \n")]
    got = mixing.mix_plan(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    plan = mixing.source_targets(corpus(spark, rows).select("source", mixing.word_count(F.col("text")).alias("size"))).collect()
    want = expected_targets(sizes)
    assert {r["source"]: round(r["target"], 6) for r in plan} == {s: round(t, 6) for s, t in want.items()}
    assert sum(r["taken"] for r in got) == sum(int(t + 1e-9) for t in want.values())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_plan(corpus(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quota_tree_is_exact(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 411}
    out = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source_index int, quota long"), 8).collect()
    for s, q in quotas.items():
        own = sorted((r for r in out if r["source_index"] == s), key=lambda r: r["shard"])
        assert sum(r["n_blocks"] for r in own) == q
        assert [r["first_block"] for r in own] == list(np.cumsum([0] + [r["n_blocks"] for r in own[:-1]]))
    totals = {k: sum(r["n_blocks"] for r in out if r["shard"] == k) for k in range(8)}
    assert max(totals.values()) - min(totals.values()) <= 1
    hot = [r["n_blocks"] for r in out if r["source_index"] == 0]
    assert len(set(hot)) > 1 and max(hot) - min(hot) < 80


def test_hypergeometric_draws_follow_the_distribution(spark):
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = u.select(mixing._hypergeometric(F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(50).cast("long"), F.col("u")).alias("x")).toPandas()["x"]
    assert abs(got.mean() - 15) < 0.02
    assert abs(got.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.05


def test_mixed_rows_carry_the_taken_words(spark):
    rows = [(i, f"s{i % 5}", " ".join(f"w{i}_{k}" for k in range(1 + i % 9))) for i in range(200)]
    docs = corpus(spark, rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(docs).collect()}
    words: dict = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {d: t for d, t in plan.items() if t}


def test_both_passes_follow_the_drawn_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 32)
    monkeypatch.setattr(mixing, "BLOCKS_PER_SHARD", 8)
    docs = corpus(spark, [(i, "big" if i % 4 == 0 else "rest", " ".join(f"w{i}_{k}" for k in range(4))) for i in range(400)])
    ids = [r["doc_id"] for r in mixing.mix(docs).collect()]
    twice = len(ids) - len(set(ids))
    assert twice > 90 and sum(a == b for a, b in zip(ids, ids[1:])) < twice / 4
    plan = mixing.mix_plan(docs).where("doc_id % 4 = 0").collect()
    target = int(plan[0]["target"])
    words: dict = {}
    for r in plan:
        for n, shard in zip(r["passes"], r["shards"]):
            if n:
                words[shard] = words.get(shard, 0) + n
    sources = mixing.source_targets(docs.select("source", mixing.word_count(F.col("text")).alias("size")))
    quotas = sources.selectExpr("source_index", "CAST(ceil(floor(target) / 32) AS LONG) AS quota")
    blocks = quotas.agg(F.sum("quota")).first()[0]
    drawn = mixing.split_quotas(quotas, 1 << max(0, int(np.ceil(np.log2(blocks / 8))))).where("source_index = 0").collect()
    assert sum(words.values()) == target
    # No document is cut at a block's edge here (4 words each); only the last block of the source is short.
    assert sum(abs(words.get(r["shard"], 0) - 32 * r["n_blocks"]) for r in drawn) <= 32


def test_empty_table(spark):
    assert mixing.mix_plan(corpus(spark, [])).count() == 0
    assert mixing.mix(corpus(spark, [])).count() == 0
