"""Each stage on its predecessor's rows, judged by plain code; registration and removal of the package."""

import subprocess
import sys

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from llm import decontam, mixing, orderminhash, tokens
from tests.conftest import DATA
from tests.llm import test_decontam, test_orderminhash


def test_stages_follow_plain_decisions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 34", "en", "src1", 5), (9004, "the of and " * 20, None, None, 220)], docs.schema)
    docs = docs.unionByName(odd)
    stages = dict(pipeline.STAGES)
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_records"]
    known = spark.createDataFrame(stages["language_id"](spark, docs, DATA).collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in known.collect()} == {9001, 9002, 9003}
    rows = [(r["doc_id"], r["text"]) for r in known.collect()]
    single = spark.createDataFrame(stages["near_dedup"](spark, known, DATA).collect(), docs.schema)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(d for d, c in test_orderminhash.brute(rows).items() if d == c)
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    judged = test_decontam.brute([(r["doc_id"], r["text"]) for r in single.collect()], bench)
    clean = spark.createDataFrame(stages["decontamination"](spark, single, DATA).collect(), docs.schema)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(j[0] for j in judged if not j[5])
    mixed = stages["source_mix"](spark, clean, DATA)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(clean).collect()}
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()} == {d: t for d, t in taken.items() if t}
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    ranks = tokens.load_vocabulary(tokens.VOCABULARY)
    end = max(ranks.values()) + 1
    encoder = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    records = sorted(stages["token_records"](spark, mixed, DATA).collect(), key=lambda r: r["sequence"])
    stream = np.concatenate([np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]] for r in records])
    texts = [encoder.decode(p[:-1].tolist()) for p in np.split(stream, np.flatnonzero(stream == end) + 1) if len(p)]
    assert sorted(texts) == sorted(r["text"] for r in mixed.collect())


def test_empty_table_runs_through(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and {"op2_nn_descent", "op3_decontamination", "op12_vector_codes", "op13_spelling_variants"} <= set(entry.oracle_sql())


def test_library_works_without_the_package():
    code = (
        "import sys, importlib.util as u; f = u.find_spec; "
        "u.find_spec = lambda n, *a: None if n.split('.')[0] in ('llm', 'corpus_pipeline') else f(n, *a); "
        "import __spark_entry__ as e; n = set(e.queries()); assert 'pipeline' not in n and len(n) > 100 and 'llm' not in sys.modules; e.oracle_sql()"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0], capture_output=True).returncode == 0


def test_constants_of_the_contract():
    assert (decontam.WINDOW, orderminhash.SHINGLE, orderminhash.SIMILARITY) == (13, 5, 0.8)
