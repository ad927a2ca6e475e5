"""Registered queries against their SQL twins on the smallest tables, and the sinks and streams."""

import math
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyloom.plans import standins as si
from skyloom.sources import tables
from skyloom.streaming import deck
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "differential_photometry", "quality_score", "candidate_score", "deck_stats", "deck_merge", "frame_batches", "observation_orbit", "reference_stars",
    "crossmatch_bands", "nearest_snapshot", "catalog_dedupe", "entity_resolution", "lomb_scargle", "snr_bins", "submission_rows", "aperture_photometry",
    "tracked_stack", "streaks", "transient_groups", "known_object_match", "motion_groups", "label_summary", "visible_limit", "calibrate", "stack_peak",
    "best_variant", "stamp_bands", "folder_match", "flagged_photometry", "transient_search", "stack_modes", "fallback_ranking", "prediction_identity",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _clean(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_clean(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_clean(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sinks_and_history(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    m = si.raw_measurements(spark, DATA).withColumn("accepted", F.col("source_no") % 2 == 0)
    tables.write_science(m, f"{root}/science")
    assert spark.read.option("header", True).csv(f"{root}/science").count() == m.count()
    tables.write_rows(m, f"{root}/m", by=("filter_name",))
    assert tables.read_measurements(spark, f"{root}/m").count() == m.count()
    report = spark.createDataFrame([("o1", 3, 2, 10, 4)], "object_name string, file_count long, solved_count long, measurement_count long, light_curve_count long")
    tables.append_run(spark, f"{root}/runs", report)
    tables.append_run(spark, f"{root}/runs", report)
    assert tables.run_history(spark, f"{root}/runs", "o1").count() == 2


def test_streaming_deck_ingest_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    files = si.orders_with_path(spark, DATA).select("path", "root_path", "file_no", F.lit("t").alias("target_name"), F.lit(1).alias("version"))
    first = files.where(F.col("file_no") % 2 == 0)
    first.write.parquet(f"{root}/in/a")
    schema = spark.read.parquet(f"{root}/in/a").schema
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
    deck.ingest_deck(read(), f"{root}/lib", f"{root}/cp").awaitTermination()
    files.where(F.col("file_no") % 3 == 0).withColumn("version", F.lit(2)).write.parquet(f"{root}/in/b")
    deck.ingest_deck(read(), f"{root}/lib", f"{root}/cp").awaitTermination()
    got = {(r["file_no"], r["version"]) for r in deck.current_library(spark, f"{root}/lib").collect()}
    total = [r["file_no"] for r in files.collect()]
    assert got == {(k, 2 if k % 3 == 0 else 1) for k in total if k % 2 == 0 or k % 3 == 0}
