"""Nearest catalog stars, reference rankings, comparison sets, identities and stored models against plain code."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import catalogs as ct
from skyloom.operators import comparison as cp
from skyloom.operators import learning as ln


def _separation(a, b):
    ra1, d1, ra2, d2 = map(math.radians, (*a, *b))
    h = math.sin((d1 - d2) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((ra1 - ra2) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h)))) * 3600


def test_nearest_star_at_uneven_density(spark):
    draw = np.random.default_rng(1)
    crowded = [(float(10 + x), float(20 + y)) for x, y in draw.normal(0, 0.002, (300, 2))]
    wide = [(float(a), float(d)) for a, d in zip(draw.uniform(0, 360, 40), draw.uniform(-89, 89, 40), strict=True)]
    stars = [*crowded, *wide, (0.0, 90.0), (0.0, 0.0), (180.0, 0.0), (90.0, 0.0), (10.0, 20.0), (10.0, 20.0)]
    spots = [(float(a), float(d)) for a, d in zip(draw.uniform(0, 360, 40), draw.uniform(-90, 90, 40), strict=True)]
    spots += [(10.0, 20.0), (10.0021, 20.0), (359.9999, 0.0), (0.0, -90.0), (123.0, 90.0), (10.0, 20.5)]
    catalog = spark.createDataFrame([(f"n{i:03d}", a, d) for i, (a, d) in enumerate(stars)], "name string, ra_deg double, dec_deg double")
    detections = spark.createDataFrame([(i, a, d) for i, (a, d) in enumerate(spots)], "detection_id int, ra_deg double, dec_deg double")
    got = {r["detection_id"]: r for r in ct.nearest_catalog(detections, catalog, "detection_id").collect()}
    for i, spot in enumerate(spots):
        best = min((_separation(spot, s), f"n{k:03d}") for k, s in enumerate(stars))
        assert got[i]["separation_arcsec"] == pytest.approx(best[0], abs=1e-6)
        assert _separation(spot, stars[int(got[i]["m_name"][1:])]) == pytest.approx(best[0], abs=1e-6)
    assert got[40]["m_name"] == min(f"n{k:03d}" for k, s in enumerate(stars) if s == (10.0, 20.0))
    empty = ct.nearest_catalog(detections, catalog.limit(0), "detection_id").collect()
    assert len(empty) == len(spots) and all(r["m_name"] is None for r in empty)


TARGET = "object_name string, filter_name string, source_id string, ra_deg double, dec_deg double, magnitude double"
REFERENCE = "object_name string, filter_name string, reference_id string, __ra double, __dec double, __name string, __mag double"


@pytest.mark.parametrize("pool", [1, 3, 9])
def test_ranked_references(spark, pool):
    draw = random.Random(pool)
    targets, references = [], []
    for field, known in (("a", 40), ("b", 2), ("c", 0)):
        targets += [(field, "V", f"t{i}", draw.random(), draw.random(), draw.choice([None, 9.0, 10.0, draw.uniform(8, 12)])) for i in range(12)]
        magnitudes = [draw.choice([9.0, 10.0, draw.uniform(8, 12)]) for _ in range(known)] + [None] * 6
        references += [(field, "V", f"r{i:02d}", draw.random(), draw.random(), f"n{i % 3}", m) for i, m in enumerate(magnitudes)]
    got = {}
    out = cp.ranked_references(spark.createDataFrame(targets, TARGET), spark.createDataFrame(references, REFERENCE), pool)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["object_name"], r["source_id"]), []).append(r["reference_id"])
    for field, _, name, ra, dec, mag in targets:
        def order(r):
            d2 = (r[3] - ra) ** 2 + (r[4] - dec) ** 2
            return (0, 0.0, d2, r[5], r[2]) if mag is None else (int(r[6] is None), abs((mag if r[6] is None else r[6]) - mag), d2, r[5], r[2])

        assert got[field, name] == [r[2] for r in sorted((r for r in references if r[0] == field), key=order)][:pool]


def test_fallback_magnitudes(spark):
    rows = [("o", "V", s, False, float(t), f"f{t}", 1.0 + t, 2.0, cal, cat) for s, t, cal, cat in (("a", 2, 11.0, 9.0), ("a", 1, 13.0, 9.0), ("b", 1, None, 9.5), ("c", 1, None, None), ("d", 1, 12.0, 1.0))]
    m = spark.createDataFrame(rows, "object_name string, filter_name string, source_id string, is_reference boolean, observation_time double, file_path string, ra_deg double, dec_deg double, calibrated_magnitude double, catalog_magnitude double")
    known = spark.createDataFrame([("d", 7.0), ("a", None)], "source_id string, magnitude double")
    got = {r["source_id"]: (r["magnitude"], r["ra_deg"]) for r in cp.target_magnitudes(m, known).collect()}
    assert got == {"a": (12.0, 2.0), "b": (9.5, 2.0), "c": (None, 2.0), "d": (7.0, 2.0)}


def test_sets_without_and_with_sampling(spark):
    rows = [(k, f"s{i:02d}", i) for k, n in (("few", 6), ("many", 30), ("none", 2)) for i in range(1, n + 1)]
    favourites = spark.createDataFrame(rows, "field string, source_id string, position int")
    preferred = spark.createDataFrame([("many", s) for s in ("s05", "s09", "s20", "s30")], "field string, source_id string")
    got = {}
    for r in cp.sets_of(favourites, "field", 3, 100, preferred).collect():
        got.setdefault(r["field"], []).append(tuple(r["members"]))
    assert len(got["few"]) == len(set(got["few"])) == math.comb(6, 3) and "none" not in got
    assert len(got["many"]) == len(set(got["many"])) == 100
    assert ("s05", "s09", "s20") in got["many"] and ("s01", "s02", "s03") in got["many"]
    assert all(list(m) == sorted(set(m)) and len(m) == 3 for sets in got.values() for m in sets)
    used = {s for m in got["many"] for s in m}
    assert len(used) == 30  # the sample spreads over the list
    wide = spark.createDataFrame([("k", f"s{i:03d}", i) for i in range(1, 201)], "field string, source_id string, position int")
    assert cp.sets_of(wide, "field", 5, 50).count() == 50  # 2.5 thousand million sets, of which fifty are formed


def test_predictions_match_by_any_name(spark):
    schema = "prediction_id long, name string, designation string, magnitude double, extra string"
    old = spark.createDataFrame([(1, "Ceres", None, 7.0, "x"), (2, None, "2020 AB1", 18.0, "y"), (3, "Lone", None, 9.0, "z"), (4, None, None, 1.0, "w"), (5, "Two", "2021 Q", 4.0, "v")], schema)
    new = spark.createDataFrame([(10, "CERES", "A899 OF", None, None), (11, "Other", "2020ab1", None, "new"), (12, "two", None, 5.0, None), (13, None, "2021-Q", 6.0, None), (14, None, "", 3.0, None)], schema)
    got = {(r["prediction_id"], r["origin"]): (r["name"], r["designation"], r["magnitude"], r["extra"], r["matched_rows"]) for r in ct.merge_predictions(old, new, ["magnitude"]).collect()}
    assert got == {
        (10, "merged"): ("CERES", "A899 OF", 7.0, None, 2), (11, "merged"): ("Other", "2020ab1", 18.0, "new", 2), (12, "merged"): ("two", None, 5.0, None, 3),
        (3, "existing"): ("Lone", None, 9.0, "z", 1), (4, "existing"): (None, None, 1.0, "w", 1), (14, "authoritative"): (None, "", 3.0, None, 1),
    }


def test_stored_models(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="spark-")
    examples = spark.createDataFrame([(f"c{i:03d}", "real" if i % 2 else "artefact", float(i % 2) + i / 1000.0, float(i)) for i in range(40)], "candidate_key string, label string, a double, b double")
    assert ln.score_latest(spark, folder, "moving", examples) is None
    model, metrics = ln.train_classifier(examples, ["a", "b"], trees=5)
    first = ln.save_model(spark, folder, "moving", model, ["a", "b"], examples, metrics)
    ln.save_model(spark, folder, "transient", model, ["a"], examples, {})
    with monkeypatch.context() as patch:
        patch.setattr("pyspark.ml.classification.RandomForestClassifier.fit", lambda *a, **k: pytest.fail("scoring fits nothing"))
        scores = [{r["candidate_key"]: (r["predicted_label"], r["model_id"]) for r in ln.score_latest(spark, folder, "moving", examples.drop("label", "b")).collect()} for _ in range(2)]
    assert scores[0] == scores[1] and {m for _, m in scores[0].values()} == {first}
    assert sum(label == ("real" if int(k[1:]) % 2 else "artefact") for k, (label, _) in scores[0].items()) >= 36
    second = ln.save_model(spark, folder, "moving", model, ["a", "b"], examples, metrics)
    assert ln.score_latest(spark, folder, "moving", examples).first()["model_id"] == second
    assert sorted((r["mode"], r["version"]) for r in ln.models(spark, folder).collect()) == [("moving", 1), ("moving", 2), ("transient", 1)]
    labels = examples.select(F.lit("moving").alias("mode"), "candidate_key", "label", F.lit(1).alias("updated"))
    summary = ln.training_summary(spark, folder, labels).collect()
    assert {(r["label"], r["label_count"], r["version"], r["model_id"]) for r in summary} == {("real", 20, 2, second), ("artefact", 20, 2, second)}
