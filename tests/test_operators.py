"""Operators on small hand-made inputs with known answers."""

import math
import random

import pytest

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyloom.functions import names as nm
from skyloom.functions import numeric as n
from skyloom.functions import sky
from skyloom.operators import archive as ar
from skyloom.operators import catalogs as ct
from skyloom.operators import clusters as cl
from skyloom.operators import fits as ft
from skyloom.operators import linking as lk
from skyloom.operators import periods as pr
from skyloom.operators import photometry as ph
from skyloom.operators import pixels as px
from skyloom.operators import quality as ql
from skyloom.operators import series as sr
from skyloom.plans import standins as si
from tests.conftest import DATA


def _measurement(**kw):
    base = dict(
        file_path="f1", filter_name="V", source_id="t", source_name="t", ra_deg=10.0, dec_deg=20.0, flux=1000.0, flux_error=10.0,
        instrumental_magnitude=-7.5, is_reference=False, is_saturated=False, peak_pixel_value=100.0, saturation_threshold=60000.0,
        catalog_magnitude=None, band_mag=None, band_error=None, band_source=None, flags=[], comparison_source_ids=[],
    )
    base.update(kw)
    return base


SCHEMA = (
    "file_path string, filter_name string, source_id string, source_name string, ra_deg double, dec_deg double, flux double, flux_error double,"
    "instrumental_magnitude double, is_reference boolean, is_saturated boolean, peak_pixel_value double, saturation_threshold double,"
    "catalog_magnitude double, band_mag double, band_error double, band_source string, flags array<string>, comparison_source_ids array<string>"
)


def _frame(spark, rows):
    return spark.createDataFrame([tuple(_measurement(**r).values()) for r in rows], SCHEMA)


def _ref(i, **kw):
    return dict(source_id=f"r{i}", source_name=f"r{i}", is_reference=True, catalog_magnitude=12.0, **kw)


def test_nearest_two_comparisons_and_weighting(spark):
    rows = [
        {}, _ref(1, ra_deg=10.001, flux=2000.0, flux_error=10.0), _ref(2, ra_deg=10.002, flux=2200.0, flux_error=20.0), _ref(3, ra_deg=11.0, flux=9000.0),
    ]
    out = ph.differential_photometry(_frame(spark, rows), k=2).first()
    w1, w2 = 1 / 100.0, 1 / 400.0
    expect = (2000 * w1 + 2200 * w2) / (w1 + w2)
    assert out["comparison_source_ids"] == ["r1", "r2"]
    assert abs(out["comparison_reference_flux"] - expect) < 1e-9
    assert abs(out["differential_magnitude"] + 2.5 * math.log10(1000 / expect)) < 1e-12


def test_saturated_and_flagged_references_are_ignored(spark):
    rows = [{}, _ref(1, is_saturated=True), _ref(2, flags=["Source saturated."]), _ref(3, peak_pixel_value=59000.0), _ref(4, flags=["Peak is near saturation."], flux=500.0)]
    out = ph.differential_photometry(_frame(spark, rows)).first()
    assert out["comparison_source_ids"] == ["r4"]


def test_row_without_comparison_is_flagged(spark):
    out = ph.differential_photometry(_frame(spark, [{}])).first()
    assert out["flags"] == [ph.NO_COMPARISON_FLAG] and out["differential_magnitude"] is None and out["zero_point_source_count"] == 0


def test_explicit_list_sets_order(spark):
    rows = [{"comparison_source_ids": ["r3", "r1"]}, _ref(1), _ref(2), _ref(3)]
    assert ph.differential_photometry(_frame(spark, rows)).first()["comparison_source_ids"] == ["r3", "r1"]


def test_unweighted_reference_uses_the_median(spark):
    rows = [{}] + [_ref(i, flux=f, flux_error=None) for i, f in enumerate((100.0, 300.0, 200.0))]
    out = ph.differential_photometry(_frame(spark, rows)).first()
    assert out["comparison_reference_flux"] == 200.0
    assert abs(out["comparison_scatter"] - np.std([100, 200, 300]) / 200) < 1e-12


def test_gridded_nearest_equals_direct(spark):
    m = si.raw_measurements(spark, DATA).withColumn("file_path", F.lit("one")).dropDuplicates(["source_id", "filter_name"])
    targets, refs = ph.science_targets(m), ph.eligible_references(m)
    pick = lambda small: {(r["source_id"], r["filter_name"], r["rank"]): r["ref_source_id"] for r in ph.nearest_references(targets, refs, 2, small=small).collect()}
    direct = pick(10_000)
    assert len(direct) > 20 and pick(3) == direct


def test_nearest_references_are_found_once_per_place(spark):
    rng = random.Random(5)
    places = [(rng.gauss(10.0, 0.001) if i % 2 else rng.uniform(9.0, 11.0), rng.gauss(20.0, 0.001) if i % 2 else rng.uniform(19.0, 21.0)) for i in range(150)]
    refs = [_ref(f"{i:03d}{j}", ra_deg=x, dec_deg=y) for i, (x, y) in enumerate(places) for j in range(2)]
    spots = [places[3], (10.0, 20.0), (9.2, 19.1), (25.0, 3.0)]
    m = _frame(spark, [{"source_id": f"t{i}_{j}", "ra_deg": x, "dec_deg": y} for i, (x, y) in enumerate(spots) for j in range(5)] + refs)
    targets, usable = ph.science_targets(m), ph.eligible_references(m)
    want = {
        (f"t{i}_{j}", n + 1, r)
        for i, (x, y) in enumerate(spots) for j in range(5)
        for n, (_, r) in enumerate(sorted(((r["ra_deg"] - x) * (r["ra_deg"] - x) + (r["dec_deg"] - y) * (r["dec_deg"] - y), r["source_id"]) for r in refs)[:3])
    }
    for limit in (4, None):
        assert ph.nearest_by_place(targets, usable, 3, limit=limit).count() == len(spots) * 3
        got = {(r["source_id"], r["rank"], r["ref_source_id"]) for r in ph.nearest_references(targets, usable, 3, limit=limit).collect()}
        assert got == want


def test_quality_excludes_an_outlier_and_large_form_agrees(spark):
    rng = random.Random(1)
    rows = [
        ("s", "V", f"f{i:02d}", 1000.0 * i, 10.0 + rng.gauss(0, 0.01) + (3.0 if i == 7 else 0.0), 100.0, 1.0, 20.0, []) for i in range(15)
    ]
    df = spark.createDataFrame(rows, "source_id string, filter_name string, file_path string, observation_time double, differential_magnitude double, flux double, flux_error double, snr double, flags array<string>")
    outs = [{r["file_path"]: (r["quality_score"], r["excluded_from_analysis"]) for r in ql.quality_score(df, fits=f).collect()} for f in (True, False)]
    assert outs[0] == outs[1]
    assert outs[0]["f07"][1] and not outs[0]["f03"][1]


def test_variability_large_form_agrees(spark):
    m = si.raw_measurements(spark, DATA).where(~F.col("is_reference"))
    a = {(r["source_id"], r["filter_name"]): r.asDict() for r in ql.variability_metrics(m, True).collect()}
    b = {(r["source_id"], r["filter_name"]): r.asDict() for r in ql.variability_metrics(m, False).collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            assert (v is None and w is None) or v == w or abs(v - w) < 1e-6 * max(1.0, abs(v)), (k, c)


def test_empirical_scatter_counts_residuals_without_a_value(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, None, float("nan"))] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ql.empirical_scatter(df, ["g"], "v", fits=True).collect()
    assert [(r["g"], r["residual_count"], r["kept_count"], round(r["empirical_scatter"], 6)) for r in got] == [("a", 5, 3, 1.4826)]


def test_error_budget_values(spark):
    row = spark.range(1).select(
        n.ccd_flux_error(F.lit(10000.0), F.lit(100.0), F.lit(50.0), 500.0, 5.0, 0.02, 60.0, 2.0).alias("e"), n.total_mag_error(F.lit(0.03), F.lit(0.04), F.lit(None).cast("double")).alias("t"),
    ).first()
    pp = 200.0 + 1.2 + 25.0
    assert abs(row["e"] - math.sqrt(20000 + 50 * pp + 2500 / 500 * pp) / 2) < 1e-9
    assert abs(row["t"] - 0.05) < 1e-12


def test_radius_join_wraps_and_reaches_the_pole(spark):
    rng = random.Random(9)
    pts = [(i, rng.uniform(0, 360), rng.choice([-89.9, 89.95, 0.0, 45.0]) + rng.uniform(0, 0.04)) for i in range(150)] + [(900, 359.99, 10.0), (901, 0.01, 10.0)]
    df = spark.createDataFrame(pts, "source_id long, ra_deg double, dec_deg double")
    got = {(r["source_id"], r["r_source_id"]) for r in sky.within_radius(df, df, 400.0).collect()}
    p = pd.DataFrame(pts, columns=["i", "ra", "dec"])
    ra, dec = np.radians(p.ra.to_numpy()), np.radians(p.dec.to_numpy())
    h = np.sin((dec[:, None] - dec) / 2) ** 2 + np.cos(dec[:, None]) * np.cos(dec) * np.sin((ra[:, None] - ra) / 2) ** 2
    a, b = np.where(np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600 <= 400.0)
    assert got == set(zip(p.i.to_numpy()[a].tolist(), p.i.to_numpy()[b].tolist()))


def test_period_search_recovers_injected_period(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        t = i * 0.21 + rng.uniform(0, 0.1)
        rows.append(("s", "V", t, 12.0 + 0.3 * math.sin(2 * math.pi * t / 1.7) + rng.gauss(0, 0.005), 0.005))
    p = spark.createDataFrame(rows, "source_id string, filter_name string, t double, y double, e double")
    b = sr.period_bounds(p)
    found = sr.best_frequency(sr.lomb_scargle(p, b)).first()["period_hours"] / 24
    ratio = found / 1.7
    assert abs(ratio - round(ratio)) < 0.03 and round(ratio) in (1, 2, 3, 4)
    scan = pr.harmonic_scan(p, b, grid=60, chunks=2).first()["period_hours"] / 24 / 1.7
    assert abs(scan - round(scan)) < 0.02


def test_box_search_recovers_injected_eclipse(spark):
    rows = []
    for i in range(300):
        t = i * 0.05
        rows.append(("s", "V", t, 12.0 + (0.25 if (t % 2.3) < 0.25 else 0.0), 0.01))  # magnitudes: an eclipse is fainter
    p = sr.as_flux(spark.createDataFrame(rows, "source_id string, filter_name string, t double, y double, e double"))
    b = sr.period_bounds(p, min_hours=36.0, max_hours=24 * 6.0)
    out = sr.best_box(sr.box_power(p, b), b).first()
    ratio = out["period_hours"] / 24 / 2.3
    assert abs(ratio - round(ratio)) < 0.03


def test_curve_fit_prefers_the_true_model(spark):
    rows = [("line", "V", i * 0.1, 2.0 + 0.5 * i * 0.1 + (4.0 if i == 11 else 0.0), 0.01) for i in range(30)]
    p = spark.createDataFrame(rows, "source_id string, filter_name string, t double, y double, e double")
    out = ft.curve_fit(p, degree=1, rounds=5).first()
    assert out["point_count"] == 30 and out["rms"] < 0.8


def test_curve_fit_equals_reweighted_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 9, 60))
    y = np.sin(2 * np.pi * t / 2.5) + 0.1 * rng.normal(size=60)
    y[7] += 6
    e = rng.uniform(0.05, 0.2, 60)
    p = spark.createDataFrame([("s", "V", *map(float, r)) for r in zip(t, y, e, strict=True)], "source_id string, filter_name string, t double, y double, e double")
    got = ft.curve_fit(p, rounds=4, period_days=2.5).first()
    base = (1 / e**2) / np.mean(1 / e**2)
    d = np.column_stack([np.ones(60), *[f(2 * np.pi * k * (t - t.min()) / 2.5) for k in (1, 2) for f in (np.cos, np.sin)]])
    w = base
    for _ in range(4):
        c = np.linalg.lstsq(d * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = y - d @ c
        u = r / (4.685 * 1.4826 * np.median(np.abs(r - np.median(r))))
        w = np.maximum(base * np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0), 1e-12)
    assert got["model"] == "periodic" and got["parameters"] == 5 and got["point_count"] == 60
    assert got["rms"] == pytest.approx(np.sqrt(np.mean(r * r)), rel=1e-6)
    assert got["bic"] == pytest.approx(60 * np.log((base * r * r).sum() / 60) + 5 * np.log(60), rel=1e-6)


def test_sequential_bins_large_form_agrees(spark):
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(120):
        t += rng.choice([50.0, 60.0, 400.0, 5000.0])
        rows.append(("s", "V", f"f{i:03d}", t, 100.0, 10.0))
    df = spark.createDataFrame(rows, "source_id string, filter_name string, file_path string, observation_time double, flux double, snr double")
    plan = spark.createDataFrame([("s", "V", 4, 300.0, None)], "source_id string, filter_name string, frames_per_bin long, max_duration_seconds double, skip_reason string")
    outs = [{r["file_path"]: (r["run_id"], r["bin_in_run"]) for r in sr.snr_bin_members(df, plan, f).collect()} for f in (True, False)]
    assert outs[0] == outs[1]
    expect, start, count, cur = {}, None, 0, -1
    for _, _, f, at, _, _ in rows:
        if start is None or count + 1 > 4 or at - start > 300.0:
            start, count, cur = at, 1, cur + 1
        else:
            count += 1
        expect[f] = cur
    order = {k: i for i, k in enumerate(sorted(set(outs[0].values())))}
    assert {f: order[v] for f, v in outs[0].items()} == expect


def test_tracklet_recovers_moving_object(spark):
    rng = random.Random(8)
    rows = []
    for k in range(5):
        rows.append((1, k, k * 1.0, 0 + k * 10, 100.0 + 3.0 * k, 50.0 + 2.0 * k, 8.0, 90.0))
        rows += [(1, k, k * 1.0, 1 + k * 10 + j, rng.uniform(0, 400), rng.uniform(0, 400), 6.0, 50.0) for j in range(4)]
    det = spark.createDataFrame(rows, "night long, frame_index int, hours double, detection_id long, x double, y double, local_snr double, peak_value double")
    seeds = lk.tracklet_seeds(det, 5.0)
    out = lk.rank_candidates(lk.tracklets(det, seeds)).orderBy("candidate_no").first()
    assert out["frame_count"] == 5 and out["fit_rms_px"] < 0.05 and out["review_class"] == "potential"
    assert abs(out["motion_px_per_hour"] - math.hypot(3, 2)) < 1e-6


def test_greedy_assignment(spark):
    rows = [(1, "a", "x", 5, 0.1, 0.2, 9.0), (1, "a", "y", 5, 0.2, 0.2, 9.0), (1, "b", "x", 4, 0.1, 0.2, 9.0), (1, "b", "y", 3, 0.1, 0.2, 9.0), (1, "c", "y", 3, 0.05, 0.2, 9.0)]
    df = spark.createDataFrame(rows, "night long, candidate_id string, object_id string, matched_frames long, rms_px double, max_offset_px double, average_snr double")
    assert {(r["candidate_id"], r["object_id"]) for r in lk.assign_one_to_one(df).collect()} == {("a", "x"), ("c", "y")}


def test_neighbour_distance_with_copies(spark):
    rng = random.Random(6)
    pts = [(i, "f", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)] + [(100 + i, "f", 5.0, 5.0) for i in range(6)] + [(200, "f", 40.0, -30.0)]
    df = spark.createDataFrame(pts, "id long, field string, a double, b double")
    got = {r["id"]: r["kth"] for r in cl.neighbour_distance(df, ["field"], ["a", "b"], "id", F.lit(4)).collect()}
    xy = np.array([[p[2], p[3]] for p in pts])
    d = np.sort(np.linalg.norm(xy[:, None] - xy, axis=2), axis=1)[:, 4]
    assert all(abs(got[p[0]] - v) < 1e-9 for p, v in zip(pts, d))


def test_shift_keeps_a_moving_spot_together(spark):
    rows = [("g", k, k, y, x, 50.0 if (x, y) == (3 + k, 4) else 1.0) for k in range(4) for y in range(10) for x in range(12)]
    df = spark.createDataFrame(rows, "g string, frame_id long, frame_index int, y long, x long, value double")
    out = px.tracked_stack(df, "g", 1.0, 0.0).orderBy(F.desc("mean_value")).first()
    assert (out["x"], out["y"], out["mean_value"]) == (3, 4, 50.0)


def test_cone_and_entities_and_text(spark):
    row = spark.range(1).select(
        nm.photometric_band(F.lit("Johnson-V")).alias("band"), nm.designation_family(F.lit("ASASSN-V J1")).alias("fam"),
        ct.preferred_identifier(F.lit("Gaia DR3 5"), F.lit("TIC 7|HD 123|HIP 9")).alias("pid"), ct.designation_keys(F.lit("NGC 0224 / M 31")).alias("keys"),
        nm.header_exposure(F.create_map(F.lit("EXPOSUREMS"), F.lit("2500"))).alias("exp"), nm.has_explicit_zone(F.lit("2024-01-01T00:00:00Z")).alias("zone"),
    ).first()
    assert (row["band"], row["fam"], row["pid"], row["exp"], row["zone"]) == ("V", "asassn", "HIP 9" if len("HIP 9") < len("HD 123") else "HD 123", 2.5, True)
    assert set(row["keys"]) == {"NGC224", "M31"}


def test_outermost_roots(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/c/",), ("/ab",)], "root_path string")
    assert {r[0] for r in ar.outermost_roots(roots).collect()} == {"/a", "/c", "/ab"}


def test_seeds_at_any_gap(spark):
    for step in (3.0, 12.0, 200.0):
        det = spark.createDataFrame(
            [(1, 0, 0.0, 1, 23.0, 5.0), (1, 1, step, 2, 23.0 + 3.92 * step, 5.0), (1, 1, step, 3, 23.0 + 4.2 * step, 5.0)],
            "night long, frame_index int, hours double, detection_id long, x double, y double",
        )
        assert [(r["start_id"], r["end_id"]) for r in lk.tracklet_seeds(det, 4.0).collect()] == [(1, 2)]


def test_candidates_past_any_count(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):  # pairs of near duplicates and chains of them
        x = (i // 3) * 50.0 + (i % 3) * 1.5
        rows.append((1, f"s{i:03d}", 3 + rng.randrange(3), rng.random() * 2.5, 5.0, 9.0, 2.0, x, 0.0, x + 5.0, 0.0))
    fields = "night long, signature string, frame_count long, fit_rms_px double, average_snr double, displacement_px double, motion_px_per_hour double, start_x double, start_y double, end_x double, end_y double"
    got = [r["signature"] for r in lk.rank_candidates(spark.createDataFrame(rows, fields)).orderBy("candidate_no").collect()]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3], -r[4], -r[5], r[1])):
        if all(math.hypot(r[7] - k[7], r[8] - k[8]) > 2 or math.hypot(r[9] - k[9], r[10] - k[10]) > 2 for k in kept):
            kept.append(r)
    assert len(kept) > 25 and got == [r[1] for r in kept]


def test_peaks_past_any_count(spark):
    rng = random.Random(9)
    rows = [(1, y, x, float(rng.randrange(40))) for y in range(14) for x in range(14)]
    df = spark.createDataFrame(rows, "frame_id long, y long, x long, value double")
    got = {(r["y"], r["x"]) for r in px._merge_bright_first(df, 2.0).collect()}
    kept = []
    for _, y, x, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if all((y - b) ** 2 + (x - a) ** 2 > 4 for b, a in kept):
            kept.append((y, x))
    assert len(kept) > 24 and got == set(kept)


def test_visible_limit_counts_failures_in_a_row(spark):
    def frame(bins):
        return [(f, f"{f}{b}{i}", b / 2 + 0.1 + i / 100, 9.0 if seen else 1.0, 0.0) for f, stars in bins.items() for b, many in stars.items() for i, seen in enumerate(many)]

    rows = frame({
        "a": {20: [1, 1, 1], 21: [1, 0], 22: [1, 1], 23: [0, 0], 24: [1], 25: [1, 1]},  # 24 has too few stars: the second failure
        "b": {18: [0], 19: [0], 20: [1, 0, 0], 21: [0, 0], 22: [1, 1]},  # never enough: the last bin with any
        "c": {20: [1, 1], 21: [0, 0], 22: [1, 1], 23: [0, 0], 24: [1, 1]},
    })
    df = spark.createDataFrame(rows, "frame_id string, source_id string, magnitude double, snr double, offset_px double")
    got = {r["frame_id"]: round(r["magnitude_limit"], 2) for r in lk.visible_limit(df).collect()}
    assert got == {"a": 11.11, "b": 10.1, "c": 12.11}


def test_filter_folder_below_the_root(spark):
    from skyloom.functions import names

    rows = [("/data/red/Target 1/lights/x.fits", "/data/red"), ("/data/red/Target 1/blue/x.fits", "/data/red")]
    df = spark.createDataFrame(rows, "path string, root string")
    got = [r["f"] for r in df.select(names.deck_filter(F.lit(None).cast("string"), F.col("path"), F.col("root")).alias("f")).collect()]
    assert got == [None, "B"]


def test_dark_is_scaled_for_each_frame(spark):
    at = "camera string, y long, x long"
    bias = spark.createDataFrame([("a", 0, 0, 10.0), ("b", 0, 0, 10.0)], f"{at}, master double")
    dark = spark.createDataFrame([("a", 60.0, True, 0, 0, 6.0), ("a", 300.0, True, 0, 0, 30.0), ("b", 60.0, False, 0, 0, 6.0)], "camera string, exposure_seconds double, bias_corrected boolean, y long, x long, master double")
    flat = spark.createDataFrame([("a", 0, 0, 2.0), ("b", 0, 0, 1.0)], f"{at}, flat double")
    lights = spark.createDataFrame(
        [(1, "a", 30.0, 0, 0, 113.0), (2, "a", 120.0, 0, 0, 122.0), (3, "a", 290.0, 0, 0, 139.0), (4, "b", 30.0, 0, 0, 116.0)],
        "frame_id long, camera string, exposure_seconds double, y long, x long, value double",
    )
    got = {r["frame_id"]: round(r["value"], 6) for r in px.calibrate(lights, bias, dark, flat, ["camera"]).collect()}
    assert got == {1: 50.0, 2: 50.0, 3: 50.0, 4: 100.0}
    level = px.normalized_flat(flat.select("camera", F.lit(1.0).alias("exposure_seconds"), "y", "x", F.lit(-5.0).alias("master")), bias, dark, ["camera"])
    with pytest.raises(Exception, match="no positive pixel"):
        level.collect()
