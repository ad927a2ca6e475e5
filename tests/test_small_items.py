"""Bins without flux, period matches, member lists, binning keys and warnings on small hand-made rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyloom.functions.numeric import rounded
from skyloom.operators import archive as ar
from skyloom.operators import catalogs as ct
from skyloom.operators import comparison as cp
from skyloom.operators import photometry as pm
from skyloom.operators import pixels as px
from skyloom.operators import planning as pl
from skyloom.operators import series as sr


def test_bins_of_magnitudes_alone(spark):
    rows = []
    for name, kinds in (("cal", ("c", "d", "i")), ("dif", ("d", "i")), ("ins", ("i",)), ("flux", ("f", "d", "i"))):
        for i in range(4):
            has = lambda k, v: v if k in kinds else None  # noqa: B023, E731
            rows.append((name, "V", f"f{i}", 100.0 * i, has("f", 1000.0 + i), has("f", 10.0), 20.0, has("i", -7.0 - i), has("d", 0.5 + i), has("d", 0.1 * (i + 1)), has("c", 12.0 + i), has("c", 0.2 if i < 2 else 0.4), 1.0 + i))
    m = spark.createDataFrame(rows, "source_id string, filter_name string, file_path string, observation_time double, flux double, flux_error double, snr double, instrumental_magnitude double, differential_magnitude double, differential_magnitude_error double, calibrated_magnitude double, calibrated_magnitude_error double, quality_weight double")
    m = m.withColumns({"quality_score": F.lit(0.9), "excluded_from_analysis": F.lit(False), "comparison_reference_flux": F.lit(500.0), "comparison_scatter": F.lit(0.01), "zero_point_magnitude": F.lit(20.0), "zero_point_magnitude_error": F.lit(0.02)})
    stars = spark.createDataFrame([(s, 100.0, "ROT", "star") for s in ("cal", "dif", "ins", "flux")], "source_id string, period_days double, variability_type string, object_type string")
    got = {r["source_id"]: r for r in sr.snr_bins(m, stars, max_seconds=10_000.0, max_fraction=0.9, smooth_fraction=0.9, target_snr=100.0).collect()}
    assert set(got) == {"cal", "dif", "ins", "flux"} and all(r["member_count"] == 4 for r in got.values())
    quality = [1.0, 2.0, 3.0, 4.0]

    def mean(values, weights):
        return sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights)

    cal_w = [q / e**2 for q, e in zip(quality, (0.2, 0.2, 0.4, 0.4), strict=True)]
    dif_w = [q / (0.1 * (i + 1)) ** 2 for i, q in enumerate(quality)]
    assert got["cal"]["flux"] is None and got["cal"]["snr"] is None
    assert got["cal"]["calibrated_magnitude"] == pytest.approx(mean([12.0, 13.0, 14.0, 15.0], cal_w)) and got["cal"]["calibrated_magnitude_error"] == pytest.approx(sum(cal_w) ** -0.5)
    assert got["cal"]["differential_magnitude"] == pytest.approx(mean([0.5, 1.5, 2.5, 3.5], quality)) and got["cal"]["differential_magnitude_error"] == pytest.approx(mean([0.1, 0.2, 0.3, 0.4], quality))
    assert got["dif"]["calibrated_magnitude"] is None and got["dif"]["differential_magnitude"] == pytest.approx(mean([0.5, 1.5, 2.5, 3.5], dif_w))
    assert got["ins"]["instrumental_magnitude"] == pytest.approx(mean([-7.0, -8.0, -9.0, -10.0], quality)) and got["ins"]["differential_magnitude"] is None
    assert got["flux"]["flux"] == pytest.approx(1001.5, abs=1.0) and got["flux"]["calibrated_magnitude"] is not None


def test_best_set_by_period(spark):
    trials = spark.createDataFrame(
        [("a", "V", "s1", 24.0, 9), ("a", "V", "s2", 26.4, 50), ("a", "V", "s3", None, 99), ("b", "V", "s1", 240.0, 3), ("b", "V", "s2", -1.0, 4), ("c", "V", "s1", 5.0, 3), ("c", "V", "s2", 5.0, 4)],
        "source_id string, filter_name string, set_id string, period_hours double, valid_count long",
    )
    known = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source_id string, period_days double")
    got = {r["source_id"]: (r["set_id"], r["match_index"], r["trial_count"]) for r in cp.best_set_by_period(trials, known).collect()}
    assert got == {"a": ("s1", 100.0, 3), "b": ("s1", 0.0, 2), "c": ("s2", None, 2)}
    error, index = cp.period_match(F.lit(26.4), F.lit(1.0))
    r = spark.range(1).select(error.alias("e"), index.alias("i")).first()
    assert (r["e"], r["i"]) == pytest.approx((0.1, 90.0))


def test_linear_prediction(spark):
    ra, dec = pl.position_at(F.lit(10.0), F.lit(-5.0), F.lit(36.0), F.lit(None).cast("double"), F.lit(10.0))
    r = spark.range(1).select(ra.alias("ra"), dec.alias("dec"), pl.motion_rate(F.lit(3.0), F.lit(4.0)).alias("rate")).first()
    assert (r["ra"], r["dec"], r["rate"]) == pytest.approx((10.1, -5.0, 5.0))


def test_binning_keys(spark):
    headers = [{"XBINNING": "2", "CCDXBIN": "3"}, {"CCDXBIN": "3"}, {"XBIN": "4"}, {}]
    files = spark.createDataFrame([(f"/r/T/a{i}.fits", "/r", h) for i, h in enumerate(headers)], "path string, root_path string, header map<string,string>")
    assert [r["binning"] for r in ar.frame_inventory(files).orderBy("path").collect()] == ["Bin2", "Bin3", "Bin4", None]


def test_members_in_time_order(spark):
    rows = [("R", 60.0, True, 5, "b"), ("R", 60.0, True, None, "z"), (" ", None, True, 2, "c"), (None, None, True, 1, "d"), ("R", 60.0, False, 1, "x"), ("R", 60.0, True, 5, "a")]
    frames = spark.createDataFrame(rows, "filter_name string, exposure_seconds double, has_wcs boolean, observation_time long, path string")
    for fits in (True, False):
        got = sorted((r["filter_name"], r["exposure_seconds"] or 0.0, r["position"], r["path"]) for r in ar.frame_group_members(frames, fits).collect())
        assert got == [("R", 60.0, 1, "z"), ("R", 60.0, 2, "a"), ("R", 60.0, 3, "b"), ("Unknown", 0.0, 1, "d"), ("Unknown", 0.0, 2, "c")]


def test_extras_stand_first(spark):
    schema = "source_id string, field string, magnitude double"
    extras = spark.createDataFrame([("a", "f2", 1.0), ("a", "f1", 2.0), ("n", "f1", None)], schema)
    stars = spark.createDataFrame([("a", "f0", 9.0), ("b", "f0", 8.0)], schema)
    got = {r["source_id"]: (r["field"], r["magnitude"], r["is_extra"]) for r in ct.with_extras_first(extras, stars).collect()}
    assert got == {"a": ("f1", 2.0, True), "n": ("f1", None, True), "b": ("f0", 8.0, False)}


def test_colour_fallback_and_flat_frames(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, None, 0.2), (3, float("nan"), None)], "k int, catalog double, own double")
    colour, source = px.colour_of(F.col("catalog"), F.col("own"))
    assert [tuple(r) for r in rows.select("k", colour, source).orderBy("k").collect()] == [(1, 0.5, "catalog"), (2, 0.2, "instrumental"), (3, None, "none")]
    flat = spark.createDataFrame([(1, 0, i, 7.0) for i in range(9)] + [(2, 0, i, float(i == 3) * 9) for i in range(9)], "frame_id long, y long, x long, value double")
    got = {r["frame_id"]: r for r in px.frame_signal(flat).collect()}
    assert got[1]["noise"] == 0.0 and got[1]["snr"] is None and got[2]["noise"] > 0


def test_rounding_equals_sql(spark):
    duck = duckdb.connect()
    values = [68.834375, -68.834375, 1.005, 2.675, 0.5, -0.0, 1e300, None] + [k / 1e5 + 5e-6 for k in range(0, 90000, 91)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r["i"]: r["v"] for r in rounded(rows, 5).collect()}
    assert got == {i: duck.execute("select round(?::double, 5) + 0.0", [v]).fetchall()[0][0] for i, v in enumerate(values)}


def test_comparison_candidates_of_rounds_equal_one_search(spark, monkeypatch):
    k = F.col("id")
    refs = spark.range(4000).select(F.concat(F.lit("r"), k).alias("source_id"), F.concat(F.lit("N"), k % 7).alias("name"), (k * 7 % 400 / 10.0).alias("ra_deg"), (k * 13 % 300 / 10.0).alias("dec_deg"), F.when(k % 50 != 0, 8.0 + k % 91 / 10.0).alias("magnitude"), F.when(k % 3 != 0, k % 25 / 10.0).alias("bp_rp"))
    targets = spark.range(60).select(F.concat(F.lit("t"), k).alias("target_id"), (k * 11 % 70).cast("double").alias("ra_deg"), (k % 30).cast("double").alias("dec_deg"), F.when(k % 9 != 0, 8.5 + k % 80 / 10.0).alias("magnitude"), F.when(k % 2 == 0, k % 25 / 10.0).alias("bp_rp"))
    whole = {tuple(r) for r in ct._ranked_candidates(targets, refs, 2.0, 0.6, 600.0, 4, 1.0).collect()}
    shares, once = [], ct._ranked_candidates
    monkeypatch.setattr(ct, "_ranked_candidates", lambda *a: shares.append((a[-1], a[0].count())) or once(*a))
    got = ct.comparison_candidates(targets, refs, 2.0, 0.6, 600.0, 4).collect()
    assert len(got) == len(whole) and {tuple(r) for r in got} == whole
    assert shares[0][0] < shares[-1][0] == 1.0 and 0 < shares[-1][1] < shares[0][1] == 60


def test_sets_of_equal_members_have_the_center_and_scatter_of_sql(spark):
    duck = duckdb.connect()
    rows = [(g, f"r{i}", i, 3.7 + g * 0.13, (3.7 + g * 0.13) ** 0.5 / 3.0) for g in range(200) for i in range(2)]
    pairs = spark.createDataFrame(rows, "g int, ref_source_id string, rank int, ref_flux double, ref_flux_error double")
    got = {r["g"]: (r["comparison_reference_flux"], r["comparison_scatter"]) for r in pm.ensemble(pairs, ["g"]).collect()}
    for g, _, _, f, e in rows[::2]:
        c = duck.execute("select (2*(f/(e*e)))/(2*(1/(e*e))) from (select ?::double f, ?::double e)", [f, e]).fetchall()[0][0]
        s = duck.execute("select sqrt((2*((f-c)*(f-c)/(e*e)))/(2*(1/(e*e))))/c from (select ?::double f, ?::double e, ?::double c)", [f, e, c]).fetchall()[0][0]
        assert got[g] == (c, s)
