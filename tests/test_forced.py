"""Forced photometry, the transient search and aperture flags on small hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import forced as fo

FRAME = "frame_id long, field long, width int, height int, crval1 double, crval2 double, crpix1 double, crpix2 double, cd11 double, cd12 double, cd21 double, cd22 double"
STEP = 1.2 / 3600.0


def _frames(spark, count, width=64, height=64):
    return spark.createDataFrame([(i, 0, width, height, 150.0, 35.0, 32.0, 32.0, -STEP, 0.0, 0.0, STEP) for i in range(count)], FRAME)


def _image(sources, seed, width=64, height=64, noise=4.0, missing=()):
    draw = np.random.default_rng(seed)
    y, x = np.indices((height, width))
    data = 100.0 + draw.normal(0, noise, (height, width))
    for sx, sy, top in sources:
        data += top * np.exp(-((x - sx) ** 2 + (y - sy) ** 2) / (2 * 1.4**2))
    for my, mx in missing:
        data[my, mx] = np.nan
    return data


def _pixels(spark, images):
    rows = [(i, y, x, float(v)) for i, data in enumerate(images) for (y, x), v in np.ndenumerate(data)]
    return spark.createDataFrame(rows, "frame_id long, y long, x long, value double")


def _sky(spark, frames, x, y):
    ra, dec = sky.to_sky(F.lit(float(x)), F.lit(float(y)))
    r = frames.limit(1).select(ra.alias("ra"), dec.alias("dec")).first()
    return r["ra"], r["dec"]


def test_projection_round_trip(spark):
    frames = spark.createDataFrame([(1, 0, 64, 64, 359.99, -71.5, 30.0, 20.0, -STEP, 2e-5, 3e-5, STEP), (2, 0, 64, 64, 12.0, 89.9, 30.0, 20.0, STEP, 0.0, 0.0, STEP)], FRAME)
    places = frames.crossJoin(spark.createDataFrame([(0.0, 0.0), (63.0, 5.5), (30.0, 20.0)], "px double, py double"))
    ra, dec = sky.to_sky("px", "py")
    back = places.withColumns({"ra": ra, "dec": dec})
    x, y = sky.to_pixel("ra", "dec")
    for r in back.withColumns({"x": x, "y": y}).collect():
        assert (r["x"], r["y"]) == pytest.approx((r["px"], r["py"]), abs=1e-7)
        assert 0 <= r["ra"] < 360
    behind = frames.withColumns({"ra": F.lit(180.0), "dec": F.lit(71.5)}).where("frame_id = 1")
    assert behind.select(sky.to_pixel("ra", "dec")[0].alias("x")).first()["x"] is None


def test_signal_of_one_source_by_hand(spark):
    image = _image([(31.3, 30.6, 500.0)], 3, missing=[(20, 31), (21, 31)])
    frames, pixels = _frames(spark, 1), _pixels(spark, [image])
    ra, dec = _sky(spark, frames, 31.3, 30.6)
    targets = spark.createDataFrame([("t", 0, ra, dec), ("edge", 0, *_sky(spark, frames, 12.0, 30.0)), ("other", 1, ra, dec)], "group_id string, field long, ra_deg double, dec_deg double")
    noise = fo.frame_noise(pixels)
    (row,) = fo.forced_signals(pixels, frames, targets, noise, 3.0).collect()
    radius, inner, outer = fo.aperture_radii(3.0)
    yy, xx = np.indices(image.shape)
    r = np.hypot(xx - row["x"], yy - row["y"])

    def clipped(v):
        v = v[np.isfinite(v)]
        for _ in range(5):
            v = v[np.abs(v - np.median(v)) <= 3 * v.std()]
        return np.median(v), v.std()

    ground, spread = clipped(image[(r >= inner) & (r <= outer)])
    whole = clipped(image)
    inside = image[r <= radius]
    sigma = max(spread, whole[1] * 0.25)
    flux = (inside - ground).sum()
    assert row["group_id"] == "t" and (row["x"], row["y"]) == pytest.approx((31.3, 30.6), abs=1e-6)
    assert (row["flux"], row["flux_uncertainty"]) == pytest.approx((flux, sigma * math.sqrt(inside.size)))
    assert (row["snr"], row["peak_snr"]) == pytest.approx((flux / (sigma * math.sqrt(inside.size)), (inside.max() - ground) / sigma))
    assert noise.first()["frame_scatter"] == pytest.approx(whole[1])


def test_noise_never_falls_below_a_quarter_of_the_frame(spark):
    image = _image([], 4, noise=8.0)
    yy, xx = np.indices(image.shape)
    image[np.hypot(xx - 32, yy - 32) <= 20] = 100.0  # a flat patch: no spread around the target
    frames, pixels = _frames(spark, 1), _pixels(spark, [image])
    targets = spark.createDataFrame([("t", 0, *_sky(spark, frames, 32.0, 32.0))], "group_id string, field long, ra_deg double, dec_deg double")
    noise = fo.frame_noise(pixels)
    row = fo.forced_signals(pixels, frames, targets, noise, 3.0).first()
    assert row["flux"] == pytest.approx(0.0, abs=1e-6)
    assert row["noise"] == pytest.approx(noise.first()["frame_scatter"])  # neither the clipped nor the plain spread is positive


def test_search_keeps_the_variable_source_without_catalog_star(spark):
    steady = [(20.0, 25.0, 850.0), (35.0, 38.0, 720.0)]
    frames = _frames(spark, 2)
    pixels = _pixels(spark, [_image(steady, 0), _image([*steady, (41.0, 30.0, 900.0)], 1)])
    catalog = spark.createDataFrame([("known", "Known", *_sky(spark, frames, 20.0, 25.0))], "source_id string, name string, ra_deg double, dec_deg double")
    (found,) = fo.search_transients(pixels, frames, catalog, sigma=8.0, fwhm=3.0).collect()
    ra, dec = _sky(spark, frames, 41.0, 30.0)
    assert (found["frame_count"], found["detection_count"], found["signal_count"]) == (1, 1, 2)
    assert found["median_snr"] > 100 and found["variability_snr"] > 10
    assert (found["ra_deg"], found["dec_deg"]) == pytest.approx((ra, dec), abs=1e-3)
    assert found["nearest_catalog_name"] is not None and found["nearest_catalog_separation_arcsec"] > 5


def test_fields_do_not_share_groups_and_empty_tables(spark):
    frames = _frames(spark, 2).withColumn("field", F.col("frame_id"))
    pixels = _pixels(spark, [_image([(30.0, 30.0, 900.0)], 1), _image([(30.0, 30.0, 300.0)], 2)])
    none = spark.createDataFrame([], "source_id string, name string, ra_deg double, dec_deg double")
    assert fo.search_transients(pixels, frames, none).collect() == []  # one frame a field: nothing to compare with
    assert fo.search_transients(pixels.limit(0), frames, none).collect() == []


def test_clipped_stats_of_large_groups_equal_small_ones(spark):
    draw = np.random.default_rng(9)
    rows = [(g, float(v)) for g in (1, 2) for v in np.concatenate([draw.normal(g, 1, 400), draw.normal(40, 5, 30)])]
    frame = spark.createDataFrame(rows, "g int, v double")
    small, large = ({r["g"]: (r["center"], r["scatter"], r["used"]) for r in fo.clipped_stats(frame, ["g"], F.col("v"), fits=f).collect()} for f in (True, False))
    assert {g: pytest.approx(v) for g, v in large.items()} == small


def test_flags(spark):
    image = _image([(20.0, 20.0, 1_000.0), (34.0, 36.0, 2_000.0), (50.0, 12.0, 100.0)], 5, noise=1.0)
    pixels = _pixels(spark, [image])
    top = float(np.floor(image.max()) - 100)
    frames = spark.createDataFrame([(0, 64, 64, 20.0, top)], "frame_id long, width int, height int, edge_percent double, saturation_threshold double")
    sources = spark.createDataFrame(
        [(0, "mid", 20.0, 20.0), (0, "top", 34.0, 36.0), (0, "side", 50.0, 12.0), (0, "away", 400.0, 400.0)], "frame_id long, source_id string, sx double, sy double"
    )
    got = {r["source_id"]: r for r in fo.flagged_photometry(pixels, sources, frames, ["frame_id"], 4.0, 6.0, 9.0).collect()}
    assert got["mid"]["flags"] == [] and got["mid"]["flux"] > 0
    assert got["top"]["is_saturated"] and got["top"]["flags"] == [f"Saturated source core detected (peak {image[30:42, 28:40].max():.0f} >= {top:.0f}; {int((image >= top).sum())} saturated pixel(s))."]
    outside = ["Target lies outside the usable image area (configured 20.0% edge margin)."]
    assert got["side"]["flags"] == outside and got["side"]["flux"] is None and not got["side"]["in_usable_area"]
    assert got["away"]["flags"] == outside and got["away"]["x"] == 400.0
    near = frames.withColumn("saturation_threshold", F.lit(float(image.max()) * 1.02)).withColumn("edge_percent", F.lit(None).cast("double"))
    got = {r["source_id"]: r for r in fo.flagged_photometry(pixels, sources, near, ["frame_id"], 4.0, 6.0, 9.0).collect()}
    assert got["top"]["is_near_saturated"] and got["top"]["flags"][0].startswith("Source core is near saturation (peak ")
    assert got["side"]["flags"] == [] and got["away"]["flags"] == ["Target lies outside the usable image area."]
