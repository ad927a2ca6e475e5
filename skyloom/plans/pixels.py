"""Registered pixel-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.groups import attach
from skyloom.functions.lineage import cut
from skyloom.functions.numeric import rounded
from skyloom.operators import pixels as px
from skyloom.operators import stacks as sk
from skyloom.plans import standins as si


def _pixels(spark, d):
    return si.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("kind"), F.posexplode("embedding").alias("pos", "v")
    ).select(
        "frame_id", "kind", F.floor(F.col("pos") / 8).cast("long").alias("y"), (F.col("pos") % 8).cast("long").alias("x"),
        (F.lit(100.0) + F.lit(50.0) * F.col("v").cast("double")).alias("value"),
    )


def _sources(spark, d):
    e = si.table(spark, d, "embeddings")
    k = F.col("vec_id")
    one = e.select(k.alias("frame_id"), F.lit("a").alias("source_id"), (F.lit(3.1) + k % 5 / 10.0).alias("sx"), (F.lit(3.4) + k % 3 / 10.0).alias("sy"))
    two = e.select(k.alias("frame_id"), F.lit("b").alias("source_id"), (F.lit(4.3) + k % 7 / 10.0).alias("sx"), F.lit(4.6).alias("sy"))
    return one.unionByName(two)


def master_frames(spark, d):
    return rounded(px.master_frames(_pixels(spark, d), ["kind"]))


def calibrate(spark, d):
    k = F.col("frame_id")
    p = _pixels(spark, d).withColumn("camera", k % 2).withColumn("exposure_seconds", F.when(F.col("kind") == 1, F.lit(60.0) + k % 3 * 60).when(F.col("kind") == 2, F.lit(20.0)).otherwise(F.lit(30.0) + k % 7 * 40))
    of = lambda kind, factor: p.where(F.col("kind") == kind).withColumn("value", F.col("value") * factor)
    bias, flat = px.master_frames(of(0, 0.1), ["camera"]), px.master_frames(of(2, 10.0), ["camera", "exposure_seconds"])
    dark = px.master_frames(of(1, 0.2), ["camera", "exposure_seconds"]).withColumn("bias_corrected", F.col("camera") == 0)
    return rounded(px.calibrate(p.where(F.col("kind") > 2), bias, dark, px.normalized_flat(flat, bias, dark, ["camera"]), ["camera"]))


def pixel_bin(spark, d):
    return rounded(px.pixel_bin(_pixels(spark, d), 3))


def tile_stats(spark, d):
    p = _pixels(spark, d).withColumn("value", F.when(F.col("value") < 92, 0.0).when(F.col("value") > 108, float("nan")).otherwise(F.col("value")))
    return rounded(px.tile_stats(p, 4, enough=8))


def region_snr(spark, d):
    inside = F.col("y").between(3, 4) & F.col("x").between(3, 4)
    return rounded(px.region_snr(_pixels(spark, d), inside, (F.col("y") < 2) | (F.col("y") > 5)))


def aperture_photometry(spark, d):
    out = px.aperture_photometry(_pixels(spark, d), _sources(spark, d), ["frame_id"], 1.6, 2.2, 3.6, saturation=112.0)
    return rounded(out, 5)


def hr_planes(spark, d):
    names = F.array(F.lit("red"), F.lit("green"), F.lit("blue"))
    p = si.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("pos", "v"))
    p = p.select(
        "frame_id", F.element_at(names, (F.col("pos") % 3 + 1).cast("int")).alias("plane"), F.floor(F.col("pos") / 21).cast("long").alias("y"),
        (F.floor(F.col("pos") / 3) % 7).cast("long").alias("x"), (F.lit(100.0) + F.lit(50.0) * F.col("v").cast("double")).alias("value"),
    )
    s = si.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit("c").alias("source_id"), F.lit(3.0).alias("sx"), F.lit(1.0).alias("sy"))
    out = px.planes_photometry(p, s, 1.1, 1.5, 3.2)
    colour, source = px.colour_of(F.when(F.col("frame_id") % 3 == 0, F.col("frame_id") % 20 / 10.0), F.col("blue_minus_red"))
    return rounded(out.withColumns({"colour": colour, "colour_source": source}), 5)


def frame_fwhm(spark, d):
    return rounded(px.frame_fwhm(_pixels(spark, d), _sources(spark, d), 3.0), 5)


def _indexed(spark, d):
    return _pixels(spark, d).withColumn("frame_index", F.floor(F.col("frame_id") / 10) % 8)


def tracked_stack(spark, d):
    return rounded(px.tracked_stack(_indexed(spark, d), "kind", 0.35, -0.2), 5)


def _residuals(spark, d):
    return px.residual_pixels(_pixels(spark, d), "kind")


def shift_stack_sweep(spark, d):
    r = px.residual_pixels(_indexed(spark, d), "kind").withColumn("hours", F.col("frame_index") / 8.0)
    out = px.shift_stack_sweep(r, "kind", px.motion_grid(spark, 3.0, 1.0, 30.0), min_snr=2.5)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), 5)


def residual_detections(spark, d):
    return rounded(px.residual_detections(_residuals(spark, d), sigma=1.5, edge=1, size=(8, 8), merge_radius=0.9), 5)


def frame_signal(spark, d):
    return rounded(px.frame_signal(_pixels(spark, d)), 6)


def unknown_residuals(spark, d):
    """Residual detections off the predicted places of known objects, with bounds on the local SNR."""
    k = F.col("vec_id")
    known = si.table(spark, d, "embeddings").select(k.alias("frame_id"), (F.lit(2.0) + k % 4).cast("double").alias("x"), (F.lit(3.0) + k % 3).cast("double").alias("y"))
    out = px.residual_detections(_residuals(spark, d), sigma=1.5, edge=1, size=(8, 8), merge_radius=0.9, known=known, known_radius=1.5, min_snr=1.6, max_snr=4.0)
    return rounded(out, 5)


def streaks(spark, d):
    out = px.streaks(_residuals(spark, d).withColumn("value", F.col("value") + 20.0), sigma=0.4, width=8, min_area=4, fwhm=1.0, elongation=1.3)
    return rounded(out, 4)


def cumulative_stack(spark, d):
    out = px.cumulative_stack(_pixels(spark, d).withColumn("frame_index", F.col("frame_id")), "kind")
    return rounded(out.select("frame_id", "kind", "y", "x", "stack_count", "stack_value"), 5)


def stack_peak(spark, d):
    stack = _pixels(spark, d).groupBy("kind", "y", "x").agg(F.avg("value").alias("stack_value"))
    return rounded(px.stack_peak(stack, ["kind"], "stack_value", F.lit(3.5), F.lit(3.5), 2.5), 4)


def frame_weights(spark, d):
    places = si.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), (F.lit(3.2) + F.col("vec_id") % 3).alias("px"), F.lit(3.6).alias("py"))
    return rounded(sk.frame_weights(_pixels(spark, d), places, radius=3), 5)


def stack_modes(spark, d):
    """Every rejection with every integration, the mean weighted by the frames' SNR."""
    weights = sk.frame_weights(_pixels(spark, d))
    p = _pixels(spark, d).withColumn("frame_index", F.col("frame_id"))
    rows = attach(px.shifted(p, ["kind", "frame_id", "frame_index"], F.col("frame_id") % 8 * 0.35, F.col("frame_id") % 8 * -0.2), weights.select("frame_id", "snr"), ["frame_id"])
    rows = cut(rows)
    out = None
    for rejection in sk.REJECTIONS:
        one = sk.integrate(sk.rejected(rows, ["kind", "y", "x"], rejection), ["kind", "y", "x"], F.col("snr")).withColumn("rejection", F.lit(rejection))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


def sweep_confirmation(spark, d):
    r = cut(px.residual_pixels(_indexed(spark, d), "kind").withColumn("hours", F.col("frame_index") / 8.0))
    vectors = px.motion_grid(spark, 3.0, 1.0, 30.0)
    peaks = px.shift_stack_sweep(r, "kind", vectors, min_snr=2.5)
    return rounded(sk.confirmed_peaks(peaks, r, "kind", vectors, min_frames=3, min_displacement_px=0.5), 4)


QUERIES = {
    f.__name__: f
    for f in (
        master_frames, calibrate, pixel_bin, tile_stats, region_snr, aperture_photometry, hr_planes, frame_fwhm, tracked_stack, shift_stack_sweep,
        residual_detections, frame_signal, unknown_residuals, streaks, cumulative_stack, stack_peak, frame_weights, stack_modes, sweep_confirmation,
    )
}
