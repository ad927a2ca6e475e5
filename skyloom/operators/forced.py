"""Forced photometry of sky positions in every frame of their field, and the transient search that rests on it.

Frames are rows ``frame_id, field, width, height`` with a tangent-plane solution (``sky.SOLUTION``); pixels are long rows
``frame_id, y, x, value``. A position meets only the frames of its field, and the pixels only meet the positions whose
circle touches their image square.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions import sky
from skyloom.functions.groups import attach, group_quantiles, groups_fit
from skyloom.functions.lineage import cut
from skyloom.operators.linking import group_positions, transient_candidates, transient_groups
from skyloom.operators.pixels import _with_background, aperture_photometry, source_pixels

# Fixed values of the search.
CLIP, CLIP_ROUNDS = 3.0, 5
LEAST_ANNULUS_PIXELS, LEAST_APERTURE_PIXELS = 10, 4
NOISE_SHARE, LEAST_NOISE = 0.25, 1e-6
NEAR_SATURATION = 0.95


def aperture_radii(fwhm: float) -> tuple[float, float, float]:
    """Aperture radius and the annulus' inner and outer radius for stars of a width."""
    radius = max(3.0, fwhm * 1.75)
    inner = radius + max(3.0, fwhm * 1.25)
    return radius, inner, inner + max(4.0, fwhm * 1.75)


def clipped_stats(rows: DataFrame, keys: list[str], value: Column, sigma: float = CLIP, rounds: int = CLIP_ROUNDS, fits: bool | None = None) -> DataFrame:
    """Median ``center``, population spread ``scatter`` and ``used`` count of each group after clipping around the median.

    A round is one map-side-combined aggregate, with the medians of large groups by value bracket, and only the limits of
    each group go on to the next round.
    """
    vals = rows.where(n.finite(value)).select(*keys, value.cast("double").alias("__v"))
    fits = groups_fit(vals, keys) if fits is None else fits

    def stats(kept: DataFrame) -> DataFrame:
        spread = [F.stddev_pop("__v").alias("scatter"), F.count(F.lit(1)).alias("used")]
        if fits:
            return kept.groupBy(*keys).agg(F.median("__v").alias("center"), *spread)
        return cut(attach(kept.groupBy(*keys).agg(*spread), group_quantiles(kept, keys, F.col("__v"), {"center": 0.5}, False), keys))

    now = stats(vals)
    for _ in range(rounds):
        low, high = F.col("center") - sigma * F.col("scatter"), F.col("center") + sigma * F.col("scatter")
        now = stats(vals.join(now.select(*keys, low.alias("__low"), high.alias("__high")), keys).where(F.col("__v").between(F.col("__low"), F.col("__high"))))
    return now.select(*keys, "center", "scatter", "used")


def frame_noise(pixels: DataFrame, fits: bool | None = None) -> DataFrame:
    """Clipped background and spread of each frame; frames without a positive spread are left out."""
    stats = clipped_stats(pixels, ["frame_id"], F.col("value"), fits=fits)
    return stats.where(n.finite("scatter") & (F.col("scatter") > 0)).select("frame_id", F.col("center").alias("frame_background"), F.col("scatter").alias("frame_scatter"))


def edge_margin(pixels: int, fraction: float) -> Column:
    """Least distance of a detection from the sides: so many pixels, or a share of the shorter side."""
    share = F.rint(F.least("width", "height") * F.lit(max(0.0, min(0.45, fraction))))
    return F.greatest(F.lit(float(pixels)), share)


def star_detections(
    pixels: DataFrame, frames: DataFrame, noise: DataFrame, sigma: float, edge_pixels: int = 8, edge_fraction: float = 0.0, reach: int = 2
) -> DataFrame:
    """Local maxima ``sigma`` above the frame's background with their centroid, sky position, flux, peak and SNR.

    Neighbours are asked for by joins on (y + dy, x + dx), so a frame need not be in one task; of equal neighbours the one
    with the smaller (y, x) is the maximum. The centroid is weighted by the positive excess within ``reach`` pixels.
    """
    level = F.col("value") - F.col("frame_background")
    lit = pixels.where(n.finite("value")).join(noise, "frame_id").withColumn("excess", level)
    hot = lit.where(F.col("excess") > sigma * F.col("frame_scatter")).select("frame_id", "y", "x", "excess", "frame_scatter")
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    ask = hot.select("frame_id", F.col("y").alias("py"), F.col("x").alias("px"), F.col("excess").alias("peak"), "frame_scatter", around.alias("o"))
    ask = ask.select("*", (F.col("py") + F.col("o.dy")).alias("y"), (F.col("px") + F.col("o.dx")).alias("x"), (F.greatest(F.abs("o.dy"), F.abs("o.dx")) <= 1).alias("touches"))
    met = ask.join(lit.select("frame_id", "y", "x", "excess"), ["frame_id", "y", "x"])
    before = F.struct("y", "x") < F.struct(F.col("py"), F.col("px"))
    beaten = F.col("touches") & ((F.col("excess") > F.col("peak")) | ((F.col("excess") == F.col("peak")) & before))
    w = F.greatest(F.col("excess"), F.lit(0.0))
    peaks = met.groupBy("frame_id", "py", "px").agg(
        F.max(beaten).alias("__beaten"), F.first("peak").alias("peak_value"), F.first("frame_scatter").alias("__s"), F.sum(w).alias("flux"),
        (F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"),
    ).where(~F.col("__beaten"))
    placed = peaks.join(frames, "frame_id")
    margin = edge_margin(edge_pixels, edge_fraction)
    inside = F.col("x").between(margin, F.col("width") - margin - 1) & F.col("y").between(margin, F.col("height") - margin - 1)
    ra, dec = sky.to_sky("x", "y")
    out = placed.where(inside).withColumns({"ra_deg": ra, "dec_deg": dec, "snr": F.greatest(F.lit(0.0), F.col("peak_value") / F.col("__s"))})
    number = F.concat_ws("/", F.col("field").cast("string"), F.lpad(F.col("frame_id").cast("string"), 12, "0"), F.lpad(F.col("py").cast("string"), 6, "0"), F.lpad(F.col("px").cast("string"), 6, "0"))
    return out.where(n.finite("ra_deg") & n.finite("dec_deg")).select(number.alias("detection_id"), "frame_id", "field", "x", "y", "ra_deg", "dec_deg", "flux", "peak_value", "snr")


def forced_signals(pixels: DataFrame, frames: DataFrame, targets: DataFrame, noise: DataFrame, fwhm: float = 3.0) -> DataFrame:
    """Flux, uncertainty, SNR and peak SNR of each target (``group_id, field, ra_deg, dec_deg``) in each frame of its field.

    The noise is the clipped spread of the target's annulus (its plain spread, then the frame's, where that is not
    positive) and never below a quarter of the frame's. Places near a frame's side, annuli with fewer than 10 finite pixels
    and apertures with fewer than 4 give no row.
    """
    radius, inner, outer = aperture_radii(fwhm)
    pad = math.ceil(outer) + 2
    x, y = sky.to_pixel("ra_deg", "dec_deg")
    placed = targets.select("group_id", "field", "ra_deg", "dec_deg").join(frames, "field").select("frame_id", F.col("group_id").alias("source_id"), x.alias("sx"), y.alias("sy"), "width", "height")
    whole = lambda c: F.rint(F.col(c))
    fits_in = (whole("sx") >= pad) & (whole("sy") >= pad) & (whole("sx") < F.col("width") - pad) & (whole("sy") < F.col("height") - pad)
    key = ["frame_id", "source_id"]
    near = source_pixels(pixels.where(n.finite("value")).select("frame_id", "y", "x", "value"), placed.where(fits_in), ["frame_id"], outer)
    ring = F.when(F.col("r") >= inner, F.col("value"))
    w = Window.partitionBy(*key)
    near = near.withColumn("__n0", F.count(ring).over(w)).withColumn("__s0", F.stddev_pop(ring).over(w)).where(F.col("__n0") >= LEAST_ANNULUS_PIXELS)
    near = _with_background(near, key, inner, CLIP, CLIP_ROUNDS)
    inside = F.col("r") <= radius
    rows = near.groupBy(*key).agg(
        F.first("sx").alias("x"), F.first("sy").alias("y"), F.first("__bg").alias("background"), F.first("__sd").alias("__sd"), F.first("__s0").alias("__s0"),
        F.count_if(inside).alias("aperture_pixels"), F.sum(F.when(inside, F.col("value"))).alias("__sum"), F.max(F.when(inside, F.col("value"))).alias("__max"),
    ).where(F.col("aperture_pixels") >= LEAST_APERTURE_PIXELS)
    rows = attach(rows, noise.select("frame_id", "frame_scatter"), ["frame_id"], "inner")
    positive = lambda c: F.when(n.finite(c) & (F.col(c) > 0), F.col(c))
    rows = rows.withColumn("noise", F.greatest(F.coalesce(positive("__sd"), positive("__s0"), F.col("frame_scatter")), F.col("frame_scatter") * NOISE_SHARE, F.lit(LEAST_NOISE)))
    rows = rows.withColumn("flux", F.col("__sum") - F.col("aperture_pixels") * F.col("background")).withColumn("flux_uncertainty", F.col("noise") * F.sqrt(F.col("aperture_pixels").cast("double")))
    return rows.select(
        F.col("source_id").alias("group_id"), "frame_id", "x", "y", "aperture_pixels", "background", "noise", "flux", "flux_uncertainty",
        (F.col("flux") / F.greatest(F.col("flux_uncertainty"), F.lit(1e-6))).alias("snr"), ((F.col("__max") - F.col("background")) / F.col("noise")).alias("peak_snr"),
    )


def search_transients(
    pixels: DataFrame, frames: DataFrame, catalog: DataFrame, sigma: float = 8.0, fwhm: float = 3.0, group_radius_arcsec: float = 2.5,
    catalog_radius_arcsec: float = 30.0, edge_pixels: int = 8, edge_fraction: float = 0.0, min_frames: int = 2,
) -> DataFrame:
    """Variable sources of each field: detections grouped on the sky, measured in every frame and ranked by their change.

    Adds the group's mean position and detection count, the nearest catalog star within ``catalog_radius_arcsec`` and the
    median SNR of the frames where the source is bright.
    """
    noise = cut(frame_noise(pixels))
    found = star_detections(pixels, frames, noise, sigma, edge_pixels, edge_fraction)
    grouped = cut(transient_groups(found, group_radius_arcsec, ["field"]))
    of_field = grouped.groupBy("group_id").agg(F.min("field").alias("field"))
    groups = cut(group_positions(grouped).drop("max_snr", "frame_count").join(of_field, "group_id"))
    signals = cut(forced_signals(pixels, frames, groups, noise, fwhm))
    near = sky.nearest_within(groups, catalog, ["group_id"], catalog_radius_arcsec, ["name"], "source_id")
    near = near.select("group_id", F.col("m_name").alias("nearest_catalog_name"), F.col("separation_arcsec").alias("nearest_catalog_separation_arcsec"))
    kept = transient_candidates(signals.join(near, "group_id", "left"), sigma, min_frames)
    bright = signals.where((F.col("flux") > 0) & (F.col("snr") >= sigma)).groupBy("group_id").agg(F.median("snr").alias("median_snr"))
    out = kept.join(groups, "group_id").join(near.select("group_id", "nearest_catalog_name"), "group_id", "left").join(bright, "group_id", "left")
    rank = Window.partitionBy("field").orderBy(F.desc("variability_snr"), F.desc("flux_ratio"), F.desc("max_snr"), "group_id")
    return out.withColumn("candidate_no", F.row_number().over(rank).cast("long")).select(
        "field", "candidate_no", "group_id", "ra_deg", "dec_deg", "detection_count", "frame_count", "signal_count", "variability_snr", "flux_ratio", "median_snr",
        "max_snr", "nearest_catalog_name", "nearest_catalog_separation_arcsec",
    )


def usable_margin(size: Column, annulus_outer: Column, edge_percent: Column) -> Column:
    """Margin on each side of an axis: the annulus, or a percentage of the axis up to 49."""
    return F.greatest(annulus_outer, size * F.least(F.lit(0.49), F.greatest(F.lit(0.0), edge_percent / 100.0)))


def _text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def flagged_photometry(
    pixels: DataFrame, sources: DataFrame, frames: DataFrame, keys: list[str], radius: float, inner: float, outer: float, flag_saturated: bool = True
) -> DataFrame:
    """Aperture photometry with the frame's geometry and saturation level (``width, height, edge_percent,
    saturation_threshold``, any of the last two null) and the flag texts of each source.

    A source outside the usable area has no measurement. A source whose peak is from 95 % of the threshold on, but below
    it, is near saturation.
    """
    geometry = frames.select(*keys, "width", "height", "edge_percent", "saturation_threshold")
    lit = attach(pixels, geometry.select(*keys, "saturation_threshold"), keys)
    level = F.coalesce(F.col("saturation_threshold"), F.lit(float("inf")))
    found = aperture_photometry(lit, sources, keys, radius, inner, outer, saturation=level)
    every = attach(sources.select(*keys, "source_id", "sx", "sy"), found, [*keys, "source_id"])
    every = attach(every, geometry, keys).withColumns({"x": F.coalesce("x", "sx"), "y": F.coalesce("y", "sy")}).drop("sx", "sy")
    percent = F.coalesce(F.col("edge_percent"), F.lit(0.0))
    mx, my = (usable_margin(F.col(c).cast("double"), F.lit(float(outer)), percent) for c in ("width", "height"))
    inside = (F.col("x") >= mx) & (F.col("x") < F.col("width") - mx) & (F.col("y") >= my) & (F.col("y") < F.col("height") - my)
    every = every.withColumn("in_usable_area", F.coalesce(inside, F.lit(False)))
    measured = [c for c in found.columns if c not in (*keys, "source_id", "x", "y", "centroid_shift_pixels", "used_predicted_position")]
    every = every.withColumns({c: F.when(F.col("in_usable_area"), F.col(c)) for c in measured})
    peak, limit = F.col("peak_pixel_value"), F.col("saturation_threshold")
    saturated = F.coalesce(F.col("saturated_pixel_count") > 0, F.lit(False))
    usable_limit = n.finite(limit) & (limit > 0)
    near = F.coalesce(~saturated & usable_limit & (peak >= limit * NEAR_SATURATION), F.lit(False))
    every = every.withColumns({"is_saturated": saturated, "is_near_saturated": near})
    # Fixed texts of the flags.
    outside = F.when(percent <= 0, F.lit("Target lies outside the usable image area.")).otherwise(
        _text("Target lies outside the usable image area (configured %.1f%% edge margin).", percent)
    )
    nearly = _text("Source core is near saturation (peak %.0f is %.1f%% of %.0f).", F.rint(peak), peak / limit * 100.0, F.rint(limit))
    full = _text("Saturated source core detected (peak %.0f >= %.0f; %d saturated pixel(s)).", F.rint(peak), F.rint(limit), F.col("saturated_pixel_count"))
    full_flag = F.when(F.col("is_saturated"), full) if flag_saturated else F.lit(None).cast("string")
    flags = F.filter(F.array(F.when(~F.col("in_usable_area"), outside), F.when(F.col("is_near_saturated"), nearly), full_flag), lambda t: t.isNotNull())
    return every.withColumn("flags", flags).drop("width", "height", "edge_percent", "saturation_threshold")
