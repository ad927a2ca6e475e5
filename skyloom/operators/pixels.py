"""Pixel-table operators: master frames, calibration, apertures, stacks, residuals and streaks.

Pixels are long rows ``frame_id, y, x, value`` (plus kind, group or plane columns where a function says so).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.components import connected_components
from skyloom.functions.groups import attach, group_quantiles, groups_fit, with_robust_scale
from skyloom.functions.lineage import cut


def master_frames(pixels: DataFrame, keys: list[str], fits: bool | None = None) -> DataFrame:
    """Per-pixel median of each kind; only finite values count."""
    at = [*keys, "y", "x"]
    count = pixels.where(n.finite("value")).groupBy(*at).agg(F.count(F.lit(1)).alias("frame_count"))
    return attach(count, group_quantiles(pixels, at, F.col("value"), {"master": 0.5}, fits), at)


def normalized_flat(flat: DataFrame, bias: DataFrame, dark: DataFrame, keys: list[str]) -> DataFrame:
    """(flat - bias - scaled dark) over the median of its positive pixels per key; single unusable pixels become 1.

    ``flat`` and ``dark`` carry ``exposure_seconds``, ``dark`` also ``bias_corrected``. A flat of any key without a
    positive pixel is an error.
    """
    at = [*keys, "y", "x"]
    chosen = chosen_dark(flat.select(*keys, "exposure_seconds").distinct(), dark, keys)
    d = chosen.join(dark.select(*at, F.col("exposure_seconds").alias("dark_exposure"), F.col("master").alias("d")), [*keys, "dark_exposure"])
    j = flat.select(*at, "exposure_seconds", F.col("master").alias("f")).join(bias.select(*at, F.col("master").alias("b")), at, "left").join(
        d, [*at, "exposure_seconds"], "left"
    )
    corrected = F.col("f") - F.coalesce("b", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)) * F.coalesce("scale", F.lit(1.0))
    rows = j.select(*at, corrected.alias("v"))
    level = group_quantiles(rows.where(F.col("v") > 0), keys, F.col("v"), {"m": 0.5})
    rows = attach(rows, level, keys)
    ratio = F.when(F.col("m").isNull(), F.raise_error(F.lit("a flat has no positive pixel")).cast("double")).otherwise(F.col("v") / F.col("m"))
    return rows.withColumn("r", ratio).select(*at, F.when(n.finite("r") & (F.col("r") > 1e-6), F.col("r")).otherwise(F.lit(1.0)).alias("flat"))


def dark_scale(exposure: Column, dark_exposure: Column, bias_corrected: Column) -> Column:
    """Exposure ratio of a bias-corrected dark; an uncorrected dark is never scaled."""
    return F.when(bias_corrected & (exposure > 0) & (dark_exposure > 0), exposure / dark_exposure).otherwise(F.lit(1.0))


def chosen_dark(frames: DataFrame, dark: DataFrame, keys: list[str]) -> DataFrame:
    """For every key and exposure of ``frames`` the dark of nearest exposure (ties: the shorter) and its scale."""
    kinds = dark.groupBy(*keys, F.col("exposure_seconds").alias("dark_exposure")).agg(F.min("bias_corrected").alias("bias_corrected"))
    wanted = frames.select(*keys, "exposure_seconds").distinct()
    order = F.struct(F.abs(F.col("dark_exposure") - F.col("exposure_seconds")), F.col("dark_exposure"))
    near = wanted.join(kinds, keys).groupBy(*keys, "exposure_seconds").agg(F.min_by(F.struct("dark_exposure", "bias_corrected"), order).alias("k"))
    near = near.select(*keys, "exposure_seconds", "k.*")
    return near.withColumn("scale", dark_scale(F.col("exposure_seconds"), F.col("dark_exposure"), F.col("bias_corrected"))).drop("bias_corrected")


def calibrate(lights: DataFrame, bias: DataFrame, dark: DataFrame, flat: DataFrame, keys: list[str]) -> DataFrame:
    """(light - bias - scaled dark) / flat with the masters of the frame's key and the dark of nearest exposure, scaled for
    each frame's own exposure; a pixel that is not finite becomes 0."""
    at = [*keys, "y", "x"]
    chosen = chosen_dark(lights.select(*keys, "exposure_seconds").distinct(), dark, keys)
    d = dark.select(*at, F.col("exposure_seconds").alias("dark_exposure"), F.col("master").alias("d"))
    j = lights.join(chosen, [*keys, "exposure_seconds"], "left").join(d, [*at, "dark_exposure"], "left")
    j = j.join(bias.select(*at, F.col("master").alias("b")), at, "left").join(flat.select(*at, "flat"), at, "left")
    v = n.ratio(F.col("value") - F.coalesce("b", F.lit(0.0)) - F.coalesce("d", F.lit(0.0)) * F.coalesce("scale", F.lit(1.0)), F.coalesce("flat", F.lit(1.0)))
    return j.select("frame_id", "y", "x", F.when(n.finite(v), v).otherwise(F.lit(0.0)).alias("value"))


def pixel_bin(pixels: DataFrame, factor: int) -> DataFrame:
    """Mean of full factor-by-factor blocks."""
    by, bx = F.floor(F.col("y") / factor).cast("long"), F.floor(F.col("x") / factor).cast("long")
    out = pixels.groupBy("frame_id", by.alias("y"), bx.alias("x")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("pixel_count"))
    return out.where(F.col("pixel_count") == factor * factor)


def tile_stats(pixels: DataFrame, tile: int, low: float = 0.01, high: float = 0.99, enough: int = 16) -> DataFrame:
    """Value limits of each tile over finite pixels (non-zero ones when enough of them exist) and the valid fraction."""
    keys = ["frame_id", "tile_y", "tile_x"]
    t = pixels.withColumn("tile_y", F.floor(F.col("y") / tile).cast("long")).withColumn("tile_x", F.floor(F.col("x") / tile).cast("long"))
    good = n.finite("value")
    counts = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixel_count"), F.count_if(good).alias("__ok"), F.count_if(good & (F.col("value") != 0)).alias("__nz")
    )
    used = attach(t, counts, keys).where(good & ((F.col("__nz") < enough) | (F.col("value") != 0)))
    q = group_quantiles(used, keys, F.col("value"), {"low_value": low, "high_value": high})
    return attach(counts, q, keys).select(*keys, "pixel_count", "low_value", "high_value", (F.col("__ok") / F.col("pixel_count")).alias("valid_fraction"))


def region_snr(pixels: DataFrame, signal: Column, background: Column, fits: bool | None = None) -> DataFrame:
    """Mean of the signal region over the background median, with 1.4826 MAD noise (spread when the MAD is 0)."""
    key = ["frame_id"]
    back = pixels.where(background & n.finite("value"))
    med = group_quantiles(back, key, F.col("value"), {"background": 0.5}, fits)
    dev = attach(back, med, key)
    mad = group_quantiles(dev, key, F.abs(F.col("value") - F.col("background")), {"__mad": 0.5}, fits)
    spread = back.groupBy(*key).agg(F.stddev_pop("value").alias("__sd"))
    sig = pixels.where(signal & n.finite("value")).groupBy(*key).agg(F.avg("value").alias("__mean"))
    j = attach(attach(attach(sig, med, key), mad, key), spread, key)
    noise = F.when(F.col("__mad") > 0, F.col("__mad") * n.MAD_TO_SIGMA).otherwise(F.col("__sd"))
    level = F.col("__mean") - F.col("background")
    return j.select(*key, level.alias("signal"), noise.alias("noise"), n.ratio(level, noise).alias("snr"))


def frame_signal(pixels: DataFrame, fits: bool | None = None) -> DataFrame:
    """Signal and noise of whole frames: the 99.5th percentile over the median, and 1.4826 MAD (spread when the MAD is 0)."""
    key = ["frame_id"]
    good = pixels.where(n.finite("value"))
    fits = groups_fit(good, key) if fits is None else fits
    level = group_quantiles(good, key, F.col("value"), {"background": 0.5, "__top": 0.995}, fits)
    dev = attach(good, level, key)
    mad = group_quantiles(dev, key, F.abs(F.col("value") - F.col("background")), {"__mad": 0.5}, fits)
    spread = good.groupBy(*key).agg(F.stddev_pop("value").alias("__sd"))
    j = attach(attach(level, mad, key), spread, key)
    noise = F.when(F.col("__mad") > 0, F.col("__mad") * n.MAD_TO_SIGMA).otherwise(F.col("__sd"))
    signal = F.col("__top") - F.col("background")
    return j.select(*key, "background", signal.alias("signal"), noise.alias("noise"), n.ratio(signal, noise).alias("snr"))


def source_pixels(pixels: DataFrame, sources: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Pixels within ``reach`` of each source: sources are copied to the image squares their circle touches."""
    side = max(1, int(np.ceil(reach)))
    sq = lambda c: F.floor(c / F.lit(float(side))).cast("long")
    s = (
        sources.select(*keys, "source_id", "sx", "sy")
        .withColumn("__ty", F.explode(F.sequence(sq(F.col("sy") - reach), sq(F.col("sy") + reach))))
        .withColumn("__tx", F.explode(F.sequence(sq(F.col("sx") - reach), sq(F.col("sx") + reach))))
    )
    p = pixels.withColumn("__ty", sq(F.col("y"))).withColumn("__tx", sq(F.col("x")))
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    return p.join(s, [*keys, "__ty", "__tx"]).drop("__ty", "__tx").withColumn("r", F.sqrt(dx * dx + dy * dy)).where(F.col("r") <= reach)


def aperture_photometry(
    pixels: DataFrame, sources: DataFrame, keys: list[str], radius: float, inner: float, outer: float, clip: float = 3.0, rounds: int = 2,
    saturation: float | Column | None = None, recentre: bool = True,
) -> DataFrame:
    """Aperture sum minus clipped annulus median, error, SNR and saturation of every source.

    A pixel belongs to a region when its centre does. The source moves to its background-subtracted centroid first; a
    centroid that leaves the aperture is ignored and flagged. A (frame, source) group holds only the pixels of one annulus.
    """
    key = [*keys, "source_id"]
    where = sources
    if recentre:
        near = _with_background(source_pixels(pixels, where, keys, outer), key, inner, clip, rounds)
        v = F.greatest(F.lit(0.0), F.col("value") - F.col("__bg"))
        c = near.where(F.col("r") <= radius).groupBy(*key).agg(
            F.first("sx").alias("px"), F.first("sy").alias("py"), F.sum(v).alias("__w"), F.sum(v * F.col("x")).alias("__wx"), F.sum(v * F.col("y")).alias("__wy")
        )
        cx, cy = n.ratio("__wx", "__w"), n.ratio("__wy", "__w")
        off = F.sqrt((cx - F.col("px")) * (cx - F.col("px")) + (cy - F.col("py")) * (cy - F.col("py")))
        good = F.coalesce((F.col("__w") > 0) & (off <= radius), F.lit(False))
        where = c.select(
            *key, F.when(good, cx).otherwise(F.col("px")).alias("sx"), F.when(good, cy).otherwise(F.col("py")).alias("sy"),
            F.when(good, off).alias("centroid_shift_pixels"), (~good).alias("used_predicted_position"),
        )
    near = _with_background(source_pixels(pixels, where, keys, outer), key, inner, clip, rounds)
    inside = F.col("r") <= radius
    agg = near.groupBy(*key).agg(
        F.first("sx").alias("x"), F.first("sy").alias("y"), F.first("__bg").alias("background_level"), F.first("__sd").alias("background_scatter"),
        F.first("__na").alias("annulus_pixels"), F.count_if(inside).alias("aperture_pixels"), F.sum(F.when(inside, F.col("value"))).alias("__sum"),
        F.max(F.when(inside, F.col("value"))).alias("peak_pixel_value"),
        F.count_if(inside & (F.col("value") >= saturation) if saturation is not None else F.lit(False)).alias("saturated_pixel_count"),
    )
    area = F.col("aperture_pixels").cast("double")
    flux = F.col("__sum") - area * F.col("background_level")
    sd = F.col("background_scatter")
    err = F.sqrt(F.abs(flux) + area * sd * sd * (F.lit(1.0) + area / F.col("annulus_pixels")))
    out = agg.withColumn("flux", flux).withColumn("flux_error", err).drop("__sum")
    out = out.withColumn("snr", n.ratio("flux", "flux_error")).withColumn("instrumental_magnitude", n.instrumental_magnitude("flux"))
    if recentre:
        out = out.join(where.select(*key, "centroid_shift_pixels", "used_predicted_position"), key)
    return out


def _with_background(near: DataFrame, key: list[str], inner: float, clip: float, rounds: int) -> DataFrame:
    """Clipped annulus median and spread on every pixel row of the source."""
    w = Window.partitionBy(*key)
    v = F.when((F.col("r") >= inner) & n.finite("value"), F.col("value"))
    rows = near.withColumn("__v", v)
    for _ in range(rounds):
        rows = rows.withColumn("__m", F.median("__v").over(w)).withColumn("__s", F.stddev_pop("__v").over(w))
        rows = rows.withColumn("__v", F.when(F.abs(F.col("__v") - F.col("__m")) <= F.lit(clip) * F.col("__s"), F.col("__v")))
    return (
        rows.withColumn("__bg", F.median("__v").over(w)).withColumn("__sd", F.stddev_pop("__v").over(w)).withColumn("__na", F.count("__v").over(w)).drop("__m", "__s")
    )


def planes_photometry(planes: DataFrame, sources: DataFrame, radius: float, inner: float, outer: float) -> DataFrame:
    """Same apertures on luminance, red, green and blue, one row per source, with the blue-red colour."""
    keys = ["frame_id", "plane"]
    lum = planes.groupBy("frame_id", "y", "x").agg(F.avg("value").alias("value")).withColumn("plane", F.lit("lum"))
    every = planes.select("frame_id", "plane", "y", "x", "value").unionByName(lum)
    wide = sources.withColumn("plane", F.explode(F.array(*[F.lit(p) for p in ("lum", "red", "green", "blue")])))
    phot = aperture_photometry(every, wide, keys, radius, inner, outer, recentre=False)
    out = phot.groupBy("frame_id", "source_id").pivot("plane", ["lum", "red", "green", "blue"]).agg(
        F.first("flux").alias("flux"), F.first("instrumental_magnitude").alias("mag"), F.first("snr").alias("snr"), F.first("flux_error").alias("flux_error"),
    )
    return out.withColumn("blue_minus_red", F.col("blue_mag") - F.col("red_mag"))


def colour_of(catalog_colour: Column, instrumental_colour: Column) -> tuple[Column, Column]:
    """Colour of a source and where it is from: the catalog's, else the instrumental one of its planes."""
    known, own = n.finite_or_null(catalog_colour), n.finite_or_null(instrumental_colour)
    return F.coalesce(known, own), F.when(known.isNotNull(), "catalog").when(own.isNotNull(), "instrumental").otherwise("none")


def frame_fwhm(pixels: DataFrame, sources: DataFrame, reach: float) -> DataFrame:
    """Full width at half maximum of each source from its radial median profile, and the frame's median."""
    key = ["frame_id", "source_id"]
    near = source_pixels(pixels, sources, ["frame_id"], reach)
    back = near.where(F.col("r") >= reach * 0.6).groupBy(*key).agg(F.median("value").alias("__bg"))
    ring = F.floor(F.col("r") / 0.5).cast("long")
    # a ring of one source is a handful of pixels
    prof = near.groupBy(*key, ring.alias("ring")).agg(F.median("value").alias("v"))
    prof = attach(prof, back, key).withColumn("v", F.col("v") - F.col("__bg"))
    w = Window.partitionBy(*key)
    o = w.orderBy("ring")
    prof = prof.withColumn("__half", F.max("v").over(w) / 2.0).withColumn("__pv", F.lag("v").over(o)).withColumn("__pr", F.lag("ring").over(o))
    mid = lambda c: (c + 0.5) * 0.5
    crossing = (F.col("__pv") >= F.col("__half")) & (F.col("v") < F.col("__half")) & (F.col("__half") > 0)
    at = mid(F.col("__pr")) + (F.col("__pv") - F.col("__half")) / (F.col("__pv") - F.col("v")) * (mid(F.col("ring")) - mid(F.col("__pr")))
    per = prof.where(crossing).groupBy(*key).agg(F.min_by(F.lit(2.0) * at, "ring").alias("fwhm"))
    count = per.groupBy("frame_id").agg(F.count(F.lit(1)).alias("source_count"))
    return attach(count, group_quantiles(per, ["frame_id"], F.col("fwhm"), {"frame_fwhm": 0.5}), ["frame_id"])


def shifted(pixels: DataFrame, keys: list[str], dx: Column, dy: Column) -> DataFrame:
    """Bilinear sample of every frame at (x + dx, y + dy): each pixel gives to at most four places, full places stay."""
    ix, iy = F.floor(dx), F.floor(dy)
    fx, fy = dx - ix, dy - iy
    parts = F.array(
        *[
            F.struct(
                (F.col("x") - ix - ox).cast("long").alias("x"), (F.col("y") - iy - oy).cast("long").alias("y"),
                ((fx if ox else F.lit(1.0) - fx) * (fy if oy else F.lit(1.0) - fy)).alias("w"),
            )
            for ox in (0, 1)
            for oy in (0, 1)
        ]
    )
    given = pixels.select(*keys, "value", F.explode(parts).alias("p")).where(F.col("p.w") > 0)
    out = given.groupBy(*keys, F.col("p.y").alias("y"), F.col("p.x").alias("x")).agg(
        F.sum(F.col("p.w") * F.col("value")).alias("value"), F.sum("p.w").alias("__w")
    )
    return out.where(F.col("__w") > 1.0 - 1e-9).drop("__w")


def tracked_stack(pixels: DataFrame, group: str, vx: float, vy: float, clip: float = 3.0, fits: bool | None = None) -> DataFrame:
    """Stack along one motion: mean, sigma-clipped mean, minimum and maximum per pixel. Needs ``frame_index``."""
    moved = shifted(pixels, [group, "frame_id", "frame_index"], F.col("frame_index") * vx, F.col("frame_index") * vy)
    at = [group, "y", "x"]
    fits = groups_fit(moved, at) if fits is None else fits
    rows = with_robust_scale(moved, at, F.col("value"), "__m", "__s", fits)
    keep = F.col("__s").isNull() | (F.abs(F.col("value") - F.col("__m")) <= clip * F.col("__s"))
    return rows.groupBy(*at).agg(
        F.count(F.lit(1)).alias("frame_count"), F.avg("value").alias("mean_value"), F.avg(F.when(keep, F.col("value"))).alias("clipped_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count_if(~keep).alias("rejected_count"),
    )


def cumulative_stack(moved: DataFrame, group: str) -> DataFrame:
    """Mean stack after each added frame (one row per pixel and frame)."""
    w = Window.partitionBy(group, "y", "x").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("stack_count", F.count(F.lit(1)).over(w)).withColumn("stack_value", F.avg("value").over(w))


def stack_peak(stack: DataFrame, keys: list[str], value: str, x: Column, y: Column, reach: float) -> DataFrame:
    """Brightest pixel near a predicted place, with local median, MAD noise and SNR."""
    near = stack.where((F.abs(F.col("x") - x) <= reach) & (F.abs(F.col("y") - y) <= reach)).withColumn("__v", F.col(value))
    rows = with_robust_scale(near, keys, F.col("__v"), "background", "noise", True)
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct("x", "y"), F.struct("__v", -F.col("y"), -F.col("x"))).alias("p"), F.max("__v").alias("peak_value"),
        F.first("background").alias("background"), F.first("noise").alias("noise"),
    ).select(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "peak_value", n.ratio(F.col("peak_value") - F.col("background"), "noise").alias("snr"))


def motion_grid(spark, max_speed: float = 12.0, speed_step: float = 1.0, angle_step: float = 30.0) -> DataFrame:
    """Trial motions: every speed at every angle (a fixed, small grid)."""
    speeds, angles = int(round(max_speed / speed_step)), int(round(360.0 / angle_step))
    grid = spark.range(speeds * angles).select(
        F.col("id").alias("vector_id"), ((F.floor(F.col("id") / angles) + 1) * speed_step).alias("speed"), ((F.col("id") % angles) * angle_step).alias("angle")
    )
    return grid.withColumn("vx", F.col("speed") * F.cos(F.radians("angle"))).withColumn("vy", F.col("speed") * F.sin(F.radians("angle")))


def shift_stack_sweep(
    residuals: DataFrame, group: str, vectors: DataFrame, min_snr: float = 6.0, top: int | None = None, combine: str = "mean"
) -> DataFrame:
    """Mean (``clipped_mean``: sigma-clipped) stack of the positive residuals along every trial motion, and its peaks by
    strength (the first ``top``, or all).

    Residual rows are expanded by the fixed vector grid and summed map-side per (group, vector, pixel). Needs ``hours``.
    """
    pos = residuals.withColumn("value", F.greatest(F.lit(0.0), F.col("value")))
    grid = vectors.agg(F.collect_list(F.struct("vector_id", "vx", "vy")).alias("grid")).first()["grid"]
    literal = F.array(*[F.struct(F.lit(r["vector_id"]).alias("vector_id"), F.lit(r["vx"]).alias("vx"), F.lit(r["vy"]).alias("vy")) for r in grid])
    trial = pos.withColumn("v", F.explode(literal)).withColumns({"vector_id": F.col("v.vector_id"), "__dx": F.col("hours") * F.col("v.vx"), "__dy": F.col("hours") * F.col("v.vy")})
    moved = shifted(trial, [group, "vector_id", "frame_id"], F.col("__dx"), F.col("__dy"))
    at = [group, "vector_id"]
    if combine == "clipped_mean":
        from skyloom.operators.stacks import clipped

        moved = clipped(moved, [*at, "y", "x"]).where(F.col("__v").isNotNull())
    elif combine != "mean":
        raise ValueError(f"unknown combination {combine}")
    stack = moved.groupBy(*at, "y", "x").agg(F.avg("value").alias("stack_value"), F.count(F.lit(1)).alias("frame_count"))
    rows = with_robust_scale(stack, at, F.col("stack_value"), "__m", "__s", groups_fit(stack, at))
    rows = rows.withColumn("snr", (F.col("stack_value") - F.col("__m")) / F.col("__s")).where(F.col("snr") >= min_snr)
    w = Window.partitionBy(*at).orderBy(F.desc("snr"), "y", "x")
    ranked = rows.withColumn("rank", F.row_number().over(w)).select(*at, "y", "x", "stack_value", "frame_count", "snr", "rank")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def residual_pixels(pixels: DataFrame, group: str, fits: bool | None = None) -> DataFrame:
    """Frame minus the median background of its group, with the frame's clipped spread."""
    back = master_frames(pixels, [group], fits).drop("frame_count")
    diff = attach(pixels, back, [group, "y", "x"]).withColumn("value", F.col("value") - F.col("master")).drop("master")
    return diff


def _merge_bright_first(peaks: DataFrame, radius: float) -> DataFrame:
    """Peaks without a brighter kept one within the radius (ties: smaller y, then x).

    Rounds over pairs that meet in cells: a peak with no brighter open one near it stays, and those near it go.
    """
    order = F.struct(-F.col("value"), F.col("y"), F.col("x"))
    rows = cut(peaks.withColumn("__o", order))
    cell = lambda c: F.floor(F.col(c) / float(radius)).cast("long")
    at = rows.select("frame_id", "y", "x", "__o", cell("y").alias("__cy"), cell("x").alias("__cx"))
    near = rows.select("frame_id", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("__o").alias("__b"), *[F.explode(F.sequence(cell("y") - 1, cell("y") + 1)).alias("__cy")])
    near = near.withColumn("__cx", F.explode(F.sequence(cell("bx") - 1, cell("bx") + 1)))
    dy, dx = F.col("y") - F.col("by"), F.col("x") - F.col("bx")
    pairs = at.join(near, ["frame_id", "__cy", "__cx"]).where((F.col("__b") < F.col("__o")) & (dy * dy + dx * dx <= float(radius) ** 2))
    open_, gone = cut(pairs.select("frame_id", "y", "x", "by", "bx")), None
    while not open_.isEmpty():
        waiting = open_.select("frame_id", F.col("y").alias("by"), F.col("x").alias("bx")).distinct()
        beaten = cut(open_.join(waiting, ["frame_id", "by", "bx"], "left_anti").select("frame_id", "y", "x").distinct())
        gone = beaten if gone is None else gone.union(beaten)
        left = open_.join(beaten, ["frame_id", "y", "x"], "left_anti")
        dead = beaten.select("frame_id", F.col("y").alias("by"), F.col("x").alias("bx"))
        open_ = cut(left.join(dead, ["frame_id", "by", "bx"], "left_anti").select("frame_id", "y", "x", "by", "bx"))
    kept = rows if gone is None else rows.join(gone, ["frame_id", "y", "x"], "left_anti")
    return kept.select(*peaks.columns)


def residual_detections(
    residuals: DataFrame, sigma: float = 5.0, edge: int = 6, size: tuple[int, int] | None = None, merge_radius: float = 2.0, limit: int | None = None,
    known: DataFrame | None = None, known_radius: float = 6.0, min_snr: float | None = None, max_snr: float | None = None,
) -> DataFrame:
    """Local maxima above sigma times the clipped frame spread, merged brightest first within a frame.

    ``min_snr`` and ``max_snr`` bound the local SNR before merging; ``known`` positions of a frame keep detections off.

    ``limit`` keeps the brightest of each frame and is off by default.
    """
    key = ["frame_id"]
    rows = with_robust_scale(residuals, key, F.col("value"), "__m", "__s", groups_fit(residuals, key))
    hot = rows.where(F.col("value") > F.col("__m") + sigma * F.col("__s"))
    if size is not None:
        hot = hot.where(F.col("y").between(edge, size[0] - 1 - edge) & F.col("x").between(edge, size[1] - 1 - edge))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]))
    ask = hot.select("frame_id", "y", "x", F.col("value").alias("__v"), around.alias("o")).select(
        "frame_id", F.col("y").alias("__y"), F.col("x").alias("__x"), "__v", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")
    )
    higher = ask.join(residuals.select("frame_id", "y", "x", "value"), ["frame_id", "y", "x"]).where(F.col("value") > F.col("__v"))
    peaks = hot.join(higher.select("frame_id", F.col("__y").alias("y"), F.col("__x").alias("x")).distinct(), ["frame_id", "y", "x"], "left_anti")
    if known is not None:
        k = known.select("frame_id", F.col("x").alias("__kx"), F.col("y").alias("__ky"))
        side = float(known_radius)
        sq = lambda c: F.floor(c / side).cast("long")
        k = k.withColumn("__ty", F.explode(F.sequence(sq(F.col("__ky")) - 1, sq(F.col("__ky")) + 1))).withColumn("__tx", F.explode(F.sequence(sq(F.col("__kx")) - 1, sq(F.col("__kx")) + 1)))
        p = peaks.withColumn("__ty", sq(F.col("y"))).withColumn("__tx", sq(F.col("x")))
        d2 = (F.col("x") - F.col("__kx")) * (F.col("x") - F.col("__kx")) + (F.col("y") - F.col("__ky")) * (F.col("y") - F.col("__ky"))
        near = p.join(k, ["frame_id", "__ty", "__tx"]).where(d2 <= side * side).select("frame_id", "y", "x").distinct()
        peaks = peaks.join(near, ["frame_id", "y", "x"], "left_anti")
    slim = peaks.select("frame_id", "y", "x", "value", ((F.col("value") - F.col("__m")) / F.col("__s")).alias("local_snr"))
    if min_snr is not None:
        slim = slim.where(F.col("local_snr") >= min_snr)
    if max_snr is not None:
        slim = slim.where(F.col("local_snr") <= max_snr)
    kept = _merge_bright_first(slim, merge_radius)
    if limit is None:
        return kept
    brightest = Window.partitionBy("frame_id").orderBy(F.desc("value"), "y", "x")
    return kept.withColumn("__r", F.row_number().over(brightest)).where(F.col("__r") <= limit).drop("__r")


def streaks(residuals: DataFrame, sigma: float, width: int, min_area: int = 6, fwhm: float = 3.0, elongation: float = 1.8) -> DataFrame:
    """Elongated groups of touching bright pixels with their weighted second moments."""
    key = ["frame_id"]
    rows = with_robust_scale(residuals, key, F.col("value"), "__m", "__s", groups_fit(residuals, key))
    hot = rows.where(F.col("value") > F.col("__m") + sigma * F.col("__s")).withColumn("cell", F.col("y") * width + F.col("x"))
    node = F.concat_ws("/", F.lpad(F.col("frame_id").cast("string"), 12, "0"), F.lpad(F.col("cell").cast("string"), 10, "0"))
    hot = hot.select("frame_id", "y", "x", "value", node.alias("node"))
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    ask = hot.select("frame_id", F.col("node").alias("a"), "y", "x", step.alias("o")).select("frame_id", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    edges = ask.join(hot.select("frame_id", "y", "x", F.col("node").alias("b")), ["frame_id", "y", "x"]).select("a", "b")
    comp = connected_components(hot, edges, "node")
    m = hot.join(comp, "node")
    w = F.col("value")
    s = m.groupBy("frame_id", "component").agg(
        F.count(F.lit(1)).alias("area"), F.sum(w).alias("W"), F.sum(w * F.col("x")).alias("sx"), F.sum(w * F.col("y")).alias("sy"), F.max("value").alias("peak_value")
    )
    s = s.where((F.col("area") >= min_area) & (F.col("W") > 0)).select("frame_id", "component", "area", "peak_value", "W", (F.col("sx") / F.col("W")).alias("cx"), (F.col("sy") / F.col("W")).alias("cy"))
    j = m.join(s, ["frame_id", "component"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    s2 = j.groupBy("frame_id", "component").agg(
        F.first("area").alias("area"), F.first("peak_value").alias("peak_value"), F.first("cx").alias("x"), F.first("cy").alias("y"),
        (F.sum(w * dx * dx) / F.first("W")).alias("xx"), (F.sum(w * dy * dy) / F.first("W")).alias("yy"), (F.sum(w * dx * dy) / F.first("W")).alias("xy"),
    )
    half, diff = (F.col("xx") + F.col("yy")) / 2.0, (F.col("xx") - F.col("yy")) / 2.0
    root = F.sqrt(diff * diff + F.col("xy") * F.col("xy"))
    major, minor = n.safe_sqrt(half + root) * 2.3548, n.safe_sqrt(half - root) * 2.3548
    out = s2.withColumn("major_fwhm", major).withColumn("minor_fwhm", minor)
    ratio = F.col("major_fwhm") / F.greatest(F.col("minor_fwhm"), F.lit(1e-6))
    ok = (F.col("major_fwhm") >= max(2.0, 1.15 * fwhm)) & (ratio >= elongation)
    return out.where(ok).select("frame_id", "area", "peak_value", "x", "y", "major_fwhm", "minor_fwhm")
