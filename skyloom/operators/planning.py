"""Observing conditions and forecasts: moonlight, variable-star events, altitude crossings, prediction confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.groups import groups_fit, with_previous

# Fixed values of the moonlight model.
MEAN_MOON_DISTANCE_KM = 384_400.0
EXTINCTION_MAG = 0.172
DARK_ZENITH_NL = 79.0
SCORE_SCALE_MAG = 4.5


def _airmass(zenith: Column) -> Column:
    s = F.sin(F.radians(F.least(F.lit(90.0), F.greatest(F.lit(0.0), zenith))))
    return F.pow(F.greatest(F.lit(1e-6), F.lit(1.0) - F.lit(0.96) * s * s), F.lit(-0.5))


def moonlight(rows: DataFrame, extinction: float = EXTINCTION_MAG, dark_nl: float = DARK_ZENITH_NL) -> DataFrame:
    """Scattered moonlight in nanoLamberts, a 0-100 impact score and its category."""
    alpha, rho = F.abs("phase_angle_deg"), F.greatest(F.lit(0.05), F.col("separation_deg"))
    ten = lambda e: F.pow(F.lit(10.0), e)
    lunar = ten(F.lit(-0.4) * (F.lit(3.84) + F.lit(0.026) * alpha + F.lit(4.0e-9) * F.pow(alpha, F.lit(4.0))))
    lunar = lunar * F.pow(F.lit(MEAN_MOON_DISTANCE_KM) / F.greatest(F.lit(1.0), F.col("distance_km")), F.lit(2.0))
    cos_rho = F.cos(F.radians(rho))
    wide = ten(F.lit(5.36)) * (F.lit(1.06) + cos_rho * cos_rho) + ten(F.lit(6.15) - rho / 40.0)
    scatter = F.when(rho < 10.0, F.lit(6.2e7) / (rho * rho)).otherwise(wide)
    x_moon = _airmass(F.lit(90.0) - F.col("moon_altitude_deg"))
    x_target = _airmass(F.lit(90.0) - F.greatest(F.lit(0.0), F.col("target_altitude_deg")))
    k = max(0.0, extinction)
    light = scatter * lunar * ten(F.lit(-0.4 * k) * x_moon) * (F.lit(1.0) - ten(F.lit(-0.4 * k) * x_target))
    out = rows.withColumn("moonlight_nl", F.when(F.col("moon_altitude_deg") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), light)))
    delta = F.abs(F.lit(-2.5) * F.log10((F.col("moonlight_nl") + dark_nl) / dark_nl))
    score = F.when(F.col("moonlight_nl") <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.lit(100.0) * delta / SCORE_SCALE_MAG))
    out = out.withColumn("moonlight_score", score)
    s = F.col("moonlight_score")
    return out.withColumn(
        "moonlight_category", F.when(s < 20, "Low").when(s < 40, "Moderate").when(s < 65, "High").otherwise("Severe")
    )


def confidence_score(magnitude, limit, snr, offset_px, trail_px, x, y, width, height) -> Column:
    """0-0.99 from magnitude margin, SNR, offset, trail and distance to the frame edge."""

    def known(c, value):
        return F.when(c.isNotNull(), value).otherwise(F.lit(0.0))

    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(top), v))
    edge = F.least(x, y, width - x, height - y)
    score = (
        F.lit(0.1)
        + known(magnitude, clip((limit - magnitude) / F.greatest(F.lit(2.0), limit), 0.25))
        + known(snr, clip(snr / 20.0, 0.4))
        + known(offset_px, F.greatest(F.lit(0.0), F.lit(0.25) * (F.lit(1.0) - F.least(offset_px, F.lit(10.0)) / 10.0)))
        + F.when(trail_px > 1.5, 0.05).otherwise(0.0)
        - F.when(edge < 12.0, 0.15).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))


def detection_status(visible: Column, confidence: Column, magnitude: Column, limit: Column) -> Column:
    return (
        F.when(visible & (confidence >= 0.75), "High-confidence match")
        .when(visible & (confidence >= 0.5), "Plausible visible match")
        .when(magnitude <= limit, "Predicted in field; visual confirmation weak")
        .otherwise("Predicted in field")
    )


def motion_rate(ra_rate, dec_rate) -> Column:
    return n.quadrature(ra_rate, dec_rate)


def position_at(ra_deg, dec_deg, ra_rate, dec_rate, hours) -> tuple[Column, Column]:
    """Position after so many hours of linear motion (arcseconds per hour along each coordinate; a missing rate counts 0)."""
    ra, dec, h = [F.col(c) if isinstance(c, str) else c for c in (ra_deg, dec_deg, hours)]
    a, b = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) for c in (ra_rate, dec_rate)]
    return ra + a * h / 3600.0, dec + b * h / 3600.0


def event_forecast(
    stars: DataFrame, now_jd: float, back_days: float = 2.0, ahead_days: float = 4.0, limit: int = 48
) -> DataFrame:
    """Upcoming minima (eclipsing: I at phase 0, II at 0.5) or maxima of every star around a date.

    Input: star_id, variability_type, period_days, epoch_jd, eclipse_hours (null when unknown).
    """
    eclipsing = F.upper(F.coalesce("variability_type", F.lit(""))).rlike("^E")
    kinds = F.when(
        eclipsing, F.array(F.struct(F.lit("Min I").alias("event"), F.lit(0.0).alias("phase")), F.struct(F.lit("Min II").alias("event"), F.lit(0.5).alias("phase")))
    ).otherwise(F.array(F.struct(F.lit("Max").alias("event"), F.lit(0.0).alias("phase"))))
    rows = stars.where(n.finite("period_days") & (F.col("period_days") > 0) & n.finite("epoch_jd")).withColumn("__k", F.explode(kinds))
    base = F.col("epoch_jd") + F.col("__k.phase") * F.col("period_days")
    first = F.ceil((F.lit(now_jd - back_days) - base) / F.col("period_days"))
    last = F.floor((F.lit(now_jd + ahead_days) - base) / F.col("period_days"))
    rows = rows.where(first <= last).withColumn("cycle", F.explode(F.sequence(first, F.least(last, first + limit - 1))))
    jd = base + F.col("cycle") * F.col("period_days")
    half = F.col("eclipse_hours") / 48.0
    rows = rows.select(
        "star_id", F.col("__k.event").alias("event"), "cycle", jd.alias("event_jd"),
        F.when(eclipsing, jd - half).alias("window_start_jd"), F.when(eclipsing, jd + half).alias("window_end_jd"),
    )
    from pyspark.sql import Window

    w = Window.partitionBy("star_id").orderBy("event_jd", "event")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def crossings(samples: DataFrame, keys: list[str], altitude: float, fits: bool | None = None) -> DataFrame:
    """First rising and first setting crossing of an altitude, interpolated between consecutive samples."""
    fits = groups_fit(samples, keys) if fits is None else fits
    rows = with_previous(samples, keys, "at", ["sample_id"], {"__pt": "at", "__pa": "altitude_deg"}, fits)
    a, b = F.col("__pa") - altitude, F.col("altitude_deg") - altitude
    at = F.col("__pt") + (F.col("at") - F.col("__pt")) * F.when(b != a, -a / (b - a)).otherwise(0.0)
    rows = rows.withColumn("__x", at)
    up, down = (a < 0) & (b >= 0), (a > 0) & (b <= 0)
    return rows.groupBy(*keys).agg(
        F.min(F.when(up, F.col("__x"))).alias("first_rise"), F.min(F.when(down, F.col("__x"))).alias("first_set"),
        F.count_if(up | down).alias("crossing_count"),
    )
