"""Null/NaN-safe arithmetic and magnitude formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnitude error scale, MAD-to-sigma factor, Unix epoch as a Julian date.
MAG_ERROR_SCALE = 1.085736
MAD_TO_SIGMA = 1.4826
UNIX_EPOCH_JD = 2440587.5

POGSON = 2.5 / math.log(10.0)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a lambda over a one-element array)."""
    return F.transform(F.array(value), body)[0]


def finite(value) -> Column:
    """True for a non-null, non-NaN, non-infinite number."""
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf")))


def finite_or_null(value) -> Column:
    v = _c(value)
    return F.when(finite(v), v)


def ratio(top, bottom) -> Column:
    """Division that gives null instead of raising when the divisor is 0 or null."""
    return F.try_divide(_c(top).cast("double"), _c(bottom).cast("double"))


def safe_sqrt(value) -> Column:
    v = _c(value)
    return F.sqrt(F.when(v < 0, F.lit(0.0)).otherwise(v))


def safe_log10(value) -> Column:
    v = _c(value)
    return F.when(v > 0, F.log10(v))


def quadrature(*terms) -> Column:
    total = None
    for term in terms:
        t = _c(term)
        total = t * t if total is None else total + t * t
    return F.sqrt(total)


def julian_date(epoch_seconds) -> Column:
    return _c(epoch_seconds) / F.lit(86400.0) + F.lit(UNIX_EPOCH_JD)


def instrumental_magnitude(flux) -> Column:
    return F.lit(-2.5) * safe_log10(flux)


def mag_error(flux, flux_error) -> Column:
    """1.085736 * sigma / F, null unless F > 0 and sigma >= 0 and both finite."""
    f, e = _c(flux), _c(flux_error)
    return F.when(finite(f) & finite(e) & (f > 0) & (e >= 0), F.lit(MAG_ERROR_SCALE) * e / f)


def differential_magnitude(flux, reference_flux) -> Column:
    f, r = _c(flux), _c(reference_flux)
    return F.when((f > 0) & (r > 0), F.lit(-2.5) * F.log10(f / r))


def differential_magnitude_error(flux, flux_error, reference_flux, reference_flux_error) -> Column:
    f, fe, r, re_ = map(_c, (flux, flux_error, reference_flux, reference_flux_error))
    return F.when(
        (f > 0) & (r > 0) & fe.isNotNull() & re_.isNotNull(),
        F.lit(POGSON) * F.sqrt((fe / f) * (fe / f) + (re_ / r) * (re_ / r)),
    )


def combined_mag_error(target_error, ensemble_error) -> Column:
    """Quadrature sum of two magnitude errors, null when either is not usable."""
    t, e = _c(target_error), _c(ensemble_error)
    return F.when(finite(t) & finite(e) & (t >= 0) & (e >= 0), quadrature(t, e))


def total_mag_error(theory, empirical, scintillation) -> Column:
    def term(v):
        v = _c(v)
        return F.when(finite(v) & (v >= 0), v).otherwise(F.lit(0.0))

    t = _c(theory)
    return F.when(finite(t) & (t >= 0), quadrature(t, term(empirical), term(scintillation)))


def ccd_flux_error(
    flux,
    sky_per_pixel,
    aperture_pixels,
    sky_pixels=None,
    read_noise=0.0,
    dark_rate=0.0,
    exposure=0.0,
    gain=1.0,
    counts_are_adu: bool = True,
    saturated=None,
    saturation_level=None,
) -> Column:
    """CCD-equation flux error (source, sky, dark, read and background-estimation noise)."""

    def col(v):
        return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))

    def floor0(v):
        return F.greatest(v, F.lit(0.0))

    f, sky, area, rn, dark, exp_, g = map(col, (flux, sky_per_pixel, aperture_pixels, read_noise, dark_rate, exposure, gain))
    scale = g if counts_are_adu else F.lit(1.0)
    per_pixel = floor0(sky) * scale + floor0(dark) * floor0(exp_) + floor0(rn) * floor0(rn)
    variance = floor0(f) * scale + area * per_pixel
    if sky_pixels is not None:
        extra = ratio(area * area, col(sky_pixels)) * per_pixel
        variance = variance + F.when(finite(extra), extra).otherwise(F.lit(0.0))
    valid = (area > 0) & (g > 0)
    for v in (f, sky, area, rn, dark, exp_, g):
        valid = valid & finite(v)
    if saturated is not None:
        valid = valid & ~F.coalesce(col(saturated), F.lit(False))
    if saturation_level is not None:
        level = col(saturation_level)
        valid = valid & ~(finite(level) & (f >= level))
    sigma = safe_sqrt(variance)
    return F.when(valid, sigma / g if counts_are_adu else sigma)


def scintillation_error(
    diameter_cm, exposure_seconds, airmass, altitude_m=0.0, comparison_count=None, scale_height_m=8000.0, coefficient=0.09
) -> Column:
    """Young-style scintillation magnitude error, widened for a comparison ensemble."""

    def col(v):
        return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))

    d, t, x, h = map(col, (diameter_cm, exposure_seconds, airmass, altitude_m))
    valid = finite(d) & finite(t) & finite(x) & finite(h) & (d > 0) & (t > 0) & (x >= 1.0)
    base = (
        F.lit(coefficient)
        * F.pow(d, F.lit(-2.0 / 3.0))
        * F.pow(x, F.lit(1.75))
        * F.exp(-h / F.lit(scale_height_m))
        / F.sqrt(F.lit(2.0) * t)
    )
    if comparison_count is not None:
        n = col(comparison_count).cast("double")
        base = base * F.when(n > 0, F.sqrt(F.lit(1.0) + F.lit(1.0) / n)).otherwise(F.lit(1.0))
    return F.when(valid, F.lit(MAG_ERROR_SCALE) * base)


def quality_weight(score, error) -> Column:
    """score / sigma^2, or the score itself when there is no usable sigma."""
    s, e = F.greatest(_c(score), F.lit(0.0)), _c(error)
    return F.when(e > 0, s / (e * e)).otherwise(s)


def parallax_or_null(parallax) -> Column:
    p = _c(parallax)
    return F.when(finite(p) & (p > 0), p)


def distance_pc(parallax) -> Column:
    return F.lit(1000.0) / parallax_or_null(parallax)


def absolute_magnitude(magnitude, parallax) -> Column:
    p = parallax_or_null(parallax)
    return F.when(finite(magnitude), _c(magnitude) + F.lit(5.0) * F.log10(p) - F.lit(10.0))


def phase(jd, anchor_jd, period_days) -> Column:
    return F.pmod((_c(jd) - _c(anchor_jd)) / _c(period_days), F.lit(1.0))


def round_half_away(value: Column, digits: int) -> Column:
    """Round as SQL engines do: scale in binary, round halves away from zero, scale back. ``F.round`` alone rounds the
    decimal text of a double, so that a value just below a half can go up."""
    scale = F.lit(10.0**digits)
    out = F.round(value * scale, 0) / scale
    return F.when(F.abs(out) < F.lit(float("inf")), out).otherwise(value)


def rounded(df, digits: int = 6, **special):
    """Round every double column; the last step of a report that is compared or printed."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            d = special.get(f.name, digits)
            # adding 0.0 turns -0.0 into 0.0
            out.append((round_half_away(F.col(f.name).cast("double"), d) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
