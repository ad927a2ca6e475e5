"""Registered photometry, quality and light-curve queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.groups import groups_fit
from skyloom.functions.numeric import rounded
from skyloom.operators import photometry as ph
from skyloom.operators import quality as ql
from skyloom.plans import standins as si

KEY = ["file_path", "filter_name", "source_id"]


def _pairs(spark, d):
    return ph.comparison_pairs(si.raw_measurements(spark, d))


def nearest_comparisons(spark, d):
    return rounded(_pairs(spark, d).select(*KEY, "ref_source_id", F.col("rank").cast("long").alias("rank"), "d2"), 9)


def _summaries(spark, d, summary):
    return ph.with_comparisons(si.raw_measurements(spark, d), summary, how="inner", columns=KEY)


def ensemble_flux(spark, d):
    out = _summaries(spark, d, ph.ensemble).withColumn("comparison_ids", F.concat_ws(";", "comparison_source_ids"))
    return rounded(out.drop("comparison_source_ids"))


def zero_point(spark, d):
    return rounded(_summaries(spark, d, ph.zero_points))


def standard_magnitude(spark, d):
    return rounded(_summaries(spark, d, ph.standard_zero_points))


def differential(spark, d):
    return ph.differential_photometry(si.raw_measurements(spark, d))


def differential_photometry(spark, d):
    out = differential(spark, d).select(
        *KEY, "flux", "differential_magnitude", "differential_magnitude_error", "calibrated_magnitude", "calibrated_magnitude_error",
        "zero_point_source_count", "standard_magnitude", "standard_magnitude_error", "standard_zero_point_source_count",
        "standard_catalog_source", "comparison_scatter", F.concat_ws(";", "comparison_source_ids").alias("comparison_ids"),
        F.concat_ws("; ", "flags").alias("flag_text"),
    )
    return rounded(out)


def series_fit(spark, d):
    """Size check of the (source, filter) series on the cheapest table that has them."""
    return groups_fit(si.raw_measurements(spark, d), ql.SERIES)


def robust_outliers(spark, d):
    return rounded(ql.robust_outliers(differential(spark, d), fits=series_fit(spark, d)).select(*KEY, "robust_z", "is_outlier"))


def hampel(spark, d):
    return rounded(ql.hampel(differential(spark, d), fits=series_fit(spark, d)).select(*KEY, "hampel_z"))


def scored(spark, d, fits=None):
    fits = series_fit(spark, d) if fits is None else fits
    return ql.quality_score(differential(spark, d), fits=fits)


def metrics(spark, d):
    fits = series_fit(spark, d)
    return ql.variability_metrics(scored(spark, d, fits), fits)


def quality_score(spark, d):
    out = scored(spark, d).select(
        *KEY, "quality_score", "quality_weight", "excluded_from_analysis", F.concat_ws("; ", "flags").alias("flag_text"),
        F.concat_ws("; ", "exclusion_reasons").alias("reason_text"),
    )
    return rounded(out, quality_weight=4)


def light_curve_points(spark, d):
    out = ql.light_curve_points(differential(spark, d), series_fit(spark, d))
    return rounded(out.select(*KEY, "point_index", "observation_time", "differential_magnitude", "flux"), observation_time=3)


def variability_metrics(spark, d):
    return rounded(metrics(spark, d).drop("candidate_score"), reduced_chi2=4, stetson_j=5)


def candidate_score(spark, d):
    return metrics(spark, d).select("source_id", "filter_name", "candidate_score")


def cadence(spark, d):
    return rounded(ql.cadence(si.raw_measurements(spark, d).where(~F.col("is_reference"))), 4)


def empirical_scatter(spark, d):
    rows = si.raw_measurements(spark, d)
    return rounded(ql.empirical_scatter(rows, ["filter_name", "object_name"], "instrumental_magnitude"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_comparisons, ensemble_flux, zero_point, standard_magnitude, differential_photometry, robust_outliers, hampel,
        quality_score, light_curve_points, variability_metrics, candidate_score, cadence, empirical_scatter,
    )
}
