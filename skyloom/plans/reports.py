"""Registered export and comparison-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions.lineage import cut
from skyloom.functions.numeric import rounded
from skyloom.operators import catalogs as ct
from skyloom.operators import comparison as cp
from skyloom.operators import export as ex
from skyloom.operators import photometry as pm
from skyloom.operators import quality as ql
from skyloom.operators.photometry import near_saturated
from skyloom.plans import photometry as ph
from skyloom.plans import standins as si

FILTERS = {"click": "Johnson V", "view": "R", "purchase": "Lum", "error": "b", "signup": "weird, one"}


def _science(spark, d):
    scored = ph.scored(spark, d)
    raw = si.raw_measurements(spark, d)
    rows = ex.with_resolved_calibration(scored, raw.where("is_reference"))
    return ex.with_check_star(rows, scored.where("is_check"))


def check_rms(spark, d):
    return rounded(ex.check_rms(_science(spark, d)))


def science_rows(spark, d):
    return rounded(ex.science_rows(_science(spark, d)), 5)


def _submitted(spark, d):
    from skyloom.functions.names import literal_map

    rows = _science(spark, d).withColumn("filter_name", F.element_at(literal_map(FILTERS), F.col("filter_name")))
    return rows.withColumn("airmass", F.when(F.col("source_no") % 3 != 0, F.lit(1.0) + F.col("source_no") % 10 / 10.0))


def _submission(spark, d):
    return ex.submission_rows(_submitted(spark, d), chart_id="X1")


def submission_rows(spark, d):
    return _submission(spark, d)


def submission_preflight(spark, d):
    return ex.submission_preflight(_submission(spark, d))


def reference_manifest(spark, d):
    return rounded(ex.reference_manifest(ph.scored(spark, d), si.raw_measurements(spark, d).where("is_reference")))


def submission_warnings(spark, d):
    rows = cut(_submitted(spark, d))
    return ex.submission_warnings(rows, ex.submission_rows(rows, chart_id="X1"))


def provenance_manifest(spark, d):
    raw = si.raw_measurements(spark, d).withColumn("aperture_radius", F.lit(3.0) + F.col("source_no") % 4 * 0.5)
    return rounded(ex.provenance_manifest(ex.science_rows(_science(spark, d)), raw, raw.where("is_reference")), 3)


def report_summary(spark, d):
    ok = ~F.col("excluded_from_analysis") & ~F.col("is_saturated")
    return ex.report_summary(ph.scored(spark, d), ok)


def _best_sets(spark, d):
    raw = si.raw_measurements(spark, d)
    ranking = cp.reference_ranking(raw, 0.75, 4, near_saturated())
    key = F.concat_ws("|", "filter_name", "source_id")
    favourites = ranking.select(key.alias("series_key"), F.col("reference_id").alias("source_id"), F.col("rank").alias("position"))
    parts = F.split("series_key", r"\|")
    sets = ct.comparison_sets(favourites, "series_key", 3).select(parts[0].alias("filter_name"), parts[1].alias("source_id"), "set_id", "members")
    fits = ph.series_fit(spark, d)
    scored = ql.quality_score(pm.differential_photometry(cp.comparison_trials(raw, sets), automatic=False), fits=fits)
    scored = cut(scored.select("file_path", "source_id", "filter_name", "observation_time", "flux", "flux_error", "instrumental_magnitude", "differential_magnitude", "differential_magnitude_error", "excluded_from_analysis", "quality_score", "comparison_scatter"))
    return cp.best_comparison_set(scored, ql.variability_metrics(scored, fits), fits)


def best_comparison_set(spark, d):
    return rounded(_best_sets(spark, d), 5)


def variable_discovery(spark, d):
    raw = si.raw_measurements(spark, d)
    out = cp.variable_discovery(_best_sets(spark, d), raw.where(~F.col("is_reference")))
    return rounded(out.select("source_id", "filter_name", "outcome", "set_id", "candidate_score"), 5)


QUERIES = {
    f.__name__: f
    for f in (
        check_rms, science_rows, submission_rows, submission_preflight, reference_manifest, submission_warnings, provenance_manifest, report_summary, best_comparison_set, variable_discovery,
    )
}
