"""Registered clustering and classifier queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyloom.functions.lineage import checkpoint_dir, cut
from skyloom.functions.numeric import rounded
from skyloom.operators import clusters as cl
from skyloom.operators import learning as ln
from skyloom.operators import quality as ql
from skyloom.plans import linking as lp
from skyloom.plans import standins as si


def motion_groups(spark, d):
    e = F.col("embedding")
    rows = si.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("star"), F.concat(F.lit("f"), (F.col("label") % 3).cast("string")).alias("field"), *[(e[i].cast("double") * 10.0).alias(c) for i, c in enumerate(("pm_ra", "pm_dec"))],
        (e[2].cast("double") + 0.15).alias("parallax"), e[3].cast("double").alias("bp_rp"), e[4].cast("double").alias("abs_mag"),
    )
    out = cl.common_motion_groups(rows, ["field"], "star", ["pm_ra", "pm_dec"], "parallax", 1.0, ["bp_rp", "abs_mag"])
    return rounded(out.withColumn("min_samples", F.col("min_samples").cast("long")), 6)


def distance_clusters(spark, d):
    c = si.catalog(spark, d)
    rows = c.select(
        F.col("source_no").alias("star"), F.col("object_type").alias("field"), (F.col("source_no") % 37 + F.col("bp_rp")).alias("pm_ra"), (F.col("source_no") % 23 + F.col("magnitude") / 10.0).alias("pm_dec"),
        F.col("parallax_mas").cast("double").alias("parallax"),
    )
    out = cl.common_motion_groups(rows, ["field"], "star", ["pm_ra", "pm_dec"], "parallax", 1.2, None)
    return rounded(out.withColumn("min_samples", F.col("min_samples").cast("long")), 6)


def _transient_detections(spark, d):
    e = lp._sky(spark, d)
    t = si.table(spark, d, "events").select(F.col("event_id").alias("detection_id"), si.epoch("ts").alias("observation_time"))
    return e.join(t, "detection_id").withColumn("peak_value", F.col("flux") * 1.5).withColumn(
        "nearest_catalog_separation_arcsec", F.when(F.col("detection_id") % 3 == 0, F.col("detection_id") % 40 * 0.1)
    )


def candidate_features(spark, d):
    found = lp.transient_candidates(spark, d).withColumnRenamed("group_id", "user_id")
    return rounded(ln.with_candidate_values(ln.transient_features(_transient_detections(spark, d), "user_id"), found, "user_id"), 5)


def moving_features(spark, d):
    scale = F.when(F.col("night") % 2 == 0, F.lit(1.5))
    return rounded(ln.moving_features(lp._detections(spark, d), ["night", "detection_id"], scale).where(F.col("detection_count") >= 3), 9)


def source_features(spark, d):
    from skyloom.plans import photometry as ph

    return rounded(ln.source_features(ph.scored(spark, d)), 4)


def training_features(spark, d):
    from skyloom.plans import photometry as ph

    fits = ph.series_fit(spark, d)
    scored = cut(ph.scored(spark, d, fits).withColumn("background_level", F.col("flux") * 0.2).withColumn("saturation_fraction", F.col("peak_pixel_value") / 450.0))
    series = ql.variability_metrics(scored, fits)
    frames = si.raw_measurements(spark, d).select("object_name", "file_path", "frame_no").distinct().select(
        "object_name", (F.lit(30.0) + F.col("frame_no") % 5 * 15).alias("exposure_seconds"), F.lit(4096.0).alias("width"), (F.lit(2048.0) + F.col("frame_no") % 3).alias("height"), (F.lit(1.0) + F.col("frame_no") % 2).alias("binning")
    )
    stars = si.raw_measurements(spark, d).where(F.col("source_no") % 5 < 4).select("source_id", F.col("catalog_magnitude").alias("magnitude")).distinct()
    settings = {"site_latitude_deg": 48.5, "bortle_scale": 5, "aperture_mode": "fwhm_scaled", "aperture_radius_fwhm_scale": 1.75}
    return rounded(ln.training_features(scored, series, frames, stars, settings), 4)


def _labels(spark, d):
    lab = si.table(spark, d, "labels")
    key = ln.candidate_key(F.lit("doc"), F.col("doc_id"))
    old = lab.select(F.lit("transient").alias("mode"), key.alias("candidate_key"), F.when(F.col("quality") == 1, "real").otherwise("artefact").alias("label"), F.col("doc_id").alias("updated"))
    new = lab.where(F.col("doc_id") % 5 == 0).select(F.lit("transient").alias("mode"), key.alias("candidate_key"), F.when(F.col("toxic") == 1, "artefact").otherwise("real").alias("label"), (F.col("doc_id") + 100000).alias("updated"))
    return old.unionByName(new)


def label_summary(spark, d):
    return ln.label_summary(_labels(spark, d))


FEATURES = ["n_chars", "lines", "digits", "upper", "spaces", "median_word"]


def _document_features(spark, d):
    t = F.col("text")
    count = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    return si.table(spark, d, "documents").select(
        ln.candidate_key(F.lit("doc"), F.col("doc_id")).alias("candidate_key"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(t, "\n")).cast("double").alias("lines"),
        count("[0-9]").cast("double").alias("digits"), count(r"\p{Lu}").cast("double").alias("upper"), count(" ").cast("double").alias("spaces"), (F.length(t) / F.size(F.split(t, " "))).alias("median_word"),
    )


def _trained(spark, d):
    feats = _document_features(spark, d)
    examples = ln.latest_labels(_labels(spark, d)).join(feats, "candidate_key")
    return feats, ln.train_classifier(examples, FEATURES)


def train_classifier(spark, d):
    _, (model, metrics) = _trained(spark, d)
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(metrics.items())], "metric string, value double")


def stored_scores(spark, d):
    """Scores by the latest model of a store in the shared folder, which is loaded and not fitted again."""
    feats, (model, metrics) = _trained(spark, d)
    folder = f"{checkpoint_dir(spark)}/classifier-{uuid.uuid4().hex}"
    ln.save_model(spark, folder, "document", model, FEATURES, feats, metrics)
    return rounded(ln.score_latest(spark, folder, "document", feats).drop("model_id"), 4)


def score_candidates(spark, d):
    feats, (model, _) = _trained(spark, d)
    return rounded(ln.score_candidates(model, feats, FEATURES), 4)


QUERIES = {
    f.__name__: f
    for f in (
        motion_groups, distance_clusters, candidate_features, moving_features, source_features, training_features, label_summary, train_classifier, score_candidates, stored_scores,
    )
}
