"""Candidate features, labels and the candidate classifier (MLlib)."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.groups import attach, group_quantiles, groups_fit
from skyloom.functions.lineage import cut

# Forest size and seed, share held out for validation.
TREES, SEED, VALIDATION_SHARE = 160, 42, 0.25
NO_NEIGHBOUR_ARCSEC = 9999.0


def candidate_key(*parts: Column) -> Column:
    """Digest of the ordered parts that name a candidate."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def transient_features(detections: DataFrame, key: str, frame_total: int | None = None) -> DataFrame:
    """Numeric features of each transient candidate from its detections."""
    sep = F.when(n.finite("nearest_catalog_separation_arcsec"), F.col("nearest_catalog_separation_arcsec"))
    fits = groups_fit(detections, [key])
    base = detections.groupBy(key).agg(
        F.count_distinct("frame_id").alias("frame_count"), F.count(F.lit(1)).alias("detection_count"), F.max("snr").alias("max_snr"), F.stddev_pop("snr").alias("snr_stddev"),
        F.min("snr").alias("snr_min"), F.max("flux").alias("flux_max"), F.min("flux").alias("flux_min"), F.max("peak_value").alias("peak_max"),
        F.count(sep).alias("__with"), F.min(sep).alias("__nearest"), (F.max("observation_time") - F.min("observation_time")).alias("observation_span_seconds"),
    )
    for column, name in (("snr", "median_snr"), ("flux", "flux_median"), ("peak_value", "peak_median")):
        base = attach(base, group_quantiles(detections, [key], F.col(column), {name: 0.5}, fits), [key])
    base = attach(base, group_quantiles(detections, [key], F.abs(F.col("flux")), {"flux_abs_median": 0.5}, fits), [key])
    base = attach(base, group_quantiles(detections, [key], sep, {"__ms": 0.5}, fits), [key])
    return base.select(
        *[c for c in base.columns if not c.startswith("__")],
        (F.col("detection_count") / F.greatest(F.lit(1), F.col("frame_count"))).alias("detection_fraction"),
        F.when(F.col("__with") > 0, 1.0).otherwise(0.0).alias("has_catalog_neighbor"),
        F.coalesce("__nearest", F.lit(NO_NEIGHBOUR_ARCSEC)).alias("nearest_catalog_separation_arcsec"),
        (F.col("__with") / F.greatest(F.lit(1), F.col("detection_count"))).alias("detection_catalog_match_fraction"),
        F.coalesce("__ms", F.lit(NO_NEIGHBOUR_ARCSEC)).alias("median_detection_catalog_separation_arcsec"),
    )


def with_candidate_values(features: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Features of transient candidates with the variability SNR and flux ratio found for them (0 where none was)."""
    found = candidates.select(key, "variability_snr", "flux_ratio")
    return attach(features, found, [key]).withColumns({c: F.coalesce(n.finite_or_null(c), F.lit(0.0)) for c in ("variability_snr", "flux_ratio")})


def moving_features(detections: DataFrame, keys: list[str], arcsec_per_pixel: Column | None = None, method: str = "tracklet") -> DataFrame:
    """Numeric features of each moving candidate from its linked detections and their straight-line fit.

    ``arcsec_per_pixel`` is a column of the detections (equal within a candidate, null: unknown scale).
    """
    scale = F.lit(None).cast("double") if arcsec_per_pixel is None else arcsec_per_pixel
    detections = detections.withColumn("__scale", n.finite_or_null(scale.cast("double")))
    fits = groups_fit(detections, keys)
    line = detections.groupBy(*keys).agg(
        F.regr_slope("x", "hours").alias("__vx"), F.regr_intercept("x", "hours").alias("__ix"), F.regr_slope("y", "hours").alias("__vy"), F.regr_intercept("y", "hours").alias("__iy"),
        F.min("hours").alias("__t0"), F.max("hours").alias("__t1"),
    )
    rows = attach(detections, line, keys)
    dx = F.col("x") - F.col("__ix") - F.col("__vx") * F.col("hours")
    dy = F.col("y") - F.col("__iy") - F.col("__vy") * F.col("hours")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detection_count"), (F.max("frame_index") - F.min("frame_index") + 1).cast("double").alias("frame_index_span"),
        F.avg("local_snr").alias("average_snr"), F.min("local_snr").alias("local_snr_min"), F.max("local_snr").alias("local_snr_max"), F.stddev_pop("local_snr").alias("local_snr_stddev"),
        F.min("peak_value").alias("peak_min"), F.max("peak_value").alias("peak_max"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("fit_rms_px"), F.sqrt(F.max(dx * dx + dy * dy)).alias("max_deflection_px"),
        F.stddev_pop("x").alias("x_stddev"), F.stddev_pop("y").alias("y_stddev"), ((F.max("hours") - F.min("hours")) * 3600.0).alias("observation_span_seconds"),
        F.max("peak_value").alias("peak_value"), F.max("__scale").alias("__scale"), F.lit(1.0 if method == "synthetic_sweep" else 0.0).alias("method_is_synthetic_sweep"),
        *[F.first(c).alias(c) for c in ("__vx", "__ix", "__vy", "__iy", "__t0", "__t1")],
    )
    base = attach(base, group_quantiles(detections, keys, F.col("local_snr"), {"local_snr_median": 0.5}, fits), keys)
    base = attach(base, group_quantiles(detections, keys, F.col("peak_value"), {"peak_median": 0.5}, fits), keys)
    at = lambda i, v, t: F.col(i) + F.col(v) * F.col(t)
    base = base.withColumns({"start_x": at("__ix", "__vx", "__t0"), "start_y": at("__iy", "__vy", "__t0"), "end_x": at("__ix", "__vx", "__t1"), "end_y": at("__iy", "__vy", "__t1")})
    ddx, ddy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    return base.withColumns(
        {
            "motion_px_per_hour": n.quadrature("__vx", "__vy"), "delta_x": ddx, "delta_y": ddy, "abs_delta_x": F.abs(ddx), "abs_delta_y": F.abs(ddy),
            "displacement_px": F.sqrt(ddx * ddx + ddy * ddy), "linked_frame_fraction": F.col("detection_count") / F.greatest(F.lit(1.0), F.col("frame_index_span")),
        }
    ).withColumns(
        {"has_arcsec_motion": F.when(F.col("__scale").isNull(), 0.0).otherwise(1.0), "motion_arcsec_per_hour": F.coalesce(F.col("motion_px_per_hour") * F.col("__scale"), F.lit(0.0))}
    ).drop("__vx", "__ix", "__vy", "__iy", "__t0", "__t1", "__scale")


#: Fixed names of the settings that describe site and equipment, and of the aperture settings; a missing one counts as 0.
SITE_SETTINGS = (
    "site_latitude_deg", "site_longitude_deg", "site_elevation_m", "telescope_focal_length_mm", "telescope_aperture_mm", "telescope_focal_ratio", "camera_pixel_size_um", "bortle_scale",
)
APERTURE_SETTINGS = (
    "aperture_radius_pixels", "annulus_inner_radius_pixels", "annulus_outer_radius_pixels", "aperture_radius_fwhm_scale", "annulus_inner_radius_fwhm_scale", "annulus_outer_radius_fwhm_scale",
)
METRICS = ("mad", "rms", "amplitude", "reduced_chi2", "von_neumann", "stetson_j")


def _present(df: DataFrame, column: str, kind: str = "double") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def training_features(measurements: DataFrame, series: DataFrame, frames: DataFrame, stars: DataFrame, settings: dict | None = None) -> DataFrame:
    """All numeric features of each source over its filters: magnitude, counts and shares, SNR, flux, scatter, quality,
    background, centroid, apertures, series metrics, the frames of its object, site, equipment and aperture settings.

    ``series``: one row per (source, filter) with ``candidate_score`` and the metrics; ``frames``: ``object_name,
    exposure_seconds, width, height, binning`` per file; ``stars``: ``source_id, magnitude``. Columns that the measurements
    lack and values nothing is known of count as 0 (an unknown magnitude as 99). Every median is exact.
    """
    key, settings = ["source_id"], settings or {}
    m = measurements
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) / F.greatest(F.lit(1), F.count(F.lit(1)))
    has = F.col("differential_magnitude").isNotNull()
    excluded, flagged = F.coalesce("excluded_from_analysis", F.lit(False)), F.coalesce(F.size("flags") > 0, F.lit(False))
    good = lambda c: n.finite_or_null(_present(m, c).cast("double"))
    base = m.groupBy(*key).agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count_if(has).alias("valid_point_count"), F.count_if(excluded).alias("excluded_point_count"), F.count_if(flagged).alias("flagged_count"),
        share(has).alias("valid_point_fraction"), share(excluded).alias("excluded_point_fraction"), share(flagged).alias("flagged_fraction"), share(_present(m, "is_saturated", "boolean")).alias("saturated_fraction"),
        share(_present(m, "is_near_saturated", "boolean")).alias("near_saturated_fraction"), F.count_distinct("file_path").alias("unique_file_count"), F.count_distinct("filter_name").alias("unique_filter_count"),
        (F.max("observation_time") - F.min("observation_time")).alias("observation_span_seconds"), F.max(good("snr")).alias("max_snr"), F.min(good("snr")).alias("min_snr"), F.stddev_pop(good("snr")).alias("snr_stddev"),
        F.max(good("flux")).alias("max_flux"), F.min(good("flux")).alias("min_flux"), F.stddev_pop(good("flux")).alias("flux_stddev"), F.stddev_pop(good("differential_magnitude")).alias("light_curve_rms"),
        (F.max(good("differential_magnitude")) - F.min(good("differential_magnitude"))).alias("light_curve_range"), F.max(good("centroid_shift_pixels")).alias("max_centroid_shift_px"),
        F.max(good("saturation_fraction")).alias("max_saturation_fraction"), F.min("object_name").alias("__object"),
    )
    medians = {
        "median_snr": "snr", "median_flux": "flux", "median_flux_error": "flux_error", "median_mag_error": "differential_magnitude_error", "median_comparison_scatter": "comparison_scatter",
        "median_quality_score": "quality_score", "median_background_level": "background_level", "median_background_scatter": "background_scatter", "median_centroid_shift_px": "centroid_shift_pixels",
        "median_aperture_radius": "aperture_radius", "median_annulus_inner_radius": "annulus_inner_radius", "median_annulus_outer_radius": "annulus_outer_radius",
    }
    fits = groups_fit(m, key)
    values = {name: good(column) for name, column in medians.items()} | {"median_comparison_star_count": F.size("comparison_source_ids").cast("double")}
    if fits:  # one pass for all medians
        base = attach(base, m.groupBy(*key).agg(*[F.median(v).alias(name) for name, v in values.items()]), key)
    else:
        for name, v in values.items():
            base = attach(base, group_quantiles(m, key, v, {name: 0.5}, False), key)
    per = series.groupBy(*key).agg(
        F.count(F.lit(1)).alias("series_count"), F.max("candidate_score").alias("best_candidate_score"), F.median("candidate_score").alias("median_candidate_score"),
        *[F.max(n.finite_or_null(c)).alias(f"best_metric_{c}") for c in METRICS],
    )
    of_object = frames.groupBy(F.col("object_name").alias("__object")).agg(
        F.min("exposure_seconds").alias("min_exposure_seconds"), F.max("exposure_seconds").alias("max_exposure_seconds"),
        *[F.percentile(c, F.lit(0.5)).alias(name) for c, name in (("exposure_seconds", "median_exposure_seconds"), ("width", "median_frame_width"), ("height", "median_frame_height"), ("binning", "median_binning"))],
    )
    out = attach(attach(base, per, key), of_object, ["__object"]).drop("__object")
    out = attach(out, stars.select("source_id", n.finite_or_null("magnitude").alias("source_magnitude")), key)
    out = out.withColumn("source_magnitude", F.coalesce("source_magnitude", F.lit(99.0)))
    fixed = {c: float(settings.get(c) or 0.0) for c in SITE_SETTINGS} | {f"settings_{c}": float(settings.get(c) or 0.0) for c in APERTURE_SETTINGS}
    fixed |= {f"aperture_mode_{mode}": float(settings.get("aperture_mode", "fixed") == mode) for mode in ("fixed", "fwhm_scaled")}
    numbers = [c for c in out.columns if c not in key]
    return out.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers], *[F.lit(v).alias(c) for c, v in fixed.items()])


def source_features(measurements: DataFrame) -> DataFrame:
    """Numeric features of each (source, filter) from its measurements: counts, fractions, SNR, flux, scatter, background, centroid."""
    key = ["source_id", "filter_name"]
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) / F.count(F.lit(1))
    base = measurements.groupBy(*key).agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count_distinct("file_path").alias("frame_count"), share(F.col("excluded_from_analysis")).alias("excluded_fraction"),
        share(F.col("is_saturated")).alias("saturated_fraction"), share(F.col("differential_magnitude").isNotNull()).alias("differential_fraction"), F.min("snr").alias("snr_min"), F.max("snr").alias("snr_max"),
        F.stddev_pop("snr").alias("snr_stddev"), F.stddev_pop("flux").alias("flux_stddev"), F.avg("quality_score").alias("quality_mean"), F.avg("comparison_scatter").alias("comparison_scatter_mean"),
        F.stddev_pop("differential_magnitude").alias("differential_stddev"), F.avg("centroid_shift_pixels").alias("centroid_shift_mean"), F.max("centroid_shift_pixels").alias("centroid_shift_max"),
    )
    fits = groups_fit(measurements, key)
    for column, name in (("snr", "snr_median"), ("flux", "flux_median"), ("differential_magnitude", "differential_median")):
        base = attach(base, group_quantiles(measurements, key, F.col(column), {name: 0.5}, fits), key)
    return base


def latest_labels(labels: DataFrame) -> DataFrame:
    """Last label of each (mode, candidate)."""
    rest = [c for c in labels.columns if c not in ("mode", "candidate_key")]
    best = labels.groupBy("mode", "candidate_key").agg(F.max_by(F.struct(*rest), F.struct("updated", "label")).alias("__r"))
    return best.select("mode", "candidate_key", "__r.*")


def label_summary(labels: DataFrame) -> DataFrame:
    return latest_labels(labels).groupBy("mode", "label").agg(F.count(F.lit(1)).alias("label_count"), F.max("updated").alias("last_updated"))


def _balanced(rows: DataFrame) -> DataFrame:
    """Row weights that give every class the same total."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__c"))
    total, classes = rows.count(), counts.count()
    return attach(rows, counts, ["label"]).withColumn("weight", F.lit(float(total)) / (F.col("__c") * classes)).drop("__c")


def train_classifier(examples: DataFrame, features: list[str], trees: int = TREES) -> tuple[PipelineModel, dict[str, float]]:
    """Balanced random forest on labelled examples, validated on a stratified quarter and refitted on everything.

    Held-out rows are the lowest digests of each label. Missing features count as 0.
    """
    rows = cut(examples.select("candidate_key", "label", *[F.coalesce(n.finite_or_null(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features]))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if sum(counts.values()) < 2 or len(counts) < 2:
        raise ValueError("training needs at least two labels")
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="features"),
        RandomForestClassifier(labelCol="label_index", featuresCol="features", weightCol="weight", numTrees=trees, seed=SEED, maxDepth=8),
    ]
    metrics: dict[str, float] = {}
    if sum(counts.values()) >= 6 and min(counts.values()) >= 2:
        cuts = group_quantiles(rows.withColumn("__h", F.xxhash64("candidate_key").cast("double")), ["label"], F.col("__h"), {"__cut": VALIDATION_SHARE})
        split = attach(rows.withColumn("__h", F.xxhash64("candidate_key").cast("double")), cuts, ["label"])
        train, held = split.where(F.col("__h") > F.col("__cut")), split.where(F.col("__h") <= F.col("__cut"))
        scored = Pipeline(stages=stages).fit(_balanced(train)).transform(_balanced(held))
        for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
            metrics[f"validation_{name}"] = MulticlassClassificationEvaluator(labelCol="label_index", metricName=metric).evaluate(scored)
        metrics["validation_count"] = float(scored.count())
    return Pipeline(stages=stages).fit(_balanced(rows)), metrics


def score_candidates(model: PipelineModel, candidates: DataFrame, features: list[str]) -> DataFrame:
    """Predicted label, its confidence and all class probabilities."""
    names = model.stages[0].labels
    rows = candidates.withColumns({c: F.coalesce(n.finite_or_null(F.col(c).cast("double")), F.lit(0.0)) for c in features})
    out = PipelineModel(model.stages[1:]).transform(rows).withColumn("__p", vector_to_array("probability"))
    label = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("prediction") + 1).cast("int"))
    return out.select(
        "candidate_key", label.alias("predicted_label"), F.array_max("__p").alias("confidence"), *[F.col("__p")[i].alias(f"p_{x}") for i, x in enumerate(names)]
    )


MODEL_SCHEMA = "mode string, version long, model_id string, features array<string>, example_count long, metrics map<string,double>, trained_at timestamp"


def save_model(spark: SparkSession, folder: str, mode: str, model: PipelineModel, features: list[str], examples: DataFrame, metrics: dict[str, float]) -> str:
    """Store a trained model as the latest of its mode; returns its id.

    The model is written to a folder of its own first. The row that names it is one small file that appears whole, so a
    reader sees the old model or the new one, and a lost driver leaves at worst a folder that nothing names.
    """
    model_id = uuid.uuid4().hex
    model.write().save(f"{folder}/models/{model_id}")
    before = [r["version"] for r in [_latest(spark, folder, mode)] if r]
    row = [(mode, (before[0] if before else 0) + 1, model_id, list(features), examples.count(), {k: float(v) for k, v in metrics.items()})]
    fresh = spark.createDataFrame(row, MODEL_SCHEMA.rsplit(",", 1)[0]).withColumn("trained_at", F.current_timestamp())
    fresh.coalesce(1).write.mode("append").parquet(f"{folder}/index")
    return model_id


def models(spark: SparkSession, folder: str) -> DataFrame:
    """All stored models; none when nothing has been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MODEL_SCHEMA)
    return spark.read.schema(MODEL_SCHEMA).parquet(f"{folder}/index")


def _latest(spark: SparkSession, folder: str, mode: str):
    order = F.struct("version", "trained_at", "model_id")
    found = models(spark, folder).where(F.col("mode") == mode).agg(F.max_by(F.struct("model_id", "version", "features", "example_count"), order).alias("m")).first()
    return found["m"]


def score_latest(spark: SparkSession, folder: str, mode: str, candidates: DataFrame) -> DataFrame | None:
    """Scores by the latest stored model of the mode, without a fit; None when there is none. Features that the model knows
    and the candidates lack count as 0."""
    latest = _latest(spark, folder, mode)
    if latest is None:
        return None
    lacking = {c: F.lit(0.0) for c in latest["features"] if c not in candidates.columns}
    model = PipelineModel.load(f"{folder}/models/{latest['model_id']}")
    return score_candidates(model, candidates.withColumns(lacking), list(latest["features"])).withColumn("model_id", F.lit(latest["model_id"]))


def training_summary(spark: SparkSession, folder: str, labels: DataFrame) -> DataFrame:
    """Labels per mode and class beside the latest stored model of the mode."""
    order = F.struct("version", "trained_at", "model_id")
    last = models(spark, folder).groupBy("mode").agg(F.max_by("model_id", order).alias("model_id"), F.max("version").alias("version"), F.max_by("example_count", order).alias("example_count"))
    return label_summary(labels).join(last, "mode", "left")
