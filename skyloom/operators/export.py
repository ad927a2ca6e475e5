"""Science rows, submission rows and report manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.groups import attach, group_quantiles
from skyloom.functions.names import literal_map
from skyloom.operators.photometry import near_saturated

FRAME = ["file_path", "filter_name"]
ROW = ["file_path", "filter_name", "source_id"]
SERIES = ["source_id", "filter_name"]

# Filter text -> submission filter code.
FILTER_CODES = {
    "u": "U", "johnsonu": "U", "johnson_u": "U", "b": "B", "johnsonb": "B", "johnson_b": "B", "v": "V", "johnsonv": "V",
    "johnson_v": "V", "r": "R", "rc": "R", "r_c": "R", "cousinsr": "R", "cousins_r": "R", "i": "I", "ic": "I", "i_c": "I",
    "cousinsi": "I", "cousins_i": "I", "j": "J", "h": "H", "k": "K", "y": "Y", "su": "SU", "sloanu": "SU", "sloan_u": "SU",
    "sg": "SG", "sloang": "SG", "sloan_g": "SG", "sr": "SR", "sloanr": "SR", "sloan_r": "SR", "si": "SI", "sloani": "SI",
    "sloan_i": "SI", "sz": "SZ", "sloanz": "SZ", "sloan_z": "SZ", "tb": "TB", "tg": "TG", "tr": "TR", "cv": "CV", "clear": "CV",
    "unfiltered": "CV", "cr": "CR", "ha": "HA", "h_alpha": "HA", "hac": "HAC", "h_alpha_continuum": "HAC", "stu": "STU",
    "stv": "STV", "stb": "STB", "sty": "STY", "sthbw": "STHBW", "sthbn": "STHBN", "ma": "MA", "mb": "MB", "mi": "MI",
}


def filter_code(filter_name: Column) -> Column:
    lookup = literal_map(FILTER_CODES)
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(filter_name)), " ", ""), "-", "_")
    return F.coalesce(F.try_element_at(lookup, text), F.lit("O"))


def with_resolved_calibration(science: DataFrame, references: DataFrame) -> DataFrame:
    """Zero point and calibrated magnitude of each row; a missing zero point falls back to its comparisons' median."""
    lacking = science.where(F.col("zero_point_magnitude").isNull() & (F.size("comparison_source_ids") > 0))
    pairs = lacking.select(*ROW, F.explode("comparison_source_ids").alias("__id")).join(
        references.select(*FRAME, F.col("source_id").alias("__id"), (F.col("catalog_magnitude") - F.col("instrumental_magnitude")).alias("__z")),
        [*FRAME, "__id"],
    )
    # a comparison list is short, so its median is too
    spare = pairs.where(n.finite("__z")).groupBy(*ROW).agg(F.median("__z").alias("__sz"), F.count(F.lit(1)).alias("__sn"))
    out = attach(science, spare, ROW)
    zp = F.coalesce("zero_point_magnitude", "__sz")
    cal = F.coalesce(F.col("calibrated_magnitude"), F.col("instrumental_magnitude") + zp)
    return out.withColumns(
        {
            "resolved_zero_point": zp,
            "resolved_source_count": F.when(F.col("zero_point_magnitude").isNotNull(), F.col("zero_point_source_count")).otherwise(F.coalesce("__sn", F.lit(0))),
            "resolved_magnitude": cal,
            "resolved_error": F.coalesce(F.col("calibrated_magnitude_error"), F.when(cal.isNotNull(), F.col("differential_magnitude_error"))),
        }
    ).drop("__sz", "__sn")


def with_check_star(science: DataFrame, checks: DataFrame) -> DataFrame:
    """First check star by name of the same frame and filter that is not the row's own source."""
    w = Window.partitionBy(*FRAME).orderBy("source_name", "source_id")
    two = checks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2)
    fields = ["source_id", "source_name", "instrumental_magnitude", "catalog_magnitude", "calibrated_magnitude"]
    per = two.groupBy(*FRAME).agg(
        F.max(F.when(F.col("__r") == 1, F.struct(*fields))).alias("__c1"), F.max(F.when(F.col("__r") == 2, F.struct(*fields))).alias("__c2")
    )
    out = attach(science, per, FRAME)
    pick = F.when(F.col("__c1.source_id") != F.col("source_id"), F.col("__c1")).otherwise(F.col("__c2"))
    variable = F.col("is_variable") & ~F.col("is_reference")
    out = out.withColumn("check", F.when(variable, pick)).drop("__c1", "__c2")
    check_cal = F.coalesce(F.col("check.calibrated_magnitude"), F.col("check.instrumental_magnitude") + F.col("resolved_zero_point"))
    return out.withColumn("check_residual_magnitude", check_cal - F.col("check.catalog_magnitude"))


def check_rms(rows: DataFrame) -> DataFrame:
    """Root mean square check-star residual of each series."""
    r = F.col("check_residual_magnitude")
    return rows.where(n.finite(r)).groupBy(*SERIES).agg(F.sqrt(F.avg(r * r)).alias("check_residual_rms"), F.count(F.lit(1)).alias("check_count"))


def science_rows(rows: DataFrame, transformed: bool = False) -> DataFrame:
    """Report value, calibration state and acceptance of every science row with its check residual and series rms."""
    cal, dif, ins, flux = (F.col(c) for c in ("resolved_magnitude", "differential_magnitude", "instrumental_magnitude", "flux"))

    def ladder(a, b, c, d, e):
        return F.when(cal.isNotNull(), a).when(dif.isNotNull(), b).when(ins.isNotNull(), c).when(flux.isNotNull(), d).otherwise(e)

    nothing = F.lit(None).cast("double")
    state = "transformed_candidate_std" if transformed else "zero_point_calibrated_untransformed"
    size = F.size("comparison_source_ids")
    out = attach(rows, check_rms(rows).drop("check_count"), SERIES)
    return out.select(
        *ROW, "object_name",
        F.when(F.col("is_check"), "check").when(F.col("is_variable"), "variable").otherwise("target").alias("role"),
        n.julian_date("observation_time").alias("julian_date"),
        ladder(F.lit("calibrated_magnitude"), F.lit("differential_magnitude"), F.lit("instrumental_magnitude"), F.lit("flux"), F.lit("none")).alias("measurement_kind"),
        ladder(cal, dif, ins, flux, nothing).alias("reported_value"),
        ladder(F.col("resolved_error"), F.col("differential_magnitude_error"), F.col("flux_error"), F.col("flux_error"), nothing).alias("reported_uncertainty"),
        ladder(F.lit(state), F.lit("differential_only"), F.lit("instrumental_only"), F.lit("flux_only"), F.lit("unreportable")).alias("calibration_state"),
        ladder(F.lit("STD"), F.lit("DIF"), F.lit("na"), F.lit("na"), F.lit("na")).alias("type_candidate"),
        F.when(size == 0, "none").when(size == 1, "single").otherwise("ensemble").alias("comparison_method"),
        F.col("check.source_id").alias("check_source_id"), "check_residual_magnitude",
        F.when(F.col("is_variable") & F.col("check").isNotNull(), F.col("check_residual_rms")).alias("check_residual_rms"),
        (~F.col("excluded_from_analysis") & ~F.col("is_saturated") & ladder(cal, dif, ins, flux, nothing).isNotNull()).alias("accepted"),
    )


def _text(value: Column, limit: int | None = None) -> Column:
    t = F.trim(F.translate(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]", " "), ",|", ";/"))
    t = F.substring(t, 1, limit) if limit else t
    return F.when(t != "", t).otherwise("na")


def _number(value: Column, places: int) -> Column:
    t = F.regexp_replace(F.format_string(f"%.{places}f", value), r"0+$", "")
    return F.when(value.isNull(), "na").otherwise(F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t))


def submission_rows(rows: DataFrame, chart_id: str = "", transformed: bool = False) -> DataFrame:
    """One line of fifteen fields per reportable variable-star row, or the reason it is skipped."""
    cand = rows.where(F.col("is_variable") & ~F.col("is_reference"))
    standard = F.col("resolved_magnitude").isNotNull()
    mag = F.coalesce("resolved_magnitude", "differential_magnitude")
    err = F.when(standard, F.col("resolved_error")).otherwise(F.col("differential_magnitude_error"))
    skip = (
        F.when(F.col("excluded_from_analysis") | F.col("is_saturated"), "measurement_excluded_or_saturated")
        .when(F.col("observation_time").isNull(), "observation_time_missing")
        .when(mag.isNull(), "submit_ready_magnitude_missing")
    )
    mtype = F.when(standard, "STD").otherwise("DIF")
    code = filter_code(F.col("filter_name"))
    size = F.size("comparison_source_ids")
    flags = F.concat_ws("; ", "flags")
    airmass = F.col("airmass") if "airmass" in rows.columns else F.lit(None).cast("double")
    notes = F.concat_ws(
        " ",
        F.when(flags != "", F.concat(F.lit("Flags: "), _text(flags))),
        F.when(code == "O", F.concat(F.lit("Original filter: "), _text(F.col("filter_name")))),
        F.when(F.col("resolved_source_count") > 0, F.concat(F.lit("Zero-point sources: "), F.col("resolved_source_count").cast("string"))),
        F.when(airmass.isNull(), "Airmass unavailable"),
    )
    check = F.col("check.instrumental_magnitude")
    subfields = F.concat_ws(
        "",
        F.when(F.col("instrumental_magnitude").isNotNull(), F.concat(F.lit("|VMAGINS="), _number(F.col("instrumental_magnitude"), 3))),
        F.when(check.isNotNull(), F.concat(F.lit("|KMAGINS="), _number(check, 3))),
        F.when(F.col("check.catalog_magnitude").isNotNull(), F.concat(F.lit("|KREFMAG="), _number(F.col("check.catalog_magnitude"), 3))),
    )
    fields = [
        _text(F.col("source_name"), 30), F.format_string("%.5f", n.julian_date("observation_time")), _number(mag, 4), _number(err, 3), code,
        F.when(standard & F.lit(transformed), "YES").otherwise("NO"), mtype,
        F.when(size > 1, "ENSEMBLE").when(size == 1, _text(F.element_at("comparison_source_ids", 1), 20)).otherwise("na"), F.lit("na"),
        F.when(F.col("check").isNotNull(), _text(F.col("check.source_name"), 20)).otherwise("na"), _number(check, 3), _number(airmass, 3), F.lit("na"),
        _text(F.lit(chart_id), 20), F.when(F.concat(notes, subfields) != "", F.concat(notes, subfields)).otherwise("na"),
    ]
    return cand.select(
        *ROW, skip.alias("skip_reason"), F.when(skip.isNull(), mtype).alias("mtype"), F.when(skip.isNull(), code).alias("filter_code"),
        F.when(skip.isNull(), F.concat_ws(",", *fields)).alias("export_line"),
    )


def submission_preflight(lines: DataFrame) -> DataFrame:
    """Counts of the submission by type, filter code and skip reason."""
    return lines.groupBy(F.coalesce("skip_reason", F.lit("exported")).alias("outcome"), F.coalesce("mtype", F.lit("-")).alias("mtype"), F.coalesce("filter_code", F.lit("-")).alias("filter_code")).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("source_id").alias("source_count")
    )


def submission_warnings(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Warnings of a submission, one row per object and kind: unfiltered or unknown filters, lines without a check star,
    without airmass, by differential magnitude only, and objects of which nothing is submitted."""
    told = lines.join(rows.select(*ROW, "object_name", F.col("check").isNull().alias("__unchecked")), ROW)
    sent, skipped = F.col("skip_reason").isNull(), F.col("skip_reason").isNotNull()
    kinds = {
        "unmatched_filter_code": sent & (F.col("filter_code") == "O"), "check_star_missing": sent & F.col("__unchecked"), "airmass_missing": sent & F.col("export_line").contains("Airmass unavailable"),
        "differential_only": sent & (F.col("mtype") == "DIF"), "rows_skipped": skipped,
    }
    per = told.groupBy("object_name").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()], F.count_if(sent).alias("__sent"))
    per = per.withColumn("nothing_to_submit", F.when(F.col("__sent") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return per.select("object_name", F.stack(F.lit(6), *[x for k in (*kinds, "nothing_to_submit") for x in (F.lit(k), F.col(k))]).alias("warning", "row_count")).where(F.col("row_count") > 0)


def _counted(rows: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Counts of a column's values as one text per key: ``value=count`` joined by ``;`` in the order of the values."""
    per = rows.groupBy(key, F.coalesce(column, F.lit("")).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return per.groupBy(key).agg(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("__v", "__c"))), lambda s: F.concat_ws("=", s["__v"], s["__c"].cast("string")))).alias(name))


def provenance_manifest(science: DataFrame, measurements: DataFrame, references: DataFrame) -> DataFrame:
    """One row per object with what a report says about its making: files, filters, time range, accepted and rejected rows,
    calibration states, comparison methods, reference stars and median aperture radii (null without such columns)."""
    key = ["object_name"]
    base = measurements.groupBy(*key).agg(
        F.count_distinct("file_path").alias("file_count"), F.min("observation_time").alias("observation_start"), F.max("observation_time").alias("observation_end"),
        F.concat_ws(";", F.array_sort(F.collect_set("filter_name"))).alias("filters"), F.count_distinct(F.when(F.col("is_variable"), F.col("source_id"))).alias("variable_star_count"),
    )
    rows = science.groupBy(*key).agg(F.count_if("accepted").alias("accepted_count"), F.count_if(~F.col("accepted")).alias("rejected_count"))
    out = attach(attach(base, rows, key), references.groupBy(*key).agg(F.count_distinct("source_id").alias("reference_star_count")), key)
    for column, name in (("calibration_state", "calibration_states"), ("comparison_method", "comparison_methods"), ("filter_name", "filter_counts")):
        out = attach(out, _counted(science, "object_name", column, name), key)
    for column in ("aperture_radius", "annulus_inner_radius", "annulus_outer_radius"):
        if column in measurements.columns:
            out = attach(out, group_quantiles(measurements, key, F.col(column), {f"median_{column}": 0.5}), key)
    return out


def reference_manifest(science: DataFrame, references: DataFrame) -> DataFrame:
    """Use and health of every reference star."""
    used = science.select(F.explode("comparison_source_ids").alias("source_id"), (~F.col("excluded_from_analysis") & ~F.col("is_saturated")).alias("ok"))
    usage = used.groupBy("source_id").agg(F.count(F.lit(1)).alias("usage_count"), F.count_if("ok").alias("accepted_usage_count"))
    base = references.groupBy("source_id").agg(
        F.min("source_name").alias("source_name"), F.min("catalog_magnitude").alias("catalog_magnitude"),
        F.concat_ws("; ", F.array_sort(F.collect_set("filter_name"))).alias("filter_names"),
        F.count_distinct("file_path").alias("file_count"), F.bool_or("is_saturated").alias("ever_saturated"),
        F.bool_or(F.coalesce(near_saturated(), F.lit(False))).alias("ever_near_saturated"),
        F.max(n.ratio("peak_pixel_value", "saturation_threshold")).alias("max_saturation_fraction"),
    )
    med = group_quantiles(references, ["source_id"], F.col("flux"), {"median_flux": 0.5})
    snr = group_quantiles(references, ["source_id"], F.col("snr"), {"median_snr": 0.5})
    out = attach(attach(attach(base, usage, ["source_id"]), med, ["source_id"]), snr, ["source_id"])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("usage_count", "accepted_usage_count")})


def report_summary(science: DataFrame, accepted: Column) -> DataFrame:
    """Counts of one object's report as JSON."""
    per = science.groupBy("object_name").agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count_if(accepted).alias("accepted_count"), F.count_if(~accepted).alias("rejected_count"),
        F.count_distinct("source_id").alias("source_count"), F.count_distinct("file_path").alias("file_count"),
        F.count_distinct("source_id", "filter_name").alias("light_curve_count"),
    )
    return per.select("object_name", F.to_json(F.struct(*[c for c in per.columns if c != "object_name"])).alias("summary_json"))
