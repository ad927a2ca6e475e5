"""Registered archive, inventory and text-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import names as nm
from skyloom.functions.numeric import rounded
from skyloom.operators import archive as ar
from skyloom.plans import standins as si


def _inventory(spark, d):
    return ar.frame_inventory(si.orders_with_path(spark, d))


def _deck(spark, d):
    return _inventory(spark, d).withColumnRenamed("object_name", "target_name").where(F.col("file_status") == "accepted")


def frame_inventory(spark, d):
    return rounded(ar.object_summary(_inventory(spark, d)), 3)


def deck_scan(spark, d):
    files = si.orders_with_path(spark, d)
    out = ar.deck_scan(files.union(files.where(F.col("file_no") % 5 == 0)), files.select("root_path"))
    return out.groupBy("root_path").agg(F.count(F.lit(1)).alias("file_count"), F.count_distinct("path").alias("path_count"))


def deck_merge(spark, d):
    deck = si.orders_with_path(spark, d).select(
        "path", "root_path", "file_no", ar.target_name(F.col("path"), F.col("root_path")).alias("target_name"), F.lit(1).alias("version")
    )
    # the scan brings every file again, the odd ones under a new path
    path = F.when(F.col("file_no") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".v2")))
    merged = ar.deck_merge(deck, deck.withColumns({"path": path, "version": F.lit(2)}))
    return merged.groupBy("root_path", "target_name", "version").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("file_no").alias("file_no_sum")
    )


def frame_groups(spark, d):
    frames = _inventory(spark, d).withColumn("observation_time", F.unix_date("observation_date"))
    return ar.frame_groups(frames)


def frame_group_members(spark, d):
    frames = _inventory(spark, d).withColumn("observation_time", F.unix_date("observation_date"))
    return ar.frame_group_members(frames).select("filter_name", "exposure_seconds", F.col("position").cast("long").alias("position"), F.col("path"))


def deck_instruments(spark, d):
    return ar.deck_instruments(_deck(spark, d))


def frame_batches(spark, d):
    files = si.orders_with_path(spark, d)
    rows = files.select("path", "observation_time", F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("target_name"))
    out = ar.frame_batches(rows, ["target_name"], 24, 4)
    return out.groupBy("target_name", "batch_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.count_if("is_reference").alias("reference_count"),
        F.min(F.when(~F.col("is_reference"), F.col("observation_time"))).alias("first_time"), F.max("observation_time").alias("last_time"),
    )


def incremental_reuse(spark, d):
    f = si.orders_with_path(spark, d)
    n = F.col("file_no")

    def inputs(size, settings):
        return f.select(
            n.alias("frame_id"), F.col("path").alias("source_path"), F.col("observation_time").cast("long").alias("source_mtime"),
            size.alias("source_size"), F.concat(F.col("path"), F.lit(".wcs")).alias("wcs_path"), (n * 7).alias("wcs_mtime"),
            F.array((n % 9).cast("string"), (n % 4).cast("string")).alias("variable_ids"), F.array(F.lit("r1")).alias("reference_ids"),
            settings.alias("settings"),
        )

    size = F.floor("o_totalprice")
    stored = inputs(F.when(n % 3 == 1, size + 1).otherwise(size), F.when(n % 7 == 0, "ap5").otherwise("ap4"))
    stored = stored.withColumn("frame_id", F.when(F.col("frame_id") % 5 == 0, -F.col("frame_id") - 1).otherwise(F.col("frame_id")))  # results of other frames
    stored = stored.withColumn("reuse_key", ar.reuse_key())
    out = ar.incremental_reuse(inputs(size, F.lit("ap4")), stored)
    return out.withColumn("changed_inputs", F.concat_ws(";", "changed_inputs"))


def designation_filter(spark, d):
    p = si.table(spark, d, "part")
    k = F.col("p_partkey")
    prefix = F.element_at(
        F.array(*[F.lit(x) for x in ("Gaia  DR3_", "ASASSN-V ", "ATO ", "atlas", "ZTF J", "[KK98] ", "TIC ", "V* ", " NSVS ", "pan-starrs ")]),
        (k % 10 + 1).cast("int"),
    )
    named = p.select(k.alias("source_no"), F.concat(prefix, F.col("p_name")).alias("name"))
    return named.withColumn("family", nm.designation_family(F.col("name"))).where(F.col("family").isin("gaia", "asassn", "other", "named"))


def band_normalize(spark, d):
    k = F.col("o_orderkey")
    raw = F.element_at(
        F.array(*[F.lit(x) for x in ("Johnson V", "sloan-g", "R_C", "g'", "Lum", "H-alpha", "Cousins  I", "Z Prime", "clear", "sdss")]),
        (k % 10 + 1).cast("int"),
    )
    rows = si.table(spark, d, "orders").select(raw.alias("filter_name"), "o_totalprice")
    return rows.withColumn("band", nm.photometric_band(F.col("filter_name"))).groupBy("filter_name", "band").agg(
        F.count(F.lit(1)).alias("frame_count")
    )


def filter_alias(spark, d):
    f = si.orders_with_path(spark, d)
    got = nm.deck_filter(F.try_element_at("header", F.lit("FILTER")), F.col("path"), F.col("root_path"))
    return f.groupBy(got.alias("filter_name"), F.try_element_at("header", F.lit("FILTER")).alias("header_filter")).agg(
        F.count(F.lit(1)).alias("frame_count")
    )


def filename_parse(spark, d):
    f = si.orders_with_path(spark, d)
    names = ["frame_type", "object_name", "exposure_text", "binning", "filter_name", "date_text", "time_text", "sequence"]
    parsed = f.select("file_no", nm.filename_fields(F.col("path")).alias("fields"))
    return parsed.select("file_no", *[nm.field_of(F.col("fields"), i + 1).alias(n) for i, n in enumerate(names)])


def timestamp_parse(spark, d):
    k = F.col("event_id")
    ev = si.table(spark, d, "events").select(
        k,
        F.concat(
            F.date_format("ts", "yyyy-MM-dd"),
            F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("T"), F.date_format("ts", "HH:mm:ss")))
            .when(k % 6 == 2, F.concat(F.lit(" "), F.date_format("ts", "HH:mm:ss"), F.lit(".12345678")))
            .when(k % 6 == 3, F.concat(F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z")))
            .when(k % 6 == 4, F.concat(F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+02:00")))
            .otherwise(F.lit(" at night")),
        ).alias("date_obs"),
    )
    at = nm.observation_timestamp(F.col("date_obs"))
    return ev.select(
        "event_id", F.unix_micros(at).alias("observed_micros"), nm.has_explicit_zone(F.col("date_obs")).alias("has_zone")
    )


def image_kind(spark, d):
    return _inventory(spark, d).groupBy("kind", "object_name").agg(F.count(F.lit(1)).alias("frame_count"))


def deck_stats(spark, d):
    return rounded(ar.deck_stats(_deck(spark, d)), 3)


def _lights(spark, d):
    return ar.counting_totals(_deck(spark, d))


def observation_map(spark, d):
    out = ar.observation_map(_lights(spark, d))
    return rounded(out.withColumn("observation_date", F.col("observation_date").cast("string")).withColumn("level", F.col("level").cast("long")), 3)


def observation_orbit(spark, d):
    days = ar.observation_days(_lights(spark, d))
    return rounded(ar.orbit_rollup(ar.observation_orbit(days, weekly_after_years=3.0)), 6, exposure_seconds=3)


def longest_night(spark, d):
    out = ar.longest_night(ar.observation_days(_lights(spark, d)))
    return rounded(out.withColumn("longest_night_date", F.col("longest_night_date").cast("string")), 3)


def library_without_root(spark, d):
    kept = ar.remove_root(_inventory(spark, d), "/data/mirror")
    return kept.select("path", "root_path", "kind")


def timing_summary(spark, d):
    return rounded(ar.timing_summary(si.table(spark, d, "events"), ["event_type", "user_id"], "value"), 6)


QUERIES = {
    f.__name__: f
    for f in (
        frame_inventory, deck_scan, deck_merge, frame_groups, frame_group_members, deck_instruments, frame_batches, incremental_reuse, designation_filter, band_normalize,
        filter_alias, filename_parse, timestamp_parse, image_kind, deck_stats, observation_map, observation_orbit, timing_summary,
        longest_night, library_without_root,
    )
}
