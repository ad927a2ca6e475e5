"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.numeric import rounded
from skyloom.operators import catalogs as ct
from skyloom.operators.photometry import near_saturated
from skyloom.plans import standins as si


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def reference_stars(spark, d):
    out = ct.reference_stars(si.catalog(spark, d), si.variables(spark, d))
    return rounded(out.select("field", "source_id", F.col("rank").cast("long").alias("rank"), "magnitude"))


def crossmatch_bands(spark, d):
    c, v = si.catalog(spark, d), si.variables(spark, d)
    own = c.select("source_id", "ra_deg", "dec_deg", F.lit("gaia-g").alias("catalog"), F.lit("G").alias("band"), F.col("magnitude").alias("mag"), F.lit(None).cast("double").alias("error"))
    vband = own.withColumn("band", F.lit("V")).withColumn("catalog", F.lit("apass")).where(F.substring("source_id", -1, 1).isin("1", "3", "5"))
    give = lambda band, shift: v.select("source_id", "ra_deg", "dec_deg", "catalog", F.lit(band).alias("band"), (F.col("magnitude") + shift).alias("mag"), F.col("magnitude_error").alias("error"))
    out = ct.crossmatch_bands(own.unionByName(vband), give("V", 0.1).unionByName(give("B", 0.6)))
    return rounded(out, 4)


def nearest_catalog(spark, d):
    rows = si.variables(spark, d).select(F.col("source_id").alias("detection_id"), (F.col("ra_deg") + 0.3).alias("ra_deg"), "dec_deg")
    return rounded(ct.nearest_catalog(rows, si.catalog(spark, d), "detection_id").withColumnRenamed("m_name", "nearest_name"), 3)


def hr_match(spark, d):
    v = si.variables(spark, d)
    twin = v.select(F.concat("source_id", F.lit("b")).alias("detection_id"), "ra_deg", (F.col("dec_deg") + 0.0001).alias("dec_deg"))
    det = v.select(F.col("source_id").alias("detection_id"), "ra_deg", "dec_deg").unionByName(twin)
    return rounded(ct.one_detection_per_star(det, si.catalog(spark, d), ct.match_tolerance_px(1.0, 12.0) / 6.0 * 10.5), 4)


def unique_match(spark, d):
    m = si.raw_measurements(spark, d)
    a = m.where("is_variable").select("frame_no", "filter_name", F.col("source_no").alias("a_id"), (F.col("ra_deg") * 1000).alias("x"), (F.col("dec_deg") * 1000).alias("y"))
    b = m.where("is_reference").select("frame_no", "filter_name", F.col("source_no").alias("b_id"), (F.col("ra_deg") * 1000).alias("x"), (F.col("dec_deg") * 1000).alias("y"))
    return rounded(ct.unique_nearest(a, b, ["frame_no", "filter_name"], 150.0), 3)


def isolated_sources(spark, d):
    v = si.variables(spark, d).select("source_id", "ra_deg", "dec_deg")
    return ct.isolated_sources(si.catalog(spark, d).select("source_id", "ra_deg", "dec_deg").unionByName(v), 5.0).select("source_id")


def cone_search(spark, d):
    q = si.variables(spark, d).select(F.col("source_id").alias("query_id"), "ra_deg", "dec_deg")
    named = si.catalog(spark, d).withColumn("name", F.concat(F.lit("Obj "), F.col("object_type"), (F.col("source_no") % 3).cast("string")))
    return rounded(ct.cone_search(q, named, 8 * 3600.0), 3, magnitude=6)


def nearest_snapshot(spark, d):
    o = si.table(spark, d, "orders")
    k = F.col("o_orderkey")
    at = F.unix_date(F.col("o_orderdate").cast("date")).cast("double") * 86400.0
    snaps = o.where(k % 2 == 0).select((F.col("o_custkey") % 10).alias("site"), k.alias("snapshot_id"), (at + (k % 24) * 3600.0).alias("snapshot_at"), (F.lit(8.0) + k % 7).alias("magnitude_limit"), (k % 100).alias("row_count"))
    asks = o.where(k % 2 == 1).select((F.col("o_custkey") % 10).alias("site"), k.alias("query_id"), (at + 43200.0).alias("at"), (F.lit(8.0) + k % 5).alias("wanted_limit"), (k % 60).alias("wanted_rows"))
    return ct.nearest_snapshot(asks, snaps)


def catalog_union(spark, d):
    c = si.catalog(spark, d).select("source_id", "field", "magnitude", "source_no")
    tiles = c.withColumn("tile", F.col("source_no") % 4).unionByName(
        c.where(F.col("source_no") % 3 == 0).withColumn("tile", (F.col("source_no") + 2) % 4).withColumn("magnitude", F.col("magnitude") + 1.0)
    )
    one = ct.first_per_key(tiles, ["source_id"], ["tile", "magnitude"])
    best = ct.choose_field(one.select(F.concat(F.lit("g"), (F.col("source_no") % 4).cast("string")).alias("group_id"), "field", (F.col("source_no") % 15 == 0).alias("is_variable")))
    chosen = one.withColumn("group_id", F.concat(F.lit("g"), (F.col("source_no") % 4).cast("string"))).join(best, ["group_id", "field"])
    return rounded(chosen.select("group_id", "field", "score", "source_id", "tile", "magnitude"))


def magnitude_filter(spark, d):
    c = si.catalog(spark, d).withColumn("layer", _pick(["deep_sky", "gaia_stars", "variable_stars"], F.col("source_no")))
    c = c.withColumn("magnitude", F.when(F.col("source_no") % 5 != 0, F.col("magnitude")))
    return ct.magnitude_filter(c, 13.0, exclude_unknown=False).groupBy("layer").agg(
        F.count(F.lit(1)).alias("kept_count"), F.count("magnitude").alias("known_count"), F.sum("source_no").alias("source_no_sum")
    )


TYPE_TEXTS = ("Galaxy", "GlC", "PN", "Sy1", "HII Region", "cluster of galaxies", "V*", "weird", "  dark   nebula", "Pair of Galaxies", "x", "")


def object_type(spark, d):
    p = si.table(spark, d, "part")
    k = F.col("p_partkey")
    layer = _pick(["deep_sky", "general_objects", "deep_sky", "exoplanets", "deep_sky"], k)
    return p.select(k.alias("source_no"), ct.object_type_key(_pick(TYPE_TEXTS, k), layer).alias("type_key"))


def designation_keys(spark, d):
    k = F.col("p_partkey")
    s = k.cast("string")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("ngc 0"), s, F.lit(" A|Barnard "), s))
        .when(k % 7 == 1, F.concat(F.lit("Messier|M "), s)).when(k % 7 == 2, F.concat(F.lit("[KK98] NGC "), s))
        .when(k % 7 == 3, F.concat(F.lit("IC"), s, F.lit("|LDN 00"), s)).when(k % 7 == 4, F.concat(F.lit("Sh2-"), s))
        .when(k % 7 == 5, F.concat(F.lit("vdB "), s, F.lit(" HASH "), s)).otherwise(F.col("p_name"))
    )
    return si.table(spark, d, "part").select(k.alias("source_no"), F.concat_ws(";", ct.designation_keys(text)).alias("keys"))


def preferred_identifier(spark, d):
    k = F.col("c_custkey")
    s = k.cast("string")
    main = F.when(k % 5 == 0, F.concat(F.lit("Gaia DR3 "), s)).when(k % 5 == 1, F.concat(F.lit("NAME Star  "), s)).when(k % 5 == 2, F.lit("--"))
    ids = F.concat_ws("|", F.when(k % 3 == 0, F.concat(F.lit("HD "), s)), F.when(k % 4 == 0, F.concat(F.lit(" hip "), s)), F.when(k % 2 == 0, F.concat(F.lit("TIC "), s)), F.concat(F.lit("ABC "), s))
    return si.table(spark, d, "customer").select(k.alias("source_no"), ct.preferred_identifier(main, ids).alias("preferred"))


def variable_candidates(spark, d):
    c, v = si.catalog(spark, d), si.variables(spark, d)
    known = v.select(F.concat(F.lit("G"), F.lpad((F.col("source_no") * 15).cast("string"), 9, "0")).alias("source_id"))
    out = ct.variable_candidates(c, known, ct.reference_stars(c, v), 9.0, 17.0, 60)
    return rounded(out.select("field", "source_id", "magnitude"))


def brightest(spark, d):
    c = si.catalog(spark, d).withColumn("magnitude", F.when(F.col("source_no") % 9 != 0, F.col("magnitude")))
    return rounded(ct.brightest(c, ["object_type"], percent=12.5).select("object_type", "source_id", "magnitude", "rank"))


def comparison_candidates(spark, d):
    c = si.catalog(spark, d)
    k = F.col("source_no")
    t = si.variables(spark, d).withColumn("dec_deg", F.col("dec_deg") + 0.02).withColumn("target_id", F.col("source_id")).withColumn("bp_rp", F.when(k % 2 == 0, F.lit(0.2) + k % 25 / F.lit(10.0)))
    return rounded(ct.comparison_candidates(t, c, 2.0, 0.6, 600.0, 10), 6)


def _favourites(spark, d):
    w = ct.reference_stars(si.catalog(spark, d), si.variables(spark, d), limit=7)
    return w.select("field", "source_id", F.col("rank").alias("position"))


def comparison_sets(spark, d):
    out = ct.comparison_sets(_favourites(spark, d), "field", 3)
    return out.select("field", "set_id")


def catalog_search(spark, d):
    p = si.table(spark, d, "part").select(
        F.col("p_partkey").alias("source_no"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"),
        F.col("p_size").cast("double").alias("magnitude"), F.when(F.col("p_partkey") % 2 == 0, "Star").otherwise("Galaxy").alias("object_type"),
    )
    out = ct.catalog_search(p, "Red", limit=80, star_limit=25.0)
    return out.select("source_no", "name", "magnitude", F.col("match_rank").cast("long").alias("match_rank"))


def distance_map(spark, d):
    m = ct.distance_map(si.catalog(spark, d))
    return rounded(m.where(F.col("rejected").isNull()).select("source_id", "magnitude", "distance_pc", "parallax_snr", "near_pc", "far_pc", "x_pc", "y_pc", "z_pc"), 4)


def distance_rejections(spark, d):
    c = si.catalog(spark, d)
    k = F.col("source_no")
    c = c.withColumns({"parallax_mas": F.when(k % 11 != 0, F.when(k % 13 == 0, -F.col("parallax_mas")).otherwise(F.col("parallax_mas"))), "parallax_error_mas": F.when(k % 17 != 0, F.col("parallax_error_mas"))})
    return ct.distance_map(c).groupBy("field", F.coalesce("rejected", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("star_count"))


def cluster_distance(spark, d):
    return rounded(ct.cluster_distance(si.catalog(spark, d), "object_type"), 4)


def catalog_dedupe(spark, d):
    c, v = si.catalog(spark, d), si.variables(spark, d)
    prim = c.select("source_id", "ra_deg", "dec_deg", "name", F.array(F.concat(F.lit("al"), (F.col("source_no") % 700).cast("string"))).alias("aliases"), (F.col("source_no") % 3 == 0).alias("is_named"))
    sec = v.select("source_id", "ra_deg", "dec_deg", "name", F.array(F.concat(F.lit("AL"), (F.col("source_no") * 11).cast("string"))).alias("aliases"), F.lit(False).alias("is_named"))
    stars = ct.merge_star_catalogs(prim, sec).groupBy("origin").agg(F.count(F.lit(1)).alias("row_count"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id"))
    deep = ct.merge_deep_sky(prim, sec).groupBy(F.lit("deep_sky").alias("origin")).agg(F.count(F.lit(1)).alias("row_count"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id"))
    return stars.unionByName(deep)


def entity_resolution(spark, d):
    p = si.table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("NGC "), (k % 400).cast("string"))).when(k % 3 == 1, F.concat(F.lit("M "), (k % 300).cast("string"))).otherwise(F.concat(F.lit("Obj"), k.cast("string")))
    rows = p.select(
        k.alias("seen_order"), name.alias("name"), F.concat(F.lit("S"), k.cast("string")).alias("source_id"), F.lit("deep_sky").alias("layer"),
        F.lit("cat").alias("catalog"), F.lit("G").alias("object_type"), (F.col("p_retailprice") / 5.0 % 360.0).alias("ra_deg"), ((k % 50) * 1.5).cast("double").alias("dec_deg"),
        F.when(k % 4 != 0, F.col("p_size").cast("double")).alias("magnitude"), (k % 17).cast("double").alias("size_arcmin"),
    )
    return rounded(ct.entity_resolution(rows).select("seen_order", "name", "magnitude", "size_arcmin", "merged_count"))


def layer_summary(spark, d):
    c = si.catalog(spark, d)
    o = c.select("source_id", "field", F.col("object_type").alias("layer"), "magnitude", (F.col("source_no") % 4 != 0).alias("in_frame"), (F.col("source_no") % 31).cast("double").alias("center_distance_arcmin"))
    return rounded(ct.layer_summary(o, 12))


def prediction_merge(spark, d):
    c, s = si.table(spark, d, "customer"), si.table(spark, d, "supplier")
    k = F.col("c_custkey")
    old = c.select(F.concat(F.lit("obj"), (k % 1200).cast("string")).alias("identity"), k.alias("prediction_id"), F.col("c_acctbal").alias("magnitude"), (k % 50).cast("double").alias("ra_rate"), F.lit(1.0).alias("uncertainty"))
    q = F.col("s_suppkey")
    new = s.select(F.concat(F.lit("obj"), (q * 20).cast("string")).alias("identity"), q.alias("prediction_id"), F.when(q % 2 == 0, F.col("s_acctbal")).alias("magnitude"), F.when(q % 3 == 0, q.cast("double")).alias("ra_rate"), F.lit(None).cast("double").alias("uncertainty"))
    return rounded(ct.prediction_merge(old, new, "identity", ["magnitude", "ra_rate", "uncertainty"]))


def prediction_identity(spark, d):
    """Predictions matched by name or designation, in other spellings and through third rows."""
    c, s = si.table(spark, d, "customer"), si.table(spark, d, "supplier")
    k, q = F.col("c_custkey"), F.col("s_suppkey")
    old = c.select(
        k.alias("prediction_id"), F.when(k % 3 != 0, F.concat(F.lit("Obj "), (k % 900).cast("string"))).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("2020 AB"), (k % 1300).cast("string"))).alias("designation"),
        F.col("c_acctbal").cast("double").alias("magnitude"), (k % 50).cast("double").alias("ra_rate"),
    )
    new = s.select(
        q.alias("prediction_id"), F.when(q % 2 == 0, F.concat(F.lit("OBJ-"), (q * 7).cast("string"))).alias("name"), F.when(q % 3 != 0, F.concat(F.lit("2020ab"), (q * 6).cast("string"))).alias("designation"),
        F.when(q % 4 != 0, F.col("s_acctbal").cast("double")).alias("magnitude"), F.lit(None).cast("double").alias("ra_rate"),
    )
    return rounded(ct.merge_predictions(old, new, ["name", "designation", "magnitude", "ra_rate"]))


def cluster_match(spark, d):
    c, v = si.catalog(spark, d), si.variables(spark, d)
    fields = c.where(F.col("source_no") < 10).select("field", "ra_deg", "dec_deg", (F.lit(5.0) + F.col("source_no")).alias("radius_deg"))
    entries = v.select(F.col("source_id").alias("entry_id"), "ra_deg", "dec_deg", (F.lit(4.0) + F.col("source_no") % 5).alias("visible_radius_deg"))
    return rounded(ct.cluster_match(c, entries, fields))


def cluster_members(spark, d):
    c, v = si.catalog(spark, d), si.variables(spark, d)
    fields = c.where(F.col("source_no") < 10).select("field", "ra_deg", "dec_deg", (F.lit(5.0) + F.col("source_no")).alias("radius_deg"))
    entries = v.select(F.col("source_id").alias("entry_id"), "ra_deg", "dec_deg", (F.lit(4.0) + F.col("source_no") % 5).alias("visible_radius_deg"))
    return rounded(ct.cluster_members(c, entries, ct.cluster_match(c, entries, fields)), 5)


def snapshot_entries(spark, d):
    line = si.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").cast("long").alias("rank"), F.col("l_partkey").alias("object_no"), F.col("l_extendedprice").cast("double").alias("brightness"))
    return rounded(ct.snapshot_entries(nearest_snapshot(spark, d), line))


def folder_references(spark, d):
    """Stars named by their folder first, then the reference stars of the fields."""
    refs = ct.reference_stars(si.catalog(spark, d), si.variables(spark, d)).select("source_id", "field", "magnitude")
    named = folder_match(spark, d).where("kept").join(si.catalog(spark, d).select("source_no", "source_id", "field", "magnitude"), "source_no")
    return rounded(ct.with_extras_first(named.select("source_id", "field", "magnitude"), refs))


def adu_screen(spark, d):
    m = si.raw_measurements(spark, d).withColumn("background_level", F.col("flux") * 0.2).withColumn("peak_pixel_value", F.col("peak_pixel_value") * 10.0).withColumn("saturation_threshold", F.lit(4500.0))
    return ct.adu_screen(m).groupBy("filter_name").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("source_id").alias("source_count"), F.max("peak_pixel_value").alias("top_peak"))


def mag_error(spark, d):
    m = si.raw_measurements(spark, d)
    return rounded(m.select("file_path", "filter_name", "source_id", n.mag_error("flux", "flux_error").alias("mag_error")))


def ccd_flux_error(spark, d):
    e = si.table(spark, d, "events")
    out = n.ccd_flux_error(
        F.col("value") * 100 - 500, F.col("value"), F.lit(1.0) + F.col("user_id") % 60, sky_pixels=(F.col("user_id") % 7) * 100.0, read_noise=5.0,
        dark_rate=0.02, exposure=60.0, gain=2.0, saturation_level=40000.0,
    )
    return rounded(e.select("event_id", out.alias("flux_error")), 5)


def error_budget(spark, d):
    m = si.raw_measurements(spark, d).where("is_reference")
    ens = m.groupBy("file_path", "filter_name").agg(
        F.count(F.lit(1)).alias("comparison_count"), F.avg("flux").alias("f"), (F.sqrt(F.sum(F.col("flux_error") * F.col("flux_error"))) / F.count(F.lit(1))).alias("e"),
    )
    scint = n.scintillation_error(28.0, 60.0, F.lit(1.0) + F.col("comparison_count") % 3 * 0.25, 500.0, F.col("comparison_count"))
    out = ens.select("file_path", "filter_name", "comparison_count", n.mag_error("f", "e").alias("ensemble_mag_error"), scint.alias("scintillation_error"))
    return rounded(out.withColumn("total_mag_error", n.total_mag_error("ensemble_mag_error", F.lit(0.01), "scintillation_error")), 7)


def phase_fold(spark, d):
    m = si.raw_measurements(spark, d).where(~F.col("is_reference"))
    anchors = m.groupBy("source_id", "filter_name").agg(
        F.max_by("observation_time", F.struct("instrumental_magnitude", -F.col("observation_time"))).alias("t0"), F.min("source_no").alias("u")
    )
    period = F.lit(0.3) + F.col("u") % 10 / 20.0
    out = m.join(anchors, ["source_id", "filter_name"]).select(
        "file_path", "filter_name", "source_id", n.phase(n.julian_date("observation_time"), n.julian_date("t0"), period).alias("phase")
    )
    return rounded(out, 4)


def hr_diagram(spark, d):
    """Absolute magnitude against colour, with an image zero point from the unsaturated rows."""
    from skyloom.functions.groups import group_quantiles

    c = si.catalog(spark, d).withColumn("instrumental", F.col("magnitude") - 25.0 + F.col("source_no") % 11 / 100.0).withColumn("ok", F.col("source_no") % 6 != 0)
    zp = group_quantiles(c.where("ok"), ["field"], F.col("magnitude") - F.col("instrumental"), {"zero_point": 0.5})
    rows = c.join(zp, "field", "left")
    out = rows.select("source_id", "field", "bp_rp", n.absolute_magnitude("magnitude", "parallax_mas").alias("absolute_magnitude"), (F.col("instrumental") + F.col("zero_point")).alias("calibrated_magnitude"))
    return rounded(out, 5)


def moonlight_score(spark, d):
    from skyloom.operators.planning import moonlight

    e = si.table(spark, d, "events")
    u = F.col("user_id")
    rows = e.select("event_id", (u % 180).cast("double").alias("phase_angle_deg"), (F.col("value") % 90 - 10).alias("moon_altitude_deg"), (u % 91).cast("double").alias("target_altitude_deg"), (F.col("value") % 170).alias("separation_deg"), (F.lit(360000.0) + u * 300).alias("distance_km"))
    out = moonlight(rows)
    return rounded(out.select("event_id", "moonlight_nl", "moonlight_score", "moonlight_category"), 4)


def reference_ranking(spark, d):
    from skyloom.operators.comparison import reference_ranking as rank

    m = si.raw_measurements(spark, d)
    return rounded(rank(m, tolerance=0.75, pool=8, near_saturated=near_saturated()), 6)


def fallback_ranking(spark, d):
    """References in order for every target, also for those without a known magnitude."""
    from skyloom.operators import comparison as cp

    u = F.col("source_no")
    m = si.raw_measurements(spark, d).withColumn("calibrated_magnitude", F.when(u % 3 == 0, F.col("instrumental_magnitude") + 22.0)).withColumn("catalog_magnitude", F.when(u % 5 != 1, F.col("catalog_magnitude")))
    stars = m.select("source_id", "source_no").distinct()
    known = stars.where(u % 8 != 4).select("source_id", F.when(u % 4 == 0, F.lit(8.0) + (u % 80) / F.lit(10.0)).when(u % 16 == 1, F.lit(9.0)).alias("magnitude"))
    refs = cp.usable_references(m, known, near_saturated())
    out = cp.ranked_references(cp.target_magnitudes(m, known), refs, 8)
    return rounded(out, 6)


def sampled_sets(spark, d):
    """Sets of four of twenty favourites: more than are tried, so a spread sample with the preferred and the nearest set."""
    from skyloom.operators import comparison as cp

    f = ct.reference_stars(si.catalog(spark, d), si.variables(spark, d), limit=20).select("field", "source_id", F.col("rank").alias("position"))
    return cp.sets_of(f, "field", 4, 200, f.where("position % 3 = 0")).select("field", "set_id")


def stamp_bands(spark, d):
    m = si.raw_measurements(spark, d)
    per = m.select("source_id", "source_no", "catalog_magnitude").distinct()
    v = per.where(F.col("source_no") % 7 != 0).select("source_id", F.lit("V").alias("band"), (F.col("catalog_magnitude") + 0.05).alias("mag"), F.lit(0.01).alias("error"), F.lit("apass").alias("band_source"))
    b = per.where(F.col("source_no") % 3 != 0).select("source_id", F.lit("B").alias("band"), (F.col("catalog_magnitude") + 0.6).alias("mag"), F.lit(0.02).alias("error"), F.lit("vsp").alias("band_source"))
    out = ct.stamp_bands(m, v.unionByName(b))
    at = lambda band, f: F.try_element_at("band_magnitudes", F.lit(band))[f]
    return rounded(out.select("file_path", "filter_name", "source_id", at("V", "mag").alias("v_mag"), at("B", "mag").alias("b_mag"), at("B", "band_source").alias("b_source")), 5)


def folder_match(spark, d):
    """Stars kept because the folder of their object names them."""
    k = F.col("c_custkey")
    text = F.lower(F.regexp_replace("c_name", "#0*", " "))
    folder = F.when(k % 5 == 0, text).when(k % 5 == 1, F.concat(text, F.lit(" V band"))).when(k % 5 == 2, F.lit("Customer")).when(k % 5 == 3, F.lit("other field")).otherwise(F.lit(""))
    c = si.table(spark, d, "customer").select(k.alias("source_no"), F.regexp_replace("c_name", "#0*", "-").alias("name"), folder.alias("folder"))
    return c.withColumn("kept", ct.folder_match(F.col("name"), F.col("folder")))


QUERIES = {
    f.__name__: f
    for f in (
        reference_stars, crossmatch_bands, nearest_catalog, hr_match, unique_match, isolated_sources, cone_search, nearest_snapshot,
        catalog_union, magnitude_filter, object_type, designation_keys, preferred_identifier, variable_candidates, brightest,
        comparison_candidates, comparison_sets, catalog_search, distance_map, distance_rejections, cluster_distance, catalog_dedupe, entity_resolution,
        layer_summary, prediction_merge, prediction_identity, cluster_match, cluster_members, snapshot_entries, folder_references, adu_screen, mag_error, ccd_flux_error, error_budget, phase_fold, hr_diagram,
        moonlight_score, reference_ranking, fallback_ranking, sampled_sets, stamp_bands, folder_match,
    )
}
