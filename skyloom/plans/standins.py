"""Domain tables derived by Spark from the driver tables (the drivers hold no astronomy).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame with the column names the operators expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.numeric import instrumental_magnitude, julian_date, ratio

FRAME_SECONDS = 21600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """A table of one small file in as many partitions as there are cores, for costly work on its rows; a table whose scan
    has them already is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def epoch(ts) -> F.Column:
    """Seconds since 1970 (double) of a zone-free timestamp read in a UTC session."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def user_ra(user="user_id"):
    return F.lit(10.0) + (F.col(user) * 37 % 1000) / F.lit(1000.0)


def user_dec(user="user_id"):
    return F.lit(20.0) + (F.col(user) * 91 % 1000) / F.lit(1000.0)


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "value", epoch("ts").alias("t"), F.floor(epoch("ts") / FRAME_SECONDS).alias("frame_no")
    )
    agg = ev.groupBy("frame_no", "event_type", "user_id").agg(
        F.avg("value").alias("flux"),
        F.count(F.lit(1)).alias("n"),
        F.max("value").alias("peak_pixel_value"),
        F.min("t").alias("observation_time"),
    )
    u = F.col("user_id")
    mag = F.lit(8.0) + (u % 80) / F.lit(10.0)
    return agg.select(
        F.concat(F.lit("frame_"), F.col("frame_no").cast("string"), F.lit(".fits")).alias("file_path"),
        F.col("frame_no").cast("long").alias("frame_no"),
        F.col("event_type").alias("filter_name"),
        F.concat(F.lit("S"), F.lpad(u.cast("string"), 8, "0")).alias("source_id"),
        F.concat(F.lit("Star "), u.cast("string")).alias("source_name"),
        u.alias("source_no"),
        F.concat(F.lit("field"), (u % 3).cast("string")).alias("object_name"),
        "observation_time",
        user_ra().alias("ra_deg"),
        user_dec().alias("dec_deg"),
        "flux",
        (F.sqrt("flux") / F.sqrt(F.col("n").cast("double"))).alias("flux_error"),
        instrumental_magnitude("flux").alias("instrumental_magnitude"),
        F.lit(None).cast("double").alias("differential_magnitude_error"),
        (u % 4 == 0).alias("is_reference"),
        (u % 4 == 1).alias("is_check"),
        (u % 4 >= 2).alias("is_variable"),
        mag.alias("catalog_magnitude"),
        # every seventh source has no standard-band entry and falls back to its catalog magnitude
        F.when(u % 7 != 0, mag + F.lit(0.05)).alias("band_mag"),
        F.when(u % 3 != 0, F.lit(0.01) + (u % 5) / F.lit(1000.0)).alias("band_error"),
        F.when(u % 2 == 0, F.lit("apass")).otherwise(F.lit("vsp")).alias("band_source"),
        "peak_pixel_value",
        F.lit(450.0).alias("saturation_threshold"),
        (F.col("peak_pixel_value") >= 450.0).alias("is_saturated"),
        ratio("flux", F.sqrt("flux") / F.sqrt(F.col("n").cast("double"))).alias("snr"),
        (F.col("n") * 1.5).alias("centroid_shift_pixels"),
        F.when(F.col("n") > 2, F.array(F.lit("Source recentred."))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.array().cast("array<string>").alias("comparison_source_ids"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("source_no"),
        F.concat(F.lit("G"), F.lpad(k.cast("string"), 9, "0")).alias("source_id"),
        F.col("c_name").alias("name"),
        F.lit("gaia").alias("catalog"),
        F.pmod(k * F.lit(137.508), F.lit(360.0)).alias("ra_deg"),
        (F.pmod(k * F.lit(61.8), F.lit(120.0)) - 60.0).alias("dec_deg"),
        (F.lit(8.0) + (F.col("c_acctbal") + 1000.0) / 1100.0).alias("magnitude"),
        F.col("c_mktsegment").alias("object_type"),
        (F.lit(0.2) + F.col("c_nationkey") / F.lit(10.0)).alias("bp_rp"),
        (F.lit(1.0) + k % 50).alias("parallax_mas"),
        (F.lit(0.1) + (k % 9) / F.lit(2.0)).alias("parallax_error_mas"),
        F.concat(F.lit("field"), (k % 10).cast("string")).alias("field"),
    )


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second catalog: near customer 15*key, a fraction of an arcsecond off for odd keys, 10 arcsec for even keys."""
    k = F.col("s_suppkey")
    c = k * 15
    off = F.when(k % 2 == 1, F.lit(0.2) + (k % 7) / F.lit(10.0)).otherwise(F.lit(10.0))
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_no"),
        F.concat(F.lit("V"), F.lpad(k.cast("string"), 9, "0")).alias("source_id"),
        F.col("s_name").alias("name"),
        F.when(k % 3 == 0, "vsp").when(k % 3 == 1, "apass").otherwise("gaia-g").alias("catalog"),
        F.pmod(c * F.lit(137.508), F.lit(360.0)).alias("ra_deg"),
        (F.pmod(c * F.lit(61.8), F.lit(120.0)) - 60.0 + off / F.lit(3600.0)).alias("dec_deg"),
        (F.lit(9.0) + (F.col("s_acctbal") + 1000.0) / 1500.0).alias("magnitude"),
        F.when(k % 4 == 0, F.lit(0.02)).alias("magnitude_error"),
        F.concat(F.lit("field"), (c % 10).cast("string")).alias("field"),
    )


def jd_of(column) -> F.Column:
    return julian_date(column)


def orders_with_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as image files: path text, root, header map, frame columns."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = spread_scan(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("d", F.col("o_orderdate").cast("date"))
    root = F.when(c % 7 == 0, "/data/archive/nested").when(c % 7 == 1, "/data/mirror").otherwise("/data/archive")
    folder = (
        F.when(k % 11 == 0, "flats").when(k % 13 == 0, "masters").when(k % 17 == 0, "Integration").when(k % 19 == 0, "processed")
        .when(F.col("o_orderstatus") == "F", "Lights").when(F.col("o_orderstatus") == "O", "calibrated").otherwise("registered")
    )
    flt = F.element_at(F.array(*[F.lit(x) for x in ("Lum", "red", "H-alpha", "o3", "Clear")]), (k % 5 + 1).cast("int"))
    exposure = F.concat(F.floor(F.col("o_totalprice") / 1000.0).cast("string"), F.lit(".5"))
    stem = F.concat(
        F.when(k % 23 == 0, "snap-").otherwise(F.lit("Light_")),
        F.lit("Target "), (c % 50).cast("string"), F.lit("_"), exposure, F.lit("s_Bin"), (k % 3 + 1).cast("string"), F.lit("_"), flt,
        F.lit("_"), F.date_format("d", "yyyyMMdd"), F.lit("-213000_"), k.cast("string"),
    )
    ext = F.when(k % 29 == 0, ".png").when(k % 31 == 0, ".cr2").otherwise(F.lit(".fits"))
    empty = F.lit(None).cast("string")
    header = F.map_filter(
        F.create_map(
            F.lit("FILTER"), F.when(k % 2 == 0, flt),
            F.lit("EXPTIME"), F.when(k % 4 == 0, exposure).when(k % 4 == 1, F.concat(exposure, F.lit(" sec"))).otherwise(empty),
            F.lit("EXPOSUREMS"), F.when(k % 4 == 2, F.concat(F.floor(F.col("o_totalprice")).cast("string"), F.lit("000"))),
            F.lit("IMAGETYP"), F.when(k % 37 == 0, "Dark Frame").when(k % 3 == 0, "Light"),
            F.lit("MASTTYPE"), F.when(k % 41 == 0, "Master_Light").when(k % 43 == 0, "Dark"),
            F.lit("INSTRUME"), F.concat(F.lit("cam"), (c % 4).cast("string")),
            F.lit("WCS"), F.when(k % 5 != 0, "T"),
            F.lit("DATE-OBS"), F.when(k % 2 == 1, F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T21:30:00.1234567"))),
        ),
        lambda key, v: v.isNotNull(),
    )
    return t.withColumn("header", header).select(
        F.concat(root, F.lit("/Target "), (c % 50).cast("string"), F.lit("/"), folder, F.lit("/"), stem, ext).alias("path"),
        root.alias("root_path"), "header", k.alias("file_no"), "d", "o_totalprice", "o_custkey",
        (F.unix_date("d").cast("double") * 86400.0 + (k % 86400)).alias("observation_time"),
    )
