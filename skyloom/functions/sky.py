"""Angles on the sky and radius joins by zone and right-ascension bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCSEC = 3600.0


def separation_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """Haversine separation; keeps precision for sub-arcsecond offsets."""
    ra1, dec1, ra2, dec2 = [F.radians(F.col(c) if isinstance(c, str) else c) for c in (ra1, dec1, ra2, dec2)]
    sd, sr = F.sin((dec1 - dec2) / 2.0), F.sin((ra1 - ra2) / 2.0)
    h = sd * sd + F.cos(dec1) * F.cos(dec2) * sr * sr
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * F.lit(ARCSEC)


def separation_arcmin(ra1, dec1, ra2, dec2) -> Column:
    """Arccos form, clamped, in arcminutes."""
    ra1, dec1, ra2, dec2 = [F.radians(F.col(c) if isinstance(c, str) else c) for c in (ra1, dec1, ra2, dec2)]
    c = F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(ra1 - ra2)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))) * F.lit(60.0)


def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + F.lit(90.0)) / F.lit(height)).cast("long")


def _buckets_in_zone(zone: Column, height: float) -> Column:
    """Number of RA buckets of a zone, so that a bucket is at least ``height`` wide on the sky."""
    south = F.abs(zone * F.lit(height) - 90.0)
    north = F.abs((zone + 1) * F.lit(height) - 90.0)
    widest = F.least(F.greatest(south, north), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(widest)) / F.lit(height))).cast("long")


def _bucket(ra: Column, count: Column) -> Column:
    return F.pmod(F.floor(F.pmod(ra, F.lit(360.0)) / F.lit(360.0) * count).cast("long"), count)


def with_sky_cell(df: DataFrame, ra: str, dec: str, radius_arcsec: float) -> DataFrame:
    """The one cell that holds each row."""
    h = max(radius_arcsec / ARCSEC * 1.0001, 1e-7)
    z = _zone(F.col(dec), h)
    return df.withColumn("__zone", z).withColumn("__cell", _bucket(F.col(ra), _buckets_in_zone(F.col("__zone"), h)))


def with_cover_cells(df: DataFrame, ra: str, dec: str, radius_arcsec: float) -> DataFrame:
    """Every cell the circle of the radius around each row can touch (RA wrap and poles included)."""
    h = max(radius_arcsec / ARCSEC * 1.0001, 1e-7)
    reach = F.radians(F.lit(radius_arcsec / ARCSEC * 1.0001))
    s = F.sin(reach) / F.cos(F.radians(F.col(dec)))
    span = F.when((F.abs(F.col(dec)) + radius_arcsec / ARCSEC < 89.9) & (s < 1.0), F.degrees(F.asin(s))).otherwise(F.lit(180.0))
    top = F.lit(int(180.0 / h))
    out = (
        df.withColumn("__z", _zone(F.col(dec), h))
        .withColumn("__zone", F.explode(F.sequence(F.greatest(F.col("__z") - 1, F.lit(0)), F.least(F.col("__z") + 1, top))))
        .withColumn("__nb", _buckets_in_zone(F.col("__zone"), h))
        .withColumn("__lo", F.floor((F.pmod(F.col(ra), F.lit(360.0)) - span) / 360.0 * F.col("__nb")).cast("long"))
        .withColumn("__hi", F.floor((F.pmod(F.col(ra), F.lit(360.0)) + span) / 360.0 * F.col("__nb")).cast("long"))
        .withColumn("__hi", F.least(F.col("__hi"), F.col("__lo") + F.col("__nb") - 1))
        .withColumn("__cell", F.explode(F.sequence("__lo", "__hi")))
        .withColumn("__cell", F.pmod("__cell", "__nb"))
    )
    return out.drop("__z", "__nb", "__lo", "__hi")


def _dealt(df: DataFrame) -> DataFrame:
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def within_radius(
    left: DataFrame, right: DataFrame, radius_arcsec: float, on: list[str] | None = None, inclusive: bool = True
) -> DataFrame:
    """Pairs of rows closer than the radius; both sides need ``ra_deg``/``dec_deg``.

    Right columns come back prefixed ``r_``; ``on`` names extra equality columns. The right side is copied to
    the few cells its circle touches, the left side stays in one cell. Both sides are dealt over the cores first: a side of
    one small file may be joined by broadcast, and would keep all its pairs in one task.
    """
    on = on or []
    left, right = _dealt(left), _dealt(right)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    lhs = with_sky_cell(left, "ra_deg", "dec_deg", radius_arcsec)
    rhs = with_cover_cells(r, "r_ra_deg", "r_dec_deg", radius_arcsec)
    rhs = rhs.withColumnRenamed("__zone", "__rzone").withColumnRenamed("__cell", "__rcell")
    cond = (F.col("__zone") == F.col("__rzone")) & (F.col("__cell") == F.col("__rcell"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"r_{c}"))
    sep = separation_arcsec("ra_deg", "dec_deg", "r_ra_deg", "r_dec_deg")
    test = sep <= F.lit(radius_arcsec) if inclusive else sep < F.lit(radius_arcsec)
    return (
        lhs.join(rhs, cond).where(test).withColumn("separation_arcsec", sep).drop("__zone", "__cell", "__rzone", "__rcell")
    )


def nearest_within(
    targets: DataFrame, donors: DataFrame, key: list[str], radius_arcsec: float, carry: list[str], tie: str, on: list[str] | None = None
) -> DataFrame:
    """Nearest donor within the radius per target (inner): key columns, donor fields ``m_*``, separation.

    Donors at exactly the same place are first reduced to the one with the least ``tie`` value, so a pile of copies
    joins as one row; the minimum per target is combined map-side.
    """
    on = on or []
    fields = [tie, *[c for c in carry if c != tie]]
    places = donors.groupBy(*on, "ra_deg", "dec_deg").agg(F.min_by(F.struct(*fields), F.col(tie)).alias("d"))
    pairs = within_radius(targets.select(*dict.fromkeys([*key, *on, "ra_deg", "dec_deg"])), places, radius_arcsec, on)
    best = pairs.groupBy(*key).agg(
        F.min(F.struct(F.col("separation_arcsec").alias("sep"), F.col(f"r_d.{tie}").alias("t"))).alias("b"),
        F.min_by(F.col("r_d"), F.struct("separation_arcsec", f"r_d.{tie}")).alias("m"),
    )
    return best.select(*key, *[F.col(f"m.{c}").alias(f"m_{c}") for c in fields], F.col("b.sep").alias("separation_arcsec"))


#: Columns of a frame's tangent-plane solution: sky and pixel of the reference point (pixels from 0) and degrees per pixel.
SOLUTION = ("crval1", "crval2", "crpix1", "crpix2", "cd11", "cd12", "cd21", "cd22")


def to_pixel(ra, dec) -> tuple[Column, Column]:
    """Pixel of a sky position by the row's ``SOLUTION`` columns; null on the far side of the sky and for a singular matrix."""
    ra, dec = [F.radians(F.col(c) if isinstance(c, str) else c) for c in (ra, dec)]
    ra0, dec0 = F.radians("crval1"), F.radians("crval2")
    depth = F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(ra - ra0)
    front = F.when(depth > 1e-6, depth)
    xi = F.degrees(F.cos(dec) * F.sin(ra - ra0) / front)
    eta = F.degrees((F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(ra - ra0)) / front)
    det = F.col("cd11") * F.col("cd22") - F.col("cd12") * F.col("cd21")
    usable = F.when(det != 0, det)
    x = F.col("crpix1") + (F.col("cd22") * xi - F.col("cd12") * eta) / usable
    y = F.col("crpix2") + (F.col("cd11") * eta - F.col("cd21") * xi) / usable
    return x, y


def to_sky(x, y) -> tuple[Column, Column]:
    """Sky position of a pixel by the row's ``SOLUTION`` columns."""
    dx, dy = [(F.col(c) if isinstance(c, str) else c) - F.col(p) for c, p in ((x, "crpix1"), (y, "crpix2"))]
    xi, eta = F.radians(F.col("cd11") * dx + F.col("cd12") * dy), F.radians(F.col("cd21") * dx + F.col("cd22") * dy)
    dec0 = F.radians("crval2")
    out = F.cos(dec0) - eta * F.sin(dec0)
    ra = F.pmod(F.col("crval1") + F.degrees(F.atan2(xi, out)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(dec0) + eta * F.cos(dec0), F.sqrt(xi * xi + out * out)))
