"""Registered queries of forced photometry: mosaics of the embedding images with stars at fixed places on the sky."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.functions.lineage import cut
from skyloom.functions.numeric import rounded
from skyloom.operators import forced as fo
from skyloom.plans import pixels as pp
from skyloom.plans import standins as si

#: Images of a mosaic (5 across), and the injected stars: offsets in arcseconds, height, and the frames that show them.
IMAGES = 20
STARS = ((-3.0, 1.0, 300.0, 1), (4.0, -1.5, 260.0, 6), (0.5, 2.0, 150.0, 1))
BLANKS = ((-0.5, -2.0), (2.0, 1.0))


def frames_table(spark, d):
    """One row per mosaic; the three fields' frames are shifted and turned against each other."""
    f = F.col("frame_id")
    ids = si.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / IMAGES).cast("long").alias("frame_id")).distinct()
    turn = (f % 7) * 0.02
    scale = 1.0 / 3600.0
    return ids.select(
        "frame_id", (f % 3).alias("field"), F.lit(40).alias("width"), F.lit(32).alias("height"), (F.lit(10.0) + f % 3).alias("crval1"), F.lit(20.0).alias("crval2"),
        (F.lit(20.0) + (f % 4) * 0.7).alias("crpix1"), (F.lit(16.0) - (f % 5) * 0.5).alias("crpix2"), (-F.cos(turn) * scale).alias("cd11"),
        (F.sin(turn) * scale).alias("cd12"), (F.sin(turn) * scale).alias("cd21"), (F.cos(turn) * scale).alias("cd22"),
    )


def _at(east: float, north: float):
    """Sky position of an offset from the field's centre."""
    return F.col("crval1") + east / 3600.0, F.col("crval2") + north / 3600.0


def mosaic(spark, d):
    e = si.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    tile = F.col("vec_id") % IMAGES
    p = e.select(
        F.floor(F.col("vec_id") / IMAGES).cast("long").alias("frame_id"), (F.floor(tile / 5) * 8 + F.floor(F.col("pos") / 8)).cast("long").alias("y"),
        (tile % 5 * 8 + F.col("pos") % 8).cast("long").alias("x"), (F.lit(100.0) + F.lit(50.0) * F.col("v").cast("double")).alias("base"),
    )
    places = frames_table(spark, d)
    for i, (east, north, height, every) in enumerate(STARS):
        sx, sy = sky.to_pixel(*_at(east, north))
        places = places.withColumns({f"sx{i}": sx, f"sy{i}": sy, f"h{i}": F.when(F.floor(F.col("frame_id") / 3) % every == 0, height).otherwise(0.0)})
    lit = p.join(places.select("frame_id", *[f"{c}{i}" for i in range(len(STARS)) for c in ("sx", "sy", "h")]), "frame_id")
    light = F.col("base")
    for i in range(len(STARS)):
        dx, dy = F.col("x") - F.col(f"sx{i}"), F.col("y") - F.col(f"sy{i}")
        light = light + F.col(f"h{i}") * F.exp(-(dx * dx + dy * dy) / 2.88)
    return lit.select("frame_id", "y", "x", light.alias("value"))


def _targets(spark, d):
    fields = frames_table(spark, d).select("field", "crval1", "crval2").distinct()
    every = [(f"star{i}", east, north) for i, (east, north, *_) in enumerate(STARS)] + [(f"blank{i}", *b) for i, b in enumerate(BLANKS)]
    of = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(east).alias("east"), F.lit(north).alias("north")) for name, east, north in every])
    t = fields.withColumn("t", F.explode(of))
    return t.select(
        F.concat_ws("-", F.col("t.name"), F.col("field").cast("string")).alias("group_id"), "field", (F.col("crval1") + F.col("t.east") / 3600.0).alias("ra_deg"),
        (F.col("crval2") + F.col("t.north") / 3600.0).alias("dec_deg"),
    )


def forced_signals(spark, d):
    pixels = cut(mosaic(spark, d))
    return rounded(fo.forced_signals(pixels, frames_table(spark, d), _targets(spark, d), fo.frame_noise(pixels), 1.5), 5)


def transient_search(spark, d):
    known = _targets(spark, d).where(F.col("group_id").startswith("star0")).select(F.col("group_id").alias("source_id"), F.concat(F.lit("Known "), "group_id").alias("name"), "ra_deg", "dec_deg")
    out = fo.search_transients(cut(mosaic(spark, d)), frames_table(spark, d), known, sigma=6.0, fwhm=1.5, group_radius_arcsec=2.5, edge_pixels=2)
    return rounded(out.drop("group_id"), 4, ra_deg=7, dec_deg=7)


def flagged_photometry(spark, d):
    k = F.col("vec_id")
    frames = si.table(spark, d, "embeddings").select(
        k.alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(k % 5 != 0, (k % 3) * 18.5).alias("edge_percent"),
        F.when(k % 7 != 0, F.lit(109.0) + k % 4).alias("saturation_threshold"),
    )
    return rounded(fo.flagged_photometry(pp._pixels(spark, d), pp._sources(spark, d), frames, ["frame_id"], 1.3, 1.9, 2.9), 5)


QUERIES = {f.__name__: f for f in (forced_signals, transient_search, flagged_photometry)}
