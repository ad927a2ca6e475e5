"""Catalog selection, sky matching, ranking, merging and de-duplication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions import sky
from skyloom.functions.components import connected_components
from skyloom.functions.groups import attach, group_quantiles, groups_fit, numbered
from skyloom.functions.lineage import cut
from skyloom.functions.names import band_source_rank

# Object-type ladder, first hit wins.
OBJECT_TYPES = (
    ("emission_nebula", ("EMO", "EMN", "Emission Nebula")),
    ("reflection_nebula", ("RFN", "Reflection Nebula")),
    ("dark_nebula", ("DNe", "Dark Nebula")),
    ("planetary_nebula", ("PN", "Pl", "Planetary Nebula")),
    ("hii_region", ("HII", "HII Region")),
    ("supernova_remnant", ("SNR", "SuperNova Remnant")),
    ("molecular_cloud", ("MoC", "Molecular Cloud")),
    ("star_forming_region", ("SFR", "Star-Forming Region", "Star Forming Region")),
    ("nebula", ("NB", "Neb", "GNe", "Nebula")),
    ("open_cluster", ("OC", "OpC", "Open Cluster")),
    ("globular_cluster", ("GC", "GlC", "Globular Cluster")),
    ("asterism", ("Ast", "Asterism")),
    ("association", ("As*", "Association")),
    ("quasar", ("Q?", "QSO", "Quasar")),
    ("blazar", ("Bz?", "BL?", "BLL", "Bla", "Blazar")),
    ("seyfert_galaxy", ("SyG", "Sy1", "Sy2", "Seyfert Galaxy")),
    ("active_galactic_nucleus", ("AG?", "AGN", "Active Galactic Nucleus")),
    ("galaxy_pair", ("IG", "PaG", "Interacting Galaxies", "Pair of Galaxies")),
    ("galaxy_group", ("GrG", "CGG", "Group of Galaxies", "Compact Group of Galaxies")),
    ("galaxy_cluster", ("ClG", "SCG", "Cluster of Galaxies", "Supercluster of Galaxies")),
    ("galaxy", ("G", "GX", "GiG", "GiC", "GiP", "LSB", "SBG", "bCG", "Galaxy")),
    ("radio_source", ("Rad", "Radio Source")),
    ("infrared_source", ("IR", "Infrared Source")),
    ("ultraviolet_source", ("UV", "Ultraviolet Source")),
    ("xray_source", ("X", "X-Ray Source", "X-Ray Binary")),
    ("gamma_source", ("gam", "Gamma-Ray Source")),
    ("gravitational_lens", ("Le?", "gLe", "LeI", "LeG", "Gravitational Lens")),
    ("variable_star", ("V*", "Variable Star")),
    ("binary_or_multiple_star", ("**", "SB*", "EB*", "Binary Star", "Multiple Object")),
    ("young_stellar_object", ("Y*O", "TT*", "Or*", "Young Stellar Object", "T Tau Star")),
    ("emission_line_star", ("Em*", "Emission-Line Star")),
    ("white_dwarf", ("WD*", "White Dwarf")),
    ("brown_dwarf", ("BD*", "Brown Dwarf")),
    ("exoplanet_host", ("Pl", "Planetary System", "Exoplanet Host Star")),
    ("star", ("*", "Star")),
)

# Layers whose objects all have one type key.
LAYER_TYPES = {
    "solar_system": "asteroid_comet", "exoplanets": "exoplanet_host", "variable_stars": "variable_star", "gaia_stars": "star",
}

# Catalog designation patterns (upper-case text) and the prefix of their key.
DESIGNATIONS = (
    (r"\bM\s*0*(\d+)\b(?!\s*[-+]\s*\d)()", "M"),
    (r"\bNGC\s*0*(\d+)\s*([A-Z])?(?!\s*\d)\b", "NGC"),
    (r"\bIC\s*0*(\d+)\s*([A-Z])?(?!\s*\d)\b", "IC"),
    (r"\bLDN\s*0*(\d+)\b()", "LDN"),
    (r"\bLBN\s*0*(\d+)\b()", "LBN"),
    (r"\bBARNARD\s*0*(\d+)\b()", "B"),
    (r"\bB\s*[- ]\s*0*(\d+)\b()", "B"),
    (r"\b(?:SH\s*0*2|SH2|SHARPLESS)\s*[- ]?0*(\d+)\b()", "SH2"),
    (r"\b(?:VDB|VAN\s+DEN\s+BERGH)\s*0*(\d+)\b()", "VDB"),
    (r"\bHASH\s*0*(\d+)\b()", "HASH"),
)

# Identifier prefixes that are preferred or only generic.
PREFERRED_IDENTIFIERS = ("hd ", "hr ", "hip ", "tyc ", "bd", "cd", "cpd", "sao ", "v* ", "cl* ", "* ")
GENERIC_IDENTIFIERS = (
    "gaia dr", "gaia edr", "2mass ", "wise ", "allwise ", "apass ", "ucac", "tic ", "tycho-2 ", "gsc ", "ps1 ",
)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def object_type_key(object_type: Column, layer: Column) -> Column:
    """Type key of a catalog type text: layer first, then the ladder, then a general or other key."""
    row = F.struct(F.upper(_squeeze(F.coalesce(object_type, F.lit("")))).alias("raw"))

    def pick(r):
        raw, compact = r["raw"], F.regexp_replace(r["raw"], " ", "")
        out = F.when(layer == "solar_system", LAYER_TYPES["solar_system"])
        for name, key in list(LAYER_TYPES.items())[1:]:
            out = out.when(layer == name, key)
        for key, texts in OBJECT_TYPES:
            texts = [t.upper() for t in texts]
            hit = compact.isin(*[t.replace(" ", "") for t in texts])
            for t in texts:
                if len(t) >= 4:
                    hit = hit | raw.contains(t)
            out = out.when(hit, key)
        return out.when(layer == "general_objects", "general_object").otherwise("other_deep_sky")

    return n.let(row, pick)


def designation_keys(*texts: Column) -> Column:
    """Distinct designation keys of the texts; a match right after "]" or "CL*" belongs to a paper and is skipped."""
    def keys_with(prefix):
        def key(number, suffix):
            digits = F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), F.lit("0"))
            return F.concat(F.lit(prefix), digits, F.coalesce(suffix, F.lit("")))

        return key

    found = []
    for text in texts:
        upper = F.upper(_squeeze(F.coalesce(text, F.lit(""))))
        free = F.regexp_replace(upper, r"(\]|CL\*)\s*\S+(\s+\d+)?", " ")
        for pattern, prefix in DESIGNATIONS:
            numbers = F.regexp_extract_all(free, F.lit(pattern), F.lit(1))
            suffixes = F.regexp_extract_all(free, F.lit(pattern), F.lit(2))
            found.append(F.zip_with(numbers, suffixes, keys_with(prefix)))
    return F.array_distinct(F.flatten(F.array(*found)))


def preferred_identifier(main_id: Column, ids: Column) -> Column:
    """Best of the main id and "|"-separated aliases: non-generic, preferred prefix, shortest, then alphabetical."""
    tidy = lambda t: F.regexp_replace(_squeeze(t), r"(?i)^NAME ", "")
    every = F.filter(
        F.transform(F.array_compact(F.concat(F.array(main_id), F.coalesce(F.split(ids, r"\|"), F.array().cast("array<string>")))), tidy),
        lambda t: (t != "") & (t != "--"),
    )

    def starts(t, prefixes):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.lower(t).startswith(p)
        return hit

    ranked = F.transform(
        every,
        lambda t: F.struct(
            starts(t, GENERIC_IDENTIFIERS).alias("generic"),
            F.when(starts(t, PREFERRED_IDENTIFIERS), 0).when(starts(t, GENERIC_IDENTIFIERS), 20).otherwise(5).alias("rank"),
            F.length(t).alias("len"),
            F.lower(t).alias("low"),
            t.alias("id"),
        ),
    )
    return F.array_min(ranked)["id"]


def magnitude_filter(objects: DataFrame, maximum: float | None, exclude_unknown: bool = False) -> DataFrame:
    """Magnitude limit that never removes deep-sky objects for being faint."""
    known = n.finite("magnitude")
    if maximum is None:
        return objects.where(known) if exclude_unknown else objects
    bright = F.col("magnitude") <= F.lit(float(maximum))
    unknown_ok = F.lit(not exclude_unknown)
    return objects.where(F.when(F.col("layer") == "deep_sky", known | unknown_ok).when(~known, unknown_ok).otherwise(bright))


def adu_screen(rows: DataFrame, min_above_sky: float = 1000.0, max_fraction: float = 0.80) -> DataFrame:
    """Rows whose peak is well above the sky and well below saturation."""
    sky_level = F.coalesce("background_level", F.lit(0.0))
    low_enough = ~n.finite("saturation_threshold") | (F.col("saturation_threshold") <= 0) | (
        F.col("peak_pixel_value") <= F.col("saturation_threshold") * max_fraction
    )
    return rows.where(
        n.finite("peak_pixel_value")
        & (F.col("peak_pixel_value") - sky_level >= min_above_sky)
        & low_enough
        & ~F.coalesce(F.col("is_saturated"), F.lit(False))
    )


def folder_match(name: Column, folder: Column) -> Column:
    """Star named like its object folder: equal, contained either way, or its first two words are in the name."""
    tidy = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", " "))
    a, b = tidy(name), tidy(folder)
    words = F.filter(F.split(b, " "), lambda w: ~w.rlike(r"^\d+$") & (w != ""))
    two = F.array_join(F.slice(words, 1, 2), " ")
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | ((F.size(words) >= 2) & a.contains(two)))


def reference_stars(
    stars: DataFrame,
    variables: DataFrame,
    limit: int = 25,
    exclusion_arcsec: float = 30.0,
    low: float = 8.0,
    high: float = 16.0,
    preferred: tuple[float, float] = (10.0, 13.5),
) -> DataFrame:
    """Up to ``limit`` comparison stars per field, none within the exclusion radius of a variable."""
    low, high = sorted((low, high))
    usable = stars.where(F.col("magnitude").between(low, high))
    near = sky.within_radius(
        usable.select("source_id", "ra_deg", "dec_deg"), variables.select("ra_deg", "dec_deg").distinct(), exclusion_arcsec,
        inclusive=False,
    )
    free = usable.join(near.select("source_id").distinct(), "source_id", "left_anti")
    band = F.when(F.col("magnitude").between(max(low, preferred[0]), min(high, preferred[1])), 0).otherwise(1)
    off = F.abs(F.col("magnitude") - F.lit((low + high) / 2.0))
    w = Window.partitionBy("field").orderBy(band, off, "magnitude", "source_id")
    return free.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def crossmatch_bands(targets: DataFrame, donors: DataFrame, radius_arcsec: float = 2.0) -> DataFrame:
    """Best magnitude per (target, band) among its own and the nearest donor of each donor catalog.

    Both sides are long: ``source_id, ra_deg, dec_deg, catalog, band, mag, error``. Source rank decides; a donor wins a tie.
    """
    where = donors.select("catalog", "source_id", "ra_deg", "dec_deg").distinct()
    places = where.groupBy("catalog", "ra_deg", "dec_deg").agg(F.min("source_id").alias("donor_id"))
    pairs = sky.within_radius(targets.select("source_id", "ra_deg", "dec_deg").distinct(), places, radius_arcsec)
    nearest = pairs.groupBy("source_id", F.col("r_catalog").alias("catalog")).agg(
        F.min_by("r_donor_id", F.struct("separation_arcsec", "r_donor_id")).alias("donor_id"),
        F.min("separation_arcsec").alias("separation_arcsec"),
    )
    bands = donors.select("catalog", F.col("source_id").alias("donor_id"), "band", "mag", "error")
    given = nearest.join(bands, ["catalog", "donor_id"]).select(
        "source_id", "band", "catalog", "mag", "error", F.lit(1).alias("given"), "separation_arcsec"
    )
    own = targets.select("source_id", "band", "catalog", "mag", "error", F.lit(0).alias("given"), F.lit(None).cast("double").alias("separation_arcsec"))
    order = F.struct(band_source_rank(F.col("catalog")), F.col("given"), F.col("catalog"))
    return (
        own.unionByName(given)
        .where(n.finite("mag"))
        .groupBy("source_id", "band")
        .agg(F.max_by(F.struct("mag", "error", "catalog", "separation_arcsec"), order).alias("b"))
        .select("source_id", "band", "b.mag", F.col("b.error").alias("error"), F.col("b.catalog").alias("band_source"), "b.separation_arcsec")
    )


def stamp_bands(measurements: DataFrame, bands: DataFrame) -> DataFrame:
    """Add each source's band magnitudes as a map column."""
    per = bands.groupBy("source_id").agg(
        F.map_from_entries(F.collect_list(F.struct("band", F.struct("mag", "error", "band_source")))).alias("band_magnitudes")
    )
    return measurements.join(per, "source_id", "left")


#: Nested cells of the unit sphere: bits added in a round, and the finest level.
CELL_BITS, FINEST_CELL = 2, 50


def nearest_catalog(detections: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Nearest catalog entry of every detection at any distance (ties: the smaller name).

    The catalog's places lie in nested cells of the unit sphere. Each detection goes down through the cells that can hold
    its neighbour: of the cells met, those stay whose nearest corner is no farther than the farthest corner of another, so
    a crowded part of the sky is entered by the detections next to it and only along their neighbours. Rows per detection
    stay a few dozen whatever the density.
    """
    unit = lambda: {"ux": F.cos(F.radians("dec_deg")) * F.cos(F.radians("ra_deg")), "uy": F.cos(F.radians("dec_deg")) * F.sin(F.radians("ra_deg")), "uz": F.sin(F.radians("dec_deg"))}
    axes = ("ux", "uy", "uz")
    sane = n.finite("ra_deg") & n.finite("dec_deg")
    stars = cut(catalog.where(sane).groupBy("ra_deg", "dec_deg").agg(F.min("name").alias("m_name")).withColumns(unit()))
    spots = cut(detections.where(sane).select("ra_deg", "dec_deg").distinct().withColumns(unit()))
    cell = lambda level: [F.floor((F.least(F.col(a), F.lit(1.0 - 1e-15)) + 1.0) * float(2.0 ** (level - 1))).cast("long").alias(f"c_{a}") for a in axes]
    cells = [f"c_{a}" for a in axes]

    def boxes(level: int) -> DataFrame:
        sides = [f(a).alias(f"{side}_{a}") for a in axes for f, side in ((F.min, "low"), (F.max, "high"))]
        rows = stars.select(*axes, *cell(level)).groupBy(*cells).agg(*sides, F.count(F.lit(1)).alias("held"))
        return rows.withColumns({f"p_{a}": F.shiftright(f"c_{a}", CELL_BITS) for a in axes})

    state, level = spots.withColumns({f"p_{a}": F.lit(0).cast("long") for a in axes}), 0
    spot = ["ra_deg", "dec_deg"]
    while True:
        level += CELL_BITS
        met = state.join(boxes(level), [f"p_{a}" for a in axes])
        gap, far = F.lit(0.0), F.lit(0.0)
        for a in axes:
            away = F.greatest(F.lit(0.0), F.col(f"low_{a}") - F.col(a), F.col(a) - F.col(f"high_{a}"))
            most = F.greatest(F.abs(F.col(a) - F.col(f"low_{a}")), F.abs(F.col(a) - F.col(f"high_{a}")))
            gap, far = gap + away * away, far + most * most
        met = met.select(*spot, *axes, *cells, "held", F.sqrt(gap).alias("gap"), F.sqrt(far).alias("far"))
        bound = F.min("far").over(Window.partitionBy(*spot))
        state = cut(met.withColumn("bound", bound).where(F.col("gap") <= F.col("bound") + 1e-14).select(*spot, *axes, *[F.col(f"c_{a}").alias(f"p_{a}") for a in axes], "held"))
        if level >= FINEST_CELL or state.where("held > 1").isEmpty():
            break
        state = state.drop("held")
    last = stars.select(F.col("ra_deg").alias("s_ra"), F.col("dec_deg").alias("s_dec"), "m_name", *[c.alias(f"p_{a}") for a, c in zip(axes, cell(level))])
    pairs = state.join(last, [f"p_{a}" for a in axes]).withColumn("separation_arcsec", sky.separation_arcsec("ra_deg", "dec_deg", "s_ra", "s_dec"))
    best = pairs.groupBy(*spot).agg(F.min(F.struct("separation_arcsec", "m_name")).alias("b")).select(*spot, "b.m_name", "b.separation_arcsec")
    return detections.select(key, *spot).join(best, spot, "left").drop(*spot)


def match_tolerance_px(pixel_scale: float, aperture: float) -> float:
    return max(1.5, min(6.0, max(2.5 * pixel_scale, aperture)))


def one_detection_per_star(detections: DataFrame, catalog: DataFrame, radius_arcsec: float) -> DataFrame:
    """Nearest catalog star of each detection, then the closest detection of each star."""
    hit = sky.nearest_within(detections, catalog, ["detection_id"], radius_arcsec, ["source_id"], "source_id")
    return hit.groupBy(F.col("m_source_id").alias("source_id")).agg(
        F.min_by("detection_id", F.struct("separation_arcsec", "detection_id")).alias("detection_id"),
        F.min("separation_arcsec").alias("separation_arcsec"),
        F.count(F.lit(1)).alias("detection_count"),
    )


def unique_nearest(
    a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, a_id: str = "a_id", b_id: str = "b_id"
) -> DataFrame:
    """Planar matching per group: nearest b of each a within the tolerance, then each b keeps its closest a.

    Points fall into squares of the tolerance; b is copied to its nine squares.
    """
    def square(c):
        return F.floor(F.col(c) / F.lit(tolerance)).cast("long")

    left = a.select(*keys, a_id, F.col("x"), F.col("y"), square("x").alias("__cx"), square("y").alias("__cy"))
    right = (
        b.select(*keys, b_id, F.col("x").alias("__bx"), F.col("y").alias("__by"), square("x").alias("__ix"), square("y").alias("__iy"))
        .withColumn("__cx", F.explode(F.sequence(F.col("__ix") - 1, F.col("__ix") + 1)))
        .withColumn("__cy", F.explode(F.sequence(F.col("__iy") - 1, F.col("__iy") + 1)))
        .drop("__ix", "__iy")
    )
    dx, dy = F.col("x") - F.col("__bx"), F.col("y") - F.col("__by")
    pairs = left.join(right, [*keys, "__cx", "__cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= F.lit(tolerance * tolerance))
    first = pairs.groupBy(*keys, a_id).agg(F.min_by(b_id, F.struct("d2", b_id)).alias(b_id), F.min("d2").alias("d2"))
    return first.groupBy(*keys, b_id).agg(F.min_by(a_id, F.struct("d2", a_id)).alias(a_id), F.min("d2").alias("d2"))


def isolated_sources(stars: DataFrame, radius_arcsec: float) -> DataFrame:
    """Stars without another star inside the radius; a place shared by several is settled without pairing them."""
    places = stars.groupBy("ra_deg", "dec_deg").agg(F.count(F.lit(1)).alias("__at"))
    crowded = sky.within_radius(places, places.select("ra_deg", "dec_deg"), radius_arcsec, inclusive=False).where(
        (F.col("ra_deg") != F.col("r_ra_deg")) | (F.col("dec_deg") != F.col("r_dec_deg"))
    )
    busy = crowded.select("ra_deg", "dec_deg").union(places.where(F.col("__at") > 1).select("ra_deg", "dec_deg")).distinct()
    return stars.join(busy, ["ra_deg", "dec_deg"], "left_anti")


def cone_search(queries: DataFrame, catalog: DataFrame, radius_arcsec: float, rows: int | None = None) -> DataFrame:
    """Catalog rows around each query point, first per case-folded name, in order of separation."""
    hits = sky.within_radius(queries.select("query_id", "ra_deg", "dec_deg"), catalog.select("ra_deg", "dec_deg", "name", "source_id", "magnitude"), radius_arcsec)
    first = hits.groupBy("query_id", F.lower("r_name").alias("__n")).agg(
        F.min_by(F.struct("r_source_id", "r_name", "r_magnitude", "separation_arcsec"), F.struct("separation_arcsec", "r_source_id")).alias("h")
    )
    w = Window.partitionBy("query_id").orderBy("h.separation_arcsec", "h.r_source_id")
    out = first.select(
        "query_id", F.col("h.r_source_id").alias("source_id"), F.col("h.r_name").alias("name"), F.col("h.r_magnitude").alias("magnitude"),
        F.col("h.separation_arcsec").alias("separation_arcsec"), F.row_number().over(w).cast("long").alias("rank"),
    )
    return out.where(F.col("rank") <= rows) if rows else out


def nearest_snapshot(queries: DataFrame, snapshots: DataFrame, max_hours: float = 18.0) -> DataFrame:
    """Snapshot of the same site nearest in time that is deep and large enough.

    Sites are cut into slots of the time limit, so a query meets three slots instead of all snapshots of its site.
    """
    slot = F.lit(max_hours * 3600.0)
    q = queries.withColumn("__slot", F.explode(F.sequence((F.floor(F.col("at") / slot) - 1).cast("long"), (F.floor(F.col("at") / slot) + 1).cast("long"))))
    s = snapshots.select(
        F.col("site").alias("__site"), F.floor(F.col("snapshot_at") / slot).cast("long").alias("__sslot"), "snapshot_id", "snapshot_at",
        "magnitude_limit", "row_count",
    )
    ok = (
        (F.col("site") == F.col("__site")) & (F.col("__slot") == F.col("__sslot")) & (F.col("magnitude_limit") >= F.col("wanted_limit"))
        & (F.col("row_count") >= F.col("wanted_rows")) & (F.abs(F.col("at") - F.col("snapshot_at")) <= slot)
    )
    gap = F.abs(F.col("at") - F.col("snapshot_at"))
    return q.join(s, ok).groupBy("query_id").agg(
        F.min_by("snapshot_id", F.struct(gap, F.col("magnitude_limit"), F.col("row_count"), F.col("snapshot_id"))).alias("snapshot_id"),
        F.min(gap).alias("gap_seconds"),
        F.count(F.lit(1)).alias("candidate_count"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the given order, by a combinable minimum."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def choose_field(stars: DataFrame) -> DataFrame:
    """Best field per group by 100000*variables + stars."""
    per = stars.groupBy("group_id", "field").agg(
        F.count_if(F.col("is_variable")).alias("variable_count"), F.count_if(~F.col("is_variable")).alias("star_count")
    )
    score = F.col("variable_count") * 100000 + F.col("star_count")
    return per.groupBy("group_id").agg(
        F.max_by("field", F.struct(score, F.col("field"))).alias("field"), F.max(score).alias("score")
    )


def variable_candidates(stars: DataFrame, variables: DataFrame, references: DataFrame, low=None, high=None, limit: int = 60) -> DataFrame:
    """The brightest ``limit`` stars of each field (0: all) that are neither known to vary (variables, exoplanet hosts among
    them) nor references."""
    known = variables.select("source_id").union(references.select("source_id")).distinct()
    out = stars.join(known, "source_id", "left_anti").where(n.finite("magnitude"))
    if low is not None:
        out = out.where(F.col("magnitude") >= low)
    if high is not None:
        out = out.where(F.col("magnitude") <= high)
    if limit <= 0:
        return out
    w = Window.partitionBy("field").orderBy("magnitude", F.lower("name"), "source_id")
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def brightest(stars: DataFrame, keys: list[str], percent: float | None = None, count: int | None = None, fits: bool | None = None) -> DataFrame:
    """Brightest stars of each group by count or percent (at least one), unknown magnitudes last."""
    fits = groups_fit(stars, keys) if fits is None else fits
    rows = stars.withColumn("__m", F.coalesce(n.finite_or_null("magnitude"), F.lit(1e9))).withColumn("__l", F.lower("name"))
    sizes = stars.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = attach(numbered(rows, keys, "__m", ["__l", "source_id"], "rank", fits, slot=0.05), sizes, keys)
    wanted = F.lit(max(1, count)) if count is not None else F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(percent) / 100.0))
    return rows.where(F.col("rank") <= wanted).drop("__m", "__l", "__n")


def comparison_candidates(
    targets: DataFrame, references: DataFrame, max_mag: float = 1.0, max_color: float = 0.3, max_arcmin: float = 15.0, pool: int = 30
) -> DataFrame:
    """References near each target in place, magnitude and colour, scored by the sum of scaled differences.

    A score of t or less needs every scaled difference to be t or less, so a target that finds ``pool`` references of such a
    score within t of all limits has its best ones. Rounds begin with a t that suits the density of the references and double
    it for the targets still open; the last round has the whole limits.
    """
    refs = references.select("source_id", "name", "ra_deg", "dec_deg", "magnitude", "bp_rp")
    open_, parts = cut(targets.select("target_id", "ra_deg", "dec_deg", "magnitude", "bp_rp")), []
    inside = refs.count() * (1.0 - math.cos(math.radians(min(max_arcmin / 60.0, 180.0)))) / 2.0
    share = min(1.0, (4.0 * pool / inside) ** (1.0 / 3.0)) if inside > 0 else 1.0
    while share < 1.0:
        ranked = cut(_ranked_candidates(open_, refs, max_mag, max_color, max_arcmin, pool, share))
        closed = ranked.where((F.col("rank") == pool) & (F.col("score") <= share)).select("target_id")
        parts.append(ranked.join(closed, "target_id", "left_semi"))
        open_ = cut(open_.join(closed, "target_id", "left_anti"))
        share *= 2.0
    out = _ranked_candidates(open_, refs, max_mag, max_color, max_arcmin, pool, 1.0)
    for part in parts:
        out = out.unionByName(part)
    return out


def _ranked_candidates(targets: DataFrame, refs: DataFrame, max_mag: float, max_color: float, max_arcmin: float, pool: int, share: float) -> DataFrame:
    """The first ``pool`` references of each target among those within ``share`` of all limits."""
    within = lambda limit: limit if share == 1.0 else limit * share * (1.0 + 1e-9)
    pairs = sky.within_radius(targets, refs, within(max_arcmin) * 60.0 * 1.001)
    sep = sky.separation_arcmin("ra_deg", "dec_deg", "r_ra_deg", "r_dec_deg")
    dm = F.when(n.finite("magnitude") & n.finite("r_magnitude"), F.abs(F.col("r_magnitude") - F.col("magnitude")))
    dc = F.when(n.finite("bp_rp") & n.finite("r_bp_rp"), F.abs(F.col("r_bp_rp") - F.col("bp_rp")))
    rows = pairs.withColumns({"separation_arcmin": sep, "delta_mag": dm, "delta_color": dc}).where(
        (F.col("separation_arcmin") <= within(max_arcmin))
        & (F.col("delta_mag").isNull() | (F.col("delta_mag") <= within(max_mag)))
        & ~(n.finite("magnitude") & ~n.finite("r_magnitude"))
        & (F.col("delta_color").isNull() | (F.col("delta_color") <= within(max_color)))
    )
    score = (
        F.coalesce(F.col("delta_mag") / max_mag, F.lit(0.0)) + F.coalesce(F.col("delta_color") / max_color, F.lit(0.0))
        + F.col("separation_arcmin") / max_arcmin
    )
    w = Window.partitionBy("target_id").orderBy("score", "separation_arcmin", F.lower("r_name"), "r_source_id")
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)
    return ranked.select(
        "target_id", F.col("r_source_id").alias("source_id"), "separation_arcmin", "delta_mag", "delta_color", "score",
        F.col("rank").cast("long").alias("rank"),
    )


def comparison_sets(favourites: DataFrame, key: str, size: int, limit: int = 1024) -> DataFrame:
    """All unordered sets of ``size`` members of a short favourites list (long rows: key, source_id, position).

    Sets grow one member at a time in position order. Past ``limit`` sets per key the nearest set and then the sets of
    least hash stay, a fixed order that stands in for seeded sampling.
    """
    ids = favourites.select(key, "source_id", "position").distinct()
    sets = ids.select(key, F.array("source_id").alias("members"), F.col("position").alias("__last"), F.array("position").alias("__ps"))
    for _ in range(size - 1):
        nxt = ids.select(F.col(key).alias("__k"), F.col("source_id").alias("__id"), F.col("position").alias("__p"))
        sets = sets.join(nxt, (F.col(key) == F.col("__k")) & (F.col("__p") > F.col("__last"))).select(
            key, F.array_append("members", F.col("__id")).alias("members"), F.col("__p").alias("__last"),
            F.array_append("__ps", F.col("__p")).alias("__ps"),
        )
    nearest = F.when(F.col("__last") == size, 0).otherwise(1)
    w = Window.partitionBy(key).orderBy(nearest, F.xxhash64(F.concat_ws("|", "members")), F.concat_ws("|", "members"))
    kept = sets.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit)
    return kept.select(key, "members", F.concat_ws("|", "members").alias("set_id"))


def catalog_search(objects: DataFrame, query: str, limit: int = 80, star_limit: float | None = None, deep_limit: float | None = None) -> DataFrame:
    """Name search: exact, then prefix, then substring, over names and aliases with and without spaces."""
    text = " ".join(query.strip().lower().split())
    tight = text.replace(" ", "")
    deep_limit = deep_limit if deep_limit is not None else (None if star_limit is None else max(16.0, star_limit))
    low = F.lower("name")
    names = F.concat(F.array(low), F.transform("aliases", lambda a: F.lower(a)))
    every = F.concat(names, F.transform(names, lambda a: F.regexp_replace(a, " ", "")))
    rank = (
        F.when(F.exists(every, lambda a: (a == text) | (a == tight)), 0)
        .when(F.exists(every, lambda a: a.startswith(text) | a.startswith(tight)), 1)
        .when(F.exists(every, lambda a: a.contains(text) | a.contains(tight)), 2)
    )
    is_star = F.lower("object_type") == "star"
    fine = F.col("magnitude").isNull()
    fine = fine | (is_star & (F.lit(True) if star_limit is None else F.col("magnitude") <= star_limit))
    fine = fine | (~is_star & (F.lit(True) if deep_limit is None else F.col("magnitude") <= deep_limit))
    hits = objects.where(fine).withColumn("match_rank", rank).where(F.col("match_rank").isNotNull())
    return hits.orderBy("match_rank", F.col("magnitude").asc_nulls_last(), F.lower("name"), "source_no").limit(limit)


def distance_map(stars: DataFrame, min_snr: float = 5.0, max_pc: float = 500.0) -> DataFrame:
    """Stars with distance, near/far interval and x/y/z, each with its rejection reason (null when accepted)."""
    p = n.parallax_or_null("parallax_mas")
    e = n.parallax_or_null("parallax_error_mas")
    d = F.lit(1000.0) / p
    reason = F.when(e.isNull() | p.isNull() | (p / e < min_snr), "low_snr").when(d > max_pc, "distance")
    ra, dec = F.radians("ra_deg"), F.radians("dec_deg")
    a, b = F.lit(1000.0) / (p + e), F.lit(1000.0) / F.greatest(p - e, F.lit(1e-6))
    return stars.select(
        *stars.columns,
        d.alias("distance_pc"),
        (p / e).alias("parallax_snr"),
        F.least(a, b).alias("near_pc"),
        F.greatest(a, b).alias("far_pc"),
        (d * F.cos(dec) * F.cos(ra)).alias("x_pc"),
        (d * F.cos(dec) * F.sin(ra)).alias("y_pc"),
        (d * F.sin(dec)).alias("z_pc"),
        reason.alias("rejected"),
    )


def cluster_distance(members: DataFrame, key: str) -> DataFrame:
    """1000 / inverse-variance mean parallax, else the median distance."""
    ok = n.parallax_or_null("parallax_error_mas").isNotNull() & n.parallax_or_null("parallax_mas").isNotNull()
    w = F.when(ok, F.lit(1.0) / (F.col("parallax_error_mas") * F.col("parallax_error_mas")))
    sums = members.groupBy(key).agg(
        (F.sum(w * F.col("parallax_mas")) / F.sum(w)).alias("__p"), F.count(F.lit(1)).alias("member_count")
    )
    med = group_quantiles(members, [key], n.distance_pc("parallax_mas"), {"median_distance_pc": 0.5})
    out = sums.join(med, key, "left")
    return out.select(
        key, "member_count", F.coalesce(F.when(F.col("__p") > 0, F.lit(1000.0) / F.col("__p")), F.col("median_distance_pc")).alias("mean_distance_pc"),
        "median_distance_pc",
    )


def merge_star_catalogs(primary: DataFrame, secondary: DataFrame, radius_deg: float = 0.12) -> DataFrame:
    """Secondary rows join unless an identical position (4 places) or a named star is close by."""
    grid = [F.round("ra_deg", 4).alias("__ra"), F.round("dec_deg", 4).alias("__dec")]
    fresh = secondary.select("*", *grid).join(primary.select(*grid).distinct(), ["__ra", "__dec"], "left_anti").drop("__ra", "__dec")
    close = sky.within_radius(
        fresh.select("source_id", "ra_deg", "dec_deg"), primary.where("is_named").select("ra_deg", "dec_deg").distinct(), radius_deg * 3600.0
    )
    kept = fresh.join(close.select("source_id").distinct(), "source_id", "left_anti")
    return primary.withColumn("origin", F.lit("primary")).unionByName(kept.withColumn("origin", F.lit("secondary")))


def merge_deep_sky(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Secondary objects join unless name, any alias, or the position (3 places) is already known."""
    names = primary.select(F.lower("name").alias("__name")).distinct()
    aliases = primary.select(F.explode(F.transform("aliases", lambda x: F.lower(x))).alias("__alias")).distinct()
    grid = [F.round("ra_deg", 3).alias("__ra"), F.round("dec_deg", 3).alias("__dec")]
    rows = secondary.withColumn("__name", F.lower("name")).join(names, "__name", "left_anti").drop("__name")
    shared = rows.select("source_id", F.explode(F.transform("aliases", lambda x: F.lower(x))).alias("__alias")).join(aliases, "__alias", "left_semi")
    rows = rows.join(shared.select("source_id").distinct(), "source_id", "left_anti")
    rows = rows.select("*", *grid).join(primary.select(*grid).distinct(), ["__ra", "__dec"], "left_anti").drop("__ra", "__dec")
    return primary.unionByName(rows)


def entity_resolution(objects: DataFrame) -> DataFrame:
    """One row per physical object: rows that share an identity, position or designation key form an entity.

    Each row links to the smallest row of each of its keys, so a key shared by many rows costs one edge per row. The first
    row seen keeps its fields; size takes the largest value and a missing magnitude the first known one.
    """
    ident = F.concat_ws("|", F.lit("i"), "catalog", F.lower("source_id"), F.round(F.col("ra_deg") * 3600.0).cast("long"), F.round(F.col("dec_deg") * 3600.0).cast("long"))
    place = F.concat_ws("|", F.lit("p"), "layer", F.round(F.col("ra_deg") * 360.0).cast("long"), F.round(F.col("dec_deg") * 360.0).cast("long"))
    named = F.transform(designation_keys(F.col("name"), F.col("source_id")), lambda k: F.concat(F.lit("d|"), F.col("layer"), F.lit("|"), k))
    keyed = objects.select("seen_order", F.explode(F.concat(F.array(ident, place), named)).alias("__key"))
    firsts = keyed.groupBy("__key").agg(F.min("seen_order").alias("b"))
    edges = keyed.join(firsts, "__key").select(F.col("seen_order").alias("a"), "b")
    comp = connected_components(objects, edges, "seen_order")
    known = n.finite("magnitude")
    return (
        objects.join(comp, "seen_order")
        .groupBy("component")
        .agg(
            F.min_by(F.struct("name", "source_id", "layer", "ra_deg", "dec_deg", "object_type"), "seen_order").alias("__f"),
            F.min_by(F.when(known, F.col("magnitude")), F.when(known, F.col("seen_order"))).alias("__known"),
            F.max("size_arcmin").alias("size_arcmin"),
            F.count(F.lit(1)).alias("merged_count"),
        )
        .select(F.col("component").alias("seen_order"), "__f.*", F.col("__known").alias("magnitude"), "size_arcmin", "merged_count")
    )


def layer_summary(objects: DataFrame, per_layer: int) -> DataFrame:
    """Returned and displayed counts per (field, layer); displayed are the brightest inside the frame."""
    keys = ["field", "layer"]
    w = Window.partitionBy(*keys).orderBy(F.col("magnitude").asc_nulls_last(), "source_id")
    shown = objects.where("in_frame").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_layer)
    left = objects.groupBy(*keys).agg(F.count(F.lit(1)).alias("returned_count"), F.count_if("in_frame").alias("in_frame_count"))
    right = shown.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("displayed_count"), F.max("magnitude").alias("faintest_magnitude"), F.avg("center_distance_arcmin").alias("mean_distance_arcmin")
    )
    return left.join(right, keys, "left").withColumn("displayed_count", F.coalesce("displayed_count", F.lit(0)))


def prediction_merge(existing: DataFrame, authoritative: DataFrame, key: str, filled: list[str]) -> DataFrame:
    """Authoritative rows replace existing rows of the same identity; their missing values come from the old row."""
    fields = [c for c in existing.columns if c != key]
    old = first_per_key(existing, [key], ["prediction_id"]).select(key, F.struct(*fields).alias("o"))
    new = first_per_key(authoritative, [key], ["prediction_id"]).select(key, F.struct(*fields).alias("a"))
    both = old.join(new, key, "full_outer")
    out = []
    for c in fields:
        pick = F.when(F.col("a").isNull(), F.col(f"o.{c}"))
        out.append((pick.otherwise(F.coalesce(f"a.{c}", f"o.{c}")) if c in filled else pick.otherwise(F.col(f"a.{c}"))).alias(c))
    source = F.when(F.col("a").isNull(), "existing").when(F.col("o").isNull(), "authoritative").otherwise("merged")
    return both.select(key, *out, source.alias("origin"))


def identity_keys(*texts: Column) -> Column:
    """Names and designations in one form: lower case, letters and digits only; empty ones are left out."""
    plain = F.transform(F.array(*texts), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(plain, lambda t: t.isNotNull() & (t != "")))


def merge_predictions(existing: DataFrame, authoritative: DataFrame, filled: list[str], names: list[str] | None = None) -> DataFrame:
    """One row per object of two prediction tables whose rows carry several names (``name``, ``designation``).

    Rows that share a name or designation, directly or through other rows, are one object: every row links to the first row
    of each of its keys, and components of these links are found in rounds, so a key shared by many rows costs one edge a
    row. The authoritative row (the least ``prediction_id``) wins; its missing values of ``filled`` come from the existing
    row. ``matched_rows`` counts the rows of the object; rows without any key stay apart.
    """
    names = names or ["name", "designation"]
    fields = existing.columns
    number = lambda df, side: df.select(*fields).withColumn("__side", F.lit(side)).withColumn("__row", F.concat_ws("/", F.lit(side), F.lpad(F.col("prediction_id").cast("string"), 19, "0")))
    rows = cut(number(existing, "b").unionByName(number(authoritative, "a")))
    keyed = rows.select("__row", F.explode(identity_keys(*[F.col(c) for c in names])).alias("__key"))
    firsts = keyed.groupBy("__key").agg(F.min("__row").alias("b"))
    comp = connected_components(rows, keyed.join(firsts, "__key").select(F.col("__row").alias("a"), "b"), "__row")
    best = rows.join(comp, "__row").groupBy("component").agg(
        *[F.min_by(F.when(F.col("__side") == s, F.struct(*fields)), F.when(F.col("__side") == s, F.col("__row"))).alias(s) for s in ("a", "b")],
        F.count(F.lit(1)).alias("matched_rows"),
    )
    out = []
    for c in fields:
        old = F.when(F.col("a").isNull(), F.col(f"b.{c}"))
        out.append((old.otherwise(F.coalesce(f"a.{c}", f"b.{c}")) if c in filled else old.otherwise(F.col(f"a.{c}"))).alias(c))
    origin = F.when(F.col("a").isNull(), "existing").when(F.col("b").isNull(), "authoritative").otherwise("merged")
    return best.select(*out, origin.alias("origin"), "matched_rows")


def cluster_members(stars: DataFrame, entries: DataFrame, matched: DataFrame, scale: float = 1.15) -> DataFrame:
    """Stars of each field inside the scaled visible radius of the entry matched to it, nearest first."""
    chosen = matched.select("field", "entry_id").join(entries.select("entry_id", F.col("ra_deg").alias("__era"), F.col("dec_deg").alias("__ede"), "visible_radius_deg"), "entry_id")
    sep = sky.separation_arcsec("ra_deg", "dec_deg", "__era", "__ede") / 3600.0
    rows = stars.select("field", "source_id", "ra_deg", "dec_deg").join(chosen, "field").withColumn("separation_deg", sep)
    return rows.where(F.col("separation_deg") <= F.col("visible_radius_deg") * scale).select("field", "entry_id", "source_id", "separation_deg")


def snapshot_entries(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each query's snapshot by their rank."""
    return found.select("query_id", "snapshot_id").join(entries, "snapshot_id")


def with_extras_first(extras: DataFrame, stars: DataFrame) -> DataFrame:
    """Extras and stars without repeats of a source: an extra (``is_extra``) stands before a star of the same id."""
    both = extras.withColumn("is_extra", F.lit(True)).unionByName(stars.withColumn("is_extra", F.lit(False)))
    return first_per_key(both.withColumn("__o", F.when(F.col("is_extra"), 0).otherwise(1)), ["source_id"], ["__o", "field"]).drop("__o")


def cluster_match(stars: DataFrame, entries: DataFrame, fields: DataFrame, scale: float = 1.15, margin_deg: float = 0.35, dense: int = 5) -> DataFrame:
    """Best cluster entry per field: 10 per star inside the scaled visible radius, 100 when in the footprint, minus separation."""
    largest = entries.agg(F.max("visible_radius_deg")).first()[0] or 0.0
    reach = largest * scale * 3600.0
    e = entries.select("entry_id", "ra_deg", "dec_deg", "visible_radius_deg")
    near = sky.within_radius(stars.select("field", "source_id", "ra_deg", "dec_deg"), e, reach).where(
        F.col("separation_arcsec") <= F.col("r_visible_radius_deg") * scale * 3600.0
    )
    counts = near.groupBy("field", F.col("r_entry_id").alias("entry_id")).agg(F.count(F.lit(1)).alias("star_count"))
    widest = fields.agg(F.max("radius_deg")).first()[0] or 0.0
    foot = sky.within_radius(fields, e, (max(0.1, widest) + largest + margin_deg) * 3600.0).where(
        F.col("separation_arcsec") <= (F.greatest(F.lit(0.1), F.col("radius_deg")) + F.col("r_visible_radius_deg") + margin_deg) * 3600.0
    )
    inside = foot.select("field", F.col("r_entry_id").alias("entry_id"), F.lit(True).alias("in_footprint"))
    both = counts.join(inside, ["field", "entry_id"], "full_outer")
    both = both.withColumn("star_count", F.coalesce("star_count", F.lit(0))).withColumn("in_footprint", F.coalesce("in_footprint", F.lit(False)))
    both = both.where(F.col("in_footprint") | (F.col("star_count") >= dense))
    at = both.join(fields.select("field", F.col("ra_deg").alias("__fr"), F.col("dec_deg").alias("__fd")), "field").join(e, "entry_id")
    sep = sky.separation_arcsec("__fr", "__fd", "ra_deg", "dec_deg") / 3600.0
    score = F.col("star_count") * 10.0 + F.when(F.col("in_footprint"), 100.0).otherwise(0.0) - sep
    return at.withColumn("score", score).groupBy("field").agg(
        F.max_by(F.struct("entry_id", "star_count", "in_footprint"), F.struct("score", "entry_id")).alias("b"), F.max("score").alias("score")
    ).select("field", "b.*", "score")
