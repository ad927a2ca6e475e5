"""Ensemble differential photometry over all frames and filters at once.

Input rows are measurements keyed by (file_path, filter_name, source_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import numeric as n
from skyloom.functions.groups import attach
from skyloom.functions.lineage import cut
from skyloom.functions.names import band_source_rank, photometric_band

FRAME = ["file_path", "filter_name"]
ROW = ["file_path", "filter_name", "source_id"]
PLACE = ["file_path", "filter_name", "ra_deg", "dec_deg"]

# Flag texts that make a measurement unusable, near-saturation limit, no-comparison flag.
HARD_FLAG_MARKERS = (
    "outside the usable image area",
    "non-positive background-subtracted flux",
    "no nearby reference stars with positive flux",
    "non-2d image",
    "saturated",
)
NEAR_SATURATION_FRACTION = 0.95
NO_COMPARISON_FLAG = "No nearby reference stars with positive flux."

SMALL_REFERENCE_SET = 64
#: References that a grid cell hands to a target as one list; a cell with more hands them over as rows.
LIST_LIMIT = 2048


def is_hard_flag(flag: Column) -> Column:
    return F.lower(flag).rlike("|".join(m.replace("-", r"\-") for m in HARD_FLAG_MARKERS))


def has_hard_flag(flags: Column) -> Column:
    return F.coalesce(F.exists(flags, is_hard_flag), F.lit(False))


def soft_flag_count(flags: Column) -> Column:
    return F.coalesce(F.size(F.filter(flags, lambda x: ~is_hard_flag(x))), F.lit(0))


def distinct_texts(values: Column) -> Column:
    """Trimmed, non-empty, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def near_saturated() -> Column:
    return ~F.col("is_saturated") & (
        n.ratio("peak_pixel_value", "saturation_threshold") >= NEAR_SATURATION_FRACTION
    )


def usable_value(df: DataFrame) -> Column:
    cond = F.col("flux") > 0
    for c in ("instrumental_magnitude", "differential_magnitude"):
        if c in df.columns:
            cond = cond | F.col(c).isNotNull()
    return F.coalesce(cond, F.lit(False))


def eligible_references(measurements: DataFrame) -> DataFrame:
    return measurements.where(
        F.col("is_reference")
        & (F.col("flux") > 0)
        & ~F.coalesce(F.col("is_saturated"), F.lit(False))
        & ~F.coalesce(near_saturated(), F.lit(False))
        & ~has_hard_flag(F.col("flags"))
    )


def science_targets(measurements: DataFrame) -> DataFrame:
    return measurements.where(~F.col("is_reference") & (F.col("flux") > 0))


def _reference_fields(refs: DataFrame) -> DataFrame:
    wanted = [
        "source_id", "source_name", "ra_deg", "dec_deg", "flux", "flux_error", "instrumental_magnitude", "catalog_magnitude",
        "band_mag", "band_error", "band_source",
    ]
    return refs.select(*[F.col(k).alias(f"__{k}") for k in FRAME], *[F.col(c).alias(f"ref_{c}") for c in wanted if c in refs.columns])


def _planar_d2() -> Column:
    dra, ddec = F.col("ref_ra_deg") - F.col("ra_deg"), F.col("ref_dec_deg") - F.col("dec_deg")
    return dra * dra + ddec * ddec


def _same_frame() -> Column:
    return (F.col("file_path") == F.col("__file_path")) & (F.col("filter_name") == F.col("__filter_name"))


def _row_keys(pairs: DataFrame, key: list[str]) -> list[str]:
    """Grouping key of the pairs; a leading hash makes sorting by it a comparison of numbers."""
    return ["row_hash", *key] if key in (ROW, PLACE) and "row_hash" in pairs.columns else key


def _nearest_of_few(carried: DataFrame, fields: DataFrame, k: int) -> DataFrame:
    columns = [c for c in fields.columns if c.startswith("ref_")]
    lists = fields.groupBy("__file_path", "__filter_name").agg(F.collect_list(F.struct(*columns)).alias("__refs"))  # at most SMALL_REFERENCE_SET each
    joined = carried.join(lists, _same_frame()).drop("__file_path", "__filter_name")

    def measured(r: Column, i: Column) -> Column:
        dra, ddec = r["ref_ra_deg"] - F.col("ra_deg"), r["ref_dec_deg"] - F.col("dec_deg")
        return F.struct((dra * dra + ddec * ddec).alias("d2"), r["ref_source_id"].alias("id"), i.alias("i"))

    near = F.slice(F.array_sort(F.transform("__refs", measured)), 1, k)
    chosen = F.transform(near, lambda t: F.struct(t["d2"].alias("d2"), F.get("__refs", t["i"]).alias("r")))
    out = joined.select(*carried.columns, F.posexplode(chosen).alias("__p", "__t"))
    return out.select(*carried.columns, *[F.col(f"__t.r.{c}").alias(c) for c in columns], F.col("__t.d2").alias("d2"), (F.col("__p") + 1).alias("rank"))


def _square(x: Column, y: Column) -> Column:
    dra, ddec = x - F.col("ra_deg"), y - F.col("dec_deg")
    return dra * dra + ddec * ddec


def _nearest_in_cells(asks: DataFrame, offers: DataFrame, cell: list[str], k: int, limit: int) -> DataFrame:
    """``near``: the k nearest (d2, id) of the references offered to the cell of each asking place, null when there are none.

    A place is one row before and after: a cell brings its references as one list. Cells with more than ``limit`` references
    are joined row by row instead.
    """
    crowded = cut(offers.groupBy(*cell).count().where(F.col("count") > limit).select(*cell))
    some = not crowded.isEmpty()
    light = offers.join(F.broadcast(crowded), cell, "left_anti") if some else offers
    lists = light.groupBy(*cell).agg(F.collect_list(F.struct("x", "y", "id")).alias("__list"))
    measured = F.transform("__list", lambda r: F.struct(_square(r["x"], r["y"]).alias("d2"), r["id"].alias("id")))
    few = asks.join(F.broadcast(crowded), cell, "left_anti") if some else asks
    out = few.join(lists, cell, "left").withColumn("near", F.slice(F.array_sort(measured), 1, k)).drop("__list")
    if not some:
        return out
    many = asks.join(F.broadcast(crowded), cell, "left_semi")
    pairs = many.select(*PLACE, *[c for c in cell if c not in PLACE]).join(offers, cell).select(*PLACE, _square(F.col("x"), F.col("y")).alias("d2"), "id")
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(*PLACE).orderBy("d2", "id"))).where(F.col("__r") <= k)
    chosen = ranked.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("near"))
    return out.unionByName(attach(many, chosen, PLACE))


def _nearest_by_grid(places: DataFrame, refs: DataFrame, k: int, limit: int) -> DataFrame:
    """``near`` of each place, from grids that hold about k references in a cell and coarsen for the places still open."""
    # of references at one place only the first k by identifier can ever be chosen
    order = Window.partitionBy(*PLACE).orderBy("source_id")
    distinct = refs.select(*PLACE, "source_id").withColumn("__p", F.row_number().over(order)).where(F.col("__p") <= k).drop("__p")
    span = F.greatest(F.max("ra_deg") - F.min("ra_deg"), F.max("dec_deg") - F.min("dec_deg"), F.lit(1e-9))
    distinct = cut(distinct)
    sizes = cut(
        distinct.groupBy(*FRAME).agg(
            F.greatest(F.lit(1.0), F.sqrt(F.count(F.lit(1)) / F.lit(float(k)))).alias("__base"),
            F.min("ra_deg").alias("__x0"), F.min("dec_deg").alias("__y0"), span.alias("__span"),
        )
    )
    gridded, open_rows = attach(distinct, sizes, FRAME, "inner"), cut(attach(places, sizes, FRAME, "inner"))
    most = sizes.agg(F.max("__base")).first()[0] or 1.0
    cell = [*FRAME, "__cx", "__cy"]

    def at(axis, start, own):
        raw = F.floor((F.col(axis) - F.col(start)) / (F.col("__span") / own))
        return F.least(own - 1, F.greatest(F.lit(0), raw))

    def around(axis, start, own):
        c = at(axis, start, own)
        return F.explode(F.sequence(F.greatest(c - 1, F.lit(0)), F.least(c + 1, own - 1)))

    def offered(scale):
        own = F.floor(F.greatest(F.lit(1.0), F.col("__base") * F.lit(scale)))
        copies = gridded.withColumn("__cx", around("ra_deg", "__x0", own)).withColumn("__cy", around("dec_deg", "__y0", own))
        return own, copies.select(*cell, F.col("ra_deg").alias("x"), F.col("dec_deg").alias("y"), F.col("source_id").alias("id"))

    # where references crowd together the first grid is finer, so that no cell there holds many
    scale = 1.0
    while most * scale < 1e6 and not offered(scale)[1].groupBy(*cell).count().where(F.col("count") > limit).isEmpty():
        scale *= 4.0
    done = None
    while True:
        own, offers = offered(scale)
        asks = open_rows.withColumn("__own", own).withColumn("__cx", at("ra_deg", "__x0", own)).withColumn("__cy", at("dec_deg", "__y0", own))
        found = _nearest_in_cells(asks, offers, cell, k, limit)
        last = most * scale < 2.0
        step = F.col("__span") / F.col("__own")
        # a reference outside the block is farther than one cell
        enough = (F.size("near") >= k) & (F.element_at("near", -1)["d2"] <= step * step * F.lit(1.0 - 1e-9))
        closed = F.lit(True) if last else (F.col("__own") == 1) | F.coalesce(enough, F.lit(False))
        found = cut(found.withColumn("__closed", closed))
        closed_rows = found.where("__closed").select(*places.columns, "near")
        done = closed_rows if done is None else done.unionByName(closed_rows)
        open_rows = found.where(~F.col("__closed")).select(*open_rows.columns)
        if last or open_rows.isEmpty():
            return done
        scale /= 4.0


def nearest_by_place(targets: DataFrame, refs: DataFrame, k: int = 5, small: int | None = None, limit: int | None = None) -> DataFrame:
    """The k nearest references (planar degrees) in the same frame and filter of each place (``PLACE``) that holds targets.

    Targets at one place share their references, so each place is searched once. Frames with few references bring them as
    one short list to each place, which picks its k from it: no pair becomes a row before it is chosen. A frame with more
    references is gridded so that a cell holds about k of them, and a cell hands the references of its 3x3 block on as one
    list. A place is finished when its k-th distance fits in the block; the rest try a grid four times coarser, and so on
    up to one cell, which is exact. Fields of the references are attached to the chosen ones only. Rows without a position
    have no nearest reference.
    """
    small = SMALL_REFERENCE_SET if small is None else small
    located = F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()
    targets, refs = targets.where(located), refs.where(located)
    fields = _reference_fields(refs)
    places = targets.select(*PLACE).distinct().withColumn("row_hash", F.xxhash64(*PLACE))
    largest = refs.groupBy(*FRAME).count().agg(F.max("count")).first()[0] or 0
    if largest <= small:
        return _nearest_of_few(places, fields, k)
    near = _nearest_by_grid(places, refs, k, LIST_LIMIT if limit is None else limit)
    chosen = near.select(*places.columns, F.posexplode("near").alias("rank", "__n"))
    chosen = chosen.select(*places.columns, F.col("__n.id").alias("__id"), F.col("__n.d2").alias("d2"), (F.col("rank") + 1).alias("rank"))
    pairs = chosen.join(fields, _same_frame() & (F.col("__id") == F.col("ref_source_id")))
    return pairs.drop("__id", "__file_path", "__filter_name")


def _of_rows(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of places as pairs of the target rows there."""
    rows = targets.select(*dict.fromkeys([*ROW, "ra_deg", "dec_deg"]), F.xxhash64(*ROW).alias("row_hash"))
    return attach(rows, pairs.drop("row_hash"), PLACE, "inner")


def nearest_references(targets: DataFrame, refs: DataFrame, k: int = 5, small: int | None = None, limit: int | None = None) -> DataFrame:
    """The k nearest references of each target row, as ``nearest_by_place`` finds them."""
    return _of_rows(targets, nearest_by_place(targets, refs, k, small, limit))


def _listed(measurements: DataFrame) -> Column:
    if "comparison_source_ids" not in measurements.columns:
        return F.lit(False)
    return F.coalesce(F.size("comparison_source_ids") > 0, F.lit(False))


def explicit_pairs(listed: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs of the rows that name their comparisons, in the order named."""
    return (
        listed
        .select(*ROW, "ra_deg", "dec_deg", F.xxhash64(*ROW).alias("row_hash"), F.posexplode("comparison_source_ids").alias("rank", "__id"))
        .groupBy(*ROW, "ra_deg", "dec_deg", "row_hash", "__id")
        .agg((F.min("rank") + 1).alias("rank"))
        .join(_reference_fields(refs), _same_frame() & (F.col("__id") == F.col("ref_source_id")))
        .withColumn("d2", _planar_d2())
        .drop("__id", "__file_path", "__filter_name")
    )


def comparison_pairs(measurements: DataFrame, k: int = 5, automatic: bool = True) -> DataFrame:
    """Chosen comparisons of every science row: an explicit id list sets members and order, else the k nearest."""
    targets, refs = science_targets(measurements), eligible_references(measurements)
    if "comparison_source_ids" not in measurements.columns:
        return nearest_references(targets, refs, k)
    explicit = explicit_pairs(targets.where(_listed(measurements)), refs)
    if not automatic:
        return explicit
    return nearest_references(targets.where(~_listed(measurements)), refs, k).unionByName(explicit)


def with_comparisons(
    measurements: DataFrame, summary, k: int = 5, automatic: bool = True, how: str = "left", columns: list[str] | None = None
) -> DataFrame:
    """Science rows (or some of their columns) with what ``summary(pairs, key)`` says of their comparison sets.

    A set of nearest references is summed up once for the place it belongs to, an explicit set once for its row.
    """
    targets, refs = science_targets(measurements), eligible_references(measurements)
    listed = _listed(measurements)
    wanted = [c for c in targets.columns if c != "comparison_source_ids"] if columns is None else columns

    def joined(rows: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
        return attach(rows.select(*dict.fromkeys([*wanted, *ROW, *key])), summary(pairs, key), key, how)

    parts = []
    if "comparison_source_ids" in measurements.columns:
        chosen = targets.where(listed) if automatic else targets
        parts.append(joined(chosen, explicit_pairs(targets.where(listed), refs), ROW))
    if automatic or not parts:
        free = targets.where(~listed)
        parts.append(joined(free, nearest_by_place(free, refs, k), PLACE))
    out = parts[0] if len(parts) == 1 else parts[1].select(*parts[0].columns).unionByName(parts[0])
    return out if columns is None else out.select(*columns, *[c for c in out.columns if c not in (*columns, *ROW, *PLACE)])


def _ensemble_aggs() -> tuple[list[Column], list[Column]]:
    f, e = F.col("ref_flux"), F.col("ref_flux_error")
    w = F.when(e > 0, F.lit(1.0) / (e * e))
    dev = f - F.col("__c")
    aggs = [
        F.count(F.lit(1)).alias("comparison_count"),
        F.count(w).alias("__enw"),
        F.sum(w).alias("__esw"),
        F.max("__c").alias("__center"),
        (F.sum(F.when(e > 0, dev * dev / (e * e))) / F.sum(w)).alias("__wvar"),
        F.median("ref_flux").alias("__med"),
        F.var_pop("ref_flux").alias("__var"),
        F.sum(e * e).alias("__see"),
        F.count("ref_flux_error").alias("__ene"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref_source_id"))), lambda s: s["ref_source_id"]).alias(
            "comparison_source_ids"
        ),
    ]
    weighted = F.col("__enw") > 0
    finish = [
        F.col("comparison_count"),
        F.col("comparison_source_ids"),
        F.when(weighted, F.col("__center")).otherwise(F.col("__med")).alias("comparison_reference_flux"),
        F.when(weighted, F.sqrt(F.lit(1.0) / F.col("__esw")))
        .when(F.col("__ene") > 0, F.sqrt("__see") / F.col("__ene"))
        .alias("comparison_reference_flux_error"),
        F.when(weighted & (F.col("__enw") >= 2), n.safe_sqrt("__wvar") / F.col("__center"))
        .when(~weighted & (F.col("comparison_count") >= 2), n.safe_sqrt("__var") / F.col("__med"))
        .alias("comparison_scatter"),
    ]
    return aggs, finish


def _with_center(pairs: DataFrame, key: list[str]) -> DataFrame:
    e = F.col("ref_flux_error")
    w = F.when(e > 0, F.lit(1.0) / (e * e))
    span = Window.partitionBy(*_row_keys(pairs, key))
    # divided in one step, as in SQL, so that sets of equal members tie alike
    return pairs.withColumn("__c", F.sum(F.when(e > 0, F.col("ref_flux") / (e * e))).over(span) / F.sum(w).over(span))


def ensemble(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Reference flux, its error and the fractional scatter of each comparison set.

    Inverse-variance mean over members that have a positive sigma; with none, the median flux of all members.
    A set holds at most k members, so the per-set median and list stay small.
    """
    key = key or ROW
    aggs, finish = _ensemble_aggs()
    return _with_center(pairs, key).groupBy(*_row_keys(pairs, key)).agg(*aggs).select(*key, *finish)


def _zero_point_aggs(zp: Column, err: Column, prefix: str) -> tuple[list[Column], list[Column]]:
    """Weighted mean when every member has a finite positive error, else plain mean and standard error."""
    z = F.when(n.finite(zp), zp)
    e = F.when(z.isNotNull() & n.finite(err) & (err > 0), err)
    w = F.lit(1.0) / (e * e)
    names = {k: f"__{prefix}{k}" for k in ("n", "ne", "sw", "swz", "mean", "sd")}
    aggs = [
        F.count(z).alias(names["n"]),
        F.count(e).alias(names["ne"]),
        F.sum(w).alias(names["sw"]),
        F.sum(w * z).alias(names["swz"]),
        F.avg(z).alias(names["mean"]),
        F.stddev_samp(z).alias(names["sd"]),
    ]
    c = {k: F.col(v) for k, v in names.items()}
    every = (c["n"] == c["ne"]) & (c["n"] > 0)
    finish = [
        F.when(every, c["swz"] / c["sw"]).otherwise(c["mean"]).alias(f"{prefix}zero_point_magnitude"),
        F.when(every, F.sqrt(F.lit(1.0) / c["sw"]))
        .when(c["n"] > 1, c["sd"] / F.sqrt(c["n"].cast("double")))
        .alias(f"{prefix}zero_point_magnitude_error"),
        c["n"].alias(f"{prefix}zero_point_source_count"),
    ]
    return aggs, finish


def _catalog_zero_point_aggs():
    return _zero_point_aggs(
        F.col("ref_catalog_magnitude") - F.col("ref_instrumental_magnitude"), n.mag_error("ref_flux", "ref_flux_error"), ""
    )


def zero_points(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or ROW
    aggs, finish = _catalog_zero_point_aggs()
    return pairs.groupBy(*_row_keys(pairs, key)).agg(*aggs).select(*key, *finish).where(F.col("zero_point_source_count") > 0)


def _with_band_source(pairs: DataFrame, key: list[str]) -> DataFrame:
    has = n.finite("ref_band_mag")
    mag = F.when(has, F.col("ref_band_mag")).otherwise(F.col("ref_catalog_magnitude"))
    ok = n.finite(mag - F.col("ref_instrumental_magnitude"))
    source = F.when(has, F.coalesce("ref_band_source", F.lit("unknown"))).otherwise(F.lit("gaia-g"))
    rows = pairs.withColumn("__bmag", mag).withColumn("__src", F.when(ok, source))
    return rows.withColumn("__uses", F.count("__src").over(Window.partitionBy(*_row_keys(pairs, key), "__src")))


def _standard_aggs():
    has = n.finite("ref_band_mag")
    cat_err = F.when(has & (F.col("ref_band_error") > 0), F.col("ref_band_error"))
    inst = n.mag_error("ref_flux", "ref_flux_error")
    inst = F.when(inst > 0, inst)
    err = F.when(cat_err.isNotNull() & inst.isNotNull(), n.quadrature(cat_err, inst)).otherwise(F.coalesce(cat_err, inst))
    aggs, finish = _zero_point_aggs(F.col("__bmag") - F.col("ref_instrumental_magnitude"), err, "standard_")
    order = F.when(F.col("__src").isNotNull(), F.struct(F.col("__uses"), band_source_rank(F.col("__src")), F.col("__src")))
    aggs.append(F.max_by("__src", order).alias("standard_catalog_source"))
    return aggs, [*finish, F.col("standard_catalog_source")]


def standard_zero_points(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Zero point against the standard band, with the dominant catalog source.

    ``ref_band_mag`` is the entry of the target's band (null falls back to the catalog magnitude as source gaia-g).
    Equally frequent sources are settled by source rank, then name.
    """
    key = key or ROW
    aggs, finish = _standard_aggs()
    rows = _with_band_source(pairs, key).groupBy(*_row_keys(pairs, key)).agg(*aggs).select(*key, *finish)
    return rows.where(F.col("standard_zero_point_source_count") > 0)


def comparison_summary(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Ensemble flux, zero point and standard zero point of every comparison set in one aggregation."""
    key = key or ROW
    parts = [_ensemble_aggs(), _catalog_zero_point_aggs(), _standard_aggs()]
    rows = _with_band_source(_with_center(pairs, key), key)
    aggs = [a for p in parts for a in p[0]]
    return rows.groupBy(*_row_keys(pairs, key)).agg(*aggs).select(*key, *[c for p in parts for c in p[1]])


def differential_photometry(measurements: DataFrame, k: int = 5, automatic: bool = True) -> DataFrame:
    """Differential, calibrated and standard magnitudes of every science row.

    Rows without a usable comparison stay and carry a hard flag. Sets of nearest references are summed up by place, so
    that no pair of a target row and a reference is ever a row.
    """
    targets = science_targets(measurements)
    out = with_comparisons(measurements, comparison_summary, k, automatic)
    own = n.mag_error("flux", "flux_error")
    zp, zpe = F.col("zero_point_magnitude"), F.col("zero_point_magnitude_error")
    szp, szpe = F.col("standard_zero_point_magnitude"), F.col("standard_zero_point_magnitude_error")
    incoming = F.col("differential_magnitude_error") if "differential_magnitude_error" in targets.columns else F.lit(None).cast("double")
    out = out.withColumn("__incoming", incoming)
    return (
        out.withColumn("differential_magnitude", n.differential_magnitude("flux", "comparison_reference_flux"))
        .withColumn(
            "differential_magnitude_error",
            n.differential_magnitude_error("flux", "flux_error", "comparison_reference_flux", "comparison_reference_flux_error"),
        )
        .withColumn("calibrated_magnitude", F.col("instrumental_magnitude") + zp)
        .withColumn(
            "calibrated_magnitude_error",
            F.when(F.col("calibrated_magnitude").isNull(), F.lit(None))
            .when(own.isNotNull() & zpe.isNotNull(), n.combined_mag_error(own, zpe))
            .when(F.col("zero_point_source_count") == 1, F.col("__incoming")),
        )
        .withColumn("standard_magnitude", F.col("instrumental_magnitude") + szp)
        .withColumn(
            "standard_magnitude_error",
            F.when(F.col("standard_magnitude").isNull(), F.lit(None))
            .when(own.isNotNull() & szpe.isNotNull(), n.quadrature(own, szpe))
            .otherwise(own),
        )
        .withColumn("standard_catalog_band", photometric_band(F.col("filter_name")))
        .withColumn("zero_point_source_count", F.coalesce("zero_point_source_count", F.lit(0)))
        .withColumn("standard_zero_point_source_count", F.coalesce("standard_zero_point_source_count", F.lit(0)))
        .withColumn(
            "flags",
            distinct_texts(
                F.when(F.col("comparison_count").isNull(), F.array_append("flags", F.lit(NO_COMPARISON_FLAG))).otherwise(F.col("flags"))
            ),
        )
        .withColumn("comparison_source_ids", F.coalesce("comparison_source_ids", F.array().cast("array<string>")))
        .drop("__incoming")
    )
