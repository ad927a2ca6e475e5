"""Text rules: designations, photometric bands, filters, filenames, timestamps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.numeric import let

# Prefixes of survey designations other than the four large variable-star surveys.
OTHER_DESIGNATION_PREFIXES = (
    "2mass", "wise", "tic", "toi", "kic", "tess", "sdss", "ucac", "usno", "ps1", "panstarrs", "pan-starrs", "gsc", "tyc",
    "css", "nsvs",
)

# Normalised filter text -> standard photometric band.
FILTER_BANDS = {
    "u": "U", "johnsonu": "U", "johnson_u": "U", "b": "B", "johnsonb": "B", "johnson_b": "B", "tb": "B", "v": "V", "johnsonv": "V",
    "johnson_v": "V", "tg": "V", "cv": "V", "clear": "V", "unfiltered": "V", "l": "V", "lum": "V", "luminance": "V", "r": "R",
    "rc": "R", "r_c": "R", "cousinsr": "R", "cousins_r": "R", "tr": "R", "cr": "R", "i": "I", "ic": "I", "i_c": "I",
    "cousinsi": "I", "cousins_i": "I", "su": "SU", "sloanu": "SU", "sloan_u": "SU", "sg": "SG", "sloang": "SG", "sloan_g": "SG",
    "g": "SG", "gp": "SG", "g_prime": "SG", "sr": "SR", "sloanr": "SR", "sloan_r": "SR", "rp": "SR", "r_prime": "SR", "si": "SI",
    "sloani": "SI", "sloan_i": "SI", "ip": "SI", "i_prime": "SI", "sz": "SZ", "sloanz": "SZ", "sloan_z": "SZ", "z": "SZ",
    "zp": "SZ", "z_prime": "SZ",
}

# Catalog source -> rank when the same band comes from several sources.
BAND_SOURCE_RANK = {"vsp": 3, "apass": 2, "gaia-g": 1}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def designation_family(name: Column) -> Column:
    """gaia / asassn / atlas / ztf / other / named from the designation prefix."""
    text = F.trim(F.regexp_replace(F.lower(name), r"[\s_]+", " "))
    other = text.startswith("[")
    for prefix in OTHER_DESIGNATION_PREFIXES:
        other = other | text.startswith(prefix)
    return (
        F.when(text.startswith("gaia"), "gaia")
        .when(text.startswith("asassn") | text.startswith("asas-sn"), "asassn")
        .when(text.startswith("atlas"), "atlas")
        .when(text.startswith("ztf"), "ztf")
        .when(other, "other")
        .otherwise("named")
    )


def photometric_band(filter_name: Column) -> Column:
    lookup = literal_map(FILTER_BANDS)
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(filter_name)), "[ '′]", ""), "-", "_")
    return F.coalesce(F.try_element_at(lookup, text), F.try_element_at(lookup, F.regexp_replace(text, "_", "")))


def band_source_rank(source: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(BAND_SOURCE_RANK), source), F.lit(0))


# Archive filter aliases.
DECK_FILTER_ALIASES = {
    "l": "L", "lum": "L", "luminance": "L", "clear": "L", "r": "R", "red": "R", "g": "G", "green": "G", "b": "B", "blue": "B",
    "ha": "Ha", "h-alpha": "Ha", "halpha": "Ha", "hα": "Ha", "sii": "SII", "s2": "SII", "oiii": "OIII", "o3": "OIII", "osc": "OSC",
    "rgb": "RGB", "lrgb": "LRGB",
}

# Fixed value: type_object_exposure_binning_filter_date-time_sequence in a file stem.
FILENAME_PATTERN = r"(?i)([A-Za-z]+)_(.+?)_(\d+(?:\.\d+)?)s_(Bin\d+)_([^_]+)_(\d{8})-(\d{6})_(\d+)"

# Header keys that hold an exposure and their scale to seconds.
EXPOSURE_KEYS = (("EXPTIME", 1.0), ("EXPOSURE", 1.0), ("EXPOSURE_TIME", 1.0), ("EXPOSUREMS", 0.001))

# Accepted light and rejected calibration frame types.
LIGHT_TYPES = ("light", "light frame", "lightframe", "science", "object")
CALIBRATION_TYPES = (
    "bias", "dark", "flat", "darkflat", "flatfield", "flat field", "offset", "bias frame", "dark frame", "flat frame",
)

# Folder names and stem tokens that tell the processing stage.
CALIBRATED_DIRS = ("calibrated", "calibrated_lights", "cfa", "debayered")
REGISTERED_DIRS = ("registered", "aligned", "alignment", "drizzle", "registered_lights")
NORMALIZED_DIRS = ("normalized", "normalization", "lnorm", "nml", "xnml", "lnml")
INTEGRATION_DIRS = (
    "integration", "integrations", "stack", "stacked", "stacks", "masterlights", "master_lights", "mosaic", "mosaics",
)
MASTER_DIRS = ("master", "masters")
CALIBRATION_DIRS = (
    "bias", "biases", "dark", "darks", "darkflat", "darkflats", "flat", "flats", "flatdarks", "offset", "offsets",
    "calibration", "calib",
)
PROCESSED_DIRS = ("processed", "output", "outputs", "export", "exports", "final", "jpeg", "jpg", "preview")
INTEGRATION_STEMS = ("integrated", "integration", "_stack", "stack_", "stacked", "_mosaic", "masterlight", "master_light")
NORMALIZED_STEMS = ("_nml", "lnml", "xnml", "lnorm", "normalized")
MASTER_STEMS = ("masterdark", "masterflat", "masterbias", "master_dark", "master_flat", "master_bias")


def deck_filter_alias(value: Column) -> Column:
    """Known alias, else the trimmed text, null when empty."""
    lookup = literal_map(DECK_FILTER_ALIASES)
    text = F.trim(value)
    return F.when(text != "", F.coalesce(F.try_element_at(lookup, F.lower(text)), text))


def path_dirs(path: Column) -> Column:
    """Folder names of a path, lower case, outermost first."""
    return F.filter(F.split(F.lower(F.regexp_replace(path, r"/[^/]*$", "")), "/"), lambda x: x != "")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def below_root(path: Column, root: Column) -> Column:
    """The part of a path under its root folder."""
    return F.substring(path, F.length(root) + 1, F.length(path))


def deck_filter(header_filter: Column, path: Column, root: Column, fields: Column | None = None, dirs: Column | None = None) -> Column:
    """Filter from the header, else the file name, else the innermost folder below the root that names one.

    ``fields`` and ``dirs`` take the already parsed file name and the folders below the root.
    """
    lookup = literal_map(DECK_FILTER_ALIASES)
    dirs = path_dirs(below_root(path, root)) if dirs is None else dirs
    named = filename_field(path, 5) if fields is None else field_of(fields, 5)
    hits = F.filter(F.transform(F.reverse(dirs), lambda p: F.try_element_at(lookup, p)), lambda x: x.isNotNull())
    return F.coalesce(deck_filter_alias(header_filter), deck_filter_alias(named), F.try_element_at(hits, F.lit(1)))


def filename_fields(path: Column) -> Column:
    """The eight parts of a file name from one pattern match (an array of one element when it does not parse)."""
    order = "\u0001".join(f"${i}" for i in range(1, 9))
    return F.split(F.regexp_replace(path_stem(path), f"^.*?{FILENAME_PATTERN}.*$", order), "\u0001")


def field_of(fields: Column, group: int) -> Column:
    """1 type, 2 object, 3 exposure, 4 binning, 5 filter, 6 date, 7 time, 8 sequence; null when the name does not parse."""
    return F.when(F.size(fields) == 8, fields[group - 1])


def filename_field(path: Column, group: int) -> Column:
    return let(filename_fields(path), lambda f: field_of(f, group))



def header_exposure(header: Column) -> Column:
    """First usable exposure of the known keys: a number, or the leading number of a text, above zero."""
    tries = []
    for key, scale in EXPOSURE_KEYS:
        raw = F.try_element_at(header, F.lit(key))
        number = F.coalesce(
            raw.try_cast("double"), F.regexp_extract(raw, r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", 0).try_cast("double")
        )
        scaled = number * F.lit(scale)
        tries.append(F.when((scaled > 0) & ~F.isnan(scaled), scaled))
    return F.coalesce(*tries)


def has_explicit_zone(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def observation_timestamp(text: Column) -> Column:
    """Timestamp of the accepted layouts; fractions are cut to microseconds and a missing zone means UTC."""
    t = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    zoned = F.regexp_replace(F.regexp_replace(t, "(?i)Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    plain = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?$"
    offset = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?[+-]\d{2}:\d{2}$"
    return F.when(t.rlike(plain), F.concat(t, F.when(t.rlike("[T ]"), F.lit("+00:00")).otherwise(F.lit(" 00:00:00+00:00"))).try_cast("timestamp")).when(
        zoned.rlike(offset), zoned.try_cast("timestamp")
    )


def _type_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[\s_]+", " "))


def is_light_type(frame_type: Column) -> Column:
    t = _type_text(frame_type)
    return F.coalesce(t.isin(*LIGHT_TYPES) | t.startswith("light"), F.lit(False))


def is_calibration_type(frame_type: Column) -> Column:
    t = _type_text(frame_type)
    return F.coalesce(
        t.isin(*CALIBRATION_TYPES) | t.startswith("bias") | t.startswith("dark") | t.startswith("flat"), F.lit(False)
    )


def image_kind(path: Column, root: Column, image_type: Column, master_type: Column) -> Column:
    """Processing stage of an image from master type, folders below the root, stem tokens and image type."""
    parts = F.struct(
        path_dirs(below_root(path, root)).alias("dirs"),
        F.lower(path_stem(path)).alias("stem"),
        F.coalesce(_type_text(master_type), F.lit("")).alias("mast"),
        is_light_type(image_type).alias("light"),
        is_calibration_type(image_type).alias("calib"),
    )
    return let(parts, _kind_of)


def _kind_of(row: Column) -> Column:
    dirs, stem, mast, light, calib = (row[c] for c in ("dirs", "stem", "mast", "light", "calib"))

    def folder(names):
        return F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in names]))

    def token(tokens):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | stem.contains(t)
        return hit

    master_calibration = mast.startswith("bias") | mast.startswith("dark") | mast.startswith("flat") | mast.startswith("offset")
    return (
        F.when(mast.isin("masterlight", "master light") | mast.startswith("light"), "integration")
        .when(master_calibration, "master_calibration")
        .when(folder(NORMALIZED_DIRS) | token(NORMALIZED_STEMS), "normalized_light")
        .when(folder(INTEGRATION_DIRS) | token(INTEGRATION_STEMS), "integration")
        .when(folder(REGISTERED_DIRS), "registered_light")
        .when(folder(CALIBRATED_DIRS), "calibrated_light")
        .when(folder(MASTER_DIRS) & (stem.contains("light") | light), "integration")
        .when(folder(MASTER_DIRS) | token(MASTER_STEMS), "master_calibration")
        .when(stem.startswith("master") & stem.contains("light"), "integration")
        .when(stem.startswith("master"), "master_calibration")
        .when(folder(CALIBRATION_DIRS) | calib, "calibration_frame")
        .when(folder(PROCESSED_DIRS), "other")
        .otherwise("light_subframe")
    )
