"""Scalar rules of the catalog as Column expressions, so that they stay inside code generation and can be pushed down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycatalog.functions import rules
from skycatalog.functions.timestamps import offset_minutes


def _null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extension_of(name: Column) -> Column:
    """Text after the last dot in lower case; NULL without a dot and for dot-files."""
    return _null_if_blank(F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)))


def posix_relative(root: Column, full: Column) -> Column:
    """Path below `root` with forward slashes (S3)."""
    return F.ltrim(F.replace(F.substring(full, F.length(root) + 1, F.length(full)), F.lit("\\"), F.lit("/")), F.lit("/"))


def format_of(extension: Column) -> Column:
    """'fits', 'xisf', 'raw' or NULL."""
    e = F.lower(extension)
    return F.when(e.isin(rules.FITS_EXTENSIONS), "fits").when(e.isin(rules.XISF_EXTENSIONS), "xisf").when(e.isin(rules.RAW_EXTENSIONS), "raw")


def is_supported_extension(extension: Column) -> Column:
    """Case-sensitive membership of the allow-list."""
    return extension.isin(rules.EXTENSIONS)


def walks_into(path: Column, skip_names: list[str]) -> Column:
    """False if any segment is hidden, `node_modules` or one of `skip_names` regardless of case."""
    skipped = ["node_modules", *[s.lower() for s in skip_names]]
    return ~F.exists(F.split(path, r"[\\/]"), lambda s: (s.startswith(".") & (F.length(s) > 0)) | F.lower(s).isin(skipped))


def normalize_image_type(raw: Column) -> Column:
    """Trim, strip one pair of quotes, unify separators, upper case; NULL if nothing is left."""
    trim = lambda c: F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")
    t = trim(raw)
    t = F.when((F.length(t) >= 2) & t.startswith("'") & t.endswith("'"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return _null_if_blank(F.upper(F.regexp_replace(F.regexp_replace(trim(t), "[_-]", " "), r"(?U)\s+", " ")))


def match_image_type(raw: Column) -> Column:
    """Frame type of a header's image type, NULL if it is none of the known spellings."""
    table = F.create_map(*[F.lit(x) for kv in rules.IMAGE_TYPES.items() for x in kv])
    return F.try_element_at(table, normalize_image_type(raw))


def match_path(path: Column) -> Column:
    """Frame type told by the deepest path segment that holds one of the type words."""
    segments = F.reverse(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"))
    a, b = rules.PATH_EDGE
    kind = lambda s: reduce(lambda acc, r: acc.when(s.rlike(a + r[0] + b), r[1]), rules.PATH_WORDS[1:], F.when(s.rlike(a + rules.PATH_WORDS[0][0] + b), rules.PATH_WORDS[0][1]))
    return F.try_element_at(F.array_compact(F.transform(segments, kind)), F.lit(1))


def classify(image_type: Column, path: Column) -> tuple[Column, Column]:
    """(frame_type, frame_type_source): header before path, else unknown by path heuristic (C4)."""
    header, by_path = match_image_type(image_type), match_path(path)
    return F.coalesce(header, by_path, F.lit("unknown")), F.when(header.isNotNull(), "header").otherwise("path_heuristic")


def detect_profile(header: dict[str, Column] | object) -> Column:
    """First capture profile whose header text fits; `header(keyword)` gives a string column."""
    out = None
    for name, keyword, how, text in rules.PROFILES:
        v = header(keyword)
        hit = v.startswith(text) if how == "prefix" else v.contains(text)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def parse_sexagesimal(text: Column) -> Column:
    """'dd mm ss.s' or 'dd:mm:ss.s' with sign as a number, NULL if malformed; the sign of -00 counts."""
    pattern = r"^\s*([+-]?)(\d{1,3})[ :](\d{1,2})[ :](\d{1,2}(?:\.\d*)?)\s*$"
    g = lambda i: F.regexp_extract(text, pattern, i)
    d, m, s = g(2).try_cast("double"), g(3).try_cast("double"), g(4).try_cast("double")
    return F.when(text.rlike(pattern) & (m < 60) & (s < 60), F.when(g(1) == "-", -1.0).otherwise(1.0) * (d + m / 60 + s / 3600))


def ra_degrees(number: Column, text: Column) -> Column:
    """Right ascension: the number, else sexagesimal hours times 15."""
    return F.coalesce(number, parse_sexagesimal(text) * 15)


def dec_degrees(number: Column, text: Column) -> Column:
    return F.coalesce(number, parse_sexagesimal(text))


def exif_date_obs(date_time: Column, offset: Column) -> Column:
    """ISO text of an EXIF time: UTC with Z where an offset is given, else local without; NULL if malformed."""
    pattern = r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}):(\d{2}):(\d{2})$"
    local = F.try_to_timestamp(F.when(date_time.rlike(pattern), date_time), F.lit("yyyy:MM:dd HH:mm:ss"))
    shift = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), offset_minutes(offset))
    utc = F.timestamp_seconds(F.unix_seconds(local) - shift * 60)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return F.when(shift.isNotNull(), F.concat(F.date_format(utc, iso), F.lit("Z"))).otherwise(F.date_format(local, iso))


def camera_name(make: Column, model: Column) -> Column:
    """Make and model, the make left out where the model already has its first word (P5)."""
    mk, md = _null_if_blank(F.trim(make)), _null_if_blank(F.trim(model))
    brand = F.lower(F.split(mk, r"\s+")[0])
    return F.when(mk.isNull(), md).when(md.isNull(), mk).when(F.contains(F.lower(md), brand), md).otherwise(F.concat_ws(" ", mk, md))


def skip_patterns(text: Column) -> Column:
    """Strings of a JSON array; NULL if the text is no JSON array (P10)."""
    v = F.try_parse_json(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def progress_label(status: Column, current: Column, total: Column) -> Column:
    """'status: NN%', or 'status: working' without a total."""
    share = F.round(100 * current / total).cast("int")
    return F.concat(status, F.lit(": "), F.when(total > 0, F.concat(share.cast("string"), F.lit("%"))).otherwise("working"))


def integration_label(seconds: Column) -> Column:
    """Seconds as 'HHh MMm' (P13)."""
    minutes = F.floor(seconds / 60).cast("bigint")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat(two(F.floor(minutes / 60).cast("bigint")), F.lit("h "), two(minutes % 60), F.lit("m"))


def is_uuid(c: Column) -> Column:
    return c.rlike(rules.UUID)


def astro_day(ts: Column, zone: str = "UTC") -> Column:
    """Date of the night: local time minus twelve hours."""
    return F.to_date(F.from_utc_timestamp(ts, zone) - F.expr("INTERVAL 12 HOURS"))


def canonical_filter(raw: Column) -> tuple[Column, Column]:
    """(canonical name, band) of a filter; an unknown one is its own group (C20)."""
    t = F.trim(raw)
    key = F.lower(t)
    name, band = F.when(t.isNull() | (t == ""), "None"), F.when(t.isNull() | (t == ""), "none")
    for canonical, (kind, spellings) in rules.FILTERS.items():
        name, band = name.when(key.isin(spellings), canonical), band.when(key.isin(spellings), kind)
    return name.otherwise(t), band


def catalog_name(raw: Column, prefixes: list[str] | None = None) -> Column:
    """'PREFIX NUMBER' if the name is a catalog designation, else the name in upper case with single blanks."""
    p = "|".join(prefixes or rules.CATALOG_PREFIXES)
    t = F.trim(F.regexp_replace(F.upper(raw), r"[\s_.-]+", " "))
    pattern = rf"^({p}) ?0*([0-9]+)\b.*$"
    return F.when(t.rlike(pattern), F.concat(F.regexp_extract(t, pattern, 1), F.lit(" "), F.regexp_extract(t, pattern, 2))).otherwise(t)


def mosaic_panel(raw: Column) -> Column:
    """Panel number in an object name, NULL if none."""
    return F.regexp_extract(F.lower(raw), r"(?:panel[ _-]*|_p)([0-9]+)", 1).try_cast("int")


def separation_degrees(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def _days_since_2000(ts: Column) -> Column:
    return F.unix_micros(ts) / 86_400_000_000.0 - 10957.5


def hours_to_transit(ts: Column, ra: Column, longitude: float) -> Column:
    """Hours until a position next crosses the meridian of a place."""
    sidereal = F.pmod(F.lit(280.46061837) + 360.98564736629 * _days_since_2000(ts) + F.lit(longitude), F.lit(360.0))
    return F.pmod(ra - sidereal, F.lit(360.0)) / 15.04106864


def moon_position(ts: Column) -> tuple[Column, Column]:
    """(right ascension, declination) of the moon in degrees by the mean orbit and its largest terms, good to about a degree."""
    d = _days_since_2000(ts)
    lon = F.radians(218.316 + 13.176396 * d + 6.289 * F.sin(F.radians(134.963 + 13.064993 * d)))
    lat, tilt = F.radians(5.128 * F.sin(F.radians(93.272 + 13.229350 * d))), F.radians(F.lit(23.439))
    ra = F.pmod(F.degrees(F.atan2(F.sin(lon) * F.cos(tilt) - F.tan(lat) * F.sin(tilt), F.cos(lon))), F.lit(360.0))
    return ra, F.degrees(F.asin(F.sin(lat) * F.cos(tilt) + F.cos(lat) * F.sin(tilt) * F.sin(lon)))


def altitude_degrees(ts: Column, ra: Column, dec: Column, latitude: float, longitude: float) -> Column:
    """Altitude of a position above the horizon of a place."""
    days = F.unix_micros(ts) / 86_400_000_000.0 + 2440587.5 - 2451545.0
    sidereal = F.radians(F.pmod(F.lit(280.46061837) + 360.98564736629 * days + F.lit(longitude), F.lit(360.0)))
    lat, d = F.radians(F.lit(latitude)), F.radians(dec)
    return F.degrees(F.asin(F.sin(lat) * F.sin(d) + F.cos(lat) * F.cos(d) * F.cos(sidereal - F.radians(ra))))


def mulberry32(state: Column) -> Column:
    """Next value in [0, 1) of the 32-bit generator from its counter state; products are cut to 32 bits in halves (C17)."""
    u32 = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))

    def times(a: Column, b: Column) -> Column:
        low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
        return u32(a * low + F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)) * high, 16))

    t = u32(state)
    t1 = times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    t2 = t1.bitwiseXOR(u32(t1 + times(t1.bitwiseXOR(F.shiftright(t1, 7)), t1.bitwiseOR(F.lit(61)))))
    return t2.bitwiseXOR(F.shiftright(t2, 14)) / F.lit(4294967296.0)
