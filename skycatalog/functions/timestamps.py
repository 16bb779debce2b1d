"""Column expressions for parsing written times: every valid reading of a text, and wall clock to UTC."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The notations read, as (name, pattern, kind). Groups: y mo d h mi s ampm zone by name order of `kind`.
ZONE = r"\s*(Z|z|[A-Za-z]{3,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?"
CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:\.\d*)?)?"
FORMATS = [
    ("ymd", rf"^(\d{{4}})[-:/](\d{{2}})[-:/](\d{{2}})[T ]\s*{CLOCK}{ZONE}$", "y m d h i s z"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:\.\d*)?{ZONE}$", "y m d h i s z"),
    ("dmy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) \s*{CLOCK}{ZONE}$", "d m y h i s z"),
    ("mdy", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) \s*{CLOCK}{ZONE}$", "m d y h i s z"),
    ("mon_d_y", rf"^([A-Za-z]{{3}}) (\d{{1,2}}),? (\d{{4}}) \s*{CLOCK}\s*(AM|PM|am|pm)?{ZONE}$", "b d y h i s p z"),
    ("d_mon_y", rf"^(\d{{1,2}})[- ]([A-Za-z]{{3}})[- ](\d{{4}}) \s*{CLOCK}{ZONE}$", "d b y h i s z"),
    ("digits14", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "y m d h i s"),
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Named offsets, in minutes east of UTC.
NAMED_OFFSETS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
#: Epoch readings count as valid only up to this second (2100-01-01).
EPOCH_MAX = 4_102_444_800
#: Half of the last digit of a Julian date written with eight decimals, in seconds.
JD_HALF_DIGIT = 0.00044

READING = "struct<format:string,wall_s:bigint,zone:string>"


def offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of '+01:00', '-0600', '+9', 'UTC+2', 'Z', 'CEST'; NULL for anything else."""
    z = F.lower(F.trim(zone))
    m = r"^(?:utc|gmt)?([+-])(\d{1,2})(?::?(\d{2}))?$"
    hours = F.regexp_extract(z, m, 2).try_cast("int")
    mins = F.coalesce(F.regexp_extract(z, m, 3).try_cast("int"), F.lit(0))
    num = F.when((hours <= 14) & (mins < 60), F.when(F.regexp_extract(z, m, 1) == "-", -1).otherwise(1) * (hours * 60 + mins))
    names = F.create_map(*[x for k, v in NAMED_OFFSETS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(num, F.try_element_at(names, z))


def _reading(text: Column, name: str, pattern: str, kinds: str) -> Column:
    """One format's reading of `text` as a struct, NULL unless it is a valid full date and time."""
    g = {k: F.regexp_extract(text, pattern, i + 1) for i, k in enumerate(kinds.split())}
    num = lambda c: c.try_cast("int")
    month = num(g["m"]) if "m" in g else F.nullif(F.array_position(F.array(*[F.lit(x) for x in MONTHS]), F.lower(g["b"])), F.lit(0)).cast("int")
    hour = num(g["h"])
    if "p" in g:
        half = F.lower(g["p"])
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    sec = F.coalesce(num(g["s"]), F.lit(0))
    # the month's length by arithmetic: failures of a date parser are slow
    year, dom = num(g["y"]), num(g["d"])
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    real = month.between(1, 12) & (dom >= 1) & (dom <= length) & (year >= 1)
    day = F.when(real, F.make_date(year, month, dom))
    wall = F.unix_date(day).cast("bigint") * 86400 + hour * 3600 + num(g["i"]) * 60 + sec
    ok = (text.rlike(pattern)) & (num(g["y"]) >= 1) & (hour < 24) & (num(g["i"]) < 60) & (sec < 60) & wall.isNotNull()
    zone = F.nullif(g["z"], F.lit("")) if "z" in g else F.lit(None).cast("string")
    return F.when(ok, F.struct(F.lit(name).alias("format"), wall.cast("bigint").alias("wall_s"), zone.alias("zone")))


def readings(text: Column) -> Column:
    """Array of all valid readings (format, wall_s, zone) of a text; epochs and Julian dates come with zone 'Z'."""
    t = F.trim(text)
    found = [_reading(t, *f) for f in FORMATS]
    n = F.when(t.rlike(r"^\d{9,14}$"), t.try_cast("bigint"))
    utc = lambda name, s, ok: F.when(ok, F.struct(F.lit(name).alias("format"), s.cast("bigint").alias("wall_s"), F.lit("Z").alias("zone")))
    found.append(utc("epoch_s", n, n.isNotNull() & (F.length(t) <= 10) & (n <= EPOCH_MAX)))
    found.append(utc("epoch_ms", F.floor(n / 1000), n.isNotNull() & (F.length(t) >= 12) & (n / 1000 <= EPOCH_MAX)))
    jd = F.regexp_extract(t, r"^(?i:JD)\s*(\d{7}(?:\.\d*)?)$", 1).try_cast("decimal(25,12)")
    found.append(utc("jd", F.floor((jd - F.lit("2440587.5").cast("decimal(25,12)")).cast("decimal(25,12)") * 86400 + F.lit(JD_HALF_DIGIT)), jd.isNotNull()))
    return F.filter(F.array(*[f.cast(READING) for f in found]), lambda x: x.isNotNull())


@lru_cache(maxsize=1)
def _zone_names() -> tuple[str, ...]:
    """Zones that Spark's JVM knows; any other name would fail the job."""
    ids = SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds()
    return tuple(sorted(z for z in ids if "/" in z or z in ("UTC", "GMT")))


def known_zone(zone: Column) -> Column:
    """The zone, NULL if Spark does not know it."""
    return F.when(zone.isin(*_zone_names()), zone)


def wall_to_utc(wall_s: Column, zone: Column) -> Column:
    """UTC second of a wall clock in a known IANA zone; NULL where the zone's clocks show it never or twice, or the zone is NULL.

    Offsets a day before and after bracket any change of the zone; a candidate holds if it shows the same wall clock.
    """
    shown = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))
    before, after = wall_s - 86400, wall_s + 86400
    a = wall_s - (shown(before) - before)
    b = wall_s - (shown(after) - after)
    fits = F.array_distinct(F.filter(F.array(a, b), lambda u: shown(u) == wall_s))
    return F.when(F.size(fits) == 1, F.try_element_at(fits, F.lit(1)))
