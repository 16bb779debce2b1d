"""The p-queries of the core problems over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycatalog.functions.timestamps import NAMED_OFFSETS
from skycatalog.operators import schema_drift, sessions, spikes, timestamps
from skycatalog.session import read_table, squeeze, without_blanks

SESSION_GAP_S = 4 * 3600


def p3_path_values(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "metadata_exports")
    return schema_drift.path_values(rows, source="export_source", file="export_file", at="exported_at", line="line_no", payload="payload_json")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = schema_drift.schema_changes(p3_path_values(spark, d))
    return out.select(F.col("file").alias("export_file"), "field_path", "change_kind", "new_path")


#: Columns of the uniform table: type, the paths known to carry the quantity, and its unit.
UNIFORM_FIELDS = {
    "exposure_seconds": ("double", ["exposureSeconds", "exposureTime", "expTime", "exposure_seconds", "headers.EXPTIME", "headers.EXPOSURE"], "s"),
    "ccd_temp": ("double", ["ccdTempCelsius", "sensorTemp", "detectorTempC", "ccd_temp", "headers.CCD-TEMP", "headers.DET-TEMP", "headers.CCDTEMP"], "c"),
    "set_temp": ("double", ["setTempCelsius", "targetTemp", "headers.SET-TEMP"], "c"),
    "gain": ("double", ["gain", "cameraGain", "gain_adu", "headers.GAIN", "headers.EGAINSET"]),
    "offset_adu": ("double", ["offset", "blackLevel", "headers.OFFSET"]),
    "binning_x": ("double", ["binningX", "xbin", "headers.XBINNING", "headers.CCDXBIN"]),
    "width_px": ("double", ["widthPixels", "width_px", "headers.NAXIS1"]),
    "date_obs": ("timestamp", ["dateObs", "dateObserved", "startTime", "headers.DATE-OBS"]),
    "object": ("string", ["object", "headers.OBJECT"]),
    "filter": ("string", ["filter", "headers.FILTER"]),
    "camera": ("string", ["instrument", "camera", "headers.INSTRUME"]),
    "telescope": ("string", ["telescope", "headers.TELESCOP", "headers.OTA"]),
}


def p3_uniform(spark: SparkSession, d: str) -> DataFrame:
    pv = p3_path_values(spark, d)
    lines = schema_drift.all_lines(read_table(spark, d, "metadata_exports"), source="export_source", file="export_file", line="line_no", payload="payload_json")
    renames = schema_drift.schema_changes(pv).where("change_kind = 'renamed'")
    out = schema_drift.uniform_table(pv, UNIFORM_FIELDS, lines=lines, renames=renames)
    return out.withColumn("failed_casts", F.array_join("failed_casts", ",")).withColumn("rest", F.to_json("rest"))


#: What a sensor and a star measurement can be at all, and the least step that they show (degrees; ratio as logarithm).
READINGS = [
    spikes.Field("ccd_temp", -100.0, 100.0, False, 0.1),
    spikes.Field("fwhm", 0.0, 100.0, True, 0.02, lowest_open=True),
    spikes.Field("hfr", 0.0, 100.0, True, 0.02, lowest_open=True),
    spikes.Field("star_count", 0.0, 500_000.0, True, 0.02),
]


def p4_readings(spark: SparkSession, d: str) -> DataFrame:
    return spikes.score_readings(read_table(spark, d, "frames"), source=without_blanks("camera_raw"), time="date_obs_utc", row_id="id", fields=READINGS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_readings(spark, d).where("verdict is not null").select(F.col("id").alias("frame_id"), F.col("field").alias("field_name"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "raw_keywords")
    plain = F.lower("file_ext").isin("fits", "xisf")
    blank = F.coalesce(F.trim("date_time_original"), F.lit("")) == ""
    return timestamps.normalise_instants(
        r,
        record_id="record_id",
        source=F.concat_ws("|", F.lower("file_ext"), F.coalesce("make", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("site_zone", F.lit(""))),
        text=F.when(plain | blank, F.col("date_obs")).otherwise(F.col("date_time_original")),
        offset=F.when(~plain, F.col("offset_time_original")),
        zone=F.when(~plain, F.col("site_zone")),
        zoneless_is_utc=plain,
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).where("status = 'ok'").select("record_id", "utc_seconds")


def p5_status(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("record_id", "status", "format", F.round("posterior", 6).alias("posterior"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    s = sessions.sessionize(
        read_table(spark, d, "frames"), key=squeeze("camera_raw"), time="date_obs_utc", event_id="id", gap_seconds=SESSION_GAP_S, distinct_of="target_id"
    )
    ms = lambda c: F.floor(F.col(c) / 1000).cast("bigint")
    return s.select(F.col("key").alias("camera"), ms("start_us").alias("start_ms"), ms("end_us").alias("end_ms"), F.col("event_count").alias("frame_count"), F.col("distinct_count").alias("target_count"))


QUERIES = {"p3_found": p3_found, "p3_uniform": p3_uniform, "p4_found": p4_found, "p4_readings": p4_readings, "p5_found": p5_found, "p5_status": p5_status, "p6_found": p6_found}

_NAMED = " ".join(f"when '{k}' then {v}" for k, v in NAMED_OFFSETS.items())


def _offset_sql(c: str) -> str:
    """Minutes east of UTC of a written offset."""
    m = "^(?:utc|gmt)?([+-])(\\d{1,2})(?::?(\\d{2}))?$"
    g = lambda i: f"regexp_extract(lower(trim({c})), '{m}', {i})"
    ok = f"regexp_matches(lower(trim({c})), '{m}') and cast({g(2)} as int) <= 14 and coalesce(try_cast({g(3)} as int), 0) < 60"
    return f"(case when {ok} then (case {g(1)} when '-' then -1 else 1 end) * (cast({g(2)} as int) * 60 + coalesce(try_cast({g(3)} as int), 0)) else case lower(trim({c})) {_NAMED} end end)"


_ZONE = "\\s*(Z|z|[A-Za-z]{3,5}|(?:UTC|GMT)?[+-]\\d{1,2}(?::?\\d{2})?)?$"
_CLOCK = "(\\d{2}):(\\d{2})(?::(\\d{2})(?:\\.\\d*)?)?"
_ISO = f"^(\\d{{4}})[-:/](\\d{{2}})[-:/](\\d{{2}})[T ]\\s*{_CLOCK}{_ZONE}"
_SLASH = f"^(\\d{{2}})/(\\d{{2}})/(\\d{{4}}) \\s*{_CLOCK}{_ZONE}"
_P5_SQL = f"""with r as (select record_id, lower(file_ext) in ('fits', 'xisf') as plain, trim(case when lower(file_ext) in ('fits', 'xisf') or coalesce(trim(date_time_original), '') = '' then date_obs else date_time_original end) as t,
   case when lower(file_ext) not in ('fits', 'xisf') then offset_time_original end as o, case when lower(file_ext) not in ('fits', 'xisf') then site_zone end as z from raw_keywords),
 n as (select *, case when regexp_matches(t, '{_ISO}') then replace(regexp_replace(t, '{_ISO}', '\\1-\\2-\\3 \\4:\\5:\\6|\\7'), ':|', ':00|')
   when regexp_matches(t, '{_SLASH}') then replace(regexp_replace(t, '{_SLASH}', case when cast(t[1:2] as int) > 12 then '\\3-\\2-\\1' else '\\3-\\1-\\2' end || ' \\4:\\5:\\6|\\7'), ':|', ':00|')
   when regexp_matches(t, '^[A-Z][a-z]{{2}} \\d{{1,2}} \\d{{4}} [\\d:]+ [AP]M$') then strftime(try_strptime(t, '%b %d %Y %I:%M:%S %p'), '%Y-%m-%d %H:%M:%S') || '|'
   when regexp_matches(t, '^\\d{{1,2}}-[A-Z][a-z]{{2}}-\\d{{4}} [\\d:]+') then strftime(try_strptime(t[1:20], '%d-%b-%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') || '|' || trim(t[21:])
   when regexp_matches(t, '^\\d{{8}}T\\d{{6}}Z?$') then strftime(try_strptime(t[1:15], '%Y%m%dT%H%M%S'), '%Y-%m-%d %H:%M:%S') || '|' || t[16:] end as w from r),
 v as (select *, case when regexp_matches(t, '^\\d{{9,10}}$') then cast(t as bigint) when regexp_matches(t, '^\\d{{12,13}}$') then cast(t as bigint) // 1000
    when regexp_matches(t, '^JD \\d{{7}}[.\\d]*$') then cast(floor((cast(t[4:] as decimal(25, 12)) - 2440587.5::decimal(25, 12)) * 86400 + 0.00044) as bigint) end as direct,
   cast(epoch(try_strptime(split_part(w, '|', 1), '%Y-%m-%d %H:%M:%S')) as bigint) as wall, nullif(split_part(w, '|', 2), '') as zt from n),
 f as (select *, case when zt is not null then {_offset_sql('zt')} else coalesce({_offset_sql('o')}, case when plain then 0 end) end as m from v),
 c as (select *, case when m is null and zt is null and wall is not null and z is not null then list_distinct([wall - cast(epoch(timezone(z, to_timestamp(wall - 86400))) - (wall - 86400) as bigint), wall - cast(epoch(timezone(z, to_timestamp(wall + 86400))) - (wall + 86400) as bigint)]) end as cand from f),
 d as (select *, list_filter(cand, lambda u: cast(epoch(timezone(z, to_timestamp(u))) as bigint) = wall) as fit from c)
select record_id, coalesce(direct, wall - m * 60, case when len(fit) = 1 then fit[1] end) as utc_seconds from d where coalesce(direct, wall - m * 60, case when len(fit) = 1 then fit[1] end) is not null"""

_CAMERA = r"trim(regexp_replace(lower(camera_raw), '\s+', ' ', 'g'))"

ORACLE: dict[str, str] = {
    "p5_found": _P5_SQL,
    "p6_found": rf"""
with f as (select distinct id, {_CAMERA} as camera, date_obs_utc as t, target_id from frames where id is not null and camera_raw is not null and date_obs_utc is not null),
     g as (select *, case when epoch_us(t) - epoch_us(lag(t) over (partition by camera order by t)) <= 14400000000 then 0 else 1 end as fresh from f),
     s as (select *, sum(fresh) over (partition by camera order by t rows unbounded preceding) as n from g)
select camera, epoch_ms(min(t)) as start_ms, epoch_ms(max(t)) as end_ms, count(distinct id) as frame_count, count(distinct target_id) as target_count
from s group by camera, n""",
}
