"""Queries for the catalog's own operators over the catalog tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycatalog.functions import rules, scalar, sqludf
from skycatalog.operators import analytics, export, files, frames, jobs, rollups, search
from skycatalog.schema import violations
from skycatalog.session import cut_lineage, ensure_checkpoint_dir, one_row_per_id, read_table
from skycatalog.sources import generator, headers
from skycatalog.streaming import debounce as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Frames once each (the latest row of an id), for SQL.
CF = "cf as (select * from frames where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def micros(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds, which every engine shows alike."""
    return df.select(*[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def current(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Frames once each, with the columns asked for."""
    return one_row_per_id(read_table(spark, d, "frames"), "id", "updated_at", list(cols))


# ---- rollups ---------------------------------------------------------------------------------------------------------------


@query(f"with {CF} select target_id, filter_id, frame_type, round(sum(exposure_seconds), 3) as total_seconds, count(*) as frame_count from cf where frame_type = 'light' group by all order by 4 desc nulls last, 1, 2, 3")
def integration_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.integration(current(spark, d, "target_id", "filter_id", "frame_type", "exposure_seconds"), ["target_id", "filter_id", "frame_type"])


@query(f"with {CF} select target_id, count(*) as frame_count from cf where frame_type = 'light' and target_id is not null group by 1 order by 2 desc, 1 limit 1")
def top_target(spark: SparkSession, d: str) -> DataFrame:
    return rollups.most_imaged(current(spark, d, "target_id", "frame_type"))


@query(f"""with {CF}, t as (select target_id from cf where frame_type = 'light' and target_id is not null group by 1 order by count(*) desc, 1 limit 1)
select target_id, filter_id, round(sum(exposure_seconds), 3) as total_seconds, count(*) as frame_count from cf join t using (target_id) where frame_type = 'light' group by all order by 3 desc nulls last, 2""")
def target_drilldown(spark: SparkSession, d: str) -> DataFrame:
    return rollups.drill_down(current(spark, d, "target_id", "filter_id", "frame_type", "exposure_seconds"))


@query(f"with {CF} select id, target_id, session_id from cf where frame_type = 'flat' and session_id is not null")
def frames_filtered(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "frame_type", "target_id", "session_id").where("frame_type = 'flat' and session_id is not null").select("id", "target_id", "session_id")


SETS = [["target_id"], ["target_id", "filter_id"], ["session_id"], ["equipment_profile_id"]]


@query(f"""with {CF}, l as (select target_id, filter_id, session_id, equipment_profile_id, exposure_seconds from cf where frame_type = 'light')
select cast(case grouping(target_id, filter_id, session_id, equipment_profile_id) when 7 then 0 when 3 then 1 when 13 then 2 else 3 end as integer) as grouping_level, target_id, filter_id, session_id, equipment_profile_id,
 round(sum(exposure_seconds), 3) as total_seconds, count(*) as frame_count from l group by grouping sets ((target_id), (target_id, filter_id), (session_id), (equipment_profile_id))""")
def rollup_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "target_id", "filter_id", "session_id", "equipment_profile_id", "exposure_seconds", "frame_type").where("frame_type = 'light'")
    return rollups.grouping_sets(f, SETS, {"total_seconds": F.round(F.sum("exposure_seconds"), 3), "frame_count": F.count(F.lit(1))})


@query(f"with {CF} select strftime(date_obs_utc, '%Y-%m') as month, round(sum(exposure_seconds), 3) as total_seconds, count(*) as frame_count, count(distinct target_id) as targets from cf where frame_type = 'light' and date_obs_utc is not null group by 1")
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "date_obs_utc", "exposure_seconds", "target_id", "frame_type").where("frame_type = 'light' and date_obs_utc is not null")
    return f.groupBy(F.date_format("date_obs_utc", "yyyy-MM").alias("month")).agg(F.round(F.sum("exposure_seconds"), 3).alias("total_seconds"), F.count(F.lit(1)).alias("frame_count"), F.countDistinct("target_id").alias("targets"))


@query(f"""with {CF}, u as (select equipment_profile_id as id, sum(exposure_seconds) / 3600 as h, count(*) as n from cf where frame_type = 'light' group by 1)
select e.name, e.camera, round(coalesce(h, 0), 4) as hours, coalesce(n, 0) as frame_count from equipment_profiles e left join u using (id)""")
def equipment_usage(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "equipment_profile_id", "exposure_seconds", "frame_type").where("frame_type = 'light'")
    u = f.groupBy(F.col("equipment_profile_id").alias("u_id")).agg((F.sum("exposure_seconds") / 3600).alias("h"), F.count(F.lit(1)).alias("n"))
    e = read_table(spark, d, "equipment_profiles")
    return e.join(u, e["id"] == u["u_id"], "left").select("name", "camera", F.round(F.coalesce("h", F.lit(0.0)), 4).alias("hours"), F.coalesce("n", F.lit(0)).alias("frame_count"))


@query(f"""with {CF}, f as (select * from cf where frame_type = 'light')
select 'hours' as metric, 'all' as label, round(sum(exposure_seconds) / 3600, 4) as value from f
union all select 'nights', strftime(date_obs_utc, '%Y-%m'), cast(count(distinct cast(date_obs_utc - interval 12 hours as date)) as double) from f where date_obs_utc is not null group by 2
union all select 'filter_hours', filter_id, round(sum(exposure_seconds) / 3600, 4) from f where filter_id is not null group by 2
union all select 'rig_hours', equipment_profile_id, round(sum(exposure_seconds) / 3600, 4) from f where equipment_profile_id is not null group by 2
union all select 'bytes', coalesce(extension, ''), cast(sum(size_bytes) as double) from files where status <> 'missing' group by 2""")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "frame_type", "exposure_seconds", "date_obs_utc", "filter_id", "equipment_profile_id")
    return analytics.dashboard(cut_lineage(f), read_table(spark, d, "files"))


@query(f"""with {CF}, f as (select * from cf where session_id is not null and frame_type = 'light' and date_obs_utc is not null),
 r as (select *, case when row_number() over w > 1 and lag(filter_id) over w is not distinct from filter_id then 0 else 1 end as fresh from f window w as (partition by session_id order by date_obs_utc, id))
select session_id, count(*) as frame_count, cast(sum(fresh) as bigint) as filter_runs, round(avg(fwhm), 6) as mean_fwhm, round(avg(hfr), 6) as mean_hfr, round(avg(star_count), 4) as mean_stars from r group by 1""")
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    return analytics.filter_sequence(current(spark, d, "session_id", "frame_type", "date_obs_utc", "filter_id", "fwhm", "hfr", "star_count"))


@query(f"""with {CF}, q as (select equipment_profile_id, avg(fwhm) as m, stddev_samp(fwhm) as sd from cf where frame_type = 'light' and fwhm between 0.1 and 50 group by 1)
select id, equipment_profile_id, fwhm from cf join q using (equipment_profile_id) where frame_type = 'light' and fwhm between 0.1 and 50 and sd > 0 and abs(fwhm - m) > 3 * sd""")
def quality_reject(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "frame_type", "fwhm", "equipment_profile_id").where("frame_type = 'light' and fwhm between 0.1 and 50")
    return rollups.sigma_rejects(f, ["equipment_profile_id"], "fwhm", 3.0).select("id", "equipment_profile_id", "fwhm")


@query(f"with {CF} select target_id, round(median(exposure_seconds), 6) as median, count(distinct equipment_profile_id) as members from cf where frame_type = 'light' group by 1 having count(distinct equipment_profile_id) >= 2")
def community_benchmark(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "frame_type", "target_id", "equipment_profile_id", "exposure_seconds").where("frame_type = 'light'")
    return rollups.community_median(f, ["target_id"], "equipment_profile_id", "exposure_seconds", 2).withColumn("median", F.round("median", 6))


@query(f"""with {CF}, n as (select target_id, cast(date_obs_utc - interval 12 hours as date) as night, sum(exposure_seconds) / 3600 as h from cf where frame_type = 'light' and target_id is not null and date_obs_utc is not null group by 1, 2),
 t as (select target_id, sum(h) as h, count(*) as nights from n group by 1)
select target_id, round(h, 4) as hours, nights, case when h > 0 then cast(ceil(round(greatest(40.0 - h, 0) / (h / nights), 6)) as bigint) end as nights_to_goal from t""")
def completion_forecast(spark: SparkSession, d: str) -> DataFrame:
    return analytics.forecast_completion(current(spark, d, "frame_type", "target_id", "date_obs_utc", "exposure_seconds"), 40.0)


@query(f"""with {CF}, p as (select target_id, filter_id, sum(exposure_seconds) as s from cf where frame_type = 'light' and target_id is not null group by 1, 2),
 t as (select target_id as id, sum(s) / 3600 as h, min(s) / max(s) as b from p group by 1)
select canonical_name, round(greatest(40.0 - coalesce(h, 0), 0), 4) as remaining_hours, round(0.7 * greatest(40.0 - coalesce(h, 0), 0) / 40.0 + 0.3 * (1 - coalesce(b, 0)), 6) as score from targets left join t using (id)""")
def recommend_targets(spark: SparkSession, d: str) -> DataFrame:
    return analytics.recommend(read_table(spark, d, "targets"), current(spark, d, "frame_type", "target_id", "filter_id", "exposure_seconds"), 40.0)


@query(f"""with {CF} select target_id, cast(regexp_extract(lower(object_raw), '(?:panel[ _-]*|_p)([0-9]+)', 1) as integer) as panel, round(sum(exposure_seconds) / 3600, 4) as hours, count(*) as frame_count
from cf where frame_type = 'light' and regexp_matches(lower(object_raw), '(?:panel[ _-]*|_p)([0-9]+)') group by 1, 2""")
def mosaic_progress(spark: SparkSession, d: str) -> DataFrame:
    return analytics.mosaic_progress(current(spark, d, "frame_type", "target_id", "object_raw", "exposure_seconds"))


@query(f"""with {CF} select lower(trim(telescope_raw)) as telescope, lower(trim(regexp_replace(camera_raw, '\\s+', ' ', 'g'))) as camera, focal_length, count(*) as frame_count, epoch_us(min(date_obs_utc)) as first_used, epoch_us(max(date_obs_utc)) as last_used
from cf where telescope_raw is not null or camera_raw is not null group by 1, 2, 3""")
def detect_equipment(spark: SparkSession, d: str) -> DataFrame:
    return micros(analytics.equipment_in_use(current(spark, d, "telescope_raw", "camera_raw", "focal_length", "date_obs_utc")))


@query(f"with {CF} select frame_type, frame_type_source, count(*) as n from cf group by 1, 2")
def realised_distribution(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, "frame_type", "frame_type_source").groupBy("frame_type", "frame_type_source").agg(F.count(F.lit(1)).alias("n"))


# ---- files -----------------------------------------------------------------------------------------------------------------

def _scan_state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files as known before (those up to the mean size, their time unknown where the row was updated), and what a walk finds now."""
    f = read_table(spark, d, "files")
    cut = f.select(F.avg("size_bytes").alias("_cut"))
    prior = f.crossJoin(F.broadcast(cut)).where(F.col("size_bytes") <= F.col("_cut")).withColumn("file_mtime", F.when(F.col("updated_at") > F.col("created_at"), None).otherwise(F.col("file_mtime"))).drop("_cut")
    return prior, f.where("status <> 'missing'")


SCAN_SQL = """c as (select avg(size_bytes) as cut from files),
 prior as (select f.* replace (case when updated_at > created_at then null else file_mtime end as file_mtime) from files f, c where size_bytes <= cut),
 seen as (select * from files where status <> 'missing'),
 j as (select coalesce(p.watch_folder_id, s.watch_folder_id) as watch_folder_id, coalesce(p.relative_path, s.relative_path) as relative_path, p.id is not null as was, s.id is not null as now,
   p.status as status0, p.sha256 as sha0, p.size_bytes as size0, p.file_mtime as time0, s.size_bytes as size1, s.file_mtime as time1
   from prior p full join seen s on p.watch_folder_id = s.watch_folder_id and p.relative_path = s.relative_path),
 u as (select watch_folder_id, relative_path, case when now then size1 else size0 end as size_bytes, case when now then time1 else time0 end as file_mtime,
   case when was and now and (size0 is distinct from size1 or time0 is distinct from time1) then null else sha0 end as sha256,
   case when not was then 'present' when now and status0 <> 'duplicate' then 'present' else status0 end as status,
   now and not was as is_new, now and (not was or size0 is distinct from size1 or time0 is distinct from time1 or status0 = 'missing') as changed, was and now and status0 = 'missing' as was_restored from j)"""


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    prior, seen = _scan_state(spark, d)
    return files.upsert_discovered(prior, seen, F.lit("2030-01-01").cast("timestamp"))


@query(f"with {SCAN_SQL} select * replace (epoch_us(file_mtime) as file_mtime) from u")
def upsert_discovered(spark: SparkSession, d: str) -> DataFrame:
    return micros(_upserted(spark, d).select("watch_folder_id", "relative_path", "size_bytes", "file_mtime", "sha256", "status", "is_new", "changed", "was_restored"))


@query(f"with {SCAN_SQL} select count(*) as files_seen, count(*) filter (where is_new) as files_added, count(*) filter (where changed and not is_new) as files_updated, count(*) filter (where file_mtime is null) as files_errored from u")
def scan_counters(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_counters(_upserted(spark, d), F.col("file_mtime").isNull())


@query("select id, case when status = 'present' and updated_at < timestamptz '2026-03-10 00:00:00+00' then 'missing' else status end as status from files")
def mark_missing(spark: SparkSession, d: str) -> DataFrame:
    return files.mark_missing(read_table(spark, d, "files"), F.lit("2026-03-10 00:00:00").cast("timestamp")).select("id", "status")


@query("""with f as (select *, status in ('present', 'duplicate') and sha256 is not null as live from files),
 g as (select sha256, first(id order by created_at, id) as first_id from f where live group by 1)
select id, case when not live then status when id = first_id then 'present' else 'duplicate' end as status, case when live and id <> first_id then first_id end as duplicate_of_id from f left join g using (sha256)""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return files.resolve_duplicates(read_table(spark, d, "files")).select("id", "status", "duplicate_of_id")


@query("select id, epoch_us(created_at) as created_at from files where sha256 is null and status in ('present', 'duplicate') order by files.created_at, id limit 500")
def unhashed_topk(spark: SparkSession, d: str) -> DataFrame:
    return micros(files.unhashed(read_table(spark, d, "files"), 500).select("id", "created_at"))


def _moves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = read_table(spark, d, "files")
    lost = f.withColumn("status", F.when(F.col("status") == "present", "missing").otherwise(F.col("status")))
    found = f.where("status <> 'missing'").select(F.concat(F.lit("new-"), "id").alias("id"), "watch_folder_id", F.concat(F.lit("moved/"), "relative_path").alias("relative_path"), "filename", "size_bytes", "sha256")
    return lost, found, files.match_moves(found, lost)


MOVE_SQL = """lost as (select * replace (case when status = 'present' then 'missing' else status end as status) from files),
 found as (select 'new-' || id as id, watch_folder_id, 'moved/' || relative_path as relative_path, filename, size_bytes, sha256 from files where status <> 'missing'),
 hit as (select n.id as new_id, n.relative_path, min(l.id) as file_id from found n join lost l on l.status = 'missing' and n.sha256 = l.sha256 and n.size_bytes = l.size_bytes group by 1, 2),
 moves as (select first(new_id order by relative_path, new_id) as new_id, file_id from hit group by file_id)"""


@query(f"with {MOVE_SQL} select new_id, file_id from moves")
def move_match(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d)[2]


@query(f"with {MOVE_SQL} select l.id, case when m.file_id is not null then n.relative_path else l.relative_path end as relative_path, case when m.file_id is not null then 'present' else l.status end as status from lost l left join moves m on m.file_id = l.id and l.status = 'missing' left join found n on n.id = m.new_id")
def reparent_moved(spark: SparkSession, d: str) -> DataFrame:
    lost, found, moves = _moves(spark, d)
    return files.reparent(lost, moves, found).select("id", "relative_path", "status")


@query("select coalesce(nullif(lower(regexp_extract(filename, '^.+\\.([^.]+)$', 1)), ''), '') as extension, case when extension in ('fits', 'fit', 'fts') then 'fits' when extension = 'xisf' then 'xisf' when extension in ('cr2', 'cr3', 'nef', 'arw', 'dng') then 'raw' end as format, count(*) as n, cast(sum(size_bytes) as bigint) as bytes from files group by 1, 2".replace("case when extension in", "case when files.extension in").replace("when extension =", "when files.extension =").replace("when extension in ('cr2'", "when files.extension in ('cr2'"))
def extension_formats(spark: SparkSession, d: str) -> DataFrame:
    e = scalar.extension_of(F.col("filename"))
    return read_table(spark, d, "files").groupBy(F.coalesce(e, F.lit("")).alias("extension"), scalar.format_of(F.col("extension")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


@query("select '/archive/' || watch_folder_id || '/' || relative_path as path from files where status <> 'missing'")
def path_list_export(spark: SparkSession, d: str) -> DataFrame:
    return analytics.path_list(read_table(spark, d, "files"), "/archive")


@query("select id, replace(substr(full_path, length('/archive') + 2), '\\', '/') as rel, not list_bool_or(list_transform(string_split(full_path, '/'), lambda s: (starts_with(s, '.') and len(s) > 0) or lower(s) in ('node_modules', 'darks'))) as walked from (select id, '/archive/' || watch_folder_id || '/' || relative_path as full_path from files)")
def walk_rules(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "files").select("id", F.concat(F.lit("/archive/"), "watch_folder_id", F.lit("/"), "relative_path").alias("p"))
    return f.select("id", scalar.posix_relative(F.lit("/archive"), F.col("p")).alias("rel"), scalar.walks_into(F.col("p"), ["darks"]).alias("walked"))


@query("""with v as (
 select 'files' as "table", 'check status' as rule, id as key from files where status not in ('present', 'missing', 'duplicate')
 union all select 'files', 'unique id', id from files group by id having count(*) > 1
 union all select 'files', 'unique watch_folder_id,relative_path', watch_folder_id || '|' || relative_path from files group by watch_folder_id, relative_path having count(*) > 1
 union all select 'frames', 'check frame_type', id from frames where frame_type not in ('light', 'dark', 'flat', 'bias', 'darkflat', 'unknown')
 union all select 'frames', 'check frame_type_source', id from frames where frame_type_source not in ('header', 'path_heuristic', 'manual')
 union all select 'frames', 'unique id', id from frames where id is not null group by id having count(*) > 1
 union all select 'frames', 'unique file_id', file_id from frames where file_id is not null group by file_id having count(*) > 1
 union all select distinct 'frames', 'reference file_id', file_id from frames where file_id is not null and file_id not in (select id from files)
 union all select distinct 'frames', 'reference target_id', target_id from frames where target_id is not null and target_id not in (select id from targets)
 union all select distinct 'frames', 'reference filter_id', filter_id from frames where filter_id is not null and filter_id not in (select id from filters)
 union all select distinct 'frames', 'reference session_id', session_id from frames where session_id is not null and session_id not in (select id from sessions)
 union all select distinct 'frames', 'reference equipment_profile_id', equipment_profile_id from frames where equipment_profile_id is not null and equipment_profile_id not in (select id from equipment_profiles)
 union all select 'sessions', 'unique id', id from sessions group by id having count(*) > 1
 union all select distinct 'sessions', 'reference equipment_profile_id', equipment_profile_id from sessions where equipment_profile_id is not null and equipment_profile_id not in (select id from equipment_profiles)
 union all select 'targets', 'unique id', id from targets group by id having count(*) > 1
 union all select 'targets', 'check status', id from targets where status not in ('planning', 'capturing', 'ready', 'processed', 'complete')
 union all select 'equipment_profiles', 'unique id', id from equipment_profiles where id is not null group by id having count(*) > 1
 union all select 'filters', 'unique id', id from filters group by id having count(*) > 1)
select * from v""")
def integrity_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations({t: read_table(spark, d, t) for t in ("files", "frames", "targets", "filters", "sessions", "equipment_profiles")})


# ---- frames ----------------------------------------------------------------------------------------------------------------

HDR = "json_extract_string(headers_json, '$.\"{0}\"')"


def _typed(key: str, kind: str) -> str:
    kinds = "('VARCHAR')" if kind == "s" else "('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT')"
    value = f"json_extract_string(headers_json, '$.\"{key}\"')"
    return f"case when json_type(headers_json, '$.\"{key}\"') in {kinds} then {value if kind == 's' else f'cast({value} as double)'} end"


@query(f"""with {CF} select id, {_typed('OBJECT', 's')} as object, {_typed('FILTER', 's')} as filter, {_typed('IMAGETYP', 's')} as image_type, {_typed('DATE-OBS', 's')} as date_obs, coalesce({_typed('EXPTIME', 'n')}, {_typed('EXPOSURE', 'n')}) as exposure_seconds,
 {_typed('CCD-TEMP', 'n')} + 0.0 as ccd_temp, {_typed('GAIN', 'n')} as gain, {_typed('XBINNING', 'n')} as binning_x, {_typed('NAXIS1', 'n')} as width_px from cf""")
def frame_records(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_records(current(spark, d, "headers_json"), "headers_json", ["id"]).select("id", "object", "filter", "image_type", "date_obs", "exposure_seconds", (F.col("ccd_temp") + 0.0).alias("ccd_temp"), "gain", "binning_x", "width_px")


def _number_sql(key: str) -> str:
    return f"try_cast(nullif(trim(json_extract_string(h, '$.\"{key}\"')), '') as double)"


@query(f"""with r as (select distinct record_id, json_extract(payload_json, '$.headers') as h from metadata_exports where json_valid(payload_json))
select record_id, json_extract_string(h, '$.OBJECT') as object, json_extract_string(h, '$.FILTER') as filter, json_extract_string(h, '$.IMAGETYP') as image_type, json_extract_string(h, '$."DATE-OBS"') as date_obs,
 coalesce({_number_sql('EXPTIME')}, {_number_sql('EXPOSURE')}) as exposure_seconds, {_number_sql('CCD-TEMP')} + 0.0 as ccd_temp, {_number_sql('GAIN')} as gain, {_number_sql('XBINNING')} as binning_x from r where json_type(h) = 'OBJECT'""")
def xisf_records(spark: SparkSession, d: str) -> DataFrame:
    """The exports' raw headers with all values as text, as an XISF head carries them."""
    e = read_table(spark, d, "metadata_exports").select("record_id", F.try_variant_get(F.try_parse_json("payload_json"), "$.headers", "map<string,string>").alias("h")).where("h is not null")
    rec = frames.frame_records(e.select("record_id", F.to_json("h").alias("h")), "h", ["record_id"], format=F.lit("xisf"))
    return rec.select("record_id", "object", "filter", "image_type", "date_obs", "exposure_seconds", (F.col("ccd_temp") + 0.0).alias("ccd_temp"), "gain", "binning_x").distinct()


_EXIF = """r as (select record_id, make, model, exposure_time, iso, date_time_original as t, offset_time_original as o, regexp_matches(date_time_original, '^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}$') as ok from raw_keywords where lower(file_ext) not in ('fits', 'xisf')),
 p as (select *, case when ok then try_strptime(t, '%Y:%m:%d %H:%M:%S') end as l, case when regexp_matches(o, '^[+-]\\d{2}:\\d{2}$') and cast(substr(o, 2, 2) as int) <= 14 and cast(substr(o, 5, 2) as int) < 60 then (case when o[1] = '-' then -1 else 1 end) * (cast(substr(o, 2, 2) as int) * 60 + cast(substr(o, 5, 2) as int)) end as m from r)"""


@query(f"""with {_EXIF}
select record_id, case when m is not null then strftime(l - to_minutes(m), '%Y-%m-%dT%H:%M:%SZ') else strftime(l, '%Y-%m-%dT%H:%M:%S') end as date_obs, exposure_time as exposure_seconds, cast(iso as double) as gain,
 case when nullif(trim(make), '') is null then nullif(trim(model), '') when nullif(trim(model), '') is null then trim(make) when contains(lower(trim(model)), lower(string_split(trim(make), ' ')[1])) then trim(model) else trim(make) || ' ' || trim(model) end as instrument, cast(null as double) as ccd_temp, cast(null as varchar) as object from p""")
def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of camera RAW heads from their EXIF tags."""
    r = read_table(spark, d, "raw_keywords").where("lower(file_ext) not in ('fits', 'xisf')")
    tags = F.to_json(F.struct(F.col("make").alias("Make"), F.col("model").alias("Model"), F.col("exposure_time").alias("ExposureTime"), F.col("iso").alias("ISO"), F.col("date_time_original").alias("DateTimeOriginal"), F.col("offset_time_original").alias("OffsetTimeOriginal")))
    rec = frames.frame_records(r.select("record_id", tags.alias("h")), "h", ["record_id"], format=F.lit("raw"))
    return rec.select("record_id", "date_obs", "exposure_seconds", "gain", "instrument", "ccd_temp", "object")


_NORM = "nullif(upper(regexp_replace(regexp_replace(trim(it), '[_-]', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_TYPES = " ".join(f"when '{k}' then '{v}'" for k, v in rules.IMAGE_TYPES.items())
_PATH = "case " + " ".join(f"when regexp_matches(s, '(^|[-_.]){w}($|[-_.])') then '{k}'" for w, k in rules.PATH_WORDS) + " end"
_BY_PATH = f"list_filter(list_transform(list_reverse(string_split(lower(relative_path), '/')), lambda s: {_PATH}), lambda x: x is not null)[1]"


@query(f"""with {CF}, c as (select cf.id, relative_path, {HDR.format('IMAGETYP')} as it from cf left join files f on f.id = cf.file_id),
 k as (select id, case {_NORM} {_TYPES} end as by_header, {_BY_PATH} as by_path from c)
select id, coalesce(by_header, by_path, 'unknown') as frame_type, case when by_header is not null then 'header' else 'path_heuristic' end as frame_type_source from k""")
def classify_frames(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "file_id", "headers_json")
    paths = read_table(spark, d, "files").select(F.col("id").alias("f_id"), "relative_path")
    j = f.join(paths, f["file_id"] == paths["f_id"], "left").withColumn("h", F.try_parse_json("headers_json"))
    kind, source = scalar.classify(F.try_variant_get("h", "$.IMAGETYP", "string"), F.col("relative_path"))
    return j.select("id", kind.alias("frame_type"), source.alias("frame_type_source"))


@query(f"with c as (select id, relative_path from files) select id, {_BY_PATH} as kind from c")
def classify_paths_sql(spark: SparkSession, d: str) -> DataFrame:
    sqludf.register(spark)
    return read_table(spark, d, "files").selectExpr("id", "match_path(relative_path) as kind")


@query(f"""with {CF}, h as (select {HDR.format('SWCREATE')} as sw, {HDR.format('CREATOR')} as cr from cf)
select coalesce(sw, '') as program, case when starts_with(sw, 'N.I.N.A.') then 'nina' when contains(cr, 'Sequence Generator Pro') then 'sgpro' when starts_with(sw, 'Astro Photography Tool') then 'apt' when starts_with(sw, 'SharpCap') then 'sharpcap'
 when starts_with(cr, 'ZWO ASI') then 'asiair-asistudio' when starts_with(sw, 'Voyager') then 'voyager' end as profile, count(*) as n from h group by 1, 2""")
def capture_profiles(spark: SparkSession, d: str) -> DataFrame:
    h = current(spark, d, "headers_json").withColumn("h", F.try_parse_json("headers_json"))
    profile = scalar.detect_profile(lambda k: frames.header_text(F.col("h"), k))
    return h.groupBy(F.coalesce(frames.header_text(F.col("h"), "SWCREATE"), F.lit("")).alias("program"), profile.alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {CF}, p as (select file_id, {_typed('OBJECT', 's')} as object_raw, {_typed('EXPTIME', 'n')} as exposure_seconds, 'dark' as frame_type, 'header' as frame_type_source from cf where ccd_temp is not null and file_id is not null),
 base as (select * replace (case when fwhm is null then 'manual' else frame_type_source end as frame_type_source) from cf)
select b.id, b.file_id, case when p.file_id is not null then p.object_raw else b.object_raw end as object_raw, case when p.file_id is not null then p.exposure_seconds else b.exposure_seconds end as exposure_seconds,
 case when p.file_id is not null and b.frame_type_source <> 'manual' then p.frame_type else b.frame_type end as frame_type, case when p.file_id is not null and b.frame_type_source <> 'manual' then p.frame_type_source else b.frame_type_source end as frame_type_source, b.target_id from base b left join p using (file_id)""")
def frame_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "file_id", "object_raw", "exposure_seconds", "frame_type", "frame_type_source", "target_id", "fwhm", "ccd_temp", "headers_json")
    rec = frames.frame_records(f.where("ccd_temp is not null"), "headers_json", ["file_id", "headers_json"])
    h = F.try_parse_json("headers_json")
    parsed = rec.select("file_id", F.col("object").alias("object_raw"), frames.header_number(h, "EXPTIME").alias("exposure_seconds"), F.lit("dark").alias("frame_type"), F.lit("header").alias("frame_type_source"))
    base = f.withColumn("frame_type_source", F.when(F.col("fwhm").isNull(), "manual").otherwise(F.col("frame_type_source"))).drop("fwhm", "ccd_temp", "headers_json")
    return frames.upsert_frames(base, parsed).select("id", "file_id", "object_raw", "exposure_seconds", "frame_type", "frame_type_source", "target_id")


@query(f"""with {CF}, s as (select id, ra_deg, dec_deg, ra_deg is not null and dec_deg is not null as ok, floor(ra_deg / 15) as h, abs(dec_deg) as a from cf)
select id, round(h * 15, 6) as ra_from_text, case when dec_deg < 0 then -floor(a) else floor(a) end + 0.0 as dec_from_text, round(floor(ra_deg * 10 + 0.5) / 10, 6) as ra_rounded from s where ok""")
def sexagesimal(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "ra_deg", "dec_deg").dropna()
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    ra = F.concat_ws(" ", two(F.floor(F.col("ra_deg") / 15)), F.lit("00"), F.lit("00"))
    dec = F.concat(F.when(F.col("dec_deg") < 0, "-").otherwise("+"), two(F.floor(F.abs("dec_deg"))), F.lit(":00:00.0"))
    return f.select("id", F.round(scalar.ra_degrees(F.lit(None).cast("double"), ra), 6).alias("ra_from_text"), (scalar.dec_degrees(F.lit(None).cast("double"), dec) + 0.0).alias("dec_from_text"), F.round(F.floor(F.col("ra_deg") * 10 + 0.5) / 10, 6).alias("ra_rounded"))


@query("""with r as (select record_id, make, model, date_time_original as t, offset_time_original as o, regexp_matches(date_time_original, '^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}$') as ok from raw_keywords),
 p as (select *, case when ok then try_strptime(t, '%Y:%m:%d %H:%M:%S') end as l, case when regexp_matches(o, '^[+-]\\d{2}:\\d{2}$') and cast(substr(o, 2, 2) as int) <= 14 and cast(substr(o, 5, 2) as int) < 60 then (case when o[1] = '-' then -1 else 1 end) * (cast(substr(o, 2, 2) as int) * 60 + cast(substr(o, 5, 2) as int)) end as m from r)
select record_id, case when m is not null then strftime(l - to_minutes(m), '%Y-%m-%dT%H:%M:%SZ') else strftime(l, '%Y-%m-%dT%H:%M:%S') end as date_obs,
 case when nullif(trim(make), '') is null then nullif(trim(model), '') when nullif(trim(model), '') is null then trim(make) when contains(lower(trim(model)), lower(string_split(trim(make), ' ')[1])) then trim(model) else trim(make) || ' ' || trim(model) end as camera from p""")
def exif_fields(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "raw_keywords")
    return r.select("record_id", scalar.exif_date_obs(F.col("date_time_original"), F.col("offset_time_original")).alias("date_obs"), scalar.camera_name(F.col("make"), F.col("model")).alias("camera"))


@query(f"""with {CF} select id, case when exposure_seconds is null then null else lpad(cast(cast(floor(exposure_seconds * 60 / 3600) as bigint) as varchar), 2, '0') || 'h ' || lpad(cast(cast(floor(exposure_seconds) as bigint) % 60 as varchar), 2, '0') || 'm' end as label,
 cast(date_obs_utc - interval 12 hours as date) as night, regexp_matches(id, '{rules.UUID}') as valid_id from cf""")
def labels(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "exposure_seconds", "date_obs_utc")
    return f.select("id", scalar.integration_label(F.floor(F.col("exposure_seconds")) * 60).alias("label"), scalar.astro_day(F.col("date_obs_utc")).alias("night"), scalar.is_uuid(F.col("id")).alias("valid_id"))


def head_bytes(spark: SparkSession, d: str) -> DataFrame:
    """(id, headers_json, extension, content): each frame's keywords written as a FITS or XISF head."""
    f = current(spark, d, "file_id", "headers_json")
    ext = read_table(spark, d, "files").select(F.col("id").alias("f_id"), "extension")
    j = f.join(ext, f["file_id"] == ext["f_id"]).where("extension in ('fits', 'xisf')").select("id", "extension", "headers_json")
    return headers.header_bytes(j, "headers_json", "extension", ["id"])


@query(f"""with {CF}, j as (select cf.id, extension, case when json_valid(headers_json) then headers_json::json end as h from cf join files f on f.id = cf.file_id where extension in ('fits', 'xisf'))
select id, extension as format, 'ok' as status, regexp_replace(rtrim(json_extract_string(h, '$.OBJECT'), ' '), '[^ -~]', '?', 'g') as object, cast(json_extract_string(h, '$.EXPTIME') as varchar) is not null as has_exposure, round(try_cast(json_extract_string(h, '$.EXPTIME') as double), 6) as exposure_seconds, regexp_replace(rtrim(json_extract_string(h, '$.FILTER'), ' '), '[^ -~]', '?', 'g') as filter from j""")
def header_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's keywords written as a FITS or XISF head and scanned again; in FITS, texts are ASCII and blanks at their end do not count."""
    scanned = headers.scan_content(head_bytes(spark, d), "extension", "content")
    h = F.try_parse_json("headers_json")
    text = lambda k: F.try_variant_get(h, f"$.{k}", "string")
    return scanned.select("id", "format", "status", F.regexp_replace(F.rtrim(text("OBJECT")), "[^ -~]", "?").alias("object"), text("EXPTIME").isNotNull().alias("has_exposure"), F.round(text("EXPTIME").try_cast("double"), 6).alias("exposure_seconds"), F.regexp_replace(F.rtrim(text("FILTER")), "[^ -~]", "?").alias("filter"))


# ---- names, targets, filters -----------------------------------------------------------------------------------------------

_FILTER = "case when t = '' then 'None' " + " ".join(f"when lower(t) in ({', '.join(repr(s) for s in v[1])}) then '{k}'" for k, v in rules.FILTERS.items()) + " else t end"
_BAND = "case when t = '' then 'none' " + " ".join(f"when lower(t) in ({', '.join(repr(s) for s in v[1])}) then '{v[0]}'" for v in rules.FILTERS.values()) + " end"


@query(f"with f as (select id, coalesce(trim(raw_name), '') as t from filters) select id, {_FILTER} as canonical, {_BAND} as band from f")
def filter_normalize(spark: SparkSession, d: str) -> DataFrame:
    name, band = scalar.canonical_filter(F.col("raw_name"))
    return read_table(spark, d, "filters").select("id", name.alias("canonical"), band.alias("band"))


def _name_sql(c: str) -> str:
    t = f"regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '([A-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '\\b0+([0-9])', '\\1', 'g'))"


_SEP = "degrees(2 * asin(sqrt(least(pow(sin(radians(t.dec_deg - f.dec_deg) / 2), 2) + cos(radians(f.dec_deg)) * cos(radians(t.dec_deg)) * pow(sin(radians(t.ra_deg - f.ra_deg) / 2), 2), 1.0))))"


@query(rf"""with {CF}, raw as (select id, canonical_name, unnest([canonical_name, display_name] || from_json(catalog_ids_json, '["VARCHAR"]')) as n from targets),
 a as (select {_name_sql('n')} as alias, min(canonical_name) as target from raw where n is not null group by 1),
 f as (select id, ra_deg, dec_deg, {_name_sql("regexp_replace(upper(object_raw), '(PANEL[ _-]*|_P)[0-9]+', ' ', 'g')")} as alias, try_cast(nullif(regexp_extract(lower(object_raw), '(?:panel[ _-]*|_p)([0-9]+)', 1), '') as integer) as panel from cf where object_raw is not null),
 g as (select f.*, target from f left join a using (alias) where alias <> ''),
 c as (select f.id, t.canonical_name, round({_SEP}, 6) as s from g f join targets t on f.target is null and abs(f.dec_deg - t.dec_deg) <= 1 where {_SEP} <= 1),
 n as (select id, first(canonical_name order by s, canonical_name) as nearest from c group by 1)
select g.id, coalesce(target, nearest) as target, panel, case when target is not null then 'alias' when nearest is not null then 'cone' else 'review' end as how from g left join n using (id)""")
def resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    return analytics.resolve_targets(current(spark, d, "object_raw", "ra_deg", "dec_deg"), read_table(spark, d, "targets"))


@query(f"""with {CF}, f as (select distinct id, ra_deg, dec_deg from cf where ra_deg is not null and dec_deg is not null)
select f.id, t.id as target_id, round({_SEP}, 6) as separation from f join targets t on abs(f.dec_deg - t.dec_deg) <= 1 where {_SEP} <= 1""")
def cone_search(spark: SparkSession, d: str) -> DataFrame:
    c = analytics.cone_search(current(spark, d, "ra_deg", "dec_deg"), read_table(spark, d, "targets"), 1.0)
    return c.withColumn("separation", F.round("separation", 6))


@query(f"""with {CF}, f as (select *, coalesce(equipment_profile_id, '?') as rig, cast(date_obs_utc - interval 12 hours as date) as astro_day from cf where date_obs_utc is not null),
 g as (select *, case when epoch_us(date_obs_utc) - epoch_us(lag(date_obs_utc) over (partition by rig, astro_day order by date_obs_utc)) <= 14400000000 then 0 else 1 end as fresh from f),
 s as (select *, sum(fresh) over (partition by rig, astro_day order by date_obs_utc rows unbounded preceding) as n from g)
select rig as equipment_profile_id, cast(astro_day as varchar) as astro_day, epoch_us(min(date_obs_utc)) as started_at_utc, epoch_us(max(date_obs_utc)) as ended_at_utc, count(*) as event_count, count(distinct target_id) as distinct_count, case when coalesce(bool_or(frame_type = 'light'), false) then 'light' else 'calibration' end as kind from s group by rig, astro_day, n""")
def detect_sessions(spark: SparkSession, d: str) -> DataFrame:
    return micros(analytics.detect_sessions(current(spark, d, "equipment_profile_id", "date_obs_utc", "target_id", "frame_type")))


_MILLI = ("exposure_seconds", "gain", "offset_adu", "binning_x", "set_temp")


def _group_key(first: Column) -> Column:
    """Text of what frames of one calibration group have in common; numbers in thousandths."""
    number = lambda c: F.coalesce(F.round(F.col(c) * 1000).cast("bigint").cast("string"), F.lit("?"))
    return F.concat_ws("|", first, F.coalesce("camera", F.lit("?")), *[number(c) for c in _MILLI], F.coalesce("filter_raw", F.lit("?")))


_GROUP_SQL = "coalesce(camera, '?') || '|' || " + " || '|' || ".join(f"coalesce(cast(cast(round({c} * 1000) as bigint) as varchar), '?')" for c in _MILLI) + " || '|' || coalesce(filter_raw, '?')"
_CAL_COLS = "camera, exposure_seconds, gain, offset_adu, binning_x, set_temp, filter_raw"
_CAL_SCORE = "-round(0.5 * (1 - least(coalesce(abs(l.set_temp - m.set_temp), 2.0) / 2.0, 1.0)) + 0.3 * coalesce(exp(-abs(date_diff('day', m.at, l.at)) / 30.0), 0) + 0.2 * least(m.n / 30.0, 1.0), 9)"


@query(rf"""with {CF}, f as (select *, lower(trim(regexp_replace(camera_raw, '\s+', ' ', 'g'))) as camera from cf),
 l as (select session_id || '|' || {_GROUP_SQL} as group_id, {_CAL_COLS}, cast(min(date_obs_utc) as date) as at from f where frame_type = 'light' and session_id is not null group by all),
 m as (select frame_type || '|' || {_GROUP_SQL} || '|' || coalesce(cast(cast(date_obs_utc - interval 12 hours as date) as varchar), '?') as master_id, frame_type as kind, {_CAL_COLS}, cast(min(date_obs_utc) as date) as at, count(*) as n from f where frame_type in ('dark', 'flat', 'bias') group by all),
 j as (select l.group_id, m.kind, {_CAL_SCORE} as s, m.master_id, abs(date_diff('day', m.at, l.at)) as days from l join m on l.camera = m.camera and l.binning_x is not distinct from m.binning_x and (
   (m.kind = 'dark' and l.exposure_seconds = m.exposure_seconds and l.gain is not distinct from m.gain and l.offset_adu is not distinct from m.offset_adu and coalesce(abs(l.set_temp - m.set_temp) <= 2.0, true))
   or (m.kind = 'bias' and l.gain is not distinct from m.gain and l.offset_adu is not distinct from m.offset_adu) or (m.kind = 'flat' and l.filter_raw is not distinct from m.filter_raw))),
 b as (select group_id, kind, min(s) as s, first(master_id order by s, master_id) as master_id, first(days order by s, master_id) as days from j group by 1, 2),
 e as (select distinct group_id, unnest(['dark', 'bias', 'flat']) as kind from l),
 r as (select group_id, kind, master_id, round(-s, 6) as score, case when master_id is null then 'missing' when kind = 'flat' and days > 30 then 'stale' else 'complete' end as status from e left join b using (group_id, kind))
select *, case when count(*) filter (where status = 'missing') over w = 3 then 'missing' when count(*) filter (where status = 'missing') over w > 0 then 'partial' when count(*) filter (where status = 'stale') over w > 0 then 'stale' else 'complete' end as group_status from r window w as (partition by group_id)""")
def calibration_match(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "frame_type", "camera_raw", *_MILLI, "filter_raw", "date_obs_utc", "session_id")
    f = cut_lineage(f.withColumn("camera", F.lower(F.trim(F.regexp_replace("camera_raw", r"\s+", " ")))).drop("camera_raw"))
    named = [F.col("camera"), F.col("exposure_seconds").alias("exposure"), F.col("gain"), F.col("offset_adu").alias("offset"), F.col("binning_x").alias("binning"), F.col("set_temp").alias("temp"), F.col("filter_raw").alias("filter")]
    lights = f.where("frame_type = 'light' and session_id is not null").groupBy(_group_key(F.col("session_id")).alias("group_id"), *named).agg(F.min("date_obs_utc").alias("at"))
    night = F.coalesce(scalar.astro_day(F.col("date_obs_utc")).cast("string"), F.lit("?"))
    masters = f.where("frame_type in ('dark', 'flat', 'bias')").groupBy(F.concat_ws("|", _group_key(F.col("frame_type")), night).alias("master_id"), F.col("frame_type").alias("kind"), *named)
    return analytics.match_calibration(lights, masters.agg(F.min("date_obs_utc").alias("at"), F.count(F.lit(1)).alias("sub_count")))


@query(f"""with {CF}, l as (select * from cf where frame_type = 'light')
select distinct 'target' as kind, id as entity_id from l where object_raw is not null and (target_id is null or target_id not in (select id from targets))
union select 'filter', id from l where filter_raw is not null and (filter_id is null or filter_id not in (select id from filters))
union select 'frame_type', id from cf where frame_type = 'unknown' union select 'duplicate', id from files where status = 'duplicate'""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    f = cut_lineage(current(spark, d, "frame_type", "object_raw", "target_id", "filter_raw", "filter_id"))
    return analytics.review_queue(f, *[read_table(spark, d, t) for t in ("files", "filters", "targets")])


@query(f"with {CF} select id as target_id, canonical_name from targets where id not in (select target_id from cf where frame_type = 'light' and target_id is not null)")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "frames").where("frame_type = 'light'").select(F.col("target_id").alias("t"))
    t = read_table(spark, d, "targets")
    return t.join(f, t["id"] == f["t"], "left_anti").select(F.col("id").alias("target_id"), "canonical_name")


@query("""select id, round(degrees(asin(sin(radians(28.3)) * sin(radians(dec_deg)) + cos(radians(28.3)) * cos(radians(dec_deg)) * cos(radians((((280.46061837 + 360.98564736629 * (epoch_us(created_at) / 86400000000.0 + 2440587.5 - 2451545.0) - 16.5) % 360.0) + 360.0) % 360.0) - radians(ra_deg)))), 4) as altitude,
 round(ra_deg, 1) as ra_coarse, round(dec_deg, 1) as dec_coarse from targets""")
def altitudes(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "targets")
    return t.select("id", F.round(scalar.altitude_degrees(F.col("created_at"), F.col("ra_deg"), F.col("dec_deg"), 28.3, -16.5), 4).alias("altitude"), F.round("ra_deg", 1).alias("ra_coarse"), F.round("dec_deg", 1).alias("dec_coarse"))


_DAYS = "(epoch_us(created_at) / 86400000000.0 - 10957.5)"
_SIDEREAL = f"(((280.46061837 + 360.98564736629 * {_DAYS} - 16.5) % 360.0 + 360.0) % 360.0)"
_MOON = f"""m as (select *, {_DAYS} as days from targets),
 e as (select *, radians(218.316 + 13.176396 * days + 6.289 * sin(radians(134.963 + 13.064993 * days))) as lon, radians(5.128 * sin(radians(93.272 + 13.229350 * days))) as lat, radians(23.439) as tilt from m),
 q as (select *, (degrees(atan2(sin(lon) * cos(tilt) - tan(lat) * sin(tilt), cos(lon))) + 360.0) % 360.0 as moon_ra, degrees(asin(sin(lat) * cos(tilt) + cos(lat) * sin(tilt) * sin(lon))) as moon_dec from e)"""


@query(f"""with {_MOON} select id, round((((ra_deg - {_SIDEREAL}) % 360.0 + 360.0) % 360.0) / 15.04106864, 3) as hours_to_transit,
 round(degrees(2 * asin(sqrt(least(pow(sin(radians(moon_dec - dec_deg) / 2), 2) + cos(radians(dec_deg)) * cos(radians(moon_dec)) * pow(sin(radians(moon_ra - ra_deg) / 2), 2), 1.0)))), 3) as moon_separation from q""")
def transits(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "targets")
    moon_ra, moon_dec = scalar.moon_position(F.col("created_at"))
    return t.select("id", F.round(scalar.hours_to_transit(F.col("created_at"), F.col("ra_deg"), -16.5), 3).alias("hours_to_transit"), F.round(scalar.separation_degrees(F.col("ra_deg"), F.col("dec_deg"), moon_ra, moon_dec), 3).alias("moon_separation"))


# ---- search ----------------------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "targets")
    aliases = t.select(F.col("id"), F.posexplode(F.from_json("catalog_ids_json", "array<string>")).alias("k", "alias")).select(F.concat_ws("#", "id", F.col("k").cast("string")).alias("id"), "alias")
    return search.search_entities(t.withColumn("notes", F.col("object_type")), aliases, read_table(spark, d, "sessions"), read_table(spark, d, "filters"))


ENTITIES_SQL = """e as (select 'target' as entity_type, id as entity_id, trim(canonical_name || ' ' || coalesce(display_name, '')) as title, coalesce(object_type, '') as body from targets
 union all select 'alias', id || '#' || (k - 1), l[k], '' from (select id, l, unnest(range(1, len(l) + 1)) as k from (select id, from_json(catalog_ids_json, '["VARCHAR"]') as l from targets))
 union all select 'session', id, coalesce(session_date, ''), coalesce(notes, '') from sessions
 union all select 'filter', id, coalesce(raw_name, ''), coalesce(canonical_name, '') from filters),
 w as (select entity_type, entity_id, 'title' as "column", list_filter(regexp_split_to_array(strip_accents(lower(title)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws, 0 as base from e
  union all select entity_type, entity_id, 'body', list_filter(regexp_split_to_array(strip_accents(lower(body)), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), 1000000 from e),
 p as (select entity_type, entity_id, "column", ws[k] as term, base + k - 1 as position from (select *, unnest(range(1, len(ws) + 1)) as k from w))"""


@query(f"with {ENTITIES_SQL} select entity_type, entity_id, \"column\", term, cast(position as integer) as position from p")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(_entities(spark, d))


def _search_sql(*conditions: str) -> str:
    ctes, joins, score = [], "", []
    for i, c in enumerate(conditions):
        ctes.append(f"m{i} as (select entity_type, entity_id, count(*) as tf from p where {c} group by 1, 2), s{i} as (select m{i}.entity_type, m{i}.entity_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / words)) as s from m{i} join dl using (entity_type, entity_id), (select count(*) as df from m{i}), st)")
        joins += f" join s{i} using (entity_type, entity_id)"
        score.append(f"s{i}.s")
    return f"with {ENTITIES_SQL}, dl as (select entity_type, entity_id, count(*) as dl from p group by 1, 2), st as (select (select count(*) from e) as n, (select count(*) from p) as words), {', '.join(ctes)} select entity_type, entity_id, title, round({' + '.join(score)}, 6) as score from e{joins}"


@query(_search_sql("term = 'cluster'"))
def fts_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_entities(spark, d), "cluster").withColumn("score", F.round("score", 6))


@query(_search_sql("starts_with(term, 'or')", "starts_with(term, '1')"))
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_entities(spark, d), "or* 1*").withColumn("score", F.round("score", 6))


# ---- queue, settings, runs ----------------------------------------------------------------------------------------------------


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("timestamp").alias("started_at"),
    )


JOBS_SQL = "j as (select o_orderkey as id, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'completed' end as status, 6 - cast(o_orderpriority[1] as integer) as priority, o_orderdate as created_at from orders)"


@query(f"with {JOBS_SQL} select id, priority, created_at from j where status = 'queued'")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).where("status = 'queued'").orderBy(*jobs.queue_order()).select("id", "priority", "created_at")


@query(f"with {JOBS_SQL}, c as (select id from j where status = 'queued' order by priority desc, created_at, id limit 1) select id, case when id in (select id from c) then 'running' else status end as status, case when id in (select id from c) then 'w1' end as worker_id from j")
def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim_next(_jobs(spark, d), "w1", F.lit("2026-01-01").cast("timestamp")).select("id", "status", "worker_id")


@query(f"""with {JOBS_SQL}, e as (select *, unnest(['cancel', 'complete', 'fail', 'mark_cancelled', 'requeue']) as event from j)
select id, event, case when event = 'cancel' and status = 'queued' then 'cancelled' when status <> 'running' or event = 'cancel' then status when event = 'complete' then 'completed' when event = 'fail' then 'failed' when event = 'mark_cancelled' then 'cancelled' else 'queued' end as status_after, event = 'cancel' and status in ('queued', 'running') as cancel_requested from e""")
def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = _jobs(spark, d).withColumn("event", F.explode(F.array(*[F.lit(x) for x in ("cancel", "complete", "fail", "mark_cancelled", "requeue")])))
    return e.select("id", "event", jobs.transition(F.col("status"), F.col("event")).alias("status_after"), jobs.cancel_requested(F.col("status"), F.col("event"), F.lit(False)).alias("cancel_requested"))


@query(f"with {JOBS_SQL}, t as (select l_orderkey as id, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by 1) select id, coalesce(n, 0) as files_seen, coalesce(q, 0) as files_added from j left join t using (id)")
def bump_counters(spark: SparkSession, d: str) -> DataFrame:
    deltas = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.lit(1).cast("bigint").alias("files_seen"), F.col("l_quantity").cast("bigint").alias("files_added"))
    zero = _jobs(spark, d).select("id", F.lit(0).cast("bigint").alias("files_seen"), F.lit(0).cast("bigint").alias("files_added"))
    return jobs.bump_counters(zero, deltas, ["files_seen", "files_added"])


@query("""with p as (select id, camera, focal_length, is_user_confirmed from equipment_profiles)
select id, case when is_user_confirmed then null else camera end as camera, case when is_user_confirmed then focal_length else 500.0 end as focal_length from p""")
def patch_update(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "equipment_profiles").select("id", "camera", "focal_length", "is_user_confirmed")
    changes = e.select("id", F.when(F.col("is_user_confirmed"), '{"camera": null}').otherwise('{"focal_length": 500.0}').alias("patch"))
    return jobs.patch(e, changes, "id", ["camera", "focal_length"]).select("id", "camera", "focal_length")


@query("with s as (select user_id as key, props as value_json, ts, event_id from events where user_id is not null) select key, first(value_json order by ts desc, event_id desc) as value_json from s group by 1")
def settings_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value_json"), "ts", "event_id").where("key is not null")
    return files.latest_by(e, ["key"], ["ts", "event_id"]).select("key", "value_json")


@query("select o_orderkey as id, 'scan' as job_type, cast(null as varchar) as payload_json, 0 as priority, o_orderdate as created_at from orders")
def migration_copy(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("scan").alias("job_type"), F.lit(None).cast("string").alias("payload_json"), F.lit(0).alias("priority"), F.col("o_orderdate").alias("created_at"))


@query(f"""with {CF}, r as (select equipment_profile_id as name, cast(date_obs_utc - interval 12 hours as date) as night, count(*) as n from cf where equipment_profile_id is not null and date_obs_utc is not null group by 1, 2),
 c as (select name, avg(n) as value from r where night >= date '2026-03-15' group by 1), b as (select name, avg(n) as value from r where night < date '2026-03-15' group by 1)
select name, round(c.value, 6) as current, round(b.value, 6) as base, round((c.value - b.value) / b.value, 6) as change, case when b.value is null then 'NEW' when c.value is null then 'MISSING' when (c.value - b.value) / b.value < -0.2 then 'REGRESSED' else 'OK' end as status from c full join b using (name)""")
def bench_compare(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "equipment_profile_id", "date_obs_utc").where("equipment_profile_id is not null and date_obs_utc is not null")
    r = f.groupBy(F.col("equipment_profile_id").alias("name"), scalar.astro_day(F.col("date_obs_utc")).alias("night")).agg(F.count(F.lit(1)).alias("n"))
    half = lambda cond: r.where(cond).groupBy("name").agg(F.avg("n").alias("value"))
    c = rollups.compare_runs(half("night >= date '2026-03-15'"), half("night < date '2026-03-15'"))
    return c.select("name", *[F.round(x, 6).alias(x) for x in ("current", "base", "change")], "status")


@query("""with r as (select id, updated_at, fwhm, session_id, object_raw from frames where id is not null)
select id, epoch_us(max(updated_at)) as updated_at, first(fwhm order by updated_at desc, fwhm desc) filter (where fwhm is not null) as fwhm, first(session_id order by updated_at desc, session_id desc) filter (where session_id is not null) as session_id, first(object_raw order by updated_at desc, object_raw desc) filter (where object_raw is not null) as object_raw from r group by 1""")
def sync_lww(spark: SparkSession, d: str) -> DataFrame:
    return micros(rollups.last_writer_wins(read_table(spark, d, "frames"), "id", "updated_at", ["fwhm", "session_id", "object_raw"]))


# ---- generator ----------------------------------------------------------------------------------------------------------------


@query(None)
def generated_frames(spark: SparkSession, d: str) -> DataFrame:
    """As many synthetic frames as there are frames, with the weights of the 40 most imaged targets in them; all else is fixed."""
    f = read_table(spark, d, "frames").where("frame_type = 'light'")
    top = [(r.k, float(r.n)) for r in f.where("target_id is not null").groupBy(F.col("target_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(40).collect()]
    total = sum(n for _, n in top) or 1.0
    index = spark.range(read_table(spark, d, "frames").count()).select(F.col("id").alias("i"))
    return generator.frames(index, seed=1, objects=[(k, n / total) for k, n in top] or [("none", 1.0)], filters=generator.parse_weights("Ha:0.4,OIII:0.3,SII:0.3"), types=generator.parse_weights("LIGHT:0.8,DARK:0.1,FLAT:0.1"), exposures=[(120.0, 1 / 3), (300.0, 1 / 3), (600.0, 1 / 3)], nights=10, start="2026-01-01")


@query("select cast(least(floor(i * s + s / 2), n - 1) as bigint) as i from (select unnest(range(0, cast(floor(n / 100) as bigint))) as i, n, n / floor(n / 100) as s from (select count(*) as n from frames))")
def corrupt_indices(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "frames").count()
    return generator.corrupt_indices(spark.range(n).select(F.col("id").alias("i")), n, n // 100)


# ---- streams ---------------------------------------------------------------------------------------------------------------


DEBOUNCE_SQL = """with e as (select user_id as key, ts as t from events where user_id is not null and ts is not null),
 g as (select *, case when epoch_us(t) - epoch_us(lag(t) over (partition by key order by t)) <= 1800000000 then 0 else 1 end as fresh from e),
 s as (select *, sum(fresh) over (partition by key order by t rows unbounded preceding) as n from g)
select key, epoch_us(min(t)) as first_event, epoch_us(max(t)) + 1800000000 as fired_at, count(*) as events from s group by key, n"""


@query(DEBOUNCE_SQL)
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    return micros(streams.debounce(read_table(spark, d, "events"), key="user_id", time="ts", quiet="30 minutes"))


@query(None)
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream over the events, read to its end; rows come out once the watermark has passed them."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = streams.debounce(stream, key="user_id", time="ts", quiet="30 minutes", late="1 hour")
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


# ---- facets and exports ----------------------------------------------------------------------------------------------------


@query(f"""with {CF} select target_id, count(*) as frame_count, round(sum(exposure_seconds), 3) as total_seconds, epoch_us(max(date_obs_utc)) as last_imaged from cf
where target_id is not null and frame_type in ('light', 'flat') and date_obs_utc >= timestamptz '2026-03-01 00:00:00+00' and file_id in (select id from files where status <> 'missing') group by 1 having round(sum(exposure_seconds), 3) >= 3600""")
def faceted_targets(spark: SparkSession, d: str) -> DataFrame:
    f = current(spark, d, "target_id", "frame_type", "file_id", "filter_id", "equipment_profile_id", "exposure_seconds", "date_obs_utc")
    return micros(export.facets(f, types=["light", "flat"], since="2026-03-01 00:00:00", least_seconds=3600, present_files=read_table(spark, d, "files")))


@query("select id, true as valid, true as in_order from files where created_at is not null")
def time_ordered_ids(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "files").where("created_at is not null").select("id", "created_at").withColumn("new_id", export.uuidv7(F.col("created_at")))
    ms = F.conv(F.replace(F.substring("new_id", 1, 13), F.lit("-"), F.lit("")), 16, 10).cast("bigint")
    return f.select("id", scalar.is_uuid(F.col("new_id")).alias("valid"), (ms == F.unix_millis("created_at")).alias("in_order"))
