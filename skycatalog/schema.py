"""Table schemas of the catalog with their constraints, and checks that report violations as rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = "id string, created_at timestamp, updated_at timestamp"
SCHEMAS = {
    "watch_folders": f"{BASE}, path string, drive_label string, is_active boolean, last_scan_at timestamp, skip_patterns string, live_watch_enabled boolean",
    "files": f"{BASE}, watch_folder_id string, relative_path string, filename string, extension string, size_bytes bigint, sha256 string, file_mtime timestamp, first_seen_at timestamp, last_seen_at timestamp, status string, parse_error string, duplicate_of_id string",
    "filters": f"{BASE}, raw_name string, canonical_name string, band_type string",
    "frames": f"{BASE}, file_id string, frame_type string, frame_type_source string, object_raw string, target_id string, filter_raw string, filter_id string, exposure_seconds double, date_obs_utc timestamp, telescope_raw string, camera_raw string, equipment_profile_id string, ccd_temp double, set_temp double, gain double, offset_adu double, binning_x int, binning_y int, width_px int, height_px int, ra_deg double, dec_deg double, focal_length double, aperture double, pier_side string, airmass double, observer string, site_name string, bayer_pattern string, fwhm double, hfr double, star_count int, session_id string, headers_json string",
    "targets": f"{BASE}, canonical_name string, display_name string, catalog_ids_json string, ra_deg double, dec_deg double, object_type string, constellation string, status string, notes string, thumbnail_frame_id string",
    "target_aliases": f"{BASE}, target_id string, alias_normalized string, source string",
    "sessions": f"{BASE}, session_date string, started_at_utc timestamp, ended_at_utc timestamp, equipment_profile_id string, notes string, weather_notes string",
    "equipment_profiles": f"{BASE}, name string, telescope string, camera string, focal_length double, aperture double, pixel_size double, is_user_confirmed boolean",
    "master_frames": f"{BASE}, file_id string, master_type string, camera_raw string, equipment_profile_id string, filter_id string, exposure_seconds double, ccd_temp double, gain double, offset_adu double, binning_x int, binning_y int, created_date string, sub_count int, notes string",
    "master_frame_subs": f"{BASE}, master_frame_id string, frame_id string",
    "processing_projects": f"{BASE}, target_id string, name string, version_label string, status string, software string, notes string",
    "project_inputs": f"{BASE}, project_id string, input_type string, frame_id string, master_frame_id string",
    "processed_images": f"{BASE}, project_id string, file_id string, format string, is_final boolean, published_url string",
    "scan_jobs": f"{BASE}, watch_folder_id string, job_type string, status string, files_seen bigint, files_added bigint, files_updated bigint, files_errored bigint, payload_json string, progress_current bigint, progress_total bigint, progress_message string, priority int, worker_id string, claimed_at timestamp, cancel_requested boolean, started_at timestamp, finished_at timestamp, error string",
    "thumbnails": f"{BASE}, frame_id string, cache_path string, generated_at timestamp",
    "settings": "key string, value_json string",
}


@dataclass(frozen=True)
class Rules:
    """Constraints of a table: allowed values by column (NULL passes), unique keys, references (column, table), and conditions by name."""

    allowed: dict[str, list[str]] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)
    references: list[tuple[str, str]] = field(default_factory=list)
    conditions: dict[str, str] = field(default_factory=dict)


# The constraints of each table; every table with an id has a unique one.
RULES = {
    "watch_folders": Rules({}, [["id"], ["path"]]),
    "files": Rules({"status": ["present", "missing", "duplicate"]}, [["id"], ["watch_folder_id", "relative_path"]], [("watch_folder_id", "watch_folders"), ("duplicate_of_id", "files")]),
    "frames": Rules(
        {"frame_type": ["light", "dark", "flat", "bias", "darkflat", "unknown"], "frame_type_source": ["header", "path_heuristic", "manual"]},
        [["id"], ["file_id"]],
        [("file_id", "files"), ("target_id", "targets"), ("filter_id", "filters"), ("session_id", "sessions"), ("equipment_profile_id", "equipment_profiles")],
    ),
    "targets": Rules({"status": ["planning", "capturing", "ready", "processed", "complete"]}, [["id"]], [("thumbnail_frame_id", "frames")]),
    "target_aliases": Rules({"source": ["builtin", "user"]}, [["id"], ["target_id", "alias_normalized"]], [("target_id", "targets")]),
    "filters": Rules({}, [["id"]]),
    "sessions": Rules({}, [["id"]], [("equipment_profile_id", "equipment_profiles")]),
    "equipment_profiles": Rules({}, [["id"]]),
    "master_frames": Rules({"master_type": ["dark", "flat", "bias", "darkflat"]}, [["id"]], [("file_id", "files"), ("equipment_profile_id", "equipment_profiles"), ("filter_id", "filters")]),
    "master_frame_subs": Rules({}, [["id"], ["master_frame_id", "frame_id"]], [("master_frame_id", "master_frames"), ("frame_id", "frames")]),
    "processing_projects": Rules({}, [["id"]], [("target_id", "targets")]),
    "project_inputs": Rules(
        {"input_type": ["frame", "master_frame"]},
        [["id"], ["project_id", "frame_id", "master_frame_id"]],
        [("project_id", "processing_projects"), ("frame_id", "frames"), ("master_frame_id", "master_frames")],
        {"exactly one input": "(input_type = 'frame') = (frame_id is not null) and (input_type = 'master_frame') = (master_frame_id is not null)"},
    ),
    "processed_images": Rules({}, [["id"]], [("project_id", "processing_projects"), ("file_id", "files")]),
    "scan_jobs": Rules({"status": ["queued", "running", "completed", "failed", "cancelled"]}, [["id"]], [("watch_folder_id", "watch_folders")]),
    "thumbnails": Rules({}, [["id"], ["frame_id"]], [("frame_id", "frames")]),
    "settings": Rules({}, [["key"]]),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table's schema: absent ones as NULL, others dropped, types cast."""
    empty = df.sparkSession.createDataFrame([], SCHEMAS[table])
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema])


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, key): one row a violation: values not allowed, keys that are not unique, references to nothing.

    References to tables that are not given, and rules of columns that a table lacks, are not checked.
    """
    out = []

    def add(rows: DataFrame, table: str, rule: str, key: Column) -> None:
        out.append(rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key")))

    for name, df in tables.items():
        r = RULES.get(name, Rules())
        for c, values in r.allowed.items():
            if c not in df.columns:
                continue
            add(df.where(F.col(c).isNotNull() & ~F.col(c).isin(values)), name, f"check {c}", F.col("id"))
        for rule, condition in r.conditions.items():
            add(df.where(f"not coalesce({condition}, false)"), name, rule, F.col("id"))
        for key in r.unique:
            known = df.dropna(subset=key)
            add(known.groupBy(*key).count().where("count > 1"), name, f"unique {','.join(key)}", F.concat_ws("|", *key))
        for c, other in r.references:
            if other in tables and c in df.columns:
                known = df.where(F.col(c).isNotNull()).select(F.col(c).alias("_ref")).distinct()
                add(known.join(tables[other].select(F.col("id").alias("_id")), F.col("_ref") == F.col("_id"), "left_anti"), name, f"reference {c}", F.col("_ref"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total
