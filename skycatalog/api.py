"""One object with the catalog's verbs; every query is a DataFrame, every change a new snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycatalog import schema
from skycatalog.functions import scalar
from skycatalog.operators import analytics, export, files, frames, jobs, rollups, search
from skycatalog.session import cut_lineage, ship_package
from skycatalog.sources import headers
from skycatalog.store import SnapshotStore
from skycatalog.streaming import debounce


class Catalog:
    """Tables of a catalog below `root` (E8, Appendix B of the survey)."""

    def __init__(self, spark: SparkSession, root: str):
        ship_package(spark)
        self.spark, self.store = spark, SnapshotStore(spark, root)

    def table(self, name: str) -> DataFrame:
        if name in self.store.current():
            return self.store.read(name)
        return self.spark.createDataFrame([], schema.SCHEMAS[name])

    # ---- generic rows
    def get(self, name: str, id_: str) -> DataFrame:
        return self.table(name).where(F.col("id") == id_)

    def insert(self, name: str, rows: DataFrame) -> None:
        now = F.current_timestamp()
        new = rows if "id" in rows.columns else rows.withColumn("id", export.uuidv7(now))
        self.store.commit({name: self.table(name).unionByName(schema.conform(new.withColumn("created_at", now).withColumn("updated_at", now), name))})

    def update(self, name: str, changes: DataFrame, columns: list[str]) -> None:
        """`changes(id, patch)`: only the columns given in the JSON object `patch` change."""
        self.store.commit({name: jobs.patch(self.table(name), changes, "id", columns)})

    def delete(self, name: str, ids: DataFrame) -> None:
        self.store.commit({name: self.table(name).join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")})

    def setting(self, key: str) -> DataFrame:
        return self.table("settings").where(F.col("key") == key).select(F.try_parse_json("value_json").alias("value"))

    def set_setting(self, key: str, value: object) -> None:
        new = self.spark.createDataFrame([(key, json.dumps(value))], schema.SCHEMAS["settings"])
        self.store.commit({"settings": self.table("settings").where(F.col("key") != key).unionByName(new)})

    # ---- scanning
    def scan(self, folder_id: str, root: str, skip: list[str] | None = None) -> DataFrame:
        """Walk, parse what is new or changed, merge files and frames, mark what is gone; returns the counters."""
        return self._merge(folder_id, root, headers.walk(self.spark, root, skip), whole=True)

    def ingest(self, folder_id: str, root: str, checkpoint: str, skip: list[str] | None = None, *, once: bool = True, existing: bool = True):
        """Starts a stream that merges what comes or changes below `root`, each micro-batch as a scan does; nothing is marked missing.

        Merging is by path, so a repeated batch does no harm.  One writer at a time: no scan may run beside it.
        """
        found = headers.watch(self.spark, root, skip, existing=existing)
        return debounce.ingest(found, lambda batch, _: self._merge(folder_id, root, batch.drop("is_stable"), whole=False), checkpoint, once=once)

    def _merge(self, folder_id: str, root: str, found: DataFrame, *, whole: bool) -> DataFrame:
        old = self.table("files")
        walked = found.withColumn("watch_folder_id", F.lit(folder_id))
        seen_at = F.lit(self.spark.range(1).select(F.current_timestamp()).first()[0])
        # walk and heads are read once: three tables are written from them
        state = cut_lineage(files.upsert_discovered(schema.conform(old, "files").select("id", *files.KEY, "filename", "extension", "size_bytes", "file_mtime", "sha256", "status", "updated_at"), walked, seen_at))
        # the join with what is known comes before the parser, so unchanged files are never opened
        todo = state.where(F.col("changed") & (F.col("watch_folder_id") == folder_id)).select("id", "relative_path", "extension")
        parsed = cut_lineage(headers.scan_files(todo, root))
        rec = frames.frame_records(parsed.where("status = 'ok'"), "headers_json", ["id", "relative_path", "headers_json"], format=F.col("format"))
        kind, source = scalar.classify(F.col("image_type"), F.col("relative_path"))
        new = rec.select(
            F.col("id").alias("file_id"), kind.alias("frame_type"), source.alias("frame_type_source"), F.col("object").alias("object_raw"), F.col("filter").alias("filter_raw"), "exposure_seconds",
            frames.date_obs_utc(F.col("date_obs")).alias("date_obs_utc"), F.col("telescope").alias("telescope_raw"), F.col("instrument").alias("camera_raw"), "ccd_temp", "set_temp", "gain", F.col("offset").alias("offset_adu"),
            *[F.col(c).cast("int").alias(c) for c in ("binning_x", "binning_y", "width_px", "height_px")], "ra_deg", "dec_deg", "focal_length", "aperture", "pier_side", "airmass", "observer", "site_name", "bayer_pattern", "headers_json",
        )
        errors = parsed.where("status = 'error'").select(F.col("id").alias("e_id"), F.concat_ws(": ", "error_code", "error_message").alias("parse_error"))
        merged = state.join(errors, F.col("id") == F.col("e_id"), "left").drop("e_id")
        kept = old.select(F.col("id").alias("o_id"), F.col("created_at"), F.col("first_seen_at"))
        table = merged.join(kept, F.col("id") == F.col("o_id"), "left").withColumn("created_at", F.coalesce("created_at", seen_at)).withColumn("first_seen_at", F.coalesce("first_seen_at", seen_at)).withColumn("last_seen_at", F.col("updated_at"))
        table = files.mark_missing(table, seen_at, folder_id) if whole else table
        self.store.commit({"files": schema.conform(table, "files"), "frames": schema.conform(frames.upsert_frames(self.table("frames"), new), "frames"), "scan_result": table.select("is_new", "changed", "was_restored", "parse_error")})
        return files.scan_counters(self.store.read("scan_result"), F.col("parse_error").isNotNull())

    def watched_folders(self) -> DataFrame:
        """Folders that are active and watched live."""
        return self.table("watch_folders").where("is_active and live_watch_enabled")

    def hash_backlog(self, root: str | None = None, n: int = 500) -> None:
        """Hashes up to `n` files and resolves duplicate groups; without `root` the files lie in their watch folders."""
        old = self.table("files")
        todo = files.unhashed(old, n)
        if root is None:
            todo, root = files.in_watch_folders(todo, self.table("watch_folders")), "/"
        done = headers.hash_files(todo.select("id", "relative_path"), root).where("sha256 is not null").select(F.col("id").alias("h_id"), F.col("sha256").alias("h"))
        with_hash = old.join(done, F.col("id") == F.col("h_id"), "left").withColumn("sha256", F.coalesce("h", "sha256")).drop("h_id", "h", "duplicate_of_id")
        self.store.commit({"files": schema.conform(files.resolve_duplicates(with_hash), "files")})

    # ---- queries
    def frames(self, target_id: str | None = None, session_id: str | None = None, frame_type: str | None = None) -> DataFrame:
        f = self.table("frames")
        for c, v in (("target_id", target_id), ("session_id", session_id), ("frame_type", frame_type)):
            if v is not None:
                f = f.where(F.col(c) == v)
        return f

    def rollup(self) -> DataFrame:
        return rollups.integration(self.table("frames"), ["target_id", "filter_id", "frame_type"])

    def search(self, text: str) -> DataFrame:
        aliases = self.table("target_aliases").select("id", F.col("alias_normalized").alias("alias"))
        return search.search(search.search_entities(self.table("targets"), aliases, self.table("sessions"), self.table("filters")), text)

    def dashboard(self) -> DataFrame:
        return analytics.dashboard(self.table("frames"), self.table("files"))

    def violations(self) -> DataFrame:
        return schema.violations({t: self.table(t) for t in schema.RULES})
