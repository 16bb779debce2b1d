"""Incremental state of the files table: discovery, missing files, duplicate groups and moves, each as DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["watch_folder_id", "relative_path"]


def upsert_discovered(files: DataFrame, seen: DataFrame, seen_at: Column) -> DataFrame:
    """State after a scan: `seen(watch_folder_id, relative_path, filename, extension, size_bytes, file_mtime)` merged into `files`.

    A new path is inserted as present; an unchanged file only moves `updated_at`; a changed one (size or time of change, NULL equals
    NULL) takes the new facts and loses its hash; a duplicate stays a duplicate; a missing file is present again.  Files that were
    not seen stay as they are.  Adds is_new, changed, was_restored (all false where not seen).  Paths seen twice count
    once, with the latest change; rows without folder or path are ignored.  (K3, J1, J2)
    """
    latest = seen.where("watch_folder_id is not null and relative_path is not null").groupBy(*KEY).agg(
        F.max(F.struct(F.col("file_mtime"), F.col("size_bytes"), F.col("filename"), F.col("extension"))).alias("s")
    )
    j = files.withColumn("_was", F.lit(True)).join(latest.withColumn("_seen", F.lit(True)), KEY, "full_outer")
    was, now = F.coalesce("_was", F.lit(False)), F.coalesce("_seen", F.lit(False))
    differs = ~(F.col("size_bytes").eqNullSafe(F.col("s.size_bytes")) & F.col("file_mtime").eqNullSafe(F.col("s.file_mtime")))
    fresh, touched = ~was & now, was & now
    changed = fresh | (touched & (differs | (F.col("status") == "missing")))
    return j.select(
        F.when(fresh, F.sha2(F.concat_ws("/", *KEY), 256)).otherwise(F.col("id")).alias("id"),
        *KEY,
        F.coalesce("filename", "s.filename").alias("filename"),
        F.coalesce("extension", "s.extension").alias("extension"),
        F.when(now, F.col("s.size_bytes")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(now, F.col("s.file_mtime")).otherwise(F.col("file_mtime")).alias("file_mtime"),
        F.when(touched & differs, None).otherwise(F.col("sha256")).alias("sha256"),
        F.when(fresh, "present").when(touched & (F.col("status") != "duplicate"), "present").otherwise(F.col("status")).alias("status"),
        F.when(now, seen_at).otherwise(F.col("updated_at")).alias("updated_at"),
        fresh.alias("is_new"),
        (now & F.coalesce(changed, F.lit(False))).alias("changed"),
        (touched & (F.col("status") == "missing")).alias("was_restored"),
    )


def mark_missing(files: DataFrame, cutoff: Column, folder: str | None = None, last_seen: str = "updated_at") -> DataFrame:
    """Present files last seen before the cutoff become missing; of one folder, or of all (K4)."""
    gone = (F.col("status") == "present") & (F.col(last_seen) < cutoff)
    if folder is not None:
        gone &= F.col("watch_folder_id") == folder
    return files.withColumn("status", F.when(gone, "missing").otherwise(F.col("status")))


def resolve_duplicates(files: DataFrame, first_seen: str = "created_at") -> DataFrame:
    """Live files of equal hash: the first seen (then the smallest id) is present, the others are its duplicates.

    One shuffle on the hash; map-side aggregation finds each group's first file, so that a hash of a third of all rows is no
    hot window, and the result joins back.  Files without hash or missing files stay as they are, duplicate_of NULL.
    """
    live = F.col("status").isin("present", "duplicate") & F.col("sha256").isNotNull()
    first = files.where(live).groupBy(F.col("sha256").alias("g_sha")).agg(F.min(F.struct(F.col(first_seen).alias("at"), F.col("id").alias("id"))).alias("first"))
    j = files.join(first, live & (F.col("sha256") == F.col("g_sha")), "left")
    other = F.col("first").isNotNull() & (F.col("first.id") != F.col("id"))
    return j.select(
        *[F.col(c) for c in files.columns if c != "status"],
        F.when(F.col("first").isNull(), F.col("status")).when(other, "duplicate").otherwise("present").alias("status"),
        F.when(other, F.col("first.id")).alias("duplicate_of_id"),
    )


def unhashed(files: DataFrame, n: int) -> DataFrame:
    """The `n` files to hash next: present or duplicate without hash, first seen first (O1)."""
    return files.where(F.col("sha256").isNull() & F.col("status").isin("present", "duplicate")).orderBy("created_at", "id").limit(n)


def in_watch_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """`files` with their whole path as relative_path; files without a known folder are left out."""
    at = folders.where("path is not null").select(F.col("id").alias("_folder"), F.col("path").alias("_path"))
    j = files.join(at, F.col("watch_folder_id") == F.col("_folder"))
    return j.withColumn("relative_path", F.concat_ws("/", F.rtrim("_path", F.lit("/")), "relative_path")).drop("_folder", "_path")


def name_ids(rows: DataFrame, name: str, known: DataFrame, known_name: str, as_: str) -> DataFrame:
    """`rows` with the id of the entry of that name (the smallest of several), NULL for none."""
    ids = known.where(F.col(known_name).isNotNull()).groupBy(F.col(known_name).alias("_name")).agg(F.min("id").alias(as_))
    return rows.join(ids, F.col(name) == F.col("_name"), "left").drop("_name")


def match_moves(new: DataFrame, missing: DataFrame) -> DataFrame:
    """(new_id, file_id): new files that are missing ones at another place.

    Sizes are compared first, by a semi-join, so that only new files of a missing file's size need a hash; then hash and size.
    Of several missing files the smallest id is taken, of several new files of one missing file the smallest path.
    """
    lost = missing.where("status = 'missing' and sha256 is not null").select(F.col("id").alias("file_id"), F.col("size_bytes").alias("l_size"), F.col("sha256").alias("l_sha"))
    sized = new.join(lost.select("l_size").distinct(), F.col("size_bytes") == F.col("l_size"), "left_semi").where("sha256 is not null")
    hits = sized.join(lost, (F.col("size_bytes") == F.col("l_size")) & (F.col("sha256") == F.col("l_sha")))
    one = hits.groupBy(F.col("id").alias("new_id"), "relative_path").agg(F.min("file_id").alias("file_id"))
    return one.groupBy("file_id").agg(F.min(F.struct("relative_path", "new_id")).alias("w")).select("w.new_id", "file_id")


def reparent(files: DataFrame, moves: DataFrame, new: DataFrame) -> DataFrame:
    """Missing rows take over the place of their new file and are present again; rows not missing are left alone (K7)."""
    place = moves.join(new.select(F.col("id").alias("new_id"), F.col("watch_folder_id").alias("n_folder"), F.col("relative_path").alias("n_path"), F.col("filename").alias("n_name")), "new_id").drop("new_id")
    j = files.join(place, files["id"] == place["file_id"], "left")
    moved = F.col("file_id").isNotNull() & (F.col("status") == "missing")
    take = {"watch_folder_id": "n_folder", "relative_path": "n_path", "filename": "n_name"}
    return j.select(*[F.when(moved, F.col(take[c])).otherwise(F.col(c)).alias(c) if c in take else F.when(moved, "present").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in files.columns])


def scan_counters(upserted: DataFrame, errors: Column) -> DataFrame:
    """One row: files seen, added, updated and in error (A4)."""
    return upserted.agg(
        F.count(F.lit(1)).alias("files_seen"), F.count_if("is_new").alias("files_added"), F.count_if(F.col("changed") & ~F.col("is_new")).alias("files_updated"), F.count_if(errors).alias("files_errored")
    )


def latest_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order` columns: keep-latest of an upsert by natural key.

    An aggregation with a map-side part, so that a hot key is no window of its own.
    """
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
