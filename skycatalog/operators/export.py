"""Faceted views, provenance, exports and run files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
# Keys and units of a baseline file.
BASELINE = ["schemaVersion", "generatedAt", "results"]
METRIC = ["name", "unit", "value", "higherIsBetter", "samples"]
RATE_UNITS = ["rows/sec", "queries/sec", "headers/sec", "files/sec"]


def uuidv7(at: Column) -> Column:
    """Time-ordered identifier: 48 bits of milliseconds, version 7, the rest random.

    In order of `at` to the millisecond; within one, and between executors, order is not defined.
    """
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    r = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))  # its 13th and 17th digits are fixed and replaced
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(r, 1, 3)), F.concat(F.substring(r, 17, 1), F.substring(r, 4, 3)), F.substring(r, 21, 12))


def facets(
    frames: DataFrame,
    *,
    types: list[str] | None = None,
    filters: list[str] | None = None,
    rigs: list[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    least_seconds: float | None = None,
    present_files: DataFrame | None = None,
    finals: DataFrame | None = None,
) -> DataFrame:
    """Targets by all facets that are given: (target_id, frame_count, total_seconds, last_imaged).

    `present_files` leaves frames of missing files out, `finals` those of files that a final image is linked to.  Predicates on frames reach the scan; the threshold is on the sums.
    """
    f = frames.where("target_id is not null")
    for column, values in (("frame_type", types), ("filter_id", filters), ("equipment_profile_id", rigs)):
        if values is not None:
            f = f.where(F.col(column).isin(values))
    if since is not None:
        f = f.where(F.col("date_obs_utc") >= F.lit(since).cast("timestamp"))
    if until is not None:
        f = f.where(F.col("date_obs_utc") < F.lit(until).cast("timestamp"))
    if present_files is not None:
        here = present_files.where("status <> 'missing'").select(F.col("id").alias("_file"))
        f = f.join(here, F.col("file_id") == F.col("_file"), "left_semi")
    if finals is not None:
        linked = finals.where("is_final and file_id is not null").select(F.col("file_id").alias("_final"))
        f = f.join(linked, F.col("file_id") == F.col("_final"), "left_anti")
    g = f.groupBy("target_id").agg(F.count(F.lit(1)).alias("frame_count"), F.round(F.sum("exposure_seconds"), 3).alias("total_seconds"), F.max("date_obs_utc").alias("last_imaged"))
    return g if least_seconds is None else g.where(F.col("total_seconds") >= least_seconds)


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of a totally ordered result."""
    return rows.orderBy(*order).offset(offset).limit(size)


def trace_back(images: DataFrame, projects: DataFrame, inputs: DataFrame, frames: DataFrame, masters: DataFrame, subs: DataFrame) -> DataFrame:
    """(image_id, project_id, frame_id, via): every frame that a final image goes back to, as an input or by a master frame."""
    p = images.where("is_final").select(F.col("id").alias("image_id"), "project_id").join(projects.select(F.col("id").alias("project_id")), "project_id")
    i = p.join(inputs.select("project_id", "frame_id", "master_frame_id"), "project_id")
    direct = i.where("frame_id is not null").select("image_id", "project_id", "frame_id", F.lit("input").alias("via"))
    by_master = i.where("master_frame_id is not null").drop("frame_id").join(masters.select(F.col("id").alias("master_frame_id")), "master_frame_id").join(subs.select("master_frame_id", "frame_id"), "master_frame_id")
    every = direct.unionByName(by_master.select("image_id", "project_id", "frame_id", F.lit("master").alias("via")))
    return every.join(frames.select(F.col("id").alias("frame_id")), "frame_id").select("image_id", "project_id", "frame_id", "via").distinct()


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; every part starts with the byte order mark, as spreadsheet programs want it (K27). Refuses an existing folder."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias(BOM + first), *rest).write.mode("errorifexists").csv(path, header=True, quoteAll=False, escape='"')


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, unit, value): metrics of a baseline file; anything but its exact layout is an error.

    The layout: schemaVersion 1, generatedAt in UTC to the millisecond, and results with exactly the keys of METRIC; a rate unit, positive
    finite numbers, at least one sample, no name twice.
    """
    wrong = lambda bad, what, value: F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit(f"bad baseline: {what} "), F.coalesce(value, F.lit("?"))))).otherwise(value)
    keys = lambda c: F.array_sort(F.map_keys(F.from_json(c, "map<string,string>")))
    exactly = lambda names: F.array(*[F.lit(n) for n in sorted(names)])
    finite = lambda c: (c > 0) & (c < float("inf"))
    t = spark.read.text(path, wholetext=True).withColumn("top", F.from_json("value", "map<string,string>"))
    good = (keys(F.col("value")) == exactly(BASELINE)) & (F.col("top.schemaVersion") == "1") & F.col("top.generatedAt").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & F.try_to_timestamp("top.generatedAt").isNotNull()
    t = t.select(wrong(~good, "file", F.col("value")).alias("value")).select(F.explode(F.from_json(F.from_json("value", "map<string,string>")["results"], "array<string>")).alias("raw"))
    kind = "struct<name: string, unit: string, value: double, higherIsBetter: boolean, samples: array<double>>"
    m = t.withColumn("m", F.from_json("raw", kind))
    metric = (keys(F.col("raw")) == exactly(METRIC)) & (F.length("m.name") > 0) & F.col("m.unit").isin(RATE_UNITS) & F.col("m.higherIsBetter") & finite(F.col("m.value")) & (F.size("m.samples") > 0) & F.forall("m.samples", finite)
    m = m.select(wrong(~metric, "metric", F.col("raw")).alias("raw")).select(F.from_json("raw", kind).alias("m")).select("m.name", "m.unit", "m.value")
    g = m.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"), F.first("value").alias("value"))
    return g.select(wrong(F.col("n") > 1, "repeated name", F.col("name")).alias("name"), "unit", "value")


def change_label(change: Column) -> Column:
    """A change as a signed percentage with one decimal, '-' for none."""
    return F.when(change.isNull(), F.lit("-")).otherwise(F.format_string("%+.1f%%", change * 100))


def rate(units: Column, elapsed_ms: Column) -> Column:
    """Units a second; NULL for no time."""
    return F.when(elapsed_ms > 0, units / (elapsed_ms / 1000.0))
