"""The job queue as a table: ordering, claiming and the transitions of its life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ["completed", "failed", "cancelled"]


def queue_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("created_at").asc(), F.col("id").asc()]


def claim_next(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """Jobs after one worker claimed the next queued one: running, with worker and times; started_at only if unset."""
    pick = jobs.where("status = 'queued'").orderBy(*queue_order()).limit(1).select(F.col("id").alias("c_id"))
    j = jobs.join(F.broadcast(pick), jobs["id"] == F.col("c_id"), "left")
    hit = F.col("c_id").isNotNull()
    return j.select(
        *[F.col(c) for c in jobs.columns if c not in ("status", "worker_id", "started_at")],
        F.when(hit, "running").otherwise(F.col("status")).alias("status"),
        F.when(hit, worker).otherwise(F.col("worker_id")).alias("worker_id"),
        F.when(hit, F.coalesce("started_at", now)).otherwise(F.col("started_at")).alias("started_at"),
    )


def transition(status: Column, event: Column) -> Column:
    """Status after an event: cancel, complete, fail, mark_cancelled, requeue; events that do not apply change nothing."""
    return (
        F.when((event == "cancel") & (status == "queued"), "cancelled")
        .when((event == "complete") & (status == "running"), "completed")
        .when((event == "fail") & (status == "running"), "failed")
        .when((event == "mark_cancelled") & (status == "running"), "cancelled")
        .when((event == "requeue") & (status == "running"), "queued")
        .otherwise(status)
    )


def cancel_requested(status: Column, event: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | ((event == "cancel") & status.isin("queued", "running"))


def bump_counters(jobs: DataFrame, deltas: DataFrame, columns: list[str]) -> DataFrame:
    """Adds all deltas of a job at once; NULL counts as 0."""
    total = deltas.groupBy(F.col("job_id").alias("d_id")).agg(*[F.sum(c).alias(f"d_{c}") for c in columns])
    j = jobs.join(total, jobs["id"] == F.col("d_id"), "left")
    return j.select(*[(F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) if c in columns else F.col(c) for c in jobs.columns])


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Tri-state update: a column absent from the JSON object `changes.patch` stays, an explicit null is written."""
    c = changes.select(F.col(key).alias("p_key"), F.try_parse_json("patch").alias("p")).where("p_key is not null")
    j = rows.join(c, rows[key] == F.col("p_key"), "left")
    given = F.coalesce(F.json_object_keys(F.col("p").cast("string")), F.array().cast("array<string>"))
    kinds = dict(rows.dtypes)
    return j.select(*[F.when(F.array_contains(given, x), F.try_variant_get("p", f"$['{x}']", kinds[x])).otherwise(F.col(x)).alias(x) if x in columns else rows[x] for x in rows.columns])


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Queued jobs appended for requests whose payload is NULL or valid JSON."""
    ok = requests.where(F.col("payload_json").isNull() | F.try_parse_json("payload_json").isNotNull())
    new = ok.select(F.sha2(F.concat_ws("|", "job_type", F.coalesce("watch_folder_id", F.lit("")), F.coalesce("payload_json", F.lit(""))), 256).alias("id"), "job_type", "watch_folder_id", "payload_json", F.coalesce("priority", F.lit(0)).alias("priority"), F.lit("queued").alias("status"), now.alias("created_at"))
    return jobs.unionByName(new, allowMissingColumns=True)
