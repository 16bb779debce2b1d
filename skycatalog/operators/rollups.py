"""Integration-time rollups and the statistics built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def integration(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds and number of light frames by `keys`, most seconds first, then in order of the keys (A1, A3, O3)."""
    sums = frames.where("frame_type = 'light'").groupBy(*keys).agg(F.round(F.sum("exposure_seconds"), 3).alias("total_seconds"), F.count(F.lit(1)).alias("frame_count"))
    return sums.orderBy(F.desc_nulls_last("total_seconds"), *keys)


def most_imaged(frames: DataFrame) -> DataFrame:
    """The target with most light frames, the first id among equals (A2)."""
    return frames.where("frame_type = 'light' and target_id is not null").groupBy("target_id").agg(F.count(F.lit(1)).alias("frame_count")).orderBy(F.desc("frame_count"), "target_id").limit(1)


def drill_down(frames: DataFrame) -> DataFrame:
    """Seconds and frames by filter of the most imaged target, most seconds first (A3, O3).

    Frames are aggregated once, by target and filter; the target is chosen from these sums.
    """
    lights = frames.where("frame_type = 'light' and target_id is not null")
    sums = lights.groupBy("target_id", "filter_id").agg(F.round(F.sum("exposure_seconds"), 3).alias("total_seconds"), F.count(F.lit(1)).alias("frame_count"))
    top = sums.groupBy("target_id").agg(F.sum("frame_count").alias("n")).orderBy(F.desc("n"), "target_id").limit(1).select("target_id")
    return sums.join(F.broadcast(top), "target_id").orderBy(F.desc_nulls_last("total_seconds"), "filter_id")


def grouping_sets(frames: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """All `sets` of keys in one pass; `grouping_level` is the index of the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("grouping_level"), *[(F.col(k) if k in s else F.lit(None).cast(frames.schema[k].dataType)).alias(f"g_{k}") for k in keys]) for i, s in enumerate(sets)]))
    e = frames.withColumn("_g", levels)
    return e.groupBy("_g").agg(*[c.alias(n) for n, c in measures.items()]).select("_g.grouping_level", *[F.col(f"_g.g_{k}").alias(k) for k in keys], *measures)


def sigma_rejects(rows: DataFrame, key: list[str], value: str, sigmas: float) -> DataFrame:
    """Rows whose value lies more than `sigmas` standard deviations from its group's mean; groups are aggregated, then joined."""
    stats = rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return rows.join(stats, key).where((F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sd")))


def community_median(rows: DataFrame, key: list[str], member: str, value: str, least_members: int) -> DataFrame:
    """Median by key, only where at least `least_members` members contribute (A14); values are counted first."""
    counts = rows.groupBy(*key, member, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(F.percentile(value, 0.5, F.col("_n")).alias("median"), F.countDistinct(member).alias("members")).where(F.col("members") >= least_members)


def compare_runs(current: DataFrame, baseline: DataFrame, threshold: float = -0.2) -> DataFrame:
    """Metrics of two runs by name: OK, REGRESSED (change below the threshold), NEW, MISSING.

    Names occur once in a run; where both runs have a `unit`, those of a name are equal.  Anything else is an error.
    """

    def side(df: DataFrame, as_: str) -> DataFrame:
        unit = F.col("unit") if "unit" in df.columns else F.lit(None).cast("string")
        g = df.select("name", "value", unit.alias("unit")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias(as_), F.first("unit").alias(f"{as_}_unit"))
        return g.withColumn(as_, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated metric: "), "name"))).otherwise(F.col(as_))).drop("n")

    j = side(current, "current").join(side(baseline, "base"), "name", "full_outer")
    differ = F.col("current_unit") != F.col("base_unit")
    j = j.withColumn("current", F.when(differ, F.raise_error(F.concat(F.lit("units differ: "), "name"))).otherwise(F.col("current")))
    change = (F.col("current") - F.col("base")) / F.col("base")
    status = F.when(F.col("base").isNull(), "NEW").when(F.col("current").isNull(), "MISSING").when(change < threshold, "REGRESSED").otherwise("OK")
    return j.select("name", "current", "base", change.alias("change"), status.alias("status"))


def last_writer_wins(replicas: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """One row a key; each field from the latest replica that has it, the greatest value among equally late ones."""
    pick = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(at), F.col(f)))).getField(f).alias(f) for f in fields]
    return replicas.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(at).alias(at), *pick)


def running_start(rows: DataFrame, night: str, order: str, seconds: Column) -> DataFrame:
    """Adds the start offset of each row within its night: the seconds of the rows before it."""
    w = Window.partitionBy(night).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start_offset", F.coalesce(F.sum(seconds).over(w), F.lit(0.0)))
