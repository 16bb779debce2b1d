"""Synthetic frames by closed formulas over spark.range: the same seed gives the same rows, in any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycatalog.functions.scalar import mulberry32
from skycatalog.operators.rollups import running_start

#: Step of the generator's counter state.
STEP = 0x6D2B79F5
GAP_SECONDS = 15


def draw(index: Column, seed: int) -> Column:
    """The `index`-th number (from 0) of the stream of `seed`: its state is a counter, so any draw can be computed directly."""
    return mulberry32((F.lit(seed & 0xFFFFFFFF) + (index + 1) * F.lit(STEP)).bitwiseAND(F.lit(0xFFFFFFFF)))


def parse_weights(text: str) -> list[tuple[str, float]]:
    """'name:weight,...' with weights made to add up to 1; negative, missing or all-zero weights are errors."""
    out = []
    for item in text.split(","):
        name, colon, weight = item.rpartition(":")
        if not colon or not name.strip():
            raise ValueError(f"no weight: {item}")
        if (w := float(weight)) < 0:
            raise ValueError(f"negative weight: {item}")
        out.append((name.strip(), w))
    total = sum(w for _, w in out)
    if total <= 0:
        raise ValueError("weights add up to 0")
    return [(n, w / total) for n, w in out]


def pick(r: Column, weights: list[tuple[object, float]]) -> Column:
    """The entry in whose part of [0, 1) `r` falls; the last one takes what rounding leaves."""
    edges, at = [], 0.0
    for name, w in weights[:-1]:
        at += w
        edges.append((at, name))
    if not edges:
        return F.lit(weights[-1][0])
    return reduce(lambda acc, e: acc.when(r < e[0], F.lit(e[1])), edges[1:], F.when(r < edges[0][0], F.lit(edges[0][1]))).otherwise(F.lit(weights[-1][0]))


def frames(index: DataFrame, *, seed: int, objects: list, filters: list, types: list, exposures: list, nights: int, start: str) -> DataFrame:
    """Frames for each `i` of `index(i)`: four draws a frame (object, filter, type, exposure), dealt over nights from 22:00."""
    # the draws are columns of their own, so that a pick compares a number and not the whole formula
    drawn = index.select("i", *[draw(F.col("i") * 4 + k, seed).alias(f"d{k}") for k in range(4)])
    f = drawn.select("i", pick(F.col("d0"), objects).alias("object"), pick(F.col("d1"), filters).alias("filter"), pick(F.col("d2"), types).alias("image_type"), pick(F.col("d3"), exposures).cast("double").alias("exposure_seconds"), (F.col("i") % nights).alias("night"))
    f = running_start(f, "night", "i", F.col("exposure_seconds") + GAP_SECONDS)
    first = F.to_timestamp(F.lit(f"{start} 22:00:00"))
    return f.withColumn("date_obs", F.timestamp_millis(F.unix_millis(first) + F.col("night") * 86_400_000 + (F.col("start_offset") * 1000).cast("bigint"))).drop("start_offset")


def corrupt_indices(index: DataFrame, total: int, count: int) -> DataFrame:
    """Evenly spread indices, `count` of `total`."""
    if count <= 0 or total <= 0:
        return index.limit(0)
    step = total / min(count, total)
    return index.where(F.col("i") < min(count, total)).select(F.least(F.floor(F.col("i") * step + step / 2), F.lit(total - 1)).cast("bigint").alias("i"))
