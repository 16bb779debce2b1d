"""Activity sessions separated by inactivity gaps (problem 6).

Method: pointer doubling.  Events within one gap-wide time cell of a key are always one session, so each cell is first
aggregated on the map side; a cell is then linked to its predecessor cell if the times facing each other are within
the gap, the pointers are doubled by self-joins until the roots are stable, and cells are aggregated by root.
A hot key is as many nodes as it has cells, never one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycatalog.session import cut_lineage



def _roots(cells: DataFrame, gap_us: int) -> DataFrame:
    """(key, cell, root): pointer doubling over linked cells."""
    prev = cells.select(F.col("key").alias("p_key"), (F.col("cell") + 1).alias("p_cell"), F.col("last_us").alias("p_last"))
    linked = F.col("p_last").isNotNull() & (F.col("first_us") - F.col("p_last") <= gap_us)
    ptr = cells.join(prev, (F.col("key") == F.col("p_key")) & (F.col("cell") == F.col("p_cell")), "left").select(
        "key", "cell", F.when(linked, F.col("cell") - 1).otherwise(F.col("cell")).alias("root")
    )
    ptr = cut_lineage(ptr)
    done, open_ = ptr.where("root = cell"), ptr.where("root <> cell")
    while not open_.isEmpty():
        # only pointers that may still move are joined; one whose root points to itself is settled
        up = done.unionByName(open_).select(F.col("key").alias("u_key"), F.col("cell").alias("u_cell"), F.col("root").alias("u_root"))
        moved = open_.join(up, (F.col("key") == F.col("u_key")) & (F.col("root") == F.col("u_cell"))).select("key", "cell", F.col("u_root").alias("root"), (F.col("u_root") != F.col("root")).alias("moved"))
        moved = cut_lineage(moved)
        done, open_ = done.unionByName(moved.where("not moved").drop("moved")), moved.where("moved").drop("moved")
    return done


def sessionize(
    events: DataFrame,
    *,
    key: Column,
    time: str,
    event_id: str,
    gap_seconds: int,
    distinct_of: str | None = None,
) -> DataFrame:
    """(key, start_us, end_us, duration_us, event_count, distinct_count) of the maximal runs in which each event
    follows the one before within `gap_seconds` (a gap of exactly that length still joins).

    Events with a NULL key, time or id take no part; rows of the same id count once, at their earliest time;
    `distinct_of` counts the distinct non-null values of the session's rows.  Equal times are one session.  An empty input
    gives an empty result; other columns are ignored.
    """
    gap = int(gap_seconds * 1_000_000)
    ev = events.select(
        key.alias("key"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("t"),
        F.col(event_id).alias("id"),
        (F.col(distinct_of) if distinct_of else F.lit(None).cast("string")).alias("d"),
    ).where("key is not null and t is not null and id is not null")
    cell = F.floor(F.col("t") / max(gap, 1)).cast("long").alias("cell")
    once = ev.groupBy("key", "id").agg(F.min("t").alias("t"))
    cells = once.groupBy("key", cell).agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count(F.lit(1)).alias("n"))
    values = ev.where("d is not null").select("key", cell, "d").distinct()
    # one row a cell (d is NULL) and one a cell and value: small, and all that is needed from here on
    nothing = F.lit(None).cast("bigint")
    parts = cut_lineage(cells.withColumn("d", F.lit(None).cast(ev.schema["d"].dataType)).unionByName(values.select("key", "cell", nothing.alias("first_us"), nothing.alias("last_us"), nothing.alias("n"), "d")))
    cells = parts.where("d is null").select("key", "cell", "first_us", "last_us")
    roots = _roots(cells, gap)
    r = roots.select(F.col("key").alias("r_key"), F.col("cell").alias("r_cell"), "root")
    joined = parts.join(r, (F.col("key") == F.col("r_key")) & (F.col("cell") == F.col("r_cell"))).groupBy("key", "root", "d").agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n")
    )
    return (
        joined.groupBy("key", "root")
        .agg(F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"), F.sum("n").alias("event_count"), F.count("d").alias("distinct_count"))
        .select("key", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "event_count", "distinct_count")
    )
