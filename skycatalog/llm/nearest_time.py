"""Pair each left row with the right row nearest in time (problem 1).

Method: both sides are united, sorted per entity and time, and the last and the next right-side row are
carried onto each left row; the nearer within the tolerance wins.

A numeric band (|left - right| <= width, e.g. a sensor temperature) is part of the entity without any
pairing of candidates: band values are scaled to integers, a right row stands in one aligned block of
each power-of-two size, and a left row asks the few blocks that make up exactly [value - width,
value + width].  Each (entity, block) is then an ordinary carry, and the blocks' winners merge.

Entities are also cut into time slabs, eight tolerances wide, so that a hot entity is many groups; a right
row near a slab's edge stands in both slabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLAB_TOLERANCES = 8


def _levels(width: int) -> int:
    return max(1, (2 * width + 1).bit_length())


def _right_blocks(v: Column, width: int) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(v, k).alias("block")) for k in range(_levels(width))])


def _left_blocks(v: Column, width: int) -> Column:
    lo, hi, found = v - F.lit(width), v + F.lit(width + 1), []
    for k in range(_levels(width)):
        first = F.shiftright(lo + F.lit((1 << k) - 1), k)
        last = F.shiftright(hi, k)
        some = first < last
        found.append(F.when(some & (first.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), first.alias("block"))))
        found.append(F.when(some & (last.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), (last - 1).alias("block"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    by: dict[str, Column],
    left_id: str,
    right_id: str,
    time: str,
    tolerance_seconds: int,
    band: Column | None = None,
    band_width: float = 0.0,
    band_scale: int = 100,
) -> DataFrame:
    """(left_id, right_id, left_us, right_us, gap_us): the nearest right row of each left row.

    `by` names the key expressions, evaluated on either side; `band` a numeric expression that may differ by
    `band_width` at most, compared after rounding to 1/`band_scale`.  Rows with a NULL id, key, time or band take no
    part; left rows without a partner give no row.  Equal gaps: the earlier right row, then the smaller id.  Repeated
    rows of one id count once (smallest time).  Empty inputs give an empty result; other columns are ignored.
    """
    tol = int(tolerance_seconds * 1_000_000)
    slab = tol * SLAB_TOLERANCES if tol else 1
    width = round(band_width * band_scale)
    keys = [f"k{i}" for i in range(len(by))]

    def side(df: DataFrame, id_: str) -> DataFrame:
        cols = [
            F.col(id_).alias("id"),
            F.unix_micros(F.col(time).cast("timestamp")).alias("t"),
            *[e.alias(k) for k, e in zip(keys, by.values(), strict=True)],
            (F.round(band * band_scale).cast("long") if band is not None else F.lit(0).cast("long")).alias("v"),
        ]
        return df.select(*cols).dropna(how="any").distinct()

    lefts = side(left, left_id)
    rights = side(right, right_id)
    lefts = lefts.select("id", "t", *keys, F.floor(F.col("t") / slab).cast("long").alias("slab"), F.explode(_left_blocks(F.col("v"), width)).alias("b"))
    rights = (
        rights.withColumn("b", F.explode(_right_blocks(F.col("v"), width)))
        .withColumn("slab", F.explode(F.array_distinct(F.array(F.floor((F.col("t") - tol) / slab).cast("long"), F.floor((F.col("t") + tol) / slab).cast("long")))))
        .select("id", "t", *keys, "slab", "b")
    )
    both = lefts.withColumn("is_left", F.lit(True)).unionByName(rights.withColumn("is_left", F.lit(False)))
    both = both.select(F.col("id"), "t", "slab", F.col("b.level").alias("level"), F.col("b.block").alias("block"), "is_left", *keys)
    part = ", ".join([*keys, "level", "block", "slab"])
    sided = both.selectExpr(
        "id", "t", "is_left", *keys, "level", "block", "slab",
        f"case when not is_left then struct(t, min(case when not is_left then id end) over (partition by {part} order by t range between current row and current row) as id) end as r",
    )
    carried = sided.selectExpr(
        "id", "t", "is_left",
        f"lag(r, 1) ignore nulls over (partition by {part} order by t, is_left) as before",
        f"lead(r, 1) ignore nulls over (partition by {part} order by t, is_left) as after",
    ).where("is_left")
    near = carried.select("id", "t", F.explode(F.array("before", "after")).alias("r")).where("r is not null")
    near = near.select("id", F.struct(F.abs(F.col("t") - F.col("r.t")).alias("gap_us"), F.col("r.t").alias("right_us"), F.col("r.id").alias("right_id"), F.col("t").alias("left_us")).alias("w"))
    best = near.where(F.col("w.gap_us") <= tol).groupBy("id").agg(F.min("w").alias("w"))
    return best.select(F.col("id").alias("left_id"), "w.right_id", "w.left_us", "w.right_us", "w.gap_us")
