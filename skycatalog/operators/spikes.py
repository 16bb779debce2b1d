"""Implausible readings of measurements, per source (problem 4).

Method: an isolation forest per source on level, difference, seasonal and run-length features; every reading is scored, and explicit
physical-limit rules apply beside it.  Everything is in units of the source itself: departures in the noise of its own readings, runs in
what its own equal neighbours make of chance.  A reading is flagged if its source's forest isolates it clearly more than every ordinary
reading of the source, and an exact check tells what it is: a departure from both sides, or a run of frozen values that chance does
not give in that source.

Sources are cut into time slabs (with a margin of neighbours) for the features, and dealt by hash to groups of bounded size for the
scores, so a hot source is many tasks.  Each tree takes readings of its own from all of the source, put in order by a hash.  Of a source of
several groups, every group gets the readings of all trees and grows the same forest, and the highest score is that of all its groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycatalog.session import broadcast_if_small, cut_lineage

#: Readings that a tree is grown on, the isolation forest's own number; one has a departure and one a run beyond the ordinary, so that the tree knows their range.
TREES, TREE_SAMPLE, DEPTH = 32, 256, 8
NODES = 2 ** (DEPTH + 1) - 1
#: Readings of a node that is not cut further; what more cuts would give on average is added to its path length.
LEAF_READINGS = 4
#: Share of a source's readings whose departures are within its noise.
NOISE_SHARE = 0.9
#: Departure in noises, and surprise of a run in nats, up to which a reading is ordinary.
ORDINARY_DEPARTURE, ORDINARY_RUN = 3.75, 7.0
#: Least departure in noises that can be a spike at all; the forest decides on it.
LEAST_DEPARTURE = 2.0
#: How far a score must lie above the highest score of an ordinary reading of the sample.
MARGIN = 0.05
#: Departure and surprise that make one unit of their feature, and the units beyond which all are alike.
DEPARTURE_UNIT, RUN_UNIT, MOST_UNITS = 5.0, 5.0, 4.0
#: Readings of a source that are scored in one group (expected); larger sources are dealt to several by hash.
GROUP_ROWS = 250_000
#: Rows up to which the statistics of sources are broadcast.
BROADCAST_ROWS = 200_000
SLAB_US = 16 * 86_400_000_000
MARGIN_US = 2 * 86_400_000_000
#: Readings further apart than this are not each other's neighbours where a session has enough of its own.
SESSION_GAP_US = 3_600_000_000
NEIGHBOURS = 3
#: Least size of the next step, as a part of the step at an edge, for a trend.
TREND = 0.3
#: Shortest run of frozen values, and how many such runs chance may give in so many readings of the source.
FROZEN_MIN, FROZEN_CHANCE = 5, 1e-3
FROZEN_READINGS = 1000


@dataclass(frozen=True)
class Field:
    """A measurement: column, physical limits, whether departures are ratios, and the least step that the instrument shows."""

    column: str
    lowest: float
    highest: float
    ratio: bool
    step: float
    lowest_open: bool = False


def _scaled(v: Column, ratio: Column) -> Column:
    return F.when(ratio, F.log(F.greatest(v, F.lit(0.0)) + F.lit(0.01))).otherwise(v)


def _readings(rows: DataFrame, *, source: Column, time: str, row_id: str, fields: list[Field]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(f.column).alias("field"), F.col(f.column).cast("double").alias("v"), F.lit(f.ratio).alias("ratio"),
                (F.isnan(F.col(f.column).cast("double")) | (F.col(f.column) < f.lowest) | ((F.col(f.column) == f.lowest) & F.lit(f.lowest_open)) | (F.col(f.column) > f.highest)).alias("impossible"),
            )
            for f in fields
        ]
    )
    used = [F.col(f.column) for f in fields]
    once = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), source.alias("src"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), *used).distinct()
    return once.select("id", "src", "t", F.explode(cells).alias("c")).where("c.v is not null").select("id", "src", "t", "c.*")


def _neighbourhood(r: DataFrame) -> DataFrame:
    """Each reading with deviation, run length and the adjacent-equality flag, computed in overlapping slabs."""
    r = r.withColumn("home", F.floor(F.col("t") / SLAB_US).cast("long"))
    slabs = F.array_distinct(F.array(F.col("home"), F.floor((F.col("t") - MARGIN_US) / SLAB_US).cast("long"), F.floor((F.col("t") + MARGIN_US) / SLAB_US).cast("long")))
    s = r.withColumn("slab", F.explode(slabs)).withColumn("x", F.when(~F.col("impossible"), _scaled(F.col("v"), F.col("ratio"))))
    part, order = "partition by src, field, slab", "order by t, id"
    s = s.selectExpr(
        "*",
        f"case when t - lag(t) over ({part} {order}) <= {SESSION_GAP_US} then 0 else 1 end as fresh",
        f"case when v = lag(v) over ({part} {order}) then 0 else 1 end as changed",
    ).selectExpr("*", f"sum(fresh) over ({part} {order} rows unbounded preceding) as session", f"sum(changed) over ({part} {order} rows unbounded preceding) as run")
    s = s.withColumn("run_length", F.expr("count(1) over (partition by src, field, slab, run)")).withColumn("in_session", F.expr("count(x) over (partition by src, field, slab, session)"))
    near = lambda a, b: f"collect_list(case when x is not null then struct(x, session) end) over ({part} {order} rows between {a} and {b})"
    s = s.selectExpr("*", f"{near(f'{2 * NEIGHBOURS} preceding', '1 preceding')} as wide_l", f"{near('1 following', f'{2 * NEIGHBOURS} following')} as wide_r").where("slab = home")
    own = lambda c: F.transform(F.filter(c, lambda z: (z["session"] == F.col("session")) | (F.col("in_session") < NEIGHBOURS)), lambda z: z["x"])
    s = s.withColumn("l", F.reverse(own(F.col("wide_l")))).withColumn("r", own(F.col("wide_r"))).drop("wide_l", "wide_r")
    return s.withColumn("l", F.slice("l", 1, NEIGHBOURS)).withColumn("r", F.slice("r", 1, NEIGHBOURS))


def _median(c: Column) -> Column:
    s = F.array_sort(c)
    n = F.size(s)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)


def _departure(s: DataFrame) -> DataFrame:
    """Signed departure that both sides agree on, at an edge from the other side's level unless it carries on a trend."""
    x = F.col("x")
    dl, dr = x - _median(F.col("l")), x - _median(F.col("r"))
    both = F.when(F.signum(dl) == F.signum(dr), F.signum(dl) * F.least(F.abs(dl), F.abs(dr))).otherwise(0.0)
    first, second = lambda c: F.try_element_at(c, F.lit(1)), lambda c: F.try_element_at(c, F.lit(2))
    # a step that goes on in the same direction at a fair part of its size is a trend, such as a cool-down
    goes_on = lambda c: (F.signum(x - first(c)) == F.signum(first(c) - second(c))) & (F.abs(first(c) - second(c)) >= TREND * F.abs(x - first(c)))
    edge = lambda d, c: F.when(F.size(c) < 2, d).when(goes_on(c), 0.0).otherwise(d)
    d = F.when((F.size("l") > 0) & (F.size("r") > 0), both).when(F.size("r") > 0, edge(dr, F.col("r"))).when(F.size("l") > 0, edge(dl, F.col("l")))
    return s.withColumn("departure", F.coalesce(d, F.lit(0.0)))


# ---- isolation forest ------------------------------------------------------------------------------------------------------


def _path_norm(n: np.ndarray | float) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow_forest(ordinary: np.ndarray, tails: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, path length at leaf) of the nodes of all trees, one tree after the other in heap order; feature -1 marks a leaf.

    The readings are in a random order, and each tree takes those that follow the tree's before, around the end.
    A feature is cut as often as it is wide in the node, so that few cuts part what lies far out.  All trees grow a level at a time.
    """
    rng, tree = np.random.default_rng(seed), np.arange(TREES)[:, None]
    tails = [t for t in tails if len(t)]
    own = min(len(ordinary), TREE_SAMPLE - len(tails))
    x = np.concatenate([ordinary[(tree * own + np.arange(own)) % len(ordinary)], *[t[tree % len(t)] for t in tails]], axis=1)
    root = np.repeat(np.arange(TREES) * NODES, x.shape[1])
    x, at = x.reshape(len(root), -1), root
    feature, threshold, length = np.full(TREES * NODES, -1), np.zeros(TREES * NODES), np.zeros(TREES * NODES)
    for depth in range(DEPTH + 1):
        order = np.argsort(at, kind="stable")
        x, at, root = x[order], at[order], root[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        node, n = at[first], np.diff(first, append=len(at))
        lo, hi = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        width = (hi - lo).cumsum(axis=1, dtype=float)
        cut = (n > LEAF_READINGS) & (width[:, -1] > 0) & (depth < DEPTH)
        length[node[~cut]] = depth + _path_norm(n[~cut])
        if not cut.any():
            break
        f = (width[cut] <= rng.random((cut.sum(), 1)) * width[cut, -1:]).sum(axis=1)
        least, most = lo[cut, f], hi[cut, f]
        t = np.maximum(rng.uniform(least, most), np.nextafter(least, most))
        feature[node[cut]], threshold[node[cut]] = f, t
        stay = np.repeat(cut, n)
        x, at, root = x[stay], at[stay], root[stay]
        right = x[np.arange(len(x)), np.repeat(f, n[cut])] >= np.repeat(t, n[cut])
        at = 2 * at - root + 1 + right
    return feature, threshold, length


def forest_scores(forest: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, sample_size: int) -> np.ndarray:
    total, flat, first = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, threshold, length in zip(*[a.reshape(TREES, NODES) for a in forest], strict=True):
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (flat[first + np.maximum(f, 0)] >= threshold[at]))
        total += length[at]
    norm = float(_path_norm(min(sample_size, TREE_SAMPLE)))
    return 2.0 ** (-total / TREES / max(norm, 1e-9))


FEATURES = ["f_level", "f_difference", "f_season", "f_run"]
# Ordinary readings, the first ones with departures and of runs, and those that follow them with the same value.
ORDINARY, DEPARTED, RUN, FOLLOWING = range(4)
GROUP = ["src", "field", "part"]
SCORED = "id string, src string, field string, v double, departure double, run_length long, claim string, score double, threshold double"


def _score(key: tuple, readings: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
    """Scores of a group by the forest of the pool, and the source's highest score of an ordinary reading: the pool's, if that has one, else the group's."""
    out = readings[["id", "src", "field", "v", "departure", "run_length", "claim"]].copy()
    p = pool.sort_values(["deal", *FEATURES])
    ordinary, *tails = [p.loc[p["kind"] == k, FEATURES].to_numpy(np.float32) for k in (ORDINARY, DEPARTED, RUN)]
    if len(out) and len(ordinary) > 1:
        forest = grow_forest(ordinary, tails, crc32(f"{key[0]}|{key[1]}".encode()))
        scores = forest_scores(forest, readings[FEATURES].to_numpy(np.float32), len(ordinary) + sum(len(t) > 0 for t in tails))
        known = pool["top"].notna().any() if "top" in pool else False
        out["score"], out["threshold"] = scores, pool["top"].max() if known else scores[(readings["kind"] == ORDINARY).to_numpy()].max(initial=0.0)
    else:
        out["score"], out["threshold"] = 1.0, 1.0
    return out


def _scored(f: DataFrame, stats: DataFrame) -> DataFrame:
    """All readings with score and threshold."""

    def alone(key: tuple, readings: pd.DataFrame) -> pd.DataFrame:
        return _score(key, readings, readings)

    def shared(key: tuple, readings: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        return _score(key, readings, pool.rename(columns=lambda c: c.removeprefix("p_")) if len(pool) else readings)

    rows = f.drop("n")
    if stats.where(F.col("n") > GROUP_ROWS).isEmpty():
        return rows.groupBy(*GROUP).applyInPandas(alone, SCORED)
    # sources of several groups: what their trees take of all readings, then the highest score of all groups
    several = f.where(F.col("n") > GROUP_ROWS)
    by_deal = Window.partitionBy("src", "field", "kind").orderBy("deal", *FEATURES)
    takes = F.when(F.col("kind") == ORDINARY, TREES * TREE_SAMPLE).otherwise(TREES)
    pool = several.where(F.col("kind") != FOLLOWING).withColumn("k", F.row_number().over(by_deal)).where(F.col("k") <= TREES * TREE_SAMPLE).where(F.col("k") <= takes)
    parts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / GROUP_ROWS) - 1).cast("int")))
    pool = cut_lineage(pool.select("src", "field", parts.alias("part"), "deal", "kind", *FEATURES))
    own_names = lambda p: p.toDF(*[f"p_{c}" for c in p.columns])
    scored = lambda r, p: r.groupBy(*GROUP).cogroup(own_names(p).groupBy(*[f"p_{c}" for c in GROUP])).applyInPandas(shared, SCORED)
    tops = cut_lineage(scored(several.drop("n"), pool).groupBy("src", "field").agg(F.max("threshold").alias("top")))
    return scored(rows, pool.join(broadcast_if_small(tops, BROADCAST_ROWS), ["src", "field"]))


def score_readings(rows: DataFrame, *, source: Column, time: str, row_id: str, fields: list[Field]) -> DataFrame:
    """(id, source, field, value, score, threshold, departure, run_length, verdict): every reading of every field.

    verdict: 'impossible' (beyond the physical limits, NaN), 'spike', 'frozen' or NULL.  Readings without time or source are judged by the
    limits only (score NULL).  NULL readings and ids give no row; repeated rows of an id count once; equal times are ordered
    by id.  In a source with fewer than two ordinary readings nothing is isolated.
    """
    r = _readings(rows, source=source, time=time, row_id=row_id, fields=fields)
    timed = r.where("src is not null and t is not null")
    s = cut_lineage(_departure(_neighbourhood(timed)).where("x is not null").select("id", "src", "t", "field", "v", "x", "departure", "run_length", "changed"))
    hour = F.floor(F.pmod(F.col("t"), F.lit(86_400_000_000)) / 3_600_000_000).cast("int")
    stats = s.groupBy("src", "field").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 200).alias("q"), F.percentile_approx(F.abs("departure"), NOISE_SHARE, 1000).alias("noise"),
        (F.sum(F.when((F.col("changed") == 0) & (F.col("run_length") <= 3), 1).otherwise(0)) / F.count(F.lit(1))).alias("p_equal"),
    )
    seasons = s.groupBy("src", "field", hour.alias("hour")).agg(F.percentile_approx("x", 0.5, 200).alias("season"))
    # a row a source, and one a source and hour; both are written out, so that their size is known before the join
    stats, seasons = cut_lineage(stats), cut_lineage(seasons)
    f = s.withColumn("hour", hour).join(broadcast_if_small(stats, BROADCAST_ROWS), ["src", "field"]).join(broadcast_if_small(seasons, BROADCAST_ROWS), ["src", "field", "hour"])
    step = F.try_element_at(F.create_map(*[F.lit(x) for c in fields for x in (c.column, c.step)]), F.col("field"))
    noise = F.greatest(F.col("noise"), step)
    # equal neighbours of a fixed number of readings, so that a run is judged alike in a small and a large table
    surprise = -F.log(F.greatest(F.col("p_equal"), F.lit(1 / (FROZEN_READINGS + 1)))) * (F.col("run_length") - 1)
    f = f.withColumn("depart", F.abs(F.col("departure")) / noise).withColumn("surprise", surprise).withColumn("spread", F.greatest(F.col("q")[2] - F.col("q")[0], noise))
    kind = F.when(F.col("depart") > ORDINARY_DEPARTURE, DEPARTED).when(F.col("surprise") > ORDINARY_RUN, RUN).otherwise(ORDINARY)
    kind = F.when((kind != ORDINARY) & (F.col("changed") == 0), FOLLOWING).otherwise(kind)
    frozen = (F.col("run_length") >= FROZEN_MIN) & (F.log(F.lit(FROZEN_READINGS / FROZEN_CHANCE)) < F.col("surprise"))
    claim = F.when(F.col("depart") >= LEAST_DEPARTURE, "spike").when(frozen, "frozen")
    small = lambda c, name: c.cast("float").alias(name)
    bounded = lambda c: c / (F.abs(c) + 1)
    units = lambda c, unit: F.pow(F.least(F.col(c) / unit, F.lit(MOST_UNITS)), 2)
    f = f.select(
        "id", "src", "field", "v", "departure", "run_length", claim.alias("claim"), "n", kind.alias("kind"), F.xxhash64("id", "field").alias("deal"),
        F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP_ROWS)).cast("int").alias("part"),
        small(bounded((F.col("x") - F.col("q")[1]) / F.col("spread")), "f_level"), small(units("depart", DEPARTURE_UNIT), "f_difference"),
        small(bounded((F.col("x") - F.col("season")) / F.col("spread")), "f_season"), small(units("surprise", RUN_UNIT), "f_run"),
    )
    scored = _scored(f, stats)
    judged = scored.select(
        "id", F.col("src").alias("source"), "field", F.col("v").alias("value"), "score", (F.col("threshold") + MARGIN).alias("threshold"), "departure", F.col("run_length").cast("long").alias("run_length"),
        F.when(F.col("score") > F.col("threshold") + MARGIN, F.col("claim")).alias("verdict"),
    )
    rest = r.where("impossible or src is null or t is null").select(
        "id", F.col("src").alias("source"), "field", F.col("v").alias("value"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("double").alias("departure"), F.lit(None).cast("long").alias("run_length"),
        F.when(F.col("impossible"), "impossible").alias("verdict"),
    )
    return judged.unionByName(rest)
