"""Nearest in time against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("skycatalog.llm")

from skycatalog.llm import nearest_time  # noqa: E402

T0 = dt.datetime(2026, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def nearest(left, right, **kw):
    return {r.left_id: r.right_id for r in nearest_time.nearest_in_time(left, right, by={"k": F.col("cam")}, left_id="id", right_id="id", time="t", tolerance_seconds=3600, **kw).collect()}


SIDE = "id string, cam string, t timestamp, temp double, slab int, level int, is_left string"


def side(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SIDE)  # columns that the operator uses inside


def test_nearest_against_brute_force(spark):
    rnd = random.Random(3)
    rows = lambda p, n: [(f"{p}{i}", rnd.choice("ab"), at(rnd.randrange(200_000)), round(rnd.uniform(-5, 5), 2)) for i in range(n)]
    ls, rs = rows("l", 300), rows("r", 200)
    want = {}
    for i, c, t, v in ls:
        ok = [(abs((t - u).total_seconds()), u, j) for j, d, u, w in rs if c == d and abs(round(v * 100) - round(w * 100)) <= 200 and abs((t - u).total_seconds()) <= 3600]
        if ok:
            want[i] = min(ok)[2]
    assert len(want) > 50
    assert nearest(side(spark, ls), side(spark, rs), band=F.col("temp"), band_width=2.0) == want


def test_nearest_ties_nulls_and_edges(spark):
    ls = [("l1", "a", at(0), 0.0), ("l1", "a", at(0), 0.0), ("l2", "a", None, 0.0), ("l3", None, at(0), 0.0), (None, "a", at(0), 0.0), ("l4", "a", at(50_000), 0.0), ("l5", "b", at(0), None)]
    rs = [("r2", "a", at(60), 0.0), ("r1", "a", at(-60), 0.0), ("r0", "a", at(-60), 2.0), ("r9", "a", at(50_000 + 3600), -2.0), ("r8", "b", at(1), 0.0), ("r7", "a", at(50_000 - 3601), 0.0)]
    assert nearest(side(spark, ls), side(spark, rs), band=F.col("temp"), band_width=2.0) == {"l1": "r0", "l4": "r9"}
    assert nearest(side(spark, ls), side(spark, rs))["l5"] == "r8"
    assert nearest(side(spark, ls), side(spark, [])) == {} and nearest(side(spark, []), side(spark, rs)) == {}
    same = nearest(side(spark, [("x", "a", at(5), 0.0)]), side(spark, [("y", "a", at(5), 0.0)]))
    assert same == {"x": "y"}
