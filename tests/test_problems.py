"""The core problems' operators against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from skycatalog.operators import schema_drift, sessions, spikes, timestamps

T0 = dt.datetime(2026, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# ---- sessions


def run_sessions(spark, rows, gap=100):
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "id string, key string, t timestamp, d string, cell int, root string")
    out = sessions.sessionize(df, key=F.col("key"), time="t", event_id="id", gap_seconds=gap, distinct_of="d")
    return sorted((r.key, r.start_us, r.end_us, r.event_count, r.distinct_count) for r in out.collect())


def brute_sessions(rows, gap=100):
    out, by = [], {}
    for i, k, t, d in {(i, k, t, d) for i, k, t, d in rows if None not in (i, k, t)}:
        by.setdefault(k, []).append((t, i, d))
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    for k, es in by.items():
        es.sort(key=lambda e: e[0])
        cur = [es[0]]
        for e in es[1:]:
            if (e[0] - cur[-1][0]).total_seconds() <= gap:
                cur.append(e)
            else:
                out.append((k, us(cur[0][0]), us(cur[-1][0]), len(cur), len({x[2] for x in cur} - {None})))
                cur = [e]
        out.append((k, us(cur[0][0]), us(cur[-1][0]), len(cur), len({x[2] for x in cur} - {None})))
    return sorted(out)


def test_sessions_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"e{i}", rnd.choice("abc"), at(rnd.randrange(30_000)), rnd.choice(["x", "y", None])) for i in range(600)]
    rows += [(f"long{i}", "chain", at(i * 100), "x") for i in range(200)]  # one session over many cells: gaps of exactly the limit
    assert run_sessions(spark, rows) == brute_sessions(rows)


def test_sessions_edges(spark):
    assert run_sessions(spark, []) == []
    rows = [("a", "k", at(0), None), ("a", "k", at(0), None), (None, "k", at(5), "x"), ("b", None, at(5), "x"), ("c", "k", None, "x"), ("d", "k", at(0), "x"), ("e", "k", at(101), "x")]
    assert [(r[3], r[4]) for r in run_sessions(spark, rows)] == [(2, 1), (1, 1)]
    twice = [("a", "k", at(0), "x"), ("a", "k", None, "y"), ("b", "k", at(1), "x"), ("b", "k", at(1), "z")]
    assert [(r[3], r[4]) for r in run_sessions(spark, twice)] == [(2, 2)]  # an id with several values is one event


# ---- schema drift


def drift(spark, files):
    rows = [("s", f, at(i * 100), n, json.dumps(line) if not isinstance(line, str) else line, "v", "l") for i, (f, lines) in enumerate(files) for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "src string, file string, at timestamp, line int, payload string, path string, leaf string")
    pv = schema_drift.path_values(df, source="src", file="file", at="at", line="line", payload="payload")
    return pv, {(r.file, r.field_path, r.change_kind, r.new_path) for r in schema_drift.schema_changes(pv).collect()}


def lines(n=6, **fields):
    return [{k: v(i) if callable(v) else v for k, v in fields.items()} for i in range(n)]


def test_drift_changes(spark):
    h = lambda **kw: lambda i: {k: v(i) if callable(v) else v for k, v in kw.items()}
    t = lambda i: -10.0 + i / 10
    files = [
        ("f1", lines(temp=t, gain=100.0, note="x", headers=h(**{"CCD-TEMP": t, "GAIN": 100.0}))),
        ("f2", lines(sensor=lambda i: t(i) - 5, gain="100.0", headers=h(**{"CCD-TEMP": lambda i: t(i) - 5, "GAIN": 100.0})) + [{"sensor": None}]),
        ("f3", lines(sensor=lambda i: {"value": t(i), "unit": "C"}, gain="100.0", angle=lambda i: i * 50.0, headers=h(DET=t, GAIN=100.0))),
    ]
    _, got = drift(spark, files)
    assert got == {
        ("f2", "temp", "renamed", "sensor"), ("f2", "gain", "type_changed", ""), ("f2", "note", "removed", ""),
        ("f3", "sensor", "type_changed", ""), ("f3", "angle", "added", ""), ("f3", "headers.CCD-TEMP", "renamed", "headers.DET"),
    }


def test_two_renames_at_once_are_told_apart(spark):
    files = [
        ("f1", lines(bin=1, off="50.0", headers=lambda i: {"XBIN": 1, "TEL": "Orrery"})),
        ("f2", lines(xb=1, black="50.0", headers=lambda i: {"CCDXB": 1, "OTA": "Orrery"})),
    ]
    _, got = drift(spark, files)
    assert got == {("f2", "bin", "renamed", "xb"), ("f2", "off", "renamed", "black"), ("f2", "headers.XBIN", "renamed", "headers.CCDXB"), ("f2", "headers.TEL", "renamed", "headers.OTA")}


def test_drift_odd_input(spark):
    files = [("f1", ["{bad", "[1]", "null", ""]), ("f2", [{"a": None}, {"a": None}]), ("f3", [{"a": 1}, {"a": "x"}, {"a": 2}]), ("f4", [{"a": None, "b": {}}, {"b": {"c": 1}}])]
    _, got = drift(spark, files)
    assert got == {("f4", "b", "added", "")}  # f1 has no lines, so f2 is the first file; only nulls are no type
    _, none = drift(spark, [])
    assert none == set()


def test_rename_by_all_values_of_a_large_file(spark):
    files = [("f1", [{"code": f"m{i:03}", "n": 1} for i in range(200)]), ("f2", [{"label": f"{'a' if i < 100 else 'm'}{i % 300 - 100 if i >= 100 else i:03}", "n": 1} for i in range(300)])]
    _, got = drift(spark, files)
    assert got == {("f2", "code", "renamed", "label")}


def test_uniform_table(spark):
    pv, _ = drift(spark, [("f1", [{"exp": 30.0}, {"exp": "abc"}, {"time": {"value": 5, "unit": "s"}}, {"exp": "12.5 s"}])])
    got = {r.line: (r.e, r.failed_casts) for r in schema_drift.uniform_table(pv, {"e": ("double", ["exp", "time"])}).collect()}
    assert got == {0: (30.0, []), 1: (None, ["e"]), 2: (5.0, []), 3: (12.5, [])}
    pv, _ = drift(spark, [("f1", [{"exp": "5 min"}, {"exp": "7 parsec"}, {"exp": {"value": 2, "unit": "h"}}, {"exp": "9 S"}, {"exp": 4}])])
    got = {r.line: (r.e, r.failed_casts) for r in schema_drift.uniform_table(pv, {"e": ("double", ["exp"], "s")}).collect()}
    assert got == {0: (300.0, []), 1: (None, ["e"]), 2: (7200.0, []), 3: (9.0, []), 4: (4.0, [])}


def test_uniform_table_keeps_every_path_and_line(spark):
    files = [("f1", lines(exp=lambda i: 10.0 + i, note="x")), ("f2", lines(shutter=lambda i: 10.0 + i, note="x")), ("f3", [{"exp": [1, 2], "headers": {"A": 1}}, {"exp": True}, {}, "{bad"])]
    pv, got = drift(spark, files)
    assert ("f2", "exp", "renamed", "shutter") in got
    raw = spark.createDataFrame([("s", f, n, x if isinstance(x, str) else json.dumps(x)) for f, ls in files for n, x in enumerate(ls)], "src string, file string, line int, payload string")
    every = schema_drift.all_lines(raw, source="src", file="file", line="line", payload="payload")
    rows = schema_drift.uniform_table(pv, {"e": ("double", ["exp"])}, lines=every, renames=schema_drift.schema_changes(pv).where("change_kind = 'renamed'")).collect()
    got = {(r.file, r.line): (r.e, r.failed_casts, r.rest) for r in rows}
    assert len(got) == len(rows) == 16
    assert got["f1", 2] == (12.0, [], {"note": '"x"'}) and got["f2", 2][:2] == (12.0, []) and got["f2", 2][2]["note"] == '"x"'
    assert got["f3", 0] == (None, ["e"], {"headers.A": "1"}) and got["f3", 1] == (None, ["e"], {})
    assert got["f3", 2] == (None, [], {}) and got["f3", 3] == (None, ["payload"], {})


# ---- timestamps


def normalise(spark, rows):
    df = spark.createDataFrame(rows, "record_id int, source string, text string, offset string, zone string, cand string, pick string")
    out = timestamps.normalise_instants(df, record_id="record_id", source=F.col("source"), text=F.col("text"), offset=F.col("offset"), zone=F.col("zone"), zoneless_is_utc=F.lit(False))
    return {r.record_id: (r.status, r.utc_seconds, r.format) for r in out.collect()}


def test_ambiguous_days_follow_their_source(spark):
    rows = [(i, "dmy", f"{13 + i % 15}/03/2026 10:00:00", "Z", None, "", "") for i in range(20)] + [(100, "dmy", "03/04/2026 10:00:00", "Z", None, "", "")]
    rows += [(200 + i, "mdy", f"03/{13 + i % 15}/2026 10:00:00", "Z", None, "", "") for i in range(20)] + [(300, "mdy", "03/04/2026 10:00:00", "Z", None, "", "")]
    rows += [(400, "alone", "03/04/2026 10:00:00", "Z", None, "", "")]
    got = normalise(spark, rows)
    second = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())
    assert got[100] == ("ok", second(2026, 4, 3, 10), "dmy") and got[300] == ("ok", second(2026, 3, 4, 10), "mdy")
    assert got[400][0] == "ambiguous" and got[400][1] is None


def test_timestamp_states(spark):
    rows = [(1, None, None, None, None, "", ""), (2, "s", "", None, None, "", ""), (3, "s", "2026-03-29 02:30:00", None, "Europe/Madrid", "", ""), (4, "s", "2026-03-29 05:30:00", None, None, "", ""), (5, "s", "2026-03-29 05:30", "??:??", "Asia/Tokyo", "", ""), (6, "s", "2026-03-29 05:30:00.99 QQQ", "+01:00", "Asia/Tokyo", "", ""), (7, "s", "x" * 100_000, "+01:00", "No/Such", "", ""), (8, "s", "2026-03-29 05:30:00.99", "-0600 ", "No/Such", "", ""), (9, "s", "2026-03-29 05:30:00", None, "No/Such", "", "")]
    got = {k: v[0] for k, v in normalise(spark, rows).items()}
    assert got == {1: "unparsed", 2: "unparsed", 3: "no_unique_instant", 4: "no_zone", 5: "ok", 6: "no_unique_instant", 7: "unparsed", 8: "ok", 9: "no_unique_instant"}
    assert normalise(spark, []) == {}


# ---- implausible readings

FIELDS = [spikes.Field("temp", -100.0, 100.0, False, 0.1), spikes.Field("fwhm", 0.0, 100.0, True, 0.02, lowest_open=True)]


def judge(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, cam string, t timestamp, temp double, fwhm double, src string, run int")
    out = spikes.score_readings(df, source=F.col("cam"), time="t", row_id="id", fields=FIELDS)
    return {(r.id, r.field): r.verdict for r in out.collect()}


def test_spikes_frozen_runs_and_limits(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for night in range(8):
        for i in range(60):
            n = f"{night}-{i}"
            temp = 15.0 - 5 * i if night % 2 and i < 4 else round(-5 + rnd.choice([-0.1, 0.0, 0.1]), 2)  # cool-down on every other night
            fwhm = round(3 + rnd.gauss(0, 0.1), 4)
            if i == 30:
                temp, want[n, "temp"] = temp + 20, "spike"
            if i == 20:
                fwhm, want[n, "fwhm"] = fwhm * 3, "spike"
            if night == 3 and 40 <= i < 48:
                fwhm, want[n, "fwhm"] = 3.1234, "frozen"
            if i == 55:
                fwhm, want[n, "fwhm"] = [0.0, -1.0, 9999.0, float("nan")][night % 4], "impossible"
            rows.append((n, "cam", at(night * 86_400 + i * 300), temp, fwhm))
    got = judge(spark, rows + rows[:5])
    assert {k: v for k, v in got.items() if v} == want
    assert len(got) == 2 * len(rows)


def test_frozen_run_is_judged_alike_at_every_table_size(spark):
    rnd = random.Random(8)
    nights = []
    for night in range(4):
        temps = [round(rnd.choice([-0.2, -0.1, 0.0, 0.1, 0.2]), 1) for _ in range(150)]
        temps[60:71] = [0.1] * 11 if night == 2 else temps[60:71]
        temps[59] = temps[71] = -0.2
        nights.append(temps)
    frozen = {}
    for times in (1, 100):
        rows = [(f"{k}-{n}-{i}", "cam", at((k * 4 + n) * 86_400 + i * 300), -5 + v, 3.0 + i / 1000) for k in range(times) for n, temps in enumerate(nights) for i, v in enumerate(temps)]
        frozen[times] = {k for (k, f), v in judge(spark, rows).items() if f == "temp" and v == "frozen"}
    assert frozen[1] == {f"0-2-{i}" for i in range(60, 71)}
    assert frozen[100] == {f"{k}-2-{i}" for k in range(100) for i in range(60, 71)}


def test_a_jump_is_judged_by_its_source(spark):
    rnd = random.Random(9)
    rows = []
    for cam, spread in (("calm", 0.1), ("wild", 3.0)):
        for night in range(5):
            rows += [(f"{cam}-{night}-{i}", cam, at(night * 86_400 + i * 300), round(-5 + rnd.gauss(0, spread) + (4.0 if i == 40 else 0.0), 2), round(3 + rnd.gauss(0, 0.1), 4)) for i in range(80)]
    got = {k for (k, f), v in judge(spark, rows).items() if f == "temp" and v}
    assert got == {f"calm-{night}-40" for night in range(5)}


def test_the_forest_decides(spark, monkeypatch):
    rnd = random.Random(10)
    rows = [(f"{n}-{i}", "cam", at(n * 86_400 + i * 300), round(-5 + rnd.gauss(0, 0.7 if rnd.random() < 0.08 else 0.3), 2), round(3 + rnd.gauss(0, 0.1), 4)) for n in range(6) for i in range(80)]
    rows[200] = (*rows[200][:3], 10.0, rows[200][4])
    flagged = lambda: {k for k, v in judge(spark, rows).items() if v}
    with_forest = flagged()
    monkeypatch.setattr(spikes, "MARGIN", -1.0)  # no reading is below the threshold: the exact check alone
    without = flagged()
    assert (rows[200][0], "temp") in with_forest and with_forest < without and len(without) >= 2 * len(with_forest)


def test_all_readings_make_forest_and_threshold(spark, monkeypatch):
    rnd = random.Random(11)
    value = lambda n, i: 6.0 if i == 40 else 1.0 if (n, i) == (7, 20) else rnd.uniform(-0.4, 0.4)
    rows = [(f"{n}-{i}", "cam", at(n * 86_400 + i * 300), round(-5 + value(n, i), 4), None, "x", 1) for n in range(40) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, cam string, t timestamp, temp double, fwhm double, src string, run int")
    scored = lambda: {r.id: r for r in spikes.score_readings(df, source=F.col("cam"), time="t", row_id="id", fields=FIELDS).collect()}
    one = scored()
    ordinary = [r for i, r in one.items() if not i.endswith("-40")]
    assert len(one) == 3200 and max(ordinary, key=lambda r: abs(r.departure)).id == "7-20"
    assert max(r.score for r in ordinary) == pytest.approx(one["0-0"].threshold - spikes.MARGIN)
    assert {f"{n}-40" for n in range(40)} == {i for i, r in one.items() if r.verdict}
    monkeypatch.setattr(spikes, "GROUP_ROWS", 500)  # seven groups: the same forest and threshold
    assert scored() == one


def test_spikes_edges(spark):
    assert judge(spark, []) == {}
    got = judge(spark, [("a", None, at(0), 1.0, None), ("b", "c", None, 500.0, 1.0), (None, "c", at(0), 1.0, 1.0), ("d", "c", at(0), 1.0, 1.0), ("e", "c2", at(0), 1.0, 1.0), ("f", "c2", at(0), 1.0, 1.0)])
    assert got[("b", "temp")] == "impossible" and got[("a", "temp")] is None and got[("d", "temp")] is None and ("a", "fwhm") not in got
    assert got[("e", "temp")] is None and got[("f", "temp")] is None


@pytest.mark.parametrize("n", [2, 50])
def test_forest_isolates_what_is_far(n):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    forest = spikes.grow_forest(x, [np.full((1, 4), 12.0), np.empty((0, 4))], 1)
    s = spikes.forest_scores(forest, np.vstack([x[:n], np.full((1, 4), 12.0)]), 501)
    assert s[-1] > 0.55 and s[-1] > s[:-1].max()


def test_trees_grow_a_level_at_a_time():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    x, tails = rng.normal(size=(3000, 4)).astype(np.float32), [np.full((40, 4), 9.0, np.float32), np.empty((0, 4), np.float32)]
    took = {"grow": [], "score": []}
    for seed in range(5):
        t = [time.process_time()]
        forest = spikes.grow_forest(x, tails, seed)
        t.append(time.process_time())
        spikes.forest_scores(forest, x, 256)
        t.append(time.process_time())
        took["grow"].append(t[1] - t[0])
        took["score"].append(t[2] - t[1])
    assert min(took["grow"]) < 3 * min(took["score"])  # tree by tree and node by node: 6 times
    # the readings of each tree, sent down, are as many at each leaf as its path length says
    for tree, (feature, threshold, length) in enumerate(zip(*[a.reshape(spikes.TREES, -1) for a in forest], strict=True)):
        own, leaves = np.vstack([x[(tree * 255 + np.arange(255)) % 3000], tails[0][:1]]), {}
        for r in own:
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(r[feature[at]] >= threshold[at])
            leaves[at] = leaves.get(at, 0) + 1
        depth = {at: int(np.log2(at + 1)) for at in leaves}
        assert set(leaves) == set(np.flatnonzero(length)) and all(length[at] == pytest.approx(depth[at] + float(spikes._path_norm(n))) for at, n in leaves.items())
        assert all(n <= spikes.LEAF_READINGS or depth[at] == spikes.DEPTH for at, n in leaves.items())
