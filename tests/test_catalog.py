"""State changes, search, queue, snapshots, streams and the scan from folder to catalog."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from skycatalog import schema
from skycatalog.api import Catalog
from skycatalog.operators import analytics, files, frames, jobs, rollups, search
from skycatalog.sources import fits, headers, raw, xisf
from skycatalog.store import SnapshotStore
from skycatalog.streaming import debounce

T = dt.datetime(2026, 1, 1)
FILE = "id string, watch_folder_id string, relative_path string, filename string, extension string, size_bytes long, file_mtime timestamp, sha256 string, status string, created_at timestamp, updated_at timestamp"


def file_row(i, path, size=1, mtime=T, sha=None, status="present", created=T, folder="w"):
    return (i, folder, path, path.split("/")[-1], "fits", size, mtime, sha, status, created, T)


@pytest.mark.parametrize(
    "prior, differs, want",
    [
        (None, False, ("present", None, True, True, False)),
        ("present", False, ("present", "h", False, False, False)),
        ("present", True, ("present", None, False, True, False)),
        ("missing", False, ("present", "h", False, True, True)),
        ("missing", True, ("present", None, False, True, True)),
        ("duplicate", False, ("duplicate", "h", False, False, False)),
        ("duplicate", True, ("duplicate", None, False, True, False)),
    ],
)
def test_upsert_decision_table(spark, prior, differs, want):
    old = spark.createDataFrame([file_row("a", "p/x.fits", sha="h", status=prior, mtime=None)] if prior else [], FILE)
    seen = spark.createDataFrame([file_row("?", "p/x.fits", size=2 if differs else 1, mtime=None)], FILE)
    r = files.upsert_discovered(old, seen, F.lit(T)).first()
    assert (r.status, r.sha256, r.is_new, r.changed, r.was_restored) == want


def test_upsert_leaves_unseen_rows_and_counts_repeats_once(spark):
    old = spark.createDataFrame([file_row("a", "p/x.fits", sha="h"), file_row("b", "p/y.fits")], FILE)
    seen = spark.createDataFrame([file_row("?", "p/z.fits"), file_row("?", "p/z.fits"), file_row("?", "p/x.fits")], FILE)
    rows = {r.relative_path: r for r in files.upsert_discovered(old, seen, F.lit(T)).collect()}
    assert set(rows) == {"p/x.fits", "p/y.fits", "p/z.fits"} and not rows["p/y.fits"].changed and rows["p/z.fits"].is_new


def test_mark_missing_is_strict(spark):
    rows = spark.createDataFrame([file_row("a", "x"), file_row("b", "y", status="duplicate"), file_row("c", "z", folder="other")], FILE)
    got = lambda cut: {r.id: r.status for r in files.mark_missing(rows, F.lit(cut), "w").collect()}
    assert got(T) == {"a": "present", "b": "duplicate", "c": "present"}
    assert got(T + dt.timedelta(seconds=1)) == {"a": "missing", "b": "duplicate", "c": "present"}


def test_duplicate_groups_do_not_depend_on_order(spark):
    rows = [file_row("b", "1", sha="h", created=T), file_row("a", "2", sha="h", created=T), file_row("c", "3", sha="h", status="missing", created=T - dt.timedelta(days=9)), file_row("d", "4", sha="g", status="duplicate"), file_row("e", "5")]
    for order in (rows, rows[::-1]):
        got = {r.id: (r.status, r.duplicate_of_id) for r in files.resolve_duplicates(spark.createDataFrame(order, FILE)).collect()}
        assert got == {"a": ("present", None), "b": ("duplicate", "a"), "c": ("missing", None), "d": ("present", None), "e": ("present", None)}


def test_moves(spark):
    old = spark.createDataFrame([file_row("m2", "old/a", size=5, sha="h", status="missing"), file_row("m1", "old/b", size=5, sha="h", status="missing"), file_row("p", "old/c", size=6, sha="g")], FILE)
    new = spark.createDataFrame([file_row("n2", "new/z", size=5, sha="h"), file_row("n1", "new/a", size=5, sha="h"), file_row("n3", "new/c", size=6, sha="g")], FILE)
    moves = files.match_moves(new, old)
    assert [tuple(r) for r in moves.collect()] == [("n1", "m1")]
    got = {r.id: (r.relative_path, r.status) for r in files.reparent(old, moves, new).collect()}
    assert got["m1"] == ("new/a", "present") and got["m2"] == ("old/a", "missing") and got["p"] == ("old/c", "present")


def test_frame_upsert_keeps_manual_types_and_quality(spark):
    s = "id string, file_id string, frame_type string, frame_type_source string, object_raw string, fwhm double"
    old = spark.createDataFrame([("1", "f1", "flat", "manual", "M 31", 2.0), ("2", "f2", "light", "header", "M 31", 3.0)], s)
    new = spark.createDataFrame([("f1", "dark", "header", None), ("f2", "dark", "header", None), ("f3", "bias", "header", "x")], "file_id string, frame_type string, frame_type_source string, object_raw string")
    got = {r.file_id: (r.frame_type, r.frame_type_source, r.object_raw, r.fwhm) for r in frames.upsert_frames(old, new).collect()}
    assert got == {"f1": ("flat", "manual", None, 2.0), "f2": ("dark", "header", None, 3.0), "f3": ("bias", "header", "x", None)}


def test_frame_records_are_strict_about_types(spark):
    h = '{"EXPTIME": "300", "EXPOSURE": 120, "OBJECT": 5, "FILTER": "", "OBJCTRA": "10 00 00", "RA": null, "CCD-TEMP": -10.5, "CREATOR": "Sequence Generator Pro v4", "ANGLE": 12.5}'
    r = frames.frame_records(spark.createDataFrame([("a", h), ("b", "{bad"), ("c", None)], "id string, h string"), "h", ["id"]).orderBy("id").collect()
    a = r[0]
    assert (a.exposure_seconds, a.object, a.filter, a.ra_deg, a.ccd_temp, a.capture_profile, a.rotator_angle_deg) == (120.0, None, "", 150.0, -10.5, "sgpro", 12.5)
    assert r[1].exposure_seconds is None and r[2].object is None


def test_records_of_all_formats_agree(spark):
    heads = [
        ("fits", {"OBJECT": "M 31", "EXPTIME": 300, "CCD-TEMP": -10.0, "GAIN": 100, "DATE-OBS": "2026-01-01T00:00:00", "INSTRUME": "Cam"}),
        ("xisf", {"OBJECT": "M 31", "EXPTIME": "300", "CCD-TEMP": " -10 ", "GAIN": "100", "DATE-OBS": "2026-01-01T00:00:00", "INSTRUME": "Cam", "AIRMASS": "Infinity"}),
        ("xisf", {"prop:Observation:Object:Name": "M 31", "prop:Instrument:ExposureTime": "300", "EXPOSURE": "7", "prop:Instrument:Sensor:Temperature": "-10", "GAIN": "100", "prop:Observation:Time:Start": "2026-01-01T00:00:00", "INSTRUME": "Cam"}),
        ("raw", {"ExposureTime": 300, "ISO": 100, "DateTimeOriginal": "2026:01:01 00:00:00", "Make": "Cam", "Model": None}),
    ]
    rows = spark.createDataFrame([(i, f, json.dumps(h)) for i, (f, h) in enumerate(heads)], "id int, format string, h string")
    got = frames.frame_records(rows, "h", ["id"], format=F.col("format")).orderBy("id").collect()
    assert {(r.exposure_seconds, r.gain, r.date_obs, r.instrument) for r in got} == {(300.0, 100.0, "2026-01-01T00:00:00", "Cam")}
    assert [(r.object, r.ccd_temp, r.airmass) for r in got] == [("M 31", -10.0, None)] * 3 + [(None, None, None)]


def test_calibration_states(spark):
    day = lambda n: T + dt.timedelta(n)
    s = "camera string, exposure double, gain double, offset double, binning int, temp double, filter string, at timestamp"
    lights = spark.createDataFrame([("g1", "c", 300.0, 1.0, 5.0, 1, -10.0, "Ha", day(0)), ("g2", "c", 60.0, 1.0, 5.0, 1, None, None, day(0)), ("g3", "other", 60.0, 1.0, 5.0, 1, 0.0, "L", day(0))], f"group_id string, {s}")
    masters = [
        ("d2", "dark", "c", 300.0, 1.0, 5.0, 1, -10.0, None, day(1), 30), ("d1", "dark", "c", 300.0, 1.0, 5.0, 1, -10.0, None, day(-1), 30), ("d0", "dark", "c", 300.0, 1.0, 5.0, 1, -12.5, None, day(0), 30),
        ("b1", "bias", "c", 0.0, 1.0, 5.0, 1, None, None, day(90), 9), ("f1", "flat", "c", 2.0, 7.0, 0.0, 1, None, "Ha", day(-40), 9),
    ]
    got = analytics.match_calibration(lights, spark.createDataFrame(masters, f"master_id string, kind string, {s}, sub_count long")).collect()
    assert {(r.group_id, r.kind): (r.master_id, r.status) for r in got} == {
        ("g1", "dark"): ("d1", "complete"), ("g1", "bias"): ("b1", "complete"), ("g1", "flat"): ("f1", "stale"),
        ("g2", "dark"): (None, "missing"), ("g2", "bias"): ("b1", "complete"), ("g2", "flat"): (None, "missing"), **{("g3", k): (None, "missing") for k in ("dark", "bias", "flat")},
    }
    assert {r.group_id: r.group_status for r in got} == {"g1": "stale", "g2": "partial", "g3": "missing"}


def test_sessions_of_a_night(spark):
    rows = [("1", "r", T, "a", "light"), ("2", "r", T + dt.timedelta(hours=4), None, "dark"), ("3", "r", T + dt.timedelta(hours=8, seconds=1), "b", "dark"), ("4", None, T, "a", None), ("5", "r", None, "a", "light"), ("6", "r", T, "c", "light")]
    f = spark.createDataFrame(rows, "id string, equipment_profile_id string, date_obs_utc timestamp, target_id string, frame_type string")
    got = lambda df: sorted((r.equipment_profile_id, r.event_count, r.distinct_count, r.kind) for r in df.collect())
    assert got(analytics.detect_sessions(f)) == [("?", 1, 1, "calibration"), ("r", 1, 1, "calibration"), ("r", 3, 2, "light")]
    assert got(analytics.detect_sessions(f, locked=f.where("id in ('1', '6')").select("id"))) == [("?", 1, 1, "calibration"), ("r", 1, 0, "calibration"), ("r", 1, 1, "calibration")]
    assert analytics.detect_sessions(f.where("false")).count() == 0


def test_watched_folder_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "lights").mkdir(parents=True)
    (tmp_path / "in" / "skip").mkdir()
    for name in ("lights/a.fits", "lights/b.txt", "lights/.c.fits", "skip/d.fits", "e.NEF"):
        (tmp_path / "in" / name).write_bytes(b"xx")

    def run(existing, at):
        w = headers.watch(spark, str(tmp_path / "in"), ["skip"], existing=existing).writeStream.format("memory").queryName(at).option("checkpointLocation", str(tmp_path / at)).trigger(availableNow=True).start()
        w.awaitTermination()
        return {(r.relative_path, r.extension, r.size_bytes) for r in spark.table(at).collect()}

    assert run(True, "all_files") == {("lights/a.fits", "fits", 2), ("e.NEF", "nef", 2)}
    for name in ("lights/a.fits", "e.NEF"):
        os.utime(tmp_path / "in" / name, (1, 1))
    assert run(False, "new_files") == set()


def test_rules_of_all_tables(spark):
    empty = {t: spark.createDataFrame([], schema.SCHEMAS[t]) for t in schema.SCHEMAS}
    assert set(schema.RULES) == set(schema.SCHEMAS) and schema.violations(empty).count() == 0
    inputs = spark.createDataFrame([("1", "p", "frame", "f", None), ("2", "p", "frame", None, "m"), ("3", "p", "other", None, None), ("4", "p", "master_frame", "f", "m")], "id string, project_id string, input_type string, frame_id string, master_frame_id string")
    got = {(r.rule, r.key) for r in schema.violations({**empty, "project_inputs": schema.conform(inputs, "project_inputs")}).collect()}
    # 'other' with no input meets the condition, and is caught by the allowed values
    assert got == {("check input_type", "3"), ("exactly one input", "2"), ("exactly one input", "4"), ("reference project_id", "p"), ("reference frame_id", "f"), ("reference master_frame_id", "m")}


def test_queue(spark):
    s = "id int, status string, priority int, created_at timestamp, worker_id string, started_at timestamp"
    q = spark.createDataFrame([(1, "queued", -1, T, None, None), (3, "queued", 0, T, None, None), (2, "queued", 0, T, None, T), (4, "running", 9, T, "w", T)], s)
    got = {r.id: (r.status, r.worker_id, r.started_at) for r in jobs.claim_next(q, "me", F.lit(T + dt.timedelta(1))).collect()}
    assert got[2] == ("running", "me", T) and got[3][0] == "queued" and got[1][0] == "queued" and got[4] == ("running", "w", T)
    empty = jobs.claim_next(q.where("false"), "me", F.lit(T))
    assert empty.count() == 0
    e = spark.createDataFrame([(s_, v) for s_ in ("queued", "running", "completed") for v in ("cancel", "complete", "requeue")], "s string, v string")
    got = {(r.s, r.v): r.n for r in e.select("s", "v", jobs.transition(F.col("s"), F.col("v")).alias("n")).collect()}
    assert got[("queued", "cancel")] == "cancelled" and got[("running", "cancel")] == "running" and got[("running", "requeue")] == "queued" and got[("completed", "requeue")] == "completed" and got[("queued", "complete")] == "queued"


def test_patch_is_tri_state(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    ch = spark.createDataFrame([(1, '{"name": null}'), (2, '{"n": 7}'), (3, "{}")], "id int, patch string")
    assert [tuple(r) for r in jobs.patch(rows, ch, "id", ["name", "n"]).orderBy("id").collect()] == [(1, None, 5), (2, "b", 7)]


def entities(spark):
    t = spark.createDataFrame([("t1", "M 31", "Andromeda Galaxy", "big spiral"), ("t2", "NGC 7000", "North América", None)], "id string, canonical_name string, display_name string, notes string")
    a = spark.createDataFrame([("a1", "NGC 224")], "id string, alias string")
    s = spark.createDataFrame([("s1", "2026-01-01", None)], "id string, session_date string, notes string")
    return search.search_entities(t, a, s)


@pytest.mark.parametrize(
    "query, ids",
    [
        ("androm*", {"t1"}), ("ngc", {"t2", "a1"}), ("NGC 7000", {"t2"}), ("null", set()), ("", set()), ("america", {"t2"}), ('"andromeda galaxy"', {"t1"}), ('"galaxy andromeda"', set()),
        ("title:spiral", set()), ("body:spiral", {"t1"}), ("andromeda OR america", {"t1", "t2"}), ("ngc -224", {"t2"}), ("2026", {"s1"}),
    ],
)
def test_search(spark, query, ids):
    rows = search.search(entities(spark), query).collect()
    assert {r.entity_id for r in rows} == ids and rows == sorted(rows, key=lambda r: (-r.score, r.entity_type, r.entity_id))


def test_compare_and_sync(spark):
    cur = spark.createDataFrame([("a", 79.0), ("b", 80.0), ("c", 5.0)], "name string, value double")
    base = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("d", 5.0)], "name string, value double")
    for wrong in (cur.withColumn("unit", F.lit("s")), cur.unionByName(cur)):
        with pytest.raises(Exception, match="units differ|repeated metric"):
            rollups.compare_runs(wrong, base.withColumn("unit", F.lit("ms"))).collect()
    assert {r.name: r.status for r in rollups.compare_runs(cur, base).collect()} == {"a": "REGRESSED", "b": "OK", "c": "NEW", "d": "MISSING"}
    rep = spark.createDataFrame([("k", 1, "x", None), ("k", 2, None, "y"), ("k", 3, "z", None)], "id string, at int, p string, q string")
    assert tuple(rollups.last_writer_wins(rep, "id", "at", ["p", "q"]).first()) == ("k", 3, "z", "y")


def test_cone_search_against_brute_force(spark):
    import math
    import random

    rnd = random.Random(2)
    pts = [(f"p{i}", rnd.uniform(0, 20), rnd.uniform(-5, 5)) for i in range(80)]
    tgs = [(f"t{i}", rnd.uniform(0, 20), rnd.uniform(-5, 5)) for i in range(60)]

    def sep(a, b):
        r = math.radians
        h = math.sin(r(b[2] - a[2]) / 2) ** 2 + math.cos(r(a[2])) * math.cos(r(b[2])) * math.sin(r(b[1] - a[1]) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(h)))

    want = {(p[0], t[0]) for p in pts for t in tgs if sep(p, t) <= 1.5}
    s = "id string, ra_deg double, dec_deg double"
    got = {(r.id, r.target_id) for r in analytics.cone_search(spark.createDataFrame(pts, s), spark.createDataFrame(tgs, s), 1.5).collect()}
    assert got == want and want


def test_violations(spark):
    f = spark.createDataFrame([("1", "f1", "light", "header", "t9"), ("1", "f1", "odd", None, None)], "id string, file_id string, frame_type string, frame_type_source string, target_id string")
    t = spark.createDataFrame([("t1",)], "id string")
    got = {(r.rule, r.key) for r in schema.violations({"frames": f, "targets": t}).collect()}
    assert got == {("check frame_type", "1"), ("unique id", "1"), ("unique file_id", "f1"), ("reference target_id", "t9")}


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store.commit({"a": spark.range(3), "b": spark.range(1)})
    before = store.read("a")
    store.commit({"a": spark.range(5)})
    assert before.count() == 3 and store.read("a").count() == 5 and store.read("b").count() == 1

    class Boom(Exception):
        pass

    class Bad:
        @property
        def write(self):
            raise Boom

    with pytest.raises(Boom):
        store.commit({"b": spark.range(9), "a": Bad()})
    assert store.read("a").count() == 5 and store.read("b").count() == 1


def test_debounce_batch(spark):
    e = spark.createDataFrame([("a", T + dt.timedelta(seconds=s)) for s in (0, 20, 45, 100)] + [(None, T), ("b", None)], "k string, t timestamp")
    got = sorted((r.events, (r.fired_at - T).seconds) for r in debounce.debounce(e, key="k", time="t").collect())
    assert got == [(1, 130), (3, 75)]


def test_one_scan_in_flight(spark, tmp_path):
    src = tmp_path / "in"
    sig = [("a", 0, "fire"), ("a", 1, "fire"), ("a", 2, "fire"), ("a", 3, "completed"), ("a", 4, "completed"), ("a", 5, "fire"), ("b", 0, "completed"), ("b", 1, "fire")]
    spark.createDataFrame([(k, T + dt.timedelta(seconds=s), v) for k, s, v in sig], "key string, at timestamp, kind string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("key string, at timestamp, kind string").parquet(str(src))
    q = debounce.one_in_flight(stream).writeStream.format("memory").queryName("requests").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, (r.at - T).seconds, r.reason) for r in spark.table("requests").collect())
    assert got == [("a", 0, "quiet"), ("a", 3, "deferred"), ("a", 5, "quiet"), ("b", 1, "quiet")]


def write_tree(root):
    def put(path, data):
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)

    put("lights/a.fits", fits.write_header([("IMAGETYP", "LIGHT"), ("OBJECT", "M 31"), ("EXPTIME", 300.0), ("DATE-OBS", "2026-01-15T03:22:10.123")]) + b"\0" * 2880)
    put("darks/_b.FIT", fits.write_header([("EXPTIME", 60.0)]))
    put("x/c.xisf", xisf.write_header({"OBJECT": "M 42", "IMAGETYP": "Flat"}))
    put("x/d.cr2", raw.write_tiff({"Make": "Canon", "Model": "EOS"}))
    put("x/bad.fits", b"X" * 512)
    put("x/readme.txt", b"no")
    put(".hidden/z.fits", b"no")
    put("Skip/z.fits", b"no")


def test_walk(spark, tmp_path):
    write_tree(tmp_path)
    os.symlink(tmp_path / "lights", tmp_path / "x" / "link")
    got = sorted((r.relative_path, r.extension) for r in headers.walk(spark, str(tmp_path), ["skip"]).collect())
    assert got == [("darks/_b.FIT", "fit"), ("lights/a.fits", "fits"), ("x/bad.fits", "fits"), ("x/c.xisf", "xisf"), ("x/d.cr2", "cr2")]
    assert headers.walk(spark, str(tmp_path / "none")).count() == 0


def test_scan_rescan_and_hash(spark, tmp_path):
    root = tmp_path / "img"
    os.makedirs(root)
    write_tree(root)
    cat = Catalog(spark, f"file://{tmp_path}/cat")
    first = cat.scan("w", str(root), ["skip"]).first()
    assert tuple(first) == (5, 5, 0, 1)
    f = {r.file_id: (r.frame_type, r.frame_type_source, r.object_raw, r.exposure_seconds) for r in cat.table("frames").collect()}
    paths = {r.id: r.relative_path for r in cat.table("files").collect()}
    by_path = {paths[k]: v for k, v in f.items()}
    assert by_path["lights/a.fits"] == ("light", "header", "M 31", 300.0) and by_path["darks/_b.FIT"][:2] == ("dark", "path_heuristic") and "x/bad.fits" not in by_path
    again = cat.scan("w", str(root), ["skip"]).first()
    assert again.files_added == 0 and again.files_updated == 0 and cat.table("frames").count() == 4
    os.remove(root / "x" / "c.xisf")
    with open(root / "darks" / "_b.FIT", "wb") as fh:
        fh.write(fits.write_header([("EXPTIME", 90.0)]) + b" " * 2880)
    third = cat.scan("w", str(root), ["skip"]).first()
    assert third.files_updated == 1
    state = {r.relative_path: r.status for r in cat.table("files").collect()}
    assert state["x/c.xisf"] == "missing" and state["lights/a.fits"] == "present"
    with open(root / "lights" / "a.fits", "rb") as src, open(root / "lights" / "copy.fits", "wb") as dst:
        dst.write(src.read())
    cat.scan("w", str(root), ["skip"])
    cat.hash_backlog(str(root))
    state = {r.relative_path: (r.status, r.sha256 is not None) for r in cat.table("files").collect()}
    assert sorted(s for p, (s, _) in state.items() if p.startswith("lights/")) == ["duplicate", "present"] and state["lights/a.fits"][1]
    cat.set_setting("k", {"a": [1]})
    cat.set_setting("k", 5)
    assert cat.setting("k").first()[0].toJson() == "5" if hasattr(cat.setting("k").first()[0], "toJson") else cat.table("settings").count() == 1


def test_files_that_come_are_merged(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    head = b"".join(f"{c:<80}".encode() for c in ("SIMPLE  =                    T", "OBJECT  = 'M 31'", "EXPTIME =                  300", "END"))
    (root / "a.fits").write_bytes(head.ljust(2880))
    cat = Catalog(spark, str(tmp_path / "cat"))
    for _ in range(2):
        cat.ingest("w", str(root), str(tmp_path / "ck")).awaitTermination()
        (root / "b.fits").write_bytes(b"no head")
    f = {r.relative_path: (r.status, r.parse_error is None) for r in cat.table("files").collect()}
    assert f == {"a.fits": ("present", True), "b.fits": ("present", False)}
    assert [(r.object_raw, r.exposure_seconds) for r in cat.frames().collect()] == [("M 31", 300.0)]


def test_exports_facets_and_provenance(spark, tmp_path):
    from skycatalog.functions.scalar import is_uuid
    from skycatalog.operators import export

    df = spark.createDataFrame([("1", 'a "q", b', None), ("2", "ü", 5)], "id string, name string, n int").coalesce(1)
    export.export_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfid,name,n") and b'"a ""q"", b"' in text
    with pytest.raises(Exception, match="exists"):
        export.export_csv(df, str(tmp_path / "csv"))
    export.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2

    ids = spark.range(50).select(export.uuidv7(F.timestamp_millis(F.col("id") + 1_700_000_000_000)).alias("u"), "id")
    rows = ids.withColumn("ok", is_uuid(F.col("u"))).orderBy("id").collect()
    assert all(r.ok for r in rows) and [r.u for r in rows] == sorted(r.u for r in rows) and len({r.u for r in rows}) == 50

    metric = {"name": "a", "unit": "rows/sec", "value": 2.0, "higherIsBetter": True, "samples": [1.0, 3.0]}
    file = {"schemaVersion": 1, "generatedAt": "2026-01-01T00:00:00.000Z", "results": [metric]}
    (tmp_path / "b.json").write_text(json.dumps(file))
    assert [tuple(r) for r in export.read_baseline(spark, str(tmp_path / "b.json")).collect()] == [("a", "rows/sec", 2.0)]
    for bad in ({"results": [{**metric, "value": -1.0}]}, {"results": [metric, metric]}, {"results": [{**metric, "unit": "s"}]}, {"results": [{**metric, "more": 1}]}, {"schemaVersion": 2}, {"generatedAt": "now"}, {"extra": 1}):
        (tmp_path / "bad.json").write_text(json.dumps({**file, **bad}))
        with pytest.raises(Exception, match="bad baseline"):
            export.read_baseline(spark, str(tmp_path / "bad.json")).collect()
    assert [r.t for r in spark.createDataFrame([(-0.2046,), (None,)], "c double").select(export.change_label(F.col("c")).alias("t")).collect()] == ["-20.5%", "-"]

    t = lambda rows_, s: spark.createDataFrame(rows_, s)
    got = export.trace_back(
        t([("im", "p", True), ("draft", "p", False)], "id string, project_id string, is_final boolean"), t([("p",)], "id string"),
        t([("p", "f1", None), ("p", None, "m1")], "project_id string, frame_id string, master_frame_id string"), t([("f1",), ("f2",), ("f3",)], "id string"),
        t([("m1",)], "id string"), t([("m1", "f2"), ("m1", "gone")], "master_frame_id string, frame_id string"),
    )
    assert sorted((r.image_id, r.frame_id, r.via) for r in got.collect()) == [("im", "f1", "input"), ("im", "f2", "master")]
    assert [r.id for r in export.page(spark.range(10), [F.col("id")], 3, 2).collect()] == [3, 4]
