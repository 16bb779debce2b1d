"""Golden tables of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from skycatalog.functions import scalar, sqludf
from skycatalog.functions.timestamps import known_zone, readings, wall_to_utc

IMAGE_TYPES = {
    "light": ["LIGHT", "Light", "light", " LIGHT ", "Light Frame", "LIGHTFRAME", "Light_Frame", "light-frame", "'LIGHT'", "' Light Frame '"],
    "dark": ["DARK", "Dark", "Dark Frame", "DarkFrame", "MASTERDARK", "Master Dark", "master_dark", "MasterDark"],
    "flat": ["FLAT", "Flat", "Flat Field", "FlatField", "MasterFlat", "Master Flat"],
    "bias": ["BIAS", "Bias Frame", "masterBias", "'Master Bias'", "biasframe"],
    "darkflat": ["DARKFLAT", "Dark Flat", "dark-flat", "DARK_FLAT", "MasterDarkFlat", "Master Dark Flat"],
    None: ["TEST FRAME", "''", None, "   ", "MASTER LIGHT", ""],
}
PATHS = {
    "light": ["lights/a.fits", "x/light/a.fits", "lights_Ha/a.fits", "M31/light_001.fits", "darks/lights/a.fits"],
    "dark": ["darks/a.fits", "dark/a.fits", "DARK_-10C/a.fits", "lights/darks/a.fits", "a\\darks\\b.fits", "masters/dark.fits"],
    "flat": ["flats/a.fits", "x/flat_L_001.xisf", "FLAT-B/a.fits"],
    "bias": ["bias/a.fits", "biases/a.fits", "x/bias_g100_001.cr2"],
    "darkflat": ["darkflats/a.fits", "dark_flat/a.fits", "dark-flats/a.fits", "Dark Flats/a.fits"],
    None: ["starlight/a.fits", "flatiron/a.fits", "biassing/a.fits", "my lights here/a.fits", None, ""],
}


def column(spark, values, f, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("kind", IMAGE_TYPES)
def test_image_type(spark, kind):
    assert column(spark, IMAGE_TYPES[kind], scalar.match_image_type) == [kind] * len(IMAGE_TYPES[kind])


@pytest.mark.parametrize("kind", PATHS)
def test_path(spark, kind):
    assert column(spark, PATHS[kind], scalar.match_path) == [kind] * len(PATHS[kind])


def test_sql_functions_agree(spark):
    names = sqludf.register(spark)
    assert "match_path" in names
    every = [v for vs in PATHS.values() for v in vs] + [v for vs in IMAGE_TYPES.values() for v in vs]
    spark.createDataFrame([(v,) for v in every], "v string").createOrReplaceTempView("v")
    rows = spark.table("v").select("v", scalar.match_path(F.col("v")).alias("a"), F.expr("match_path(v)").alias("b"), scalar.match_image_type(F.col("v")).alias("c"), F.expr("match_image_type(v)").alias("d"), scalar.extension_of(F.col("v")).alias("e"), F.expr("extension_of(v)").alias("f")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in rows)
    # the functions are inlined: no Python stage in the plan
    plan = spark.sql("select match_path(v) from v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_extension_and_walk(spark):
    assert column(spark, ["a.FITS", "a.b.fit", "a", ".hidden", "x.", None], scalar.extension_of) == ["fits", "fit", None, None, None, None]
    assert column(spark, ["a/b.fits", ".git/b", "a/Node_Modules/b", "a/skip/b", None], lambda c: scalar.walks_into(c, ["Skip"])) == [True, False, False, False, None]


def test_sexagesimal(spark):
    got = column(spark, ["13 29 53", "+47 11 43", "-00 30 00", "13:29:60", "1 2", None, "-05:23:28.5"], scalar.parse_sexagesimal)
    assert got[0] == pytest.approx(13 + 29 / 60 + 53 / 3600) and got[1] == pytest.approx(47 + 11 / 60 + 43 / 3600)
    assert got[2] == pytest.approx(-0.5) and got[3] is None and got[4] is None and got[5] is None
    assert got[6] == pytest.approx(-(5 + 23 / 60 + 28.5 / 3600))


def test_exif_time_and_camera(spark):
    df = spark.createDataFrame([("2026:04:05 22:11:03", "+02:00", "Canon", "Canon EOS 6D"), ("2026:04:06 01:20:00", None, "NIKON CORPORATION", "NIKON Z 6"), ("bad", "+01:00", "SONY", "ILCE-7M4"), ("2026:02:30 01:00:00", None, None, "X")], "t string, o string, mk string, md string")
    got = [tuple(r) for r in df.select(scalar.exif_date_obs(F.col("t"), F.col("o")), scalar.camera_name(F.col("mk"), F.col("md"))).collect()]
    assert got == [("2026-04-05T20:11:03Z", "Canon EOS 6D"), ("2026-04-06T01:20:00", "NIKON Z 6"), (None, "SONY ILCE-7M4"), (None, "X")]


def test_labels_filters_names(spark):
    assert column(spark, [0.0, 3600.0, 359940.0, 360060.0], scalar.integration_label, "double") == ["00h 00m", "01h 00m", "99h 59m", "100h 01m"]
    assert column(spark, ["Lum", "UV/IR", "Ha 3nm", None, "", "Weird"], lambda c: scalar.canonical_filter(c)[0]) == ["L", "L", "Ha", "None", "None", "Weird"]
    assert column(spark, ["m31", "NGC  7000", "Sh2-101", "ngc_0891 panel 2", "My Field"], scalar.catalog_name) == ["M 31", "NGC 7000", "SH2 101", "NGC 891", "MY FIELD"]
    assert column(spark, ["M 31 Panel 2", "KX 11_P3", "M 31"], scalar.mosaic_panel) == [2, 3, None]
    assert column(spark, ['["a", 1, "b"]', "no json", '{"a": 1}', None], scalar.skip_patterns) == [["a", "b"], None, None, None]


def test_generator_stream(spark):
    def reference(seed, n):
        out, a = [], seed
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & 0xFFFFFFFF
            out.append(((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296)
        return out

    from skycatalog.sources import generator

    got = [r[0] for r in spark.range(50).orderBy("id").select(generator.draw(F.col("id"), 12345)).collect()]
    assert got == reference(12345, 50)
    with pytest.raises(ValueError):
        generator.parse_weights("a:0,b:0")
    with pytest.raises(ValueError):
        generator.parse_weights("a:-1")


def test_readings(spark):
    def formats(text):
        return [r["format"] for r in spark.createDataFrame([(text,)], "v string").select(readings(F.col("v"))).first()[0]]

    assert formats("2026:04:05 22:11:03") == ["ymd"]
    assert formats("03/04/2026 10:00:00") == ["dmy", "mdy"]
    assert formats("31/04/2026 10:00:00") == []
    assert formats("2022:02:30 21:10:00") == [] and formats("20:52") == [] and formats("2026-01-01T24:00:00") == []
    assert formats("1691694968") == ["epoch_s"] and formats("1397479115200") == ["epoch_ms"] and formats("JD 2460234.02968171") == ["jd"]
    assert formats("Mar 13 2026 08:08:40 PM") == ["mon_d_y"] and formats("16-Oct-2015 15:58:05Z") == ["d_mon_y"] and formats("20260409T091834Z") == ["compact"]


def test_wall_clock(spark):
    import datetime as dt

    def utc(text, zone):
        s = int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp())
        got = spark.createDataFrame([(s, zone)], "s long, z string").select(wall_to_utc(F.col("s"), known_zone(F.col("z")))).first()[0]
        return None if got is None else dt.datetime.fromtimestamp(got, dt.UTC).strftime("%Y-%m-%d %H:%M")

    assert utc("2026-07-01 12:00", "Europe/Madrid") == "2026-07-01 10:00"
    assert utc("2026-03-29 02:30", "Europe/Madrid") is None  # skipped
    assert utc("2026-10-25 02:30", "Europe/Madrid") is None  # shown twice
    assert utc("2026-10-25 03:30", "Europe/Madrid") == "2026-10-25 02:30"
    assert utc("2026-04-05 01:45", "Australia/Lord_Howe") is None  # half an hour twice
    assert utc("2026-07-01 12:00", "America/Phoenix") == "2026-07-01 19:00"
    assert utc("2026-07-01 12:00", "No/Such") is None
    assert utc("2026-07-01 12:00", None) is None
