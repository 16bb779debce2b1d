"""The p-queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycatalog.llm import canonical, leaks, mixing, nearest_time, sentences
from skycatalog.session import read_table, without_blanks

DARK_TOLERANCE_S = 36 * 3600
DARK_TEMP_BAND = 2.0

def _reference(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "targets")
    ids = t.select(F.lit("object").alias("domain"), F.lit("id").alias("kind"), F.explode(F.from_json("catalog_ids_json", "array<string>")).alias("entry"), F.col("canonical_name").alias("canonical"))
    own = t.select(F.lit("object").alias("domain"), F.lit("id").alias("kind"), F.col("canonical_name").alias("entry"), F.col("canonical_name").alias("canonical"))
    names = t.select(F.lit("object").alias("domain"), F.lit("titled").alias("kind"), F.col("display_name").alias("entry"), F.col("canonical_name").alias("canonical"))
    c = read_table(spark, d, "filter_catalog")
    spelled = F.concat(F.array("canonical_name"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")))
    filters = c.select(F.lit("filter").alias("domain"), F.lit("alias").alias("kind"), F.explode(spelled).alias("entry"), F.col("canonical_name").alias("canonical"))
    return ids.unionByName(own).unionByName(names).unionByName(filters)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    f = read_table(spark, d, "frames")
    # one scan gives both fields of a frame
    fields = f.select(F.col("id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(dom).alias("domain"), F.col(c).alias("value")) for c, dom in (("object_raw", "object"), ("filter_raw", "filter"))])).alias("x"))
    frames = fields.select("x.field_name", "row_id", "x.domain", "x.value")
    raw = read_table(spark, d, "filters").select(F.lit("raw_name").alias("field_name"), F.col("id").alias("row_id"), F.lit("filter").alias("domain"), F.col("raw_name").alias("value"))
    out = canonical.canonicalise(frames.unionByName(raw), _reference(spark, d))
    return out.where("value <> canonical").select("field_name", "row_id", "canonical")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    frames = read_table(spark, d, "frames")
    pairs = nearest_time.nearest_in_time(
        frames.where("frame_type = 'light'"),
        frames.where("frame_type = 'dark'"),
        by={"camera": without_blanks("camera_raw"), "exposure": F.col("exposure_seconds")},
        left_id="id",
        right_id="id",
        time="date_obs_utc",
        tolerance_seconds=DARK_TOLERANCE_S,
        band=F.col("ccd_temp"),
        band_width=DARK_TEMP_BAND,
    )
    return pairs.select(F.col("left_id").alias("light_id"), F.col("right_id").alias("dark_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # templates and slots decide; asked for are the pairs whose slots are the item's own
    return p7_leaks(spark, d).where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]
    return shares.withColumn("actual_share", F.round("actual_share", 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_starts(read_table(spark, d, "documents"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(read_table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_sentences": p9_sentences}
ORACLE: dict[str, str] = {
    "p1_found": rf"""
with f as (select distinct id, frame_type, nullif(regexp_replace(lower(camera_raw), '\s+', '', 'g'), '') as camera, exposure_seconds as e, cast(round(ccd_temp * 100) as bigint) as v, date_obs_utc as t
           from frames where id is not null and camera_raw is not null and exposure_seconds is not null and ccd_temp is not null and date_obs_utc is not null),
     p as (select l.id as light_id, r.id as dark_id, row_number() over (partition by l.id order by abs(epoch_us(l.t) - epoch_us(r.t)), r.t, r.id) as k
           from f l join f r on l.camera = r.camera and l.e = r.e and abs(l.v - r.v) <= 200 and abs(epoch_us(l.t) - epoch_us(r.t)) <= 129600000000
           where l.frame_type = 'light' and r.frame_type = 'dark')
select light_id, dark_id from p where k = 1""",
}
