"""Frame records: from header keywords to typed fields, and their upsert by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycatalog.functions import rules, scalar

#: Columns that a re-parse never touches.
KEPT = ["target_id", "filter_id", "session_id", "equipment_profile_id", "fwhm", "hfr", "star_count"]


def header_text(headers: Column, keyword: str) -> Column:
    """String value of a keyword; numbers, booleans and absent keywords are NULL."""
    v = F.try_variant_get(headers, f"$['{keyword}']", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(headers, f"$['{keyword}']", "string"))


def header_number(headers: Column, keyword: str) -> Column:
    """Numeric value of a keyword; numbers written as text are NULL."""
    kind = F.schema_of_variant(F.try_variant_get(headers, f"$['{keyword}']", "variant"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(headers, f"$['{keyword}']", "double"))


def text_number(headers: Column, keyword: str) -> Column:
    """Number of a keyword whose value is text, as XISF writes all values; NULL if it is no finite number."""
    n = F.trim(F.try_variant_get(headers, f"$['{keyword}']", "string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def _xisf_first(field: str, keywords: list[str], get) -> Column:
    """The first keyword, else the native property that stands in for it, else the other keywords."""
    prop = [f"prop:{rules.XISF_PROPERTIES[field]}"] if field in rules.XISF_PROPERTIES else []
    return F.coalesce(*[get(F.col("_h"), k) for k in [keywords[0], *prop, *keywords[1:]]])


def frame_records(rows: DataFrame, headers_json: str, keep: list[str], format: Column | None = None) -> DataFrame:
    """Typed record of each header, by the rules of its `format` ('fits' by default, 'xisf', 'raw').

    FITS: strings only from strings, numbers only from numbers, first present keyword wins.  XISF: all values are text; native
    properties stand in for absent keywords.  Camera RAW: exposure, time, camera and ISO (as gain) from EXIF, all else NULL.
    Malformed or NULL headers give NULL fields.
    """
    h = rows.select(*keep, F.try_parse_json(headers_json).alias("_h"), (F.lit("fits") if format is None else F.coalesce(format, F.lit("fits"))).alias("_format"))
    first = lambda get, ks: F.coalesce(*[get(F.col("_h"), k) for k in ks])
    text = {f: first(header_text, ks) for f, ks in rules.STRING_KEYWORDS.items()}
    num = {f: first(header_number, ks) for f, ks in rules.NUMBER_KEYWORDS.items()}
    if format is not None:
        is_xisf, is_raw = F.col("_format") == "xisf", F.col("_format") == "raw"
        exif = {
            "exposure_seconds": header_number(F.col("_h"), "ExposureTime"), "gain": header_number(F.col("_h"), "ISO"),
            "date_obs": scalar.exif_date_obs(header_text(F.col("_h"), "DateTimeOriginal"), header_text(F.col("_h"), "OffsetTimeOriginal")),
            "instrument": scalar.camera_name(header_text(F.col("_h"), "Make"), header_text(F.col("_h"), "Model")),
        }
        none = lambda kind: F.lit(None).cast(kind)
        text = {f: F.when(is_raw, exif.get(f, none("string"))).when(is_xisf, _xisf_first(f, rules.STRING_KEYWORDS[f], header_text)).otherwise(c) for f, c in text.items()}
        num = {f: F.when(is_raw, exif.get(f, none("double"))).when(is_xisf, _xisf_first(f, rules.NUMBER_KEYWORDS[f], text_number)).otherwise(c) for f, c in num.items()}
    num["ra_deg"] = scalar.ra_degrees(num["ra_deg"], header_text(F.col("_h"), "OBJCTRA"))
    num["dec_deg"] = scalar.dec_degrees(num["dec_deg"], header_text(F.col("_h"), "OBJCTDEC"))
    profile = scalar.detect_profile(lambda k: header_text(F.col("_h"), k))
    original = dict(num)
    for name, field, keyword in rules.FIXUPS:  # each reads the record as it was; a later one wins
        num[field] = F.coalesce(original[field], F.when(profile == name, header_number(F.col("_h"), keyword)), num[field])
    return h.select(*keep, *[c.alias(f) for f, c in {**text, **num}.items()], profile.alias("capture_profile"))


def date_obs_utc(text: Column) -> Column:
    """Instant of a header's DATE-OBS, read as UTC; NULL if it is no time."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", ""))


def upsert_frames(frames: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row a file: parsed columns overwrite, NULLs included; a manual type and its source stay, as do the columns in KEPT.

    `parsed` has file_id and some of the frames' columns; of several rows of a file the first by content is taken.  Rows without
    file_id are ignored.  New files are added with an id derived from the file's.
    """
    given = [c for c in parsed.columns if c != "file_id" and c in frames.columns and c not in KEPT]
    p = parsed.where("file_id is not null").groupBy("file_id").agg(F.min(F.struct(*[F.col(c) for c in given])).alias("_p"))
    j = frames.withColumn("_was", F.lit(True)).join(p.withColumn("_now", F.lit(True)), "file_id", "full_outer")
    manual = F.coalesce(F.col("frame_type_source") == "manual", F.lit(False))

    def column(c: str) -> Column:
        if c == "file_id":
            return F.col(c)
        if c == "id":
            return F.coalesce(F.col("id"), F.sha2("file_id", 256)).alias("id")
        if c not in given:
            return F.col(c)
        fresh = F.col("_now").isNotNull() & (~manual if c in ("frame_type", "frame_type_source") else F.lit(True))
        return F.when(fresh, F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c)

    return j.select(*[column(c) for c in frames.columns])
