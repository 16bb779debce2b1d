"""The scalar rules as temporary SQL functions, for use from spark.sql; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skycatalog.functions import rules


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    types = ", ".join(f"'{k}', '{v}'" for k, v in rules.IMAGE_TYPES.items())
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    a, b = rules.PATH_EDGE
    words = " ".join(f"WHEN s RLIKE '{a}{w}{b}' THEN '{kind}'" for w, kind in rules.PATH_WORDS)
    functions = {
        "extension_of(name STRING)": r"nullif(lower(regexp_extract(name, r'^.+\.([^.]+)$', 1)), '')",
        "format_of(extension STRING)": f"CASE WHEN lower(extension) IN ({listed(rules.FITS_EXTENSIONS)}) THEN 'fits' WHEN lower(extension) IN ({listed(rules.XISF_EXTENSIONS)}) THEN 'xisf' WHEN lower(extension) IN ({listed(rules.RAW_EXTENSIONS)}) THEN 'raw' END",
        "normalize_image_type(raw STRING)": r"nullif(upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, r'^\s+|\s+$', ''), r'''^''(.*)''$''', '$1') , r'^\s+|\s+$', ''), '[_-]', ' '), r'\s+', ' ')), '')",
        "match_image_type(raw STRING)": f"try_element_at(map({types}), normalize_image_type(raw))",
        "match_path(path STRING)": f"try_element_at(array_compact(transform(reverse(split(lower(replace(path, '\\\\', '/')), '/')), s -> CASE {words} END)), 1)",
        "integration_label(seconds DOUBLE)": "concat(lpad(cast(floor(seconds / 3600) as string), greatest(2, length(cast(floor(seconds / 3600) as string))), '0'), 'h ', lpad(cast(floor(seconds / 60) % 60 as string), 2, '0'), 'm')",
        "astro_day(ts TIMESTAMP, zone STRING)": "to_date(from_utc_timestamp(ts, zone) - INTERVAL 12 HOURS)",
    }
    for head, body in functions.items():
        body = body.replace("r'''^''(.*)''$'''", "\"^'(.*)'$\"")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in functions]
