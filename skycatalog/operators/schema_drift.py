"""Schemas that drift between the files of a source: one uniform table and a report of each change (problem 3).

Method: rows are read as path-value maps with raw types (VARIANT), path-type statistics are aggregated by file, and
typed columns are projected from them with failed casts reported.

Renames are told from a removal next to an addition by what the two fields carry: a field's value repeats
under a path of the other level (top-level field and header keyword), or the sets of values overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycatalog.session import cut_lineage

#: Least evidence (0..1) for a removed and an added field to be one renamed field.
RENAME_EVIDENCE = 0.5
NESTED = "headers"

LEAF_OF_OBJECT = ("value", "val", "v")


def _json_type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "STRING", "string")
        .otherwise("number")
    )


# A number with the unit written after it.
MEASURE = r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:\s*([A-Za-z°%]{1,6}))?$"
# What one of a unit is in another.
UNIT_FACTORS = {("ms", "s"): 0.001, ("sec", "s"): 1.0, ("min", "s"): 60.0, ("h", "s"): 3600.0, ("degc", "c"): 1.0, ("°c", "c"): 1.0, ("celsius", "c"): 1.0, ("um", "mm"): 0.001, ("cm", "mm"): 10.0, ("m", "mm"): 1000.0}


def _leaf(raw: Column) -> Column:
    """Comparable text of a value: numbers without their form or unit, times as epoch milliseconds, else trimmed text."""
    # texts that are no times must not reach the parser, whose failures are slow
    when = F.try_to_timestamp(F.nullif(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)Z?$", 1), F.lit("")))
    number = F.regexp_extract(raw, MEASURE, 1).try_cast("double")
    return F.coalesce(F.unix_millis(when).cast("double").cast("string"), number.cast("string"), F.nullif(raw, F.lit("")))


def path_values(rows: DataFrame, *, source: str, file: str, at: str, line: str, payload: str) -> DataFrame:
    """(source, file, at, line, path, type, raw, unit, json): one row for each field of each JSON line, from one pass over its text.

    Paths are top-level keys or 'headers.KEY'.  `raw` is the value as text (of an object that holds a value, that value), `unit` the
    unit written with it, `json` the value as JSON.  Lines repeated under one line number count once; NULL or malformed payloads
    and payloads that are no objects give no rows.
    """
    r = rows.select(F.col(source).alias("source"), F.col(file).alias("file"), F.col(at).alias("at"), F.col(line).alias("line"), F.col(payload).alias("payload"))
    r = r.where("file is not null and payload is not null").distinct()
    members = lambda path: F.map_entries(F.try_variant_get("doc", path, "map<string,variant>"))
    r = r.withColumn("doc", F.try_parse_json("payload")).select("source", "file", "at", "line", members("$").alias("top"), members(f"$.{NESTED}").alias("nested"))
    nested = F.transform("nested", lambda e: F.struct(F.concat(F.lit(NESTED + "."), e["key"]).alias("key"), e["value"].alias("value")))
    cells = F.when(F.col("nested").isNull(), F.col("top")).otherwise(F.concat("top", nested))
    v = F.col("e.value")
    c = r.select("source", "file", "at", "line", F.col("nested").isNotNull().alias("has_nested"), F.explode(cells).alias("e"))
    kind = F.when((F.col("e.key") == NESTED) & F.col("has_nested"), "object").otherwise(_json_type(v))
    c = c.select("source", "file", "at", "line", F.col("e.key").alias("path"), kind.alias("type"), v.alias("v"))
    inner = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in LEAF_OF_OBJECT])
    raw = F.trim(F.when(F.col("type") == "object", inner).otherwise(F.try_variant_get("v", "$", "string")))
    c = c.withColumn("raw", raw)
    unit = F.when(F.col("type") == "object", F.try_variant_get("v", "$.unit", "string")).when(F.col("type") == "string", F.regexp_extract("raw", MEASURE, 2))
    return c.select("source", "file", "at", "line", "path", "type", "raw", F.nullif(F.lower(F.trim(unit)), F.lit("")).alias("unit"), F.to_json("v").alias("json"))


def path_statistics(pv: DataFrame) -> DataFrame:
    """(source, file, at, path, lines, nulls, type): the type is that of most non-null values (ties: the type first by name)."""
    by_type = pv.groupBy("source", "file", "at", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    return by_type.groupBy("source", "file", "at", "path").agg(
        F.sum("n").alias("lines"),
        F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        F.min(F.when(F.col("type") != "null", F.struct(-F.col("n"), F.col("type").alias("type")))).getField("type").alias("type"),
    )


def _file_order(stats: DataFrame) -> DataFrame:
    """(source, file, prev_file): files of a source by time, then name; files without a time come first.

    In two levels, so that a source with most of the files is no single window: within days, and over the days' last files.
    """
    files = stats.groupBy("source", "file").agg(F.min("at").alias("at"))
    files = files.select("source", "file", F.struct(F.col("at"), F.col("file")).alias("key"), F.coalesce(F.unix_date(F.to_date("at")), F.lit(-(2**31))).alias("day"))
    days = files.groupBy("source", "day").agg(F.max("key").alias("last"))
    before = days.select("source", "day", F.lag("last.file").over(Window.partitionBy("source").orderBy("day")).alias("day_before"))
    w = Window.partitionBy("source", "day").orderBy("key")
    inside = files.withColumn("prev_file", F.lag("file").over(w)).withColumn("first", F.row_number().over(w) == 1)
    out = inside.join(before, ["source", "day"]).select("source", "file", F.when(F.col("first"), F.col("day_before")).otherwise(F.col("prev_file")).alias("prev_file"))
    return out.where("prev_file is not null")


def schema_changes(pv: DataFrame) -> DataFrame:
    """(source, file, field_path, change_kind, new_path) against the preceding file of the same source.

    'added', 'removed', 'type_changed' (path in the later file), 'renamed' (old path; `new_path` carries the same quantity; not
    also added or removed).  `new_path` is '' otherwise.  A field with only nulls has no type, so it never changes type.
    """
    pv = cut_lineage(pv.select("source", "file", "at", "line", "path", "type", "raw"))  # the texts are parsed once
    stats = cut_lineage(path_statistics(pv))
    order = _file_order(stats)
    now = stats.select("source", F.col("file"), "path", "type").join(order, ["source", "file"])
    then = stats.select("source", F.col("file").alias("prev_file"), "path", F.col("type").alias("prev_type"), F.lit(True).alias("was")).join(order, ["source", "prev_file"])
    both = now.withColumn("is", F.lit(True)).join(then, ["source", "file", "prev_file", "path"], "full")
    both = both.select("source", "file", "prev_file", "path", "type", "prev_type", F.coalesce("is", F.lit(False)).alias("is"), F.coalesce("was", F.lit(False)).alias("was"))
    changes = cut_lineage(both.where("is <> was or type <> prev_type"))
    renamed = cut_lineage(_renames(pv, changes))
    gone = renamed.select("source", "file", F.col("old_path").alias("path"), F.lit(True).alias("hit")).unionByName(renamed.select("source", "file", F.col("new_path").alias("path"), F.lit(True).alias("hit")))
    plain = changes.join(gone, ["source", "file", "path"], "left").where("hit is null")
    kind = F.when(F.col("is") & ~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("type_changed")
    out = plain.select("source", "file", F.col("path").alias("field_path"), kind.alias("change_kind"), F.lit("").alias("new_path"))
    moved = renamed.select("source", "file", F.col("old_path").alias("field_path"), F.lit("renamed").alias("change_kind"), "new_path")
    retyped = renamed.where("type <> prev_type").select("source", "file", F.col("new_path").alias("field_path"), F.lit("type_changed").alias("change_kind"), F.lit("").alias("new_path"))
    return out.unionByName(moved).unionByName(retyped)


def _level(path: Column) -> Column:
    return path.startswith(NESTED + ".")


def _renames(pv: DataFrame, changes: DataFrame) -> DataFrame:
    """(source, file, old_path, new_path, prev_type, type): the best mutual pairs of removed and added fields of a file and level.

    Evidence of a pair: (a) the share of lines in which the old field's value repeats under a path of the other level that repeats
    the new field's value in the later file (or under a counterpart that was itself removed and added); (b) the overlap of
    value sets.  Only files in which a field of a level went and another came are looked at.
    """
    moved = changes.where("is <> was").select("source", "file", "prev_file", "path", "is", "type", "prev_type", _level(F.col("path")).alias("deep"))
    # fields that went and came, of files in which a level has both; of the old ones the values of the preceding file count
    swaps = moved.groupBy("source", "file", "deep").agg(F.bool_or("is").alias("came"), F.bool_or(~F.col("is")).alias("went")).where("came and went").select("source", "file", "deep")
    sides = cut_lineage(moved.join(swaps, ["source", "file", "deep"]).select("source", "file", F.when(F.col("is"), F.col("file")).otherwise(F.col("prev_file")).alias("at_file"), "path", "is", "deep", "type", "prev_type"))
    looked_at = sides.select("source", F.col("at_file").alias("file")).distinct()
    values = pv.join(looked_at, ["source", "file"], "left_semi").select("source", F.col("file").alias("at_file"), "line", "path", _leaf(F.col("raw")).alias("leaf")).where("leaf is not null")
    values = cut_lineage(values)
    mine = cut_lineage(sides.select("source", "file", "at_file", "path", "is", "deep").join(values, ["source", "at_file", "path"]))
    other = values.select("source", "at_file", "line", "leaf", F.col("path").alias("mirror"))
    hits = mine.join(other, ["source", "at_file", "line", "leaf"]).where(F.col("deep") != _level(F.col("mirror")))
    # a row a field: its lines and values, and the share of lines in which each path of the other level repeats it
    field = ["source", "file", "path", "is"]
    size = mine.groupBy(*field).agg(F.countDistinct("line").alias("lines"), F.countDistinct("leaf").alias("own"))
    hit = hits.groupBy(*field, "mirror").agg(F.countDistinct("line").alias("hit")).groupBy(*field).agg(F.map_from_entries(F.collect_list(F.struct("mirror", "hit"))).alias("hits"))
    seen = size.join(hit, field, "left").withColumn("mirrors", F.transform_values(F.coalesce("hits", F.create_map().cast("map<string,bigint>")), lambda _, n: n / F.col("lines"))).drop("hits")
    # all fields of a file stand in one row: their number does not grow with the lines
    known = sides.select(*field, "deep", "type", "prev_type").join(seen, field, "left")
    cell = F.struct("path", "deep", "type", "prev_type", "own", "mirrors")
    a_file = known.groupBy("source", "file").agg(F.collect_list(F.when(~F.col("is"), cell)).alias("old"), F.collect_list(F.when(F.col("is"), cell)).alias("new"))
    names = lambda c: F.transform(c, lambda x: x["path"])
    p = a_file.select("source", "file", names("old").alias("gone"), names("new").alias("born"), F.explode("old").alias("o"), F.col("new")).select("source", "file", "gone", "born", "o", F.explode("new").alias("n"))
    p = p.where("o.deep = n.deep and o.own is not null and n.own is not null").select("source", "file", "gone", "born", F.col("o.path").alias("old_path"), F.col("n.path").alias("new_path"), F.col("o.prev_type").alias("prev_type"), F.col("n.type").alias("type"), F.col("o.own").alias("old_own"), F.col("n.own").alias("new_own"), F.col("o.mirrors").alias("om"), F.col("n.mirrors").alias("nm"))
    # the values that both fields of a pair carry, counted exactly
    leaves = mine.select("source", "file", "path", "is", "deep", "leaf").distinct()
    carried = lambda new, path: leaves.where(F.col("is") == new).select("source", "file", "deep", "leaf", F.col("path").alias(path))
    common = carried(False, "old_path").join(carried(True, "new_path"), ["source", "file", "deep", "leaf"]).groupBy("source", "file", "old_path", "new_path").agg(F.count(F.lit(1)).alias("common"))
    p = p.join(common, ["source", "file", "old_path", "new_path"], "left")
    # a mirror that was itself removed or added stands for its level's counterpart
    om, nm = F.col("om"), F.col("nm")
    same = F.array_max(F.transform(F.map_keys(om), lambda k: F.least(F.try_element_at(om, k), F.coalesce(F.try_element_at(nm, k), F.lit(0.0)))))
    lost = F.array_max(F.transform(F.filter(F.map_keys(om), lambda k: F.array_contains("gone", k)), lambda k: F.try_element_at(om, k)))
    new = F.array_max(F.transform(F.filter(F.map_keys(nm), lambda k: F.array_contains("born", k)), lambda k: F.try_element_at(nm, k)))
    mirrored = F.greatest(F.coalesce(same, F.lit(0.0)), F.least(F.coalesce(lost, F.lit(0.0)), F.coalesce(new, F.lit(0.0))))
    overlap = F.coalesce("common", F.lit(0)) / F.least("old_own", "new_own")
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, 2))
    alike = F.size(F.array_intersect(grams(F.col("old_path")), grams(F.col("new_path")))) / F.size(F.array_union(grams(F.col("old_path")), grams(F.col("new_path"))))
    p = p.withColumn("evidence", F.greatest(mirrored, overlap)).where(F.col("evidence") >= RENAME_EVIDENCE)
    p = p.withColumn("score", F.col("evidence") + 0.5 * F.least(mirrored, overlap) + alike)
    for mine_, rank in (("old_path", "r_old"), ("new_path", "r_new")):
        p = p.withColumn(rank, F.row_number().over(Window.partitionBy("source", "file", mine_).orderBy(F.desc("score"), "old_path", "new_path")))
    return p.where("r_old = 1 and r_new = 1").select("source", "file", "old_path", "new_path", "prev_type", "type")


def all_lines(rows: DataFrame, *, source: str, file: str, line: str, payload: str) -> DataFrame:
    """(source, file, line, unreadable): every line once; `unreadable` if it has a text but none that is a JSON object."""
    r = rows.select(F.col(source).alias("source"), F.col(file).alias("file"), F.col(line).alias("line"), F.col(payload).alias("payload")).where("file is not null")
    good = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>").isNotNull()
    return r.groupBy("source", "file", "line").agg((F.max(F.trim("payload") != "") & ~F.max(good)).alias("unreadable")).withColumn("unreadable", F.coalesce("unreadable", F.lit(False)))


def paths_of_fields(renames: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """(source, path, field, rank): paths that chains of renames tie to a field's own paths in a source, nearer ones first."""
    own = [(p, c, i) for c, (_, paths, *_) in fields.items() for i, p in enumerate(paths)]
    known = F.create_map(*[x for p, c, i in own for x in (F.lit(p), F.struct(F.lit(c).alias("field"), F.lit(i).alias("rank")))])
    edges = renames.select("source", F.col("field_path").alias("a"), F.col("new_path").alias("b"))
    edges = cut_lineage(edges.unionByName(edges.select("source", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    step = edges.select("source", F.col("a").alias("path"), F.try_element_at(known, F.col("a")).alias("f")).where("f is not null").distinct().select("source", "path", "f.field")
    found, hop = None, max(len(spec[1]) for spec in fields.values())
    while True:
        near = step.withColumnRenamed("path", "a").join(edges, ["source", "a"]).where(F.try_element_at(known, F.col("b")).isNull())
        step = near.groupBy("source", F.col("b").alias("path")).agg(F.min("field").alias("field"))
        step = cut_lineage(step if found is None else step.join(found, ["source", "path"], "left_anti"))
        ranked = step.withColumn("rank", F.lit(hop))
        found = ranked if found is None else found.unionByName(ranked)
        if step.isEmpty():
            return found
        hop += 1


def uniform_table(pv: DataFrame, fields: dict[str, tuple], *, lines: DataFrame | None = None, renames: DataFrame | None = None) -> DataFrame:
    """(source, file, line, one typed column a field, failed_casts, rest): the drifting lines as one table.

    `fields` maps a column to its type, the paths that may carry it, the first present one wins, and its unit, if any: a value written
    with another unit is converted by UNIT_FACTORS, or is a failed cast where that has no factor.  Paths that `renames` (of
    `schema_changes`) ties to them in a source come after.  Where a value of any JSON type is present but can't be cast, the column
    is NULL and the field is listed in `failed_casts`; a line of `lines` that is no JSON object lists 'payload'.  `rest` maps
    every path that no field lists to its value as JSON.  Lines repeated in a file give one row.
    """
    named = F.create_map(*[x for c, (_, paths, *_) in fields.items() for i, p in enumerate(paths) for x in (F.lit(p), F.struct(F.lit(c).alias("field"), F.lit(i).alias("rank")))])
    is_nested = (F.col("path") == NESTED) & (F.col("type") == "object")  # its members are paths of their own
    cell = pv.where(~is_nested).withColumn("leaf", _leaf(F.col("raw"))).withColumn("f", F.try_element_at(named, F.col("path"))).drop("raw", "at")
    tied = paths_of_fields(renames, fields) if renames is not None else None
    if tied is not None:
        cell = cell.join(tied, ["source", "path"], "left").withColumn("field", F.coalesce("f.field", "field")).withColumn("rank", F.coalesce("f.rank", "rank"))
    else:
        cell = cell.withColumn("field", F.col("f.field")).withColumn("rank", F.col("f.rank"))
    blank = (F.col("type") == "null") | ((F.col("type") == "string") & F.col("leaf").isNull())
    pick = F.struct(F.col("leaf").isNull().alias("none"), F.col("rank"), F.col("leaf"), F.col("unit"))
    best = [F.min(F.when((F.col("field") == c) & ~blank, pick)).alias(c) for c in fields]
    others = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("f").isNull(), F.struct("path", F.coalesce("json", F.lit("null")).alias("json"))))))
    keys = ["source", "file", "line"]
    wide = cell.groupBy(*keys).agg(*best, others.alias("rest"))
    every = (lines if lines is not None else pv.select(*keys).distinct().withColumn("unreadable", F.lit(False))).select(*[F.col(k).alias(f"l_{k}") for k in keys], "unreadable")
    wide = every.join(wide, F.col("l_source").eqNullSafe(F.col("source")) & (F.col("l_file") == F.col("file")) & F.col("l_line").eqNullSafe(F.col("line")), "left")
    cols, bad = [], []
    for c, (kind, _, *unit) in fields.items():
        leaf, written = F.col(c).getField("leaf"), F.col(c).getField("unit")
        v = leaf.try_cast(kind) if kind != "timestamp" else F.timestamp_millis(leaf.try_cast("double").cast("bigint"))
        if unit:
            factors = F.create_map(*[F.lit(x) for x in (unit[0], 1.0)], *[F.lit(x) for (a, b), n in UNIT_FACTORS.items() if b == unit[0] and a != b for x in (a, n)])
            v = v * F.when(written.isNull(), 1.0).otherwise(F.try_element_at(factors, written))
        cols.append(v.alias(c))
        bad.append(F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)))
    bad.append(F.when(F.col("unreadable"), F.lit("payload")))
    rest = F.coalesce("rest", F.create_map().cast("map<string,string>"))
    return wide.select(*[F.col(f"l_{k}").alias(k) for k in keys], *cols, F.array_compact(F.array(*bad)).alias("failed_casts"), rest.alias("rest"))
