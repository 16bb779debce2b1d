"""Sessions, targets, filters, calibration and review: the catalog's composite operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skycatalog.functions import scalar
from skycatalog.session import cut_lineage

#: Degrees of declination of a band of the cone search.
BAND = 1.0


def target_aliases(targets: DataFrame) -> DataFrame:
    """(target_id, alias): canonical name, display name and catalog ids of each target, normalised."""
    names = F.concat(F.array("canonical_name", "display_name"), F.coalesce(F.from_json("catalog_ids_json", "array<string>"), F.array().cast("array<string>")))
    a = targets.select(F.col("id").alias("target_id"), F.explode(names).alias("raw"))
    return a.where("raw is not null").select("target_id", normal_name(F.col("raw")).alias("alias")).distinct()


def normal_name(raw: Column) -> Column:
    """Name for exact lookup: upper case, letters and digits parted by one blank, other marks blanks."""
    t = F.regexp_replace(F.upper(raw), r"[^A-Z0-9]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"([A-Z])([0-9])", "$1 $2"), r"([0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(t, r"\b0+([0-9])", "$1"))


def resolve_targets(frames: DataFrame, targets: DataFrame, radius_degrees: float = 1.0) -> DataFrame:
    """(id, target, panel, how): exact alias lookup of the object name without its mosaic panel, then the nearest target in a cone.

    how: 'alias'; 'cone' (a proposal by position, for names that resolve to nothing); 'review'.  Equal aliases: the first name; equal
    distances: the first name.  Frames without position or with a blank name are looked up by the other alone.
    """
    alias = target_aliases(targets).join(targets.select(F.col("id").alias("target_id"), "canonical_name"), "target_id").groupBy("alias").agg(F.min("canonical_name").alias("target"))
    whole = F.regexp_replace(F.upper("object_raw"), r"(PANEL[ _-]*|_P)[0-9]+", " ")
    f = frames.select("id", normal_name(whole).alias("alias"), scalar.mosaic_panel(F.col("object_raw")).alias("panel"), "ra_deg", "dec_deg").where("alias <> ''")
    named = cut_lineage(f.join(alias, "alias", "left"))
    near = cone_search(named.where("target is null").select("id", "ra_deg", "dec_deg"), targets, radius_degrees).join(targets.select(F.col("id").alias("target_id"), "canonical_name"), "target_id")
    near = near.groupBy("id").agg(F.min(F.struct(F.round("separation", 6), "canonical_name")).getField("canonical_name").alias("nearest"))
    how = F.when(F.col("target").isNotNull(), "alias").when(F.col("nearest").isNotNull(), "cone").otherwise("review")
    return named.join(near, "id", "left").select("id", F.coalesce("target", "nearest").alias("target"), "panel", how.alias("how"))


def cone_search(points: DataFrame, targets: DataFrame, radius_degrees: float) -> DataFrame:
    """(id, target_id, separation): for each point all targets within the radius.

    Declination bands as wide as the radius (at least BAND) make an equi-join: a target stands in its own band and the two beside.
    """
    width = max(radius_degrees, BAND)
    p = points.select("id", "ra_deg", "dec_deg").dropna().distinct().withColumn("band", F.floor(F.col("dec_deg") / width).cast("int"))
    t = targets.select(F.col("id").alias("target_id"), F.col("ra_deg").alias("t_ra"), F.col("dec_deg").alias("t_dec")).dropna()
    t = t.withColumn("t_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("t_dec") / width).cast("int") + o)))
    d = scalar.separation_degrees(F.col("ra_deg"), F.col("dec_deg"), F.col("t_ra"), F.col("t_dec"))
    return p.join(t, F.col("band") == F.col("t_band")).where(F.abs(F.col("dec_deg") - F.col("t_dec")) <= radius_degrees).withColumn("separation", d).where(F.col("separation") <= radius_degrees).select("id", "target_id", "separation")


def detect_sessions(frames: DataFrame, zone: str = "UTC", gap_hours: int = 4, locked: DataFrame | None = None) -> DataFrame:
    """(equipment_profile_id, astro_day, started_at_utc, ended_at_utc, event_count, distinct_count, kind): sessions by night, rig and gap.

    `frames` has one row an id; kind is 'calibration' where a session has no light frame.  Frames in `locked(id)` were assigned by
    hand and take no part.  The gaps are found by a window over one night of one rig, which has no more frames than a night has time for.
    """
    f = frames.where("date_obs_utc is not null")
    if locked is not None:
        f = f.join(locked.select(F.col("id").alias("_lock")), F.col("id") == F.col("_lock"), "left_anti")
    f = f.select("id", F.coalesce("equipment_profile_id", F.lit("?")).alias("equipment_profile_id"), scalar.astro_day(F.col("date_obs_utc"), zone).cast("string").alias("astro_day"), "date_obs_utc", "target_id", "frame_type")
    night = Window.partitionBy("equipment_profile_id", "astro_day").orderBy("date_obs_utc", "id")
    at = F.unix_micros("date_obs_utc")
    f = f.withColumn("fresh", F.when(at - F.lag(at).over(night) <= gap_hours * 3_600_000_000, 0).otherwise(1)).withColumn("n", F.sum("fresh").over(night))
    return f.groupBy("equipment_profile_id", "astro_day", "n").agg(
        F.min("date_obs_utc").alias("started_at_utc"), F.max("date_obs_utc").alias("ended_at_utc"), F.count(F.lit(1)).alias("event_count"), F.countDistinct("target_id").alias("distinct_count"),
        F.when(F.bool_or(F.col("frame_type") == "light"), "light").otherwise("calibration").alias("kind"),
    ).drop("n")


#: What a master of each kind must have in common with the lights; a dark's temperature is within 2 degrees where both are known.
MASTER_KEYS = {"dark": ["camera", "exposure", "gain", "offset", "binning"], "bias": ["camera", "gain", "offset", "binning"], "flat": ["camera", "binning", "filter"]}


def match_calibration(sessions: DataFrame, masters: DataFrame, w_temp: float = 0.5, w_recency: float = 0.3, w_count: float = 0.2, stale_days: int = 30) -> DataFrame:
    """(group_id, kind, master_id, score, status, group_status): best master of each kind for each light group.

    `sessions`: group_id, camera, exposure, gain, offset, binning, temp, filter, at.  `masters`: master_id, kind, the same columns and
    sub_count.  The best by score (to nine decimals), then the smallest id, by one aggregation over an equi-join a kind; NULL
    equals NULL in a key but for camera and exposure; unknown dates count as far apart.  status: 'complete', 'stale' (a flat more than `stale_days` away), 'missing'; of
    a group: 'missing' if it has no master, 'partial' if not all kinds, 'stale' if one is, else 'complete'.
    """
    hits = None
    for kind, keys in MASTER_KEYS.items():
        m = masters.where(F.col("kind") == kind).select("master_id", "sub_count", *[F.col(c).alias(f"m_{c}") for c in ("at", "temp", *keys)])
        on = [(F.col(k) == F.col(f"m_{k}")) if k in ("camera", "exposure") else F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
        apart = F.abs(F.col("temp") - F.col("m_temp"))
        if kind == "dark":
            on.append(F.coalesce(apart <= 2.0, F.lit(True)))
        j = sessions.join(m, on)
        days = F.abs(F.datediff("at", "m_at"))
        score = w_temp * (1 - F.least(F.coalesce(apart, F.lit(2.0)) / 2.0, F.lit(1.0))) + w_recency * F.coalesce(F.exp(-days / 30.0), F.lit(0.0)) + w_count * F.least(F.col("sub_count") / 30.0, F.lit(1.0))
        hit = j.select("group_id", F.lit(kind).alias("kind"), F.struct((-F.round(score, 9)).alias("s"), "master_id", days.alias("days")).alias("w"))
        hits = hit if hits is None else hits.unionByName(hit)
    best = hits.groupBy("group_id", "kind").agg(F.min("w").alias("w"))
    every = sessions.select("group_id", F.explode(F.array(*[F.lit(k) for k in MASTER_KEYS])).alias("kind")).distinct()
    status = F.when(F.col("w").isNull(), "missing").when((F.col("kind") == "flat") & (F.col("w.days") > stale_days), "stale").otherwise("complete")
    out = every.join(best, ["group_id", "kind"], "left").select("group_id", "kind", "w.master_id", F.round(-F.col("w.s"), 6).alias("score"), status.alias("status"))
    group = Window.partitionBy("group_id")  # a row a kind
    number = lambda s: F.sum((F.col("status") == s).cast("int")).over(group)
    whole = F.when(number("missing") == len(MASTER_KEYS), "missing").when(number("missing") > 0, "partial").when(number("stale") > 0, "stale").otherwise("complete")
    return out.withColumn("group_status", whole)


def review_queue(frames: DataFrame, files: DataFrame, filters: DataFrame, targets: DataFrame) -> DataFrame:
    """(kind, entity_id): unresolved targets and filters, unknown types and duplicate files as one queue."""
    lights = frames.where("frame_type = 'light'")
    a = lights.where("object_raw is not null").join(targets.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(F.lit("target").alias("kind"), F.col("id").alias("entity_id"))
    b = lights.where("filter_raw is not null").join(filters.select(F.col("id").alias("filter_id")), "filter_id", "left_anti").select(F.lit("filter").alias("kind"), F.col("id").alias("entity_id"))
    c = frames.where("frame_type = 'unknown'").select(F.lit("frame_type").alias("kind"), F.col("id").alias("entity_id"))
    d = files.where("status = 'duplicate'").select(F.lit("duplicate").alias("kind"), F.col("id").alias("entity_id"))
    return a.unionByName(b).unionByName(c).unionByName(d).distinct()


def dashboard(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(metric, label, value): totals, nights by month, hours by filter and rig, library size, in one union."""
    f = frames.where("frame_type = 'light'")
    hours = F.round(F.sum("exposure_seconds") / 3600, 4)
    total = f.agg(hours.alias("value")).select(F.lit("hours").alias("metric"), F.lit("all").alias("label"), "value")
    month = f.where("date_obs_utc is not null").groupBy(F.date_format("date_obs_utc", "yyyy-MM").alias("label")).agg(F.countDistinct(scalar.astro_day(F.col("date_obs_utc"))).cast("double").alias("value")).select(F.lit("nights").alias("metric"), "label", "value")
    by = lambda metric, col: f.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(hours.alias("value")).select(F.lit(metric).alias("metric"), "label", "value")
    size = files.where("status <> 'missing'").groupBy(F.coalesce("extension", F.lit("")).alias("label")).agg(F.sum("size_bytes").cast("double").alias("value")).select(F.lit("bytes").alias("metric"), "label", "value")
    return total.unionByName(month).unionByName(by("filter_hours", "filter_id")).unionByName(by("rig_hours", "equipment_profile_id")).unionByName(size)


def equipment_in_use(frames: DataFrame) -> DataFrame:
    """Distinct rigs as they stand in the headers, with frames and span."""
    return frames.where("telescope_raw is not null or camera_raw is not null").groupBy(
        F.lower(F.trim("telescope_raw")).alias("telescope"), F.lower(F.trim(F.regexp_replace("camera_raw", r"\s+", " "))).alias("camera"), "focal_length"
    ).agg(F.count(F.lit(1)).alias("frame_count"), F.min("date_obs_utc").alias("first_used"), F.max("date_obs_utc").alias("last_used"))


def path_list(files: DataFrame, root: str, include_missing: bool = False) -> DataFrame:
    """Absolute paths for export; missing files only if asked for."""
    f = files if include_missing else files.where("status <> 'missing'")
    return f.select(F.concat_ws("/", F.lit(root), "watch_folder_id", "relative_path").alias("path"))


def recommend(targets: DataFrame, frames: DataFrame, goal_hours: float) -> DataFrame:
    """Targets by what is missing to their goal, weighted with the balance of filters."""
    f = frames.where("frame_type = 'light' and target_id is not null")
    per = f.groupBy("target_id", "filter_id").agg(F.sum("exposure_seconds").alias("s"))
    t = per.groupBy("target_id").agg((F.sum("s") / 3600).alias("hours"), (F.min("s") / F.max("s")).alias("balance"))
    j = targets.select(F.col("id").alias("target_id"), "canonical_name").join(t, "target_id", "left")
    remaining = F.greatest(goal_hours - F.coalesce("hours", F.lit(0.0)), F.lit(0.0))
    return j.select("canonical_name", F.round(remaining, 4).alias("remaining_hours"), F.round(0.7 * remaining / goal_hours + 0.3 * (1 - F.coalesce("balance", F.lit(0.0))), 6).alias("score"))


def forecast_completion(frames: DataFrame, goal_hours: float) -> DataFrame:
    """Nights each target still needs at its mean pace of hours a night."""
    f = frames.where("frame_type = 'light' and target_id is not null and date_obs_utc is not null")
    night = f.groupBy("target_id", scalar.astro_day(F.col("date_obs_utc")).alias("night")).agg((F.sum("exposure_seconds") / 3600).alias("h"))
    t = night.groupBy("target_id").agg(F.sum("h").alias("hours"), F.count(F.lit(1)).alias("nights"))
    left = F.greatest(goal_hours - F.col("hours"), F.lit(0.0))
    return t.select("target_id", F.round("hours", 4).alias("hours"), "nights", F.when(F.col("hours") > 0, F.ceil(F.round(left / (F.col("hours") / F.col("nights")), 6))).cast("bigint").alias("nights_to_goal"))


def mosaic_progress(frames: DataFrame) -> DataFrame:
    """Hours and frames by target and mosaic panel."""
    f = frames.where("frame_type = 'light'").withColumn("panel", scalar.mosaic_panel(F.col("object_raw"))).where("panel is not null")
    return f.groupBy("target_id", "panel").agg(F.round(F.sum("exposure_seconds") / 3600, 4).alias("hours"), F.count(F.lit(1)).alias("frame_count"))


def filter_sequence(frames: DataFrame) -> DataFrame:
    """Session detail: runs of filters in order of time, counts and mean quality (A13). A session is a night of one rig."""
    w = Window.partitionBy("session_id").orderBy("date_obs_utc", "id")
    f = frames.where("session_id is not null and frame_type = 'light' and date_obs_utc is not null").withColumn("fresh", F.when(F.lag("filter_id").over(w).eqNullSafe(F.col("filter_id")) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return f.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.sum("fresh").alias("filter_runs"), F.round(F.avg("fwhm"), 6).alias("mean_fwhm"), F.round(F.avg("hfr"), 6).alias("mean_hfr"), F.round(F.avg("star_count"), 4).alias("mean_stars")
    )
