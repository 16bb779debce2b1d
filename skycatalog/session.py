"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "skycatalog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE, last-wins maps."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Python workers need no path of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):
        return  # already running from a shipped archive
    archive = os.path.join(tempfile.mkdtemp(prefix="skycatalog-"), "skycatalog.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("skycatalog", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; a folder of our own only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of an executor and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if `df` has at most `max_rows` rows; reads no further than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint behind a checked row bound; larger sides stay a shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def one_row_per_id(df: DataFrame, key: str, version: str, cols: list[str]) -> DataFrame:
    """One row per non-null key, the one of the latest version (NULL versions are oldest)."""
    packed = F.struct(F.col(version).alias("_v"), F.struct(*[F.col(c) for c in cols]).alias("_r"))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(packed["_r"], F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**62)))).alias("_r"))
        .select(key, "_r.*")
    )


def squeeze(c: Column | str) -> Column:
    """Lower case, trimmed, inner runs of white space a single blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def without_blanks(c: Column | str) -> Column:
    """Lower case without any white space: equal for spellings that differ in case and blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(c), r"(?U)\s+", ""), F.lit(""))
