"""Mixed time notations and zones to one UTC instant (problem 5).

Method: expectation-maximisation over format mixtures per source.  Every valid reading of a value is a candidate;
values are aggregated to (source, set of candidate formats) counts, EM estimates each source's format shares from
these counts (one-reading values vote fully, others by posterior), and the posteriors choose the reading.  Values
whose best posterior stays below the threshold are marked ambiguous and get no instant.

The EM groups are the counts of a source: at most one row for each combination of formats, whatever the data's size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycatalog.functions.timestamps import known_zone, offset_minutes, readings, wall_to_utc
from skycatalog.session import cut_lineage

EM_ROUNDS = 30
#: Weight of the even prior over formats in each source, in values.
PRIOR = 0.5
#: Least posterior for a reading to be chosen.
CONFIDENT = 0.8


def _em(pdf: pd.DataFrame) -> pd.DataFrame:
    """Posterior of each format of each candidate set of one source."""
    sets = [(list(s), n) for s, n in zip(pdf["formats"], pdf["n"], strict=True)]
    names = sorted({f for s, _ in sets for f in s})
    share = dict.fromkeys(names, 1.0 / len(names))
    for _ in range(EM_ROUNDS):
        votes = dict.fromkeys(names, PRIOR)
        for s, n in sets:
            total = sum(share[f] for f in s)
            for f in s:
                votes[f] += n * share[f] / total
        whole = sum(votes.values())
        share = {f: v / whole for f, v in votes.items()}
    out = []
    for s, _ in sets:
        total = sum(share[f] for f in s)
        best = max(s, key=lambda f: (share[f], f))
        out.append((pdf["source"].iloc[0], "|".join(s), best, share[best] / total))
    return pd.DataFrame(out, columns=["source", "signature", "best_format", "posterior"])


def format_posteriors(candidates: DataFrame) -> DataFrame:
    """(source, signature, best_format, posterior) of each candidate set of each source, from `candidates(source, cand)`."""
    formats = candidates.select("source", F.transform("cand", lambda r: r["format"]).alias("formats"))
    counts = formats.where(F.size("formats") > 0).groupBy("source", "formats").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").applyInPandas(_em, "source string, signature string, best_format string, posterior double")


def normalise_instants(
    rows: DataFrame,
    *,
    record_id: str,
    source: Column,
    text: Column,
    offset: Column,
    zone: Column,
    zoneless_is_utc: Column,
) -> DataFrame:
    """(record_id, status, format, posterior, utc_seconds) for each row.

    The chosen reading of `text` is taken in the zone written in it, else in `offset`, else in UTC where `zoneless_is_utc`, else in
    the IANA `zone`; an unknown zone name in the text gives no instant.  status: 'ok', 'unparsed' (NULL, empty or no valid full date and time), 'ambiguous' (no confident reading),
    'no_zone' (a wall clock without offset and zone), 'no_unique_instant' (clock change).  utc_seconds is NULL unless 'ok';
    fractions of seconds are dropped.  Repeated rows stay; an empty table gives an empty result.
    """
    v = rows.select(
        F.col(record_id).alias("record_id"), F.coalesce(source, F.lit("")).alias("source"), text.alias("text"), offset.alias("offset"), zone.alias("zone"), F.coalesce(zoneless_is_utc, F.lit(False)).alias("as_utc")
    )
    v = cut_lineage(v.withColumn("cand", readings(F.col("text"))).withColumn("iana", known_zone(F.col("zone"))).drop("text"))  # each text is read once
    post = format_posteriors(v)
    v = v.withColumn("signature", F.array_join(F.transform("cand", lambda r: r["format"]), "|"))
    j = v.join(post.withColumnRenamed("source", "p_source").withColumnRenamed("signature", "p_signature"), (F.col("source") == F.col("p_source")) & (F.col("signature") == F.col("p_signature")), "left")
    j = j.withColumn("pick", F.when(F.col("posterior") >= CONFIDENT, F.filter("cand", lambda r: r["format"] == F.col("best_format"))[0]))
    named = F.col("pick.zone").isNotNull()
    fixed = F.when(named, offset_minutes(F.col("pick.zone"))).otherwise(F.coalesce(offset_minutes(F.col("offset")), F.when(F.col("as_utc"), F.lit(0))))
    utc = F.when(fixed.isNotNull(), F.col("pick.wall_s") - fixed * 60).when(~named, wall_to_utc(F.col("pick.wall_s"), F.col("iana")))
    j = j.withColumn("utc_seconds", utc)
    status = (
        F.when(F.size("cand") == 0, "unparsed")
        .when(F.col("pick").isNull(), "ambiguous")
        .when(F.col("utc_seconds").isNotNull(), "ok")
        .when(F.coalesce(F.trim("zone"), F.lit("")) == "", "no_zone")
        .otherwise("no_unique_instant")
    )
    return j.select("record_id", status.alias("status"), F.col("pick.format").alias("format"), "posterior", "utc_seconds")
