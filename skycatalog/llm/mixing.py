"""Sources mixed to target weights (problem 8).

Method: entropy balancing.  Of all document rates within [0, cap] whose token totals meet the targets, those nearest to one copy each
(in relative entropy) are exponentially tilted: rate = min(cap, exp(lambda_source * tokens / mean tokens)).  The convex dual has one
variable a source; its gradient and curvature come from distributed aggregations over (source, tokens) counts, and
Newton steps run until every target is met.  Rates are then rounded to copies by systematic sampling in blocks of a source.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skycatalog.session import cut_lineage

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Newton steps at most, and the relative error of a source's tokens at which they end.
MAX_STEPS, TOLERANCE = 200, 1e-6
#: Rows of the table of targets.
MAX_SOURCES = 100_000
#: Documents of a block in which copies are rounded.
BLOCK_DOCS = 20_000
#: Share of the largest possible total that is asked for.
FILL = 0.999


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; NULL and empty texts have no tokens."""

    docs.sparkSession.sparkContext.addFile(tokenizer_path)  # executors need no path of their own

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(os.path.basename(tokenizer_path)))
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n})

    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInPandas(count, "doc_id bigint, source string, n_tokens bigint")


def _solve(hist: DataFrame, goals: dict[str, tuple[float, float, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Dual variable of each source, and how far its tokens still are from the goal: goals gives (tokens wanted, cap, mean tokens)."""
    spark = hist.sparkSession
    lam = dict.fromkeys(goals, 0.0)
    low, high = dict.fromkeys(goals, -700.0), dict.fromkeys(goals, 700.0)
    open_, residual = set(goals), dict.fromkeys(goals, float("nan"))
    for _ in range(MAX_STEPS):
        if not open_:
            break
        state = spark.createDataFrame([(s, lam[s], goals[s][1], goals[s][2]) for s in open_], "source string, lam double, cap double, mean double")
        x = F.col("n_tokens") / F.col("mean")
        free = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        inside = free < F.col("cap")
        got = (
            hist.join(F.broadcast(state), "source")
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("n_tokens") * F.least(free, "cap")).alias("tokens"), F.sum(F.when(inside, F.col("n") * F.col("n_tokens") * x * free).otherwise(0.0)).alias("slope"))
        )
        for r in got.collect():  # one row a source
            want = goals[r.source][0]
            gap = r.tokens - want
            residual[r.source] = gap / want
            if abs(gap) <= TOLERANCE * want:
                open_.discard(r.source)
                continue
            (high if gap > 0 else low)[r.source] = lam[r.source]
            step = lam[r.source] - gap / r.slope if r.slope > 0 else float("nan")
            inside_bracket = low[r.source] < step < high[r.source]
            lam[r.source] = step if inside_bracket else (low[r.source] + high[r.source]) / 2
    return lam, residual


def mix(docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, tokenizer_path: str = TOKENIZER_PATH) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).  copies(doc_id, source, n_tokens, rate, copies): every document of the target sources.  shares(source, target_share,
    max_repeats, documents, available_tokens, used_tokens, actual_share, residual): one row a target; `residual` is the relative distance of
    the source's rates from its goal before rounding, within TOLERANCE unless MAX_STEPS ended the search.

    `total_tokens` is the mixture's size; by default (and at most) the largest that no source's cap prevents.  Sources without tokens
    reach no share, the others keep their proportions.  Documents of NULL or other sources take no part; documents without
    tokens get no copy.  Repeated document ids are documents of their own.  Targets with a NULL source or share are ignored.
    """
    t = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).dropna()
    wanted = t.where("target_share > 0 and max_repeats > 0").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = cut_lineage(token_counts(docs, doc_id=doc_id, text=text, source=source, tokenizer_path=tokenizer_path).join(t.select("source").distinct(), "source", "left_semi"))
    hist = cut_lineage(sizes.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r.source: (r.docs, r.tokens) for r in hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}
    live = [w for w in wanted if w.source in have]
    whole = sum(w.target_share for w in live)
    most = min((w.max_repeats * have[w.source][1] * whole / w.target_share for w in live), default=0.0)
    total = min(most * FILL, total_tokens or most * FILL)
    goals = {w.source: (total * w.target_share / whole, float(w.max_repeats), have[w.source][1] / have[w.source][0]) for w in live}
    lam, residual = _solve(hist, goals)
    spark = docs.sparkSession
    rows = [(s, lam[s], g[1], g[2], max(1, -(-have[s][0] // BLOCK_DOCS))) for s, g in goals.items()]
    state = spark.createDataFrame(rows, "source string, lam double, cap double, mean double, blocks long")
    rate = F.when(F.col("n_tokens") > 0, F.least(F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.lit(700.0))), "cap")).otherwise(0.0)
    d = sizes.join(F.broadcast(state), "source", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    # a long document weighs more than a short one: blocks are dealt by hash, and within them each size class is rounded on its own line
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))))
    line = Window.partitionBy("source", "block").orderBy("n_tokens", F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("rate") - F.floor("rate")
    start = F.pmod(F.xxhash64("source", "block"), F.lit(1000)) / 1000.0
    upto = F.sum(part).over(line)
    copies = (F.floor("rate") + F.floor(upto + start) - F.floor(upto - part + start)).cast("int")
    out = d.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), F.least(copies, F.coalesce(F.ceil("cap"), F.lit(0)).cast("int")).alias("copies"))
    out = cut_lineage(out)
    used = out.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    s = t.join(used, "source", "left").na.fill(0, ["documents", "available_tokens", "used_tokens"])
    everything = used.agg(F.sum("used_tokens")).first()[0] or 0
    left = spark.createDataFrame(list(residual.items()), "source string, residual double")
    return out, s.withColumn("actual_share", F.col("used_tokens") / F.lit(max(everything, 1))).join(F.broadcast(left), "source", "left")
