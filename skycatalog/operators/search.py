"""Full-text search as DataFrames: postings of a union of entities, and queries ranked by BM25.

Query language: blank-separated terms, all required; `term*` matches prefixes; `"a b"` a phrase; `title:term` one column;
`-term` and NOT exclude; OR between two terms gives alternatives.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skycatalog.session import cut_lineage

K1, B = 1.2, 0.75
#: Least inverse document frequency, as in the reference ranking formula.
IDF_FLOOR = 1e-6
#: Postings of columns come one after another with this gap, so that phrases do not span columns.
COLUMN_GAP = 1_000_000


def plain_letters(text: str) -> str:
    """Lower case, without marks: compatibility forms are kept, combining marks dropped."""
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(plain_letters, na_action="ignore")


def tokens(text: Column) -> Column:
    """Lower-case words without marks; punctuation separates."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_entities(targets: DataFrame, aliases: DataFrame, sessions: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """(entity_type, entity_id, title, body): the union of the searchable entities; NULL texts are '' (Q1, C14)."""
    t = targets.select(F.lit("target").alias("entity_type"), F.col("id").alias("entity_id"), F.trim(F.concat(F.col("canonical_name"), F.lit(" "), F.coalesce("display_name", F.lit("")))).alias("title"), F.coalesce("notes", F.lit("")).alias("body"))
    a = aliases.select(F.lit("alias").alias("entity_type"), F.col("id").alias("entity_id"), F.col("alias").alias("title"), F.lit("").alias("body"))
    s = sessions.select(F.lit("session").alias("entity_type"), F.col("id").alias("entity_id"), F.coalesce("session_date", F.lit("")).alias("title"), F.coalesce("notes", F.lit("")).alias("body"))
    out = t.unionByName(a).unionByName(s)
    if filters is not None:
        out = out.unionByName(filters.select(F.lit("filter").alias("entity_type"), F.col("id").alias("entity_id"), F.coalesce("raw_name", F.lit("")).alias("title"), F.coalesce("canonical_name", F.lit("")).alias("body")))
    return out


def postings(entities: DataFrame) -> DataFrame:
    """(entity_type, entity_id, column, term, position): one row a word occurrence."""
    folded_ = entities.select("entity_type", "entity_id", folded(F.coalesce("title", F.lit(""))).alias("title"), folded(F.coalesce("body", F.lit(""))).alias("body"))
    both = folded_.select("entity_type", "entity_id", F.explode(F.array(F.struct(F.lit("title").alias("column"), tokens(F.col("title")).alias("w"), F.lit(0).alias("at")), F.struct(F.lit("body").alias("column"), tokens(F.col("body")).alias("w"), F.lit(COLUMN_GAP).alias("at")))).alias("c"))
    return both.select("entity_type", "entity_id", "c.column", F.col("c.at").alias("at"), F.posexplode("c.w").alias("p", "term")).select("entity_type", "entity_id", "column", "term", (F.col("at") + F.col("p")).alias("position"))


TERM = re.compile(r'(-|NOT\s+)?(?:(title|body):)?(?:"([^"]+)"|(\S+))')


def _parse(query: str) -> tuple[list[list[tuple[str | None, list[str], bool]]], list[tuple[str | None, list[str], bool]]]:
    """Required groups of alternatives and exclusions, each (column, words, last word is a prefix)."""
    groups, excluded, alternative = [], [], False
    for m in TERM.finditer(query):
        raw = m[3] or m[4]
        if m[4] in ("OR", "AND", "NOT"):
            alternative = m[4] == "OR"
            continue
        text = plain_letters(raw)
        words = [w for w in re.split(r"[^\w]+", text.rstrip("*")) if w]
        if not words:
            continue
        item = (m[2], words, raw.endswith("*"))
        if m[1]:
            excluded.append(item)
        elif alternative and groups:
            groups[-1].append(item)
        else:
            groups.append([item])
        alternative = False
    return groups, excluded


def _matches(post: DataFrame, item: tuple[str | None, list[str], bool]) -> DataFrame:
    """(entity_type, entity_id, tf): entities with the word, prefix or phrase."""
    column, words, prefix = item
    hit = None
    for i, w in enumerate(words):
        p = post if column is None else post.where(F.col("column") == column)
        p = p.where(F.col("term").startswith(w) if prefix and i == len(words) - 1 else F.col("term") == w)
        p = p.select("entity_type", "entity_id", (F.col("position") - i).alias("start"))
        hit = p if hit is None else hit.join(p, ["entity_type", "entity_id", "start"])
    return hit.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("tf"))


def search(entities: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """(entity_type, entity_id, title, score): entities that have all terms, best first by score.

    `index` is a stored result of `postings`; without it the texts are read once for the query.  An empty query and unknown
    words give no rows; ties are in order of type and id.
    """
    groups, excluded = _parse(query)
    if not groups:
        return entities.select("entity_type", "entity_id", "title", F.lit(0.0).alias("score")).limit(0)
    post = cut_lineage(postings(entities)) if index is None else index
    lengths = post.groupBy("entity_type", "entity_id").agg(F.count(F.lit(1)).alias("dl"))
    stats = entities.agg(F.count(F.lit(1)).alias("n")).join(post.agg(F.count(F.lit(1)).alias("words")))
    found = None
    for items in groups:
        m = None
        for item in items:
            one = _matches(post, item)
            m = one if m is None else m.unionByName(one)
        m = m.groupBy("entity_type", "entity_id").agg(F.sum("tf").alias("tf"))
        df = m.agg(F.count(F.lit(1)).alias("df"))
        scored = m.join(lengths, ["entity_type", "entity_id"]).join(F.broadcast(df)).join(F.broadcast(stats))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n") / F.col("words"))
        scored = scored.select("entity_type", "entity_id", (idf * F.col("tf") * (K1 + 1) / norm).alias("s"))
        found = scored.withColumnRenamed("s", "score") if found is None else found.join(scored, ["entity_type", "entity_id"]).select("entity_type", "entity_id", (F.col("score") + F.col("s")).alias("score"))
    for item in excluded:
        found = found.join(_matches(post, item), ["entity_type", "entity_id"], "left_anti")
    return found.join(entities, ["entity_type", "entity_id"]).select("entity_type", "entity_id", "title", "score").orderBy(F.desc("score"), "entity_type", "entity_id")
