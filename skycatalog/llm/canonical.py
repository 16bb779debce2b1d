"""Free-entered values to the closest entry of a reference list (problem 2).

Method: a BK-tree over the reference entries under Levenshtein distance (a true metric), sharded; the triangle inequality prunes
the tree and every entry within the radius comes back; the shards' winners are merged.

Rows are first reduced to distinct values.  (shard of the reference, block of values) pairs are the tasks: entries are spread
over shards by a row bound and copied to each block, values are spread over blocks and copied to each shard, so neither
side is ever whole in one task or on the driver.  A swap of two letters counts as one edit when candidates are ranked;
the search radius is twice the limit, as a swap is two Levenshtein edits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycatalog.session import cut_lineage

#: Reference entries of a shard's tree.
SHARD_ENTRIES = 20_000
#: Distinct values of a block (expected).
BLOCK_VALUES = 50_000
UNMATCHED = "unmatched"


# ---- metric and tree -------------------------------------------------------------------------------------------------------


def levenshtein(a: str, b: str, peq: dict[str, int] | None = None) -> int:
    """Edit distance, bit-parallel over `a` (`peq`: its letters' positions, if at hand)."""
    if not a:
        return len(b)
    if peq is None:
        peq = letter_masks(a)
    pv, mv, score, last = (1 << len(a)) - 1, 0, len(a), 1 << (len(a) - 1)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) | 1
        pv, mv = (mh << 1) | ~(xv | ph), ph & xv
    return score


def letter_masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def swap_distance(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbouring letters is one edit."""
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


class BKTree:
    """Entries by text; `within` gives every entry at most `radius` edits away."""

    def __init__(self, words: Iterator[str] | list[str] = ()):
        self.root: tuple[str, dict] | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        text, kids = self.root
        while (d := levenshtein(word, text)) in kids:
            if d == 0:
                return
            text, kids = kids[d]
        if d:
            kids[d] = (word, {})

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        if self.root is None or not word:
            return []
        peq, found, stack = letter_masks(word), [], [self.root]
        while stack:
            text, kids = stack.pop()
            d = levenshtein(word, text, peq)
            if d <= radius:
                found.append((d, text))
            stack.extend(kid for at, kid in kids.items() if d - radius <= at <= d + radius)
        return found


# ---- forms of a value ------------------------------------------------------------------------------------------------------

# Remarks, sizes and articles beside a name.
NOISE = re.compile(
    r"\((?:old|new|test|[a-z]{1,3} test)\)|#\d+|\b\d+(?:\.\d+)?\s*(?:mm|in|inch)\b|\d+(?:\.\d+)?\s*[\"”]|\bthe\b", re.I
)
BANDWIDTH = (re.compile(r"(?<!\d)\d{1,2}(?:\.\d+)?\s*nm\b", re.I), re.compile(r"\d(?:\.\d+)?\s*nm\b", re.I))


def _spelled(ch: str) -> str:
    """A Greek letter by its name, any other as it is."""
    name = unicodedata.name(ch, "")
    return name.rsplit(" ", 1)[1].lower() if name.startswith("GREEK ") and " LETTER " in name else ch


def plain(text: str) -> str:
    """Compatibility form, accents and Greek letters resolved; case is kept."""
    t = unicodedata.normalize("NFKD", text)
    return t if t.isascii() else "".join(_spelled(c) for c in t if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Lower-case words; also cut where a small letter meets a capital that starts a word."""
    cut = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", text)
    return [w for w in re.split(r"[^0-9a-z]+", cut.lower()) if w]


def limit(word: str) -> int:
    """Edits allowed for a word of this length."""
    n = len(word)
    return 0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3


def catalog_id(text: str, prefixes: frozenset[str]) -> str | None:
    """First 'PREFIX NUMBER' in `text` whose prefix is one of the reference's, as 'prefix number'."""
    for m in re.finditer(r"(?<![a-z])([a-z]{1,8})[\s_.\-]*0*(\d+)", text.lower()):
        if m[1] in prefixes:
            return f"{m[1]}{int(m[2])}"
    return None


class Matcher:
    """Searches one shard: `best` gives (rank, distance, canonical) or None."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.ids: dict[str, str] = {}
        self.names: dict[str, list[tuple[str, str]]] = {}
        self.longest = 1  # words of the longest entry, and one more where a name is written apart
        prefixes = set()
        for kind, text, canonical in entries:
            flat = plain(text)
            if kind == "prefix":
                prefixes.add(flat.lower())
                continue
            if kind == "id":
                m = re.fullmatch(r"([a-z]+)[\s_.\-]*0*(\d+)", flat.lower())
                key = f"{m[1]}{int(m[2])}" if m else "".join(words(flat))
                self.ids[key] = min(canonical, self.ids.get(key, canonical))
                continue
            whole = "".join(words(flat))
            self.names.setdefault(whole, []).append((canonical, whole))
            if kind == "titled" and len(w := words(flat)) > 1:  # 'Proper Kind': the proper part alone names it as well
                self.names.setdefault("".join(w[:-1]), []).append((canonical, whole))
            self.longest = max(self.longest, len(words(flat)) + 1)
        self.prefixes = frozenset(prefixes)
        self.id_tree, self.name_tree = BKTree(self.ids), BKTree(sorted(self.names))

    def best(self, value: str) -> tuple[int, int, str] | None:
        flat = plain(value)
        if (key := catalog_id(flat, self.prefixes)) is not None:
            hit = self.id_tree.within(key, 0)  # another number is another object
            return (0, 0, self.ids[key]) if hit else None
        base = NOISE.sub(" ", flat)
        forms = dict.fromkeys([base, *(p.sub(" ", base) for p in BANDWIDTH)])
        found: list[tuple[int, int, int, int, str]] = []
        for form in forms:
            w = words(form)
            spans = dict.fromkeys([tuple(w)] + [tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + self.longest) + 1)])
            whole = "".join(w)
            # single letters in long values, and spans under four letters in values of more than three words, name nothing
            asked = dict.fromkeys(q for q in map("".join, spans) if q and not (len(q) == 1 and len(w) > 2) and not (len(q) < 4 and len(w) > 3))
            exact = [q for q in asked if q in self.names]
            for q in exact or asked:
                allowed = 0 if exact else limit(q)  # radius 0 where some span is an entry: no other can be nearer
                for _, text in self.name_tree.within(q, 2 * allowed):
                    d = swap_distance(q, text)
                    if d <= min(allowed, limit(text) if len(text) > 3 else (1 if len(q) > 3 else 0)):
                        for canonical, full in self.names[text]:
                            found.append((d, -len(text), swap_distance(whole, full) if len(full) > 8 else 0, len(whole), canonical))
            if found and min(found)[0] == 0:
                break
        if not found:
            return None
        d, _, rest, _, canonical = min(found)
        return 1 + d, rest, canonical


# ---- on Spark --------------------------------------------------------------------------------------------------------------


def _search(key: tuple, vals: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
    m = Matcher(list(ref[["kind", "entry", "canonical"]].itertuples(index=False, name=None)))
    out = [(key[0], v, *hit) for v in vals["value"] if (hit := m.best(v)) is not None]
    return pd.DataFrame(out, columns=["domain", "value", "rank", "distance", "canonical"])


def canonical_map(values: DataFrame, reference: DataFrame, blocks: int | None = None) -> DataFrame:
    """(domain, value, canonical): each distinct non-blank value of `values(domain, value)` with the entry meant, or 'unmatched'.

    `reference(domain, kind, entry, canonical)`: kind 'id' (a catalog number, matched exactly), 'titled' (a proper name with a closing
    kind word), 'alias' (any other spelling).  Equal distances: the longer entry, then the closer whole text, then the
    name first by order.  NULL and blank values and NULL entries take no part; an empty reference leaves all unmatched.
    """
    spark = values.sparkSession
    distinct = cut_lineage(values.select("domain", "value").where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "").distinct())
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // BLOCK_VALUES))
    ref = reference.select("domain", "kind", "entry", "canonical").where("entry is not null and canonical is not null").distinct()
    shards = max(1, -(-ref.count() // SHARD_ENTRIES))
    pieces = ref.withColumn("shard", F.pmod(F.xxhash64("canonical"), F.lit(shards)).cast("int"))
    prefix = ref.where("kind = 'id'").select("domain", F.lit("prefix").alias("kind"), F.regexp_extract("entry", r"^\s*([A-Za-z]+)", 1).alias("entry"), F.lit("").alias("canonical"))
    prefix = prefix.distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pieces = pieces.unionByName(prefix).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = distinct.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["domain", "shard", "block"]
    # a fixed number of partitions: values are few bytes but long work, so they must not be coalesced
    spread, pieces = spread.repartition(blocks, *keys), pieces.repartition(blocks, *keys)
    hits = spread.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInPandas(_search, "domain string, value string, rank int, distance int, canonical string")
    best = hits.groupBy("domain", "value").agg(F.min(F.struct("rank", "distance", "canonical")).alias("w")).select("domain", "value", F.col("w.canonical").alias("canonical"))
    return distinct.join(best, ["domain", "value"], "left").select("domain", "value", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))


def canonicalise(rows: DataFrame, reference: DataFrame, blocks: int | None = None) -> DataFrame:
    """`rows(field_name, row_id, domain, value)` with non-blank values, each with its `canonical`; repeated rows count once."""
    r = rows.select("field_name", "row_id", "domain", "value").where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "").distinct()
    m = canonical_map(r, reference, blocks)
    return r.join(m, ["domain", "value"]).select("field_name", "row_id", "domain", "value", "canonical")
