"""Evaluation passages in training texts (problem 7).

Method: template canonicalisation.  Words become tokens without case, accents, markup and punctuation; numbers, names and units become
typed placeholders; windows of tokens are hash-joined between documents and items on the template, and the slots
behind the placeholders are compared: equal slots are a verbatim leak, slots that map one to one a re-parameterised one.

A window has up to three keys: its plain tokens; its template with the names that the items teach, in any case; and its
template with every word written with a capital as a name, which each text tells by itself, so that a name that no item has is
a slot too.  Words exchanged under the last key must be names by their use in all documents and items.  Texts are read twice:
with the parts of a number as tokens of their own, and with a decimal or grouped number as one token ('3.5' stands where '4' does).

A window of the documents is sent on only if its template may occur in an item: the items' templates set bits in a filter of a
fixed size, which Spark fills by aggregation, whatever the number of items.  The join that follows is exact.  The equality
pattern of the slots is part of the hashed template, so that windows whose slots cannot map one to one never meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skycatalog.llm.mime import running_text
from skycatalog.session import broadcast_if_small, cut_lineage

#: Words of an item that must follow one another in a document.
RUN_WORDS = 12
#: Tokens of a window: at most as many as any run of RUN_WORDS words has.
WINDOW = 12
#: Words that must stay for a window to be a template at all.
LEAST_FIXED = 4
#: Bits of a filter; a fuller one lets more windows pass to the join, the result stays the same.
FILTER_BITS = 1 << 26
#: Windows of the items up to which they are broadcast to the join.
BROADCAST_WINDOWS = 100_000
#: Characters of documents whose tokens are held at once.
PIECE_CHARS = 8_000_000
#: Rows of name counts of a batch that are written at once.
COUNT_ROWS = 200_000

# Unit words that stand for a <unit>.
UNITS = frozenset("nm mm cm km m s ms min h kg g mg c f deg px mb gb kb mp adu hz khz mhz v w a % nights minutes seconds hours days mins hrs secs".split())
TOKEN = re.compile(r"[^\W_]+")
# A number with a decimal part or grouped thousands is one token; dates, versions and lists of numbers are not.
JOINED = re.compile(r"(?<![^\W_])(?<!\d[.,'’])(?:\d{1,3}(?:[.,'’]\d{3})+(?:[.,]\d+)?|\d+[.,]\d+)(?![.,'’]?\d)[^\W_]*|[^\W_]+")
SEPARATORS = str.maketrans(",'’", "...")
DROPPED = re.compile("[̀-ͯ­​-‍⁠﻿]")
P = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
NUMBER, UNIT, NAME = 3, 5, 7
# Keys of a window: plain tokens, names that the items teach, words written with a capital.
PLAIN, TAUGHT, WRITTEN = 0, 1, 2
# Both readings of numbers; a key is 3 * reading + kind.
READINGS = (TOKEN, JOINED)


def bare(text: str) -> str:
    """Accents and invisible characters resolved."""
    return text if text.isascii() else DROPPED.sub("", unicodedata.normalize("NFKD", text))


def flat(text: str) -> str:
    """Case, accents and invisible characters resolved."""
    return bare(text).casefold()


@lru_cache(maxsize=1 << 18)
def folded(token: str) -> str:
    """A token without case; numbers with one kind of separator."""
    return (token.translate(SEPARATORS) if token[0].isdigit() else token).casefold()


@lru_cache(maxsize=1 << 18)
def _code(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) & MASK
    return h


def _windows(codes: np.ndarray, since: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all windows of codes; `since` tells for slots how far back the same token stood, which counts inside the window."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out *= np.uint64(P)
            out += codes[k : k + n]
            if since is not None:
                back = since[k : k + n]
                out += np.where(back <= k, back, 0).astype(np.uint64) << np.uint64(8)
        out ^= out >> np.uint64(29)
    return out


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter that a hash sets."""
    h = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        return [((h ^ (h >> np.uint64(31))) * np.uint64(m) >> np.uint64(20)) % np.uint64(bits) for m in (P, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where all bits of a hash are set."""
    at = np.arange(len(hashes))
    for places in _places(hashes, 64 * len(bitmap)):
        p = places[at]
        at = at[(bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    out = np.zeros(len(hashes), bool)
    out[at] = True
    return out


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of all `hashes(h)`: words of 64 bits, added up by Spark; the driver gets at most bits / 64 rows."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.concatenate(_places(pdf["h"].to_numpy(np.int64), bits))
            p.sort()
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            bits_ = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), p & np.uint64(63)), first) if len(p) else p
            yield pd.DataFrame({"word": word.astype(np.int64), "bits": bits_.view(np.int64)})

    rows = hashes.mapInPandas(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _slot(token: str) -> int:
    """The placeholder of a token as it is written; 0 for none."""
    if token[0].isdigit():
        return NUMBER
    return UNIT if token.casefold() in UNITS else NAME if token[0].isupper() else 0


def _codes(stream: list[str], names: np.ndarray, kinds: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the tokens for each kind of key, and how far back the same token stood; each distinct token is looked at once."""
    at = {t: k for k, t in enumerate(dict.fromkeys(stream))}
    place = np.fromiter(map(at.__getitem__, stream), np.int64, len(stream))
    small = [folded(t) for t in at]
    plain = np.fromiter(map(_code, small), np.uint64, len(at))
    if kinds == [PLAIN]:
        return [plain[place]], np.empty(0, np.int64)
    slot = np.fromiter(map(_slot, at), np.uint64, len(at))
    named = np.where((slot == 0) | (slot == NAME), np.where(_held(names, plain.view(np.int64)), np.uint64(NAME), np.uint64(0)), slot)
    # the place before of each token, case aside
    ids = {t: k for k, t in enumerate(dict.fromkeys(small))}
    same = np.fromiter(map(ids.__getitem__, small), np.int64, len(at))[place]
    order = np.argsort(same, kind="stable")
    since = np.full(len(stream), len(stream))
    again = same[order[1:]] == same[order[:-1]]
    since[order[1:][again]] = order[1:][again] - order[:-1][again]
    return [(plain if kind == PLAIN else np.where(slots > 0, slots, plain))[place] for kind, slots in ((k, named if k == TAUGHT else slot) for k in kinds)], since


SCHEMA = "id bigint, pos int, key int, template bigint, tokens array<string>"


def _pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about PIECE_CHARS characters, so that long texts do not add up in memory; no text is cut."""
    if pdf.empty:
        yield pdf
        return
    part = pdf["text"].str.len().fillna(0).cumsum() // PIECE_CHARS
    for _, piece in pdf.groupby(part.to_numpy()):
        yield piece.reset_index(drop=True)


def _window_rows(batches: Iterator[pd.DataFrame], names: Broadcast | None, wanted: Broadcast | None, kinds: list[int], readings: int, decode: bool) -> Iterator[pd.DataFrame]:
    for pdf in (piece for batch in batches for piece in _pieces(batch)):
        texts = [bare(running_text(t) if decode else t) if isinstance(t, str) else "" for t in pdf["text"]]
        ids = pdf["id"].to_numpy()
        for reading, pattern in enumerate(READINGS[:readings]):
            all_tokens: list[list[str]] = [pattern.findall(t) for t in texts]
            lengths = np.array([len(t) for t in all_tokens], np.int64)
            stream = [t for ts in all_tokens for t in ts]
            if len(stream) < WINDOW:
                continue
            first = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(len(lengths)), lengths)[: len(stream) - WINDOW + 1]
            pos = np.arange(len(doc)) - first[doc]
            inside = pos + WINDOW <= lengths[doc]
            coded, since = _codes(stream, names.value if names is not None else np.zeros(1, np.uint64), kinds)
            for kind, codes in zip(kinds, coded, strict=True):
                key = 3 * reading + kind
                is_slot = codes <= NAME
                hashes, keep = _windows(codes, None if kind == PLAIN else np.where(is_slot, since, len(stream))).view(np.int64) ^ key, inside
                if kind != PLAIN:  # a window without slots has its plain key
                    slots = np.concatenate([[0], np.cumsum(is_slot)])
                    slots = slots[WINDOW:] - slots[:-WINDOW]
                    keep = keep & (slots > 0) & (slots <= WINDOW - LEAST_FIXED)
                hit = np.flatnonzero(keep)
                if wanted is not None:
                    hit = hit[_held(wanted.value, hashes[hit])]
                yield pd.DataFrame({"id": ids[doc[hit]], "pos": pos[hit].astype(np.int32), "key": np.full(len(hit), key, np.int32), "template": hashes[hit], "tokens": pd.Series([list(map(folded, stream[i : i + WINDOW])) for i in hit], dtype=object)})


def _case_rows(batches: Iterator[pd.DataFrame], decode: bool) -> Iterator[pd.DataFrame]:
    """(token, capital): how often each word is written with a capital more than with a small letter, a part of a batch at a time."""
    for pdf in (piece for batch in batches for piece in _pieces(batch)):
        seen: Counter[str] = Counter()
        for t in pdf["text"]:
            if isinstance(t, str):
                seen.update(TOKEN.findall(bare(running_text(t) if decode else t)))
        words = [(folded(t), n if t[0].isupper() else -n) for t, n in seen.items() if t[0].isalpha()]
        for i in range(0, len(words), COUNT_ROWS):
            yield pd.DataFrame(words[i : i + COUNT_ROWS], columns=["token", "capital"])


def _item_names(items: DataFrame) -> DataFrame:
    """(h): codes of the names in the items: words written with a capital away from a sentence start, and never small, in texts whose nouns are small."""
    words = items.where("lang is null or lang <> 'de'").select(F.explode(F.split(F.col("text"), r"\s+")).alias("w"), F.lit(1))
    inside = items.where("lang is null or lang <> 'de'").select(F.explode(F.expr(r"regexp_extract_all(text, '(?U)[\\p{L}\\p{N},;] (\\p{Lu}[\\p{L}]+)', 1)")).alias("w")).distinct()
    small = words.select(F.regexp_replace("w", r"(?U)[^\p{L}]+", "").alias("w")).where(F.col("w") == F.lower("w")).distinct()
    names = inside.join(small.select(F.col("w").alias("s")), F.lower("w") == F.col("s"), "left_anti")

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.array([_code(flat(w)) for w in pdf["w"]], np.uint64).view(np.int64)})

    return names.mapInPandas(codes, "h bigint")


def _exchanged_by_names(j: DataFrame, texts: DataFrame, it: DataFrame) -> DataFrame:
    """Of the windows that share what is written with capitals: those whose exchanged words are names, and fewer than the words that stay.

    A name is written with a capital more often than not, in all documents and items together.
    """
    # units are slots of their own in every key
    unit = F.col("o.d").isin(*UNITS) & F.col("o.i").isin(*UNITS)
    changed = F.filter(F.arrays_zip("d", "i"), lambda o: (o["d"] != o["i"]) & ~o["d"].rlike(r"^\d"))
    j = cut_lineage(j.withColumn("changed", F.array_distinct(changed)).where(F.size(F.filter(F.arrays_zip("d", "i"), lambda o: o["d"] != o["i"])) * 2 <= WINDOW))
    swaps = j.select(F.explode("changed").alias("o")).distinct().where(~unit).select("o.d", "o.i")
    asked = swaps.select(F.explode(F.array("d", "i")).alias("token")).distinct()
    counts = texts.mapInPandas(lambda b: _case_rows(b, True), "token string, capital bigint").unionByName(it.select("text").mapInPandas(lambda b: _case_rows(b, False), "token string, capital bigint"))
    names = cut_lineage(counts.join(asked, "token", "left_semi").groupBy("token").agg(F.sum("capital").alias("n")).where("n > 0").select("token"))
    good = swaps.join(names.withColumnRenamed("token", "d"), "d").join(names.withColumnRenamed("token", "i"), "i").select(F.struct("d", "i").alias("o"), F.lit(True).alias("good"))
    j = j.withColumn("row", F.struct("doc_id", "item_id", "reading", "doc_pos", "item_pos"))
    bad = j.select("row", F.explode("changed").alias("o")).where(~unit).join(good, "o", "left").where("good is null").select("row").distinct()
    return j.join(bad, "row", "left_anti").drop("changed", "row")


def item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which tokens make up each blank-separated word of an item, in each reading of numbers."""
    for pdf in batches:
        out = []
        for i, text in zip(pdf["id"], pdf["text"], strict=True):
            for reading, pattern in enumerate(READINGS):
                at = 0
                for w in text.split() if isinstance(text, str) else []:
                    n = len(pattern.findall(bare(w)))
                    if n:
                        out.append((i, reading, at, at + n))
                    at += n
        yield pd.DataFrame(out, columns=["id", "reading", "first", "last"])


def leaked_windows(docs: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, text: str, lang: str = "lang", verbatim_only: bool = False) -> DataFrame:
    """(doc_id, item_id, reading, doc_pos, item_pos, kind): windows that share a key; kind 'verbatim' or 'reparameterised'."""
    it = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null")
    kinds = [PLAIN] if verbatim_only else [PLAIN, TAUGHT, WRITTEN]
    readings = 1 if verbatim_only else len(READINGS)
    sc = docs.sparkSession.sparkContext
    # both filters have a fixed size; a word that passes for a name does so in documents and items alike
    names = None if verbatim_only else sc.broadcast(_filter(_item_names(it), FILTER_BITS))
    iw = cut_lineage(it.select("id", "text").mapInPandas(lambda b: _window_rows(b, names, None, kinds, readings, False), SCHEMA))
    wanted = sc.broadcast(_filter(iw.select(F.col("template").alias("h")), FILTER_BITS))
    src = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null and text <> ''")
    dw = src.mapInPandas(lambda b: _window_rows(b, names, wanted, kinds, readings, True), SCHEMA)
    left = dw.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "key", "template", F.col("tokens").alias("d"))
    right = iw.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "key", "template", F.col("tokens").alias("i"))
    j = left.join(broadcast_if_small(right, BROADCAST_WINDOWS), ["key", "template"])
    # slots: equal everywhere, or one to one between the two sides
    pairs = F.array_distinct(F.arrays_zip("d", "i"))
    kinds_ = F.when(F.col("d") == F.col("i"), "verbatim").when((F.size(pairs) == F.size(F.array_distinct("d"))) & (F.size(pairs) == F.size(F.array_distinct("i"))), "reparameterised")
    j = j.withColumn("kind", kinds_).where("kind is not null")
    j = j.withColumn("reading", F.floor(F.col("key") / 3).cast("int"))
    out = ["doc_id", "item_id", "reading", "doc_pos", "item_pos", "kind"]
    if verbatim_only:
        return j.select(*out)
    j = cut_lineage(j)
    last = F.col("key") % 3 == WRITTEN
    written = _exchanged_by_names(j.where(last & (F.col("kind") == "reparameterised")), src.select("text"), it)
    return j.where(~last | (F.col("kind") == "verbatim")).select(*out).unionByName(written.select(*out))


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", verbatim_only: bool = False) -> DataFrame:
    """(doc_id, item_id, kind, words): documents with at least RUN_WORDS consecutive words of an item.

    `words` is the longest run of whole words of the item; kind is 'verbatim' if such a run has the item's own slots, else
    'reparameterised'.  NULL texts and ids take no part; texts shorter than a run leak nothing; repeated documents give one
    row; a passage shared by several items is reported for each.
    """
    w = leaked_windows(docs, items, doc_id=doc_id, item_id=item_id, text=text, verbatim_only=verbatim_only)
    if verbatim_only:
        w = w.where("kind = 'verbatim'")
    w = w.distinct()
    runs = []
    for kind in ["verbatim"] if verbatim_only else ["verbatim", "template"]:
        rows = w.where("kind = 'verbatim'") if kind == "verbatim" else w.drop("kind").distinct()
        diagonal = Window.partitionBy("doc_id", "item_id", "reading", F.col("doc_pos") - F.col("item_pos")).orderBy("item_pos")  # no longer than an item
        isle = F.col("item_pos") - F.row_number().over(diagonal)
        r = rows.withColumn("isle", isle).withColumn("diag", F.col("doc_pos") - F.col("item_pos"))
        runs.append(r.groupBy("doc_id", "item_id", "reading", "diag", "isle").agg(F.min("item_pos").alias("a"), F.max(F.col("item_pos") + WINDOW).alias("b")).select("doc_id", "item_id", "reading", "a", "b", F.lit(kind).alias("run")))
    spans = runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1])
    it = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    words = it.mapInPandas(item_words, "id bigint, reading int, first int, last int").groupBy("id", F.col("reading").alias("as_read")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("words"))
    j = spans.join(words, (spans["item_id"] == words["id"]) & (spans["reading"] == words["as_read"])).withColumn("n", F.size(F.filter("words", lambda x: (x["first"] >= F.col("a")) & (x["last"] <= F.col("b")))))
    best = j.where(F.col("n") >= RUN_WORDS).groupBy("doc_id", "item_id").agg(F.max("n").alias("words"), F.max(F.when(F.col("run") == "verbatim", True).otherwise(False)).alias("v"))
    return best.select("doc_id", "item_id", F.when(F.col("v"), "verbatim").otherwise("reparameterised").alias("kind"), "words")
