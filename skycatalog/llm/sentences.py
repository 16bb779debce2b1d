"""Sentence boundaries across languages and scripts (problem 9).

Method: abbreviations, collocations and sentence starters are learned unsupervised per language by log-likelihood ratios over
all texts; each period is then classified with these statistics.

One pass over the documents gives, per Arrow batch, (a) every place where a sentence may start, with the word before and
after it, and (b) word counts already added up.  Statistics and decisions are joins and aggregations of these rows; no
vocabulary is collected.  Marks that end a sentence by themselves (those that Unicode calls sentence terminals, without the
period) are settled in that pass, as are blanks in Thai.  The pass is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycatalog.llm.mime import parts
from skycatalog.session import cut_lineage

#: Least score of an abbreviation, log-likelihood of a sentence starter and of a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Followers of decided case that an abbreviation needs before its own tendency counts.
TENDENCY_MIN = 3
#: Share of whole numbers with a period from which a language writes ordinals so.
ORDINAL_SHARE = 0.2

# Lines that hold no running text.
ATTRIBUTION = re.compile(r"(?:wrote|writes|schrieb|écrit|escribió|написала?|写道|έγραψε|كتب)\s*:\s*$", re.I)
HEADER_FIELD = re.compile(r"(?:From|To|Cc|Bcc|Date|Sent|Subject|Reply-To|Received|Message-ID|References|In-Reply-To|MIME-Version|Content-[\w-]+|X-[\w-]+):\s", re.I)
OPENERS, CLOSERS = "\"'«“„‘‚(¿¡「『（《[", "\"'»”’“)」』）》]"
PAIRS = {"”": "“", "」": "「", "』": "『", "）": "（", "》": "《"}
# Unicode's sentence terminals but for the wide ones, the ellipsis, and the semicolon that Greek asks with.
LATIN_END = regex.compile(r"(?V1)(?P<mark>[[\p{Sentence_Terminal}…;]--[。！？｡．]]+)(?P<close>\s»|[\"'»”’“)\]]*)(?P<gap>\s+)")
WIDE = re.compile(r"[。！？…“”「」『』（）《》]")
WIDE_TEXT = re.compile(r"[぀-ヿ㐀-鿿！-｠。、]")
THAI, THAI_GAP = re.compile("[\u0e00-\u0e7f]"), re.compile(r"\s+")

FIRST = re.compile(r"\S*?([^\W_])")
NONSPACE, WORDLETTERS = re.compile(r"\S+"), re.compile(r"\w*")
OPEN_QUOTE = re.compile(r"[\"«“„]")
#: Letters up to which a word stands for itself in the counts; of longer ones a digest is counted.
LONG_WORD = 40

SCHEMA = "kind string, doc_id bigint, row bigint, start_char int, lang string, script string, tok string, nxt string, shape string, upper_mid bigint, lower bigint, dotted bigint, plain bigint"


def paragraphs(raw: str) -> Iterator[tuple[int, int]]:
    """Offsets of the paragraphs of running text of a mail."""
    for p in parts(raw):
        if p.kind != "text/plain" or p.encoding in ("base64", "quoted-printable"):
            continue
        first, last, signature, at = None, None, False, p.start
        while at < p.end:
            end = raw.find("\n", at, p.end)
            end = p.end if end < 0 else end
            line = raw[at:end]
            blank = not line.strip()
            if blank:
                signature = False
            elif line.rstrip() == "--":
                signature = True
            if blank or signature or line.lstrip().startswith((">", "|")) or HEADER_FIELD.match(line) or ATTRIBUTION.search(line):
                if first is not None:
                    yield first, last
                first = None
            else:
                first, last = (at if first is None else first), end
            at = end + 1
        if first is not None:
            yield first, last


@lru_cache(maxsize=1 << 16)
def script_of(ch: str) -> str:
    """Script of a letter by the first word of its Unicode name; anything else counts as Latin."""
    return unicodedata.name(ch, "LATIN").split(" ", 1)[0] if ch.isalpha() else "LATIN"


def counted(word: str) -> str:
    """The word, or its beginning with a digest of all of it where it is long."""
    return word if len(word) <= LONG_WORD else word[:LONG_WORD] + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def wide_starts(text: str) -> list[int]:
    """Sentence starts in text of scripts without blanks: marks end a sentence unless quoted inside another."""
    starts, stack, begin, n = [], [], 0, len(text)
    while begin < n and text[begin].isspace():
        begin += 1
    skip = -1
    for m in WIDE.finditer(text):
        at, ch = m.start(), m[0]
        if at < skip:
            continue
        if ch in "“「『（《":
            stack.append(at)
        elif ch in PAIRS:
            if stack:
                stack.pop()
        else:
            end = at + 1
            while end < n and text[end] in "。！？…":
                end += 1
            outer = None
            while end < n and text[end] in PAIRS and stack:
                outer = stack.pop()
                end += 1
            skip = end
            if not stack and (outer is None or outer == begin):
                while end < n and text[end].isspace():
                    end += 1
                if end < n and text[end] not in PAIRS:
                    starts.append(end)
                    begin = end
    return starts


def _first_letter(text: str, at: int) -> str:
    """First letter or digit of the word at `at`, '' if there is none."""
    m = FIRST.match(text, at)
    return m[1] if m else ""


def _capitals(text: str, at: int) -> bool:
    word = WORDLETTERS.match(text, at)[0]
    return len(word) > 1 and word.isupper()


BRAND = re.compile(r"[^\w\s]*[a-z]{1,3}[A-Z]\w*")


def _brand(text: str, at: int) -> bool:
    """A name that keeps its small first letter at the start of a sentence, such as 'eMail'."""
    return BRAND.match(text, at) is not None


def _quoted_inside(text: str, quotes: list[int], at: int) -> bool:
    """True if the last quotation before `at` opened in the middle of a sentence; `quotes` are the places of opening marks."""
    k = bisect_left(quotes, at)
    before = quotes[k - 1] if k else 0
    while before > 0 and text[before - 1].isspace():
        before -= 1
    return before > 0 and text[before - 1] not in ".!?…:"


def _word_before(text: str, at: int) -> str:
    left = at
    while left and not text[left - 1].isspace():
        left -= 1
    return text[left:at].lstrip(OPENERS)


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(offset of the next word, shape, word before, word after): shape 'sure' or the case of the next word: U, C (all in capitals), d, n; i for an initial."""
    for at in wide_starts(text) if WIDE_TEXT.search(text) else ():
        yield at, "sure", "", ""
    quotes = [m.start() for m in OPEN_QUOTE.finditer(text)]
    for m in LATIN_END.finditer(text):
        end, mark = m.end(), m["mark"]
        if end >= len(text):
            break
        at = m.start()
        before = text[at - 1] if at else " "
        if ";" in mark and script_of(before) != "GREEK":
            continue
        ch = _first_letter(text, end)
        if not ch or (ch.islower() and not _brand(text, end)) or ")" in m["close"]:
            continue
        if text[end] in CLOSERS and text[end] not in OPENERS:
            continue
        if mark != ".":
            apart = m["close"][:1].isspace()  # French sets its quotation marks apart
            if m["close"] and ch.isupper() and (apart or _capitals(text, end)) and _quoted_inside(text, quotes, at):
                continue
            yield end, "sure", "", ""
            continue
        word = _word_before(text, at)
        right = NONSPACE.match(text, end)[0].lstrip(OPENERS)
        follow = WORDLETTERS.match(right)[0]
        nxt = follow or right
        shape = "d" if ch.isdigit() else "U" if ch.isupper() or ch.islower() else "n"
        if shape == "U" and len(nxt) > 1 and nxt.isupper() and word.isupper():
            shape = "C"  # in capitals throughout, the case of the next word tells nothing
        if len(nxt) == 1 and nxt.isalpha() and right[1:2] == ".":
            shape = "i"
        yield end, shape, counted(word), counted(nxt)
    for m in THAI_GAP.finditer(text) if THAI.search(text) else ():  # in Thai a blank not beside a digit
        a, b = m.start() - 1, m.end()
        if a >= 0 and b < len(text) and (THAI.match(text[a]) or THAI.match(text[b])) and not text[a].isdigit() and not text[b].isdigit() and text[a] not in ".!?…;":
            yield b, "sure", "", ""


WORD = re.compile(r"\S+")
NAME_FIELD = re.compile(r"^(?:From|To|Cc|Sender)[ \t]*:[ \t]*([^<\n@]*)<", re.I | re.M)
EDGE = OPENERS + CLOSERS + ",:;!?…"


def _count(text: str, lang: str, counts: Counter) -> None:
    """Adds the words of a paragraph: with and without final period, lower case, capital away from a sentence start."""
    fresh = True
    for w in WORD.findall(text):
        core = w.strip(EDGE)
        if not core:
            continue
        dot = core.endswith(".") and not core.endswith("..")
        core = core.rstrip(".")
        if core and (core[0].isalpha() or core[-1].isalpha() or core.isdigit()) and not WIDE_TEXT.search(core):
            lower = core[0].islower() and not BRAND.match(core)
            counts[lang, script_of(core[0]), counted(core.lower()), dot, lower, core[0].isupper() and not fresh] += 1
        fresh = w[-1] in ".!?…:;\"»”" or w[-1] in CLOSERS


def scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for pdf in batches:
        rows, counts = [], Counter()
        for doc_id, row, text, lang in zip(pdf["doc_id"], pdf["row"], pdf["text"], pdf["lang"], strict=True):
            if not text:
                continue
            lang = lang if isinstance(lang, str) else ""
            for name in NAME_FIELD.findall(text):
                for w in name.replace('"', " ").split():
                    if w[0].isupper():
                        counts[lang, script_of(w[0]), counted(w.lower()), False, False, True] += 1
            for a, b in paragraphs(text):
                para = text[a:b]
                _count(para, lang, counts)
                done = set()
                for at, shape, tok, nxt in candidates(para):
                    if at not in done:
                        done.add(at)
                        rows.append(("at", doc_id, row, a + at, lang, script_of(tok[0]) if tok else "", tok, nxt, shape, 0, 0, 0, 0))
        for (lang, script, word, dot, lower, mid), n in counts.items():
            rows.append(("word", 0, 0, 0, lang, script, word, "", "", n * mid, n * lower, n * dot, n * (not dot)))
        yield pd.DataFrame(rows, columns=columns)


def _abbreviations(words: DataFrame, level: list[str]) -> DataFrame:
    """(level, tok, score): log-likelihood that the word goes with its period, weighed by length, inner periods and plain uses."""
    total = words.groupBy(*level).agg(F.sum("dotted").alias("all_dotted"), F.sum(F.col("dotted") + F.col("plain")).alias("all"))
    w = words.groupBy(*level, "tok").agg(F.sum("dotted").alias("dotted"), F.sum("plain").alias("plain")).where("dotted > 1")
    w = w.join(total, level)
    p = F.least(F.col("all_dotted") / F.col("all"), F.lit(0.95))
    inner = F.length("tok") - F.length(F.replace("tok", F.lit("."), F.lit(""))) + 1
    letters = F.length("tok") - inner + 1
    ll = 2 * (F.col("dotted") * F.log(F.lit(0.99) / p) + F.col("plain") * F.log(F.lit(0.01) / (1 - p)))
    seldom_plain = F.least(F.col("plain"), 20 * F.col("plain") / (F.col("plain") + F.col("dotted")))
    score = ll * F.exp(-letters) * inner * F.pow(letters, -seldom_plain)
    return w.withColumn("score", score).where(F.col("score") >= ABBREVIATION).select(*level, "tok", "score")


def _llr(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two events in `total` trials, 0 unless they attract each other."""
    xlogx = lambda k, n: F.when((k > 0) & (n > 0), k * F.log(k / n)).otherwise(0.0)
    k1, n1, k2, n2 = both, first, second - both, total - first
    joint = xlogx(k1, n1) + xlogx(n1 - k1, n1) + xlogx(k2, n2) + xlogx(n2 - k2, n2)
    apart = xlogx(second, total) + xlogx(total - second, total)
    return F.when(k1 * n2 > k2 * n1, 2 * (joint - apart)).otherwise(0.0)


def _text_key(doc_id: Column, text: Column) -> Column:
    """Tells texts under one id apart; equal texts have equal sentences."""
    return F.xxhash64(doc_id, text)


def sentence_starts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, start_char): code-point offset of each sentence that follows another in its paragraph.

    NULL and empty texts have none; a NULL language is one of its own.  Repeated documents give their rows again; ids need not be
    unique.  Other columns are ignored; an empty table gives an empty result.
    """
    return _starts(docs, doc_id=doc_id, text=text, lang=lang).select("doc_id", "start_char")


def _starts(docs: DataFrame, *, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, row, start_char); `row` is the key of the text."""
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.when(F.col(lang) == "und", None).otherwise(F.col(lang)).alias("lang"))
    src = src.where("text is not null and text <> ''").withColumn("row", _text_key(F.col("doc_id"), F.col("text")))
    rows = cut_lineage(src.mapInPandas(scan_batches, SCHEMA))
    at = rows.where("kind = 'at'").select("doc_id", "row", "start_char", "lang", "script", F.lower("tok").alias("tok"), F.col("tok").alias("word"), "nxt", "shape")
    sure = at.where("shape = 'sure'").select("doc_id", "row", "start_char")

    words = cut_lineage(
        rows.where("kind = 'word'").withColumn("lang", F.coalesce("lang", F.lit(""))).groupBy("lang", "script", "tok").agg(*[F.sum(c).alias(c) for c in ("upper_mid", "lower", "dotted", "plain")])
    )
    # abbreviations of the language, and of all texts in the script: mails mix languages
    own = _abbreviations(words, ["lang", "script"]).select("lang", "script", "tok", F.lit(True).alias("own"))
    pooled = _abbreviations(words, ["script"]).select("script", "tok", F.lit(True).alias("pooled"))
    period = at.where("shape <> 'sure'").withColumn("lang", F.coalesce("lang", F.lit("")))
    uses = period.groupBy("lang", "script", "tok", "word", "nxt", "shape").agg(F.count(F.lit(1)).alias("n"))
    uses = uses.join(own, ["lang", "script", "tok"], "left").join(pooled, ["script", "tok"], "left")
    initial = F.col("tok").rlike(r"^\p{L}(?:\.\p{L})*$")
    uses = uses.withColumn("abbr", F.coalesce("own", "pooled", F.lit(False)) | initial).withColumn("own", F.coalesce("own", F.lit(False))).drop("pooled")

    # orthography of the next word: in its language, else in its script
    ortho = words.groupBy("lang", F.col("tok").alias("key")).agg(F.sum("upper_mid").alias("um"), F.sum("lower").alias("lo"))
    wide = words.groupBy(F.col("tok").alias("key")).agg(F.sum("upper_mid").alias("um_all"), F.sum("lower").alias("lo_all"))
    u = uses.withColumn("key", F.lower("nxt")).join(ortho, ["lang", "key"], "left").join(wide, ["key"], "left")
    local = F.coalesce(F.col("um"), F.lit(0)) + F.coalesce(F.col("lo"), F.lit(0)) > 0
    um, lo = F.when(local, F.col("um")).otherwise(F.coalesce("um_all", F.lit(0))), F.when(local, F.col("lo")).otherwise(F.coalesce("lo_all", F.lit(0)))
    u = u.withColumn("open", F.when(um + lo == 0, None).otherwise(lo > um))
    u = cut_lineage(u.select("lang", "script", "tok", "word", "nxt", "key", "shape", "n", "own", "abbr", "open"))

    # what follows an abbreviation: its own tendency, in the language, else in those of the script where it was learned as one
    upper = u.where("shape = 'U'")
    known = upper.where("abbr and open is not null").groupBy("lang", "script", "tok", "own").agg(F.sum("n").alias("known"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("opens"))
    known_all = known.where("own").groupBy("script", "tok").agg(F.sum("known").alias("known_all"), F.sum("opens").alias("opens_all"))
    known = known.drop("own")
    tends = F.when(F.col("known") >= TENDENCY_MIN, F.col("opens") > 0.5 * F.col("known")).when(F.col("known_all") >= TENDENCY_MIN, F.col("opens_all") > 0.5 * F.col("known_all"))
    # sentence starters: words that follow sure ends more than their share; collocations: words that go with this abbreviation
    ended = F.when(~F.col("abbr"), F.col("n")).otherwise(0)
    by_word = upper.groupBy("lang", "key").agg(F.sum(ended).alias("after_end"), F.sum("n").alias("all_word"))
    by_lang = upper.groupBy("lang").agg(F.sum(ended).alias("all_end"), F.sum("n").alias("all_n"))
    by_tok = upper.groupBy("lang", "script", "tok").agg(F.sum("n").alias("all_tok"))
    by_pair = upper.groupBy("lang", "script", "tok", "key").agg(F.sum("n").alias("with_tok"))
    # words before numbers: 'No. 14'; ordinals: whole numbers that carry a period more often than by chance
    numeric = u.groupBy("lang", "script", "tok").agg(F.sum(F.when(F.col("shape") == "d", F.col("n")).otherwise(0)).alias("tok_num"), F.sum("n").alias("tok_n"))
    numeric_all = numeric.groupBy("script", "tok").agg(F.sum("tok_num").alias("all_num"), F.sum("tok_n").alias("all_tok_n"))
    by_lang_num = u.groupBy("lang").agg(F.sum(F.when(F.col("shape") == "d", F.col("n")).otherwise(0)).alias("lang_num"), F.sum("n").alias("lang_n"))
    numbers = words.where(F.col("tok").rlike(r"^\d{1,2}$")).groupBy("lang").agg((F.sum("dotted") / F.sum(F.col("dotted") + F.col("plain"))).alias("ordinal"))

    v = u.join(known, ["lang", "script", "tok"], "left").join(known_all, ["script", "tok"], "left").join(by_word, ["lang", "key"], "left").join(by_lang, ["lang"], "left")
    v = v.join(by_tok, ["lang", "script", "tok"], "left").join(by_pair, ["lang", "script", "tok", "key"], "left").join(numeric, ["lang", "script", "tok"]).join(numeric_all, ["script", "tok"]).join(by_lang_num, ["lang"]).join(numbers, ["lang"], "left")
    starter = _llr(F.col("after_end"), F.col("all_word"), F.col("all_end"), F.col("all_n")) >= STARTER
    colloc = (_llr(F.col("with_tok"), F.col("all_tok"), F.col("all_word"), F.col("all_n")) >= COLLOCATION) & (F.col("with_tok") > 0.9 * F.col("all_word"))
    goes = lambda num, n: (_llr(F.col(num), F.col(n), F.col("lang_num"), F.col("lang_n")) >= COLLOCATION) & (F.col(num) > 0.5 * F.col(n))
    before_number = goes("tok_num", "tok_n") | goes("all_num", "all_tok_n")
    is_ordinal = F.col("tok").rlike(r"^\d{1,2}$") & (F.coalesce("ordinal", F.lit(0.0)) >= ORDINAL_SHARE)
    wordlike = F.col("word").rlike(r"^(?U)\p{L}[\p{Ll}'’-]*$") & (F.length("word") > 3)
    yes = (
        F.when(is_ordinal | (F.col("shape") == "i") & F.col("abbr"), False)
        .when(F.col("shape") == "d", F.when(F.col("abbr"), F.coalesce(tends, F.lit(False))).otherwise(~before_number))
        .when(~F.col("abbr"), True)
        .when(F.col("shape") == "n", False)
        .when(F.col("shape") == "C", F.coalesce(tends, F.lit(False)))
        .when(F.col("open").isNotNull(), F.col("open"))
        .when(tends.isNotNull(), tends)
        .when(starter & ~colloc, True)
        .otherwise(wordlike)
    )
    verdicts = v.where(yes).select("lang", "script", "word", "nxt", "shape")
    held = period.join(verdicts, ["lang", "script", "word", "nxt", "shape"], "left_semi").select("doc_id", "row", "start_char")
    return sure.unionByName(held)


def sentences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, start_char, end_char, sentence): the sentence units of every document, in paragraphs of running text."""
    marked = _starts(docs, doc_id=doc_id, text=text, lang=lang).groupBy("row").agg(F.array_sort(F.collect_set("start_char")).alias("starts"))
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    src = src.withColumn("row", _text_key(F.col("doc_id"), F.col("text")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, raw, starts in zip(pdf["doc_id"], pdf["text"], pdf["starts"], strict=True):
                starts = [] if starts is None else [int(x) for x in starts]
                for a, b in paragraphs(raw):
                    cuts = [a, *[s for s in starts if a < s < b], b]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        s = raw[x:y].strip()
                        if s:
                            at = x + raw[x:y].index(s)
                            out.append((i, at, at + len(s), " ".join(s.split())))
            yield pd.DataFrame(out, columns=["doc_id", "start_char", "end_char", "sentence"])

    return src.join(marked, "row", "left").mapInPandas(cut, "doc_id bigint, start_char int, end_char int, sentence string")
