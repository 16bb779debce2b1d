"""The llm problems' operators against brute force, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import base64
import os
import quopri
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("skycatalog.llm")

from skycatalog.llm import canonical, leaks, mime, mixing, sentences  # noqa: E402

# ---- canonical names

WORD = st.text("abcde", max_size=9)


def slow_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_levenshtein(a, b):
    assert canonical.levenshtein(a, b) == slow_levenshtein(a, b)
    assert canonical.swap_distance(a, b) <= slow_levenshtein(a, b) <= 2 * canonical.swap_distance(a, b)


@settings(max_examples=100, deadline=None)
@given(st.lists(WORD.filter(bool), max_size=40), WORD.filter(bool), st.integers(0, 4))
def test_tree_finds_every_entry_in_the_radius(words, q, r):
    got = {w for _, w in canonical.BKTree(words).within(q, r)}
    assert got == {w for w in words if slow_levenshtein(q, w) <= r}


REF = [
    ("object", "id", "KX 301", "KX 301"), ("object", "id", "VN 7", "KX 301"), ("object", "titled", "Olporwideth Cloud", "KX 301"), ("object", "id", "ORL 150", "ORL 150"),
    ("object", "titled", "Xazamporeth Galaxy", "ORL 150"), ("object", "titled", None, "ORL 150"), ("filter", "alias", "Ha", "Ha"), ("filter", "alias", "H-alpha", "Ha"), ("filter", "alias", "Luminance", "L"),
    ("filter", "alias", "L", "L"), ("filter", "alias", "O3", "OIII"), ("filter", "alias", "OIII", "OIII"), ("filter", "alias", "Green", "G"),
]
CASES = {
    "object": {
        "KX 301": "KX 301", "kx_0301": "KX 301", "KX ３０１": "KX 301", "VN7 panel 2": "KX 301", "KX 302": "unmatched", "Olporwideth_Cloud": "KX 301", "the Olporwideht Cloud": "KX 301", "OLPORWIDETHCLOUD": "KX 301",
        "OlporwidethCloud": "KX 301", "Xazampreth Glaaxy": "ORL 150", "ORL 150 (Ha test)": "ORL 150", "KX 999 Olporwideth": "unmatched", "test shot": "unmatched", "-": "unmatched", "x" * 20_000: "unmatched",
    },
    "filter": {"Ha": "Ha", "Hα 3nm": "Ha", "Sorn-H-Alhpa_5nm": "Ha", "o33nm": "OIII", "0III": "OIII", "Kivu L": "L", "lumnance 36mm": "L", "Grean #2": "G", "Pos 5": "unmatched", "L R": "L"},
}


@pytest.mark.parametrize("shard", [20_000, 2])
def test_canonical_map(spark, monkeypatch, shard):
    monkeypatch.setattr(canonical, "SHARD_ENTRIES", shard)
    ref = spark.createDataFrame(REF, "domain string, kind string, entry string, canonical string").withColumn("shard", F.lit("clash"))
    rows = [("f", str(i), d, v, "x") for d, vs in CASES.items() for i, v in enumerate(vs)]
    rows += [rows[0], ("f", "n", "object", None, "x"), ("f", "b", "object", "  ", "x")]
    df = spark.createDataFrame(rows, "field_name string, row_id string, domain string, value string, block string")
    got = canonical.canonicalise(df, ref, blocks=3).collect()
    assert {(r.domain, r.value): r.canonical for r in got} == {(d, v): c for d, vs in CASES.items() for v, c in vs.items()}
    assert len(got) == len(rows) - 3


def test_names_of_many_words_inside_longer_values():
    m = canonical.Matcher([("titled", "North Grand Copper Ribbon Nebula", "NG 1"), ("alias", "H-alpha", "Ha")])
    assert [m.best(v)[2] for v in ("mosaic North Grand Copper Ribbon Nebula", "two NorthGrand Coper Ribbon Nebula west", "Hα")] == ["NG 1", "NG 1", "Ha"]
    assert m.best("North Grand") is None and canonical.plain("ΩΣς") == "omegasigmasigma"


def test_canonical_empty(spark):
    ref = spark.createDataFrame(REF, "domain string, kind string, entry string, canonical string")
    v = spark.createDataFrame([("object", "KX 301")], "domain string, value string")
    assert canonical.canonical_map(v, ref.where("false")).first().canonical == "unmatched"
    assert canonical.canonical_map(v.where("false"), ref).count() == 0


# ---- mails


def mail(body, kind="text/plain", cte="8bit"):
    return f"From: Ann Lee <a@x.example>\nSubject: s\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {cte}\n\n{body}\n"


def test_mail_parts():
    b64 = base64.encodebytes("Größe zwölf".encode()).decode()
    raw = f'A: b\nContent-Type: multipart/mixed; boundary="xx"\n\npre\n--xx\n\nplain one\n--xx\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\n{b64}\n--xx\nContent-Type: multipart/alternative; boundary=yy\n\n--yy\nContent-Type: text/plain\n\ninner\n--yy--\n--xx--\nafter'
    ps = mime.parts(raw)
    assert [(p.kind, p.encoding) for p in ps] == [("text/plain", ""), ("text/html", "base64"), ("text/plain", "")]
    assert [mime.decode(raw, p).strip() for p in ps] == ["plain one", "Größe zwölf", "inner"]
    assert [p.kind for p in mime.parts("")] == ["text/plain"] and mime.running_text("") == ""
    assert "wörd" in mime.running_text(mail(quopri.encodestring("wörd".encode()).decode(), cte="quoted-printable"))


# ---- leaks

ITEM = "The quick dome watched 14 old kettles near the harbour while Velmar counted 3.5 mm of copper ribbon before the winter market opened again"


def find(spark, texts, items=(ITEM,), **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens string, pos int")
    its = spark.createDataFrame([(i, "en", t, 1) for i, t in enumerate(items)], "item_id long, lang string, text string, pos int")
    return {(r.doc_id, r.item_id): (r.kind, r.words) for r in leaks.leaks(docs, its, **kw).collect()}


def test_leaks_in_any_dress(spark):
    w = ITEM.split()
    texts = [
        mail("xx " + " ".join(w[:12]) + " yy"),
        mail("xx " + " ".join(w[:11]) + " yy"),
        mail("> " + "\n> ".join(w[2:16]).upper()),
        mail(base64.encodebytes(("so " + " ".join(w[3:18])).encode()).decode(), cte="base64"),
        mail(quopri.encodestring(("so „" + " — ".join(w[3:18])).encode()).decode(), cte="quoted-printable"),
        mail("<p>" + " ".join(f"<b>{x}</b>," for x in w[:14]) + "</p>", "text/html"),
        mail(" ".join(w[:14]).replace("dome", "dôme­").replace(" ", "&nbsp;"), "text/html"),
        mail("nothing here"), None, "",
        mail(" ".join(w).replace("14", "99").replace("Velmar", "Osmere")),
    ]
    got = find(spark, texts)
    assert set(got) == {(i, 0) for i in (0, 2, 3, 4, 5, 6, 10)}
    assert got[(0, 0)] == ("verbatim", 12) and got[(2, 0)] == ("verbatim", 14) and got[(3, 0)][1] == 15
    strict = find(spark, texts, verbatim_only=True)
    w99 = " ".join(w).replace("14", "99").replace("Velmar", "Osmere").split()
    still = any(w[i : i + 12] == w99[i : i + 12] for i in range(len(w) - 11))
    assert set(strict) == {(i, 0) for i in (0, 2, 3, 4, 5, 6)} | ({(10, 0)} if still else set())


def test_leaks_shared_and_none(spark):
    other = " ".join(ITEM.split()[:13]) + " and then something else entirely"
    got = find(spark, [mail(" ".join(ITEM.split()[:13]))] * 2, (ITEM, other, "", "short item"))
    assert set(got) == {(d, i) for d in (0, 1) for i in (0, 1)}
    assert find(spark, [mail(ITEM)], ()) == {} and find(spark, []) == {}


def test_leaks_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [" ".join(rnd.choices(vocab, k=40)) for _ in range(6)]
    docs = []
    for _ in range(60):
        it = rnd.choice(items).split()
        n, a = rnd.randrange(8, 18), rnd.randrange(0, 20)
        docs.append(" ".join(rnd.choices(vocab, k=10) + it[a : a + n] + rnd.choices(vocab, k=10)))

    def longest(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            new = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    new[j + 1] = row[j] + 1
                    best = max(best, new[j + 1])
            row = new
        return best

    want = {(d, i) for d, t in enumerate(docs) for i, u in enumerate(items) if longest(t.split(), u.split()) >= 12}
    assert want and set(find(spark, docs, items, verbatim_only=True)) == want
    monkeypatch.setattr(leaks, "FILTER_BITS", 256)  # a filter that is full
    monkeypatch.setattr(leaks, "BROADCAST_WINDOWS", 0)
    assert set(find(spark, docs, items, verbatim_only=True)) == want


def test_leaks_with_an_unseen_name_and_decimals(spark):
    item = "Before the storm Anna poured 3.5 litres into kettles and Anna sealed them while 1,200 guests waited near the harbour for Anna to finish"
    doc = item.replace("Anna", "Zoltan").replace("3.5", "4").replace("1,200", "90")
    a, b = item.split(), doc.split()
    assert all(a[i : i + 12] != b[i : i + 12] for i in range(len(a) - 11))
    got = find(spark, [mail(doc), mail(item.replace("3.5", "3,5")), mail(item.replace("kettles", "buckets").replace("guests", "people"))], (item,))
    assert got == {(0, 0): ("reparameterised", len(a)), (1, 0): ("verbatim", len(a))}


def test_leaks_exchanged_words_are_names(spark):
    item = "Then we all saw the old kettles near the harbour and Then we left the harbour again with Velmar before noon"
    docs = [item.replace("Then", "Soon"), item.replace("Velmar", "Zoltan"), "soon then soon then soon then", item.replace("Velmar", "Osmere").lower()]
    got = find(spark, docs, (item, "We met Osmere there"))
    assert {k: v[0] for k, v in got.items()} == {(1, 0): "verbatim", (3, 0): "verbatim"} and got[(1, 0)][1] == len(item.split())


def test_p7_found_by_templates_and_slots(spark, tmp_path, monkeypatch):
    from skycatalog.llm import queries

    item = "Before the storm Anna poured 16MB litres into kettles and Anna sealed them while 1,200 guests waited near the harbour for Anna to finish"
    texts = [item, item.replace("Anna", "Zoltan").replace("16MB", "4").replace("1,200", "90"), " ".join(item.split()[:12]).lower(), item.replace("Anna", "Zoltan", 1).replace("Anna", "Osmere", 1).replace("Anna", "Zoltan")]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "en", item)], "item_id long, lang string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    windows, real = [], leaks.leaked_windows
    monkeypatch.setattr(leaks, "leaked_windows", lambda *a, **kw: windows.append(real(*a, **kw)) or windows[0])
    assert {tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()} == {(0, 0), (2, 0)}
    kinds = {(r.doc_id, r.kind) for r in windows[0].collect()}
    assert {(0, "verbatim"), (1, "reparameterised"), (2, "verbatim")} <= kinds and (1, "verbatim") not in kinds


# ---- mixing

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER_PATH), reason="no public tokenizer here")


@needs_tokenizer
def test_mix_meets_its_shares(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choices(["kettle", "harbour", "dome", "ß"], k=rnd.randrange(5, 60))), s, "x") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 60)]
    docs += [(9001, None, "a", "x"), (9002, "", "b", "x"), (9003, "no source", None, "x"), (9004, "other", "zzz", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 4), ("none", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(d, t)
    rows, s = copies.collect(), {r.source: r for r in shares.collect()}
    cap = {"a": 1, "b": 3, "c": 4}
    assert len(rows) == 900 + 300 + 60 + 2 and all(0 <= r.copies <= cap[r.source] and r.rate <= cap[r.source] for r in rows)
    assert set(s) == {"a", "b", "c", "none"} and s["none"].used_tokens == 0
    for k, share in (("a", 0.3), ("b", 0.4), ("c", 0.2)):
        assert s[k].actual_share == pytest.approx(share / 0.9, rel=0.03) and abs(s[k].residual) <= mixing.TOLERANCE
    # rates are tilted exponentially by length below the cap
    import math

    free = [(r.n_tokens, math.log(r.rate)) for r in rows if r.source == "b" and 0 < r.rate < 2.99]
    slopes = [y / x for x, y in free]
    assert max(slopes) - min(slopes) < 1e-3


@needs_tokenizer
def test_mix_edges(spark):
    d = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    t = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(d.where("false"), t)
    assert copies.count() == 0 and shares.first().actual_share == 0
    copies, shares = mixing.mix(d, t.where("false"))
    assert copies.count() == 0 and shares.count() == 0
    copies, _ = mixing.mix(d, t)
    assert copies.first().copies in (1, 2)


# ---- sentences


def starts(spark, texts, lang="en"):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, shape string")
    out = {}
    for r in sentences.sentence_starts(docs).collect():
        out.setdefault(r.doc_id, set()).add(r.start_char)
    return out


def corpus(rnd, n=120):
    """Small words, abbreviations before names and numbers, and the same words at sentence starts."""
    words = "dome kettle ribbon harbour valley copper window signal ledger meadow".split()
    out = []
    for _ in range(n):
        s = []
        for _ in range(4):
            w = rnd.choices(words, k=6)
            w.insert(rnd.randrange(1, 6), rnd.choice(["Dr. Velmar", "approx. 3.5 mm", "e.g. the old", "Fig. 4b", "Orsel", "Velmar"]))
            s.append(" ".join([w[0].capitalize(), *w[1:]]) + rnd.choice([".", ".", "?", "!", "…", " etc."]))
        out.append(mail(" ".join(s)))
    return out


def test_sentences_of_a_learned_language(spark):
    rnd = random.Random(8)
    texts = corpus(rnd)
    target = 'Dome saw Dr. Velmar etc. Kettle cost approx. 3.5 mm e.g. here. "Ribbon went?" said Orsel. Window came! "Signal left." Ledger is on Fig. 4b… Meadow'
    raw = mail(target)
    at = raw.index(target)
    got = starts(spark, [*texts, raw])[len(texts)]
    want = {at + target.index(x) for x in ("Kettle", '"Ribbon', "Window", '"Signal', "Ledger", "Meadow")}
    assert got == want


@pytest.mark.parametrize(
    "text, firsts",
    [
        ("窗户打开了。“花园冷。”工坊，送到了“好吗？”他问着！灯……桥", ["“花园", "工坊", "灯", "桥"]),
        ("手紙。「確認した。」「銅夜。」橋（本当？）と閉じた。夜", ["「確", "「銅", "橋", "夜"]),
        ("रात पत्र था। बगीचा खाली? तार", ["बगीचा", "तार"]),
        ("รายงานเปิด สะพาน 120 คืน ตลาด", ["สะพาน", "ตลาด"]),
        ("Νύχτα κρύο; Θόλος ήταν! Αργά", ["Θόλος", "Αργά"]),
        ("¡Sí! ¿Mide hoy «¡Sí!» luego? «Vacío.» Norte", ["¿Mide", "«Vacío", "Norte"]),
        ("وصل الجديد؟ قاس السوق. طلب", ["قاس", "طلب"]),
        ("A 😀 dome. Kettle", ["Kettle"]),
        ("« Oui ! » Second pont « Oui ! » Orsel vient ! Après", ["Second", "Après"]),
        ("One dome. iKiln closed! said nobody. two", ["iKiln"]),
    ],
)
def test_scripts(spark, text, firsts):
    raw = mail(text)
    at, i, want = raw.index(text), 0, set()
    for f in firsts:
        i = text.index(f, i + 1 if i else 0)
        want.add(at + i)
    assert starts(spark, [raw]).get(0, set()) == want


def test_what_holds_no_sentences(spark):
    body = "Hi. Ann\n\nOne. Two\n> Quoted. More\n| Bar. More\nOn 1/2/2020, Ann wrote. Then wrote:\nFrom: A. B\n\n-- \nAnn. Lee\nTel. Five\n\nAfter. Wards"
    raw = mail(body)
    got = {raw[s : s + 5] for s in starts(spark, [raw])[0]}
    assert got == {"Ann\n\n", "Two\n>", "Wards"}
    assert starts(spark, [mail(base64.encodebytes(b"One. Two").decode(), cte="base64"), mail("One. Two", "text/html"), None, "", "x" * 50_000]) == {}
    assert starts(spark, []) == {}


def test_sentence_units_cover_the_text(spark):
    raw = mail("One thing. Two things!\nThree\n\nFour")
    docs = spark.createDataFrame([(1, raw, None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = sentences.sentences(docs).orderBy("start_char").collect()
    assert [r.sentence for r in rows] == ["One thing.", "Two things!", "Three", "Four"] or [r.sentence for r in rows] == ["One thing.", "Two things! Three"[:11], "Three", "Four"]
    assert all(" ".join(raw[r.start_char : r.end_char].split()) == r.sentence for r in rows)


def test_sentence_units_of_texts_under_one_id(spark):
    a, b = mail("Abc def. Ghi jkl! Mno"), mail("Pq! Rstuvw xyz! Abc")
    rows = sentences.sentences(spark.createDataFrame([(1, a, "en"), (1, b, "en"), (1, b, "en")], "doc_id long, text string, lang string")).collect()
    assert sorted(r.sentence for r in rows) == sorted(["Abc def.", "Ghi jkl!", "Mno", *["Pq!", "Rstuvw xyz!", "Abc"] * 2])


def test_long_words_are_told_apart():
    a, b = "x" * 60 + "a", "x" * 60 + "b"
    assert sentences.counted(a) != sentences.counted(b) and sentences.counted("abc") == "abc"


@pytest.mark.parametrize("piece", ['said "Yes" to Orsel. Then ', "kettle. ", "a" * 30 + ". Bcd! ", "-" * 40 + " "])
def test_the_scan_is_linear(piece):
    import time

    def took(n):
        text, best = piece * (n // len(piece)), 9.0
        for _ in range(3):
            began = time.perf_counter()
            sum(1 for _ in sentences.candidates(text))
            best = min(best, time.perf_counter() - began)
        return best

    assert took(800_000) < 9 * took(200_000) + 0.05


@pytest.mark.parametrize("text, first", [("Ժամը վեց է։ Բարև", "Բարև"), ("ሰላም ነው። ደህና", "ደህና"), ("ဟုတ်ကဲ့။ မင်္ဂလာပါ", "မင်္ဂလာပါ"), ("ফুল ফোটে। আকাশ", "আকাশ")])
def test_terminals_of_other_scripts(spark, text, first):
    raw = mail(text)
    assert starts(spark, [raw]).get(0, set()) == {raw.index(first, raw.index(text))}


def test_recall_of_reparameterised_items(spark):
    rnd = random.Random(12)
    small = [a + b for a in ("kel", "dom", "rib", "har", "cop", "mead", "lan", "win") for b in ("tle", "ber", "bon", "bour", "per", "ow", "tern", "dle")]
    name = lambda: "".join(rnd.choices("bdfgklmnprst", k=1)).upper() + "".join(rnd.choices("aeioulmnr", k=7))

    def item():
        w = rnd.choices(small, k=30)
        for at in (6, 16, 25):  # no run of 12 words without a slot
            w[at] = "<name>" if at != 16 else "<number>"
        return ["The", *w]

    def filled(w):
        a, n = name(), str(rnd.randrange(10, 9999))
        return " ".join(a if x == "<name>" else n if x == "<number>" else x for x in w)

    plans = [item() for _ in range(40)]
    items = [filled(w) for w in plans]
    texts = [mail(" ".join(rnd.choices(small, k=20)) + ". " + filled(w)) for w in plans] + [mail(" ".join(rnd.choices(small, k=60))) for _ in range(40)]
    got = find(spark, texts, items)
    planted = {(i, i) for i in range(40)}
    assert set(got) <= planted and len(set(got) & planted) >= 38 and {k for k, _ in got.values()} == {"reparameterised"}


def test_nearest_in_time_query_matches_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from skycatalog.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute(f"create view frames as select * from '{data}/frames.parquet'")
    assert sorted(map(tuple, queries.p1_found(spark, data).collect())) == sorted(c.sql(queries.ORACLE["p1_found"]).fetchall())
