"""Leaked passages and personal data on planted texts."""

import random

import pytest

from pyspark.sql import functions as F

from lcspark.llm import leak, pii

VOCAB = [f"{a}{b}{c}" for a in "ka lo mi ru ta ve".split() for b in "n r s".split() for c in "do ge li pa".split()]


def _words(r, n):
    return [r.choice(VOCAB) for _ in range(n)]


def _planted(seed=0):
    r = random.Random(seed)
    items = [(i, " ".join(_words(r, r.randrange(60, 90))).capitalize() + ".") for i in range(30)]
    docs, want = [], set()
    for d in range(240):
        body = _words(r, r.randrange(100, 400))
        kind = d % 6
        i, t = items[d % 30]
        w = t.rstrip(".").split()
        if kind == 0:
            part = w
        elif kind == 1:
            part = [x if r.random() > 0.1 else r.choice(VOCAB) for x in w]
        elif kind == 2:
            k = r.randrange(len(w) // 3)
            part = w[k : k + round(len(w) * 0.65)]
        elif kind == 3:
            part = [x.upper() for x in w]
            part.insert(len(w) // 2, "\n\nHigh Court — HT 2012/0002082 — page 2\n\n")
        elif kind == 4:
            part = w[: len(w) // 4]
        else:
            part = []
        if kind < 4:
            want.add((d, i))
        at = r.randrange(len(body))
        text = " ".join(body[:at] + part + body[at:])
        if kind == 1:
            words = text.split(" ")
            k = len(words) // 2
            words[k] = words[k][:2] + "-\n" + words[k][2:]
            text = "\n".join(words)
        docs.append((d, text))
    return docs, items, want


def test_planted_passages_are_found(spark):
    docs, items, want = _planted()
    d = spark.createDataFrame(docs + [(900, ""), (901, None), (None, items[0][1]), (902, items[1][1]), (902, items[1][1])], "doc_id bigint, text string").withColumn("share", F.lit(1)).withColumn("item_id", F.lit(1))
    i = spark.createDataFrame([*items, (77, ""), (78, None), (None, "x")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    rows = leak.leaked(d, i).collect()
    assert len(rows) == len({(x.doc_id, x.item_id) for x in rows})
    got = {(x.doc_id, x.item_id) for x in rows}
    assert (902, items[1][0]) in got
    got -= {(902, items[1][0])}
    assert got == want
    assert leak.leaked(d.limit(0), i).count() == 0 and leak.leaked(d, i.limit(0)).count() == 0


def test_joined_keys_give_the_same(spark):
    docs, items, want = _planted(3)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leak.leaked(d, i).collect()} == want
    assert {(x.doc_id, x.item_id) for x in leak.leaked(d, i, held=8).collect()} == want


def _passage(r, w, share, changed):
    n = max(1, round(len(w) * share))
    k = r.randrange(len(w) - n + 1)
    p = list(w[k : k + n])
    for j in r.sample(range(n), round(n * changed) if n >= 5 else 0):
        p[j] = r.choice(WIDE)
    return p


WIDE = [f"{a}{b}" for a in "kalo mira ruta veno sipe dugo hate bilu".split() for b in (f"{x}{y}{z}" for x in "bdfgklmn" for y in "aeiou" for z in "lnrst")]


@pytest.mark.parametrize("held", [10**6, 0])
def test_recall_by_length_of_the_item(spark, held):
    """At least nine of ten for items of 8 to 200 words, verbatim, and half of them with one word in ten changed; nothing else is reported."""
    r = random.Random(17)
    items, docs, planted = [], [], {}
    for size in (8, 12, 16, 20, 24, 30, 40, 60, 90, 140, 200):
        for share, changed in ((1.0, 0.0), (0.5, 0.0), (0.5, 0.1), (0.7, 0.1)):
            for _ in range(12):
                w = [r.choice(WIDE) for _ in range(size)]
                items.append((len(items), " ".join(w)))
                body = [r.choice(WIDE) for _ in range(150)]
                body[70:70] = _passage(r, w, share, changed)
                docs.append((len(docs), " ".join(body)))
                planted.setdefault((size, share, changed), []).append(len(items) - 1)
    # a quotation of a third of the words is no case
    for k in range(0, len(items), 4):
        w = items[k][1].split()
        if len(w) >= 24:
            docs.append((len(docs), " ".join([r.choice(WIDE) for _ in range(60)] + w[: len(w) // 3] + [r.choice(WIDE) for _ in range(60)])))
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leak.leaked(d, i, held=held).collect()}
    recall = {k: sum((x, x) in got for x in v) / len(v) for k, v in planted.items()}
    assert min(recall.values()) >= 0.75 and sum(recall.values()) / len(recall) >= 0.97, recall
    for kind in ((1.0, 0.0), (0.5, 0.0), (0.5, 0.1), (0.7, 0.1)):
        assert sum(v for (_, *k), v in recall.items() if tuple(k) == kind) / 11 >= 0.9
    assert not {x for x in got if x[0] != x[1]}


def test_common_wording_is_no_case(spark):
    r = random.Random(3)
    w = [r.choice(WIDE) for _ in range(60)]
    half = _passage(r, w[:30], 1.0, 0.1)
    text = lambda: " ".join([r.choice(WIDE) for _ in range(40)] + half + [r.choice(WIDE) for _ in range(40)])
    i = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    few = spark.createDataFrame([(k, text()) for k in range(40)], "doc_id bigint, text string")
    many = spark.createDataFrame([(k, text()) for k in range(120)], "doc_id bigint, text string")
    for held in (10**6, 0):
        assert leak.leaked(few, i, held=held).count() == 40 and leak.leaked(many, i, held=held).count() == 0


def test_long_text(spark):
    r = random.Random(9)
    item = " ".join(_words(r, 70))
    d = spark.createDataFrame([(1, " ".join(_words(r, 150_000)) + " " + item)], "doc_id bigint, text string")
    assert [x.doc_id for x in leak.leaked(d, spark.createDataFrame([(5, item)], "item_id bigint, text string")).collect()] == [1]


def test_alignment_equals_brute_force():
    import numpy as np

    r = random.Random(2)
    for _ in range(20):
        a = [r.randrange(12) for _ in range(r.randrange(5, 30))]
        b = [r.randrange(12) for _ in range(4)] + [x for x in a if r.random() > 0.1] + [r.randrange(12) for _ in range(5)]
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1.5), h[i - 1, j] - 1.5, h[i, j - 1] - 1.5)
        items = leak.Items(np.array([1]), np.array(a, np.uint64), np.array([0, len(a)]), (), *[np.empty(0)] * 6)
        score, reach = leak.passages(np.array(b, np.uint64), np.array([0, len(b)]), np.array([0]), np.array([0]), np.array([4]), items)
        assert score[0] == h.max() and h.max() <= reach[0] <= len(a)


CASES = [
    ("Counsel wrote to Mr Adler and to Karl Brenner; both came.", [("name", "Adler"), ("name", "Karl Brenner")]),
    ("The witness HUGO J. WEIDNER and Brandt, Anna were heard.", [("name", "HUGO J. WEIDNER"), ("name", "Brandt, Anna")]),
    ("Before: K. Halder\n\nHEADNOTE\nNo case: A.K. and Mr E. appeared for Halder & Sons Ltd.", [("name", "K. Halder")]),
    ("La cour de cassation et le juge que M. Dubreuil a saisi dans une affaire.", [("name", "Dubreuil")]),
    ("Mail to <k.adler@post.example> or office [at] law [dot] example, fax k_2 @ x-y.test.", [("email", "k.adler@post.example"), ("email", "office [at] law [dot] example"), ("email", "k_2 @ x-y.test")]),
    ("Call +44 1632 960 123, (01632) 960-398, 030/23125174, 0049 (0)30 23125232 or 01.99.00.82.21.", [("phone", "+44 1632 960 123"), ("phone", "(01632) 960-398"), ("phone", "030/23125174"), ("phone", "0049 (0)30 23125232"), ("phone", "01.99.00.82.21")]),
    ("Passport X1234567, tax ID 954-82-2499; not 12.03.2001, INV-9167-226, Registry ref. 2231-4817-26 or HT 2011/0000103.", [("id_number", "X1234567"), ("id_number", "954-82-2499")]),
    ("lived at Flat 8, 157 Quayside Terrace, Selmouth ZQ26 8XW until", [("address", "Flat 8, 157 Quayside Terrace, Selmouth")]),
    ("wohnhaft Obere Mühlstrasse 45a, 90498 Torfen, und 153, quai de la Pesée, 99108 Port-Lisse.", [("address", "Obere Mühlstrasse 45a, 90498 Torfen"), ("address", "153, quai de la Pesée, 99108 Port-Lisse")]),
    ("messages to ████@████ or [NAME REDACTED] of [address withheld]", []),
    ("", []),
]


def test_mentions():
    blanks = "Tax ID: " + " " * 200 + "954822499"
    assert [k for *_, k, _ in pii.find(blanks)] == ["id_number"]
    for text, want in CASES:
        got = [(k, text[a:b]) for a, b, k, _ in pii.find(text)]
        assert [k for k, _ in got] == [k for k, _ in want], text
        for (_, g), (_, w) in zip(got, want):
            assert w.startswith(g) or g.startswith(w), text
        assert [text.index(w) for _, w in want] == [a for a, *_ in pii.find(text)]


# names that no list holds, by the evidence that finds them
UNLISTED = [
    ("Giorgio Rossi met Wei Zhang and Aleksandra Nowak.", ["Giorgio Rossi", "Wei Zhang", "Aleksandra Nowak"]),
    ("Björn Lindqvist, Ngozi Okafor and Siobhan Kelly wrote to the court.", ["Björn Lindqvist", "Ngozi Okafor", "Siobhan Kelly"]),
    ("The claimant Deborah Collins sued; Brian Collins did not.", ["Deborah Collins", "Brian Collins"]),
    ("Mr Rossi came in May. Giorgio Rossi left.", ["Rossi", "Giorgio Rossi"]),
    ("Herr Łukasz Wójcik und Frau Šimková waren da.", ["Łukasz Wójcik", "Šimková"]),
    ("Die Zeugin Milica Đorđević sagte nichts.", ["Milica Đorđević"]),
    ("the letter of Иван Петров was read in the court", ["Иван Петров"]),
    ("Jean-Pierre Dupont et le témoin Aïssatou Ndiaye sont venus.", ["Jean-Pierre Dupont", "Aïssatou Ndiaye"]),
    ("Mr Li and Karl Wu spoke with Mrs Ng.", ["Li", "Karl Wu", "Ng"]),
    ("Maria von der Heide and Karl van Dongen left.", ["Maria von der Heide", "Karl van Dongen"]),
    # no persons
    ("The claimant Northern Harbour Authority and High Court of Tarvell; Karl Brenner and Lindholt & Partner AG.", ["Karl Brenner"]),
    ("Die Klägerin\n\nKantonsgericht Oberhain — KG 2012/0004523", []),
    ("the witness Limitation Act is silent on the limitation act", []),
]


def test_names_beyond_the_list():
    for text, want in UNLISTED:
        got = [text[a:b] for a, b, k, _ in pii.find(text) if k == "name"]
        assert got == want, (text, got)


def test_spellings_of_a_value_are_one():
    assert len({pii.normal("email", x) for x in ("j.doe@firm.example", "J.Doe @ firm.example", "j.doe (at) firm.example", "j.doe [at] firm [dot] example", "j.doe at firm dot example")}) == 1
    assert len({pii.normal("phone", x) for x in ("+44 1632 960 123", "01632 960123", "0044 (0)1632-960123", "(01632) 960 123")}) == 1
    assert pii.normal("id_number", "954-82-2499") == pii.normal("id_number", "954 822499")


def test_surrogates_keep_form():
    import re
    import unicodedata

    new = lambda kind, shown: pii.rendered(kind, shown, [pii.surrogate(b"k", kind, pii.normal(kind, shown))])
    a, b = new("phone", "+44 1632 960 123"), new("phone", "01632 960123")
    assert re.fullmatch(r"\+44 \d{4} \d{3} \d{3}", a) and re.fullmatch(r"0\d{4} \d{6}", b) and re.sub(r"\D", "", a)[-9:] == re.sub(r"\D", "", b)[-9:]
    c, d = new("email", "j.doe@firm.example"), new("email", "j.doe (at) firm [dot] example")
    assert re.fullmatch(r"\w+\.\w+@\w+\.invalid", c) and re.fullmatch(r"\w+\.\w+ \(at\) \w+ \[dot\] invalid", d) and d.replace(" (at) ", "@").replace(" [dot] ", ".") == c
    assert new("email", "a@firm.example").split("@")[1] == c.split("@")[1]
    assert re.fullmatch(r"[A-Z]\d{7}", new("id_number", "X1234567")) and re.fullmatch(r"\d{3}-\d\d-\d{4}", new("id_number", "954-82-2499"))
    assert re.fullmatch(r"Flat \d, \d{3} [A-Z][a-z]+ Terrace, [A-Z][a-z]+", new("address", "Flat 8, 157 Quayside Terrace, Selmouth"))
    assert re.fullmatch(r"Obere [A-Z][a-z]+strasse \d\da, \d{5} [A-Z][a-z]+", new("address", "Obere Mühlstrasse 45a, 90498 Torfen"))
    assert re.fullmatch(r"\d{3}, quai de la [A-Z][a-z]+, \d{5} [A-Z][a-z]+-[A-Z][a-z]+", new("address", "153, quai de la Pesée, 99108 Port-Lisse"))
    assert new("address", "12 Hill Road, Selmouth").split()[-1] == new("address", "7 Mill Lane, Selmouth").split()[-1]
    name = lambda shown, *parts: pii.rendered("name", shown, [pii.surrogate(b"k", t, v.casefold()) for t, v in parts])
    x = name("Иван Петров", ("given", "Иван"), ("surname", "Петров"))
    assert all(unicodedata.name(c).startswith("CYRILLIC") for c in x if c.isalpha()) and x.istitle()
    assert name("KARL BRENNER", ("given", "Karl"), ("surname", "Brenner")) == name("Karl Brenner", ("given", "Karl"), ("surname", "Brenner")).upper()
    assert re.fullmatch(r"[A-Z]\. [A-Z][a-z]+", name("K. Brenner", ("initial", "K"), ("surname", "Brenner"))) and re.fullmatch(r"\w+, \w+", name("Brandt, Anna", ("surname", "Brandt"), ("given", "Anna")))
    assert re.fullmatch(r"\w+ von der \w+", name("Maria von der Heide", ("given", "Maria"), ("surname", "Heide"))) and pii.surrogate(b"k", "given", "anna").endswith("a") and pii.surrogate(b"k", "given", "karl").endswith("o")


def test_a_surrogate_is_no_real_value_and_no_rank(spark):
    rows = [(k, f"Mr {n} came.") for k, n in enumerate(("Adler", "Brenner", "Halder"))]
    one = {r.value: r.surrogate for r in pii.surrogates(pii.mentions(spark.createDataFrame(rows, "doc_id bigint, text string")), "key").collect()}
    clash = one["adler"].capitalize()
    more = [*rows, (9, f"Mr {clash} came."), *[(20 + k, f"Mr Aa{x}der came.") for k, x in enumerate("bcdfgh")]]
    two = {r.value: r.surrogate for r in pii.surrogates(pii.mentions(spark.createDataFrame(more, "doc_id bigint, text string")), "key").collect()}
    assert one["adler"] == pii.surrogate(b"key", "surname", "adler") and two["adler"] == pii.surrogate(b"key", "surname", "adler", 1)
    assert two["brenner"] == one["brenner"] and two["halder"] == one["halder"]
    assert not set(two.values()) & set(two) and len(set(two.values())) == len(two)


def test_redaction_keeps_the_rest_and_tells_people_apart(spark):
    docs = [(1, "Karl Brenner met Mrs Brenner and Karl Adler. K. Brenner left."), (2, "Call Karl Brenner: +44 1632 960 123."), (2, "Nobody here."), (3, None), (4, ""), (None, "Anna Weidner wrote.")]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id bigint, text string").withColumn("m", F.lit(1)).withColumn("text_id", F.lit(1))
    out = [(r.doc_id, r.text) for r in pii.redacted(d, "key").collect()]
    assert len(out) == 7 and out.count(next(x for x in out if x[0] == 1)) == 2
    text = {i: t for i, t in out if i in (1, 3, 4)}
    import re

    names = re.findall(r"\[NAME ([^\]]+)\]", text[1])
    assert re.sub(r"\[NAME [^\]]+\]", "#", text[1]) == "# met Mrs # and #. # left." and text[3] is None and text[4] == ""
    given, family = names[0].split(" ")
    assert names[1] == family and names[2].split(" ")[0] == given and names[2] != names[0] and names[3] == f"{given[0]}. {family}"
    assert (2, "Nobody here.") in out and not any(t and "Weidner" in t for _, t in out)
    (call,) = [t for i, t in out if i == 2 and "Call" in t]
    assert call.startswith(f"Call [NAME {names[0]}]: [PHONE +") and call.endswith("].")
    other = [r.text for r in pii.redacted(d, "another").filter("doc_id = 1").collect()][0]
    assert other != text[1]
    assert pii.redacted(d.limit(0), "key").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr {a}{b}{c}") for i, (a, b, c) in enumerate((a, b, c) for a in "Abcdefghijklmnop" for b in "aeiou" for c in ("rnes", "lder", "mbach", "nnert", "stig"))]
    rows = [(i, t[:3] + t[3:].capitalize()) for i, t in rows]
    found = pii.mentions(spark.createDataFrame(rows, "doc_id bigint, text string"))
    s = pii.surrogates(found, "key")
    assert s.count() > 300 and s.select("type", "surrogate").distinct().count() == s.count()
