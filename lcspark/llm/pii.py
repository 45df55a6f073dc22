"""Personal data in free text: found, given keyed surrogates of their own type, and replaced by typed placeholders.

Finding is a map over whole texts. Names are found by several kinds of evidence: a listed given name, initials or a title before a surname; the
role a person has in the proceedings; being the subject or object of what only people do; standing in a row with a name; and, in the same text, a
surname that one of these has shown. Every distinct value (for names: every given name, surname and initial; for the other kinds its normal form,
whatever the spelling) then gets one keyed surrogate of the same type, gender, script and shape over the whole corpus, so that the same person
keeps one surrogate and different values stay different: surrogates that meet, or that are real values of the corpus, are drawn again from the
value's further digests. The table is joined, never broadcast whole.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.session import materialise, spread

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names of the three languages and of their immigrants, by grammatical gender.
FEMALE = """Ada Agnes Alice Amara Amelie Amina Ana Anita Anja Anna Anne Antonia Astrid Barbara Beatrice Birgit Brigitte Camille Carla Carmen Caroline
Catherine Cécile Céline Charlotte Chloé Christine Clara Claire Claudia Delphine Denise Diana Doris Edith Elena Eleonore Elisabeth Elizabeth Ella Elsa Emily
Emma Erika Esther Eva Fatima Florence Françoise Frieda Gabriele Gerda Gisela Greta Hanna Hannah Heidi Helen Helena Helga Hélène Ida Ilse Inès Ingrid
Irene Isabelle Jana Jane Jeanne Johanna Judith Julia Julie Karin Katharina Laura Lea Leila Lena Lina Louise Lucia Lucie Madeleine Margaret Maria Marie
Marta Martha Martina Mary Mathilde Mei Monika Nadia Nicole Nina Nora Olga Olivia Paula Petra Priya Rosa Ruth Sabine Sara Sarah Simone Sofia Sophie
Susan Susanne Sylvie Tanja Thérèse Ursula Valérie Vera Victoria Yasmin Zoe Zoé Zoë""".split()
MALE = """Adam Ahmed Alan Albert Alexander Ali Andrew Antoine Anton Armin Arthur Axel Benoît Bernard Bernd Bruno Carlos Charles Christian Claude Dieter
David Daniel Dominik Edgar Edward Edwin Emil Erich Erik Ernst Felix Finn Florian François Frank Fritz Gaston Georg George Gérard Gilles Gustav Günter
Hans Harald Heinrich Heinz Henri Henry Hermann Hubert Hugo Ibrahim Ivan Jacques James Jan Jean Johann John Jonas Josef Joseph Julian Jürgen Kamil Karl
Kevin Klaus Konrad Kurt Lars Laurent Leo Leon Louis Luc Lukas Manfred Marc Marcel Mario Martin Matthias Max Maurice Michael Michel Moritz Niels Nikolai
Oliver Olivier Omar Oscar Oskar Otto Pascal Paul Pavel Peter Philipp Philippe Pierre Rafael Rainer Ralph Raphaël Ravi Raymond Reinhard René Richard Robert Rolf
Samuel Sebastian Serge Simon Stefan Stephen Sven Tariq Théo Thierry Thomas Tim Tomas Ulrich Urs Viktor Walter Werner William Wolfgang Xavier Yann Yves Yusuf""".split()
GENDER = {n.casefold(): "f" for n in FEMALE} | {n.casefold(): "m" for n in MALE}
# Titles that stand before a surname; the offices and months that look like names.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "me", "sir", "lady", "madame", "monsieur", "maître", "doktor", "professor"}
NO_SURNAME = set("""the and for from with judge justice presiding before between court tribunal docket decision section article tel fax mail flat unit headnote
januar januar february march april may june july august september october november december januar februar märz mai juni juli oktober dezember
monday tuesday wednesday thursday friday saturday sunday receiver minister registrar counsel claimant respondent der die das ein eine nach aus als wie
gemäss regeste sommaire besetzung composition entre affaire geschäft richter richterin juge kammer cour name address redacted withheld letters
am im in an zu er es so ob um da wo je de le la du au en et il se ce un by at of on or as it is he we no to be do my if up us
ltd ag gmbh sa plc llp co inc""".split())  # fmt: skip
# Words between a given name and a surname that belong to the name.
PARTICLES = "van von vom zu zur der den de di da del della la le du des ter ten bin ibn al el dos das".split()
# What persons are in proceedings and contracts, and what only persons do; a full name after or around these is one.
ROLES = """claimant plaintiff defendant applicant appellant respondent petitioner witness expert accused victim tenant landlord employee patient
Kläger Klägerin Beklagter Beklagte Zeuge Zeugin Gutachter Gutachterin Beschwerdeführer Beschwerdeführerin Beschuldigter Beschuldigte Mieter Mieterin
Arbeitnehmer Arbeitnehmerin demandeur demanderesse défendeur défenderesse témoin expert experte requérant requérante recourant recourante intimé intimée prévenu
prévenue locataire salarié salariée""".split()
DEEDS = """met wrote said stated testified signed told replied lived married phoned visited swore thanked traf schrieb sagte erklärte unterschrieb wohnte
heiratete bezeugte rencontra écrivit déclara signa témoigna habitait épousa""".split()

# Mail is anchored on its sign, from which the local part is read backwards.
_AT_SIGN = re.compile(r"@|[\[(](?:at|AT|At|ät|ÄT|Ät)[\])]")
_DOMAIN = re.compile(r"\s?[\w-]+(?:(?:\.|\s?[\[(](?:dot|punkt|point)[\])]\s?)[\w-]+)+", re.I)
_WRITTEN = re.compile(r"(?<![\w.+-])[\w.+-]+\s(?:at|AT|arobase)\s[\w-]+(?:\s(?:dot|DOT|punkt|point)\s[\w-]+)+")
# Numbers are looked at as clusters of digits and their signs; the words before a cluster and its shape say what it is.
_CLUSTER = re.compile(r"\d[\d\s().+/-]{4,}")
_PHONE = re.compile(r"(?<![\w./+-])(?:\+\d{1,3}[\s.-]?(?:\(0\))?|00\s?\d{2}\s?(?:\(0\)\s?)?|\(0?\d{2,5}\)\s?|0\d{1,4}[\s./-]?)\d{1,9}(?:[\s.-]\d{2,9}){0,5}(?![\w/])")
_DATE = re.compile(r"\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d\d-\d\d")
_REFERENCES = ("ref", "ref.", "INV-", "no. of file", "Docket", "docket", "Geschäft", "Affaire", "folio", "folios")
# Parts of which one stands in whatever _ID_BEFORE finds.
_ID_STEMS = ("tax", "identity", "personal", "passport", "insurance", "security", "id", "ausweis", "ahv", "steuer", "sozial", "passeport", "pièce", "numéro", "sécurité", "avs")
_ID_BEFORE = re.compile(
    r"(?i:tax\s+(?:ID|no|number)|identity\s+(?:no|number|card)|personal\s+(?:no|number|ID)|passport(?:\s+no)?|national\s+insurance(?:\s+(?:ref|no|number))?|social\s+security(?:\s+(?:no|number))?|\bID(?:\s+(?:number|no|card))?"
    r"|Ausweis(?:-?Nr|nummer)?|AHV[\w-]*(?:\s+Nr)?|Personal(?:nummer|ausweis)|Steuer(?:-?ID|nummer)|Sozialversicherungsnummer|passeport|pièce\s+d['’]identité|numéro\s+(?:fiscal|d['’]identité|AVS)|sécurité\s+sociale|\bAVS)"
    r"[\s.:]*(?:n°|no\.?|Nr\.?)?[\s.:]*((?:[A-Z]{1,4}-?)?)\Z",
)
_ID_VALUE = re.compile(r"(?:[A-Z]{1,4}-?)?\d(?:[\s-]?[\dA-Z](?![a-z])){5,14}(?!\w)")
_ID_SHAPE = re.compile(r"(?<![\w./-])(?:[A-Z]{2,4}-\d{7,9}-[A-Z]|\d{3}-\d{2}-\d{4}|\d{6}-\d{4})(?![\w/-])")
_STREET = r"Terrace|Lane|Square|Street|Road|Close|Avenue|Row|Drive|Crescent|Court|Place|Gardens|Grove|Mews|Walk|Way|Hill|Ave|Rd|St|Sq|Ln|Dr"
_WORD_CAP = r"[A-ZÀ-Þ][\w'’.-]*"
# Addresses are anchored on what is rare: a number before a capital, or a postcode after a comma.
_NUMBER_CAPITAL = re.compile(r"\d[A-Za-z]?,?\s+[A-ZÀ-Þ]")
_STREET_EN = re.compile(rf"\d{{1,4}}[A-Za-z]?,?\s+(?:{_WORD_CAP}\s+){{1,4}}?(?:{_STREET}|{_STREET.upper()})\b\.?,?\s+[A-ZÀ-Þ]")
_BEFORE_EN = re.compile(r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|FLAT|UNIT)\s+\d+[A-Za-z]?,\s+)?(?:[Nn][Oo]\.\s+)?\Z")
_POSTCODE = re.compile(r",\s+(?:[A-Z]{1,2}-)?\d{4,5}\s+[A-ZÀ-Þ]")
_STREET_DE = r"(?:strasse|straße|str\.|weg|gasse|brücke|platz|allee|ufer|hof|ring|damm|steig|graben|markt|tor)"
_BEFORE_DE = r"(?:(?:Obere|Untere|Alte|Neue|Grosse|Große|Kleine|Lange|Hintere|Vordere|Innere|Äussere)\s+)"
_ADDRESS_DE = re.compile(rf"(?:{_BEFORE_DE}?[A-ZÄÖÜ][\w-]*{_STREET_DE}|(?:{_BEFORE_DE}|(?:Am|An\s+der|An\s+den|Im|In\s+der|Zum|Zur|Beim|Auf\s+dem|Auf\s+der|Unter\s+den)\s+)[A-ZÄÖÜ][\w-]+)\s+\d{{1,4}}\s?[a-zA-Z]?\Z")
_ADDRESS_FR = re.compile(r"(?<![\w./-])\d{1,4}(?:\s?(?:bis|ter|quater|[A-D])\b)?,?\s+(?:rue|quai|avenue|allée|chemin|place|boulevard|impasse|cours|passage|ruelle|route|sentier|square|esplanade)\s[^,\n]{2,40}(?:\n[^,\n]{1,40})?\Z", re.I)
# All capital letters of the scripts that have them.
_UPPER = "".join(chr(i) for i in [*range(0x41, 0x590), *range(0x1E00, 0x2000)] if unicodedata.category(chr(i)) == "Lu")
_CAPITAL = re.compile(rf"[{_UPPER}][\w'’-]*")
_WITH = re.compile(r"(?:,\s+|,?\s+(?:and|und|et|sowie)\s+)\Z")
_WITH_AFTER = re.compile(r"(?:,\s+|,?\s+(?:and|und|et|sowie)\s+)")
_ROLES, _DEEDS = {w.casefold() for w in ROLES}, {w.casefold() for w in DEEDS}
_BLANK = {" ", "\n"}
_NEXT_WORD = re.compile(r"[ \t]?\n?[ \t]{0,2}(\w+)")
_FIRM = re.compile(r"\s*&|\s+(?:Ltd|AG|GmbH|SA|plc|PLC|LLP|Co|Inc|SE|KG|OHG|SARL|Sàrl|Limited|Company|Sons|Partners?)\b|\s+(?:and|et|und)\s+(?:Sons|Partners?|Söhne|Fils)\b")
_GAP = re.compile(rf"[ \t]?\n?[ \t]{{0,2}}(?:(?:{'|'.join(PARTICLES)})\s){{0,3}}\Z")
_FR = re.compile(r"\b(?:la|le|les|que|du|des|est|dans|une)\b")
_EN_DE = re.compile(r"\b(?:the|of|and|der|die|das|und|nicht)\b")


_DOTS, _ATS = (" dot ", " DOT ", "\ndot ", " dot\n", " punkt ", " point ", "\npoint ", " point\n"), (" at ", " at\n", "\nat ", " AT ", "arobase")


def _back(t: str, a: int, signs: int) -> int:
    """Where the ``signs`` signs before ``a`` begin, blanks not counted."""
    b, want = a, signs
    while b > 0 and want > 0:
        step = max(0, b - want)
        b, want = step, signs - len("".join(t[step:a].split()))
    return b


def _spans(t: str) -> list[tuple[int, int, str]]:
    """Contacts and numbers: no two overlap, the earlier kind wins."""
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))

    if "@" in t or "(at" in t or "[at" in t or "(AT" in t or "[AT" in t or "(ät" in t or "(At" in t:
        for m in _AT_SIGN.finditer(t):
            b = m.start() - (m.start() > 0 and t[m.start() - 1].isspace())
            a = b
            while a and (t[a - 1].isalnum() or t[a - 1] in "_.+-"):
                a -= 1
            if a < b and (d := _DOMAIN.match(t, m.end())):
                add(a, d.end(), "email")
    if any(x in t for x in _DOTS) and any(x in t for x in _ATS):
        for m in _WRITTEN.finditer(t):
            add(m.start(), m.end(), "email")
    phones: list[tuple[int, int]] = []
    for m in _CLUSTER.finditer(t):
        a, b = m.span()
        if sum(map(str.isdigit, m.group())) < 6:
            continue
        # a sign before the first digit belongs to the number
        plain = not (a and t[a - 1] in "+(")
        a -= not plain
        before = t[_back(t, a, 56) : a]
        low = before.lower()
        if plain and any(x in low for x in _ID_STEMS) and (k := _ID_BEFORE.search(before)) and (v := _ID_VALUE.match(t, a - len(k[1]))) and sum(map(str.isdigit, v.group())) >= 6:
            add(v.start(), v.end(), "id_number")
        elif not before.rstrip().endswith(_REFERENCES):
            # a shape may begin with letters that stand before the cluster
            for v in _ID_SHAPE.finditer(t, max(0, a - 5), min(len(t), b + 2)):
                add(v.start(), v.end(), "id_number")
            phones += [v.span() for v in _PHONE.finditer(t, a, b) if 9 <= sum(map(str.isdigit, v.group())) <= 15 and not _DATE.match(v.group())]
    for a, b in phones:
        add(a, b, "phone")
    for m in _NUMBER_CAPITAL.finditer(t):
        a = m.start()
        while a and t[a - 1].isdigit():
            a -= 1
        if (a == 0 or not (t[a - 1].isalnum() or t[a - 1] in "_.-")) and (v := _STREET_EN.match(t, a)):
            add(_BEFORE_EN.search(t, _back(t, a, 32), a).start(), v.end() - 1, "address")
    for m in _POSTCODE.finditer(t):
        for rx in (_ADDRESS_DE, _ADDRESS_FR):
            if v := rx.search(t, _back(t, m.start(), 100), m.start()):
                add(v.start(), m.end() - 1, "address")
                break
    return out


def find(t: str) -> list[tuple[int, int, str, tuple[tuple[str, str], ...]]]:
    """Mentions of a text: start, end, kind and, for a name, its parts as (type, value); types: given, initial, surname."""
    spans = _spans(t)
    taken = sorted(spans)
    names: list[tuple[int, int, str, tuple]] = []
    caps = [(m.start(), m.end(), m.group()) for m in _CAPITAL.finditer(t)]
    low = [c[2].casefold() for c in caps]
    french: bool | None = None

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    def near(k: int, sign: str = "") -> bool:
        """Token k + 1 follows token k after ``sign`` and at most one line break."""
        if k + 1 >= len(caps):
            return False
        gap = t[caps[k][1] : caps[k + 1][0]]
        if not sign and gap in _BLANK:
            return True
        return gap.startswith(sign) and len(gap) > len(sign) and _GAP.match(gap, len(sign)) is not None

    def surname(k: int) -> bool:
        a, b, w = caps[k]
        if len(w) < 2 or low[k] in NO_SURNAME or low[k] in TITLES or low[k] in GENDER or not free(a, b) or (not w.isupper() and not w[1:].islower() and "-" not in w and "'" not in w and "’" not in w):
            return False
        return f" {low[k]} " not in t and _FIRM.match(t, b) is None

    k = 0
    while k < len(caps):
        a, b, w = caps[k]
        g = low[k]
        parts: list[tuple[str, str]] = []
        end = None
        if (g in GENDER or g.split("-")[0] in GENDER) and len(w) > 2 and (w.isupper() or all(x[1:].islower() for x in w.split("-"))) and free(a, b):
            j, parts = k, [("given", w)]
            while near(j) and low[j + 1] in GENDER and not surname(j + 1):
                j += 1
                parts.append(("given", caps[j][2]))
            while near(j) and len(caps[j + 1][2]) == 1 and t[caps[j + 1][1] : caps[j + 1][1] + 1] == ".":
                j += 1
                parts.append(("initial", caps[j][2]))
                if not near(j, "."):
                    break
            sign = "." if len(caps[j][2]) == 1 else ""
            if near(j, sign) and surname(j + 1):
                j += 1
                parts.append(("surname", caps[j][2]))
                end = j
        elif len(w) == 1 and near(k, ".") and t[a - 1 : a] not in (".", "-"):
            j, parts = k, [("initial", w)]
            while near(j, ".") and len(caps[j + 1][2]) == 1 and t[caps[j + 1][1] : caps[j + 1][1] + 1] == ".":
                j += 1
                parts.append(("initial", caps[j][2]))
            if near(j, ".") and surname(j + 1):
                j += 1
                parts.append(("surname", caps[j][2]))
                if w == "M" and len(parts) == 2:
                    if french is None:
                        french = len(_FR.findall(t)) > len(_EN_DE.findall(t))
                    if french:
                        a, parts = caps[j][0], parts[1:]
                elif w == "M" and french is None and len(parts) == 3:
                    french = len(_FR.findall(t)) > len(_EN_DE.findall(t))
                    if french:
                        a, parts = caps[k + 1][0], parts[1:]
                end = j
        elif g in TITLES and (near(k) or near(k, ".")) and low[k + 1] not in GENDER and len(caps[k + 1][2]) > 1 and low[k + 1] not in TITLES:
            if surname(k + 1):
                a, end, parts = caps[k + 1][0], k + 1, [("surname", caps[k + 1][2])]
                if k + 2 < len(caps) and t[caps[end][1] : caps[k + 2][0]] == " " and surname(k + 2):
                    end, parts = k + 2, [("given", caps[k + 1][2]), ("surname", caps[k + 2][2])]
        if end is None and t[b : b + 1] == "," and near(k, ",") and low[k + 1] in GENDER and surname(k) and free(caps[k + 1][0], caps[k + 1][1]):
            j = k + 1
            # "Place, Given Surname" is no name turned round
            if not (near(j) and surname(j + 1)):
                a, parts, end = caps[k][0], [("surname", w), ("given", caps[j][2])], j
        if end is None:
            k += 1
            continue
        # "Surname, Given" after a title or alone, if the pair's given name does not start a name of its own
        if parts and parts[-1][0] == "surname" and len(parts) == 1 and near(end, ",") and low[end + 1] in GENDER and not (near(end + 1) and surname(end + 1 + 1)):
            end += 1
            parts.append(("given", caps[end][2]))
        names.append((a, caps[end][1], "name", tuple(parts)))
        k = end + 1
    if len(caps) > 1:
        names += _evident(t, caps, low, names, near, surname)
    return sorted([(a, b, kind, ()) for a, b, kind in spans] + names)


def _foreign(w: str) -> bool:
    return not any(c < "\u0250" or "\u1e00" <= c <= "\u1eff" for c in w if c.isalpha())


def _evident(t: str, caps: list[tuple[int, int, str]], low: list[str], names: list[tuple], near, surname) -> list[tuple]:
    """Full names that no list or title shows, by what stands around them: a role or a deed of persons, a surname shown in the same text, another
    script than the text's, or a row with a name."""
    # two capitals and no third: longer rows are titles of things
    joined = [t[x[1] : y[0]] in _BLANK for x, y in zip(caps, caps[1:])] + [False]
    pairs = [k for k in range(len(caps) - 1) if joined[k] and not joined[k + 1] and not (k and joined[k - 1] and low[k - 1] not in _ROLES) and low[k] not in _ROLES and low[k + 1] not in _ROLES]
    if not pairs:
        return []
    shown = {v.casefold() for *_, parts in names for kind, v in parts if kind == "surname" and len(v) > 2}
    starts, ends = {a for a, *_ in names}, {b for _, b, *_ in names}
    foreign = any(_foreign(caps[k][2]) for k in pairs) and sum("a" <= c <= "z" for c in t) > len(t) / 3
    out: list[tuple] = []
    left = []

    def accept(k: int) -> bool:
        a, b = caps[k][0], caps[k + 1][1]
        if len(caps[k][2]) < 2 or any(x < b and a < y for x, y, *_ in names) or not (surname(k) and surname(k + 1)):
            return False
        starts.add(a)
        ends.add(b)
        shown.add(low[k + 1])
        out.append((a, b, "name", (("given", caps[k][2]), ("surname", caps[k + 1][2]))))
        return True

    for k in pairs:
        a, b = caps[k][0], caps[k + 1][1]
        part = t[max(0, a - 40) : a]
        head = part.rstrip()
        before = head[max(head.rfind(" "), head.rfind("\n")) + 1 :].rstrip(",").casefold() if part.count("\n", len(head)) < 2 else ""
        after = m[1].casefold() if (m := _NEXT_WORD.match(t, b)) else ""
        sure = low[k + 1] in shown or before in _ROLES or before in _DEEDS or after in _DEEDS or (foreign and _foreign(caps[k][2]) and _foreign(caps[k + 1][2]))
        if not (sure and accept(k)):
            left.append(k)
    if left and ends:
        for row in (left, left[::-1]):
            for k in row:
                a, b = caps[k][0], caps[k + 1][1]
                m, n = _WITH.search(t, max(0, a - 12), a), _WITH_AFTER.match(t, b)
                if a not in starts and (low[k + 1] in shown or (m and m.start() in ends) or (n and n.end() in starts)):
                    accept(k)
    return out


# Written-out signs of an address of mail.
_AT = re.compile(r"\s*[\[(]\s*(?:at|ät|arobase)\s*[\])]\s*|\s+(?:at|arobase)\s+|\s?@\s?", re.I)
_DOT = re.compile(r"\s*[\[(]\s*(?:dot|punkt|point)\s*[\])]\s*|\s+(?:dot|punkt|point)\s+|\.", re.I)
#: Digits from the end by which two spellings of a telephone number are the same: with or without country code and its zero.
NATIONAL = 9


def normal(kind: str, text: str) -> str:
    """The value that a mention stands for, whatever its spelling."""
    v = " ".join(text.split()).casefold()
    if kind == "email":
        local, at, domain = _AT.sub("@", v).partition("@")
        return _DOT.sub(".", local) + at + _DOT.sub(".", domain)
    if kind == "phone":
        return re.sub(r"\D", "", v.replace("(0)", ""))[-NATIONAL:]
    if kind == "id_number":
        return "".join(c for c in v if c.isalnum())
    return v


_FOUND = "doc_id bigint, text_id bigint, kind string, start_pos int, end_pos int, shown string, parts array<struct<type:string,value:string>>"
_PARTS = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())]))


def _find_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], [], [], []]
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            for a, e, kind, parts in find(t) if t else ():
                for c, v in zip(cols, (i, h, kind, a, e, t[a:e], [{"type": x, "value": v.casefold()} for x, v in parts] or [{"type": kind, "value": normal(kind, t[a:e])}])):
                    c.append(v)
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), _PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types)], names=["doc_id", "text_id", "kind", "start_pos", "end_pos", "shown", "parts"])


def mentions(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_id, kind, start_pos, end_pos, shown, parts)`` of every mention, ``text_id`` being the text's hash: rows of one id may differ
    in text.

    Null and empty texts have none; repeated rows repeat their mentions. A map over whole texts; other columns are not looked at.
    """
    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")).mapInArrow(_find_all, _FOUND)


_ONSET = "b br d dr f g gr h k kl l m n p pl r s st t tr v w z".split()
_VOWEL = "a e i o u".split()
_CODA = "l m n r s rd ld nt rn lm".split()
# How the letters of a made-up name are written in the scripts that have letters for them.
SCRIPTS = {
    "CYRILLIC": dict(zip("abdefghiklmnoprstuvwyz", "абдефгхиклмнопрстувшыз")),
    "GREEK": dict(zip("abdefghiklmnoprstuvwyz", "αβδεφγχικλμνοπρστυβωηζ")),
}
_WORDS_KEPT = re.compile(rf"(?:{_STREET}|flat|unit|apt|apartment|suite|no|rue|quai|avenue|allée|chemin|boulevard|impasse|cours|passage|ruelle|route|sentier|esplanade|bis|ter|quater|am|an|im|in|zum|zur|beim|auf|unter|der|den|dem|de|la|le|les|des|du|d|obere|untere|alte|neue|lange|d-?)\.?,?", re.I)
_STREET_END = re.compile(rf"{_STREET_DE},?\Z", re.I)
#: How often a value may draw a surrogate before its digest is written out.
DRAWS = 4


def _digest(key: bytes, *what: str) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(what).encode(), hashlib.blake2b).digest()[:16], "big")


def _syllables(n: int, count: int) -> str:
    out = []
    for _ in range(count):
        n, a = divmod(n, len(_ONSET))
        n, b = divmod(n, len(_VOWEL))
        n, c = divmod(n, len(_CODA))
        out.append(_ONSET[a] + _VOWEL[b] + _CODA[c])
    return "".join(out)


def _script(value: str) -> str:
    return next((unicodedata.name(c, "LATIN").split()[0] for c in value if c.isalpha()), "LATIN")


def _in_script(name: str, like: str, key: bytes) -> str:
    """A made-up Latin name in the script of ``like``: by letters where the script has them, else other signs of its own block in its places."""
    script = _script(like)
    if script == "LATIN":
        return name
    if script in SCRIPTS:
        return "".join(SCRIPTS[script].get(c, c) for c in name)
    out = []
    for i, c in enumerate(like):
        block = [x for x in map(chr, range(ord(c) & ~0x3F, (ord(c) | 0x3F) + 1)) if x.isalpha()]
        out.append(block[_digest(key, name, str(i)) % len(block)] if c.isalpha() and block else c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, draw: int = 0) -> str:
    """A keyed stand-in of the same type, the ``draw``-th of its value: given names keep their gender (and start with one letter for one initial),
    names their script and hyphens, numbers their places of digits and letters, mail its number of words and addresses their words of place, street
    types and lengths of numbers."""
    again = (str(draw),) if draw else ()
    h = _digest(key, kind, value, *again)
    letter = lambda c: chr(97 + _digest(key, "initial", c) % 26)
    if kind == "initial":
        return _in_script(letter(value[:1]), value, key)
    if kind == "given":
        first, *more = value.split("-")
        gender = GENDER.get(value) or GENDER.get(first)
        name = letter(first[:1]) + "aeiou"[h % 5] + _syllables(h >> 3, 1 + draw) + ("a" if gender == "f" else "o" if gender == "m" else "y")
        return _in_script("-".join([name, *[_syllables(_digest(key, kind, m), 1) for m in more]]), value, key)
    if kind == "surname":
        return _in_script("-".join(_syllables(_digest(key, kind, v, *again), 2 + draw) for v in value.split("-")), value, key)
    if kind == "email":
        local, _, domain = value.partition("@")
        words = [_syllables(_digest(key, kind, value, str(i), *again), 1 + (i == 0) + draw) if w.isalnum() else w for i, w in enumerate(re.split(r"([._+-]+)", local))]
        return "".join(words) + "@" + ".".join([*[_syllables(_digest(key, "domain", x), 2) for x in domain.split(".")[:-1]], "invalid"])
    if kind == "address":
        out = []
        for i, w in enumerate(value.split(" ")):
            tail = w[len(w.rstrip(",.")) :]
            core = w[: len(w) - len(tail)] if tail else w
            if any(c.isdigit() for c in core):
                core = "".join(str(_digest(key, kind, value, str(i), str(j), *again) % 9 + 1) if c.isdigit() else c for j, c in enumerate(core))
            elif not _WORDS_KEPT.fullmatch(w):
                end = m.group() if (m := _STREET_END.search(core)) and m.start() else ""
                core = "-".join(_syllables(_digest(key, "place", x, *again), 2) for x in core[: len(core) - len(end)].split("-")) + end
            out.append(core + tail)
        return " ".join(out)
    out = []
    for i, c in enumerate(value):
        r = _digest(key, kind, value, str(i), *again)
        out.append(str(r % 10) if c.isdigit() else chr(97 + r % 26) if c.isalpha() else c)
    return "".join(out)


def _cased(new: str, like: str) -> str:
    """``new`` in the case of ``like``; every part of a hyphenated name is capital."""
    if len(like) > 1 and like.isupper():
        return new.upper()
    return "-".join(x[:1].upper() + x[1:] for x in new.split("-")) if like[:1].isupper() else new


def rendered(kind: str, shown: str, parts: list[str]) -> str:
    """A mention's surrogates in the form it was written in."""
    if kind == "name":
        it = iter(parts)
        return _CAPITAL.sub(lambda m: _cased(next(it, ""), m.group()), shown)
    (new,) = parts
    if kind == "email":
        at = _AT.search(shown)
        local, _, domain = new.partition("@")
        dot = _DOT.search(shown, at.end()) if at else None
        return local + (at.group() if at else "@") + domain.replace(".", dot.group() if dot else ".")
    if kind == "phone":
        # what stands before the national digits, the country's code or a zero, stays
        digits = [i for i, c in enumerate(shown) if c.isdigit() and not shown.startswith("(0)", max(i - 1, 0))][-len(new) :]
        out = list(shown)
        for i, c in zip(digits, new[-len(digits) :]):
            out[i] = c
        return "".join(out)
    if kind == "id_number":
        it = iter(new)
        return "".join((next(it, c).upper() if c.isupper() else next(it, c)) if c.isalnum() else c for c in shown)
    words = new.split(" ")
    return " ".join(_cased(n, o) for n, o in zip(words, shown.split()))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``(type, value, surrogate)``: one row for each distinct part of the mentions; no two values of a type have one surrogate, and no surrogate is
    itself a value of the type.

    A value draws from its own digests, not from its place among the others. Those whose draw is met by another's, taken or a real value draw
    again. Initials are few letters and may meet, as they do in the text.
    """
    secret = key.encode()

    def draw(k: int):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t, v = b.column(0).to_pylist(), b.column(1).to_pylist()
                out = [surrogate(secret, x, y, k) if k < DRAWS else f"{surrogate(secret, x, y)}-{_digest(secret, x, y):032x}" for x, y in zip(t, v)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["type", "value", "s"])

        return make

    parts = materialise(found.select(F.explode("parts").alias("p")).select("p.type", "p.value").distinct())
    left = parts.filter("type != 'initial'")
    done = parts.filter("type = 'initial'").mapInArrow(draw(0), "type string, value string, surrogate string")
    none = F.lit(None).cast("string")
    taken = left.select("type", F.col("value").alias("s"), none.alias("value"))
    for k in range(DRAWS):
        drawn = left.mapInArrow(draw(k), "type string, value string, s string").select("type", "s", "value")
        met = drawn.unionByName(taken).groupBy("type", "s").agg(F.count("*").alias("n"), F.max("value").alias("value"))
        won = materialise(met.filter("n = 1 and value is not null").select("type", "value", F.col("s").alias("surrogate")))
        done = done.unionByName(won)
        left = materialise(left.join(won.select("type", "value"), ["type", "value"], "left_anti"))
        if left.isEmpty():
            return done
        taken = taken.unionByName(won.select("type", F.col("surrogate").alias("s"), none.alias("value")))
    return done.unionByName(left.mapInArrow(draw(DRAWS), "type string, value string, surrogate string"))


def pseudonymised(documents: DataFrame, key: str) -> DataFrame:
    """``(doc_id, text_id, kind, start_pos, end_pos, placeholder)``: every mention with its typed placeholder, e.g. ``[NAME Lera Dorn]``.

    ``key`` is the secret of the surrogates: with another key all of them change. A mention's parts meet their surrogates in a join on the
    value, where AQE splits a value that is frequent, and are put together again per mention, in the form the mention was written in.
    """
    found = materialise(mentions(documents))
    table = surrogates(found, key)
    at = ["doc_id", "text_id", "kind", "start_pos", "end_pos", "shown"]
    long = found.select(*at, F.posexplode("parts").alias("_i", "_p")).select(*at, "_i", F.col("_p.type").alias("type"), F.col("_p.value").alias("value"))
    whole = long.join(table, ["type", "value"]).groupBy(*at).agg(F.transform(F.array_sort(F.collect_set(F.struct("_i", "surrogate"))), lambda x: x["surrogate"]).alias("s"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f"[{k.upper()} {rendered(k, t, s)}]" for k, t, s in zip(b.column(2).to_pylist(), b.column(5).to_pylist(), b.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.string())], names=[*at[:5], "placeholder"])

    return whole.mapInArrow(write, "doc_id bigint, text_id bigint, kind string, start_pos int, end_pos int, placeholder string")


def redacted(documents: DataFrame, key: str) -> DataFrame:
    """``(doc_id, text)``: the texts with every mention replaced by its placeholder and nothing else changed; null texts stay null."""
    marks = pseudonymised(documents, key).groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "placeholder"))).alias("m")).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), "m")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, ms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t and ms:
                    parts, at = [], 0
                    for m in ms:
                        parts += [t[at : m["start_pos"]], m["placeholder"]]
                        at = m["end_pos"]
                    t = "".join([*parts, t[at:]])
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    d = d.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left").select("doc_id", "text", "m")
    return d.mapInArrow(write, "doc_id bigint, text string")
