"""Sentence units of texts in many languages by cascading tables of break and no-break rules.

A rule is (breaks, before, after): `before` must match the text that ends at a position, `after` the text that begins
there. The tables of a language are tried in order, first its own, then those of its script, then the general one;
the first rule that matches decides the position. Two cascades run one after the other: LAYOUT decides which lines
stand alone, the language's cascade each place inside running prose that ends with closing punctuation. A place between
paired marks is asked the table PAIRED first. Most places of the Latin script follow a word that no exception names; they
are answered without trying the tables, as the general rule of their last table would. A blank line always breaks.
Lines of reports (headings, list items, table rows, 'label: value') are units of their own and aren't broken inside.

Offsets count code points, the end is exclusive, units carry no surrounding white space and cover all else. Defined
results: null, empty and blank texts give no unit; text without any rule's place is one unit; every row gives its units,
repeated rows too; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.sources.tables import read

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶĹŁŃŇŐŘŚŞŠŢŤŪŮŰŹŻŽА-ЯЁ"
LOW = "a-zß-öø-ÿāăąćčďđēęěğģīķĺłńňőřśşšţťūůűźżžа-яё"
OPEN, CLOSE = "\"'“„«‹‘「『（(\\[¿¡", "\"'”“’»›」』）)\\]"

# Abbreviations after which a sentence goes on whatever follows; after NUMBERED only before a digit,
# after SOFT only before a small letter or a digit. Words that are words by themselves stand in the last two.
ALWAYS = {
    "en": "Dr Mr Mrs Ms Prof St Fig Figs cf approx esp vs viz incl Rev Hon Capt Sgt dept Dept",
    "de": "Dr med Prof Hr Fr Frau bzw ca z d u o Tel tel Str str Nr nr vgl Abs evtl ggf inkl usw St Pat tgl geb Mio Abb",
    "fr": "Dr Pr Mme Mlle MM M env cf c-à-d p ex tél Tél bd av St Ste art fig Fig chap éd",
    "es": "St Sta Sto Dr Dra Sr Sra Srta Prof Lic aprox p ej pág Avda núm tel Tel Ud Uds",
    "ru": "т е д г ул кв р ч мин им стр рис тел обл пер проф др руб коп п пр напр",
    "hi": "डॉ मि.ग्रा मि ग्रा श्री प्रो कि",
    "ar": "د أ م",
}
NUMBERED = {"en": "No no Nos nos Apt apt Rm pp p vol Vol Art sec Sec fig Jan Feb Mar Apr May Jun Jul Aug Sep Sept Oct Nov Dec", "de": "S Kap", "fr": "n art janv févr avr juil sept oct nov déc", "es": "n art pág ene feb mar abr may jun jul ago sep oct nov dic", "ru": "№ с"}
SOFT = {"en": "sat Sat sec Sec resp Resp temp Temp est Est ref Ref tel Tel ca al ext Gen fig etc Jr Sr Inc Ltd Co a.m p.m b.i.d t.i.d q.i.d q.d q.h.s p.r.n i.v U.S U.K M.D Ph.D e.g i.e", "de": "usw etc", "fr": "etc", "es": "etc m"}


#: Those of them that a value may follow.
MEASURES = "sat Sat resp Resp temp Temp est Est ref Ref tel Tel ca ext"


def _words(s: str) -> str:
    return "|".join(sorted(map(re.escape, s.split()), key=len, reverse=True))


def _table(lang: str) -> list[tuple[bool, str, str]]:
    """The exceptions of one language."""
    rules = [(False, rf"(?:^|[^\w.-])(?:{_words(ALWAYS[lang])})\.", r"\s*")]
    if lang in NUMBERED:
        rules.append((False, rf"(?:^|[^\w.-])(?:{_words(NUMBERED[lang])})\.", r"\s*\d"))
    if lang in SOFT:
        rules.append((False, rf"(?:^|[^\w.-])(?:{_words(SOFT[lang])})\.", rf"\s*[{LOW},;:)]"))
        rules.append((False, rf"(?:^|[^\w.-])(?:{_words(MEASURES)})\.", r"\s*\d"))
    return rules


#: Cascading tables; each language names the tables that are tried in turn.
TABLES: dict[str, list[tuple[bool, str, str]]] = {x: _table(x) for x in ALWAYS} | {
    "de-ordinals": [(False, r"(?:^|[\s(])\d{1,2}\.", r"\s+[A-ZÄÖÜ]")],
    "addresses": [  # nothing ends inside an e-mail address, however it is spelled
        (False, r"@\s?[\w.-]*\.", r"[a-z]"),
        (False, r"@\s?[A-Z\d.-]*\.", r"[A-Z]{2}"),
        (True, r"@\s?[A-Z\d.-]*[A-Z]\.", r"[A-Z][a-z ]"),
        (False, r"[\w+-]\.", r"[\w.+-]*\w\s?(?:@|[\[({][Aa][Tt][\])}])|[\w.+-]+\s(?:AT\s|at\s\S+\sdot\s|[\[(]at)"),
    ],
    "latin": [
        (False, r"(?:^|[^\w.])[a-z]\.(?:\s?[a-z]\.)*", rf"\s*[{LOW}(,\d]"),  # i.e. / p. m. before a small letter
        (False, rf"(?:^|[\s(\"'“„«-])(?<!\d\s)(?<!\d)(?<!°\s)(?<!deg\s)[{UP}]\.(?:[ -]?[{UP}]\.)*", rf"\s*(?:[{UP}'’-]?[{LOW}{UP}'’-]+|[{UP}]\.|[(,;:])"),  # initials
        (False, rf"[.!?…][{CLOSE}]+", rf"\s+(?:[{LOW}]|[,;:–—-])"),  # a quotation inside a sentence
        (False, r"\.\.\.|…", rf"\s*[{LOW}]"),
        (True, rf"[.!?…][{CLOSE}]*", r"\s"),
        (True, rf"(?:[{LOW}]{{2}}|\d|[)”»\"])[.!?]", rf"[{UP}][{LOW} ]"),  # the blank is missing
        (True, r"(?:^|\s)[A-Za-z(),;-]{3,}\.", r"[a-z]{2,}[ ,;]"),
    ],
    "cyrillic": [
        (False, rf"(?:^|[\s(])[{UP}]\.", r"\s*[а-яёА-ЯЁ]"),
        (False, rf"[.!?…][{CLOSE}]+", r"\s*[,–—-]"),
    ],
    "cjk": [
        (False, rf"[。！？｡!?][{CLOSE}]+", r"[^\s]"),  # 「…。」と
        (True, rf"[。！？｡][{CLOSE}]*", r""),
        (True, rf"[!?][{CLOSE}]*", r"\s*[^\s\w]?[぀-ヿ一-鿿]"),
    ],
    "thai": [(True, r"\S", r"\s+[ก-ฮเ-ไ]")],
    "danda": [(True, rf"[।॥?!][{CLOSE}]*", r"\s|$|[ऄ-ह]")],
    "arabic": [(True, rf"[؟!.۔][{CLOSE}]*", r"\s+|[ء-ي]{2}")],
}
LATIN = ["en", "de", "fr", "es"]
CASCADES = {
    "en": ["en", "addresses", "latin"], "de": ["de", "de-ordinals", "addresses", "latin"], "fr": ["fr", "addresses", "latin"], "es": ["es", "addresses", "latin"],
    "ru": ["ru", "cyrillic", "en", "addresses", "latin"],
    "zh": ["cjk", "addresses", "latin"], "ja": ["cjk", "addresses", "latin"], "th": ["thai", "addresses", "latin"], "hi": ["hi", "danda", "addresses", "latin"], "ar": ["ar", "arabic", "addresses", "latin"],
}
#: A text of the Latin script whose language is uncertain is asked all of its languages' tables, the likeliest first.
UNCERTAIN = {x: [x, *(["de-ordinals"] if x == "de" else []), *(y for y in LATIN if y != x), "addresses", "latin"] for x in LATIN}
#: Where the rules are asked; any other position is no break.
PLACES = {
    "thai": re.compile(r"(?:[^\S\n]+\n?|\n)(?=[^\S\n]*[ก-ฮเ-ไ])|[.!?…]+(?=\s)"),
    "cjk": re.compile(r"[.!?…。！？｡]+[\"'”’」』）)»]*"),
    "": re.compile(rf"[.!?…।॥؟۔]+[{CLOSE}]*"),
}
#: The first table of every cascade: marks that come in pairs, as before and after of the whole quotation; a place between
#: the two marks is no break. A plain mark opens only where no letter or digit stands before it, so an inch mark is none.
PAIRED = re.compile(r"(?<!\w)\"(?=\S)[^\"]*\"(?!\w)|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]")

HEADING = rf"(?:[{UP}][{UP}\d &,'’./-]*[{UP}]|[^.!?。！？]{{1,40}}[:：])"
LABEL = rf"[{UP}][\w ./'’-]{{0,30}}[:：]\s+(?:(?!(?:[{LOW}\d]{{2,}}|\))[.!?](?:\s|$)).)+"
ROW = r".*?\S(?:\s{3,}|\s*\t\s*)\S.*"
BULLET = r"(?:[-*•–]|\d{1,2}[.)]|[a-z]\))\s+\S.*"
RULE = r"[-=_*—–]+"
#: The cascade of lines: (alone, where, pattern). The first rule whose pattern is the whole line decides whether it is a
#: unit of its own; rules for 'top' hold only at a block's start or below a line that is one.
LAYOUT = [
    (True, "any", RULE), (True, "any", r"[-*•]\s+\S.*"), (True, "any", ROW),
    (True, "top", HEADING), (True, "top", LABEL), (True, "top", BULLET),
    (False, "any", r".*"),
]
_LAYOUT = [(alone, where == "top", re.compile(pattern)) for alone, where, pattern in LAYOUT]


def stands_alone(line: str, on_top: bool) -> bool:
    """What the first matching rule says of a line."""
    return next((alone for alone, top, rx in _LAYOUT if (on_top or not top) and rx.fullmatch(line)), False)


#: A line with the next line's first word that is longer than this was wrapped.
WRAP = 60
LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_COMPILED: dict[str, list[tuple[bool, re.Pattern, re.Pattern]]] = {}
REACH = 40  # characters before a place that a rule looks at
# Frequent words by which languages of the Latin script are told apart.
FREQUENT = {
    "en": (" the ", " of ", " and ", " was ", " is ", " for ", " to ", " my "),
    "de": (" der ", " die ", " und ", " ist ", " wurde ", " mit ", " auf ", " den "),
    "fr": (" le ", " la ", " les ", " est ", " une ", " des ", " au ", " par "),
    "es": (" el ", " la ", " los ", " es ", " una ", " del ", " con ", " su "),
}
_SCRIPT = re.compile(r"([ก-๛]+)|([ऄ-ॿ]+)|([ء-ۿ]+)|([А-я]+)|([぀-ヿ]+)|([一-鿿]+)")

#: Words of two letters or more that some rule of the Latin script names, for the common case without one.
NAMED = {w for t in (ALWAYS, NUMBERED, SOFT) for s in t.values() for w in s.split()}


def language(text: str) -> str:
    """The language whose rules fit a text: by script where that tells it, else by frequent words."""
    if not text.isascii():
        counts = [0] * 7
        for m in _SCRIPT.finditer(text):
            counts[m.lastindex] += m.end() - m.start()
        if sum(counts) * 5 > len(text) // 2 or sum(counts) > 20:
            counts[6] += counts[5]
            if counts[5] * 20 > counts[6] > 0 and max(counts[1:5]) < counts[6]:
                return "ja"
            return ("", "th", "hi", "ar", "ru", "ja", "zh")[max(range(1, 7), key=counts.__getitem__)]
    text = text.replace("\n", " ").replace("\xa0", " ")
    return max(FREQUENT, key=lambda x: sum(map(text.count, FREQUENT[x])))


def certain(text: str, lang: str) -> bool:
    """Whether a text of the Latin script has three times as many frequent words of its language as of any other."""
    text = text.replace("\n", " ").replace("\xa0", " ")
    n = {x: sum(map(text.count, FREQUENT[x])) for x in FREQUENT}
    return n.pop(lang) > 3 * max(n.values())


def cascade(lang: str, sure: bool = True) -> list[tuple[bool, re.Pattern, re.Pattern]]:
    key = lang if sure or lang not in UNCERTAIN else f"{lang}?"
    if key not in _COMPILED:
        _COMPILED[key] = [(b, re.compile(rf"(?:{before})\Z"), re.compile(after)) for t in (CASCADES[lang] if key == lang else UNCERTAIN[lang]) for b, before, after in TABLES[t]]
    return _COMPILED[key]


def breaks(text: str, pos: int, rules: list[tuple[bool, re.Pattern, re.Pattern]], latin: bool = False, since: int = 0) -> bool:
    """What the first matching rule says of a position in a unit that began at `since`."""
    if latin and text[pos - 1] == "." and text[pos].isspace():
        # Before a single full stop a word that no exception names always ends a sentence of the Latin script.
        k = pos - 2
        while k >= since and pos - k < 12 and text[k].isalpha():
            k -= 1
        if pos - 2 - k >= 2 and (pos - k >= 12 or ((k < since or text[k] not in ".-") and text[k + 1 : pos - 1] not in NAMED)):
            return True
    # What `before` needs is bounded (no abbreviation or chain of initials needs more to match its last part), and '^'
    # matches only where the unit itself begins.
    head = text[since:pos] if pos - since <= REACH else None
    for b, before, after in rules:
        if after.match(text, pos) and (before.search(head) if head is not None else before.search(text, pos - REACH, pos)):
            return b
    return False


def _prose(text: str, start: int, end: int, lang: str, rules, out: list[tuple[int, int]]) -> None:
    """The sentences of a run of prose."""
    body = text[start:end]
    closed = [m.span() for m in PAIRED.finditer(body)]
    at, k = 0, 0
    for m in PLACES[{"th": "thai", "ja": "cjk", "zh": "cjk"}.get(lang, "")].finditer(body):
        p = m.start() if lang == "th" and m[0].isspace() else m.end()
        if p >= len(body):
            break
        while k < len(closed) and closed[k][1] < p:
            k += 1
        if k < len(closed) and closed[k][0] < p < closed[k][1]:
            continue
        if breaks(body, p, rules, lang in FREQUENT, at):
            _add(text, start + at, start + p, out)
            at = p
    _add(text, start + at, end, out)


def _add(text: str, s: int, e: int, out: list[tuple[int, int]]) -> None:
    t = text[s:e]
    left = len(t) - len(t.lstrip())
    t = t.strip()
    if t:
        out.append((s + left, s + left + len(t)))


def segment(text: str | None) -> list[tuple[int, int]]:
    """The units of a text in order."""
    out: list[tuple[int, int]] = []
    if not text or text.isspace():
        return out
    lang = language(text)
    rules = cascade(lang, lang not in UNCERTAIN or certain(text, lang))
    run = None  # start and end of the prose that goes on
    before, above, top = "", False, True  # the line before, whether it stands alone, whether a block begins
    at, size = 0, len(text)
    while at < size:
        m = LINE_END.search(text, at)
        end, nxt = (m.start(), m.end()) if m else (size, size)
        line = text[at:end].strip()
        if not line:
            if run:
                _prose(text, *run, lang, rules, out)
            run, top, above, before = None, True, False, ""
        else:
            alone = stands_alone(line, top or above)
            # A line that begins with a small letter goes on (not after one in capitals); any other only where its first word did not fit above.
            if run and (alone or ((not line[0].islower() or before.isupper()) and len(before) + 1 + len(line.split(None, 1)[0]) <= WRAP)):
                _prose(text, *run, lang, rules, out)
                run = None
            if alone:
                _add(text, at, end, out)
            else:
                run = (run[0] if run else at, end)
            before, above, top = line, alone, False
        at = nxt
    if run:
        _prose(text, *run, lang, rules, out)
    return out


def sentence_units(docs: DataFrame, label: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """label (doc_id, or another column), char_start, char_end of the units of a table with text, without a shuffle."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [segment(t) for t in b.column(1).to_pylist()]
            n = np.array([len(u) for u in units], np.int64)
            flat = np.array([x for u in units for x in u], np.int32).reshape(-1, 2)
            docs_ = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([docs_, pa.array(flat[:, 0]), pa.array(flat[:, 1])], [label, "char_start", "char_end"])

    return docs.select(F.col(label).cast(kind).alias(label), "text").where("text is not null").mapInArrow(rows, f"{label} {kind}, char_start int, char_end int")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(read(spark, sf_dir, "documents"))


def p9_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units of each length (in tens of characters) each language label has."""
    units = sentence_units(read(spark, sf_dir, "documents"), "lang", "string")
    return units.groupBy("lang", (F.floor((F.col("char_end") - F.col("char_start")) / 10) * 10).alias("length")).agg(F.count("*").alias("n"))


QUERIES = {"p9_found": p9_found, "p9_lengths": p9_lengths}
ORACLE: dict[str, str] = {}
