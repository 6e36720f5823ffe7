"""Personal information in free text, and keyed surrogates in its place.

Detection is a cascade over one text, without a shuffle: e-mail, address, identity number, phone, name; a later type
never takes what an earlier one holds. Names are found by their own shape (initials, 'surname, given name', a given
name of the lexicon) or by what stands around them (titles, labels, greetings, sign-offs, verbs of people); numbers by
shape and by the label in front of them, as the same digits may be an order or accession number.

Surrogates: every entity gets a replacement derived from a key by HMAC. Digits change to digits and letters to letters in the same places;
a name's parts change to made-up parts of the same script, case and gender ending, an initial to the initial
of the same key, so that 'D. Dormara' and 'Daniel Dormara' still go together. Equal entities get equal surrogates in the
whole corpus; surrogates that two entities would share are told apart by further attempts until all are distinct and
none equals an entity of the corpus (collision check), so distinct entities stay distinct.

Offsets count code points, the end is exclusive. Defined results: null, empty and blank texts give no mention and stay
as they are; repeated page rows give their mentions once; mentions of one type never overlap; empty tables give no row;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.sentences import language
from chartloom.session import written
from chartloom.sources.tables import read

# Given names by the gender that their bearers mostly have (f, m, u for either).
GIVEN = {
    "f": "Abigail Adaeze Agnieszka Alexandra Alice Amina Amélie Ana Ananya Anaïs Anna Antonia Astrid Barbara Begoña Chloé Christina Deborah Dolores Dorothy Elizabeth Emily Emma Fatima Gabriella Grace Greta Guadalupe Hannah Ifeoma Ingrid Isabella Jacqueline Jennifer Josephine Julia Karen Katherine Laura Leila Linda Lucía Ludmila Maeve Magdalena Margaret María Mary Mei Ngozi Niamh Noémie Oksana Olivia Patricia Penelope Priya Rebecca Renée Rosa Sakura Salome Sarah Sofia Solveig Sophie Susan Svetlana Theresa Veronica Victoria Virginia Xiomara Zofia Zoë",
    "m": "Ahmed Alexander Andrew Andrzej Andrés Anthony Arjun Benjamin Björn Carlos Charles Christopher Cormac Daniel David Declan Dmitri Edward Emeka Farid Francisco Frederick George Gregory Günther Hans Henry Hiroshi Ibrahim Idris Iñigo Ivan Jack James Johannes John Joseph Juan Jérôme Jörun Kenji Kevin Kofi Lars Lawrence Leonard Luis Luís Mark Mateus Matthew Matthias Michael Mohammed Nicholas Oliver Omar Oskar Paul Pavel Peter Raúl Renato Richard Robert Rohan Samuel Stefan Stellan Stephen Søren Tariq Theodore Thomas Tunde Walter William Yusuf Zachary Étienne",
    "u": "Alex Robin Sasha Wei Yuki",
}
GENDER = {w.lower(): g for g, s in GIVEN.items() for w in s.split()}
# Titles before a name, labels before a name, words after which a person is named.
TITLES = r"Drs?|Prof|Professor|Mr|Mrs|Ms|Miss|Mx|Herrn?|Frau|Mme|Mlle|Madame|Monsieur|Sra?|Dra|Srta|Lic|Nurse|Sister"
LABELS = r"Patient(?:in)?|Name|Ordering Physician|Physician|Attending|Referring|Re|Chapter editor|Editor|Author|Signed|Provider|Guarantor|Next of kin|Contact"
BEFORE = r"[Ss]igned by|presence of|for referring|[Ss]een by|kin is|phoned to|[Pp]ickup by|[Mm]y colleague|[Tt]his is|[Ww]ho is|went to|spoke to|informed|[Cc]all|[Dd]ear|[Hh]i|[Hh]ello"
CLOSINGS = r"[Yy]ours (?:sincerely|faithfully|truly)|(?:[Kk]ind|[Bb]est|[Ww]arm) (?:regards|wishes)|[Rr]egards|[Ss]incerely|[Tt]hanks(?: so much| again)?|[Tt]hank you|Mit freundlichen Grüßen|Cordialement|Bien à vous|Atentamente|Saludos|С уважением"
NOT_NAMES = set(
    "hospital clinic institute care practice services center centre laboratory diagnostics family regional community urgent heart pathology reference university department ward room street road lane north south east west "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday the this that there she he it we they you your our his her their who when what which why how please thank thanks dear no yes not and but for from with without copies mail lives levels doses skin temp "
    "medication medications result results report reports analyte units flag date dob mrn accession collected printed seen attending patient physician diagnosis plan assessment history".split()
)
AFTER = r"(?:Hospital|Clinic|Institute|Care|Practice|Services|Cent(?:er|re)|Laboratory|Diagnostics|Family|Regional|Community|Urgent|Heart|Pathology|Reference|University|Department|Ward|Hospice|Road|Street|Lane|Avenue)\b"
# Labels of identity numbers of persons.
ID_LABELS = (
    r"MRN|[Mm]edical record|[Pp]assport|PASSPORT|[Ii]nsurance card|[Ii]nsurance|[Mm]ember(?:ship)? id|[Mm]ember ID|[Hh]ealth plan|SSN|[Ss]ocial [Ss]ecurity|[Pp]ayer ID|[Pp]olicy|[Tt]ax ID|TIN|National ID|[Nn]ational id|Versichertennummer|Versichertennr|Steuer-ID|Sozialversicherungsnummer|Krankenkassennummer|Ausweisnummer|[Ss]écurité sociale|NIR|DNI|NIE|NIF|[Pp]asaporte|"
    r"[Пп]олис|ИНН|СНИЛС|[Пп]аспорт|保険証番号|被保険者番号|マイナンバー|身份证明?号码?|身份证|医保号|护照号?|आधार|बीमा|रقم الهوية|الهوية|بطاقة|บัตรประชาชน|เลขบัตร"
)
PHONE_CUE = re.compile(r"(?:tel|tél|phone|fax|call|ring|cell|mobile|contact|teléfono|телефон|फ़ोन|नंबर|هاتف|الهاتف|โทร|电话|電話|連絡先|联系)[^\d+]{0,24}$", re.I)

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČÇĎĐĒĘĚĞĢĪİĶĹŁŃŇŐŘŚŞŠŢŤŪŮŰŹŻŽ"
_L = r"[^\W\d_]"
_WS = r"(?:[ \t\u00a0\u2000-\u200a\u202f\u3000](?:\r?\n)?|\r?\n)"
_WORD = rf"(?:[{_UP}]['’])?[{_UP}]{_L}+(?:['’]{_L}{{2,}})?(?:-(?:{_L}['’])?{_L}{{2,}})*(?!['’]s\b)"
_PART = rf"(?:(?:de la|de las|de los|de|da|do|dos|du|van der|van den|van|von der|von|del|della|di|el|al|bin|ibn|DE LA|DE|DA|VAN DER|VAN|VON|St\.|ST\.|Ó){_WS})?"
_INIT = rf"(?<![\d°][ \u00a0])(?<![\d°])(?<!deg[ \u00a0])(?<!itamin )(?<!atitis )[{_UP}]\."
_SUR = rf"{_PART}{_WORD}"


def _any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, the longest first, by their common begins: one step a letter instead of one a word."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(c) + pattern(sub) for c, sub in sorted(at.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})"
        return body + ("?" if "" in at else "")

    return pattern(tree)


_NAMES = sorted({w for s in GIVEN.values() for w in s.split()})
_GIVEN = f"(?:{_any_of([*_NAMES, *map(str.upper, _NAMES)])})"
_GIVEN_LOW = f"(?:{_any_of(map(str.lower, _NAMES))})"
_DEGREE = r"(?!M\.\s?D\b|D\.\s?O\b|R\.\s?N\b|P\.\s?A\b|Ph\.\s?D\b|MD\b|RN\b|Jr\b|Sr\b|II)"
_COMMA = rf"{_SUR},{_WS}{_DEGREE}(?:{_WORD}|{_INIT})(?:{_WS}{_INIT})*(?![^\W_])"
_FULL = rf"(?:{_WORD}|{_INIT})(?:{_WS}{_INIT})*{_WS}{_SUR}"
_B = r"(?<![\w'’@-])"

NAME_RULES = [
    re.compile(rf"(?<!\w)(?:{TITLES})\b\.?(?:{_WS}med\.)?{_WS}(?P<n>{_SUR},{_WS}{_DEGREE}(?:(?:{_GIVEN})(?![^\W_])|{_INIT})(?:{_WS}{_INIT})*|{_FULL}|{_SUR})"),
    re.compile(rf"(?:^|(?<=[\s(]))(?:{LABELS})[ \t]*[:：][ \t]*(?P<n>{_COMMA}|{_FULL})", re.M),
    re.compile(rf"{_B}(?P<n>{_PART}{_WORD},{_WS}{_DEGREE}(?:(?:{_GIVEN})(?![^\W_])(?:{_WS}{_INIT})*|{_INIT}(?:{_WS}{_INIT})*))"),
    re.compile(rf"{_B}(?P<n>(?:{_GIVEN})(?:{_WS}(?:{_INIT}|{_GIVEN}))*{_WS}{_SUR})"),
    re.compile(rf"{_B}(?P<n>{_INIT}(?:{_WS}?{_INIT})*{_WS}{_SUR})"),
    re.compile(rf"(?<!\w)(?:{BEFORE}){_WS}(?P<n>{_FULL})"),
    re.compile(rf"(?<!\w)(?:(?:{TITLES})\b\.?|{BEFORE})(?:{_WS}med\.)?{_WS}(?P<n>{_GIVEN_LOW}{_WS}(?:[a-z]\.{_WS})?(?:(?:de la|da|van der|von|ó){_WS})?{_L}['’]?{_L}{{2,}}(?:-{_L}+)*)"),
    re.compile(rf"^(?:{CLOSINGS})[,.!]?\s+(?P<n>{_COMMA}|{_FULL}|{_WORD})[ \t\r\u00a0]*$", re.M),
    re.compile(rf"(?<!\w)[Tt]hanks so much,{_WS}(?P<n>{_FULL}|{_WORD})"),
    re.compile(rf"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>{_COMMA}|{_FULL}|{_WORD})[ \t\r\u00a0]*$", re.M),
    re.compile(rf"^(?:[Dd]ear|[Hh]i|[Hh]ello){_WS}(?P<n>{_WORD})(?=,)", re.M),
    re.compile(rf"^[ \t]*(?P<n>{_GIVEN})[ \t\r\u00a0]*$", re.M),
]
_FRENCH = re.compile(rf"(?<!\w)M\.{_WS}(?P<n>{_FULL}|{_SUR})")
_HAN = "一-鿿々〆"
OTHER_NAMES = [
    re.compile(rf"(?:^|(?<=[^{_HAN}]))(?P<n>[{_HAN}]{{2,6}}?)(?=医生|医师|医師|先生|さん|氏|女士|主任)", re.M),
    re.compile(rf"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>[{_HAN}]{{2,6}})[ \t\r\u00a0]*$", re.M),
    re.compile(r"(?:[Вв]рач(?:ом|а|у)?|[Дд]октор(?:ом|а|у)?)\s+(?P<n>[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s(?:[А-ЯЁ]\.(?:\s?[А-ЯЁ]\.)?|[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)|[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.\s?)?[А-ЯЁ][а-яё]+|[А-ЯЁ][а-яё]+)"),
    re.compile(r"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>[А-ЯЁ][\w-]+\s(?:[А-ЯЁ]\.(?:\s?[А-ЯЁ]\.)?|[А-ЯЁ][\w-]+)|[А-ЯЁ]\.\s?(?:[А-ЯЁ]\.\s?)?[А-ЯЁ][\w-]+)[ \t\r\u00a0]*$", re.M),
    re.compile(r"(?:डॉ\.|डॉक्टर|श्रीमती|श्री)\s*(?P<n>[ऀ-ॿ]+\s[ऀ-ॿ]+?)(?=\s(?:ने|को|से|का|की|के|द्वारा)(?![ऀ-ॿ])|[।,\n]|$)"),
    re.compile(r"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>[ऀ-ॿ]+(?:\s[ऀ-ॿ]+){1,2})[ \t\r\u00a0]*$", re.M),
    re.compile(r"(?:الدكتورة|الدكتور|الطبيبة|الطبيب|السيدة|السيد)\s+(?P<n>[ء-ٟٱ-ۓ]+\s[ء-ٟٱ-ۓ]+)"),
    re.compile(r"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>[ء-ٟٱ-ۓ]+(?:\s[ء-ٟٱ-ۓ]+){1,2})[ \t\r\u00a0]*$", re.M),
    re.compile(r"(?:นายแพทย์|แพทย์หญิง|คุณหมอ|นางสาว|คุณ)\s?(?P<n>[ก-๎]{4,40}?)(?=ตรวจ|ได้|สั่ง|แนะนำ|กล่าว|พบ|\s|$)"),
    re.compile(r"^[—–][ \t\u00a0]*(?:\r?\n)?(?P<n>[ก-๎]{4,40})[ \t\r\u00a0]*$", re.M),
]

_DOM = r"[A-Za-z0-9-]+(?:(?:\.[a-z0-9-]*[a-z][a-z0-9-]*(?![A-Z]))+|(?:\.[A-Z0-9-]*[A-Z][A-Z0-9-]*(?![a-z]))+)"
_AT, _DOT = r"(?:\[at\]|\(at\)|\{at\}|\[AT\]|\(AT\)|AT|at)", r"(?:\[dot\]|\(dot\)|\{dot\}|\[DOT\]|\(DOT\)|DOT|dot)"
_SP = r"[ \t\u00a0\u2000-\u200a\u202f\u3000]*(?:\r?\n)?[ \t\u00a0\u2000-\u200a\u202f\u3000]*"
EMAILS = [
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|{_WS}@{_WS}){_DOM}"),
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\(at\)|\[at\]|\{{at\}}|\(AT\)|\[AT\]){_DOM}"),
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*{_WS}{_AT}{_WS}[A-Za-z0-9-]+(?:{_WS}{_DOT}{_WS}[A-Za-z0-9-]+)+"),
]
_CITY = rf"{_WORD}(?:{_WS}{_WORD}){{0,2}}"
_CAPS = rf"[{_UP}]{_L}+(?:['’]{_L}+)?"
ADDRESSES = [
    re.compile(
        rf"(?:(?<!\w)(?:Flat|Apt\.?|Apartment|Unit|Suite){_WS}\w+,{_WS})?(?<![\w.,/-])\d{{1,5}}[A-Za-z]?{_WS}(?:{_CAPS}{_WS}){{1,4}}?(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Terrace|Ter|Boulevard|Blvd|Way|Place|Pl|Close|Square|Sq|Crescent|Parkway|Pkwy|Circle|STREET|ST|ROAD|RD|LANE|AVENUE|DRIVE|DR|COURT|TERRACE|BLVD|WAY)\b\.?"
        rf"(?:,{_WS}(?:Apt|Unit|Suite|Ste|Flat|APT)\.?{_WS}\w+)?(?:,{_WS}{_CAPS}(?:{_WS}{_CAPS}){{0,3}})?(?:,{_WS}[A-Z]{{2}}(?![A-Za-z]))?(?:,?{_WS}\d{{5}}(?:-\d{{4}})?(?!\d))?"
    ),
    re.compile(rf"(?<![\w-])(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den){_WS})?(?:(?:Alte[rs]?|Neue[rs]?|Große|Kleine|Obere|Untere){_WS})?{_WORD}\.?{_WS}\d{{1,4}}{_WS}?[a-z]?,{_WS}\d{{5}}{_WS}{_CITY.replace('{0,2}', '{0,1}')}"),
    re.compile(rf"(?<![\w,])\d{{1,4}}(?:{_WS}(?:bis|ter|quater))?,?{_WS}(?:rue|av\.|avenue|bd|boulevard|chemin|place|allée|impasse|route|quai|cours|square){_WS}[^,;:!?\d]{{2,50}}?,{_WS}\d{{5}}{_WS}{_CITY}"),
    re.compile(rf"(?<![\w])(?:Calle|C/|Avda\.|Av\.|Avenida|Plaza|Pl\.|Paseo|Camino|Ronda|Travesía|Carrera)(?:{_WS})?[^,;:!?\d]{{2,50}}?{_WS}\d{{1,4}}(?:,{_WS}\d+\.?[ºª](?:{_WS}[A-Z](?![\w]))?)?,{_WS}\d{{5}}{_WS}{_CITY.replace('{0,2}', '{0,1}')}"),
    re.compile(rf"(?:г\.|город){_WS}?[А-ЯЁ][\w-]+(?:{_WS}[А-ЯЁ][\w-]+)?,{_WS}(?:ул\.|улица|пр\.|просп\.|пер\.|пл\.|бул\.){_WS}?[^,\n]{{2,40}}(?:\n[^,\n]{{1,40}})?,{_WS}д\.{_WS}?\d+\w?(?:,{_WS}(?:корп|стр)\.{_WS}?\d+)?(?:,{_WS}кв\.{_WS}?\d+)?"),
    re.compile(rf"[{_HAN}]{{1,8}}[都道府県市区町村郡][{_HAN}ァ-ヶー]{{0,12}}[0-9０-９]+(?:[-－‐−丁目番][0-9０-９]+){{1,3}}(?:号|番地)?"),
    re.compile(r"(?P<n>(?:(?![址为是在于居])[一-鿿]){2,8}?[市县][一-鿿]{1,12}?[路街道巷]\s?\d+\s?号(?:\s?\d+\s?(?:栋|幢|单元|室|号楼|楼))*)"),
]
_VAL = rf"(?:[A-Z]{{1,4}}-?)?\d{{1,14}}(?:(?:[.\-]|{_WS})\d{{1,9}}){{0,7}}(?:-?[A-Z](?![^\W_]))?"
_LINK = rf"(?:{_SP}(?:\([^)\n]{{1,20}}\)|no\.|nr\.|No\.|number|numbers?|num\.|№|N°|is|reads|was|ist|es|del tutor|del paciente|der Patientin|des Patienten|on{_WS}the{_WS}intake{_WS}form{_WS}reads|:|：|は|为|是|है|हो|هو)){{0,4}}{_SP}"
IDS = [re.compile(rf"(?<![A-Za-z])(?:{ID_LABELS}){_LINK}(?P<n>{_VAL})(?!\d)"), re.compile(r"(?<!\w)(?P<n>(?:MRN|HPN)-?\d[\d-]{5,}\d(?:-[A-Z](?!\w))?)(?!\w)"), re.compile(r"(?<![\w-])(?P<n>\d{3}-\d{2}-\d{4})(?![\w-])")]
_NOT_ID = re.compile(r"(?:accession|lot|order|form|visit code|specimen|ref|invoice|protocol|photo|table|fax)(?:\s+\(?no)?[.:#]?\s*$", re.I)
_S1 = rf"(?:[.\-]|{_WS})?"
PHONES = [
    re.compile(rf"\+1{_S1}(?:\(\d{{3}}\)|\d{{3}}){_S1}\d{{3}}{_S1}\d{{4}}(?!\d)"),
    re.compile(rf"(?<![\w.+/-])(?:1{_S1})?\(\d{{3}}\){_S1}\d{{3}}{_S1}\d{{4}}(?![\d])"),
    re.compile(rf"(?<![\w.+/-])(?:1{_S1})?\d{{3}}{_S1}\d{{3}}{_S1}\d{{4}}(?![\w/-]|\.\d)"),
    re.compile(rf"(?:\+|(?<![\w.+/-])00)\d{{1,3}}(?:(?:[.\-/]|{_WS})?\(?\d{{1,4}}\)?(?!\d{{3}}-)){{2,6}}(?:(?:[.\-/]|{_WS})?\d{{1,8}})?"),
    re.compile(rf"(?<![\w.+-])(?:\(0\d{{2,4}}\){_WS}?|0\d{{2,4}}[/ ])\d{{3,8}}(?:[ -]\d{{2,5}})?(?![\w/])"),
    re.compile(rf"(?<![\w.+-])0\d(?:(?:[.\-]|{_WS})\d\d){{4}}(?!\d)"),
    re.compile(rf"(?<![\w.+-])8{_S1}\(?\d{{3}}\)?{_S1}\d{{3}}{_S1}\d\d{_S1}\d\d(?!\d)"),
    re.compile(r"(?<![\d.+-])[0０][\d０-９]{1,4}[-－‐−][\d０-９]{2,4}[-－‐−][\d０-９]{3,4}(?![\d０-９])"),
    re.compile(rf"(?<![\w.+-])1\d{{2}}{_WS}?-?\d{{4}}{_WS}?-?\d{{4}}(?!\d)"),
]
LOOSE_PHONE = re.compile(rf"(?<![\w.+/-])\d{{2,9}}(?:(?:[.\-/]|{_WS})\d{{2,8}}){{0,4}}(?![\w/-])")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def mentions(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the personal information in a text, in order."""
    if not text or text.isspace():
        return []
    taken = np.zeros(len(text) + 1, bool)
    out: list[tuple[str, int, int]] = []

    def add(kind: str, s: int, e: int) -> None:
        while s < e and (text[s].isspace() or text[s] in ",;:"):
            s += 1
        while e > s and (text[e - 1].isspace() or text[e - 1] in ",;:"):
            e -= 1
        if e > s and not taken[s:e].any():
            taken[s:e] = True
            out.append((kind, s, e))

    for rx in EMAILS:
        for m in rx.finditer(text):
            add("EMAIL", *m.span())
    plain = text.isascii()
    # The last three kinds of addresses are of other scripts.
    for k, rx in enumerate(ADDRESSES[:4] if plain else ADDRESSES):
        for m in rx.finditer(text):
            # A number and a street alone are no address.
            if k or "," in m[0]:
                add("ADDRESS", *m.span())
    for rx in IDS:
        for m in rx.finditer(text):
            if _digits(m["n"]) >= 6 and not _NOT_ID.search(text[max(0, m.start() - 20) : m.start()]):
                add("ID", *m.span("n"))
    for rx in PHONES:
        for m in rx.finditer(text):
            head = text[max(0, m.start() - 30) : m.start()]
            if 8 <= _digits(m[0]) <= 15 and not re.search(r"(?:accession|lot no|order|visit code|specimen \(no|№|no)[.:]?\s*$", head, re.I):
                add("PHONE", *m.span())
    for m in LOOSE_PHONE.finditer(text):
        if 7 <= _digits(m[0]) <= 12 and PHONE_CUE.search(text[max(0, m.start() - 40) : m.start()]):
            add("PHONE", *m.span())
    # "M." is a title in French and an initial elsewhere.
    french = [_FRENCH] if "M." in text and language(text) == "fr" else []
    for rx in [NAME_RULES[0], *french, *NAME_RULES[1:]]:
        for m in rx.finditer(text):
            s, e = m.span("n")
            # What follows a facility's or street's name, and words that begin sentences, are no persons.
            words = [w for w in re.findall(rf"{_L}+", text[s:e])]
            if any(w.lower() in NOT_NAMES for w in words):
                first = re.match(rf"(?:{_GIVEN}|{_WORD})(?={_WS})", text[s:e])
                if rx is NAME_RULES[0] and first and first[0].lower() not in NOT_NAMES:
                    e = s + first.end()
                else:
                    continue
            if re.match(rf"{_WS}{AFTER}", text[e : e + 24]) or re.match(r"['’]s?\s+(?:ward|hospice|hospital|clinic)", text[e : e + 14], re.I):
                continue
            add("NAME", s, e)
    if not plain:
        for rx in OTHER_NAMES:
            for m in rx.finditer(text):
                add("NAME", *m.span("n"))
    out.sort(key=lambda x: x[1])
    return out


def found(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, pii_type, char_start, char_end) of every mention in a table with doc_id, page_no and text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [mentions(t) for t in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(hits)), [len(h) for h in hits]))
            flat = [x for h in hits for x in h]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())],
                ["doc_id", "page_no", "pii_type", "char_start", "char_end"],
            )

    cols = pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text").where("text is not null")
    # Only the small mentions are shuffled to make those of repeated pages one.
    return cols.mapInArrow(rows, "doc_id bigint, page_no int, pii_type string, char_start int, char_end int").distinct()


# --- surrogates

_POOLS = {  # fixed values: letters and syllables of made-up names by script
    "latin": ("b c d f g h j k l m n p r s t v w z".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split()),
    "arabic": ("ب ت ج د ر ز س ش ف ق ك ل م ن".split(), "ا ي و".split()),
    "devanagari": ("क ग च ज त द न प ब म र ल व स".split(), "ा ि ी ु े ो".split()),
    "thai": ("ก ค ง จ ช ด ต น บ ป พ ม ร ล ว ส".split(), "า ี ุ ู".split()),
}
_HAN_POOL = "山川田木林石水金土火東西南北春夏秋冬青白光明和平安文武英花雪月風星海江河湖松竹梅"
_ENDING = {"f": "a", "m": "o", "u": "e"}


def _bits(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest(), "big")


def script(word: str) -> str:
    for c in word:
        for name, lo, hi in (("han", 0x3005, 0x9FFF), ("thai", 0xE00, 0xE7F), ("devanagari", 0x900, 0x97F), ("arabic", 0x600, 0x6FF), ("cyrillic", 0x400, 0x4FF)):
            if lo <= ord(c) <= hi:
                return name
    return "latin"


def initial(key: bytes, letter: str) -> str:
    """A keyed permutation of the alphabet's letters, so that initials and names agree and differ where they differed."""
    base = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}.get(script(letter), "abcdefghijklmnopqrstuvwxyz")
    order = sorted(base, key=lambda c: _bits(key, "initial", c))
    plain = letter.lower() if letter.lower() in base else base[_bits(key, "other", letter.lower()) % len(base)]
    return order[base.index(plain)]


def surrogate_part(key: bytes, part: str, attempt: int = 0) -> str:
    """The lower-case surrogate of one part of a name."""
    s, n = script(part), _bits(key, "part", part.lower(), str(attempt))
    size = max(2, min(len(part), 12)) + attempt // 4
    if s == "han":
        out = ""
        for _ in range(len(part) + attempt // 4):
            n, k = divmod(n, len(_HAN_POOL))
            out += _HAN_POOL[k]
        return out
    cons, vows = _POOLS[s]
    out = initial(key, part[0]) if s in ("latin", "cyrillic") else ""
    while len(out) < size:
        n, k = divmod(n, len(cons) * len(vows))
        c, v = cons[k // len(vows)], vows[k % len(vows)]
        out += v + c if out and out[-1] in cons else c + v
    if s == "latin" and part.lower() in GENDER:
        out = out.rstrip("aeiou") + _ENDING[GENDER[part.lower()]]
    return out


def surrogate_code(key: bytes, kind: str, text: str, attempt: int = 0) -> str:
    """Letters to letters and digits to digits in the same places; signs, blanks and a country code in front stay."""
    fixed = re.match(r"(?:\+\d{1,3}|[A-Z]{3}-?(?=\d))?", text)[0] if kind in ("PHONE", "ID") else ""
    norm = re.sub(r"[\s().\-/]", "", text).lower()
    out, n = list(fixed), _bits(key, kind, norm, str(attempt))
    for c in text[len(fixed) :]:
        if c.isdigit():
            n, k = divmod(n, 10)
            c = chr(ord(c) - int(c) + k)
        elif c.isalpha() and c.isascii() and kind != "ADDRESS":
            n, k = divmod(n, 26)
            c = chr((65 if c.isupper() else 97) + k)
        if n == 0:
            n = _bits(key, kind, norm, str(attempt), str(len(out)))
        out.append(c)
    return "".join(out)


def entity_parts(kind: str, text: str) -> list[str]:
    """What gets a surrogate of its own: the parts of a name, the letters of an address with its numbers, else the whole."""
    if kind == "NAME":
        return [w.lower() for w in re.findall(r"[^\W\d_฀-๿ऀ-ॿ]+|[฀-๿]+|[ऀ-ॿ]+", text) if len(w) > 1]
    return [re.sub(r"\s+", " ", text)]


def surrogate(key: bytes, kind: str, part: str, attempt: int) -> str:
    if kind == "NAME":
        return surrogate_part(key, part, attempt)
    if kind == "ADDRESS":
        lower = {"street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "drive", "dr", "court", "terrace", "blvd", "way", "apt", "rue", "bd", "av", "calle", "avda", "plaza", "g", "ul", "am"}
        words = re.sub(r"[^\W\d_]{3,}", lambda m: m[0] if m[0].lower() in lower or m[0].islower() else match_case(surrogate_part(key, m[0].lower(), attempt), m[0]), part)
        return surrogate_code(key, kind, words, attempt)
    if kind == "EMAIL":
        local, at, rest = re.match(r"(.*?)(\s*@\s*|[\[({]at[\])}]|\s+\S?at\S?\s+|$)(.*)", part, re.I | re.S).groups()
        return surrogate_code(key, kind, local, attempt) + at + rest
    return surrogate_code(key, kind, part, attempt)


def match_case(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[:1].isupper() else new


def replaced(key: bytes, kind: str, text: str, attempts: dict[str, int]) -> str:
    """The mention's surrogate in the shape that it has in the text."""
    if kind != "NAME":
        return surrogate(key, kind, entity_parts(kind, text)[0], attempts.get(entity_parts(kind, text)[0], 0))
    one = lambda m: (match_case(surrogate_part(key, m[0].lower(), attempts.get(m[0].lower(), 0)), m[0]) if len(m[0]) > 1 else initial(key, m[0]).upper())
    return re.sub(r"[^\W\d_฀-๿ऀ-ॿ]+|[฀-๿]+|[ऀ-ॿ]+", one, text)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, part, attempt): for each entity the first attempt whose surrogate no other entity has and that is no entity itself."""
    secret = key.encode()

    def make(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["surrogate"] = [surrogate(secret, k, p, a) for k, p, a in zip(b["kind"], b["part"], b["attempt"])]
            yield b

    schema = "kind string, part string, attempt int, surrogate string"
    known = written(entities.select("kind", "part").distinct())
    made = written(known.select("kind", "part", F.lit(0).alias("attempt")).mapInPandas(make, schema))
    while True:
        real = known.select("kind", F.col("part").alias("surrogate"), F.lit(True).alias("real"))
        # The holder of a surrogate with the fewest attempts, then the smallest, keeps it.
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "part"))
        shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", F.lit(True).alias("shared"))
        state = made.join(shared, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        lost = state.where("real").select("kind", "part", "attempt").unionByName(state.where("shared and real is null").withColumn("r", rank).where("r > 1").select("kind", "part", "attempt"))
        lost = written(lost)
        if lost.isEmpty():
            return made
        again = lost.select("kind", "part", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInPandas(make, schema)
        made = written(made.join(lost.select("kind", "part"), ["kind", "part"], "left_anti").unionByName(again))


def pseudonymised(pages: DataFrame, key: str) -> DataFrame:
    """(doc_id, page_no, text) of every page row, with surrogates in place of the personal information."""
    secret = key.encode()
    pages = pages.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_no").cast("int").alias("page_no"), "text").dropDuplicates(["doc_id", "page_no", "text"])
    pages = pages.withColumn("h", F.xxhash64("text"))

    def hold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, n, h, k, s, e, t[s:e], entity_parts(k, t[s:e])) for d, n, t, h in b.itertuples(index=False) for k, s, e in mentions(t)]
            yield pd.DataFrame(out, columns=["doc_id", "page_no", "h", "kind", "s", "e", "mention", "parts"])

    held = written(pages.where("text is not null").mapInPandas(hold, "doc_id bigint, page_no int, h bigint, kind string, s int, e int, mention string, parts array<string>"))
    entity = held.select("kind", F.explode("parts").alias("part"))
    # Only entities that needed another attempt are looked up; all others follow from the key.
    moved = written(distinct_surrogates(entity, key).where("attempt > 0").select("kind", "part", "attempt"))
    parts = held.select("doc_id", "page_no", "h", "kind", "s", F.explode("parts").alias("part")).join(moved, ["kind", "part"]).groupBy("doc_id", "page_no", "h", "s").agg(F.collect_list(F.struct("part", "attempt")).alias("moved"))
    spans = held.select("doc_id", "page_no", "h", "kind", "s", "e").join(parts, ["doc_id", "page_no", "h", "s"], "left")
    spans = spans.groupBy("doc_id", "page_no", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e", "kind", "moved"))).alias("spans"))

    def put(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, spans in zip(b["text"], b["spans"]):
                if spans is not None and t is not None:
                    out, at = [], 0
                    for x in spans:
                        attempts = {m["part"]: m["attempt"] for m in (x["moved"] if x["moved"] is not None else ())}
                        out += [t[at : x["s"]], replaced(secret, x["kind"], t[x["s"] : x["e"]], attempts)]
                        at = x["e"]
                    t = "".join(out) + t[at:]
                texts.append(t)
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_no": b["page_no"], "text": texts})

    return pages.join(spans, ["doc_id", "page_no", "h"], "left").select("doc_id", "page_no", "text", "spans").mapInPandas(put, "doc_id bigint, page_no int, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(read(spark, sf_dir, "pages"))


def p2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its personal information replaced; the key is a setting of the session."""
    return pseudonymised(read(spark, sf_dir, "pages"), spark.conf.get("spark.chartloom.surrogate.key", "not a secret: set spark.chartloom.surrogate.key"))


QUERIES = {"p2_found": p2_found, "p2_surrogates": p2_surrogates}
ORACLE: dict[str, str] = {}
