"""What a row of a register says about a person, and how two rows compare.

A typed name becomes its spelled-out parts (without marks, case, titles, remarks and particles) and initials; dob
becomes a date, mrn a registry number, an address a short key. Blank, test and placeholder names mean nobody.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTICLES = set("de la da van der von al st ben mac mc del di du le el bin ibn dos".split())
TITLES = set("mr mrs ms miss dr prof sir jr sr ii iii iv md phd rn".split())
NOBODY = re.compile(r"\b(test|xxx+|placeholder|unknown|unidentified|baby|asdf|qwer|walk[- ]?in|anonymous|dummy|do not use this)\b", re.I)
REMARK = re.compile(r"\[[^\]]*\]|\*\*.*?\*\*|\((?=[^)]*\s)[^)]*\)|/\s*referred.*$|,?\s*\bc/o\b.*$|\s+-\s+.*$", re.I)
NICKNAMES: dict[str, set[str]] = {}
for _full, _names in {
    "theodore": "ted teddy", "rebecca": "becky becca", "dorothy": "dot dottie", "charles": "chuck charlie", "lawrence": "larry", "johannes": "hannes", "christina": "tina chris", "antonia": "toni",
    "theresa": "terry tess", "penelope": "penny", "virginia": "ginny", "richard": "rick dick richie", "william": "bill billy will", "robert": "bob bobby rob", "margaret": "peggy maggie meg",
    "susan": "sue susie", "leonard": "lenny", "jacqueline": "jackie", "gabriella": "gabi", "elizabeth": "liz beth betty lisa", "isabella": "izzy bella", "veronica": "ronnie", "anthony": "tony",
    "katherine": "kate kathy katie kit", "alexander": "sasha", "alexandra": "sandra", "josephine": "josie jo", "victoria": "vicky", "patricia": "patty trish", "daniel": "danny", "abigail": "abby",
    "jennifer": "jenny", "nicholas": "nick", "edward": "ed ted ned", "joseph": "joey joe", "james": "jim jimmy", "andrew": "drew andy", "stephen": "steve", "michael": "mike mick", "matthew": "matt",
    "matthias": "matt", "frederick": "fred freddy", "benjamin": "benny", "samuel": "sammy", "maeve": "mae", "thomas": "tommy", "deborah": "debbie", "barbara": "barb babs", "francisco": "paco",
    "gregory": "greg", "zachary": "zach zack", "magdalena": "lena magda", "guadalupe": "lupe",
}.items():
    for _a in _names.split():
        NICKNAMES.setdefault(_a, set()).add(_full)
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
SLIP = 12  # days; two grids of twice as many bring all dates up to this far apart together
ROW = "key string, parts array<string>, initials string, dob int, mrn string, home string"
PROFILE = ["parts", "initials", "dob", "mrn", "home"]


def fold(text: str) -> str:
    """Lower case without marks; oe, ue and ae as the single vowels that they are often typed for."""
    t = text.lower().translate(str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "æ": "a", "œ": "o"}))
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return re.sub(r"([aou])e", r"\1", t)


def name_parts(name: str | None) -> tuple[list[str], str]:
    """The spelled-out parts of a name and its initials; nothing for a name that means nobody."""
    if not name or NOBODY.search(name):
        return [], ""
    t = re.sub(r"(?<=[^\W\d_])[01]|[01](?=[^\W\d_])", lambda m: "ol"[int(m[0])], REMARK.sub(" ", name))
    tokens = [x for x in re.findall(r"[^\W\d_]+", t.lower()) if x not in TITLES and fold(x) not in PARTICLES]
    return list(dict.fromkeys(fold(x) for x in tokens if len(x) > 2)), "".join(dict.fromkeys(c for x in tokens if len(x) <= 2 for c in fold(x)))


def birth(text: str | None) -> int | None:
    """yyyymmdd of a date in any of the notations; None where it is missing, impossible or a filler."""
    t = (text or "").strip().lower()
    for pattern, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(\d{4})(\d\d)(\d\d)$", "ymd"), (r"(\d\d?)/(\d\d?)/(\d{4})", "mdy"), (r"(\d\d?)\.(\d\d?)\.(\d{4})", "dmy"), (r"(\d\d?) ([a-z]{3})[a-z]* (\d{4})", "dmy"), (r"([a-z]{3})[a-z]* (\d\d?),? (\d{4})", "mdy")):
        if m := re.match(pattern, t):
            p = {k: MONTHS.get(v) or (int(v) if v.isdigit() else 0) for k, v in zip(order, m.groups())}
            try:
                date(p["y"], p["m"], p["d"])
            except ValueError:
                return None
            return p["y"] * 10000 + p["m"] * 100 + p["d"] if 1901 <= p["y"] <= 2030 else None
    return None


def registry_number(text: str | None) -> str | None:
    """The eight digits of a real registry number; None for placeholders and numbers of the old system."""
    t = re.sub(r"[\s-]", "", (text or "").upper())
    m = re.fullmatch(r"(?:MRN)?(\d{8})", t)
    return m[1] if m and len(set(m[1])) > 1 else None


def home_key(text: str | None) -> str | None:
    """House number and the begin of the street's name: what survives abbreviations, a missing town and most slips."""
    m = re.match(r"\s*(\d+)\s+([^\W\d_]{2,4})", fold(text or ""))
    return f"{m[1]} {m[2]}" if m else None


def near(a: str, b: str) -> bool:
    """Equal but for one letter put in, left out or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


#: The nicknames and their full names as parts.
FULL_NAMES: dict[str, set[str]] = {}
for _n, _fs in NICKNAMES.items():
    FULL_NAMES[fold(_n)] = {fold(_f) for _f in _fs}


def same_part(a: str, b: str) -> bool:
    if a == b or (min(len(a), len(b)) >= 4 and near(a, b)):
        return True
    if len(a) > len(b):
        a, b = b, a
    return (3 <= len(a) < len(b) and b.startswith(a)) or any(near(f, y) for x, y in ((a, b), (b, a)) for f in FULL_NAMES.get(x, ()))


def alike(a: str, b: str) -> bool:
    """One slip in a short part, or two in a longer one: enough only beside an equal date or number."""
    return (min(len(a), len(b)) >= 3 and near(a, b)) or (min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 2 and two_slips(a, b))


def two_slips(a: str, b: str) -> bool:
    """Whether Levenshtein's distance is two at most."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        left, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, left + (x != y))
        if min(row) > 2:
            return False
    return row[-1] <= 2


def compare_names(pa: list[str], ia: str, pb: list[str], ib: str) -> str:
    """'full': all parts of the shorter name are in the longer, two or more; 'initial': the surname and a fitting initial; 'alike': full but for a part with more slips; 'part': some part; ''."""
    left, rest, hits = list(pb), [], 0
    for test in (str.__eq__, same_part):
        rest, todo = [], (pa if test is str.__eq__ else rest)
        for x in todo:
            y = next((y for y in left if test(x, y)), None)
            if y is None:
                rest.append(x)
            else:
                left.remove(y)
                hits += 1
    if not hits:
        return ""
    if rest and left:
        return "alike" if len(rest) == 1 and any(alike(rest[0], y) for y in left) else "part"
    if hits >= 2:
        return "full"
    if not rest and not left:
        return "initial" if not ia or not ib or set(ia) & set(ib) else "part"
    firsts = {y[0] for x in rest + left for y in (x, *FULL_NAMES.get(x, ()))}
    return "initial" if firsts & set(ib if rest else ia) else "part"


def compare_dates(a: int | None, b: int | None) -> str:
    if not a or not b:
        return "missing"
    if a == b:
        return "same"
    x, y = (a // 10000, a // 100 % 100, a % 100), (b // 10000, b // 100 % 100, b % 100)
    if abs((date(*x) - date(*y)).days) == 1 or (x[0] == y[0] and x[1:] == y[:0:-1]):
        return "close"
    if sum(p == q for p, q in zip(x, y)) >= 2 or abs((date(*x) - date(*y)).days) < SLIP:
        return "near"
    # Year and day are both damaged: told apart from another date only by further evidence.
    return "loose" if abs(x[0] - y[0]) in (1, 10) and abs((date(2000, *x[1:]) - date(2000, *y[1:])).days) < SLIP else "other"


def compare_numbers(a: str | None, b: str | None) -> str:
    if not a or not b:
        return "missing"
    if a == b:
        return "same"
    return "near" if sum(x != y for x, y in zip(a, b)) == 1 or (sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) == 2) else "other"


def decide(a: tuple, b: tuple) -> str:
    """'strong', 'weak' or '' for two rows (parts, initials, dob, mrn, home)."""
    name, dob, mrn = compare_names(a[0], a[1], b[0], b[1]), compare_dates(a[2], b[2]), compare_numbers(a[3], b[3])
    home = a[4] is not None and a[4] == b[4]
    if name == "full":
        if mrn == "near" or (home and dob in ("missing", "near", "loose")):
            return "strong"
        if mrn == "same" or dob in ("same", "close") or (dob == "near" and mrn != "other"):
            return "strong"
        return "weak" if dob == "missing" and mrn == "missing" else ""
    if name == "alike":
        return "strong" if (dob == "same" and mrn != "other") or (mrn in ("same", "near") and dob != "other") else ""
    if name == "initial":
        if mrn == "same" and dob != "other":
            return "strong"
        return "weak" if dob in ("same", "close") or (dob == "near" and mrn == "near") or (home and dob in ("missing", "near")) else ""
    return "strong" if name == "part" and mrn == "same" and dob == "same" else ""


def parsed(rows: DataFrame) -> DataFrame:
    """ROW of the people in a table with key, name, dob, mrn and, where it has one, address."""
    rows = rows if "address" in rows.columns else rows.withColumn("address", F.lit(None).cast("string"))

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, name, dob, mrn, address in b.itertuples(index=False):
                parts, initials = name_parts(name)
                if parts:
                    out.append((key, parts, initials, birth(dob), registry_number(mrn), home_key(address)))
            df = pd.DataFrame(out, columns=["key", "parts", "initials", "dob", "mrn", "home"])
            yield df.astype({"dob": "Int32"})

    return rows.select("key", "name", "dob", "mrn", "address").mapInPandas(parse, ROW)


def registry_rows(patients: DataFrame) -> DataFrame:
    """key, name, dob, mrn and address of the registry."""
    return patients.select(F.col("id").alias("key"), "name", "dob", "mrn", F.get_json_object("patient_json", "$.address").alias("address")).dropDuplicates(["key"])


def confidence(a: tuple, b: tuple) -> float:
    """How sure a match is by the two rows themselves, from 0 to 1: an ordered scale, not a calibrated probability."""
    name, dob, mrn = compare_names(a[0], a[1], b[0], b[1]), compare_dates(a[2], b[2]), compare_numbers(a[3], b[3])
    odds = {"full": 8.0, "initial": 2.0, "alike": 3.0, "part": 0.5, "": 0.2}[name] * {"same": 20.0, "close": 8.0, "near": 3.0, "missing": 1.0, "loose": 0.5, "other": 0.1}[dob]
    odds *= {"same": 30.0, "near": 8.0, "missing": 1.0, "other": 0.4}[mrn] * (6.0 if a[4] is not None and a[4] == b[4] else 1.0)
    return round(odds / (1.0 + odds), 4)
