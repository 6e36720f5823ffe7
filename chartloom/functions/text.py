"""Text expressions: lines, cells, numbers, ranges, dates, kinds of documents, stances and tokens.

Patterns use only what Java's and RE2's regular expressions share, so that SQL engines can check them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
#: A line with its end, as all of these characters end one.
LINE = rf"[^{_END}]*(?:\r\n|[{_END}])|[^{_END}]+"
STRIP = r"^[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}]+|[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{2028}\x{2029}]+$"
NUMBER = r"[<>]?\s*[-+]?\d+(?:\.\d+)?"
PLAIN = r"\d+(?:\.\d+)?"
RANGE = rf"^(?:[<>]=?\s*{PLAIN}|{PLAIN}\s*-\s*-?{PLAIN})$"
US_DATE = r"\d{1,2}/\d{1,2}/\d{4}"

# Markers of kinds of documents, the first kind with a marker wins.
KIND_MARKERS = {
    "rx": ["prescription history", "pharmacy", "directions", "take 1 tablet"],
    "lab": ["reference range", "analyte", "collected:", "accession:", "chemistry", "end of report"],
    "note": ["discharge summary", "admit date", "discharge date", "attending:", "presenting history", "department of"],
}
# Cues of speculation and of negation.
SPECULATION = [
    "possible", "possibly", "probable", "probably", "likely", "concern for", "concerning for", "suspicious for", "may have", "might have", "question of", "consider", "considering", "cannot exclude", "not excluded",
    "differential includes",
]
NEGATION = ["no", "not", "without", "denies", "deny", "denied", "negative for", "absence of", "absent", "free of", "never had", "no evidence of", "rule out", "ruled out", "without any", "neither", "nor", "cannot"]
# Words that are no terms of retrieval.
STOPWORDS = (
    "a an the and or but if then than that this these those of in on at to for from by with without into over under is are was were be been being am do does did have has had having it its as not no nor so such can could will "
    "would shall should may might must i you he she they we me him her them us my your his their there here when where which who whom whose what how why all any both each few more most other some only own same too very s t "
    "just don now"
).split()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def cells(line: Column) -> Column:
    """A row's cells, divided by two blanks or more.

    A dash that stands in a cell of its own takes the number after it away with it; a cell that begins with a dash and
    follows a number is joined to it.
    """
    t = F.regexp_replace(line, rf"\s{{2,}}-\s{{2,}}{NUMBER}(\s{{2,}}|$)", "$1")
    t = F.regexp_replace(t, rf"(\s{{2,}}{NUMBER})\s{{2,}}(-{NUMBER}(?:\s{{2,}}|$))", "$1$2")
    return F.filter(F.transform(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def number(cell: Column) -> Column:
    """The number of a numeric cell, without a leading < or >; null for other cells."""
    return F.when(cell.rlike(rf"^{NUMBER}$"), F.regexp_replace(cell, r"^[<>\s]+", "").try_cast("double"))


def reference_range(cell: Column) -> Column:
    """(low, high) of a range cell, null for others; bounds in wrong order are swapped, '<5' sets low and '>5' high."""
    open_ = F.nullif(F.regexp_extract(cell, rf"^[<>]=?\s*({PLAIN})$", 1), F.lit("")).try_cast("double")
    a = F.nullif(F.regexp_extract(cell, rf"^({PLAIN})\s*-\s*(-?{PLAIN})$", 1), F.lit("")).try_cast("double")
    b = F.nullif(F.regexp_extract(cell, rf"^({PLAIN})\s*-\s*(-?{PLAIN})$", 2), F.lit("")).try_cast("double")
    low = F.when(a.isNotNull(), F.least(a, b)).when(cell.startswith("<"), open_)
    high = F.when(a.isNotNull(), F.greatest(a, b)).when(cell.startswith(">"), open_)
    return F.when(cell.rlike(RANGE), F.struct(low.alias("low"), high.alias("high")))


def us_date(text: Column) -> Column:
    """The first M/D/YYYY of a text as an ISO date; month 1-12 and day 1-31 are asked for, no calendar."""
    part = lambda i: F.regexp_extract(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", i)
    m, d = F.nullif(part(1), F.lit("")).cast("int"), F.nullif(part(2), F.lit("")).cast("int")
    return F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))


def document_kind(text: Column) -> Column:
    """rx, lab, note or unknown, by the first kind with a marker."""
    low = F.lower(text)
    has = lambda kind: F.coalesce(low.rlike("|".join(KIND_MARKERS[kind])), F.lit(False))
    return F.when(has("rx"), "rx").when(has("lab"), "lab").when(has("note"), "note").otherwise("unknown")


def sentences(text: Column) -> Column:
    """Trimmed sentences of eight characters or more."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\x0c]+", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\n\r\x0c]+|[ \t\n\r\x0c]+$", "")), lambda s: F.length(s) >= 8)


def stance(sentence: Column) -> Column:
    """ASSERTED, NEGATED or SPECULATIVE; cues of negation match at the begin of a word and need not end there."""
    low = F.lower(sentence)
    words = F.array_join(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), " ")
    return F.when(low.rlike("|".join(SPECULATION)), "SPECULATIVE").when(words.rlike(f"(?:^| )(?:{'|'.join(NEGATION)})"), "NEGATED").otherwise("ASSERTED")


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, without stop-words and single characters."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))
