"""Queries of the text expressions over documents and pages (functions/text.py).

Defined results: null texts give no line, sentence or term and are of kind 'unknown'; a page row that comes twice counts
once, and of differing copies of a page the smallest text counts; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.sources.tables import read


def page_rows(pages: DataFrame) -> DataFrame:
    """One row (doc_id, page_no, text) of each page that has a text."""
    return pages.where("text is not null").groupBy("doc_id", "page_no").agg(F.min("text").alias("text"))


def page_lines(pages: DataFrame, wanted: F.Column | None = None) -> DataFrame:
    """(doc_id, page_no, line_no, start, line): the lines of each page with their offsets.

    Offsets are running sums of lengths; lines that `wanted` (over the column `line`) refuses are shuffled without
    their text and dropped.
    """
    raw = page_rows(pages).select("doc_id", "page_no", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    keep = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    raw = raw.select("doc_id", "page_no", "line_no", F.length("line").alias("size"), F.when(keep, F.col("line")).alias("line"))
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return raw.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("int")).where("line is not null").drop("size")


def detect_kind(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.document_kind(F.col("text")).alias("kind_now"))


def lines_with_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return page_lines(read(spark, sf, "pages")).select("doc_id", "page_no", "line_no", "start", F.length("line").alias("size"))


def row_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of table rows: how many, the first one, and the numbers among them."""
    c = page_lines(read(spark, sf, "pages"), F.col("line").rlike(r"\S\s{2,}\S")).withColumn("cells", T.cells(F.col("line")))
    return c.where("size(cells) >= 2").select("doc_id", "page_no", "line_no", F.size("cells").alias("n"), F.element_at("cells", 1).alias("head"), F.size(F.filter("cells", lambda x: T.number(x).isNotNull())).alias("numbers"))


def ref_range_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of a table row that is a reference range."""
    c = page_lines(read(spark, sf, "pages"), F.col("line").rlike(r"\S\s{2,}\S")).select("doc_id", "page_no", "line_no", F.posexplode(T.cells(F.col("line"))).alias("at", "cell"))
    return c.withColumn("r", T.reference_range(F.col("cell"))).where("r is not null").select("doc_id", "page_no", "line_no", "at", "r.low", "r.high")


def us_date_to_iso(spark: SparkSession, sf: str) -> DataFrame:
    """The first American date of each page as an ISO date."""
    return page_rows(read(spark, sf, "pages")).select("doc_id", "page_no", T.us_date(F.col("text")).alias("first_date"))


def sentence_stances(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that are negated or speculative."""
    s = read(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    return s.withColumn("stance", T.stance(F.col("sentence"))).where("stance <> 'ASSERTED'").select("doc_id", "at", "sentence", "stance")


def stance_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "documents").select("lang", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("lang", T.stance(F.col("sentence")).alias("stance")).agg(F.count("*").alias("n"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies of each document."""
    t = read(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def icd_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that end with a code in brackets: the code, and the name in front of it."""
    l = page_lines(read(spark, sf, "pages"), F.col("line").contains("("))
    code = F.regexp_extract("line", r"\(([A-Z]\d{2}(?:\.\d+)?)\)\s*$", 1)
    return l.select("doc_id", "page_no", "start", code.alias("code"), F.trim(F.regexp_extract("line", r"^\s*(?:\d+\.\s*)?(.*?)\s*\([A-Z]\d{2}(?:\.\d+)?\)\s*$", 1)).alias("name")).where("code <> ''")


_P = "p as (select doc_id, page_no, min(text) as text from pages where text is not null group by 1, 2)"
_LINE = T.LINE.replace("'", "''")
#: The lines l(doc_id, page_no, line_no, start, line) in SQL.
LINES_SQL = f"""{_P},
l0 as (select doc_id, page_no, unnest(regexp_extract_all(text, '{_LINE}')) line, generate_subscripts(regexp_extract_all(text, '{_LINE}'), 1) - 1 line_no from p),
l as (select *, coalesce(cast(sum(length(line)) over (partition by doc_id, page_no order by line_no rows between unbounded preceding and 1 preceding) as integer), 0) start from l0)"""


def cells_sql(c: str) -> str:
    t = rf"regexp_replace({c}, '\s{{2,}}-\s{{2,}}{T.NUMBER}(\s{{2,}}|$)', '\1', 'g')"
    t = rf"regexp_replace({t}, '(\s{{2,}}{T.NUMBER})\s{{2,}}(-{T.NUMBER}(?:\s{{2,}}|$))', '\1\2', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '\s{{2,}}'), lambda x: trim(x)), lambda x: x <> '')"


def sentences_sql(c: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])[ \t\n\r\x0c]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\n\r\x0c]+|[ \t\n\r\x0c]+$', '', 'g')), lambda s: length(s) >= 8)"


def stance_sql(c: str) -> str:
    return rf"case when regexp_matches(lower({c}), '{'|'.join(T.SPECULATION)}') then 'SPECULATIVE' when regexp_matches(array_to_string(regexp_extract_all(lower({c}), '[a-z]+'), ' '), '(?:^| )(?:{'|'.join(T.NEGATION)})') then 'NEGATED' else 'ASSERTED' end"


def tokens_sql(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda w: lower(w)), lambda w: length(w) > 1 and w not in ({stop}))"


def kind_sql(c: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({c}), '{'|'.join(m)}') then '{k}'" for k, m in T.KIND_MARKERS.items()) + " else 'unknown' end"


def us_date_sql(c: str) -> str:
    g = lambda i: rf"regexp_extract({c}, '\b(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\b', {i})"
    return f"case when try_cast({g(1)} as integer) between 1 and 12 and try_cast({g(2)} as integer) between 1 and 31 then {g(3)} || '-' || lpad({g(1)}, 2, '0') || '-' || lpad({g(2)}, 2, '0') end"


def range_sql(c: str) -> tuple[str, str]:
    a, b = (rf"try_cast(regexp_extract({c}, '^({T.PLAIN})\s*-\s*(-?{T.PLAIN})$', {i}) as double)" for i in (1, 2))
    o = rf"try_cast(regexp_extract({c}, '^[<>]=?\s*({T.PLAIN})$', 1) as double)"
    return f"case when {a} is not null then least({a}, {b}) when {c} like '<%' then {o} end", f"case when {a} is not null then greatest({a}, {b}) when {c} like '>%' then {o} end"


_NUM = f"regexp_matches(x, '^{T.NUMBER}$')"
QUERIES = {
    "detect_kind": detect_kind, "lines_with_offsets": lines_with_offsets, "row_cells": row_cells, "ref_range_parse": ref_range_parse, "us_date_to_iso": us_date_to_iso, "sentence_stances": sentence_stances,
    "stance_counts": stance_counts, "terms": terms, "icd_codes": icd_codes,
}
ORACLE = {
    "detect_kind": f"select doc_id, {kind_sql('text')} kind_now from documents",
    "lines_with_offsets": f"with {LINES_SQL} select doc_id, page_no, cast(line_no as integer) line_no, start, cast(length(line) as integer) size from l",
    "row_cells": rf"with {LINES_SQL}, c as (select *, {cells_sql('line')} cells from l where regexp_matches(line, '\S\s{{2,}}\S')) select doc_id, page_no, cast(line_no as integer) line_no, cast(len(cells) as integer) n, cells[1] head, cast(len(list_filter(cells, lambda x: {_NUM})) as integer) numbers from c where len(cells) >= 2",
    "ref_range_parse": rf"""with {LINES_SQL}, c as (select doc_id, page_no, line_no, unnest(cs) cell, generate_subscripts(cs, 1) - 1 k from (select *, {cells_sql('line')} cs from l where regexp_matches(line, '\S\s{{2,}}\S')) z) select doc_id, page_no, cast(line_no as integer) line_no, cast(k as integer) "at", {range_sql('cell')[0]} low, {range_sql('cell')[1]} high from c where regexp_matches(cell, '{T.RANGE}')""",
    "us_date_to_iso": f"with {_P} select doc_id, page_no, {us_date_sql('text')} first_date from p",
    "sentence_stances": f"""select doc_id, cast(k as integer) "at", sentence, {stance_sql('sentence')} stance from (select doc_id, unnest(s) sentence, generate_subscripts(s, 1) - 1 k from (select doc_id, {sentences_sql('text')} s from documents where text is not null) z) where {stance_sql('sentence')} <> 'ASSERTED'""",
    "stance_counts": f"select lang, {stance_sql('sentence')} stance, count(*) n from (select lang, unnest({sentences_sql('text')}) sentence from documents where text is not null) group by 1, 2",
    "terms": f"select doc_id, term, count(*) tf from (select doc_id, unnest({tokens_sql('text')}) term from documents) group by 1, 2",
    "icd_codes": rf"""with {LINES_SQL} select doc_id, page_no, start, regexp_extract(line, '\(([A-Z]\d{{2}}(?:\.\d+)?)\)\s*$', 1) code, trim(regexp_extract(line, '^\s*(?:\d+\.\s*)?(.*?)\s*\([A-Z]\d{{2}}(?:\.\d+)?\)\s*$', 1)) "name" from l where regexp_matches(line, '\([A-Z]\d{{2}}(?:\.\d+)?\)\s*$')""",
}
