"""Facts out of report pages: result rows, prescription rows, encounters, headers.

Pages are cut into lines with offsets (texts.page_lines); only lines that can matter keep their text in the shuffle.
Every fact points to the characters that it was read from. Defined results: a row whose first cell is no known analyte,
or that has no number, gives no fact; a dash between blanks loses the upper bound; dates are month/day/year, others
leave the time null; repeated page rows count once; null and blank pages give nothing; empty tables give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import text as T
from chartloom.operators import texts as X
from chartloom.operators.facts import abnormal
from chartloom.sources.tables import read

RULER = r"^\s*[-=_]*\s*$"
DATE = rf"({T.US_DATE})"
ANCHORS = {
    "admit": rf"(?i)Admit(?:ted)?\s*(?:Date)?\s*:?\s*{DATE}",
    "discharge": rf"(?i)Discharg(?:e|ed)\s*(?:Date)?\s*:?\s*{DATE}",
    "visit": rf"(?i)(?:VISIT|Encounter\s+Date|Visit\s+Date|Service\s+Date)\s*:?\s*{DATE}",
    "collected": rf"(?i)Collected\s*:?\s*{DATE}",
}
FACILITY = r"^[ \t]*([A-Z][A-Z'.&-]*(?:[ ][A-Z][A-Z'.&-]*)+)[ \t]*$"
SERVICE = r"[ \t]*Department[ \t]+of[ \t]+(\S.*?)[ \t]*$"
# Pages of the layouts that the tables lack (stays, visits), with negative document ids.
LAYOUT_PAGES = [
    (-1, 1, "MOUNT HARROW HOSPITAL\nDepartment of Internal Medicine\nAdmit Date: 01/15/2026   Discharge Date: 01/22/2026\nCollected: 01/16/2026\n"),
    (-2, 1, "Admitted: 3/4/2025\nquiet course\nDischarged: 3/9/2025\nAdmit: 5/1/2025\n"),
    (-3, 1, "Discharge Date: 2/31/2025\nDischarged 6/7/2025\n"),
    (-4, 1, "Visit Date: 7/8/2025\nVISIT 7/8/2025\nService Date: 13/40/2025\nEncounter Date: 9/9/2025 and Visit Date: 1/1/2020\n"),
    (-5, 1, "Discharge: 1/2/2025\nAdmit: 1/3/2025 Discharge: 1/5/2025\nDischarge: 1/9/2025\nAdmit: 1/3/2025\n"),
]


def _first(cells: Column, test) -> Column:
    return F.element_at(F.filter(cells, test), 1)


def lab_rows(pages: DataFrame, analytes: DataFrame) -> DataFrame:
    """Result rows as lab facts. analytes: (loinc, display)."""
    l = X.page_lines(pages, F.col("line").rlike(r"\S\s{2,}\S") & ~F.col("line").rlike(RULER)).withColumn("cells", T.cells(F.col("line"))).where("size(cells) >= 2")
    name_key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    codes = analytes.select(name_key(F.col("display")).alias("name_key"), "loinc").groupBy("name_key").agg(F.min("loinc").alias("loinc"))
    l = l.withColumn("name", F.element_at("cells", 1)).withColumn("name_key", name_key(F.col("name"))).join(codes, "name_key")
    rest = F.slice("cells", 2, F.size("cells"))
    at = F.array_position(F.transform(rest, lambda x: T.number(x).isNotNull()), True)
    l = l.withColumn("at", at.cast("int")).where("at > 0").withColumn("value", T.number(F.element_at(rest, F.col("at"))))
    after = F.filter(F.slice(rest, F.col("at") + 1, F.size(rest)), lambda x: ~x.rlike(r"^(?:[HLAhla]|[A-Za-z])$"))
    ranges = F.filter(F.transform(after, T.reference_range), lambda r: r.isNotNull())
    l = l.withColumn("r", F.try_element_at(ranges, F.lit(-1))).withColumn("unit", F.try_element_at(F.filter(after, lambda x: ~x.rlike(T.RANGE)), F.lit(1)))
    dated = X.page_rows(pages).select("doc_id", "page_no", T.us_date(F.regexp_extract("text", ANCHORS["collected"].replace(r"Collected\s*:?", "Collected:"), 1)).alias("time_iso"))
    l = l.join(dated, ["doc_id", "page_no"])
    start = (F.col("start") + F.instr("line", F.col("name")) - 1).cast("int")
    return l.select(
        "doc_id", "page_no", start.alias("char_start"), (start + F.length("name")).alias("char_end"), "name", "value", "unit", "time_iso", "loinc", F.col("r.low").alias("ref_low"), F.col("r.high").alias("ref_high"),
        abnormal(F.col("value"), F.col("r.low"), F.col("r.high")).alias("abnormal"),
    )


def rx_rows(pages: DataFrame) -> DataFrame:
    """Prescription rows as med facts: a row counts if some cell after the first is a strength."""
    l = X.page_lines(pages, F.col("line").rlike(r"\S\s{2,}\S") & ~F.col("line").rlike(RULER)).withColumn("cells", T.cells(F.col("line"))).where("size(cells) >= 2")
    l = l.withColumn("rest", F.slice("cells", 2, F.size("cells"))).withColumn("dated", F.element_at("rest", -1).rlike(rf"^{T.US_DATE}$"))
    l = l.withColumn("body", F.when(F.col("dated"), F.slice("rest", 1, F.size("rest") - 1)).otherwise(F.col("rest")))
    at = F.array_position(F.transform("body", lambda x: x.rlike(rf"^{T.PLAIN}\s+\S")), True).cast("int")
    l = l.withColumn("at", at).where("at > 0").withColumn("name", F.element_at("cells", 1))
    start = (F.col("start") + F.instr("line", F.col("name")) - 1).cast("int")
    directions = F.trim(F.array_join(F.slice("body", F.col("at") + 1, F.size("body")), " "))
    return l.select(
        "doc_id", "page_no", start.alias("char_start"), (start + F.length("name")).alias("char_end"), "name", F.element_at("body", F.col("at")).alias("dose"), F.nullif(directions, F.lit("")).alias("frequency"),
        F.when(F.col("dated"), T.us_date(F.element_at("rest", -1))).alias("time_iso"),
    )


def anchors(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, start, admit, discharge, visit, collected): the dates that each line names, as structs of iso, at and raw."""
    any_ = F.col("line").rlike(rf"(?i)(?:admit|discharg|visit|date|collected).*{T.US_DATE}")
    l = X.page_lines(pages, any_)

    def anchor(rx: str) -> Column:
        hit, raw = F.regexp_extract("line", rx, 0), F.regexp_extract("line", rx, 1)
        iso = T.us_date(raw)
        return F.when(iso.isNotNull(), F.struct(iso.alias("iso"), (F.col("start") + F.instr("line", hit) - 1 + F.length(hit) - F.length(raw)).cast("int").alias("at"), raw.alias("raw")))

    return l.select("doc_id", "page_no", "start", *[anchor(rx).alias(k) for k, rx in ANCHORS.items()])


def encounter_facts(pages: DataFrame) -> DataFrame:
    """Encounters that a page evidences: stays before visits before collections; within the source every date counts."""
    a = anchors(pages)
    page = ["doc_id", "page_no"]
    w = Window.partitionBy(*page).orderBy("start")
    i = a.where("admit is not null or discharge is not null").withColumn("prior", F.last("admit", ignorenulls=True).over(w)).withColumn("any_admit", F.max(F.col("admit").isNotNull()).over(Window.partitionBy(*page)))
    # Phases in the order in which facts get their numbers: both dates on a line; a discharge with the admission before it; the rest.
    same = i.where("admit is not null and discharge is not null").select(*page, F.lit(0).alias("phase"), "admit", "discharge")
    orphan = i.where("admit is null and (prior is not null or not any_admit)").select(*page, F.lit(1).alias("phase"), F.col("prior").alias("admit"), "discharge")
    paired = same.unionByName(orphan).where("admit is not null").select(*page, "admit.at").distinct()
    open_ = i.where("admit is not null").select(*page, "admit", F.col("admit.at").alias("at")).join(paired, [*page, "at"], "left_anti").select(*page, F.lit(2).alias("phase"), "admit", F.lit(None).cast("struct<iso:string,at:int,raw:string>").alias("discharge"))
    stays = same.unionByName(orphan).unionByName(open_).select(*page, F.lit(0).alias("source"), "phase", F.coalesce("admit", "discharge").alias("anchor"), F.coalesce("discharge.at", "admit.at").alias("order_at"), F.col("admit.iso").alias("admit"), F.col("discharge.iso").alias("discharge"), F.lit("inpatient").alias("enc_type"))
    point = lambda k, s: a.where(F.col(k).isNotNull()).select(*page, F.lit(s).alias("source"), F.lit(0).alias("phase"), F.col(k).alias("anchor"), F.col(f"{k}.at").alias("order_at"), F.col(f"{k}.iso").alias("admit"), F.col(f"{k}.iso").alias("discharge"), F.lit("outpatient").alias("enc_type"))
    f = reduce(DataFrame.unionByName, [stays, point("visit", 1), point("collected", 2)])
    f = f.withColumn("best", F.min("source").over(Window.partitionBy(*page))).where("source = best")
    f = f.withColumn("ordinal", F.row_number().over(Window.partitionBy(*page).orderBy("phase", "order_at")) - 1)
    name = F.concat(F.col("doc_id").cast("string"), F.lit("#p"), F.col("page_no").cast("string"), F.lit(":"), F.col("enc_type"), F.lit(":"), F.col("anchor.iso"), F.when(F.col("ordinal") > 0, F.concat(F.lit("#"), F.col("ordinal").cast("string"))).otherwise(F.lit("")))
    head = X.page_rows(pages).select(*page, *banner(F.col("text")))
    return f.join(head, page).select(*page, name.alias("name"), F.col("anchor.iso").alias("time_iso"), "admit", "discharge", "enc_type", "facility", "service", F.col("anchor.at").alias("char_start"), (F.col("anchor.at") + F.length("anchor.raw")).alias("char_end"))


def banner(text: Column) -> list[Column]:
    """The facility (first line of two capitalised words or more) and the service (Department of ...) of a page."""
    return [F.nullif(F.regexp_extract(text, f"(?md){FACILITY}", 1), F.lit("")).alias("facility"), F.nullif(F.regexp_extract(text, f"(?imd)^{SERVICE}", 1), F.lit("")).alias("service")]


def demographics(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, name, mrn, dob) of the pages with a patient header; what is absent stays null."""
    t = F.col("text")
    got = lambda rx: F.nullif(F.trim(F.regexp_extract(t, rx, 1)), F.lit(""))
    dob = F.regexp_extract(t, r"\bDOB:\s*(\d{2}/\d{2}/\d{4})", 1)
    d = X.page_rows(pages).select(
        "doc_id", "page_no", F.coalesce(got(r"(?md)^[ \t]*Patient:[ \t]*(.+?)[ \t]{2,}\S"), got(r"(?md)^[ \t]*Patient:[ \t]*(\S.*?)[ \t]*$")).alias("name"), got(r"\bMRN:\s*([A-Za-z0-9\-]+)").alias("mrn"),
        F.when(dob != "", F.concat_ws("-", F.substring(dob, 7, 4), F.substring(dob, 1, 2), F.substring(dob, 4, 2))).alias("dob"),
    )
    return d.where("name is not null or mrn is not null or dob is not null")


def parsed(pages: DataFrame, analytes: DataFrame) -> DataFrame:
    """All facts of all pages: lab rows of lab pages, prescription rows of pharmacy pages, encounters of every page."""
    p = X.page_rows(pages).withColumn("kind_now", T.document_kind(F.col("text")))
    none = lambda t: F.lit(None).cast(t)
    lab = lab_rows(p.where("kind_now = 'lab'"), analytes).select("doc_id", "page_no", F.lit("lab").alias("kind"), "name", "value", "unit", "time_iso", "loinc", "char_start", "char_end")
    med = rx_rows(p.where("kind_now = 'rx'")).select("doc_id", "page_no", F.lit("med").alias("kind"), "name", none("double").alias("value"), none("string").alias("unit"), "time_iso", none("string").alias("loinc"), "char_start", "char_end")
    enc = encounter_facts(p).select("doc_id", "page_no", F.lit("encounter").alias("kind"), "name", none("double").alias("value"), none("string").alias("unit"), "time_iso", none("string").alias("loinc"), "char_start", "char_end")
    return lab.unionByName(med).unionByName(enc)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The table's pages and the fixed pages of the layouts that it lacks."""
    extra = dims.rows(spark, LAYOUT_PAGES, "doc_id bigint, page_no int, text string")
    return read(spark, sf, "pages").select("doc_id", "page_no", "text").unionByName(extra)


def q_lab_rows(spark: SparkSession, sf: str) -> DataFrame:
    return lab_rows(read(spark, sf, "pages"), read(spark, sf, "analytes"))


def q_rx_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rx_rows(read(spark, sf, "pages"))


def encounter_anchors(spark: SparkSession, sf: str) -> DataFrame:
    a = anchors(_pages(spark, sf))
    one = lambda k: a.where(F.col(k).isNotNull()).select("doc_id", "page_no", F.lit(k).alias("anchor"), f"{k}.iso", f"{k}.at", f"{k}.raw")
    return reduce(DataFrame.unionByName, map(one, ANCHORS))


def q_encounter_facts(spark: SparkSession, sf: str) -> DataFrame:
    return encounter_facts(_pages(spark, sf))


def admissions(spark: SparkSession, sf: str) -> DataFrame:
    """Only the stays."""
    return encounter_facts(_pages(spark, sf)).where("enc_type = 'inpatient'").select("doc_id", "page_no", "name", "admit", "discharge")


def demographics_parse(spark: SparkSession, sf: str) -> DataFrame:
    return demographics(read(spark, sf, "pages"))


def facility_service(spark: SparkSession, sf: str) -> DataFrame:
    return X.page_rows(_pages(spark, sf)).select("doc_id", "page_no", *banner(F.col("text")))


def parsed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(_pages(spark, sf), read(spark, sf, "analytes"))


def slice_back(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed lab and drug facts whose characters are not their name: none, if offsets are right."""
    p = parsed(_pages(spark, sf), read(spark, sf, "analytes")).where("kind <> 'encounter'")
    t = p.join(X.page_rows(_pages(spark, sf)), ["doc_id", "page_no"])
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.expr("substring(text, char_start + 1, char_end - char_start)") != F.col("name")).alias("wrong"))


_FIX = f"fix(doc_id, page_no, text) as ({dims.sql_rows(LAYOUT_PAGES)}),\n"
_ALL = X.LINES_SQL.replace("from pages where text is not null", "from (select doc_id, page_no, text from pages union all select * from fix) where text is not null")
_CELLS = rf"c as (select *, {X.cells_sql('line')} cells from l where regexp_matches(line, '\S\s{{2,}}\S') and not regexp_matches(line, '{RULER}'))"
_NUM = f"regexp_matches(x, '^{T.NUMBER}$')"
_COLL = ANCHORS["collected"].replace(r"Collected\s*:?", "Collected:")
_LOW, _HIGH = X.range_sql("rg")
_LAB = rf"""{_CELLS}, k as (select lower(trim(regexp_replace(display, '\s+', ' ', 'g'))) name_key, min(loinc) loinc from analytes group by 1),
b as (select c.*, cells[1] "name", loinc, cells[2:] rest from c join k on lower(trim(regexp_replace(cells[1], '\s+', ' ', 'g'))) = name_key where len(cells) >= 2),
b2 as (select *, list_position(list_transform(rest, lambda x: {_NUM}), true) k from b),
b3 as (select *, list_filter(rest[k + 1:], lambda x: not regexp_matches(x, '^(?:[HLAhla]|[A-Za-z])$')) after from b2 where k > 0),
b4 as (select *, list_filter(after, lambda x: regexp_matches(x, '{T.RANGE}'))[-1] rg, list_filter(after, lambda x: not regexp_matches(x, '{T.RANGE}'))[1] unit, try_cast(regexp_replace(rest[k], '^[<>\s]+', '') as double) as value from b3),
b5 as (select b4.*, {_LOW} ref_low, {_HIGH} ref_high, {X.us_date_sql(f"regexp_extract(p.text, '{_COLL}', 1)")} time_iso, cast(start + instr(line, "name") - 1 as integer) char_start from b4 join p on b4.doc_id = p.doc_id and b4.page_no = p.page_no),
lab as (select *, cast(char_start + length("name") as integer) char_end from b5)"""
_RX = rf"""x0 as (select *, cells[2:] rest from c where len(cells) >= 2),
x1 as (select *, regexp_matches(rest[-1], '^{T.US_DATE}$') dated from x0), x2 as (select *, case when dated then rest[:-2] else rest end body from x1),
x3 as (select *, list_position(list_transform(body, lambda x: regexp_matches(x, '^{T.PLAIN}\s+\S')), true) k, cells[1] "name" from x2),
rx as (select doc_id, page_no, cast(start + instr(line, "name") - 1 as integer) char_start, cast(start + instr(line, "name") - 1 + length("name") as integer) char_end, "name", body[k] dose, nullif(trim(array_to_string(body[k + 1:], ' ')), '') frequency, case when dated then {X.us_date_sql('rest[-1]')} end time_iso from x3 where k > 0)"""


def _anchor_sql(k: str) -> str:
    hit, raw = f"regexp_extract(line, '{ANCHORS[k]}', 0)", f"regexp_extract(line, '{ANCHORS[k]}', 1)"
    return f"select doc_id, page_no, start, '{k}' anchor, {X.us_date_sql(raw)} iso, cast(start + instr(line, {hit}) - 1 + length({hit}) - length({raw}) as integer) \"at\", {raw} raw from l where {X.us_date_sql(raw)} is not null"


_ANCHOR = "an as (" + " union all ".join(map(_anchor_sql, ANCHORS)) + ")"
_FAC = FACILITY.replace("'", "''")
_ENC = f"""{_ANCHOR}, ad as (select * from an where anchor = 'admit'), di as (select * from an where anchor = 'discharge'),
st as (
  select d.doc_id, d.page_no, 0 phase, a.iso admit, a."at" a_at, a.raw a_raw, d.iso discharge, d."at" d_at, d.raw d_raw from di d join ad a on d.doc_id = a.doc_id and d.page_no = a.page_no and d.start = a.start
  union all
  select d.doc_id, d.page_no, 1, a.iso, a."at", a.raw, d.iso, d."at", d.raw from di d left join ad a on d.doc_id = a.doc_id and d.page_no = a.page_no and a.start < d.start
  where not exists (select 1 from ad z where z.doc_id = d.doc_id and z.page_no = d.page_no and z.start = d.start)
  qualify row_number() over (partition by d.doc_id, d.page_no, d.start order by a.start desc nulls last) = 1),
st2 as (
  select * from st where phase = 0 or a_at is not null or not exists (select 1 from ad z where z.doc_id = st.doc_id and z.page_no = st.page_no)
  union all select doc_id, page_no, 2, iso, "at", raw, null, null, null from ad where not exists (select 1 from st where st.doc_id = ad.doc_id and st.page_no = ad.page_no and st.a_at = ad."at")),
al as (
  select doc_id, page_no, 0 src, phase, coalesce(admit, discharge) iso, coalesce(a_at, d_at) "at", coalesce(a_raw, d_raw) raw, coalesce(d_at, a_at) o, admit, discharge, 'inpatient' enc_type from st2
  union all select doc_id, page_no, case anchor when 'visit' then 1 else 2 end, 0, iso, "at", raw, "at", iso, iso, 'outpatient' from an where anchor in ('visit', 'collected')),
al2 as (select * from al qualify src = min(src) over (partition by doc_id, page_no)),
al3 as (select *, row_number() over (partition by doc_id, page_no order by phase, o) - 1 ordinal from al2),
enc as (select al3.doc_id, al3.page_no, al3.doc_id || '#p' || al3.page_no || ':' || enc_type || ':' || iso || case when ordinal > 0 then '#' || ordinal else '' end "name", iso time_iso, admit, discharge, enc_type,
  nullif(regexp_extract(p.text, '(?m){_FAC}', 1), '') facility, nullif(regexp_extract(p.text, '(?im)^{SERVICE}', 1), '') service, "at" char_start, cast("at" + length(raw) as integer) char_end
  from al3 join p on al3.doc_id = p.doc_id and al3.page_no = p.page_no)"""
_PARSED = rf"""with {_FIX}{_ALL}, kd as (select doc_id, page_no, {X.kind_sql('text')} kd from p), {_LAB}, {_RX}, {_ENC},
parsed as (select lab.doc_id, lab.page_no, 'lab' kind, "name", value, unit, time_iso, loinc, char_start, char_end from lab join kd on lab.doc_id = kd.doc_id and lab.page_no = kd.page_no and kd = 'lab'
  union all select rx.doc_id, rx.page_no, 'med', "name", null, null, time_iso, null, char_start, char_end from rx join kd on rx.doc_id = kd.doc_id and rx.page_no = kd.page_no and kd = 'rx'
  union all select doc_id, page_no, 'encounter', "name", null, null, time_iso, null, char_start, char_end from enc)"""

QUERIES = {
    "lab_rows": q_lab_rows, "rx_rows": q_rx_rows, "encounter_anchors": encounter_anchors, "encounter_facts": q_encounter_facts, "admissions": admissions, "demographics_parse": demographics_parse, "facility_service": facility_service,
    "parsed_documents": parsed_documents, "slice_back": slice_back,
}
ORACLE = {
    "lab_rows": f"""with {X.LINES_SQL}, {_LAB} select doc_id, page_no, char_start, char_end, "name", value, unit, time_iso, loinc, ref_low, ref_high,
        case when ref_low is not null and value < ref_low then true when ref_high is not null and value > ref_high then true when ref_low is not null or ref_high is not null then false end abnormal from lab""",
    "rx_rows": f"with {X.LINES_SQL}, {_CELLS}, {_RX} select * from rx",
    "encounter_anchors": f'with {_FIX}{_ALL}, {_ANCHOR} select doc_id, page_no, anchor, iso, "at", raw from an',
    "encounter_facts": f"with {_FIX}{_ALL}, {_ENC} select * from enc",
    "admissions": f"with {_FIX}{_ALL}, {_ENC} select doc_id, page_no, \"name\", admit, discharge from enc where enc_type = 'inpatient'",
    "demographics_parse": rf"""with p as (select doc_id, page_no, min(text) as text from pages where text is not null group by 1, 2), d as (select doc_id, page_no,
        coalesce(nullif(trim(regexp_extract(text, '(?m)^[ \t]*Patient:[ \t]*(.+?)[ \t]{{2,}}\S', 1)), ''), nullif(trim(regexp_extract(text, '(?m)^[ \t]*Patient:[ \t]*(\S.*?)[ \t]*$', 1)), '')) "name", nullif(trim(regexp_extract(text, '\bMRN:\s*([A-Za-z0-9\-]+)', 1)), '') mrn,
        nullif(regexp_extract(text, '\bDOB:\s*(\d{{2}}/\d{{2}}/\d{{4}})', 1), '') b from p)
        select doc_id, page_no, "name", mrn, substr(b, 7, 4) || '-' || substr(b, 1, 2) || '-' || substr(b, 4, 2) dob from d where "name" is not null or mrn is not null or b is not null""",
    "facility_service": f"with {_FIX}{_ALL} select doc_id, page_no, nullif(regexp_extract(p.text, '(?m){_FAC}', 1), '') facility, nullif(regexp_extract(p.text, '(?im)^{SERVICE}', 1), '') service from p",
    "parsed_documents": f"{_PARSED} select * from parsed",
    "slice_back": f"{_PARSED} select kind, count(*) n, count(*) filter (where substr(text, char_start + 1, char_end - char_start) <> \"name\") wrong from parsed join p on parsed.doc_id = p.doc_id and parsed.page_no = p.page_no where kind <> 'encounter' group by 1",
}
