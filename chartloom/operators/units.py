"""Quantities in different units, brought to each analyte's common unit by joins and arithmetic.

The unit comes from the unit column, else the raw text of the extraction, else the analyte's printed name, else the
page text at the row's offsets, else the source's default where one is given; the first that names a unit of the
analyte's kind wins. Of differing copies of a page the smallest text counts. Defined results: no row
without a readable number, without a known analyte or without a unit of a fitting kind anywhere (meaningless units
such as 'arb.' or '?' are none); no row where the number stays as it is; repeated page rows count once; a row whose
analyte code is null takes the code that most rows of the same printed name carry (ties: the smallest code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.dims import rows as dims_rows
from chartloom.operators.texts import page_rows
from chartloom.session import written
from chartloom.sources.tables import read

# Fixed values: (kind, factor to the kind's base unit, offset added before the factor, spellings without blanks in lower case with u for micro).
UNIT_SPELLINGS = [
    ("massconc", 1.0, 0.0, "mg/dl mg% mg/100ml mgperdl"),
    ("massconc", 1000.0, 0.0, "g/dl g% g/100ml gperdl"),
    ("massconc", 100.0, 0.0, "g/l gperl"),
    ("massconc", 0.1, 0.0, "mg/l ug/ml mcg/ml mgperl"),
    ("massconc", 0.001, 0.0, "ug/dl mcg/dl"),
    ("massconc", 0.0001, 0.0, "ug/l mcg/l ng/ml"),
    ("massconc", 0.000001, 0.0, "ng/dl"),
    ("massconc", 0.0000001, 0.0, "ng/l pg/ml"),
    ("molar", 1.0, 0.0, "mmol/l mm"),
    ("molar", 1000.0, 0.0, "mol/l m"),
    ("molar", 0.001, 0.0, "umol/l um"),
    ("molar", 0.000001, 0.0, "nmol/l nm"),
    ("equivalent", 1.0, 0.0, "meq/l"),
    ("enzyme", 1.0, 0.0, "u/l iu/l"),
    ("enzyme", 1000.0, 0.0, "u/ml iu/ml ku/l"),
    ("enzyme", 60.0, 0.0, "ukat/l"),
    ("enzyme", 0.06, 0.0, "nkat/l"),
    ("hormone", 1.0, 0.0, "miu/l mu/l uiu/ml uu/ml"),
    ("hormone", 1000.0, 0.0, "iu/l u/l miu/ml"),
    ("hormone", 0.01, 0.0, "uiu/dl"),
    ("count", 1.0, 0.0, "k/ul 10^3/ul 10^9/l x10e9/l x10^9/l x10e3/ul g/l"),
    ("count", 0.001, 0.0, "cells/ul /ul /mm3 cells/mm3 10^6/l x10e6/l"),
    ("mass", 1.0, 0.0, "kg kgs kilograms kilogram"),
    ("mass", 0.001, 0.0, "g grams gram"),
    ("mass", 0.45359237, 0.0, "lb lbs pounds pound"),
    ("mass", 0.028349523125, 0.0, "oz ounces ounce"),
    ("length", 1.0, 0.0, "cm cms centimetres centimeters centimetre"),
    ("length", 100.0, 0.0, "m metres meters"),
    ("length", 0.1, 0.0, "mm millimetres"),
    ("length", 2.54, 0.0, "in inches inch"),
    ("length", 30.48, 0.0, "ft feet"),
    ("pressure", 1.0, 0.0, "mmhg mm[hg]"),
    ("pressure", 10.0, 0.0, "cmhg"),
    ("pressure", 7.500616827041697, 0.0, "kpa"),
    ("temperature", 1.0, 0.0, "°c c degc cel celsius"),
    ("temperature", 0.5555555555555556, -32.0, "°f f degf fahrenheit"),
    ("temperature", 1.0, -273.15, "k kelvin"),
]
# Charges per ion where milliequivalents and millimoles differ.
CHARGES = {"calcium": 2.0, "magnesium": 2.0}
# Kinds that a value of each common-unit kind may come in.
ACCEPTED = {"massconc": ["massconc", "molar", "equivalent"], "molar": ["molar", "equivalent", "massconc"]}
COMMON_KIND = "massconc molar enzyme hormone count mass length pressure temperature".split()

NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"
RAW = rf"^(?:.*: |= *)?({NUMBER})\s*\[?([^\]]*)\]?\s*$"
IN_NAME = r"(?:, in |\()([^()]+?)\)?\s*$"
ROW_UNIT = rf"^.*?\s\s+{NUMBER}\s+(\S+(?: \S+){{0,2}})"
ROW_NAME = rf"^(.*?)\s\s+{NUMBER}"
VITAL_UNIT = rf"^\s*{NUMBER}\s*(\S+(?: \S+)?)\s*$"


def unit_key(c: Column) -> Column:
    """A unit's spelling without blanks, in lower case, with one letter for micro; null where blank."""
    k = F.regexp_replace(F.lower(F.regexp_replace(c, "[µμ]", "u")), r"\s+", "")
    return F.when(k != "", k)


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def spelling_table(spark: SparkSession) -> DataFrame:
    """The fixed table of spellings (about a hundred rows): source kind, spelling, factor, offset."""
    rows = [(k, s, f, o) for k, f, o, names in UNIT_SPELLINGS for s in names.split()]
    return spark.createDataFrame(rows, "kind string, spelling string, factor double, shift double")


def analyte_table(spark: SparkSession, analytes: DataFrame) -> DataFrame:
    """Each analyte and accepted spelling with what a value is multiplied by after adding the shift."""
    s = spelling_table(spark)
    accepted = spark.createDataFrame([(k, a) for k in COMMON_KIND for a in ACCEPTED.get(k, [k])], "common_kind string, kind string")
    order = F.create_map(*[x for i, k in enumerate(COMMON_KIND) for x in (F.lit(k), F.lit(i))])
    charge = F.coalesce(*[F.when(F.lower("display").contains(n), F.lit(v)) for n, v in CHARGES.items()], F.lit(1.0))
    common = (
        analytes.select("loinc", "display", F.when(~F.isnan("molar_mass"), F.col("molar_mass")).alias("molar_mass"), "decimals", unit_key(F.col("unit")).alias("spelling"))
        .join(F.broadcast(s), "spelling")
        .where(order[F.col("kind")].isNotNull())
        .withColumn("n", F.row_number().over(Window.partitionBy("loinc").orderBy(order[F.col("kind")])))
        .where("n = 1")
        .select("loinc", "display", "molar_mass", "decimals", F.col("kind").alias("common_kind"), F.col("factor").alias("common_factor"), F.col("shift").alias("common_shift"), charge.alias("charge"))
    )
    to_base = (
        F.when(F.col("kind") == F.col("common_kind"), F.lit(1.0))
        .when((F.col("common_kind") == "molar") & (F.col("kind") == "equivalent"), 1.0 / F.col("charge"))
        .when((F.col("common_kind") == "molar") & (F.col("kind") == "massconc"), 10.0 / F.col("molar_mass"))
        .when((F.col("common_kind") == "massconc") & (F.col("kind") == "molar"), F.col("molar_mass") / 10.0)
        .when((F.col("common_kind") == "massconc") & (F.col("kind") == "equivalent"), F.col("molar_mass") / 10.0 / F.col("charge"))
    )
    return (
        common.join(F.broadcast(accepted), "common_kind")
        .join(F.broadcast(s), "kind")
        .withColumn("to_base", to_base)
        .where("to_base is not null")
        .select("loinc", "spelling", "decimals", "shift", "common_shift", (F.col("factor") * F.col("to_base") / F.col("common_factor")).alias("factor"))
    )


def convert(facts: DataFrame, lab_analytes: DataFrame, pages: DataFrame, analytes: DataFrame, defaults: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Rows (tbl, row_id, loinc, value, unit, converted, decimals) of every value with a known unit, also equal ones.

    defaults are (table, analyte code, unit) of sources whose values without any unit are known to be in one; the test
    tables have none, as their rows without a unit may be in any.
    """
    spark = facts.sparkSession
    number = lambda c: F.regexp_replace(F.nullif(c, F.lit("")), ",", ".").try_cast("double")
    raw = F.get_json_object("meta", "$.raw")
    f = facts.where("kind in ('lab', 'vital')").select(
        F.lit("facts").alias("tbl"), F.col("fact_id").cast("bigint").alias("row_id"), F.nullif(F.trim("loinc"), F.lit("")).alias("loinc"), F.col("name").alias("label"),
        F.coalesce(F.when(~F.isnan("value"), F.col("value")), number(F.regexp_extract(raw, RAW, 1))).alias("value"),
        unit_key(F.col("unit")).alias("u1"), unit_key(F.regexp_extract(raw, RAW, 2)).alias("u2"), "doc_id", "page_no", "char_start", "char_end", "kind",
    )
    none = lambda t: F.lit(None).cast(t)
    l = lab_analytes.select(
        F.lit("lab_analytes").alias("tbl"), F.col("row_id").cast("bigint").alias("row_id"), F.nullif(F.trim("loinc"), F.lit("")).alias("loinc"), F.col("display").alias("label"),
        F.when(~F.isnan("value"), F.col("value")).alias("value"), unit_key(F.col("unit")).alias("u1"), none("string").alias("u2"),
        none("bigint").alias("doc_id"), none("int").alias("page_no"), none("int").alias("char_start"), none("int").alias("char_end"), F.lit("lab").alias("kind"),
    )
    known = F.broadcast(spelling_table(spark).select(F.col("spelling").alias("u3")).distinct())
    rows = f.unionByName(l).where("value is not null")
    rows = rows.withColumn("u3", unit_key(F.regexp_extract("label", IN_NAME, 1))).join(known.withColumn("named", F.lit(True)), "u3", "left")
    rows = rows.withColumn("label", name_key(F.when(F.col("named"), F.regexp_replace("label", r"\s*(, in [^()]+|\([^()]+\))\s*$", "")).otherwise(F.col("label"))))
    # The printed names' codes: counted over all rows, pre-aggregated, then one row a name, written so that its true size
    # decides whether it is broadcast (names are typed, so no bound is known before).
    codes = written(
        rows.where("loinc is not null").groupBy("label", "loinc").agg(F.count("*").alias("n"))
        .unionByName(analytes.select(name_key(F.col("display")).alias("label"), "loinc", F.lit(1).cast("bigint").alias("n")))
        .groupBy("label").agg(F.max(F.struct("n", F.col("loinc").alias("code"))).alias("m")).select("label", F.col("m.code").alias("code"))
    )
    # One row an analyte with all of its spellings; the spellings are literals, the analytes a fixed table.
    entry = F.struct("spelling", F.struct("spelling", "factor", "shift", "common_shift", "decimals"))
    table = F.broadcast(analyte_table(spark, analytes).groupBy("loinc").agg(F.map_from_entries(F.collect_list(entry)).alias("units")))
    coded = rows.join(codes, "label", "left").withColumn("loinc", F.coalesce("loinc", "code")).join(table, "loinc")
    fits = lambda u: F.try_element_at("units", u)
    given = dims_rows(spark, defaults or [], "tbl string, loinc string, given string")
    keep = ["tbl", "row_id", "loinc", "value", "m", "kind", "doc_id", "page_no", "char_start", "char_end"]
    by_column = written(coded.withColumn("m", F.coalesce(fits(F.col("u1")), fits(F.col("u2")), fits(F.col("u3")))).select(*keep))
    # Rows still without a unit read it from the page at their offsets, else take their source's default.
    page = page_rows(pages)
    located = F.col("doc_id").isNotNull() & F.col("page_no").isNotNull() & (F.col("char_end") > F.col("char_start"))
    text = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    open_ = by_column.where("m is null").drop("m")
    at = open_.where(located).join(page, ["doc_id", "page_no"]).select("tbl", "row_id", "loinc", "value", "kind", text.alias("t"))
    at = at.unionByName(open_.where(~located | located.isNull()).select("tbl", "row_id", "loinc", "value", "kind", F.lit(None).cast("string").alias("t"))) if defaults else at
    u4 = unit_key(F.when(F.col("kind") == "vital", F.regexp_extract("t", VITAL_UNIT, 1)).otherwise(F.regexp_extract("t", ROW_UNIT, 1)))
    u5 = unit_key(F.regexp_extract(F.regexp_extract("t", ROW_NAME, 1), IN_NAME, 1))
    at = at.join(table, "loinc").join(F.broadcast(given), ["tbl", "loinc"], "left").withColumn("m", F.coalesce(fits(u4), fits(u5), fits(F.col("given"))))
    out = by_column.where("m is not null").select(*keep[:5]).unionByName(at.where("m is not null").select(*keep[:5]))
    return out.select("tbl", "row_id", "loinc", "value", F.col("m.spelling").alias("unit"), ((F.col("value") + F.col("m.shift")) * F.col("m.factor") - F.col("m.common_shift")).alias("converted"), F.col("m.decimals").alias("decimals"))


def changed(converted: DataFrame) -> DataFrame:
    """Only the rows whose number changes, scaled to an integer of the analyte's decimals (halves go up)."""
    return converted.where(F.abs(F.col("converted") - F.col("value")) > 1e-9 * F.greatest(F.abs("value"), F.lit(1e-6))).select(
        "tbl", "row_id", F.floor(F.col("converted") * F.pow(F.lit(10.0), F.col("decimals")) + 0.5).cast("bigint").alias("scaled")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(convert(*[read(spark, sf_dir, t) for t in ("facts", "lab_analytes", "pages", "analytes")]))


def p6_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each analyte has in each recorded unit, and how many of them change."""
    rows = convert(*[read(spark, sf_dir, t) for t in ("facts", "lab_analytes", "pages", "analytes")])
    return rows.groupBy("loinc", "unit").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("converted") - F.col("value")) > 1e-9 * F.greatest(F.abs("value"), F.lit(1e-6))).alias("n_changed"))



def _sql() -> str:
    """The same conversion in DuckDB's SQL, over the fixed tables above."""
    v = ", ".join(f"('{k}', '{x}', cast({f!r} as double), cast({o!r} as double))" for k, f, o, names in UNIT_SPELLINGS for x in names.split())
    kinds = ", ".join(f"('{k}', {i})" for i, k in enumerate(COMMON_KIND))
    acc = ", ".join(f"('{k}', '{a}')" for k in COMMON_KIND for a in ACCEPTED.get(k, [k]))
    charge = "case " + " ".join(f"when contains(lower(display), '{n}') then {x!r}" for n, x in CHARGES.items()) + " else 1.0 end"
    key = lambda c: f"nullif(regexp_replace(lower(regexp_replace({c}, '[µμ]', 'u', 'g')), '\\s+', '', 'g'), '')"
    name = lambda c: f"regexp_replace(trim(lower({c})), '\\s+', ' ', 'g')"
    raw = "json_extract_string(meta, '$.raw')"
    pick = lambda us: "coalesce(" + ", ".join(f"m{u[1]}.m" for u in us) + ")"
    joins = lambda us: " ".join(f"left join tab m{u[1]} on m{u[1]}.loinc = r.loinc and m{u[1]}.spelling = r.{u}" for u in us)
    return f"""
with s(kind, spelling, factor, shift) as (values {v}), k(kind, o) as (values {kinds}), acc(common_kind, kind) as (values {acc}),
common as (
  select loinc, display, case when not isnan(molar_mass) then molar_mass end mm, decimals, s.kind common_kind, s.factor cf, s.shift cs, cast({charge} as double) ch
  from analytes a join s on s.spelling = {key("a.unit")} join k on k.kind = s.kind
  qualify row_number() over (partition by loinc order by k.o) = 1),
tab as (
  select loinc, spelling, {{'u': spelling, 'f': factor * b / cf, 's': shift, 'cs': cs, 'd': decimals}} m from (
    select c.*, s.*, case when s.kind = common_kind then 1.0 when common_kind = 'molar' and s.kind = 'equivalent' then 1.0 / ch
      when common_kind = 'molar' and s.kind = 'massconc' then 10.0 / mm when common_kind = 'massconc' and s.kind = 'molar' then mm / 10.0
      when common_kind = 'massconc' and s.kind = 'equivalent' then mm / 10.0 / ch end b
    from common c join acc using (common_kind) join s on s.kind = acc.kind) where b is not null),
src as (
  select 'facts' tbl, cast(fact_id as bigint) row_id, nullif(trim(loinc), '') loinc, name label,
    coalesce(case when not isnan(value) then value end, try_cast(replace(nullif(regexp_extract({raw}, '{RAW}', 1), ''), ',', '.') as double)) as value,
    {key("unit")} u1, {key(f"regexp_extract({raw}, '{RAW}', 2)")} u2, doc_id, page_no, char_start, char_end, kind from facts where kind in ('lab', 'vital')
  union all select 'lab_analytes', cast(row_id as bigint), nullif(trim(loinc), ''), display, case when not isnan(value) then value end, {key("unit")}, null, null, null, null, null, 'lab' from lab_analytes),
named as (select * exclude (label), {key(f"regexp_extract(label, '{IN_NAME}', 1)")} u3, label from src where value is not null),
rows_ as (select * exclude (label), {name("case when u3 in (select spelling from s) then regexp_replace(label, '\\s*(, in [^()]+|\\([^()]+\\))\\s*$', '') else label end")} as label from named),
codes as (
  select label, max_by(loinc, (n, loinc)) code from (
    select label, loinc, sum(n) n from (select label, loinc, 1 n from rows_ where loinc is not null) group by all
    union all select {name("display")}, loinc, 1 from analytes) group by label),
coded as (select r.* exclude (loinc), coalesce(r.loinc, code) loinc from rows_ r left join codes using (label)),
a as (select r.*, {pick(["u1", "u2", "u3"])} m from coded r {joins(["u1", "u2", "u3"])} where r.loinc is not null),
t as (
  select distinct tbl, row_id, loinc, value, a.kind, substring(text, char_start + 1, char_end - char_start) t
  from a join (select distinct doc_id, page_no, text from pages where text is not null) p on a.doc_id = p.doc_id and a.page_no = p.page_no where m is null and char_end > char_start),
t2 as (select *, {key(f"case when kind = 'vital' then regexp_extract(t, '{VITAL_UNIT}', 1) else regexp_extract(t, '{ROW_UNIT}', 1, 's') end")} u4,
  {key(f"regexp_extract(regexp_extract(t, '{ROW_NAME}', 1, 's'), '{IN_NAME}', 1)")} u5 from t),
b as (select r.*, {pick(["u4", "u5"])} m from t2 r {joins(["u4", "u5"])}),
c as (
  select tbl, row_id, loinc, value, m.u unit, (value + m.s) * m.f - m.cs converted, m.d decimals
  from (select tbl, row_id, loinc, value, m from a where m is not null union all select tbl, row_id, loinc, value, m from b where m is not null))
"""


_CHANGES = "abs(converted - value) > 1e-9 * greatest(abs(value), 1e-6)"
QUERIES = {"p6_found": p6_found, "p6_by_unit": p6_by_unit}
ORACLE = {
    "p6_found": _sql() + f"select tbl, row_id, cast(floor(converted * pow(10.0, decimals) + 0.5) as bigint) scaled from c where {_CHANGES}",
    "p6_by_unit": _sql() + f"select loinc, unit, count(*) n, count(*) filter (where {_CHANGES}) n_changed from c group by all",
}
