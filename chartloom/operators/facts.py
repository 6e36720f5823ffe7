"""Extracted observations as rows: validation, flags, codes, units and duplicates.

Defined results: a null or blank patient, and a kind or extractor outside its domain, is counted by `enum_guard` and is
in no chart; comparisons with a missing value or missing bounds are null (three-valued); equal observations of one
person (kind, name without case, time and value, nulls equal) are one, the first by document, page and place; repeated
rows count once; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.sources.tables import read

ORDER = ["doc_id", "page_no", "char_start", "fact_id"]


def person_key(c: Column) -> Column:
    """A patient's key without case and surrounding white space; null where blank."""
    k = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def abnormal(value: Column, low: Column, high: Column) -> Column:
    """Whether a value lies outside its bounds; null where there is nothing to compare."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).when(value < low, True).when(value > high, True).when(low.isNotNull() | high.isNotNull(), False)


def valid(facts: DataFrame) -> DataFrame:
    """The facts of known kind and extractor with their person's key `pid`."""
    return facts.where(F.col("kind").isin(dims.FACT_KINDS) & F.col("extractor").isin(dims.EXTRACTORS)).withColumn("pid", person_key(F.col("patient_id"))).where("pid is not null")


def deduplicated(facts: DataFrame) -> DataFrame:
    """One row of each observation: the map side keeps one struct a key, so hot keys shrink before the shuffle."""
    f = valid(facts).withColumn("t", F.coalesce("time_iso", F.lit("")))
    keep = [*ORDER, "name", "unit", "loinc", "ref_low", "ref_high", "negated", "meta", "extractor", "char_end"]
    first = f.groupBy("pid", "kind", F.lower("name").alias("name_key"), "time_iso", "value").agg(F.min(F.struct(*keep)).alias("s"))
    return first.select("pid", "kind", "name_key", "time_iso", F.coalesce("time_iso", F.lit("")).alias("t"), "value", *[F.col(f"s.{c}").alias(c) for c in keep])


def coded(facts: DataFrame, analytes: DataFrame) -> DataFrame:
    """facts with the analyte code of lab rows: their own, else that of their printed name; null where unmappable."""
    by_name = analytes.select(F.lower("display").alias("name_key"), F.col("loinc").alias("code_by_name")).groupBy("name_key").agg(F.min("code_by_name").alias("code_by_name"))
    own = F.when(F.trim("loinc") != "", F.trim("loinc"))
    f = facts if "name_key" in facts.columns else facts.withColumn("name_key", F.lower("name"))
    return f.join(by_name, "name_key", "left").withColumn("loinc", F.when(F.col("kind") == "lab", F.coalesce(own, "code_by_name"))).drop("code_by_name")


def abnormal_flag(spark: SparkSession, sf: str) -> DataFrame:
    f = read(spark, sf, "facts").where("kind = 'lab'")
    return f.select("fact_id", abnormal(F.col("value"), F.col("ref_low"), F.col("ref_high")).alias("abnormal_now"), F.col("abnormal").alias("abnormal_then"))


def enum_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each kind and extractor, and whether both are known."""
    return read(spark, sf, "facts").groupBy("kind", "extractor").agg(F.count("*").alias("n")).select("kind", "extractor", "n", F.coalesce(F.col("kind").isin(dims.FACT_KINDS) & F.col("extractor").isin(dims.EXTRACTORS), F.lit(False)).alias("known"))


def schema_guard_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that lack a column which their collection requires."""
    f = read(spark, sf, "facts")
    need = {"lab": ["name", "value", "time_iso"], "vital": ["name", "value", "time_iso"], "med": ["name", "time_iso"], "dx": ["name", "time_iso"]}
    lacks = F.array_compact(F.array(*[F.when((F.col("kind") == k) & F.col(c).isNull(), F.lit(c)) for k, cs in need.items() for c in cs]))
    return f.select("kind", F.explode(lacks).alias("missing")).groupBy("kind", "missing").agg(F.count("*").alias("n"))


def unit_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical unit and value of each recorded unit that the fixed table knows; null for others."""
    u = F.broadcast(dims.rows(spark, dims.UNITS, "unit_key string, canonical string, factor double"))  # 12 literal rows
    f = read(spark, sf, "facts").where("value is not null and unit is not null").withColumn("unit_key", F.lower(F.trim("unit")))
    return f.join(u, "unit_key", "left").select("fact_id", "canonical", (F.col("value") * F.col("factor")).alias("canonical_value"))


def unit_comparable(spark: SparkSession, sf: str) -> DataFrame:
    """Creatinine-like molar values per litre brought to mg/dL for comparison, all others as they are."""
    u = F.lower(F.trim("unit"))
    return read(spark, sf, "lab_analytes").where("value is not null").select("row_id", F.when(u.isin("umol/l", "µmol/l"), F.col("value") / 88.4).otherwise(F.col("value")).alias("comparable"))


def analyte_code(spark: SparkSession, sf: str) -> DataFrame:
    """Lab rows with their code, and whether it came from the row, from the printed name or from nowhere."""
    f = read(spark, sf, "facts").where("kind = 'lab'").withColumn("own", F.when(F.trim("loinc") != "", F.trim("loinc")))
    c = coded(f, read(spark, sf, "analytes"))
    return c.select("fact_id", "loinc", F.when(F.col("own").isNotNull(), "row").when(F.col("loinc").isNotNull(), "name").otherwise("none").alias("source"))


def analyte_enrich_left(spark: SparkSession, sf: str) -> DataFrame:
    """Lab rows with display and direction of their analyte; an unknown code keeps the row, shows its own name and counts as worse when higher."""
    a = read(spark, sf, "analytes").select("loinc", F.col("display").alias("known"), "hi_is_worse")
    f = read(spark, sf, "lab_analytes").select("row_id", "loinc", "display")
    return f.join(a, "loinc", "left").select("row_id", F.coalesce("known", "display", "loinc").alias("display"), F.coalesce("hi_is_worse", F.lit(True)).alias("hi_is_worse"), F.col("known").isNotNull().alias("known"))


def fact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(read(spark, sf, "facts")).select("pid", "fact_id")


def facts_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Facts and characters of evidence by kind and extractor, with totals (rollup)."""
    f = read(spark, sf, "facts").rollup("kind", "extractor").agg(F.count("*").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    return f.select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("extractor", F.lit("all")).alias("extractor"), "n", "chars")


def result_flag(value: Column, low: Column, high: Column) -> Column:
    """H above, L below, empty within or without bounds; null without a value."""
    return F.when(value.isNull(), F.lit(None).cast("string")).when(value > high, "H").when(value < low, "L").otherwise("")


def result_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Printed result rows with their flag as it follows from value and bounds, and as printed."""
    l = read(spark, sf, "lab_analytes")
    return l.select("row_id", result_flag(F.col("value"), F.col("ref_low"), F.col("ref_high")).alias("flag_now"), F.col("flag").alias("flag_printed"))


def birth_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole years of age on the first of January 2026, and the birth date in American order, where the date is ISO."""
    d = F.try_to_date(F.when(F.col("dob").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("dob")))
    p = read(spark, sf, "patients").select("id", d.alias("d")).where("d is not null and d <= date'2026-01-01'")
    return p.select("id", F.floor(F.months_between(F.lit("2026-01-01").cast("date"), "d") / 12).cast("int").alias("age"), F.date_format("d", "MM/dd/yyyy").alias("us_date"))


def facts_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's facts in the order of page and place, as their number among the document's."""
    from pyspark.sql import Window

    # A document's facts are bounded by its text.
    w = Window.partitionBy("doc_id").orderBy("page_no", "char_start", "fact_id")
    return read(spark, sf, "facts").where("doc_id is not null").select("doc_id", "fact_id", F.row_number().over(w).alias("place"))


def fact_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """meta as typed fields; unknown keys are ignored, text that is no JSON gives nulls."""
    m = F.from_json("meta", "code string, dose string, raw string, frequency string", {"mode": "PERMISSIVE"})
    return read(spark, sf, "facts").where("meta is not null").select("fact_id", m["code"].alias("code"), m["dose"].alias("dose"), m["raw"].alias("raw"))


_KINDS = "(" + ", ".join(f"'{k}'" for k in dims.FACT_KINDS) + ")"
_EXTR = "(" + ", ".join(f"'{k}'" for k in dims.EXTRACTORS) + ")"
#: The deduplicated facts `d` in SQL.
DEDUP_SQL = f"""
f as (select *, nullif(lower(trim(patient_id)), '') pid, coalesce(time_iso, '') t, lower(name) name_key from facts where kind in {_KINDS} and extractor in {_EXTR}),
d as (select * from f where pid is not null
      qualify row_number() over (partition by pid, kind, name_key, time_iso, value order by doc_id nulls first, page_no nulls first, char_start nulls first, fact_id) = 1)"""

QUERIES = {
    "abnormal_flag": abnormal_flag, "enum_guard": enum_guard, "schema_guard_violations": schema_guard_violations, "unit_normalise": unit_normalise, "unit_comparable": unit_comparable,
    "analyte_code": analyte_code, "analyte_enrich_left": analyte_enrich_left, "fact_dedup": fact_dedup, "facts_by_kind": facts_by_kind, "facts_of_documents": facts_of_documents, "fact_from_json": fact_from_json,
    "result_flags": result_flags, "birth_ages": birth_ages,
}
ORACLE = {
    "result_flags": "select row_id, case when value is null then null when ref_high is not null and value > ref_high then 'H' when ref_low is not null and value < ref_low then 'L' else '' end flag_now, flag flag_printed from lab_analytes",
    "birth_ages": r"""select id, cast(date_sub('year', d, date '2026-01-01') as integer) age, strftime(d, '%m/%d/%Y') us_date
        from (select id, try_cast(case when regexp_matches(dob, '^\d{4}-\d{2}-\d{2}$') then dob end as date) d from patients) where d <= date '2026-01-01'""",
    "abnormal_flag": """select fact_id, case when value is null then null when ref_low is not null and value < ref_low then true when ref_high is not null and value > ref_high then true
        when ref_low is not null or ref_high is not null then false end abnormal_now, abnormal abnormal_then from facts where kind = 'lab'""",
    "enum_guard": f"select kind, extractor, count(*) n, coalesce(kind in {_KINDS} and extractor in {_EXTR}, false) known from facts group by 1, 2",
    "schema_guard_violations": """select kind, missing, count(*) n from (
        select kind, 'name' missing from facts where kind in ('lab', 'vital', 'med', 'dx') and name is null union all select kind, 'time_iso' from facts where kind in ('lab', 'vital', 'med', 'dx') and time_iso is null
        union all select kind, 'value' from facts where kind in ('lab', 'vital') and value is null) group by 1, 2""",
    "unit_normalise": f"""with u(unit_key, canonical, factor) as ({dims.sql_rows(dims.UNITS)})
        select fact_id, canonical, value * factor canonical_value from facts left join u on lower(trim(unit)) = unit_key where value is not null and unit is not null""",
    "unit_comparable": "select row_id, case when lower(trim(unit)) in ('umol/l', 'µmol/l') then value / 88.4 else value end comparable from lab_analytes where value is not null",
    "analyte_code": """with a as (select lower(display) k, min(loinc) code from analytes group by 1)
        select fact_id, coalesce(nullif(trim(loinc), ''), code) loinc, case when nullif(trim(loinc), '') is not null then 'row' when code is not null then 'name' else 'none' end source
        from facts left join a on lower(name) = k where kind = 'lab'""",
    "analyte_enrich_left": """select row_id, coalesce(a.display, l.display, l.loinc) display, coalesce(a.hi_is_worse, true) hi_is_worse, a.display is not null known
        from lab_analytes l left join analytes a on l.loinc = a.loinc""",
    "fact_dedup": f"with {DEDUP_SQL} select pid, fact_id from d",
    "facts_by_kind": """select case when grouping(kind) = 1 then 'all' else kind end kind, case when grouping(extractor) = 1 then 'all' else extractor end extractor, count(*) n, cast(sum(char_end - char_start) as bigint) chars
        from facts group by rollup (kind, extractor)""",
    "facts_of_documents": "select doc_id, fact_id, row_number() over (partition by doc_id order by page_no nulls first, char_start nulls first, fact_id) place from facts where doc_id is not null",
    "fact_from_json": "select fact_id, json_extract_string(meta, '$.code') code, json_extract_string(meta, '$.dose') dose, json_extract_string(meta, '$.raw') raw from facts where meta is not null",
}
ORACLE["facts_of_documents"] = dims.as_integers(ORACLE["facts_of_documents"], "place")
