"""Charts: a person's observations as typed nodes with ids, and the encounters in which they were made.

Each step is over all persons at once, keyed by `pid`. Ids number a person's nodes of a kind in the order of time, name
and place (ranked by month, so a person with a third of all rows is not one task). An observation belongs to the first
stay (by begin) whose days include it, else to the encounter that begins at just its time, else to none; times are
compared as ISO text, an undated observation is never attributed. Overlaps are found by month, so that a long history
does not meet all observations of its person.

Defined results: lab rows without any analyte code are in no chart; undated rows stay in the chart; empty tables give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators.facts import DEDUP_SQL, coded, deduplicated, valid
from chartloom.operators.ordered import ranked
from chartloom.sources.tables import read

#: Kinds that are attributed to encounters.
ATTRIBUTED = ["lab", "med", "imaging", "note_stance", "dx"]


def _choice(c: Column, table: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), table.items(), F)


def records(facts: DataFrame, analytes: DataFrame) -> DataFrame:
    """One row of each charted observation with its node id and number within (pid, kind)."""
    d = coded(deduplicated(facts), analytes).where("kind <> 'lab' or loinc is not null").where("kind <> 'encounter'")
    r = ranked(d.withColumn("month", F.substring("t", 1, 7)), ["pid", "kind"], ["t", "name", "doc_id", "page_no", "char_start", "fact_id"], "month", "ord")
    return r.withColumn("node_id", F.format_string("%s_%04d", _choice(F.col("kind"), dims.ID_PREFIX), "ord")).drop("month")


def encounters(facts: DataFrame) -> DataFrame:
    """(pid, enc_id, ord, doc_id, start, discharge, enc_type): each document of a person evidences one encounter.

    Facts of several days make a stay from the first to the last day, facts of one day a visit without a discharge.
    """
    day = F.substring("time_iso", 1, 10)
    e = valid(facts).where("time_iso is not null and doc_id is not null").groupBy("pid", "doc_id").agg(F.min(day).alias("start"), F.max(day).alias("last"))
    e = ranked(e.withColumn("month", F.substring("start", 1, 7)), ["pid"], ["start", "doc_id"], "month", "ord")
    return e.select(
        "pid", F.format_string("enc_%04d", "ord").alias("enc_id"), "ord", "doc_id", "start", F.when(F.col("last") > F.col("start"), F.col("last")).alias("discharge"),
        F.when(F.col("last") > F.col("start"), "inpatient").otherwise("outpatient").alias("enc_type"),
    )


def attribution(times: DataFrame, enc: DataFrame) -> DataFrame:
    """(pid, time_iso, enc_id) of the distinct (pid, time_iso) that fall into an encounter of enc (pid, enc_id, ord, start, discharge)."""
    times = times.where("time_iso is not null").select("pid", "time_iso").distinct().withColumn("month", F.substring("time_iso", 1, 7))
    first = lambda c: F.try_to_date(F.concat(F.substring(c, 1, 7), F.lit("-01")))
    stays = enc.where("discharge >= start").select("pid", "enc_id", "ord", "start", "discharge", F.explode(F.sequence(first("start"), first("discharge"), F.expr("interval 1 month"))).alias("m"))
    stays = stays.select("pid", "enc_id", "ord", "start", "discharge", F.date_format("m", "yyyy-MM").alias("month"))
    inside = times.join(stays, ["pid", "month"]).where("start <= time_iso and time_iso <= discharge").select("pid", "time_iso", "enc_id", "ord", F.lit(0).alias("point"))
    at = times.join(enc.select("pid", "enc_id", "ord", F.col("start").alias("time_iso")), ["pid", "time_iso"]).select("pid", "time_iso", "enc_id", "ord", F.lit(1).alias("point"))
    return inside.unionByName(at).groupBy("pid", "time_iso").agg(F.min_by("enc_id", F.struct("point", "ord")).alias("enc_id"))


def nodes(facts: DataFrame, analytes: DataFrame) -> DataFrame:
    """All nodes of all charts; structural columns (node_id, type, time) are never taken from the payload."""
    r, e = records(facts, analytes), encounters(facts)
    a = attribution(r.where(F.col("kind").isin(ATTRIBUTED)), e)
    dim = analytes.select("loinc", F.col("display").alias("known"), "hi_is_worse")
    r = r.join(a, ["pid", "time_iso"], "left").join(dim, "loinc", "left")
    obs = r.select(
        "pid", "node_id", _choice(F.col("kind"), dims.NODE_TYPES).alias("type"), F.col("time_iso").alias("time"), "ord",
        F.when(F.col("kind") == "lab", F.coalesce("known", "loinc")).otherwise(F.col("name")).alias("display"), "loinc", "value", "unit", "ref_low", "ref_high",
        F.when(F.col("kind") == "lab", F.coalesce("hi_is_worse", F.lit(True))).alias("hi_is_worse"), F.get_json_object("meta", "$.code").alias("code"), F.get_json_object("meta", "$.dose").alias("dose"),
        F.when(F.col("kind").isin(ATTRIBUTED), F.col("enc_id")).alias("encounter_id"), F.lit(None).cast("string").alias("encounter_type"), "doc_id", "page_no", "char_start", "char_end",
    )
    none = lambda t: F.lit(None).cast(t)
    enc = e.select(
        "pid", F.col("enc_id").alias("node_id"), F.lit("Encounter").alias("type"), F.col("start").alias("time"), "ord", none("string").alias("display"), none("string").alias("loinc"), none("double").alias("value"), none("string").alias("unit"),
        none("double").alias("ref_low"), none("double").alias("ref_high"), none("boolean").alias("hi_is_worse"), none("string").alias("code"), none("string").alias("dose"), none("string").alias("encounter_id"), F.col("enc_type").alias("encounter_type"),
        "doc_id", none("int").alias("page_no"), none("int").alias("char_start"), none("int").alias("char_end"),
    )
    return obs.unionByName(enc)


def chart(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(read(spark, sf, "facts"), read(spark, sf, "analytes"))


def sequential_ids(spark: SparkSession, sf: str) -> DataFrame:
    return records(read(spark, sf, "facts"), read(spark, sf, "analytes")).select("pid", "fact_id", "node_id")


def encounter_spans(spark: SparkSession, sf: str) -> DataFrame:
    return encounters(read(spark, sf, "facts"))


def encounter_attribution(spark: SparkSession, sf: str) -> DataFrame:
    f, a = read(spark, sf, "facts"), read(spark, sf, "analytes")
    r = records(f, a).where(F.col("kind").isin(ATTRIBUTED))
    return r.join(attribution(r, encounters(f)), ["pid", "time_iso"], "left").select("pid", "node_id", "enc_id")


def stay_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """The same interval join over other tables: which order's span (first to last shipment) of a customer includes each shipment."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("pid"), day("o_orderdate").alias("start"))
    l = read(spark, sf, "lineitem").select("l_orderkey", day("l_shipdate").alias("time_iso"))
    shipped = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("time_iso").alias("last"))
    enc = o.join(shipped, "o_orderkey").select("pid", F.col("o_orderkey").cast("string").alias("enc_id"), F.struct("start", "o_orderkey").alias("ord"), "start", F.col("last").alias("discharge"))
    times = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("pid", "time_iso")
    return attribution(times, enc)


def collection_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's place in its collection, by time (undated first) and then by number."""
    c = chart(spark, sf).where("type <> 'Encounter'").withColumn("t", F.coalesce("time", F.lit(""))).withColumn("month", F.substring("t", 1, 7))
    return ranked(c, ["pid", "type"], ["t", "ord"], "month", "place").select("pid", "node_id", "type", "place")


def chart_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return chart(spark, sf).select("pid", "node_id", "type", "time", "display", "loinc", "value", "hi_is_worse", "code", "encounter_id", "encounter_type")


#: r (charted observations), e (encounters), att (attribution) and nodes in SQL.
CHART_SQL = f"""{DEDUP_SQL},
a as (select lower(display) k, min(loinc) code from analytes group by 1),
c as (select d.* exclude (loinc), case when kind = 'lab' then coalesce(nullif(trim(d.loinc), ''), a.code) end loinc from d left join a on d.name_key = a.k),
r as (select *, row_number() over (partition by pid, kind order by t, name nulls first, doc_id nulls first, page_no nulls first, char_start nulls first, fact_id) ord from c where (kind <> 'lab' or loinc is not null) and kind <> 'encounter'),
rn as (select *, case kind when 'lab' then 'lab' when 'med' then 'med' when 'dx' then 'dx' when 'allergy' then 'alg' when 'note_stance' then 'note' when 'vital' then 'vs' when 'imaging' then 'img' end || printf('_%04d', ord) node_id from r),
e0 as (select pid, doc_id, min(substr(time_iso, 1, 10)) start, max(substr(time_iso, 1, 10)) fin from f where pid is not null and time_iso is not null and doc_id is not null group by 1, 2),
e1 as (select *, row_number() over (partition by pid order by start, doc_id) ord from e0),
e as (select pid, printf('enc_%04d', ord) enc_id, ord, doc_id, start, case when fin > start then fin end discharge, case when fin > start then 'inpatient' else 'outpatient' end enc_type from e1),
att as (select pid, time_iso, enc_id from (
    select o.pid, o.time_iso, e.enc_id, row_number() over (partition by o.pid, o.time_iso order by case when e.discharge is not null and e.start <= o.time_iso and o.time_iso <= e.discharge then 0 else 1 end, e.ord) n
    from (select distinct pid, time_iso from rn where kind in ('lab', 'med', 'imaging', 'note_stance', 'dx') and time_iso is not null) o
    join e on o.pid = e.pid and ((e.discharge is not null and e.start <= o.time_iso and o.time_iso <= e.discharge) or e.start = o.time_iso)) where n = 1),
nodes as (
    select r.pid, node_id, case kind when 'lab' then 'LabResult' when 'med' then 'MedicationOrder' when 'dx' then 'Diagnosis' when 'allergy' then 'Allergy' when 'note_stance' then 'Note' when 'vital' then 'VitalSeries' when 'imaging' then 'ImagingStudy' end as type,
        r.time_iso as time, ord, case when kind = 'lab' then coalesce(x.display, r.loinc) else name end display, r.loinc, value, r.unit, r.ref_low, r.ref_high, case when kind = 'lab' then coalesce(x.hi_is_worse, true) end hi_is_worse,
        json_extract_string(meta, '$.code') code, json_extract_string(meta, '$.dose') dose, case when kind in ('lab', 'med', 'imaging', 'note_stance', 'dx') then att.enc_id end encounter_id, cast(null as varchar) encounter_type, r.doc_id, page_no, char_start, char_end
    from rn r left join att on r.pid = att.pid and r.time_iso = att.time_iso left join analytes x on r.loinc = x.loinc
    union all select pid, enc_id, 'Encounter', start, ord, null, null, null, null, null, null, null, null, null, null, enc_type, doc_id, null, null, null from e)"""

QUERIES = {
    "sequential_ids": sequential_ids, "encounter_spans": encounter_spans, "encounter_attribution": encounter_attribution, "stay_attribution": stay_attribution, "collection_order": collection_order, "chart_nodes": chart_nodes,
}
ORACLE = {
    "sequential_ids": f"with {CHART_SQL} select pid, fact_id, node_id from rn",
    "encounter_spans": f"with {CHART_SQL} select * from e",
    "encounter_attribution": f"with {CHART_SQL} select rn.pid, node_id, enc_id from rn left join att on rn.pid = att.pid and rn.time_iso = att.time_iso where kind in ('lab', 'med', 'imaging', 'note_stance', 'dx')",
    "stay_attribution": """with l as (select l_orderkey, strftime(l_shipdate, '%Y-%m-%d') t from lineitem), o as (select o_orderkey, cast(o_custkey as varchar) pid, strftime(o_orderdate, '%Y-%m-%d') start from orders),
        e as (select pid, o_orderkey, start, max(t) fin from o join l on l_orderkey = o_orderkey group by all), p as (select distinct pid, t from l join o on l_orderkey = o_orderkey)
        select pid, time_iso, enc_id from (select p.pid, t time_iso, cast(o_orderkey as varchar) enc_id, row_number() over (partition by p.pid, t order by case when start <= t and t <= fin then 0 else 1 end, start, o_orderkey) n
        from p join e on p.pid = e.pid and ((start <= t and t <= fin) or start = t)) where n = 1""",
    "collection_order": f"with {CHART_SQL} select pid, node_id, type, row_number() over (partition by pid, type order by coalesce(time, ''), ord) place from nodes where type <> 'Encounter'",
    "chart_nodes": f"with {CHART_SQL} select pid, node_id, type, time, display, loinc, value, hi_is_worse, code, encounter_id, encounter_type from nodes",
}
ORACLE["encounter_spans"] = dims.as_integers(ORACLE["encounter_spans"], "ord")
ORACLE["collection_order"] = dims.as_integers(ORACLE["collection_order"], "place")
