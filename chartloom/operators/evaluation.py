"""Measures of the whole: planted findings found, right and wrong claims, and how both fare when records degrade.

Random choices are hashes of ids and a seed, so every engine and every rerun makes the same. Defined results: rates
without cases are 0; empty tables give counts of 0 or no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions import text as T
from chartloom.operators import temporal
from chartloom.operators.chart import CHART_SQL, chart
from chartloom.operators.graph import drug_orders, interacting
from chartloom.session import written
from chartloom.sources.tables import read

# How likely each damage is at full noise, and the noise levels of the sweep.
DAMAGE = {"unit": 0.4, "range": 0.3, "case": 0.3, "expire": 0.2, "code": 0.25}
LEVELS = [0.0, 0.25, 0.5, 0.75, 1.0]
EXPIRED = "2025-01-01T00:00:00"


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a key and a seed, equal in every engine."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def perturbed(n: DataFrame, level: Column, molar: float = 88.4) -> DataFrame:
    """Nodes degraded by a level: units and ranges of results, case of drugs, case of codes."""
    key = F.concat_ws("/", "pid", "node_id")
    hit = lambda what: uniform(key, what) < level * DAMAGE[what]
    lab, med, dx = (F.col("type") == t for t in ("LabResult", "MedicationOrder", "Diagnosis"))
    return n.select(
        *[c for c in n.columns if c not in ("value", "unit", "ref_low", "ref_high", "display", "code")],
        F.when(lab & hit("unit"), F.col("value") * molar).otherwise(F.col("value")).alias("value"), F.when(lab & hit("unit"), "umol/L").otherwise(F.col("unit")).alias("unit"),
        F.when(~(lab & hit("range")), F.col("ref_low")).alias("ref_low"), F.when(~(lab & hit("range")), F.col("ref_high")).alias("ref_high"),
        F.when(med & hit("case"), F.initcap("display")).otherwise(F.col("display")).alias("display"), F.when(dx & hit("code"), F.lower("code")).otherwise(F.col("code")).alias("code"),
    )


def planted(n: DataFrame, pairs: list[tuple] = dims.TEST_INTERACTIONS) -> DataFrame:
    """(pid, type): what the undamaged record holds: an interaction, a worsening series, a follow-up gap."""
    i = interacting(drug_orders(n), pairs).select("pid", F.lit("drug_interaction").alias("type"))
    t = temporal.trends(temporal.points(n)).where("deteriorated").select("pid", F.lit("deteriorating_trend").alias("type"))
    g = temporal.gaps(n).select("pid", F.lit("missed_follow_up").alias("type"))
    return reduce(DataFrame.unionByName, [i, t, g]).distinct()


def detection(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Planted and detected persons by type, with the total of all (rollup)."""
    j = truth.join(found.withColumn("hit", F.lit(1)), ["pid", "type"], "left")
    r = j.rollup("type").agg(F.count("*").alias("planted"), F.count("hit").alias("detected"))
    return r.select(F.coalesce("type", F.lit("all")).alias("type"), "planted", "detected", F.coalesce(F.try_divide(F.col("detected").cast("double"), F.col("planted")), F.lit(0.0)).alias("rate"))


def detection_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """What is found in records at half the noise of what the clean records hold."""
    n = written(chart(spark, sf))
    return detection(written(planted(n)), written(planted(perturbed(n, F.lit(0.5)))))


def perturb_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions found at each level of noise; levels are literals, so each order's row is exploded."""
    m = chart(spark, sf).where("type = 'MedicationOrder'").withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))
    p = perturbed(m, F.col("level")).select(F.concat_ws("@", "pid", "level").alias("pid"), "node_id", F.col("display").alias("drug"))
    i = interacting(p, dims.TEST_INTERACTIONS).select("pid").distinct().select(F.element_at(F.split("pid", "@"), 1).alias("who"), F.element_at(F.split("pid", "@"), 2).cast("double").alias("level"))
    return i.groupBy("level").agg(F.count("*").alias("persons"))


def perturbed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return perturbed(chart(spark, sf), F.lit(1.0)).select("pid", "node_id", "value", "unit", "ref_high", "display", "code")


def planted_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Planted interactions whose two orders are both cited by the claim of their pair (array overlap)."""
    m = drug_orders(chart(spark, sf))
    i = interacting(m, dims.TEST_INTERACTIONS)
    cited = i.groupBy("pid", "pair").agg(F.min(F.struct("src", "dst")).alias("c")).select("pid", "pair", F.array("c.src", "c.dst").alias("cited"))
    return i.join(cited, ["pid", "pair"]).select("pid", "pair", "src", "dst", F.arrays_overlap(F.array("src", "dst"), "cited").alias("found"), F.size(F.array_intersect(F.array("src", "dst"), "cited")).alias("shared"))


def extraction_precision(spark: SparkSession, sf: str) -> DataFrame:
    """How the stored abnormal flags agree with the computed ones, as precision, recall and f1 of 'abnormal'."""
    from chartloom.operators.facts import abnormal
    from chartloom.operators.identity import rates

    f = read(spark, sf, "facts").where("kind = 'lab'").select(F.coalesce("abnormal", F.lit(False)).alias("said"), F.coalesce(abnormal(F.col("value"), F.col("ref_low"), F.col("ref_high")), F.lit(False)).alias("is"))
    c = f.agg(F.count_if(F.col("said") & F.col("is")).alias("tp"), F.count_if(F.col("said") & ~F.col("is")).alias("fp"), F.count_if(~F.col("said") & F.col("is")).alias("fn"))
    return rates(c)


def stance_share(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a negated or speculative sentence, by kind: none of these sentences may support a claim."""
    d = read(spark, sf, "documents").select("kind", F.exists(T.sentences(F.col("text")), lambda s: T.stance(s) != "ASSERTED").alias("hedged"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.coalesce("hedged", F.lit(False))).alias("hedged"))


def finding_types(spark: SparkSession, sf: str) -> DataFrame:
    """Persons whose planted types include all of a required set (subset test)."""
    need = F.array(F.lit("drug_interaction"), F.lit("missed_follow_up"))
    p = planted(written(chart(spark, sf))).groupBy("pid").agg(F.collect_set("type").alias("types"))  # three types at most
    return p.select("pid", F.forall(need, lambda x: F.array_contains("types", x)).alias("complete"))


def cohort(spark: SparkSession, n: int, seed: str = "20261007") -> DataFrame:
    """A synthetic cohort of n persons as facts (schema of the facts table), with a worsening creatinine series for every fourth,
    two interacting drugs for every third and an early diagnosis for every second: set-wise, from hashes of ids and seed."""
    p = spark.range(n).select(F.col("id").alias("k"), F.format_string("p_%05d", F.col("id")).alias("patient_id"))
    day = lambda c: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), c), "yyyy-MM-dd")
    lab = p.select("k", "patient_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).withColumn("u", uniform(F.concat_ws("/", "k", "j"), seed))
    value = F.when(F.col("k") % 4 == 0, 0.9 + F.col("j") * 0.2 + F.col("u") * 0.05).otherwise(0.8 + F.col("u") * 0.4)
    labs = lab.select("patient_id", (F.col("k") * 100 + F.col("j")).alias("doc_id"), F.lit("lab").alias("kind"), F.lit("Creatinine").alias("name"), F.round(value, 3).alias("value"), F.lit("mg/dL").alias("unit"), day((F.col("j") * 40).cast("int")).alias("time_iso"), F.lit("2160-0").alias("loinc"))
    none = lambda t: F.lit(None).cast(t)
    drugs = p.select("k", "patient_id", F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit("warfarin"), F.lit("ibuprofen"))).otherwise(F.array(F.lit("lisinopril")))).alias("name"))
    meds = drugs.select("patient_id", (F.col("k") * 100).alias("doc_id"), F.lit("med").alias("kind"), "name", none("double").alias("value"), none("string").alias("unit"), day(F.lit(10)).alias("time_iso"), none("string").alias("loinc"))
    dxs = p.where("k % 2 = 0").select("patient_id", (F.col("k") * 100).alias("doc_id"), F.lit("dx").alias("kind"), F.lit("Essential hypertension").alias("name"), none("double").alias("value"), none("string").alias("unit"), day(F.lit(5)).alias("time_iso"), none("string").alias("loinc"))
    f = labs.unionByName(meds).unionByName(dxs)
    return f.select(
        F.xxhash64("patient_id", "doc_id", "kind", "name").alias("fact_id"), "doc_id", "patient_id", F.lit(1).alias("page_no"), F.lit(0).alias("char_start"), F.lit(0).alias("char_end"), F.lit("regex").alias("extractor"), "kind", "name", "value", "unit", "time_iso", "loinc",
        F.when(F.col("kind") == "lab", 0.6).alias("ref_low"), F.when(F.col("kind") == "lab", 1.3).alias("ref_high"), none("boolean").alias("abnormal"), F.lit(False).alias("negated"), none("string").alias("meta"),
    )


_U = lambda key, what: f"cast(('0x' || substr(md5({key} || '{what}'), 1, 8)) as bigint) / cast(4294967296.0 as double)"
_HIT = lambda what, level: f"{_U(chr(40) + 'pid || ' + chr(39) + '/' + chr(39) + ' || node_id)', what)} < {level} * {DAMAGE[what]}"


def _perturbed_sql(level: str, source: str = "nodes") -> str:
    unit, rng, case, code = (_HIT(w, level) for w in ("unit", "range", "case", "code"))
    return f"""select * exclude (value, unit, ref_low, ref_high, display, code), case when type = 'LabResult' and {unit} then value * cast(88.4 as double) else value end as value, case when type = 'LabResult' and {unit} then 'umol/L' else unit end unit,
      case when not (type = 'LabResult' and {rng}) then ref_low end ref_low, case when not (type = 'LabResult' and {rng}) then ref_high end ref_high,
      case when type = 'MedicationOrder' and {case} then upper(display[1:1]) || lower(display[2:]) else display end display, case when type = 'Diagnosis' and {code} then lower(code) else code end code from {source}"""


_INTER = f"inter(pair, drug_a, drug_b, severity, why) as ({dims.sql_rows([(k, *p) for k, p in enumerate(dims.TEST_INTERACTIONS)])})"
_IX = "select m1.pid, m1.node_id src, m2.node_id dst, pair from {t} m1 join inter on m1.display = drug_a join {t} m2 on m2.pid = m1.pid and m2.display = drug_b where m1.type = 'MedicationOrder' and m2.type = 'MedicationOrder'"


def _planted_sql(t: str, k: str) -> str:
    """Relation planted{k} over the nodes relation t."""
    us = temporal._US
    v = temporal._V.replace("v as (", f"v{k} as (").replace("from nodes where", f"from {t} where")
    pts = temporal.TREND_SQL.replace("from pts", f"from pts{k}").replace("s as (select", f"s{k} as (select", 1).replace("tr as (select", f"tr{k} as (select").replace("from s group", f"from s{k} group").replace("t as (select *, \"last\"", f"t{k} as (select *, \"last\"").replace("from tr)", f"from tr{k})")
    return f"""pts{k} as (select * from {t} where type = 'LabResult' and time is not null and value is not null), {pts}, {v},
      planted{k} as (select pid, 'drug_interaction' as type from ({_IX.format(t=t)}) union select pid, 'deteriorating_trend' from t{k} where n >= 4 and deteriorated
        union select x.pid, 'missed_follow_up' from {t} x join v{k} on x.pid = v{k}.pid where type = 'Diagnosis' and n >= 2 and time < last_time and {us('last_time')} is not null)"""


QUERIES = {
    "detection_by_type": detection_by_type, "perturb_sweep": perturb_sweep, "perturbed_nodes": perturbed_nodes, "planted_evidence": planted_evidence, "extraction_precision": extraction_precision, "stance_share": stance_share,
    "finding_types": finding_types, "synthetic_cohort": lambda spark, sf: cohort(spark, 200).drop("abnormal", "meta"),
}
from chartloom.operators.texts import sentences_sql as _sent  # noqa: E402
from chartloom.operators.texts import stance_sql as _stance  # noqa: E402

ORACLE = {
    "detection_by_type": f"""with {CHART_SQL}, {_INTER}, pert as ({_perturbed_sql('cast(0.5 as double)')}), {_planted_sql('nodes', '1')}, {_planted_sql('pert', '2')},
        j as (select a.type, b.pid hit from planted1 a left join planted2 b on a.pid = b.pid and a.type = b.type)
        select coalesce(type, 'all') as type, count(*) planted, count(hit) detected, count(hit) / cast(count(*) as double) rate from j group by rollup (type)""",
    "perturb_sweep": f"""with {CHART_SQL}, {_INTER}, lv(level) as (values {", ".join(f"(cast({x} as double))" for x in LEVELS)}), m as (select nodes.*, level from nodes cross join lv where type = 'MedicationOrder'), pm as ({_perturbed_sql('level', 'm')})
        select a.level, count(distinct a.pid) persons from pm a join inter on a.display = drug_a join pm b on a.pid = b.pid and a.level = b.level and b.display = drug_b group by 1""",
    "perturbed_nodes": f"with {CHART_SQL}, pert as ({_perturbed_sql('cast(1.0 as double)')}) select pid, node_id, value, unit, ref_high, display, code from pert",
    "planted_evidence": f"""with {CHART_SQL}, {_INTER}, ix as ({_IX.format(t='nodes')}), ce as (select pid, pair, min((src, dst)) z from ix group by 1, 2)
        select ix.pid, ix.pair, src, dst, src in (z[1], z[2]) or dst in (z[1], z[2]) found, cast(src in (z[1], z[2]) as integer) + cast(dst in (z[1], z[2]) as integer) shared from ix join ce on ix.pid = ce.pid and ix.pair = ce.pair""",
    "extraction_precision": """with f as (select coalesce(abnormal, false) said, coalesce(case when value is null then null when ref_low is not null and value < ref_low then true when ref_high is not null and value > ref_high then true when ref_low is not null or ref_high is not null then false end, false) is_ from facts where kind = 'lab'),
        c as (select count(*) filter (where said and is_) tp, count(*) filter (where said and not is_) fp, count(*) filter (where not said and is_) fn from f),
        d as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end "precision", case when tp + fn > 0 then tp / (tp + fn) else 0.0 end recall from c) select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end f1 from d""",
    "stance_share": f"select kind, count(*) n, count(*) filter (where len(list_filter({_sent('text')}, lambda s: {_stance('s')} <> 'ASSERTED')) > 0) hedged from documents group by 1",
    "finding_types": f"with {CHART_SQL}, {_INTER}, {_planted_sql('nodes', '1')} select pid, count(distinct type) filter (where type in ('drug_interaction', 'missed_follow_up')) = 2 complete from planted1 group by 1",
}
