"""Questions as plans over all charts: intent, coverage, evidence.

Every question is planned once (they are few), then asked of every person. A question is refused where the schema cannot
represent what it asks for, where a named condition is not documented, or where the nodes that its intent needs are
missing; what is refused is dropped before any evidence is computed. Defined results: cues are plain substrings of the
question in lower case, in their order; a null question has the intent 'general'; empty charts give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import temporal
from chartloom.operators.chart import chart
from chartloom.operators.graph import EDGE_SQL, drug_orders, interacting
from chartloom.session import written

# Intents with their cues, in order.
INTENTS = [
    ("trend", ["worsen", "deteriorat", "trend", "declin", "getting worse", "trajectory", "kidney", "renal", "creatinine", "renal function"]),
    ("interaction", ["interaction", "interact", "conflict", "together", "combine"]),
    ("allergy", ["allerg", "contraindicat"]),
    ("followup", ["follow", "missed", "overdue", "no show"]),
    ("change", ["new", "changed", "since last"]),
    ("administrative", ["when", "last visit", "how many"]),
]
# Cues of what no chart can hold.
UNREPRESENTABLE = [
    ("blood type", "no haematology/blood-bank resource in the record schema"), ("blood group", "no blood-bank resource in the record schema"), ("family history", "family history is not modelled as a node type"),
    ("insurance", "no payer/claims resource in the record schema"), ("surgeon", "no practitioner-attribution resource in the record schema"), ("operation performed by", "no practitioner-attribution resource"),
    ("at home", "current outpatient medications are not recorded"), ("address", "no address node type in the record schema"), ("phone", "no contact-detail node type"), ("password", "out of clinical scope"),
    ("prescribe", "the system does not prescribe - out of scope by design"), ("diagnose", "the system does not diagnose - out of scope by design"), ("gene", "no genomic resource in the record schema"),
    ("pregnan", "obstetric history is not modelled"),
]
# Conditions that may be asked for, what they are called in a refusal, and words of a diagnosis that show them.
CONCEPTS = [
    ("stroke", "cerebrovascular accident (I20-I25/I63-I64)", ["stroke", "cerebrovascular", "cva"]), ("heart attack", "acute myocardial infarction (I21)", ["myocardial infarction", "mi"]),
    ("myocardial infarction", "acute myocardial infarction (I21)", ["myocardial infarction", "mi"]), ("sepsis", "sepsis (A40-A41)", ["sepsis", "septic"]),
    ("cancer", "malignant neoplasm (C00-C97)", ["carcinoma", "neoplasm", "malignan", "cancer"]), ("tuberculosis", "tuberculosis (A15-A19)", ["tuberculosis"]), ("hiv", "HIV (B20-B24)", ["hiv", "immunodeficiency"]),
    ("epilepsy", "epilepsy / convulsions (G40-G41)", ["epilepsy"]), ("asthma", "asthma (J45-J46)", ["asthma"]), ("pneumonia", "pneumonia (J18)", ["pneumonia"]), ("clot", "thromboembolism (I63/I81)", ["thromboemb", "embol"]),
    ("anemia", "anaemia (D50-D64)", ["anaemia", "anemia"]),
]
# The node type that an intent needs.
NEEDS = [("trend", "LabResult"), ("interaction", "MedicationOrder"), ("allergy", "Allergy"), ("followup", "Diagnosis"), ("administrative", "Encounter"), ("change", "Encounter")]
# Questions with answers and questions without.
QUESTIONS = [
    (1, "Is there any medication interaction in the current regimen?"), (2, "Are there any allergy contraindications in this record?"), (3, "Is there any sign the kidney function is worsening?"), (4, "Are there any missed follow-ups or overdue referrals?"),
    (5, "What has changed since the last visit?"), (6, "When was the last visit?"), (7, "What is this patient's blood type?"), (8, "What medications is the patient taking at home right now?"), (9, "Has the patient ever had a stroke?"),
    (10, "What is the patient's family history of cardiac disease?"), (11, "Which surgeon performed the procedure last year?"), (12, "What is the patient's insurance plan?"),
    (13, "Did the asthma get worse, or the anemia?"), (14, "Show the creatinine trend over the last 18 months"), (15, "Tell me about this patient"),
]
#: The analytes of the test tables that a trend question looks at, the first with a trend wins.
TEST_PRIORITY = ["71204-5", "71834-6", "72231-7", "71911-2"]


def plans(questions: DataFrame) -> DataFrame:
    """questions (qid, query) with intent and months."""
    low = F.lower(F.coalesce("query", F.lit("")))
    intent = F.lit("general")
    for name, cues in reversed(INTENTS):
        intent = F.when(low.rlike("|".join(cues)), name).otherwise(intent)
    months = F.when(low.rlike("18 month|year|6 month"), F.nullif(F.regexp_extract(low, r"(\d+)\s*month", 1), F.lit("")).cast("int"))
    return questions.select("qid", "query", intent.alias("intent"), months.alias("months"))


def replanned(plan: DataFrame, suggested: DataFrame) -> DataFrame:
    """plans with the intents that a model suggests (qid, intent), only where the cues found none and only of known intents."""
    known = [i for i, _ in INTENTS]
    s = suggested.where(F.col("intent").isin(known)).groupBy("qid").agg(F.min("intent").alias("other"))
    return plan.join(s, "qid", "left").withColumn("intent", F.when(F.col("intent") == "general", F.coalesce("other", "intent")).otherwise(F.col("intent"))).drop("other")


def unrepresentable(query: Column) -> Column:
    """(cue, why) of the first cue that a question holds, null without one."""
    low, out = F.lower(F.coalesce(query, F.lit(""))), F.lit(None).cast("struct<cue:string,why:string>")
    for cue, why in reversed(UNREPRESENTABLE):
        out = F.when(low.contains(cue), F.struct(F.lit(cue).alias("cue"), F.lit(why).alias("why"))).otherwise(out)
    return out


def documented(n: DataFrame) -> DataFrame:
    """(pid, concept) of the conditions that some diagnosis of a person shows."""
    low = F.lower("display")
    shown = F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), F.lit(c)) for c, _, words in CONCEPTS]))
    return n.where("type = 'Diagnosis'").select("pid", F.explode(shown).alias("concept")).distinct()


def asked(n: DataFrame, questions: list[tuple] = QUESTIONS) -> DataFrame:
    """Every question of every person: (pid, qid). The questions are literals, so each person's row is exploded."""
    return n.select("pid").distinct().select("pid", F.explode(F.array(*[F.lit(q[0]) for q in questions])).alias("qid"))


def coverage(n: DataFrame, questions: list[tuple] = QUESTIONS) -> DataFrame:
    """(pid, qid, query, intent, months, missing, reason): missing and reason are null where the question can be answered."""
    spark = n.sparkSession
    q = plans(dims.rows(spark, questions, "qid int, query string")).withColumn("u", unrepresentable(F.col("query")))
    low = F.lower(F.coalesce("query", F.lit("")))
    named = q.select("qid", F.explode(F.array_compact(F.array(*[F.when(low.contains(c), F.struct(F.lit(k).alias("k"), F.lit(c).alias("concept"), F.lit(codes).alias("codes"))) for k, (c, codes, _) in enumerate(CONCEPTS)]))).alias("c")).select("qid", "c.*")
    a = asked(n, questions)
    absent = a.join(F.broadcast(named), "qid").join(documented(n), ["pid", "concept"], "left_anti").groupBy("pid", "qid").agg(F.min(F.struct("k", "concept", "codes")).alias("absent"))
    need = dims.rows(spark, NEEDS, "intent string, need string")
    has = n.select("pid", F.col("type").alias("need"), F.lit(True).alias("has")).distinct()
    r = a.join(F.broadcast(q), "qid").join(F.broadcast(need), "intent", "left").join(absent, ["pid", "qid"], "left").join(has, ["pid", "need"], "left")
    lacks = F.when(F.col("need").isNotNull() & F.col("has").isNull(), F.concat(F.lit("no "), F.col("need"), F.lit(" nodes exist in this record")))
    return r.select(
        "pid", "qid", "query", "intent", "months", F.coalesce(F.col("u.cue"), F.col("absent.concept"), lacks).alias("missing"),
        F.when(F.col("u").isNotNull(), F.col("u.why")).when(F.col("absent").isNotNull(), F.concat(F.lit("no "), F.col("absent.codes"), F.lit(" is documented in this record"))).otherwise(lacks).alias("reason"),
    )


def first_trend(n: DataFrame, priority: list[str], months: int | None = None) -> DataFrame:
    """Each person's trend of the first analyte in the order of priority that has one."""
    p = temporal.points(n).where(F.col("loinc").isin(priority))
    t = temporal.trends(p, months=months)
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("loinc"))
    return t.groupBy("pid").agg(F.min_by(F.struct(*t.columns[1:]), rank).alias("t")).select("pid", "t.*")


def evidence(n: DataFrame, cov: DataFrame, priority: list[str] = TEST_PRIORITY, pairs: list[tuple] = dims.TEST_INTERACTIONS) -> DataFrame:
    """(pid, qid, node_id, place): the nodes that each answerable question rests on, distinct, as rows."""
    ok = cov.where("reason is null").select("pid", "qid", "intent", "months")
    by = lambda i: ok.where(F.col("intent") == i).select("pid", "qid")
    t = first_trend(n, priority).select("pid", "loinc")
    trend = temporal.points(n).join(t, ["pid", "loinc"]).select("pid", "node_id", F.concat_ws("|", "time", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("place"))
    i = interacting(drug_orders(n), pairs)
    inter = i.select("pid", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("place", F.col("node_id"))
    allergy = n.where("type in ('Allergy', 'MedicationOrder')").select("pid", "node_id", F.concat_ws("|", "type", "node_id").alias("place"))
    gap = temporal.gaps(n).select("pid", "node_id", F.col("rank").cast("string").alias("place"))
    change = temporal.changed(n).select("pid", "node_id", F.col("node_id").alias("place"))
    admin = temporal.visits(n).select("pid", F.col("last_ord_id").alias("node_id"), F.lit("").alias("place"))
    general = n.where("type = 'Diagnosis' or (type = 'MedicationOrder' and ord <= 6)").select("pid", "node_id", F.concat_ws("|", "type", "node_id").alias("place"))
    out = None
    for intent, e in (("trend", trend), ("interaction", inter), ("allergy", allergy), ("followup", gap), ("change", change), ("administrative", admin), ("general", general)):
        e = by(intent).join(e, "pid")
        out = e if out is None else out.unionByName(e)
    return out


def plan_questions(spark: SparkSession, sf: str) -> DataFrame:
    return plans(dims.rows(spark, QUESTIONS, "qid int, query string"))


def coverage_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(written(chart(spark, sf))).where("reason is not null").select("pid", "qid", "intent", "missing", "reason")


def concept_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Documented conditions of each person."""
    return documented(chart(spark, sf))


def question_evidence(spark: SparkSession, sf: str) -> DataFrame:
    n = written(chart(spark, sf))
    return evidence(n, written(coverage(n))).select("pid", "qid", "node_id")


def evidence_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much evidence each answerable question has: an eighth a node, one at most."""
    n = written(chart(spark, sf))
    cov = written(coverage(n))
    e = evidence(n, cov).groupBy("pid", "qid").agg(F.count("*").alias("n"))
    a = cov.where("reason is null").select("pid", "qid").join(e, ["pid", "qid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return a.select("pid", "qid", "n", F.least(F.lit(1.0), F.col("n") / 8.0).alias("coverage"))


def _intent_sql() -> str:
    return "case " + " ".join(f"when regexp_matches(lower(query), '{'|'.join(c)}') then '{i}'" for i, c in INTENTS) + " else 'general' end"


_T = dims.sql_text
_CUES, _WHYS = ("case " + " ".join(f"when contains(lower(query), {_T(u[0])}) then {_T(u[i])}" for u in UNREPRESENTABLE) + " end" for i in (0, 1))
#: qn (questions), cov (coverage) in SQL over the chart.
COVER_SQL = f"""{EDGE_SQL}, qs(qid, query) as ({dims.sql_rows(QUESTIONS)}),
qn as (select qid, query, {_intent_sql()} intent, case when regexp_matches(lower(query), '18 month|year|6 month') then try_cast(regexp_extract(lower(query), '(\\d+)\\s*month', 1) as integer) end "months", {_CUES} cue, {_WHYS} why from qs),
cn(k, concept, codes, words) as ({dims.sql_rows([(k, c, codes, "|".join(w)) for k, (c, codes, w) in enumerate(CONCEPTS)])}),
doc as (select distinct pid, concept from nodes join cn on regexp_matches(lower(display), words) where type = 'Diagnosis'),
nd(intent, need) as ({dims.sql_rows(NEEDS)}), persons as (select distinct pid from nodes), has as (select distinct pid, type from nodes),
ab as (select pid, qid, concept, codes from persons, qn join cn on contains(lower(query), concept) where not exists (select 1 from doc where doc.pid = persons.pid and doc.concept = cn.concept) qualify row_number() over (partition by pid, qid order by k) = 1),
lk as (select persons.pid, qid, 'no ' || need || ' nodes exist in this record' lacks from persons, qn join nd on qn.intent = nd.intent where not exists (select 1 from has where has.pid = persons.pid and has.type = need)),
cov as (select persons.pid, qn.qid, query, intent, months, coalesce(cue, concept, lacks) missing, case when cue is not null then why when concept is not null then 'no ' || codes || ' is documented in this record' else lacks end reason
        from persons cross join qn left join ab on ab.pid = persons.pid and ab.qid = qn.qid left join lk on lk.pid = persons.pid and lk.qid = qn.qid)"""
_PRIO = ", ".join(f"'{x}'" for x in TEST_PRIORITY)
#: ev (evidence rows), with what it needs, in SQL.
EVIDENCE_SQL = f"""{COVER_SQL}, {temporal._V}, {temporal._PTS}, {temporal.TREND_SQL},
ft as (select * from t where n >= 4 and loinc in ({_PRIO}) qualify row_number() over (partition by pid order by list_position([{_PRIO}], loinc)) = 1),
gp as (select nodes.pid, node_id, display, time, cast(floor(({temporal._US('last_time')} - {temporal._US('time')}) / {temporal.DAY}) as bigint) dd, ord from nodes join v on nodes.pid = v.pid where type = 'Diagnosis' and n >= 2 and time < last_time),
gap as (select *, row_number() over (partition by pid order by dd desc, ord) rank from gp qualify rank <= 5), {temporal._CHANGED},
evn as (select 'trend' intent, pts.pid, node_id from pts join ft on pts.pid = ft.pid and pts.loinc = ft.loinc union all select 'interaction', pid, src from ix union select 'interaction', pid, dst from ix
  union all select 'allergy', pid, node_id from nodes where type in ('Allergy', 'MedicationOrder') union all select 'followup', pid, node_id from gap union all select 'change', pid, node_id from ch
  union all select 'administrative', pid, last_ord_id from v union all select 'general', pid, node_id from nodes where type = 'Diagnosis' or (type = 'MedicationOrder' and ord <= 6)),
ev as (select distinct cov.pid, qid, node_id from cov join evn on cov.pid = evn.pid and cov.intent = evn.intent where reason is null)"""

QUERIES = {"plan_questions": plan_questions, "coverage_refusals": coverage_refusals, "concept_absent": concept_absent, "question_evidence": question_evidence, "evidence_coverage": evidence_coverage}
ORACLE = {
    "plan_questions": f"with qs(qid, query) as ({dims.sql_rows(QUESTIONS)}) select qid, query, {_intent_sql()} intent, case when regexp_matches(lower(query), '18 month|year|6 month') then try_cast(regexp_extract(lower(query), '(\\d+)\\s*month', 1) as integer) end as months from qs",
    "coverage_refusals": f"with {COVER_SQL} select pid, qid, intent, missing, reason from cov where reason is not null",
    "concept_absent": f"with {COVER_SQL} select pid, concept from doc",
    "question_evidence": f"with {EVIDENCE_SQL} select * from ev",
    "evidence_coverage": f"with {EVIDENCE_SQL}, ec as (select pid, qid, count(*) n from ev group by 1, 2) select cov.pid, cov.qid, coalesce(n, 0) n, least(cast(1.0 as double), coalesce(n, 0) / cast(8.0 as double)) coverage from cov left join ec on cov.pid = ec.pid and cov.qid = ec.qid where reason is null",
}
