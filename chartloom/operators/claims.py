"""Claims from evidence, checked against what they cite, calibrated, and published, withheld or refused.

A claim is one row; what it cites are rows of their own (claim, node), so a series of any length needs no array. The
check sees only a claim and its cited nodes. An answer without a published claim is a refusal: silence is no finding.
Defined results: a cited node that does not exist contradicts the claim; a claim of absence cites nothing and stands;
unknown severities count as high; empty charts give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import questions as Q
from chartloom.operators import temporal
from chartloom.operators.calibration import TEST_KNOTS, predict
from chartloom.operators.chart import chart
from chartloom.operators.graph import drug_orders, interacting, trade_allergies, trade_meds
from chartloom.session import written

# Thresholds and escalations by type of claim; others need 0.85 and go nowhere.
RULES = [
    ("medication_interaction", 0.90, "pharmacist review"), ("allergy_contraindication", 0.90, "immediate clinician alert"), ("lab_trend", 0.85, "clinician review at next appointment"), ("diagnosis_change", 0.85, "no escalation - informational"),
    ("followup_gap", 0.85, "scheduling team"), ("factual_lookup", 0.85, "records request"), ("administrative", 0.60, "no escalation - informational"),
]
SILENCE = "the record does not contain evidence that either supports or excludes this claim"
KEY = ["pid", "qid", "no"]


def _claim(ctype: str, conf: Column | float, severity: Column | str, text: Column, **more: Column) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [F.lit(ctype).alias("ctype"), lit(conf).cast("double").alias("raw_conf"), lit(severity).alias("severity"), text.alias("text"), more.get("absence", F.lit(False)).alias("absence")]


def claims(n: DataFrame, cov: DataFrame, priority: list[str] = Q.TEST_PRIORITY, pairs: list[tuple] = dims.TEST_INTERACTIONS) -> tuple[DataFrame, DataFrame]:
    """(claims, cited): pid, qid, no, ctype, raw_conf, severity, text, absence; and pid, qid, no, node_id."""
    ok = cov.where("reason is null").select("pid", "qid", "intent")
    by = lambda i: ok.where(F.col("intent") == i).select("pid", "qid")
    out, cited = [], []

    t = Q.first_trend(n, priority).withColumn("text", F.format_string("Serum %s %s from %s to %s %s between %s and %s, a change of %s%%.", F.lower("display"), F.when(F.col("deteriorated"), "rose").otherwise("fell"), F.col("first").cast("string"), F.col("last").cast("string"), F.coalesce("unit", F.lit("")), F.substring("first_time", 1, 10), F.substring("last_time", 1, 10), F.round("change_pct", 1).cast("string")))
    t = written(by("trend").join(t, "pid").withColumn("no", F.lit(1)))
    high = lambda c: F.when(c, "high").otherwise("info")
    out.append(t.select(*KEY, *_claim("lab_trend", 0.72 + 0.2 * F.col("monotonicity"), high(F.col("deteriorated")), F.col("text"))))
    cited.append(t.select(*KEY, "loinc").join(temporal.points(n).select("pid", "loinc", "node_id"), ["pid", "loinc"]).select(*KEY, "node_id"))
    # The last value beyond its limit, in the canonical unit where the fixed table knows the unit.
    u = F.broadcast(dims.rows(n.sparkSession, dims.UNITS, "unit_key string, canonical string, factor double"))
    bounds = n.where("type = 'LabResult'").groupBy("pid", F.col("node_id").alias("last_node")).agg(F.max("ref_low").alias("lo"), F.max("ref_high").alias("hi"))
    l = t.where("deteriorated and change_pct > 10").withColumn("unit_key", F.lower(F.trim("unit"))).join(u, "unit_key", "left").drop("ref_high").join(bounds, ["pid", "last_node"])
    l = l.withColumn("cv", F.col("last") * F.coalesce("factor", F.lit(1.0))).withColumn("scale", F.when(F.col("hi") - F.col("lo") != 0, F.col("hi") - F.col("lo")).otherwise(1.0)).where("cv > hi + 0.01D * scale").withColumn("no", F.lit(2))
    out.append(l.select(*KEY, *_claim("lab_trend", 0.93, "high", F.format_string("The final %s value of %s exceeds the reference upper limit of %s.", "display", F.col("cv").cast("string"), F.col("hi").cast("string")))))
    cited.append(l.select(*KEY, F.col("last_node").alias("node_id")))

    # One claim an unordered pair of drugs: the first pair of orders.
    i = interacting(drug_orders(n), pairs).groupBy("pid", F.least("drug_a", "drug_b").alias("x"), F.greatest("drug_a", "drug_b").alias("y")).agg(F.min(F.struct("pair", "src", "dst", "drug_a", "drug_b", "severity", "why")).alias("s")).select("pid", "s.*")
    i = i.join(i.groupBy("pid").agg(F.sort_array(F.collect_set("pair")).alias("all")), "pid").withColumn("no", F.array_position("all", F.col("pair")).cast("int"))  # as many pairs as literals
    i = written(by("interaction").join(i, "pid"))
    out.append(i.select(*KEY, *_claim("medication_interaction", 0.90, F.coalesce("severity", F.lit("high")), F.format_string("%s and %s are both active prescriptions. %s", "drug_a", "drug_b", "why"))))
    cited.append(i.select(*KEY, F.explode(F.array("src", "dst")).alias("node_id")))

    g = by("followup").join(temporal.gaps(n).where("rank <= 2"), "pid").withColumn("no", F.col("rank").cast("int"))
    out.append(g.select(*KEY, *_claim("followup_gap", 0.88, "medium", F.format_string("%s was recorded on %s and no subsequent encounter appears in the record within %s days.", "display", F.substring("time", 1, 10), F.col("days").cast("string")))))
    cited.append(g.select(*KEY, "node_id"))

    c = temporal.changed(n).select("pid", "node_id")
    m = by("change").join(c.groupBy("pid").agg(F.count("*").alias("m")), "pid", "left").withColumn("m", F.coalesce("m", F.lit(0))).withColumn("no", F.lit(1))
    some = F.col("m") > 0
    text = F.when(some, F.format_string("%s new clinical events were recorded at the most recent encounter compared with the previous one.", F.col("m").cast("string"))).otherwise("No new clinical events were recorded at the most recent encounter.")
    out.append(m.select(*KEY, *_claim("diagnosis_change", F.when(some, 0.85).otherwise(0.70), "info", text, absence=~some)))
    cited.append(m.select(*KEY).join(c, "pid").select(*KEY, "node_id"))

    v = by("administrative").join(temporal.visits(n).where("last_ord_id is not null"), "pid").withColumn("no", F.lit(1))
    out.append(v.select(*KEY, *_claim("administrative", 0.95, "info", F.format_string("The most recent encounter in this record is on %s.", F.substring("last_time", 1, 10)))))
    cited.append(v.select(*KEY, F.col("last_ord_id").alias("node_id")))
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, cited)


def verified(c: DataFrame, cited: DataFrame, n: DataFrame) -> DataFrame:
    """The claims with verdict and reason, from each claim and the nodes that it cites."""
    k = cited.join(n.select("pid", "node_id", "type", "ref_high"), ["pid", "node_id"], "left")
    is_ = lambda *types: F.every(F.coalesce(F.col("type").isin(*types), F.lit(False)))
    s = k.groupBy(*KEY).agg(
        F.count("*").alias("n_cited"), F.count_if(F.col("type").isNull()).alias("n_missing"), is_("LabResult").alias("labs"), F.every(F.col("ref_high").isNotNull()).alias("ranged"), is_("MedicationOrder", "Allergy").alias("orders"),
        is_("Diagnosis").alias("dxs"), is_("Diagnosis", "LabResult", "MedicationOrder", "Allergy", "Encounter").alias("clinical"),
    )
    v = c.join(s, KEY, "left").withColumn("n_cited", F.coalesce("n_cited", F.lit(0))).withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    t, m = F.col("ctype"), F.col("n_cited")
    holds = (
        F.when(t == "lab_trend", (m >= 2) | ((m == 1) & F.col("labs") & F.col("ranged")))
        .when(t.isin("medication_interaction", "allergy_contraindication"), (m == 2) & F.col("orders"))
        .when(t == "followup_gap", (m == 1) & F.col("dxs"))
        .when(t == "diagnosis_change", F.when(m > 0, F.col("clinical")).otherwise(F.col("absence")))
        .when(t == "administrative", m > 0)
        .otherwise(False)
    )
    verdict = F.when(F.col("n_missing") > 0, "CONTRADICTED").when(F.coalesce(holds, F.lit(False)), "ENTAILED").otherwise("INSUFFICIENT")
    return v.select(*c.columns, "n_cited", "n_missing", verdict.alias("verdict"))


def decided(v: DataFrame, knots: list[tuple[float, float]] = TEST_KNOTS) -> DataFrame:
    """The verified claims with score, threshold, action and escalation."""
    rules = F.broadcast(dims.rows(v.sparkSession, RULES, "ctype string, threshold double, escalate string"))
    d = v.join(rules, "ctype", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.85))).withColumn("score", predict(F.col("raw_conf"), knots))
    action = F.when(F.col("verdict") != "ENTAILED", "SUPPRESSED").when(F.col("score") < F.col("threshold"), "ABSTAINED").otherwise("PUBLISHED")
    return d.withColumn("action", action).withColumn("escalate_to", F.when(F.col("action") != "PUBLISHED", F.col("escalate"))).drop("escalate")


def answers(cov: DataFrame, d: DataFrame) -> DataFrame:
    """(pid, qid, intent, refused, reason, n_published, n_suppressed, n_abstained): one row a question and person."""
    of = lambda a: F.count_if(F.col("action") == a).cast("int")
    s = d.groupBy("pid", "qid").agg(of("PUBLISHED").alias("p"), of("SUPPRESSED").alias("s"), of("ABSTAINED").alias("a"))
    z = lambda c: F.coalesce(c, F.lit(0))
    r = cov.join(s, ["pid", "qid"], "left")
    covered = F.col("reason").isNull()
    refused = ~covered | (z("p") == 0)
    return r.select(
        "pid", "qid", "intent", refused.alias("refused"), F.when(covered, F.when(z("p") == 0, SILENCE)).otherwise(F.col("reason")).alias("reason"), z("p").alias("n_published"), z("s").alias("n_suppressed"),
        F.when(covered, z("a")).otherwise(1).alias("n_abstained"),
    )


def _all(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # The chart feeds every branch: it is computed once.
    n = written(chart(spark, sf))
    cov = written(Q.coverage(n))
    c, k = claims(n, cov)
    return n, cov, written(c), written(k)


def q_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = _all(spark, sf)[2]
    return c.select("pid", "qid", F.format_string("c_%02d", "no").alias("claim_id"), "ctype", "raw_conf", "severity", "absence", F.when(F.col("ctype") != "lab_trend", F.col("text")).alias("text"))


def claim_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _all(spark, sf)[3].select("pid", "qid", F.col("no").cast("int").alias("no"), "node_id")


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    n, _, c, k = _all(spark, sf)
    return verified(c, k, n).select("pid", "qid", F.col("no").cast("int").alias("no"), "ctype", "n_cited", "verdict")


def citations_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Cited nodes that do not exist: an anti-join; every tenth node is taken away to have some."""
    n, _, _, k = _all(spark, sf)
    kept = n.where(~F.col("node_id").endswith("7"))
    return k.join(kept, ["pid", "node_id"], "left_anti").select("pid", "qid", F.col("no").cast("int").alias("no"), "node_id")


def abstention_decisions(spark: SparkSession, sf: str) -> DataFrame:
    n, _, c, k = _all(spark, sf)
    return decided(verified(c, k, n)).select("pid", "qid", F.col("no").cast("int").alias("no"), "ctype", "score", "threshold", "action", "escalate_to")


def answers_or_refusal(spark: SparkSession, sf: str) -> DataFrame:
    n, cov, c, k = _all(spark, sf)
    return answers(cov, decided(verified(c, k, n)))


def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Published, suppressed and abstained claims by intent, with the total of all (rollup)."""
    a = answers_or_refusal(spark, sf).rollup("intent").agg(F.count("*").alias("asked"), F.count_if("refused").alias("refused"), F.sum("n_published").alias("published"), F.sum("n_suppressed").alias("suppressed"), F.sum("n_abstained").alias("abstained"))
    return a.withColumn("intent", F.coalesce("intent", F.lit("all")))


def audit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Over all answers: claims examined and published, refusals, citations and distinct cited nodes, published claims that failed the check."""
    n, cov, c, k = _all(spark, sf)
    d = decided(verified(c, k, n))
    m = d.agg(F.count("*").alias("examined"), F.count_if(F.col("action") == "PUBLISHED").alias("published"), F.count_if((F.col("action") == "PUBLISHED") & (F.col("verdict") != "ENTAILED")).alias("unsupported"), F.count_if(F.col("action") != "PUBLISHED").alias("withheld"))
    cites = k.agg(F.count("*").alias("citations"), F.countDistinct("pid", "node_id").alias("cited_nodes"))
    return m.crossJoin(cites).crossJoin(answers(cov, d).agg(F.count("*").alias("asked"), F.count_if("refused").alias("refused")))  # one row each


def allergy_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Allergies against orders of the substance, as claims, over the stand-in rows."""
    a = trade_allergies(spark, sf).select("pid", F.lower("substance").alias("s"), F.col("node_id").alias("src"), "substance")
    m = trade_meds(spark, sf).select("pid", F.lower("drug").alias("s"), F.col("node_id").alias("dst"))
    return a.join(m, ["pid", "s"]).select("pid", "src", "dst", F.format_string("The record documents a %s allergy while it is ordered.", "substance").alias("text"), F.lit(0.94).alias("raw_conf"), F.lit("high").alias("severity"))


_D = lambda v: f"cast({v!r} as double)"
_UNIT = f"un(unit_key, canonical, factor) as ({dims.sql_rows(dims.UNITS)})"
_SEG = " ".join(f"when raw_conf >= {_D(a)} and raw_conf <= {_D(c)} then {_D(b)} + (raw_conf - {_D(a)}) / ({_D(c)} - {_D(a)}) * ({_D(d)} - {_D(b)})" for (a, b), (c, d) in zip(TEST_KNOTS, TEST_KNOTS[1:]))
#: cl (claims), ci (citations), ve (verdicts), de (decisions) and an (answers) in SQL.
CLAIM_SQL = f"""{Q.EVIDENCE_SQL}, {_UNIT}, ok as (select pid, qid, intent from cov where reason is null),
tq as (select ok.qid, ft.*, 1 "no" from ft join ok on ft.pid = ok.pid and intent = 'trend'),
tl as (select tq.*, nodes.node_id last_node, "last" * coalesce(factor, cast(1.0 as double)) cv, nodes.ref_high hi_, nodes.ref_low lo_ from tq
  join (select pid, loinc, max_by(node_id, (time, ord)) nid from pts group by 1, 2) z on tq.pid = z.pid and tq.loinc = z.loinc join nodes on nodes.pid = tq.pid and nodes.node_id = z.nid left join un on lower(trim(tq.unit)) = unit_key where deteriorated and change_pct > 10),
tl2 as (select * from tl where cv > hi_ + {_D(0.01)} * case when hi_ - lo_ <> 0 then hi_ - lo_ else 1.0 end),
i1 as (select *, row_number() over (partition by pid, least(drug_a, drug_b), greatest(drug_a, drug_b) order by pair, src, dst) r from ix),
i2 as (select ok.qid, i1.*, row_number() over (partition by i1.pid, ok.qid order by pair) "no" from i1 join ok on i1.pid = ok.pid and intent = 'interaction' where r = 1),
fg as (select ok.qid, gap.*, rank "no" from gap join ok on gap.pid = ok.pid and intent = 'followup' where rank <= 2),
cg as (select ok.pid, ok.qid, coalesce(m, 0) m from ok left join (select pid, count(*) m from ch group by 1) z on z.pid = ok.pid where intent = 'change'),
av as (select ok.qid, v.* from v join ok on v.pid = ok.pid and intent = 'administrative'),
cl as (
  select pid, qid, 1 "no", 'lab_trend' ctype, {_D(0.72)} + {_D(0.2)} * monotonicity raw_conf, case when deteriorated then 'high' else 'info' end severity, cast(null as varchar) as text, false "absence" from tq
  union all select pid, qid, 2, 'lab_trend', {_D(0.93)}, 'high', null, false from tl2
  union all select pid, qid, "no", 'medication_interaction', {_D(0.90)}, severity, drug_a || ' and ' || drug_b || ' are both active prescriptions. ' || why, false from i2
  union all select pid, qid, "no", 'followup_gap', {_D(0.88)}, 'medium', display || ' was recorded on ' || substr(time, 1, 10) || ' and no subsequent encounter appears in the record within ' || dd || ' days.', false from fg
  union all select pid, qid, 1, 'diagnosis_change', case when m > 0 then {_D(0.85)} else {_D(0.70)} end, 'info', case when m > 0 then m || ' new clinical events were recorded at the most recent encounter compared with the previous one.' else 'No new clinical events were recorded at the most recent encounter.' end, m = 0 from cg
  union all select pid, qid, 1, 'administrative', {_D(0.95)}, 'info', 'The most recent encounter in this record is on ' || substr(last_time, 1, 10) || '.', false from av),
ci as (
  select tq.pid, tq.qid, 1 "no", node_id from tq join pts on tq.pid = pts.pid and tq.loinc = pts.loinc union all select pid, qid, 2, last_node from tl2
  union all select pid, qid, "no", src from i2 union all select pid, qid, "no", dst from i2 union all select pid, qid, "no", node_id from fg
  union all select cg.pid, cg.qid, 1, node_id from cg join ch on cg.pid = ch.pid union all select pid, qid, 1, last_ord_id from av),
k as (select ci.pid, qid, "no", count(*) n_cited, count(*) filter (where type is null) n_missing, bool_and(coalesce(type = 'LabResult', false)) labs, bool_and(ref_high is not null) ranged, bool_and(coalesce(type in ('MedicationOrder', 'Allergy'), false)) orders,
  bool_and(coalesce(type = 'Diagnosis', false)) dxs, bool_and(coalesce(type in ('Diagnosis', 'LabResult', 'MedicationOrder', 'Allergy', 'Encounter'), false)) clinical from ci left join nodes on ci.pid = nodes.pid and ci.node_id = nodes.node_id group by 1, 2, 3),
ve as (select cl.*, coalesce(n_cited, 0) n_cited, case when coalesce(n_missing, 0) > 0 then 'CONTRADICTED' when coalesce(case ctype when 'lab_trend' then n_cited >= 2 or (n_cited = 1 and labs and ranged) when 'medication_interaction' then n_cited = 2 and orders
  when 'followup_gap' then n_cited = 1 and dxs when 'diagnosis_change' then case when coalesce(n_cited, 0) > 0 then clinical else "absence" end when 'administrative' then n_cited > 0 end, false) then 'ENTAILED' else 'INSUFFICIENT' end verdict
  from cl left join k on cl.pid = k.pid and cl.qid = k.qid and cl."no" = k."no"),
ru(ct, threshold, escalate) as ({dims.sql_rows(RULES)}),
sc as (select ve.*, case when raw_conf <= {_D(TEST_KNOTS[0][0])} then {_D(TEST_KNOTS[0][1])} when raw_conf >= {_D(TEST_KNOTS[-1][0])} then {_D(TEST_KNOTS[-1][1])} {_SEG} end score, threshold, escalate from ve left join ru on ctype = ct),
de as (select *, case when verdict <> 'ENTAILED' then 'SUPPRESSED' when score < threshold then 'ABSTAINED' else 'PUBLISHED' end "action" from sc),
an as (select cov.pid, cov.qid, intent, reason is not null or coalesce(p, 0) = 0 refused, case when reason is not null then reason when coalesce(p, 0) = 0 then '{SILENCE}' end reason, cast(coalesce(p, 0) as integer) n_published, cast(coalesce(s, 0) as integer) n_suppressed, cast(case when reason is null then coalesce(a, 0) else 1 end as integer) n_abstained
  from cov left join (select pid, qid, count(*) filter (where "action" = 'PUBLISHED') p, count(*) filter (where "action" = 'SUPPRESSED') s, count(*) filter (where "action" = 'ABSTAINED') a from de group by 1, 2) z on z.pid = cov.pid and z.qid = cov.qid)"""

QUERIES = {
    "claims": q_claims, "claim_citations": claim_citations, "verify_claims": verify_claims, "citations_missing": citations_missing, "abstention_decisions": abstention_decisions, "answers_or_refusal": answers_or_refusal,
    "audit_rollup": audit_rollup, "audit_metrics": audit_metrics, "allergy_claims": allergy_claims,
}
ORACLE = {
    "claims": f"with {CLAIM_SQL} select pid, qid, printf('c_%02d', \"no\") claim_id, ctype, raw_conf, severity, \"absence\", text from cl",
    "claim_citations": f'with {CLAIM_SQL} select pid, qid, "no", node_id from ci',
    "verify_claims": f'with {CLAIM_SQL} select pid, qid, "no", ctype, n_cited, verdict from ve',
    "citations_missing": f"with {CLAIM_SQL} select pid, qid, \"no\", node_id from ci where not exists (select 1 from nodes where nodes.pid = ci.pid and nodes.node_id = ci.node_id and nodes.node_id not like '%7')",
    "abstention_decisions": f"with {CLAIM_SQL} select pid, qid, \"no\", ctype, score, threshold, \"action\", case when \"action\" <> 'PUBLISHED' then escalate end escalate_to from de",
    "answers_or_refusal": f"with {CLAIM_SQL} select * from an",
    "audit_rollup": f"with {CLAIM_SQL} select coalesce(intent, 'all') intent, count(*) asked, count(*) filter (where refused) refused, cast(sum(n_published) as bigint) published, cast(sum(n_suppressed) as bigint) suppressed, cast(sum(n_abstained) as bigint) abstained from an group by rollup (intent)",
    "audit_metrics": f"""with {CLAIM_SQL} select (select count(*) from de) examined, (select count(*) from de where "action" = 'PUBLISHED') published, (select count(*) from de where "action" = 'PUBLISHED' and verdict <> 'ENTAILED') unsupported, (select count(*) from de where "action" <> 'PUBLISHED') withheld,
        (select count(*) from ci) citations, (select count(distinct (pid, node_id)) from ci) cited_nodes, (select count(*) from an) asked, (select count(*) from an where refused) refused""",
    "allergy_claims": """with al as (select o_custkey pid, l_orderkey || '_' || l_linenumber node_id, p_brand substance from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_returnflag = 'R'),
        me as (select o_custkey pid, l_orderkey || '_' || l_linenumber node_id, p_brand drug from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linestatus = 'O' and l_discount >= 0.05)
        select al.pid, al.node_id src, me.node_id dst, 'The record documents a ' || substance || ' allergy while it is ordered.' as text, cast(0.94 as double) raw_conf, 'high' severity from al join me on al.pid = me.pid and lower(substance) = lower(drug)""",
}
ORACLE["claim_citations"] = dims.as_integers(ORACLE["claim_citations"], "no")
ORACLE["verify_claims"] = dims.as_integers(ORACLE["verify_claims"], "no")
ORACLE["citations_missing"] = dims.as_integers(ORACLE["citations_missing"], "no")
ORACLE["abstention_decisions"] = dims.as_integers(ORACLE["abstention_decisions"], "no")
