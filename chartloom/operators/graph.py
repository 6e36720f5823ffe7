"""Temporal graphs of charts: typed edges between nodes, counts, neighbours and positions on a time axis.

An edge joins two nodes of one person, so both ends exist by construction. Defined results: observations without an
encounter have no occurs_during edge; undated nodes have no place on the axis; allergies and drugs are compared as the
operator says (`ci`: without case); empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators.chart import CHART_SQL, chart
from chartloom.operators.ordered import ranked
from chartloom.sources.tables import read


def edge(df: DataFrame, src: str, dst: str, etype: str) -> DataFrame:
    return df.select("pid", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(etype).alias("etype"))


def occurs_during(n: DataFrame) -> DataFrame:
    """Observations to the encounter that they were attributed to; orders of drugs have none."""
    return edge(n.where("type in ('Diagnosis', 'LabResult', 'ImagingStudy', 'Note') and encounter_id is not null"), "node_id", "encounter_id", "occurs_during")


def precedes(n: DataFrame) -> DataFrame:
    """Each encounter to the next of its person: numbers are dense, so the next is found by an equi-join, not a window."""
    e = n.where("type = 'Encounter'").select("pid", "node_id", "ord")
    nxt = e.select("pid", F.col("node_id").alias("next_id"), (F.col("ord") - 1).alias("ord"))
    return edge(e.join(nxt, ["pid", "ord"]), "node_id", "next_id", "precedes")


def co_occurs(n: DataFrame) -> DataFrame:
    """Diagnoses of one encounter, the earlier number first."""
    d = n.where("type = 'Diagnosis' and encounter_id is not null").select("pid", "encounter_id", "node_id", "ord")
    e = d.select("pid", "encounter_id", F.col("node_id").alias("other"), F.col("ord").alias("ord2"))
    return edge(d.join(e, ["pid", "encounter_id"]).where("ord < ord2"), "node_id", "other", "co_occurs_with")


def supersedes(allergies: DataFrame) -> DataFrame:
    """A later allergy (pid, node_id, substance, time, ord) to every earlier one of the same substance."""
    a = allergies.select("pid", F.lower("substance").alias("s"), "node_id", F.struct(F.coalesce("time", F.lit("~")).alias("time"), "ord").alias("at"))
    b = a.select("pid", "s", F.col("node_id").alias("earlier"), F.col("at").alias("at2"))
    return edge(a.join(b, ["pid", "s"]).where("at > at2"), "node_id", "earlier", "supersedes")


def allergy_contraindicated(allergies: DataFrame, meds: DataFrame) -> DataFrame:
    """Allergies (pid, node_id, substance) to the drug orders (pid, node_id, drug) of that substance, active or not."""
    a = allergies.select("pid", F.lower("substance").alias("s"), "node_id")
    m = meds.select("pid", F.lower("drug").alias("s"), F.col("node_id").alias("med"))
    return edge(a.join(m, ["pid", "s"]), "node_id", "med", "contraindicated_with")


def interacting(meds: DataFrame, pairs: list[tuple], ci: bool = False) -> DataFrame:
    """Orders (pid, node_id, drug) of two drugs that interact, with the pair's number, severity and text."""
    fold = F.lower if ci else (lambda c: F.col(c))
    i = F.broadcast(dims.rows(meds.sparkSession, [(k, *p) for k, p in enumerate(pairs)], "pair int, drug_a string, drug_b string, severity string, why string"))  # literal rows
    m = meds.select("pid", "node_id", fold("drug").alias("drug"))
    left = m.withColumnRenamed("drug", "drug_a").join(i, "drug_a")
    right = m.select("pid", F.col("node_id").alias("other"), F.col("drug").alias("drug_b"))
    return left.join(right, ["pid", "drug_b"]).select("pid", F.col("node_id").alias("src"), F.col("other").alias("dst"), "pair", "drug_a", "drug_b", "severity", "why")


def drug_orders(n: DataFrame) -> DataFrame:
    return n.where("type = 'MedicationOrder'").select("pid", "node_id", F.col("display").alias("drug"), "time", "ord")


def chart_edges(n: DataFrame, pairs: list[tuple] = dims.TEST_INTERACTIONS) -> DataFrame:
    """All edges that a chart of facts has."""
    drug = edge(interacting(drug_orders(n), pairs), "src", "dst", "contraindicated_with")
    return occurs_during(n).unionByName(precedes(n)).unionByName(co_occurs(n)).unionByName(drug)


def trade_allergies(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in rows, as no table holds allergies: the returned lines of a customer, substance = brand."""
    l = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("time"))
    return _of_customer(spark, sf, l, "p_brand").select("pid", "node_id", F.col("word").alias("substance"), "time", F.col("node_id").alias("ord"))


def trade_meds(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in rows: the open lines of a customer, drug = brand in capitals, until quantity days later."""
    l = read(spark, sf, "lineitem").where("l_linestatus = 'O' and l_discount >= 0.05").select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("time"))
    return _of_customer(spark, sf, l, "p_brand").select("pid", "node_id", F.upper("word").alias("drug"), "time")


def _of_customer(spark: SparkSession, sf: str, lines: DataFrame, word: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pid"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(word).alias("word"))
    return lines.join(o, "l_orderkey").join(p, "l_partkey").withColumn("node_id", F.concat_ws("_", "l_orderkey", "l_linenumber"))


def edges_occurs_during(spark: SparkSession, sf: str) -> DataFrame:
    return occurs_during(chart(spark, sf))


def edges_precedes(spark: SparkSession, sf: str) -> DataFrame:
    return precedes(chart(spark, sf))


def edges_co_occurs(spark: SparkSession, sf: str) -> DataFrame:
    return co_occurs(chart(spark, sf))


def edges_supersedes(spark: SparkSession, sf: str) -> DataFrame:
    return supersedes(trade_allergies(spark, sf))


def edges_allergy_contra(spark: SparkSession, sf: str) -> DataFrame:
    return allergy_contraindicated(trade_allergies(spark, sf), trade_meds(spark, sf))


def edges_interaction(spark: SparkSession, sf: str) -> DataFrame:
    return interacting(drug_orders(chart(spark, sf)), dims.TEST_INTERACTIONS)


def interaction_overlap_ext(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the plain pairs: only orders that begin within 30 days of each other, drugs compared without case."""
    m = drug_orders(chart(spark, sf))
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    t = m.select("pid", "node_id", day("time").alias("d"))
    i = interacting(m, dims.TEST_INTERACTIONS, ci=True).select("pid", "src", "dst", "pair")
    i = i.join(t.toDF("pid", "src", "d1"), ["pid", "src"]).join(t.toDF("pid", "dst", "d2"), ["pid", "dst"])
    return i.where(F.abs(F.datediff("d1", "d2")) <= 30).select("pid", "src", "dst", "pair")


def graph_stats_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return chart(spark, sf).groupBy("pid", "type").agg(F.count("*").alias("n"))


def graph_stats_edges(spark: SparkSession, sf: str) -> DataFrame:
    return chart_edges(chart(spark, sf)).groupBy("pid", "etype").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, of: DataFrame, etype: str | None = None, direction: str = "out") -> DataFrame:
    """(pid, node_id, neighbour) of the nodes of (pid, node_id) along edges of a type in a direction."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges if etype is None else edges.where(F.col("etype") == etype)
    return e.select("pid", F.col(here).alias("node_id"), F.col(there).alias("neighbour")).join(of.select("pid", "node_id"), ["pid", "node_id"])


def neighbours_out(spark: SparkSession, sf: str) -> DataFrame:
    n = chart(spark, sf)
    return neighbours(chart_edges(n), n.where("type = 'Diagnosis'"))


def neighbours_in(spark: SparkSession, sf: str) -> DataFrame:
    n = chart(spark, sf)
    return neighbours(chart_edges(n), n.where("type = 'Encounter'"), "occurs_during", "in")


def nodes_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnoses by the letter of their code, laboratory results by analyte."""
    n = chart(spark, sf).where("type in ('Diagnosis', 'LabResult')")
    key = F.when(F.col("type") == "LabResult", F.col("loinc")).otherwise(F.coalesce(F.substring("code", 1, 1), F.lit("unspecified")))
    return n.groupBy("type", key.alias("category")).agg(F.count("*").alias("n"), F.countDistinct("pid").alias("persons"))


def nodes_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's place in the list of its person's nodes by id."""
    n = chart(spark, sf).withColumn("head", F.substring("node_id", 1, 6))
    return ranked(n, ["pid"], ["node_id"], "head", "place").select("pid", "node_id", "place")


def timeline_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where each dated node lies between its person's first and last time, in percent; the bounds are one row a person."""
    from chartloom.functions.times import iso_micros

    n = chart(spark, sf).select("pid", "node_id", iso_micros(F.col("time")).alias("t")).where("t is not null")
    span = n.groupBy("pid").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return n.join(span, "pid").select("pid", "node_id", ((F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 100).alias("pct"))


#: The chart's edges in SQL.
EDGE_SQL = f"""{CHART_SQL},
inter(pair, drug_a, drug_b, severity, why) as ({dims.sql_rows([(k, *p) for k, p in enumerate(dims.TEST_INTERACTIONS)])}),
ix as (select m1.pid, m1.node_id src, m2.node_id dst, pair, drug_a, drug_b, severity, why from nodes m1 join inter on m1.display = drug_a join nodes m2 on m2.pid = m1.pid and m2.display = drug_b where m1.type = 'MedicationOrder' and m2.type = 'MedicationOrder'),
edges as (
    select pid, node_id src, encounter_id dst, 'occurs_during' etype from nodes where type in ('Diagnosis', 'LabResult', 'ImagingStudy', 'Note') and encounter_id is not null
    union all select * from (select pid, enc_id src, lead(enc_id) over (partition by pid order by ord) dst, 'precedes' etype from e) where dst is not null
    union all select x.pid, x.node_id, y.node_id, 'co_occurs_with' from nodes x join nodes y on x.pid = y.pid and x.encounter_id = y.encounter_id and x.ord < y.ord where x.type = 'Diagnosis' and y.type = 'Diagnosis'
    union all select pid, src, dst, 'contraindicated_with' from ix)"""
_TRADE = """al as (select o_custkey pid, l_orderkey || '_' || l_linenumber node_id, p_brand substance, strftime(l_shipdate, '%Y-%m-%d') t from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_returnflag = 'R'),
me as (select o_custkey pid, l_orderkey || '_' || l_linenumber node_id, upper(p_brand) drug from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linestatus = 'O' and l_discount >= 0.05)"""
_MICROS = "epoch_us(try_cast(time as timestamp))"

QUERIES = {
    "edges_occurs_during": edges_occurs_during, "edges_precedes": edges_precedes, "edges_co_occurs": edges_co_occurs, "edges_supersedes": edges_supersedes, "edges_allergy_contra": edges_allergy_contra,
    "edges_interaction": edges_interaction, "interaction_overlap_ext": interaction_overlap_ext, "graph_stats_nodes": graph_stats_nodes, "graph_stats_edges": graph_stats_edges, "neighbours_out": neighbours_out,
    "neighbours_in": neighbours_in, "nodes_by_category": nodes_by_category, "nodes_sorted": nodes_sorted, "timeline_positions": timeline_positions,
}
ORACLE = {
    **{f"edges_{k}": f"with {EDGE_SQL} select * from edges where etype = '{v}'" for k, v in (("occurs_during", "occurs_during"), ("precedes", "precedes"), ("co_occurs", "co_occurs_with"))},
    "edges_supersedes": f"with {_TRADE} select x.pid, x.node_id src, y.node_id dst, 'supersedes' etype from al x join al y on x.pid = y.pid and lower(x.substance) = lower(y.substance) and (x.t, x.node_id) > (y.t, y.node_id)",
    "edges_allergy_contra": f"with {_TRADE} select al.pid, al.node_id src, me.node_id dst, 'contraindicated_with' etype from al join me on al.pid = me.pid and lower(substance) = lower(drug)",
    "edges_interaction": f"with {EDGE_SQL} select * from ix",
    "interaction_overlap_ext": f"""with {EDGE_SQL}, m as (select pid, node_id, try_cast(substr(time, 1, 10) as date) d from nodes where type = 'MedicationOrder')
        select ix.pid, src, dst, pair from ix join m m1 on ix.pid = m1.pid and src = m1.node_id join m m2 on ix.pid = m2.pid and dst = m2.node_id where abs(date_diff('day', m2.d, m1.d)) <= 30""",
    "graph_stats_nodes": f"with {CHART_SQL} select pid, type, count(*) n from nodes group by 1, 2",
    "graph_stats_edges": f"with {EDGE_SQL} select pid, etype, count(*) n from edges group by 1, 2",
    "neighbours_out": f"with {EDGE_SQL} select pid, src node_id, dst neighbour from edges semi join nodes on edges.pid = nodes.pid and src = node_id and type = 'Diagnosis'",
    "neighbours_in": f"with {EDGE_SQL} select pid, dst node_id, src neighbour from edges where etype = 'occurs_during'",
    "nodes_by_category": f"with {CHART_SQL} select type, case when type = 'LabResult' then loinc else coalesce(substr(code, 1, 1), 'unspecified') end category, count(*) n, count(distinct pid) persons from nodes where type in ('Diagnosis', 'LabResult') group by 1, 2",
    "nodes_sorted": f"with {CHART_SQL} select pid, node_id, row_number() over (partition by pid order by node_id) place from nodes",
    "timeline_positions": f"""with {CHART_SQL}, n as (select pid, node_id, {_MICROS} t from nodes), s as (select pid, min(t) lo, max(t) hi from n group by 1)
        select n.pid, node_id, (t - lo) / greatest(hi - lo, 1) * 100 pct from n join s on n.pid = s.pid where t is not null""",
}
ORACLE["nodes_sorted"] = dims.as_integers(ORACLE["nodes_sorted"], "place")
