"""What screens and exports derive from charts: segments of pages, places of terms, labels, sources, audit lists, bundles.

Defined results: spans are clipped to their page, empty ones dropped; a span inside an earlier or equal kept one is
dropped; a term is looked up by its longest begin that occurs; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import claims as C
from chartloom.operators.chart import CHART_SQL, chart
from chartloom.operators.facts import person_key
from chartloom.operators.graph import EDGE_SQL, chart_edges
from chartloom.operators.texts import page_rows
from chartloom.session import written
from chartloom.sources.tables import read

AUDIT_LIMIT = 50


def kept_spans(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, start, fin, priority): the spans (char_start, char_end, priority) of each page that no earlier one contains.

    In the order of start (longer and higher priority first on ties) a span is inside an earlier one if its end is not
    beyond the running maximum of the ends: one window over a page's spans.
    """
    p = page_rows(pages).select("doc_id", "page_no", F.length("text").alias("size"))
    s = spans.join(p, ["doc_id", "page_no"]).select("doc_id", "page_no", "size", F.greatest(F.lit(0), F.least("char_start", "size")).alias("start"), F.greatest(F.lit(0), F.least("char_end", "size")).alias("fin"), "priority")
    s = s.where("fin > start").distinct()
    w = Window.partitionBy("doc_id", "page_no").orderBy("start", F.desc("priority"), F.desc("fin"))
    before = F.max("fin").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("before", before).where("before is null or fin > before").select("doc_id", "page_no", "size", "start", "fin", "priority")


def page_segments(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, start, fin, cited): the kept spans and the gaps between them, in order over the whole page."""
    k = kept_spans(spans, pages)
    w = Window.partitionBy("doc_id", "page_no").orderBy("start", "fin")
    k = k.withColumn("cursor", F.coalesce(F.lag("fin").over(w), F.lit(0))).withColumn("nxt", F.lead("start").over(w))
    gap = k.where("start > cursor").select("doc_id", "page_no", F.col("cursor").alias("start"), F.col("start").alias("fin"), F.lit(False).alias("cited"))
    tail = k.where("nxt is null and fin < size").select("doc_id", "page_no", F.col("fin").alias("start"), F.col("size").alias("fin"), F.lit(False).alias("cited"))
    own = k.select("doc_id", "page_no", "start", "fin", F.lit(True).alias("cited"))
    bare = page_rows(pages).select("doc_id", "page_no", F.length("text").alias("fin")).where("fin > 0").join(k.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
    return own.unionByName(gap).unionByName(tail).unionByName(bare.select("doc_id", "page_no", F.lit(0).alias("start"), "fin", F.lit(False).alias("cited")))


def needles(term: Column) -> Column:
    """A term and its begins of four, two and one words, the longest first, without a comma or semicolon at the end."""
    words = F.split(F.trim(term), r"\s+")
    short = F.array(*[F.when(F.size(words) > n, F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), "[,;]$", "")) for n in (4, 2, 1)])
    return F.array_distinct(F.filter(F.concat(F.array(F.trim(term)), short), lambda x: x.isNotNull() & (x != "")))


def located(terms: DataFrame, pages: DataFrame, most_pages: int = 3) -> DataFrame:
    """(key, doc_id, page_no, char_start, needle): where the longest begin of a term occurs first.

    terms: (key, doc_id, term), so each term meets only its own document's pages, of which the first three are read.
    """
    p = page_rows(pages).where(F.col("page_no") <= most_pages)
    t = terms.select("key", "doc_id", F.posexplode(needles(F.col("term"))).alias("rung", "needle")).join(p, "doc_id")
    hit = t.withColumn("at", F.instr("text", F.col("needle"))).where("at > 0")
    return hit.groupBy("key").agg(F.min(F.struct("rung", "page_no", "doc_id", (F.col("at") - 1).alias("char_start"), "needle")).alias("s")).select("key", "s.doc_id", "s.page_no", "s.char_start", "s.needle")


def label() -> Column:
    """A node's text in lists: result and unit, drug and dose, name or code, visit and day."""
    unit = F.when(F.col("unit").isNotNull() & (F.col("unit") != ""), F.concat(F.lit(" "), F.col("unit"))).otherwise(F.lit(""))
    return (
        F.when(F.col("type") == "LabResult", F.concat(F.coalesce("display", "loinc"), F.lit(" "), F.coalesce(F.col("value").cast("string"), F.lit("")), unit))
        .when(F.col("type") == "MedicationOrder", F.trim(F.concat(F.col("display"), F.lit(" "), F.coalesce("dose", F.lit("")))))
        .when(F.col("type") == "Encounter", F.concat(F.coalesce("encounter_type", F.lit("encounter")), F.lit(" "), F.substring("time", 1, 10)))
        .otherwise(F.coalesce("display", "code", "node_id"))
    )


def q_page_segments(spark: SparkSession, sf: str) -> DataFrame:
    f = read(spark, sf, "facts").where("char_start is not null and char_end is not null")
    # Facts of the model's extraction stand for the cited span.
    return page_segments(f.select("doc_id", "page_no", "char_start", "char_end", F.when(F.col("extractor") == "llm", 2).otherwise(1).alias("priority")), read(spark, sf, "pages"))


def locate_term_ladder(spark: SparkSession, sf: str) -> DataFrame:
    n = chart(spark, sf).where("type in ('Diagnosis', 'MedicationOrder', 'LabResult') and doc_id is not null")
    return located(n.select(F.concat_ws("/", "pid", "node_id").alias("key"), "doc_id", F.col("display").alias("term")), read(spark, sf, "pages"))


def node_labels(spark: SparkSession, sf: str) -> DataFrame:
    return chart(spark, sf).where("type <> 'VitalSeries'").select("pid", "node_id", F.when(F.col("type") != "LabResult", label()).alias("label"), F.coalesce("display", "encounter_type", "type").alias("export_label"))


def node_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Where each node comes from: document, page (1 if unknown) and characters; null documents have no source."""
    n = chart(spark, sf).where("doc_id is not null")
    return n.select("pid", "node_id", "doc_id", F.coalesce("page_no", F.lit(1)).alias("page_no"), F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"))


def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that a person's record points at, by how its nodes come first (encounters, diagnoses, orders, results)."""
    order = F.expr("case type when 'Encounter' then 0 when 'Diagnosis' then 1 when 'MedicationOrder' then 2 when 'LabResult' then 3 else 4 end")
    return chart(spark, sf).where("doc_id is not null").groupBy("pid", "doc_id").agg(F.min(order).alias("first_kind"), F.count("*").alias("nodes"))


def citation_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The source fields behind each citation of each claim."""
    n, _, _, k = C._all(spark, sf)
    s = n.select("pid", "node_id", "type", "time", "code", "value", "unit", "ref_low", "ref_high", "dose")
    return k.join(s, ["pid", "node_id"]).select("pid", "qid", F.col("no").cast("int").alias("no"), "node_id", "type", "time", "code", "value", "unit", "ref_high", "dose")


def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(audit_id, pid, qid, refused, n_published): the answers as audit rows, numbered within their person."""
    return C.answers_or_refusal(spark, sf).select("pid", "qid", F.concat_ws("/", F.lit("audit"), "pid", F.lpad(F.col("qid").cast("string"), 4, "0")).alias("audit_id"), "refused", "n_published")


def audit_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest audit rows, a top-k report."""
    return audit_rows(spark, sf).orderBy(F.desc("audit_id")).limit(AUDIT_LIMIT)


def claim_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Published claims by audit row and claim id, with the decision: a claim id alone would not be unique."""
    n, cov, c, k = C._all(spark, sf)
    d = C.decided(C.verified(c, k, n)).where("action = 'PUBLISHED'")
    return d.select(F.concat_ws("/", F.lit("audit"), "pid", F.lpad(F.col("qid").cast("string"), 4, "0")).alias("audit_id"), F.format_string("c_%02d", "no").alias("claim_id"), "ctype", "threshold")


def export_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """One row a person for export: node and edge counts, trends and whether the record has three kinds of findings."""
    from chartloom.operators import temporal

    n = written(chart(spark, sf))
    e = chart_edges(n).groupBy("pid").agg(F.count("*").alias("edges"))
    t = temporal.trends(temporal.points(n)).groupBy("pid").agg(F.count("*").alias("trends"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.groupBy("pid").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "Encounter").alias("encounters")).join(e, "pid", "left").join(t, "pid", "left").select("pid", "nodes", "encounters", z("edges"), z("trends"))


def export_json(spark: SparkSession, sf: str) -> DataFrame:
    """The same bundle as JSON text, one object a person."""
    return export_bundle(spark, sf).select("pid", F.to_json(F.struct("encounters", "nodes")).alias("json"))


def bundle_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the documents by person and kind."""
    d = read(spark, sf, "documents").select(person_key(F.col("patient_id")).alias("pid"), F.coalesce("kind", F.lit("unknown")).alias("kind"), "n_chars")
    return d.where("pid is not null").groupBy("pid", "kind").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


_KEPT = """pg as (select doc_id, page_no, cast(length(min(text)) as integer) size from pages where text is not null group by 1, 2),
sp as (select distinct f.doc_id, f.page_no, size, greatest(0, least(char_start, size)) start, greatest(0, least(char_end, size)) fin, case when extractor = 'llm' then 2 else 1 end priority from facts f join pg on f.doc_id = pg.doc_id and f.page_no = pg.page_no where char_start is not null and char_end is not null),
sq as (select *, max(fin) over (partition by doc_id, page_no order by start, priority desc, fin desc rows between unbounded preceding and 1 preceding) bef from sp where fin > start),
kp as (select *, coalesce(lag(fin) over (partition by doc_id, page_no order by start, fin), 0) cur, lead(start) over (partition by doc_id, page_no order by start, fin) nxt from sq where bef is null or fin > bef)"""
_LBL = """case type when 'MedicationOrder' then trim(display || ' ' || coalesce(dose, '')) when 'Encounter' then coalesce(encounter_type, 'encounter') || ' ' || substr(time, 1, 10) else coalesce(display, code, node_id) end"""

QUERIES = {
    "page_segments": q_page_segments, "locate_term_ladder": locate_term_ladder, "node_labels": node_labels, "node_sources": node_sources, "document_ids": document_ids, "citation_sources": citation_sources, "audit_latest": audit_latest,
    "claim_trace": claim_trace, "export_bundle": export_bundle, "export_json": export_json, "bundle_documents": bundle_documents,
}
from chartloom.operators import temporal as _t  # noqa: E402

_BUNDLE = f"""{EDGE_SQL}, {_t._PTS}, {_t.TREND_SQL}, en as (select pid, count(*) edges from edges group by 1), tn as (select pid, count(*) trends from t where n >= 4 group by 1),
bu as (select z.pid, nodes, encounters, coalesce(edges, 0) edges, coalesce(trends, 0) trends from (select pid, count(*) nodes, count(*) filter (where type = 'Encounter') encounters from nodes group by 1) z left join en on en.pid = z.pid left join tn on tn.pid = z.pid)"""
ORACLE = {
    "page_segments": f"""with {_KEPT} select doc_id, page_no, start, fin, true cited from kp union all select doc_id, page_no, cur, start, false from kp where start > cur union all select doc_id, page_no, fin, size, false from kp where nxt is null and fin < size
        union all select doc_id, page_no, 0, size, false from pg where size > 0 and not exists (select 1 from kp where kp.doc_id = pg.doc_id and kp.page_no = pg.page_no)""",
    "locate_term_ladder": rf"""with {CHART_SQL}, tm as (select pid || '/' || node_id k, doc_id, trim(display) term, regexp_split_to_array(trim(display), '\s+') w from nodes where type in ('Diagnosis', 'MedicationOrder', 'LabResult') and doc_id is not null),
        nd as (select k, doc_id, 0 rung, term needle from tm union all select k, doc_id, 1, regexp_replace(array_to_string(w[1:4], ' '), '[,;]$', '') from tm where len(w) > 4 union all select k, doc_id, 2, regexp_replace(array_to_string(w[1:2], ' '), '[,;]$', '') from tm where len(w) > 2
          union all select k, doc_id, 3, regexp_replace(w[1], '[,;]$', '') from tm where len(w) > 1),
        pg as (select doc_id, page_no, min(text) as text from pages where text is not null and page_no <= 3 group by 1, 2)
        select k "key", nd.doc_id, page_no, cast(instr(text, needle) - 1 as integer) char_start, needle from nd join pg on nd.doc_id = pg.doc_id where needle <> '' and instr(text, needle) > 0 qualify row_number() over (partition by k order by rung, page_no) = 1""",
    "node_labels": f"with {CHART_SQL} select pid, node_id, case when type <> 'LabResult' then {_LBL} end \"label\", coalesce(display, encounter_type, type) export_label from nodes where type <> 'VitalSeries'",
    "node_sources": f"with {CHART_SQL} select pid, node_id, doc_id, coalesce(page_no, 1) page_no, coalesce(char_start, 0) char_start, coalesce(char_end, 0) char_end from nodes where doc_id is not null",
    "document_ids": f"with {CHART_SQL} select pid, doc_id, min(case type when 'Encounter' then 0 when 'Diagnosis' then 1 when 'MedicationOrder' then 2 when 'LabResult' then 3 else 4 end) first_kind, count(*) nodes from nodes where doc_id is not null group by 1, 2",
    "citation_sources": f'with {C.CLAIM_SQL} select ci.pid, qid, "no", ci.node_id, type, time, code, value, unit, ref_high, dose from ci join nodes on ci.pid = nodes.pid and ci.node_id = nodes.node_id',
    "audit_latest": f"with {C.CLAIM_SQL} select pid, qid, 'audit/' || pid || '/' || lpad(cast(qid as varchar), 4, '0') audit_id, refused, n_published from an order by audit_id desc limit {AUDIT_LIMIT}",
    "claim_trace": f"with {C.CLAIM_SQL} select 'audit/' || pid || '/' || lpad(cast(qid as varchar), 4, '0') audit_id, printf('c_%02d', \"no\") claim_id, ctype, threshold from de where \"action\" = 'PUBLISHED'",
    "export_bundle": f"with {_BUNDLE} select * from bu",
    "export_json": f"with {_BUNDLE} select pid, cast(json_object('encounters', encounters, 'nodes', nodes) as varchar) \"json\" from bu",
    "bundle_documents": "select nullif(lower(trim(patient_id)), '') pid, coalesce(kind, 'unknown') kind, count(*) documents, cast(sum(n_chars) as bigint) chars from documents where nullif(lower(trim(patient_id)), '') is not null group by 1, 2",
}
ORACLE["citation_sources"] = dims.as_integers(ORACLE["citation_sources"], "no")
