"""The registry: validation, keyed updates, uniqueness, listings, re-attribution, audit rows.

Keyed writes are merges of an old and a new table (the newer row of a key wins), so they run as one shuffle by key and
can be repeated. Defined results: null and blank keys are refused with a reason and never merged; of equal keys the
latest row wins, ties the larger content; lists of empty tables are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions.times import iso_micros
from chartloom.operators.chart import CHART_SQL, chart
from chartloom.operators.facts import person_key
from chartloom.operators.texts import page_rows
from chartloom.sources.tables import read


def blank_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def iso_day(c: Column) -> Column:
    """The day of an ISO date or date and time, null for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?$"), F.date_format(F.try_to_date(F.substring(t, 1, 10)), "yyyy-MM-dd"))


def validated(payloads: DataFrame) -> DataFrame:
    """Create requests with their trimmed fields and the reason for which they are refused (null if none)."""
    p = payloads.select("payload_id", blank_null(F.col("mrn")).alias("mrn"), iso_day(F.col("dob")).alias("dob"), F.col("dob").alias("dob_typed"), blank_null(F.col("name")).alias("name"), blank_null(F.col("sex")).alias("sex"), blank_null(F.col("id")).alias("id"), "received_at")
    reason = F.when(F.col("mrn").isNull(), "MRN is required").when(blank_null(F.col("dob_typed")).isNull(), "DOB is required").when(F.col("dob").isNull(), "DOB is no ISO date").when(F.col("name").isNull(), "name is required")
    return p.withColumn("reason", reason).drop("dob_typed")


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Insert or replace: the row with the highest version of each key; new rows win over old ones of equal version."""
    cols = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    both = both.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull())
    rest = [c for c in cols if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(*version, "_new", *[c for c in rest if c not in version])).alias("s"))
    return best.select(*[F.col(c) if c in keys else F.col(f"s.{c}").alias(c) for c in cols])


def accepted(patients: DataFrame, payloads: DataFrame) -> DataFrame:
    """(payload_id, status): created, or why not: not valid, number taken (by the registry or by an earlier request)."""
    v = validated(payloads)
    taken = patients.select(blank_null(F.col("mrn")).alias("mrn")).where("mrn is not null").distinct().withColumn("taken", F.lit(True))
    first = v.where("reason is null").groupBy("mrn").agg(F.min(F.struct("received_at", "payload_id")).alias("f")).select("mrn", F.col("f.payload_id").alias("winner"))
    r = v.join(taken, "mrn", "left").join(first, "mrn", "left")
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("taken"), "MRN exists").when(F.col("winner") != F.col("payload_id"), "MRN requested before").otherwise("created")
    return r.select("payload_id", status.alias("status"))


def updated(patients: DataFrame, changes: DataFrame) -> DataFrame:
    """patients with the demographic fields that changes (id, name, dob, mrn, sex) give; null fields leave the old value."""
    c = changes.select("id", *[F.col(k).alias(f"new_{k}") for k in ("name", "dob", "mrn", "sex")])
    return patients.join(c, "id", "left").select("id", *[F.coalesce(f"new_{k}", k).alias(k) for k in ("name", "dob", "mrn", "sex")], "created_at")


def reattributed(facts: DataFrame, attach: DataFrame) -> DataFrame:
    """facts of the documents in attach (doc_id, new_pid) under their new person; one row a document decides."""
    a = attach.groupBy("doc_id").agg(F.max("new_pid").alias("new_pid"))
    return facts.join(a, "doc_id", "left").withColumn("patient_id", F.coalesce("new_pid", "patient_id")).drop("new_pid")


def touched(facts: DataFrame, attach: DataFrame) -> DataFrame:
    """(pid): the persons whose charts an attachment changes, old and new ones."""
    f = facts.join(attach, "doc_id")
    return f.select(person_key(F.col("patient_id")).alias("pid")).unionByName(f.select(person_key(F.col("new_pid")).alias("pid"))).where("pid is not null").distinct()


def registry_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validated(read(spark, sf, "patient_payloads")).select("payload_id", "mrn", "dob", "name", "sex", "reason")


def registry_accept(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(read(spark, sf, "patients"), read(spark, sf, "patient_payloads"))


def mrn_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that several registry rows hold: the uniqueness that no constraint enforces here."""
    return read(spark, sf, "patients").select(blank_null(F.col("mrn")).alias("mrn")).where("mrn is not null").groupBy("mrn").agg(F.count("*").alias("n")).where("n > 1")


def registry_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose name, number or id holds the trimmed text, without case."""
    q = " ANA ".strip().lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return read(spark, sf, "patients").where(has("name") | has("mrn") | has("id")).select("id", "name")


def doc_counts_per_patient(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(person_key(F.col("patient_id")).alias("pid")).where("pid is not null").groupBy("pid").agg(F.count("*").alias("n"))
    p = read(spark, sf, "patients").select("id", person_key(F.col("id")).alias("pid"))
    return p.join(d, "pid", "left").select("id", F.coalesce("n", F.lit(0)).alias("doc_count"))


def node_counts_per_patient(spark: SparkSession, sf: str) -> DataFrame:
    c = chart(spark, sf).groupBy("pid").agg(F.count("*").alias("n"))
    p = read(spark, sf, "patients").select("id", person_key(F.col("id")).alias("pid"))
    return p.join(c, "pid", "left").select("id", F.coalesce("n", F.lit(0)).alias("node_count"))


def documents_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's ten latest documents by creation; the rank is cut before the shuffle."""
    d = read(spark, sf, "documents").select("doc_id", person_key(F.col("patient_id")).alias("pid"), iso_micros(F.col("created_at")).alias("us"))
    w = Window.partitionBy("pid").orderBy(F.col("us").desc_nulls_last(), "doc_id")
    return d.where("pid is not null").withColumn("place", F.row_number().over(w)).where("place <= 10").select("pid", "doc_id", "place")


def attach_reassign(spark: SparkSession, sf: str) -> DataFrame:
    """Facts per person after the documents of the walk-in chart go to the person whose document is next by id."""
    d = read(spark, sf, "documents").select("doc_id", person_key(F.col("patient_id")).alias("pid"))
    attach = d.where("pid like '%walkin%'").select("doc_id", F.concat(F.lit("pat_new"), F.col("doc_id").cast("string")).alias("new_pid"))
    r = reattributed(read(spark, sf, "facts").select("fact_id", "doc_id", "patient_id"), attach)
    return r.select("fact_id", person_key(F.col("patient_id")).alias("pid"))


def attach_touched(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", person_key(F.col("patient_id")).alias("pid"))
    attach = d.where("pid like '%walkin%'").select("doc_id", F.concat(F.lit("pat_new"), F.col("doc_id").cast("string")).alias("new_pid"))
    return touched(read(spark, sf, "facts").select("doc_id", "patient_id"), attach)


def rebuild_touched(spark: SparkSession, sf: str) -> DataFrame:
    """Charts rebuilt only for the persons that the attachment touches: node counts by type."""
    from chartloom.operators.chart import nodes

    d = read(spark, sf, "documents").select("doc_id", person_key(F.col("patient_id")).alias("pid"))
    attach = d.where("pid like '%walkin%'").select("doc_id", F.concat(F.lit("pat_new"), F.col("doc_id").cast("string")).alias("new_pid"))
    f = read(spark, sf, "facts")
    changed = touched(f.select("doc_id", "patient_id"), attach)
    r = reattributed(f, attach)
    r = r.withColumn("pid", person_key(F.col("patient_id"))).join(changed, "pid", "left_semi").drop("pid")
    return nodes(r, read(spark, sf, "analytes")).groupBy("pid", "type").agg(F.count("*").alias("n"))


def upsert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The table after a second load in which each third document comes again with its kind as now detected."""
    from chartloom.functions.text import document_kind

    d = read(spark, sf, "documents")
    old = d.select("doc_id", "kind", F.lit(1).alias("load"))
    return merged(old, d.where("doc_id % 3 = 0").select("doc_id", document_kind(F.col("text")).alias("kind"), F.lit(2).alias("load")), ["doc_id"], ["load"])


def upsert_patients(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after the demographic changes of the payloads that name its id or, by number, its row."""
    p = read(spark, sf, "patients")
    by_mrn = p.select("id", blank_null(F.col("mrn")).alias("mrn")).where("mrn is not null").groupBy("mrn").agg(F.min("id").alias("id"))
    v = validated(read(spark, sf, "patient_payloads")).where("reason is null")
    latest = v.groupBy("mrn").agg(F.max(F.struct("received_at", "payload_id", "name", "dob", "sex")).alias("s")).join(by_mrn, "mrn")
    return updated(p, latest.select("id", "s.name", "s.dob", F.lit(None).cast("string").alias("mrn"), "s.sex")).select("id", "name", "dob", "sex")


def upsert_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Append with the primary key (document, page, place, content): repeated facts once, missing offsets as 0."""
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    f = read(spark, sf, "facts").select("doc_id", z("page_no"), z("char_start"), z("char_end"), "kind", "name", "value", "fact_id")
    return f.groupBy("doc_id", "page_no", "char_start", "char_end", "kind", "name", "value").agg(F.min("fact_id").alias("fact_id")).select("doc_id", "page_no", "char_start", "char_end", "fact_id")


def page_with_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with how many facts point into it and what they cover at most."""
    s = read(spark, sf, "facts").groupBy("doc_id", "page_no").agg(F.count("*").alias("spans"), F.min("char_start").alias("first"), F.max("char_end").alias("last"))
    p = page_rows(read(spark, sf, "pages"))
    return p.join(s, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.length("text").alias("size"), F.coalesce("spans", F.lit(0)).alias("spans"), "first", "last")


def patient_record(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's record in one row: demographics, documents and nodes by type (get, list and health are filters of it)."""
    c = chart(spark, sf).groupBy("pid").agg(*[F.count_if(F.col("type") == t).alias(t.lower()) for t in ("Encounter", "Diagnosis", "LabResult", "MedicationOrder", "VitalSeries")])
    p = read(spark, sf, "patients").select("id", person_key(F.col("id")).alias("pid"), "name", "dob", "mrn", "sex")
    return p.join(c, "pid", "left").select("id", "name", "dob", "mrn", "sex", *[F.coalesce(t, F.lit(0)).alias(t) for t in ("encounter", "diagnosis", "labresult", "medicationorder", "vitalseries")])


def service_status(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the tables: what a health request reports."""
    out = None
    for t in ("patients", "documents", "pages", "facts"):
        r = read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
        out = r if out is None else out.unionByName(r)
    return out


_B = lambda c: f"nullif(trim({c}), '')"
_PK = lambda c: f"nullif(lower(trim({c})), '')"
_DAY = r"case when regexp_matches(trim(dob), '^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?$') then strftime(try_cast(substr(trim(dob), 1, 10) as date), '%Y-%m-%d') end"
_VAL = f"""va as (select payload_id, {_B('mrn')} mrn, {_DAY} dob, {_B('"name"')} "name", {_B('sex')} sex, received_at,
  case when {_B('mrn')} is null then 'MRN is required' when {_B('dob')} is null then 'DOB is required' when {_DAY} is null then 'DOB is no ISO date' when {_B('"name"')} is null then 'name is required' end reason from patient_payloads)"""
_US = r"epoch_us(try_cast(case when regexp_matches(n, '(Z|[+-]\d\d:?\d\d)$') and regexp_matches(n, '\d\d:\d\d:\d\d') then n when regexp_matches(n, '\d\d:\d\d:\d\d') then n || 'Z' else n || 'T00:00:00Z' end as timestamptz))"
_ATT = f"atd as (select doc_id, 'pat_new' || doc_id new_pid from documents where {_PK('patient_id')} like '%walkin%')"
_REFACTS = f"{_ATT}, fx as (select facts.* exclude (patient_id), coalesce(new_pid, patient_id) patient_id, patient_id old_pid, new_pid from facts left join atd on facts.doc_id = atd.doc_id), tch as (select {_PK('old_pid')} pid from fx where new_pid is not null and {_PK('old_pid')} is not null union select lower(new_pid) from fx where new_pid is not null)"

QUERIES = {
    "registry_validate": registry_validate, "registry_accept": registry_accept, "mrn_duplicates": mrn_duplicates, "registry_search": registry_search, "doc_counts_per_patient": doc_counts_per_patient, "node_counts_per_patient": node_counts_per_patient,
    "documents_latest": documents_latest, "attach_reassign": attach_reassign, "attach_touched": attach_touched, "rebuild_touched": rebuild_touched, "upsert_documents": upsert_documents, "upsert_patients": upsert_patients,
    "upsert_facts": upsert_facts, "page_with_spans": page_with_spans, "patient_record": patient_record, "service_status": service_status,
}
from chartloom.operators.texts import kind_sql as _kind_sql  # noqa: E402

ORACLE = {
    "registry_validate": f'with {_VAL} select payload_id, mrn, dob, "name", sex, reason from va',
    "registry_accept": f"""with {_VAL}, w as (select mrn, min_by(payload_id, (received_at, payload_id)) winner from va where reason is null group by 1), tk as (select distinct {_B('mrn')} mrn from patients where {_B('mrn')} is not null)
        select payload_id, case when reason is not null then reason when tk.mrn is not null then 'MRN exists' when winner <> payload_id then 'MRN requested before' else 'created' end status from va left join tk on va.mrn = tk.mrn left join w on w.mrn = va.mrn""",
    "mrn_duplicates": f"select {_B('mrn')} mrn, count(*) n from patients where {_B('mrn')} is not null group by 1 having count(*) > 1",
    "registry_search": """select id, "name" from patients where contains(lower("name"), 'ana') or contains(lower(mrn), 'ana') or contains(lower(id), 'ana')""",
    "doc_counts_per_patient": f"select id, coalesce(n, 0) doc_count from patients left join (select {_PK('patient_id')} pid, count(*) n from documents group by 1) d on {_PK('id')} = pid",
    "node_counts_per_patient": f"with {CHART_SQL}, x as (select pid, count(*) n from nodes group by 1) select id, coalesce(n, 0) node_count from patients left join x on {_PK('id')} = pid",
    "documents_latest": rf"""with d as (select doc_id, {_PK('patient_id')} pid, regexp_replace(trim(created_at), '^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})', '\1-\2-\3T\4:\5:\6') n from documents)
        select pid, doc_id, row_number() over (partition by pid order by {_US} desc nulls last, doc_id) place from d where pid is not null qualify place <= 10""",
    "attach_reassign": f"with {_ATT} select fact_id, {_PK('coalesce(new_pid, patient_id)')} pid from facts left join atd on facts.doc_id = atd.doc_id",
    "attach_touched": f"with {_REFACTS} select pid from tch",
    "rebuild_touched": f"with {_REFACTS}, {CHART_SQL.replace('from facts where', 'from (select * from fx where ' + _PK('patient_id') + ' in (select pid from tch)) where')} select pid, type, count(*) n from nodes group by 1, 2",
    "upsert_documents": f"select doc_id, case when doc_id % 3 = 0 then {_kind_sql('text')} else kind end kind, case when doc_id % 3 = 0 then 2 else 1 end load from documents",
    "upsert_patients": f"""with {_VAL}, l as (select * from va where reason is null qualify row_number() over (partition by mrn order by received_at desc, payload_id desc) = 1), m as (select {_B('mrn')} mrn, min(id) id from patients where {_B('mrn')} is not null group by 1)
        select p.id, coalesce(l."name", p."name") "name", coalesce(l.dob, p.dob) dob, coalesce(l.sex, p.sex) sex from patients p left join m on m.id = p.id left join l on l.mrn = m.mrn""",
    "upsert_facts": "select doc_id, coalesce(page_no, 0) page_no, coalesce(char_start, 0) char_start, coalesce(char_end, 0) char_end, min(fact_id) fact_id from facts group by 1, 2, 3, 4, kind, \"name\", value",
    "page_with_spans": """with p as (select doc_id, page_no, min(text) as text from pages where text is not null group by 1, 2), s as (select doc_id, page_no, count(*) spans, min(char_start) "first", max(char_end) "last" from facts group by 1, 2)
        select p.doc_id, p.page_no, cast(length(text) as integer) size, coalesce(spans, 0) spans, "first", "last" from p left join s on p.doc_id = s.doc_id and p.page_no = s.page_no""",
    "patient_record": f"""with {CHART_SQL}, x as (select pid, {", ".join(f"count(*) filter (where type = '{t}') {t.lower()}" for t in ("Encounter", "Diagnosis", "LabResult", "MedicationOrder", "VitalSeries"))} from nodes group by 1)
        select id, "name", dob, mrn, sex, {", ".join(f"coalesce({t}, 0) {t}" for t in ("encounter", "diagnosis", "labresult", "medicationorder", "vitalseries"))} from patients left join x on {_PK('id')} = pid""",
    "service_status": "select 'patients' tbl, count(*) n from patients union all select 'documents', count(*) from documents union all select 'pages', count(*) from pages union all select 'facts', count(*) from facts",
}
ORACLE["documents_latest"] = dims.as_integers(ORACLE["documents_latest"], "place")
