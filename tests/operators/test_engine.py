import json
import os
import random

import pytest
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators import calibration as K
from chartloom.operators import claims, identity, questions, references, registry, retrieval, units
from chartloom.operators.components import components
from chartloom.plans import pipeline
from chartloom.sources import uploads
from chartloom.streaming import ingest

DOCS = "doc_id bigint, patient_id string, created_at string"
PATS = "id string, created_at string"
REFS = "fact_id bigint, patient_id string, doc_id bigint, loaded_at timestamp"


def test_references_missing_late_and_nothing(spark):
    t = "2024-05-01 10:00:00"
    pats = spark.createDataFrame([("p1", "2024-01-01"), (" P2", "2024-09-01"), ("p3", None), ("p4", "1900-01-01"), ("p1", "2023-01-01")], PATS)
    docs = spark.createDataFrame([(1, "p1", "2024-03-01"), (2, "nobody", "2024-03-01"), (3, "n/a", "2024-03-01"), (4, None, None), (5, "0", "2024-03-01"), (6, "P2 ", "2024-03-01")], DOCS)
    facts = spark.createDataFrame([(10, "p2", 1), (11, "p3", 2), (12, "p4", 99), (13, "gone", 0), (14, "none", None)], "fact_id bigint, patient_id string, doc_id bigint").withColumn("loaded_at", F.lit(t).cast("timestamp_ntz"))
    got = {tuple(r) for r in references.chart_references(docs, facts, pats).collect()}
    assert got == {
        ("documents", "patient_id", 2, "missing", "2024-03"), ("documents", "patient_id", 5, "missing", "2024-03"), ("documents", "patient_id", 6, "late", "2024-03"),
        ("facts", "patient_id", 10, "late", "2024-05"), ("facts", "patient_id", 13, "missing", "2024-05"), ("facts", "doc_id", 12, "missing", "2024-05"),
    }
    assert references.chart_references(docs.limit(0), facts.limit(0), pats).count() == 0
    hot = spark.range(3000).select((F.col("id") + 100).alias("doc_id"), F.lit("nobody").alias("patient_id"), F.lit("2024-03-01").alias("created_at"))
    assert references.chart_references(docs.unionByName(hot), facts.limit(0), pats).where("status = 'missing'").count() == 3002


FACT6 = "fact_id bigint, doc_id bigint, page_no int, char_start int, char_end int, kind string, name string, value double, unit string, loinc string, meta string"
LAB6 = "row_id bigint, doc_id bigint, page_no int, loinc string, display string, value double, unit string"
ANA6 = "loinc string, display string, unit string, molar_mass double, decimals int"


@pytest.mark.parametrize(
    "analyte, value, unit, want",
    [
        (("a", "Calcium", "mg/dL", 40.078, 2), 2.5, "mmol/L", 1002), (("a", "Calcium", "mg/dL", 40.078, 2), 5.0, "mEq/L", 1002), (("a", "Albumin", "g/dL", None, 1), 40.0, "g/L", 40), (("a", "Iron", "ug/dL", 55.845, 0), 20.0, "umol/L", 112),
        (("a", "Ferritin", "ng/mL", None, 0), 0.5, "mg/L", 500), (("a", "Body temperature", "°C", None, 1), 98.6, "°F", 370), (("a", "Body weight", "kg", None, 1), 100.0, "lb", 454), (("a", "Body height", "cm", None, 0), 70.0, "inches", 178),
        (("a", "Lipase", "U/L", None, 0), 1.0, "ukat/L", 60), (("a", "Thyrotropin", "mIU/L", None, 2), 0.005, "IU/L", 500), (("a", "Neutrophils", "K/uL", None, 1), 5000.0, "/mm3", 50), (("a", "Systolic blood pressure", "mmHg", None, 0), 16.0, "kPa", 120),
        (("a", "Lactate", "mmol/L", 90.08, 1), 18.0, "mg/dL", 20), (("a", "Calcium", "mg/dL", 40.078, 2), 9.0, "MG / DL", None), (("a", "Calcium", "mg/dL", 40.078, 2), 9.0, "arb.", None), (("a", "Calcium", "mg/dL", 40.078, 2), None, "mmol/L", None),
    ],
)
def test_factors(spark, analyte, value, unit, want):
    labs = spark.createDataFrame([(1, 1, 1, "a", analyte[1], value, unit)], LAB6)
    none = spark.createDataFrame([], FACT6)
    pages = spark.createDataFrame([], "doc_id bigint, page_no int, text string")
    got = units.changed(units.convert(none, labs, pages, spark.createDataFrame([analyte], ANA6))).collect()
    assert [r.scaled for r in got] == ([want] if want is not None else [])


def test_unit_from_name_meta_page_and_default(spark):
    ana = spark.createDataFrame([("a", "Calcium", "mg/dL", 40.078, 2), ("w", "Body weight", "kg", None, 1)], ANA6)
    page = "Calcium     2.5   mmol/L   2.1 - 2.6\n"
    facts = [
        (1, 1, 1, 0, len(page) - 1, "lab", "Calcium", 2.5, None, "a", None), (2, 1, 1, None, None, "lab", "Calcium (mmol/L)", 2.5, None, None, None), (3, 1, 1, None, None, "vital", "Body weight", None, None, "w", '{"raw": "220,5pounds"}'),
        (4, 1, 1, None, None, "lab", "Calcium", 2.5, None, "a", None), (5, 1, 1, None, None, "med", "Calcium", 2.5, "mmol/L", "a", None), (6, 1, 1, None, None, "lab", "Nothing known", 2.5, "mmol/L", None, None),
    ]
    f = spark.createDataFrame(facts, FACT6)
    pages = spark.createDataFrame([(1, 1, page), (1, 1, page), (1, 1, "a copy that differs")], "doc_id bigint, page_no int, text string").where("text like 'Calcium%'")
    labs = spark.createDataFrame([], LAB6)
    got = {r.row_id: r.scaled for r in units.changed(units.convert(f, labs, pages, ana)).collect()}
    assert got == {1: 1002, 2: 1002, 3: 1000}
    got = {r.row_id: r.scaled for r in units.changed(units.convert(f, labs, pages, ana, defaults=[("facts", "a", "mmol/l")])).collect()}
    assert got == {1: 1002, 2: 1002, 3: 1000, 4: 1002}


def test_components_of_a_long_chain_and_a_star(spark):
    n = 70
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(n)] + [("s", f"s{i}") for i in range(40)] + [("c000", "c000"), ("x", "nowhere")]
    nodes = sorted({v for e in edges for v in e if v != "nowhere"} | {"lonely"})
    got = {r.key: r.label for r in components(spark.createDataFrame([(v,) for v in nodes], "key string"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(n + 1)} == {"c000"} and {got[f"s{i}"] for i in range(40)} == {"s"} and got["lonely"] == "lonely" and len(got) == len(nodes)


def test_identity(spark):
    assert identity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and identity.jaro_winkler("", "a") == 0.0 and identity.jaro_winkler("abc", "xyz") == 0.0 and identity.jaro_winkler("same", "same") == 1.0
    r = spark.createDataFrame(
        [("1", "Quill, Ada", "1950-02-03", "F", "M1", "12 Elm St"), ("2", "ADA QUILL", "1950-02-03", "F", "L9", ""), ("3", "Zed Ott", "1950-02-03", "F", "", None), ("4", "Other Name", "1999-01-01", None, "M1", None), ("5", None, None, None, None, None), ("6", None, None, None, "", None)],
        "rec string, name string, dob string, sex string, mrn string, address string",
    )
    assert {(x.i, x.j) for x in identity.blocking_pairs(r).collect()} == {("1", "2"), ("1", "3"), ("2", "3"), ("1", "4")}
    m = {(x.i, x.j): x for x in identity.matched(identity.pair_features(r)).collect()}
    assert m["1", "4"].score == 0.995 and m["1", "4"].same and 0.73 < m["1", "3"].score < 0.89
    sims = spark.createDataFrame([("1950-02-03", "1950-03-02"), ("1950-02-03", "1951-02-03"), ("1950-02-03", "1950-02-09"), ("x", "1950-02-03")], "a string, b string").select(identity.dob_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [round(x.s, 2) for x in sims] == [0.9, 0.6, 0.75, 0.0]


def test_calibration(spark):
    assert K.pool([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)]) == [(0.1, 0.0), (0.25, 0.5), (0.4, 1.0)]
    assert [y for _, y in K.pool(K.DEFAULT_POINTS)] == [1.0] * 5
    pts = [(0.5 + (i * 7 % 40) / 100, int(i * 13 % 10 > 4)) for i in range(200)]
    got = [(r.x, r.y) for r in K.fit(spark.createDataFrame(pts, "x double, y int")).orderBy("k").collect()]
    assert [v for p in got for v in p] == pytest.approx([v for x in K.pool([(round(x, 3), y) for x, y in pts]) for v in x]) and K.fit(spark.createDataFrame([], "x double, y int")).count() == 0
    p = spark.createDataFrame([(1, 0.1), (2, 0.75), (3, 0.99), (4, 0.8)], "id int, x double")
    got = {r.id: round(r.score, 4) for r in K.predict_join(p, spark.createDataFrame([(k, *v) for k, v in enumerate(K.TEST_KNOTS)], "k int, x double, y double")).collect()}
    assert got == {1: 0.2, 2: 0.375, 3: 1.0, 4: 0.55}
    assert K.predict_join(p, spark.createDataFrame([], "k int, x double, y double")).where("score = x").count() == 4


def test_questions_are_answered_or_refused(spark):
    rows = [(i, i, "p1", 1, 0, 1, "regex", "lab", "Creatinine", v, "mg/dL", f"2025-0{i}-15", None, 0.6, 1.3, None, False, None) for i, v in enumerate([0.85, 1.06, 1.27, 1.48], 1)]
    rows += [(10, 1, "p1", 1, 0, 1, "regex", "dx", "Chronic asthma", None, None, "2025-01-15", None, None, None, None, False, None)]
    schema = "fact_id bigint, doc_id bigint, patient_id string, page_no int, char_start int, char_end int, extractor string, kind string, name string, value double, unit string, time_iso string, loinc string, ref_low double, ref_high double, abnormal boolean, negated boolean, meta string"
    analytes = dims.rows(spark, dims.ANALYTES, "loinc string, display string, unit string, ref_low double, ref_high double, hi_is_worse boolean")
    asked = [(1, "Is the kidney function worsening?"), (2, "What is the blood type?"), (3, "Any drug interaction?"), (4, "Did the asthma get better?"), (5, "Was there a stroke?"), (6, None)]
    got = {r.qid: (r.intent, r.refused, r.reason) for r in pipeline.ask(spark.createDataFrame(rows, schema), analytes, asked, ["2160-0", "33914-3"]).collect()}
    assert got[1] == ("trend", False, None) and got[2][1] and "blood-bank" in got[2][2] and got[3] == ("interaction", True, "no MedicationOrder nodes exist in this record")
    assert got[4] == ("general", True, claims.SILENCE) and "cerebrovascular" in got[5][2] and got[6] == ("general", True, claims.SILENCE)
    plans = {r.qid: (r.intent, r.months) for r in questions.plans(spark.createDataFrame([(1, "trend over 18 months"), (2, "trend over 12 months"), (3, "no show?")], "qid int, query string")).collect()}
    assert plans == {1: ("trend", 18), 2: ("trend", None), 3: ("followup", None)}
    assert pipeline.ask(spark.createDataFrame([], schema), analytes, asked, ["2160-0"]).count() == 0


def test_bad_citations_are_contradicted(spark):
    n = spark.createDataFrame([("p", "m1", "MedicationOrder", None), ("p", "l1", "LabResult", 1.3)], "pid string, node_id string, type string, ref_high double")
    c = spark.createDataFrame([("p", 1, 1, "medication_interaction", 0.9, "high", "", False), ("p", 2, 1, "lab_trend", 0.93, "high", "", False), ("p", 3, 1, "lab_trend", 0.9, "high", "", False), ("p", 4, 1, "diagnosis_change", 0.7, "info", "", True), ("p", 5, 1, "unheard", 0.99, "info", "", False)], "pid string, qid int, no int, ctype string, raw_conf double, severity string, text string, absence boolean")
    k = spark.createDataFrame([("p", 1, 1, "m1"), ("p", 1, 1, "gone"), ("p", 2, 1, "l1"), ("p", 5, 1, "l1")], "pid string, qid int, no int, node_id string")
    d = {r.qid: (r.verdict, r.action, r.threshold) for r in claims.decided(claims.verified(c, k, n)).collect()}
    assert d == {1: ("CONTRADICTED", "SUPPRESSED", 0.90), 2: ("ENTAILED", "PUBLISHED", 0.85), 3: ("INSUFFICIENT", "SUPPRESSED", 0.85), 4: ("ENTAILED", "ABSTAINED", 0.85), 5: ("INSUFFICIENT", "SUPPRESSED", 0.85)}


def test_retrieval(spark):
    spans = retrieval.chunk_spans("beta " * 300, 200, 60)
    assert all(e - s <= 220 for s, e in spans) and all(a[1] - b[0] >= 50 for a, b in zip(spans, spans[1:])) and spans[-1][1] == 1499 and retrieval.chunk_spans("x" * 5000) == [(0, 5000)] and retrieval.chunk_spans(" \n") == []
    parts = spark.createDataFrame([(1, "aspirin and rest"), (2, "warfarin warfarin dose"), (3, "warfarin once with a long tail of other words")], "seq int, body string")
    q = spark.createDataFrame([("a", "warfarin"), ("b", "zzz"), ("c", "")], "query_id string, query string")
    got = {}
    for r in retrieval.top_k(parts, q, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.seq, r.score > 0))
    assert got == {"a": [(2, True), (3, True)], "b": [(1, False), (2, False)], "c": [(1, False), (2, False)]}
    assert retrieval.top_k(parts.limit(0), q).count() == 0


def test_registry(spark):
    p = spark.createDataFrame([("a", " M1 "), ("b", "M2"), ("c", None), ("d", "")], "id string, mrn string")
    pay = spark.createDataFrame([("1", "M3", "Ada", "1950-02-03", "F", None, 1), ("2", "M3", "Bob", "1950-02-03T10:00", None, None, 2), ("3", "M1", "Cy", "1950-02-03", " ", None, 3), ("4", " ", "Di", "1950-02-03", None, None, 4), ("5", "M5", "Ed", "02/03/1950", None, None, 5), ("6", "M6", " ", "1950-02-03", None, None, 6), ("7", "M7", "Fi", "1950-02-30", None, None, 7)], "payload_id string, mrn string, name string, dob string, sex string, id string, received_at int")
    assert {r.payload_id: r.status for r in registry.accepted(p, pay).collect()} == {"1": "created", "2": "MRN requested before", "3": "MRN exists", "4": "MRN is required", "5": "DOB is no ISO date", "6": "name is required", "7": "DOB is no ISO date"}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "x", 1)], "k int, v string, load int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "e", 0)], "k int, v string, load int")
    assert {tuple(r) for r in registry.merged(old, new, ["k"], ["load"]).collect()} == {(1, "a", 1), (2, "c", 1), (3, "d", 1)}


def test_uploads(spark, tmp_path):
    lines = {"a.txt": b"one\x0c \x0ctwo", "b.TXT": "caf\xe9".encode("latin-1"), "c.docx": b"x", "d.pdf": b"%PDF-1.4", "f.txt": b"  \n", "g": b"x", "h.txt": b"%PDF-"}
    for k, v in lines.items():
        (tmp_path / k).write_bytes(v)
    f = uploads.files(spark, str(tmp_path))
    assert {r.filename: r.s for r in f.select("filename", uploads.status(F.col("filename"), F.col("content")).alias("s")).collect()} == {"a.txt": "ok", "b.TXT": "ok", "c.docx": "office format", "d.pdf": "no PDF reader", "f.txt": "blank", "g": "unknown ending", "h.txt": "no PDF reader"}
    assert spark.range(1).select(uploads.status(F.lit("e.txt"), F.lit(b"")).alias("a"), uploads.status(F.lit("e.txt"), F.lit(None).cast("binary")).alias("b")).collect() == [("empty", "empty")]
    assert {(r.filename, r.page_no, r.text) for r in uploads.pages(f).collect()} == {("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.TXT", 1, "café")}
    assert uploads.pages(f, lambda b: ["p1", " ", "p3"]).where("filename = 'd.pdf'").count() == 2
    uploads.write_corpus(spark.createDataFrame([(1, "p", "lab", "x")], "doc_id bigint, pid string, kind string, text string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/manifest")).collect()[0].documents == 1


def test_stream_of_pages_becomes_facts_and_charts(spark, tmp_path):
    analytes = dims.rows(spark, dims.ANALYTES, "loinc string, display string, unit string, ref_low double, ref_high double, hi_is_worse boolean")
    page = "Analyte\nCollected: 0{}/15/2025\nCreatinine   1.{}   mg/dL   0.60 - 1.30\n"
    for i in (1, 2):
        spark.createDataFrame([(i, 1, page.format(i, i), "P1")], ingest.PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.page_stream(spark, str(tmp_path / "in"), 1), analytes, str(tmp_path / "facts"), str(tmp_path / "charts"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "facts")).where("kind = 'lab'").count() == 2
    last = max(p for p in os.listdir(tmp_path / "charts") if p.startswith("batch="))
    assert spark.read.parquet(str(tmp_path / "charts" / last)).where("type = 'LabResult'").count() == 2
    q.stop()


def test_event_windows(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "x", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {(r.start[11:13], r.n, r["last"]) for r in ingest.event_counts(e).collect()} == {("00", 2, 2.0), ("01", 1, 3.0)}
    e.write.parquet(str(tmp_path / "ev"))
    q = ingest.event_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("evs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert spark.table("evs").count() == 2


def test_plan_queries_name_no_missing_module():
    import __spark_entry__

    assert len(__spark_entry__.queries()) > 100 and json.dumps(sorted(__spark_entry__.oracle_sql()))


def test_services_over_a_folder(spark, sf):
    from chartloom.plans.facade import Engine, NotFound

    e = Engine(spark, sf)
    f = e.table("facts").where("patient_id is not null and page_no is not null").select("patient_id", "doc_id", "page_no").orderBy("fact_id").first()
    key = f.patient_id
    assert e.patients().count() == e.table("patients").count() and {r.tbl for r in e.status().collect()} == {"patients", "documents", "pages", "facts"}
    assert e.nodes(key).select("pid").distinct().count() == 1 and e.edges(key).where("etype = 'occurs_during'").count() <= e.nodes(key).count()
    page = e.page(f.doc_id, f.page_no).collect()
    assert len(page) == 1 and page[0].spans
    with pytest.raises(NotFound):
        e.page(-1, 1)
    with pytest.raises(NotFound):
        e.patient("nobody at all")
    got = {r.qid: r.refused for r in e.ask([(1, "What is the blood type?"), (2, "When was the last visit?")], key).collect()}
    assert got == {1: True, 2: False} and [r.action for r in e.trace(key, 6, 1).collect()] == ["PUBLISHED"]
    ok, bad = e.register(e.table("patient_payloads"))
    assert ok.count() + bad.count() == e.table("patient_payloads").count()
    moved, charts = e.attach(spark.createDataFrame([(f.doc_id, "pat_new")], "doc_id bigint, new_pid string"))
    assert moved.where("patient_id = 'pat_new'").count() > 0 and {r.pid for r in charts.select("pid").distinct().collect()} <= {"pat_new", key.strip().lower()}


def test_store_schemas(spark, tmp_path):
    from chartloom.sources import tables

    tables.create_store(spark, str(tmp_path))
    tables.create_store(spark, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "facts.parquet")).count() == 0
    old = spark.createDataFrame([("a", 5), ("a", 6), (None, 7)], "id string, extra int")
    assert tables.conformed(old, tables.STORE["patients"]).columns == "id name dob mrn sex patient_json created_at".split() and [(r.id, r.n) for r in tables.repeated_keys(old, "id").collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path), "labels")


def test_model_clients():
    from chartloom.operators import prose

    assert prose.payload_of('```json\n{"facts": []}\n```') == {"facts": []} and prose.payload_of('Sure: {"a": 1} done') == {"a": 1} and prose.payload_of("[1]") is None and prose.payload_of(None) is None
    said, slept = [], []

    def ask(p):
        said.append(p)
        if len(said) < 3:
            raise prose.Unavailable
        return "no json" if len(said) == 3 else '{"facts": []}'

    assert prose.retrying(ask, sleep=slept.append)("hello") == {"facts": []} and slept == [1, 2] and len(said) == 4 and said[3].startswith("hello\n")
    with pytest.raises(prose.Unavailable):
        prose.retrying(lambda p: (_ for _ in ()).throw(prose.Unavailable()), sleep=slept.append)("x")


def test_suggested_intents_replace_only_general_ones(spark):
    p = questions.plans(spark.createDataFrame([(1, "hello"), (2, "any interaction?"), (3, "hi")], "qid int, query string"))
    s = spark.createDataFrame([(1, "trend"), (2, "trend"), (3, "dance")], "qid int, intent string")
    assert {r.qid: r.intent for r in questions.replanned(p, s).collect()} == {1: "trend", 2: "interaction", 3: "general"}


def test_rendered_reports_parse_back(spark):
    from chartloom.operators import extraction

    rows = [(1, "Ada Quill", "M-1", "02/03/1950", "04/15/2025", k, n, v, u, r, f) for k, (n, v, u, r, f) in enumerate([("Creatinine", 1.48, "mg/dL", "0.60 - 1.30", "H"), ("INR", 1.1, "ratio", "0.80 - 1.20", None)])]
    text = uploads.lab_layout(spark.createDataFrame(rows, "doc_id bigint, patient string, mrn string, dob string, collected string, place int, name string, value double, unit string, range string, flag string"))
    pages = text.withColumn("page_no", F.lit(1))
    a = spark.createDataFrame([("c", "Creatinine"), ("i", "INR")], "loinc string, display string")
    got = sorted((r.name, r.value, r.unit, r.ref_low, r.ref_high, r.abnormal, r.time_iso) for r in extraction.lab_rows(pages, a).collect())
    assert got == [("Creatinine", 1.48, "mg/dL", 0.6, 1.3, True, "2025-04-15"), ("INR", 1.1, "ratio", 0.8, 1.2, False, "2025-04-15")]
    assert [(r.name, r.mrn, r.dob) for r in extraction.demographics(pages).collect()] == [("Ada Quill", "M-1", "1950-02-03")]


def test_spread_join_meets_every_pair_of_a_hot_key_once(spark, monkeypatch):
    a = spark.createDataFrame([("f", i) for i in range(30)] + [("g", 1), (None, 2)], "k string, x int")
    b = spark.createDataFrame([("f", i) for i in range(20)] + [("g", 3), ("g", 3), (None, 4)], "k string, y int")
    monkeypatch.setattr(identity, "PAIRS_A_PART", 40)
    for left, right in ((a, b), (b, a)):
        got = sorted((r.k, r.x, r.y) for r in identity.spread_join(left, right, "k").collect())
        assert got == sorted([("f", x, y) for x in range(30) for y in range(20)] + [("g", 1, 3)] * 2)


def test_records_of_several_rows_and_of_both_blocks_pair_once(spark):
    rows = [("a", "Ann Lee", "1950-01-02", "F", "M1"), ("b", "Ann Lea", "1950-01-02", "F", "M1"), ("c", "Bo Lee", "1950-01-02", "M", "M1"), ("d", "Bo Lee", None, "M", "M2"), ("d", "Bo Li", "1950-01-02", "M", " "), (None, "Bo Lee", "1950-01-02", "M", "M1")]
    r = spark.createDataFrame([(*x, None) for x in rows], "rec string, name string, dob string, sex string, mrn string, address string")
    for similar in (identity.edit_similarity, identity.jaro_winkler_column):
        direct, by_pairs = identity.pair_features(r, similar), identity.pair_features(r, similar, identity.blocking_pairs(r))
        key = lambda df: sorted((x.i, x.j, x.equal_mrn, round(x.mean, 9)) for x in df.collect())
        assert key(direct) == key(by_pairs) and [x[:2] for x in key(direct)] == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "d")]


def test_jaro_winkler_of_many_pairs_equals_that_of_each():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé𝒳") for _ in range(rnd.randrange(0, 12)))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    a[:3], b[:3] = ["martha", "", "same"], ["marhta", "", "same"]
    assert identity.jaro_winkler_rows(a, b).tolist() == pytest.approx([identity.jaro_winkler(x, y) for x, y in zip(a, b)], abs=1e-12)
    assert len(identity.jaro_winkler_rows([], [])) == 0
