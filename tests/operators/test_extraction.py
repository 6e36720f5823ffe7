from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import extraction as X
from chartloom.operators import prose as P
from chartloom.operators import texts

PAGE = "doc_id bigint, page_no int, text string"
LAB = (
    "MOUNT HARROW LABORATORY\nPatient: Ada Quill   MRN: M-12\nDOB: 02/03/1950   Collected: 04/15/2025\nCreatinine rose before.\n"
    "Creatinine        1.48   mg/dL   0.60 - 1.30   H\nINR      1.1            0.80 - 1.20\nUnheard of   3   x\nSodium 131 mmol/L\nPotassium   4.0   mmol/L   3.5  -  5.1\nGlucose   pending   mg/dL\nCreatinine        1.48   mg/dL   1.30 - 0.60   H\n"
)


def test_expressions(spark):
    def one(e):
        return spark.range(1).select(e.alias("x")).collect()[0].x

    lit = F.lit
    assert one(T.us_date(lit("on 2/31/2025 or 3/1/2025"))) == "2025-02-31" and one(T.us_date(lit("13/1/2025"))) is None
    assert [one(T.number(lit(x))) for x in ("<5.0", "-3", "5 mg", "1e5")] == [5.0, -3.0, None, None]
    assert tuple(one(T.reference_range(lit("9 - 3")))) == (3.0, 9.0) and tuple(one(T.reference_range(lit("<5.0")))) == (5.0, None) and tuple(one(T.reference_range(lit(">1000")))) == (None, 1000.0)
    assert one(T.reference_range(lit("5"))) is None and one(T.cells(lit("a  b   c d  "))) == ["a", "b", "c d"]
    assert [one(T.stance(lit(s))) for s in ("She denies pain.", "Possible infiltrate.", "Pain is present.", "Normal gait today.", "unlikely to recur")] == ["NEGATED", "SPECULATIVE", "ASSERTED", "NEGATED", "SPECULATIVE"]
    assert [one(T.document_kind(lit(s))) for s in ("Directions: take 1 tablet; Analyte", "ANALYTE", "Discharge Summary", "", None)] == ["rx", "lab", "note", "unknown", "unknown"]
    assert one(T.sentences(lit("Short. This is long enough!  And so is this?"))) == ["This is long enough!", "And so is this?"]
    assert one(T.tokens(lit("The Red-cell count of A é42"))) == ["red", "cell", "count", "42"] and one(T.lines(lit("a\r\nb c"))) == ["a\r\n", "b ", "c"]


def test_lab_rows_point_to_their_table_rows(spark):
    pages = spark.createDataFrame([(1, 1, LAB), (1, 1, LAB), (2, 1, None), (3, 1, " "), (4, 1, "x" * 100_000)], PAGE)
    analytes = spark.createDataFrame([("c", "Creatinine"), ("i", "INR"), ("s", "Sodium"), ("k", "Potassium"), ("g", "Glucose")], "loinc string, display string")
    rows = sorted(X.lab_rows(pages, analytes).collect(), key=lambda r: r.char_start)
    assert [(r.name, r.value, r.unit, r.ref_low, r.ref_high, r.abnormal, r.time_iso) for r in rows] == [
        ("Creatinine", 1.48, "mg/dL", 0.6, 1.3, True, "2025-04-15"), ("INR", 1.1, None, 0.8, 1.2, False, "2025-04-15"), ("Potassium", 4.0, "mmol/L", None, None, None, "2025-04-15"), ("Creatinine", 1.48, "mg/dL", 0.6, 1.3, True, "2025-04-15"),
    ]
    assert all(LAB[r.char_start : r.char_end] == r.name for r in rows) and rows[0].char_start > LAB.index("Creatinine")
    assert X.lab_rows(pages.limit(0), analytes).count() == 0
    d = X.demographics(pages).collect()
    assert [(r.name, r.mrn, r.dob) for r in d] == [("Ada Quill", "M-12", "1950-02-03")]


def test_rx_rows(spark):
    text = "Prescription History\nMedication   Strength   Directions   Date\nMetformin     500 mg      Take 1 tablet   PO BID      01/05/2024\nnothing   here   at all\nLisinopril   10 mg   daily\n"
    r = sorted(X.rx_rows(spark.createDataFrame([(1, 1, text)], PAGE)).collect(), key=lambda r: r.char_start)
    assert [(x.name, x.dose, x.frequency, x.time_iso) for x in r] == [("Metformin", "500 mg", "Take 1 tablet PO BID", "2024-01-05"), ("Lisinopril", "10 mg", "daily", None)]


def test_encounters_of_every_layout(spark):
    e = X.encounter_facts(spark.createDataFrame(X.LAYOUT_PAGES, PAGE)).collect()
    got = {(r.doc_id, r.name.split(":", 1)[1], r.admit, r.discharge) for r in e}
    assert got == {
        (-1, "inpatient:2026-01-15", "2026-01-15", "2026-01-22"),  # a stay hides the collection
        (-2, "inpatient:2025-03-04", "2025-03-04", "2025-03-09"), (-2, "inpatient:2025-05-01#1", "2025-05-01", None),
        (-3, "inpatient:2025-02-31", None, "2025-02-31"), (-3, "inpatient:2025-06-07#1", None, "2025-06-07"),
        (-4, "outpatient:2025-07-08", "2025-07-08", "2025-07-08"), (-4, "outpatient:2025-07-08#1", "2025-07-08", "2025-07-08"), (-4, "outpatient:2025-09-09#2", "2025-09-09", "2025-09-09"),
        (-5, "inpatient:2025-01-03", "2025-01-03", "2025-01-05"), (-5, "inpatient:2025-01-03#1", "2025-01-03", "2025-01-09"), (-5, "inpatient:2025-01-03#2", "2025-01-03", None),
    }
    texts_ = {r[0]: r[2] for r in X.LAYOUT_PAGES}
    assert all(X.T.US_DATE and texts_[r.doc_id][r.char_start : r.char_end].count("/") == 2 for r in e)
    assert {r.facility for r in e if r.doc_id == -1} == {"MOUNT HARROW HOSPITAL"} and {r.service for r in e if r.doc_id == -1} == {"Internal Medicine"}


def test_lines_of_repeated_pages_count_once(spark):
    pages = spark.createDataFrame([(1, 1, "a\nb"), (1, 1, "a\nb"), (1, 2, "c")], PAGE)
    assert sorted((r.page_no, r.line_no, r.start) for r in texts.page_lines(pages).collect()) == [(1, 0, 0), (1, 1, 2), (2, 0, 0)]


def test_prose_takes_only_what_the_text_bears_out(spark):
    text = "Chronic kidney disease (N18.3) is stable. She denies chest pain. Possible infiltrate seen. Creatinine was 1.2 and creatinine was 1.4."
    items = [
        {"kind": "dx", "name": "Chronic kidney disease (N18.3)", "phrase": "Chronic kidney disease (N18.3)"}, {"kind": "dx", "name": "chest pain", "phrase": "chest pain"}, {"kind": "finding", "name": "infiltrate", "phrase": "infiltrate"},
        {"kind": "lab", "name": "Creatinine", "phrase": "reatinine was", "value": "1.2"}, {"kind": "lab", "name": "Creatinine", "phrase": "reatinine was", "value": 1.4}, {"kind": "dx", "name": "gone", "phrase": "not in the text"},
    ]
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "boom"), (3, 1, None), (4, 1, "bad")], PAGE)

    def client(t):
        if t == "boom":
            raise RuntimeError("no model")
        return {"facts": items if t != "bad" else [*items, {"kind": "dx", "name": "x", "phrase": "bad", "negated": "yes"}]}

    got = sorted(P.prose_facts(pages, client).collect(), key=lambda r: r.char_start)
    assert [(r.doc_id, r.kind, r.name, r.code, r.category, r.reported_as, r.value) for r in got] == [(1, "dx", "Chronic kidney disease", "N18.3", "renal", None, None), (1, "note_stance", "chest pain", None, "unspecified", "dx", None), (1, "lab", "Creatinine", None, None, None, 1.2), (1, "lab", "Creatinine", None, None, None, 1.4)]
    assert len({r.char_start for r in got}) == 4 and got[2].loinc == "2160-0"
    assert P.prose_facts(pages, None).count() == 0 and P.checked("no json") is None and P.checked({"facts": [1]}) is None
