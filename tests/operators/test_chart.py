import pytest

from chartloom.operators import chart as C
from chartloom.operators import facts as F_
from chartloom.operators import graph as G
from chartloom.operators import ordered as O
from chartloom.operators import temporal as T

FACTS = "fact_id bigint, doc_id bigint, patient_id string, page_no int, char_start int, char_end int, extractor string, kind string, name string, value double, unit string, time_iso string, loinc string, ref_low double, ref_high double, abnormal boolean, negated boolean, meta string, extra int"
ANALYTES = "loinc string, display string, hi_is_worse boolean"


def fact(k, kind, name, value=None, time=None, doc=1, pid="p1", loinc=None, meta=None):
    return (k, doc, pid, 1, k, k + 1, "regex", kind, name, value, "mg/dL", time, loinc, 0.6, 1.3, None, False, meta, 0)


@pytest.fixture(scope="module")
def analytes(spark):
    return spark.createDataFrame([("2160-0", "Creatinine", True), ("33914-3", "eGFR", False)], ANALYTES)


def table(spark, rows):
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize(
    "encs, ts, want",
    [
        ([("e1", 1, "2025-01-10", "2025-01-20")], "2025-01-15", "e1"),  # inside a stay
        ([("e1", 1, "2025-01-10", None)], "2025-01-10", "e1"),  # the same day
        ([("e1", 1, "2025-01-10", "2025-01-20")], "2025-01-09", None),  # before
        ([("e1", 1, "2025-01-10", "2025-01-20")], "2025-01-21", None),  # after: no snapping to the nearest
        ([("e1", 1, "2025-01-12", None), ("e2", 2, "2025-01-10", "2025-01-20")], "2025-01-12", "e2"),  # a stay beats a visit of that day
        ([("e1", 1, "2024-11-01", "2025-02-01"), ("e2", 2, "2025-01-10", "2025-01-20")], "2025-01-12", "e1"),  # the first stay by order
        ([("e1", 1, "2025-01-10", "2025-01-20")], None, None),  # undated
        ([("e1", 1, "2025-01-20", "2025-01-10")], "2025-01-15", None),  # ends before it begins
        ([("e1", 1, "2025-01-10", "2025-01-20")], "2025-01-20T08:00:00", None),  # later than the last day as text
    ],
)
def test_attribution(spark, encs, ts, want):
    enc = spark.createDataFrame([("p1", *e) for e in encs], "pid string, enc_id string, ord int, start string, discharge string")
    got = C.attribution(spark.createDataFrame([("p1", ts), ("p1", ts), ("p2", ts)], "pid string, time_iso string"), enc).collect()
    assert [(r.pid, r.enc_id) for r in got] == ([("p1", want)] if want else [])


def test_duplicates_nulls_and_ids(spark, analytes):
    rows = [
        fact(1, "lab", "Creatinine", 1.0, "2025-01-01"), fact(2, "lab", "CREATININE", 1.0, "2025-01-01"), fact(3, "lab", "Creatinine", 1.1, None), fact(4, "lab", "Creatinine", 1.1, None),
        fact(5, "lab", "Unknown thing", 3.0, "2025-01-01"), fact(6, "med", "x", None, "2025-01-01", pid=" P1 "), fact(7, "med", "x", None, "2025-01-01", pid=None), fact(8, "bad", "x", None, "2025-01-01"), fact(9, "dx", None, None, None),
    ]
    f = table(spark, rows)
    assert {r.fact_id for r in F_.deduplicated(f).collect()} == {1, 3, 5, 6, 9}
    assert {(r.fact_id, r.node_id) for r in C.records(f, analytes).collect()} == {(3, "lab_0001"), (1, "lab_0002"), (6, "med_0001"), (9, "dx_0001")}
    assert C.nodes(f.limit(0), analytes).count() == 0 and C.nodes(f, analytes.limit(0)).count() == 3  # no code is known: drug, diagnosis, encounter


def test_ranks_and_steps_do_not_depend_on_buckets(spark):
    rows = [("a", i // 7, i, float((i * 37) % 11)) for i in range(60)] + [("b", 0, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, bucket int, at int, v double")
    assert [r.n for r in O.ranked(df, ["k"], ["at"], "bucket").where("k = 'a'").orderBy("at").collect()] == list(range(1, 61))
    got = O.previous(df, ["k"], ["at"], "bucket", ["v"]).orderBy("k", "at").collect()
    assert [r.prev_v for r in got] == [None] + [r[3] for r in rows[:59]] + [None]


def test_trend_of_a_rising_series(spark, analytes):
    rows = [fact(i, "lab", "Creatinine", v, f"2025-0{i}-15", doc=i) for i, v in enumerate([0.85, 1.06, 1.27, 1.48], 1)] + [fact(9, "lab", "Creatinine", 9.9, None)]
    t = T.trends(T.points(C.nodes(table(spark, rows), analytes))).collect()
    assert len(t) == 1 and t[0].n == 4 and round(t[0].delta, 3) == 0.63 and round(t[0].change_pct, 1) == 74.1 and t[0].monotonicity == 1.0 and t[0].deteriorated
    falling = [fact(i, "lab", "eGFR", v, f"2025-0{i}-15", doc=i) for i, v in enumerate([90.0, 80.0, 85.0, 41.0], 1)]
    t = T.trends(T.points(C.nodes(table(spark, falling), analytes))).collect()[0]
    assert t.deteriorated and t.monotonicity == 2 / 3
    assert T.trends(T.points(C.nodes(table(spark, rows[:3]), analytes))).count() == 0


def test_changes_and_gaps(spark, analytes):
    rows = [fact(1, "dx", "A", None, "2025-01-01", doc=1), fact(2, "dx", "B", None, "2025-03-01", doc=2), fact(3, "lab", "Creatinine", 1.0, "2025-02-01", doc=None), fact(4, "lab", "Creatinine", 1.5, None, doc=None)]
    n = C.nodes(table(spark, rows), analytes)
    assert {r.display for r in T.changed(n).collect()} == {"B", "Creatinine"}
    assert [(r.display, r.days) for r in T.gaps(n).collect()] == [("A", 59)]
    assert T.gaps(C.nodes(table(spark, rows[:1]), analytes)).count() == 0


def test_edges(spark):
    a = spark.createDataFrame([("p", "a1", "Latex", "2020-01-01", 1), ("p", "a2", "latex", "2021-01-01", 2), ("q", "a3", "latex", None, 3)], "pid string, node_id string, substance string, time string, ord int")
    assert [(r.src, r.dst) for r in G.supersedes(a).collect()] == [("a2", "a1")]
    m = spark.createDataFrame([("p", "m1", "LATEX"), ("p", "m2", "warfarin"), ("p", "m3", "Ibuprofen")], "pid string, node_id string, drug string")
    assert {(r.src, r.dst) for r in G.allergy_contraindicated(a, m).collect()} == {("a1", "m1"), ("a2", "m1")}
    pair = [("warfarin", "ibuprofen", "critical", "x")]
    assert G.interacting(m, pair).count() == 0 and [(r.src, r.dst) for r in G.interacting(m, pair, ci=True).collect()] == [("m2", "m3")]
