import random

from chartloom.llm import persons as P
from chartloom.llm import variants as V

ROWS = "id string, name string, dob string, mrn string, patient_json string, extra int"
PAYS = "payload_id string, name string, dob string, mrn string, id string"


def test_every_spelling_of_one_person_is_linked_and_nobody_else(spark):
    patients = [
        ("a1", "Rebecca Ana Branczyk", "1996-09-28", "MRN24920792"),
        ("a2", "BRANCCZYK REBECCA", "Sep 28, 1996", "mrn 2492-0792"),
        ("a3", "Branczyk, R.", "28.09.1996", "LEG22430"),  # only an initial
        ("a4", "Rebecca Branczyk", "1950-01-02", "MRN11112223"),  # namesake
        ("b1", "Günther O'Brannigan", "1960-03-04", None),
        ("c1", "Mei Halripoulos", "1980-03-04", None),  # twins
        ("c2", "Maeve Halripoulos", "1980-03-04", None),
        ("c3", "M. Halripoulos", "1980-03-04", None),
        ("z1", "TEST TEST", "1980-03-04", None), ("z2", None, None, None), ("z3", " ", "1980-03-04", None), ("z4", "xxx", "1980-03-04", None), ("z5", "x" * 5000, None, None),
        (None, "Rebecca Branczyk", "1996-09-28", None),
    ]
    payloads = [
        ("p1", "Ms. Becky Branczyk [temp]", "09/28/1996", "TBD"),
        ("p2", "Branczyk, Rebecca", "1996-09-29", None),
        ("p3", "guenther o'brannigan, c/o daughter", "03/04/1960", "MRN00000000"),
        ("p4", "Günther O'Brannigan", "1960-03-04", None),  # equal byte for byte
        ("z5", "Test Test", "1980-03-04", None),
    ]
    pat = spark.createDataFrame([(*r, None, 1) for r in patients * 2], ROWS)
    got = [(r.key_a, r.key_b) for r in V.linked_variants(pat, spark.createDataFrame([(*r, "x") for r in payloads], PAYS)).collect()]
    one = ["a1", "a2", "a3", "p1", "p2"]
    assert sorted(got) == sorted([(a, b) for a in one for b in one if a < b] + [("b1", "p3"), ("p3", "p4")])
    assert V.linked_variants(spark.createDataFrame([], ROWS), spark.createDataFrame([], PAYS)).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
    return row[-1]


def test_radius_join_finds_every_pair_whatever_the_pivots(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 9))) for _ in range(150)]
    names = sorted({*base, *(w[:k] + rnd.choice("abcde") + w[k + 1 :] for w in base for k in [rnd.randrange(len(w))])})
    df = spark.createDataFrame([(n,) for n in [*names, *names, None]], "name string")
    for radius, pivots, cell in ((1, 256, 2000), (1, 5, 3), (2, 12, 2), (1, 1, 1)):
        got = sorted((r.x, r.y) for r in V.radius_join(df, radius, pivots, cell).collect())
        assert got == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if lev(a, b) <= radius]
    swaps = {(r.x, r.y) for r in V.swapped(df).collect()}
    assert swaps == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if P.near(a, b) and lev(a, b) == 2}
    assert V.radius_join(df.limit(0)).count() == 0


def test_blocks_lose_no_pair_that_the_decision_takes(spark, sf):
    rows = P.registry_rows(spark.read.parquet(f"{sf}/patients.parquet")).unionByName(spark.read.parquet(f"{sf}/patient_payloads.parquet").selectExpr("payload_id as key", "name", "dob", "mrn", "cast(null as string) address"))
    rows = rows.unionByName(spark.read.parquet(f"{sf}/identity_records.parquet").selectExpr("concat('r', rec_id) as key", "name", "dob", "mrn", "address"))
    people, member = V.profiles(rows)
    assert member.count() == P.parsed(rows).count()
    all_ = sorted(((r.key, (r.parts, r.initials, r.dob, r.mrn, r.home)) for r in people.collect()))
    want = {(a, b): k for i, (a, x) in enumerate(all_) for b, y in all_[i + 1 :] if (k := P.decide(x, y))}
    assert len(want) > 20
    for block in (60, 2):  # small blocks are divided by what else the rows share
        got = {(r.a, r.b): r.kind for r in V.decided(people, V.blocked_pairs(people, block)).collect()}
        assert got == want


def test_registered():
    import __spark_entry__

    assert {"p1_found", "p1_forms"} <= set(__spark_entry__.queries())


def test_two_slips_count_beside_an_equal_date_only():
    a, b = (["halini", "agnieszka"], "", 19870215, None, None), (["halini", "agnyszka"], "", 19870215, None, None)
    assert P.compare_names(a[0], "", b[0], "") == "alike" and P.decide(a, b) == "strong"
    assert P.decide(a, (*b[:2], 19870216, *b[3:])) == "" and P.decide((["halripoulos", "mei"], "", 19800304, None, None), (["halripoulos", "maeve"], "", 19800304, None, None)) == ""
    assert P.name_parts("Y Wenpoulos")[1] == "y" and P.two_slips("cholé", "chloé") and not P.two_slips("abcdef", "uvwxyz")


def damaged_rows(n=500):
    """Rows with few given names and surnames, cut, misspelled and short ones among them, so that every part is common."""
    rnd = random.Random(5)
    given, last = "rebecca becky marie theodore ted maeve mav christina chris sue joe".split(), "halini hallyni halin branczyk brancz lee moe wenville su".split()

    def slip(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + "o" + w[k:], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]])

    for i in range(n):
        parts = [slip(rnd.choice(given)) for _ in range(rnd.choice((0, 1, 1, 2)))] + [slip(rnd.choice(last)) for _ in range(rnd.choice((0, 1, 1, 2)))] + ["r."] * (rnd.random() < 0.2)
        dob = None if rnd.random() < 0.15 else f"{rnd.choice((1960, 1961, 1970))}-{rnd.randrange(1, 4):02d}-{rnd.randrange(1, 29):02d}"
        mrn = f"MRN2493{rnd.choice(('0792', '0729', '0793', '4411'))}" if rnd.random() < 0.3 else None
        yield f"k{i:03d}", " ".join(parts), dob, mrn, f"{rnd.randrange(5)} Kestrel St" if rnd.random() < 0.3 else None


def test_common_short_and_cut_names_lose_no_pair(spark):
    people, _ = V.profiles(spark.createDataFrame(list(damaged_rows()), "key string, name string, dob string, mrn string, address string"))
    all_ = sorted(((r.key, (r.parts, r.initials, r.dob, r.mrn, r.home)) for r in people.collect()))
    want = {(a, b): k for i, (a, x) in enumerate(all_) for b, y in all_[i + 1 :] if (k := P.decide(x, y))}
    assert {"strong", "weak"} == set(want.values()) and len(want) > 200
    for block in (60, 3):
        got = {(r.a, r.b): r.kind for r in V.decided(people, V.blocked_pairs(people, block)).collect()}
        assert got == want


def test_tables_on_the_way_are_deleted_and_passes_meet_every_key(spark):
    import os
    from pathlib import Path

    from chartloom.session import shared_folder

    left = lambda: {p for p in os.listdir(shared) if p.startswith("written-")}
    blocks = lambda: sum(p.stat().st_size for p in local.rglob("shuffle_*"))
    shared, local = shared_folder(spark).removeprefix("file://"), Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    people, _ = V.profiles(spark.createDataFrame(list(damaged_rows(150)), "key string, name string, dob string, mrn string, address string"))
    before, on_disk = left(), blocks()
    pairs = {n: V.blocked_pairs(people, 3, n) for n in (1, 3)}
    # Before, every table on the way stayed, and its shuffles until the driver collected its garbage.
    assert len(left() - before) == 2 and blocks() <= on_disk
    a, b = ({(r.a, r.b): round(r.weight, 6) for r in pairs[n].collect()} for n in (1, 3))
    assert a == b and len(a) > 100


def test_pairs_that_cannot_be_taken_are_no_candidates_and_every_part_is_small(spark):
    rows = [
        ("a1", "Rebecca Ana Halini", "1960-01-02", None), ("a2", "Rebecca Marie Branczyk", "1960-01-20", None), ("a3", "Rebecca Halini", "1960-01-25", None),
        ("b1", "Theo Kestrelin", "1950-01-01", "MRN24930792"), ("b2", "Gus Kestrelin", "1970-05-05", "MRN24931111"), ("b3", "Gus Kestrelin", "1981-11-19", "MRN24931121"),
        *((f"c{i}", f"{n} {s}", f"19{70 + i}-07-15", None) for i, (n, s) in enumerate((n, s) for n in ("Ana", "Marie") for s in ("Tavrenley", "Wickville", "Ulmsaholm", "Zantosberg"))),
    ]
    people, member = V.profiles(spark.createDataFrame([(*r, None) for r in rows], "key string, name string, dob string, mrn string, address string"))
    name = {r.key: r.member for r in member.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in V.blocked_pairs(people).collect()}
    # Before, one shared name beside a month, and the half of a number, made candidates too.
    assert ("a1", "a3") in got and ("b2", "b3") in got and not {("a1", "a2"), ("a2", "a3"), ("b1", "b2"), ("b1", "b3")} & got
    assert V.parts_of(0) == 1 and 1_000_000 / V.parts_of(1_000_000) <= V.ROWS_A_PASS  # before, four parts at most
