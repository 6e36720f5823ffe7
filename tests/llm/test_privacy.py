import re

import pytest
from pyspark.sql import functions as F

from chartloom.llm import privacy as V

CASES = {
    "Seen by Solveig Noreski, M.D., at 10 a.m.; Dr. Norloley, Guadalupe agreed.": [("NAME", "Solveig Noreski"), ("NAME", "Norloley, Guadalupe")],
    "Patient: Ulmishaw, M.        MRN: MRN28091738\nOrdering Physician: da Silvara, J.\nAccession: 22-574-8868": [("NAME", "Ulmishaw, M."), ("ID", "MRN28091738"), ("NAME", "da Silvara, J.")],
    "It was 35.9 °C. Current treatment for vitamin D. Sleep improved.": [],
    "A Brandel catheter and a Dorvell thyroiditis at Tarnsby Urgent Care, St. Orvin's ward.": [],
    "call James Kelbin (870 555 0145), order 41-644-5541, lot no. 98-791-4911": [("NAME", "James Kelbin"), ("PHONE", "870 555 0145")],
    "Passport 937 13 2614 was shown, my member id is T64 452 8288; SSN on the intake form reads 957-98-6722.": [("ID", "937 13 2614"), ("ID", "T64 452 8288"), ("ID", "957-98-6722")],
    "write to linoeau-dmitri AT clinic\nDOT example, ed95(at)a.example or a.b @ c.org. ran @ 3.5 units": [("EMAIL", "linoeau-dmitri AT clinic\nDOT example"), ("EMAIL", "ed95(at)a.example"), ("EMAIL", "a.b @ c.org")],
    "Lives at Flat 8, 949 Millrace Court, Lowmere, VT\n00413 with two cats.": [("ADDRESS", "Flat 8, 949 Millrace Court, Lowmere, VT\n00413")],
    "Die Patientin wohnt in der Alte Poststraße 57b, 00936 Altbrück und lebt allein. Frau Faromann. Tel. 030/23125196.": [("ADDRESS", "Alte Poststraße 57b, 00936 Altbrück"), ("NAME", "Faromann"), ("PHONE", "030/23125196")],
    "Le Dr M. Korminaka a examiné M. Dorreneau. Elle habite 39 bis, bd Saint-Orlan,\n00607 Montclair-sur-Eau, au 2e étage. Tél. 01 99 00 01 35": [("NAME", "M. Korminaka"), ("NAME", "Dorreneau"), ("ADDRESS", "39 bis, bd Saint-Orlan,\n00607 Montclair-sur-Eau"), ("PHONE", "01 99 00 01 35")],
    "Vive en Avda. de la Encina 4, 1.º B, 00202 Villarosa, con su hija. Su teléfono es 955500137. DNI del tutor: 99.294.857-M.": [("ADDRESS", "Avda. de la Encina 4, 1.º B, 00202 Villarosa"), ("PHONE", "955500137"), ("ID", "99.294.857-M")],
    "Осмотрен врачом Лазовский З. в 4 ч. Полис № 9964 384590. Телефон: 8 495 555 01 33. г. Ольхов, ул. Мельничная, д. 61, кв. 83.": [("NAME", "Лазовский З."), ("ID", "9964 384590"), ("PHONE", "8 495 555 01 33"), ("ADDRESS", "г. Ольхов, ул. Мельничная, д. 61, кв. 83")],
    "家庭住址为柳林市石桥路205号4栋，与女儿同住。陆海澄医生于上午9点查房。身份证明号码G995129201已登记。": [("ADDRESS", "柳林市石桥路205号4栋"), ("NAME", "陆海澄"), ("ID", "G995129201")],
    "連絡先は０３－５５５０－０１９１である。住所は青葉市本郷4-28-10、長女と同居。早乙女千尋医師が診察し": [("PHONE", "０３－５５５０－０１９１"), ("ADDRESS", "青葉市本郷4-28-10"), ("NAME", "早乙女千尋")],
    "डॉ. कविता पलासकर ने जाँच की। फ़ोन नंबर 0609-555-0191 पर": [("NAME", "कविता पलासकर"), ("PHONE", "0609-555-0191")],
    "فحص الدكتور كريم الساحلي المريض. رقم الهاتف هو +971 55500 22901.": [("NAME", "كريم الساحلي"), ("PHONE", "+971 55500 22901")],
    "นายแพทย์มาลีศรีลำดวนตรวจร่างกาย โทรศัพท์+665550021901": [("NAME", "มาลีศรีลำดวน"), ("PHONE", "+665550021901")],
    "Thanks.\n\nYours sincerely,\nZANSON, A.\n": [("NAME", "ZANSON, A.")],
    "": [], "  \n ": [], "Nothing here.": [],
}


@pytest.mark.parametrize("text", list(CASES))
def test_mentions(text):
    got = [(k, text[s:e]) for k, s, e in V.mentions(text)]
    assert got == CASES[text]


def test_none_and_very_long_texts():
    assert V.mentions(None) == []
    long = "word " * 200_000 + "Mr. Keltosova came."
    assert [(k, long[s:e]) for k, s, e in V.mentions(long)] == [("NAME", "Keltosova")]


def test_found_is_distinct_over_repeated_pages(spark):
    rows = [(1, 1, "Dr. Dorbinetti told me."), (1, 1, "Dr. Dorbinetti told me."), (2, 1, None), (3, 1, ""), (4, None, "Mr. Belski")]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, text string").withColumn("pii_type", F.lit("x"))
    assert sorted(map(tuple, V.found(df).collect()), key=str) == [(1, 1, "NAME", 4, 14), (4, None, "NAME", 4, 10)]
    assert V.found(df.limit(0)).count() == 0


def test_surrogates_keep_shape_coreference_and_distinctness(spark):
    rows = [
        (1, 1, "Patient: Daniel Dormara   MRN: MRN30520228\nConsent by D. Dormara. Mr. DORMARA rang (579) 555-0177."),
        (1, 2, "Call Daniel Dormara, not Mr. Belski; or mail daniel.d@post.test. Lives at 74 Windmere Road, Fernmoor, PA 00895."),
        (6, 1, "ada.q(at)clinic.example or ada.q [at] clinic [dot] example or ada.q AT clinic DOT example"),
        (2, 1, "陆海澄医生于上午9点查房。"), (3, 1, None), (4, 1, "Nothing."), (5, 1, "(579) 555-0177 and (579) 555-0178"),
    ]
    df = spark.createDataFrame(rows + rows[:1], "doc_id bigint, page_no int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in V.pseudonymised(df, "k1").collect()}
    assert len(got) == len(rows) and got[3, 1] is None and got[4, 1] == "Nothing."
    m = re.fullmatch(r"Patient: (\w+) (\w+)   MRN: (MRN\d{8})\nConsent by (\w)\. (\w+)\. Mr\. (\w+) rang (\(\d{3}\) \d{3}-\d{4})\.", got[1, 1])
    given, surname, mrn, first, s2, s3, phone = m.groups()
    assert surname == s2 == s3.capitalize() and s3.isupper() and given[0] == first and given.endswith("o")  # as Daniel mostly is a man's name
    assert {given, surname} & {"Daniel", "Dormara"} == set() and mrn != "MRN30520228" and phone != "(579) 555-0177"
    assert f"{given} {surname}" in got[1, 2] and "daniel" not in got[1, 2] and "Windmere" not in got[1, 2] and "@post.test" in got[1, 2]
    assert "ada" not in got[6, 1] and "(at)clinic.example" in got[6, 1] and " AT clinic DOT example" in got[6, 1]
    assert phone in got[5, 1] and len(set(re.findall(r"\(\d{3}\) \d{3}-\d{4}", got[5, 1]))) == 2
    assert "陆海澄" not in got[2, 1] and got[2, 1].endswith("医生于上午9点查房。")
    assert got != {(r.doc_id, r.page_no): r.text for r in V.pseudonymised(df, "k2").collect()}


def test_shared_surrogates_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(V, "_HAN_POOL", "山川田木")
    parts = [(a + b,) for a in "陆海澄戴若曦谭文岚" for b in "山川"]
    df = spark.createDataFrame([*parts, ("山",), ("川川",)], "part string").select(F.lit("NAME").alias("kind"), "part")
    made = V.distinct_surrogates(df.unionByName(df), "k").collect()
    real = {p for (p,) in parts} | {"山", "川川"}
    assert len(made) == len({r.surrogate for r in made}) == len(real) and not {r.surrogate for r in made} & real
