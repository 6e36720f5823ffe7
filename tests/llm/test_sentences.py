import pytest

from chartloom.llm import sentences as S

CASES = {
    "en": (
        "The dose (approx. 10.5 mg/kg, cf. protocol no. 2) was tolerated well. Dr. Liesl Normann came at 6 p.m. and left.\n\n"
        "\"It comes and goes. It never lasts,\" is how she puts it. Is monitoring needed? Usually not.Est. loss was 3 mL. Temp. 101.3 F. He left...",
        ["The dose (approx. 10.5 mg/kg, cf. protocol no. 2) was tolerated well.", "Dr. Liesl Normann came at 6 p.m. and left.", "\"It comes and goes. It never lasts,\" is how she puts it.",
         "Is monitoring needed?", "Usually not.", "Est. loss was 3 mL.", "Temp. 101.3 F.", "He left..."],
    ),
    "report": (
        "LOWMERE CLINIC\nProgress note\n\nPatient: Nunez, T.      MRN: 1\nAttending: R. P. Cors\n\nDIAGNOSIS\n1. Asthma, mild (J45.2)\n2. Gout\r\n\r\nAnalyte   Result\n-----\nIron, in umol/l   3.8    10.7 - 30.4\n\nDear colleague,\n\nKind regards,\nT. Smith",
        ["LOWMERE CLINIC", "Progress note", "Patient: Nunez, T.      MRN: 1", "Attending: R. P. Cors", "DIAGNOSIS", "1. Asthma, mild (J45.2)", "2. Gout", "Analyte   Result", "-----",
         "Iron, in umol/l   3.8    10.7 - 30.4", "Dear colleague,", "Kind regards,", "T. Smith"],
    ),
    "de": ("Die 2. Kontrolle ist für den 4. Juni geplant. Der Wert stieg, d. h. deutlich über die Norm. „Mir geht es besser. Ich gehe“, sagte sie.", ["Die 2. Kontrolle ist für den 4. Juni geplant.", "Der Wert stieg, d. h. deutlich über die Norm.", "„Mir geht es besser. Ich gehe“, sagte sie."]),
    "fr": ("Avez-vous de la fièvre ? Non. Le Dr X a examiné M. Dor à 8 h 30. La valeur, c.-à-d. le double.", ["Avez-vous de la fièvre ?", "Non.", "Le Dr X a examiné M. Dor à 8 h 30.", "La valeur, c.-à-d. le double."]),
    "es": ("¿Tiene fiebre? No. La Sra. Mar firmó a las 7 p. m. y no halló cambios, p. ej. con la comida.", ["¿Tiene fiebre?", "No.", "La Sra. Mar firmó a las 7 p. m. y no halló cambios, p. ej. con la comida."]),
    "ru": ("Проживает: г. Ольхов, ул. Садовая, д. 14, кв. 4. «Мне лучше. Хочу домой», — сказал он. Осмотрен Ярцева Н. в 11 ч. 30 мин. и выписан.", ["Проживает: г. Ольхов, ул. Садовая, д. 14, кв. 4.", "«Мне лучше. Хочу домой», — сказал он.", "Осмотрен Ярцева Н. в 11 ч. 30 мин. и выписан."]),
    "ja": ("発熱はあるか？今のところない。「もう痛くない。帰りたい。」と話す。値は2.0（未満。再検予定）。", ["発熱はあるか？", "今のところない。", "「もう痛くない。帰りたい。」と話す。", "値は2.0（未満。再検予定）。"]),
    "zh": ("有无发热？无。“我好多了。我想回家。”患者说。值为9.3。", ["有无发热？", "无。", "“我好多了。我想回家。”患者说。", "值为9.3。"]),
    "hi": ("क्या बुखार है? नहीं। डॉ. मोहन ने 5 मि.ग्रा. दी। मान 11.8 हो गया।", ["क्या बुखार है?", "नहीं।", "डॉ. मोहन ने 5 मि.ग्रा. दी।", "मान 11.8 हो गया।"]),
    "ar": ("هل توجد حمى؟ لا توجد. ارتفعت القيمة من 3.6 إلى 2.8 خلال يومين! تم.", ["هل توجد حمى؟", "لا توجد.", "ارتفعت القيمة من 3.6 إلى 2.8 خلال يومين!", "تم."]),
    "th": ("ไม่มีไข้และไม่มีอาการไอ โทรศัพท์0762-555-0117 ให้กลับบ้าน", ["ไม่มีไข้และไม่มีอาการไอ", "โทรศัพท์0762-555-0117", "ให้กลับบ้าน"]),
    "wrapped": ("The patient was seen on the ward this morning and reviewed by Dr.\nLiesl Normann, who found no change in the general condition of\nthe patient.", ["The patient was seen on the ward this morning and reviewed by Dr.\nLiesl Normann, who found no change in the general condition of\nthe patient."]),
}


@pytest.mark.parametrize("name", CASES)
def test_units(name):
    text, want = CASES[name]
    assert [text[a:b] for a, b in S.segment(text)] == want


def test_plain_place_shortcut_agrees_with_the_whole_cascade(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect():
        for x in S.FREQUENT:
            for m in S.PLACES[""].finditer(r.text):
                if m.end() < len(r.text):
                    assert S.breaks(r.text, m.end(), S.cascade(x), True) == S.breaks(r.text, m.end(), S.cascade(x)), r.text[m.end() - 20 : m.end() + 5]


def test_units_cover_all_visible_text(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect():
        units, at = S.segment(r.text), 0
        for a, b in units:
            assert a >= at and r.text[at:a].strip() == "" and r.text[a:b] == r.text[a:b].strip() != ""
            at = b
        assert r.text[at:].strip() == ""


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One. Two."), (4, "One. Two."), (5, "no mark at all"), (6, "A bit. " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as char_start", "'x' as lang")
    got = S.sentence_units(df).collect()
    assert sorted((r.doc_id, r.char_start, r.char_end) for r in got if r.doc_id < 6) == [(4, 0, 4), (4, 0, 4), (4, 5, 9), (4, 5, 9), (5, 0, 14)]
    assert sum(r.doc_id == 6 for r in got) == 50_000
    assert S.sentence_units(df.limit(0)).count() == 0


def test_words_that_look_like_abbreviations_and_inch_marks():
    def units(t):
        return [t[a:b] for a, b in S.segment(t)]

    assert units('He has a 5" scar. It healed. Now a 3" scar remains.') == ['He has a 5" scar.', "It healed.", 'Now a 3" scar remains.']
    assert units("She studied art. Then she left the room.") == ["She studied art.", "Then she left the room."]
    assert units("He sat. Then he stood up. The patient was on med. She was fine.") == ["He sat.", "Then he stood up.", "The patient was on med.", "She was fine."]
    assert units("The resp. rate was 6, sat. 51 percent, temp. 38.4 and est. loss 5 mL. It fell.") == ["The resp. rate was 6, sat. 51 percent, temp. 38.4 and est. loss 5 mL.", "It fell."]
    assert units("We met A. B. C. D. E. F. G. H. I. J. K. L. M. N. O. P. Q. R. Smith. He left.") == ["We met A. B. C. D. E. F. G. H. I. J. K. L. M. N. O. P. Q. R. Smith.", "He left."]


def test_addresses_and_lines_that_go_on():
    def units(t):
        return [t[a:b] for a, b in S.segment(t)]

    assert units("Write to ana.q @ clinic.example or bo.x AT post DOT test. Mail ED.W@EXAMPLE.COM.Then wait. It helps.") == ["Write to ana.q @ clinic.example or bo.x AT post DOT test.", "Mail ED.W@EXAMPLE.COM.", "Then wait.", "It helps."]
    assert units("El Dr. revisó la placa\na las 8 p.\nm. y no halló cambios.") == ["El Dr. revisó la placa\na las 8 p.\nm. y no halló cambios."]
    assert units("HISTORY\npH was low.\nit fell.") == ["HISTORY", "pH was low.", "it fell."]
