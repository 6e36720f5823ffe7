"""Terminology and rule vocabularies as plain values, and as small DataFrames or SQL rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, display, unit, reference low and high, whether a higher value is worse.
ANALYTES = [
    ("2160-0", "Creatinine", "mg/dL", 0.6, 1.3, True),
    ("33914-3", "eGFR", "mL/min/1.73m2", 90.0, 140.0, False),
    ("3094-0", "Urea Nitrogen", "mg/dL", 7.0, 20.0, True),
    ("2345-7", "Glucose", "mg/dL", 70.0, 99.0, True),
    ("4548-4", "HbA1c", "%", 4.0, 5.6, True),
    ("718-7", "Hemoglobin", "g/dL", 12.0, 17.5, False),
    ("777-3", "Platelets", "K/uL", 150.0, 400.0, False),
    ("6690-2", "WBC", "K/uL", 4.0, 11.0, True),
    ("2951-2", "Sodium", "mmol/L", 135.0, 145.0, True),
    ("2823-3", "Potassium", "mmol/L", 3.5, 5.1, True),
    ("6301-6", "INR", "", 0.8, 1.2, True),
    ("1742-6", "ALT", "U/L", 7.0, 56.0, True),
    ("1920-8", "AST", "U/L", 10.0, 40.0, True),
    ("1975-2", "Bilirubin, total", "mg/dL", 0.1, 1.2, True),
    ("10839-9", "Troponin I", "ng/mL", 0.0, 0.04, True),
]
# ICD code, display, category.
CONDITIONS = [
    ("I10", "Essential hypertension", "cardio"),
    ("E11.9", "Type 2 diabetes mellitus", "endocrine"),
    ("N18.3", "Chronic kidney disease stage 3", "renal"),
    ("J44.1", "COPD with exacerbation", "pulmonary"),
    ("I50.9", "Heart failure, unspecified", "cardio"),
    ("E78.5", "Hyperlipidemia", "cardio"),
    ("K21.9", "Gastroesophageal reflux", "gi"),
    ("F32.9", "Major depressive disorder", "psych"),
    ("N39.0", "Urinary tract infection", "renal"),
    ("M54.5", "Low back pain", "msk"),
    ("E66.9", "Obesity, unspecified", "endocrine"),
]
# Two drugs, severity, explanation.
INTERACTIONS = [
    ("warfarin", "ibuprofen", "critical", "Additive anticoagulant/antiplatelet effect - bleeding risk."),
    ("warfarin", "naproxen", "critical", "Additive anticoagulant/antiplatelet effect - bleeding risk."),
    ("warfarin", "amiodarone", "high", "Amiodarone inhibits warfarin metabolism - INR may rise."),
    ("digoxin", "furosemide", "high", "Loop-diuretic-induced hypokalaemia potentiates digoxin toxicity."),
    ("lisinopril", "spironolactone", "high", "Combined potassium retention - hyperkalaemia risk, requires monitoring."),
    ("digoxin", "spironolactone", "high", "Both reduce renal potassium excretion - hyperkalaemia and toxicity risk."),
]
# Invented pairs over the drugs of the test tables, in which none of the drugs above occurs.
TEST_INTERACTIONS = [
    ("gabrasil", "metrazone", "critical", "bleeding risk"),
    ("lorvastin", "enoxaplin", "high", "level may rise"),
    ("rosuvel", "pindorol", "high", "needs monitoring"),
    ("tiopril", "ondaxin", "high", "potassium retention"),
    ("cefamil", "valtrexin", "critical", "toxicity risk"),
    ("torasenide", "amlovene", "high", "toxicity risk"),
]
# Spelling in lower case, canonical unit, factor.
UNITS = [
    ("mg/dl", "mg/dL", 1.0), ("milligram/deciliter", "mg/dL", 1.0), ("umol/l", "umol/L", 1.0), ("µmol/l", "umol/L", 1.0), ("mmol/l", "mmol/L", 1.0), ("mg/l", "mg/L", 0.001),
    ("g/dl", "g/dL", 1.0), ("k/ul", "K/uL", 1.0), ("ml/min/1.73m2", "mL/min/1.73m2", 1.0), ("ukat/l", "ukat/L", 1.0), ("%", "%", 1.0), ("u/l", "U/L", 1.0),
]
# The kinds of facts and of extractors.
FACT_KINDS = ["lab", "med", "dx", "allergy", "note_stance", "vital", "imaging", "encounter"]
EXTRACTORS = ["regex", "llm"]
# Node types and edge types in their declared order.
NODE_TYPES = {"lab": "LabResult", "med": "MedicationOrder", "dx": "Diagnosis", "allergy": "Allergy", "note_stance": "Note", "vital": "VitalSeries", "imaging": "ImagingStudy", "encounter": "Encounter"}
ID_PREFIX = {"lab": "lab", "med": "med", "dx": "dx", "allergy": "alg", "note_stance": "note", "vital": "vs", "imaging": "img", "encounter": "enc"}
EDGE_TYPES = ["occurs_during", "precedes", "co_occurs_with", "supersedes", "contradicts", "contraindicated_with"]


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values; its size is bounded by the literals in this package, so it may be broadcast."""
    return spark.createDataFrame(values, schema)


def sql_text(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"cast({v!r} as {'double' if isinstance(v, float) else 'integer'})"
    return "'" + str(v).replace("'", "''") + "'"


def sql_rows(values: list[tuple]) -> str:
    """The same values as the body of a SQL VALUES clause."""
    return "values " + ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in values)


def as_integers(sql: str, *columns: str) -> str:
    """The SQL's result with ranks as 32-bit integers, as the queries give them."""
    return "select * replace (" + ", ".join(f'cast("{c}" as integer) as "{c}"' for c in columns) + f") from ({sql})"
