"""Readers of the parquet tables of one scale directory, and tables that are made to fit a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings patients patient_payloads "
    "identity_records pages facts lab_analytes analytes eval_items"
).split()
#: The tables that the engine itself keeps, as a store would declare them; keys are checked by queries, not by the format.
STORE = {
    "patients": "id string, name string, dob string, mrn string, sex string, patient_json string, created_at string",
    "documents": "doc_id bigint, patient_id string, filename string, kind string, sha256 string, created_at string",
    "pages": "doc_id bigint, page_no int, text string, kind string",
    "facts": "fact_id bigint, doc_id bigint, patient_id string, page_no int, char_start int, char_end int, extractor string, kind string, name string, value double, unit string, time_iso string, loinc string, "
    "ref_low double, ref_high double, abnormal boolean, negated boolean, meta string, loaded_at timestamp_ntz",
    "audit": "audit_id string, pid string, qid int, response string, created_at string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; columns and filters are pushed to the scan by Catalyst."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conformed(df: DataFrame, ddl: str) -> DataFrame:
    """df with just the columns of a schema, in its order and types; columns that an older table lacks are null."""
    want = StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def create_store(spark: SparkSession, path: str) -> None:
    """Empty tables of the store under a path, where they are not yet there."""
    for name, ddl in STORE.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{path}/{name}.parquet")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that several rows hold: what a unique index would refuse."""
    return df.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
