"""References to rows that are absent or came later (left anti-join of distinct keys, joined back).

Defined results: a null, blank, 'none' or 'n/a' key and document 0 (but no patient '0') refer to nothing and give no row; a parent without
a usable time (null, blank, unreadable or in 1900) is never late; a referring row without a readable time keeps a
'missing' case with a null month and is never late; empty tables give no row (against an empty parent table every
reference is missing); repeated parents count with their earliest time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.times import iso_micros, ntz_micros, utc_month
from chartloom.session import written
from chartloom.sources.tables import read

#: Rows of a key that one task takes; a key with more is cut into as many parts as it needs.
ROWS_A_SALT = 200_000
#: Words that refer to nothing; documents have the number 0 besides.
NOTHING = ("", "none", "n/a")
YEAR_1901 = -2_177_452_800_000_000  # microseconds; earlier parents count as undated


def key_text(c: Column, nothing: tuple[str, ...] = NOTHING) -> Column:
    """A key without case and surrounding white space; null where it refers to nothing."""
    k = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(~k.isin(*nothing), k)


def reference(df: DataFrame, tbl: str, field: str, row_id: str, own_us: Column, domain: str, nothing: tuple[str, ...] = NOTHING) -> DataFrame:
    """Rows (tbl, ref_field, row_id, own_us, domain, key) of the references that refer to something."""
    return df.select(
        F.lit(tbl).alias("tbl"), F.lit(field).alias("ref_field"), F.col(row_id).alias("row_id"), own_us.alias("own_us"), F.lit(domain).alias("domain"), key_text(F.col(field), nothing).alias("key")
    ).where("key is not null")


def parent(df: DataFrame, key: str, created_us: Column, domain: str) -> DataFrame:
    """Rows (domain, key, born_us): the parent keys with the time from which they exist, null for never late."""
    return df.select(F.lit(domain).alias("domain"), key_text(F.col(key)).alias("key"), F.when(created_us >= YEAR_1901, created_us).alias("us")).where("key is not null").groupBy("domain", "key").agg(
        F.when(F.count("*") == F.count("us"), F.min("us")).alias("born_us")
    )


def broken_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """One row (tbl, ref_field, row_id, status, yyyymm) for each reference whose parent is missing or late.

    The distinct keys (pre-aggregated on the map side, so a key that a third of the rows hold is one row) meet the
    parents; only keys that have a case go back to the rows, a hot key in as many parts as its count asks for.
    """
    keys = written(refs.groupBy("domain", "key").agg(F.min("own_us").alias("first_us"), F.count("*").alias("n")))
    absent = keys.join(parents, ["domain", "key"], "left_anti").select("domain", "key", "n", F.lit("missing").alias("status"), F.lit(None).cast("bigint").alias("born_us"))
    late = keys.join(parents, ["domain", "key"]).where("born_us > first_us").select("domain", "key", "n", F.lit("late").alias("status"), "born_us")
    cases = written(absent.unionByName(late).withColumn("salts", F.ceil(F.col("n") / ROWS_A_SALT).cast("int")).drop("n"))
    # Only hot keys are cut; there are at most rows / ROWS_A_SALT of them, so their list is small beside the rows.
    hot = cases.where("salts > 1").select("domain", "key", F.col("salts").alias("hot"))
    rows = refs.join(hot, ["domain", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.coalesce("hot", F.lit(1))).cast("int")).drop("hot") if not hot.isEmpty() else refs.withColumn("salt", F.lit(0))
    cases = cases.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return (
        rows.join(cases, ["domain", "key", "salt"])
        .where("status = 'missing' or born_us > own_us")
        .select("tbl", "ref_field", F.col("row_id").cast("bigint").alias("row_id"), "status", utc_month(F.col("own_us")).alias("yyyymm"))
    )


def chart_references(documents: DataFrame, facts: DataFrame, patients: DataFrame) -> DataFrame:
    """Broken references of documents.patient_id, facts.patient_id and facts.doc_id."""
    refs = [
        reference(documents, "documents", "patient_id", "doc_id", iso_micros(F.col("created_at")), "patient"),
        reference(facts, "facts", "patient_id", "fact_id", ntz_micros(F.col("loaded_at")), "patient"),
        reference(facts, "facts", "doc_id", "fact_id", ntz_micros(F.col("loaded_at")), "document", (*NOTHING, "0")),
    ]
    parents = parent(patients, "id", iso_micros(F.col("created_at")), "patient").unionByName(parent(documents, "doc_id", iso_micros(F.col("created_at")), "document"))
    return broken_references(reduce(DataFrame.unionByName, refs), parents)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_references(read(spark, sf_dir, "documents"), read(spark, sf_dir, "facts"), read(spark, sf_dir, "patients"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken references per table, field, month and status."""
    return p4_found(spark, sf_dir).groupBy("tbl", "ref_field", "yyyymm", "status").agg(F.count("*").alias("n"))


_SQL = r"""
with t as (
  select 'documents' tbl, 'patient_id' ref_field, doc_id row_id, created_at raw_us, cast(null as timestamp) ts, 'patient' dom, patient_id k from documents
  union all select 'facts', 'patient_id', fact_id, null, loaded_at, 'patient', patient_id from facts
  union all select 'facts', 'doc_id', fact_id, null, loaded_at, 'document', cast(doc_id as varchar) from facts),
iso(s, us) as (
  select s, epoch_us(try_cast(case when regexp_matches(n, '(Z|[+-]\d\d:?\d\d)$') and regexp_matches(n, '\d\d:\d\d:\d\d') then n when regexp_matches(n, '\d\d:\d\d:\d\d') then n || 'Z' else n || 'T00:00:00Z' end as timestamptz))
  from (select s, regexp_replace(trim(s), '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})', '\1-\2-\3T\4:\5:\6') n
        from (select created_at s from documents union select created_at from patients) where trim(s) <> '')),
refs as (
  select tbl, ref_field, row_id, dom, lower(trim(k)) k, coalesce(iso.us, epoch_us(ts)) us
  from t left join iso on t.raw_us = iso.s where k is not null and lower(trim(k)) not in ('', 'none', 'n/a') and not (dom = 'document' and trim(k) = '0')),
parents as (
  select dom, k, case when count(*) = count(us) then min(us) end born from (
    select 'patient' dom, lower(trim(id)) k, case when us >= -2177452800000000 then us end us from patients left join iso on created_at = s
    union all select 'document', cast(doc_id as varchar), case when us >= -2177452800000000 then us end from documents left join iso on created_at = s) group by all),
found as (
  select tbl, ref_field, cast(row_id as bigint) row_id, case when p.k is null then 'missing' else 'late' end status,
         strftime(make_timestamp(us), '%Y-%m') yyyymm
  from refs r left join parents p on r.dom = p.dom and r.k = p.k where p.k is null or p.born > r.us)
"""

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
ORACLE = {
    "p4_found": _SQL + "select tbl, ref_field, row_id, status, yyyymm from found",
    "p4_counts": _SQL + "select tbl, ref_field, yyyymm, status, count(*) n from found group by all",
}
