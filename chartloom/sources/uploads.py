"""Uploaded files as pages, and pages, charts and manifests as files.

Files are read by the binaryFile source, so one row is one file and no file is split. Defined results: empty files,
files over the limit, office formats, unknown endings, blank texts and (without a reader) PDFs are refused with a
status; text is UTF-8, else Latin-1; blank pages are dropped and the rest numbered from 1 without holes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.sources.tables import read

# The largest file, the endings that are read and those that are refused as office formats.
MAX_BYTES = 25 * 1024 * 1024
ENDINGS = [".pdf", ".txt", ".md", ".text"]
OFFICE = [".doc", ".docx", ".odt", ".rtf", ".xlsx", ".pptx"]
#: Divides the pages of a text; PDFs are divided by their reader.
PAGE_BREAK = "\f"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of every file under a path; the source itself skips files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def ending(filename: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(F.coalesce(filename, F.lit("")))), r"^.+(\.[^.]*)$", 1)


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1, which always is."""
    t = F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(t)


def status(filename: Column, content: Column, readable_pdf: bool = False) -> Column:
    """'ok' or why a file is refused."""
    e, size = ending(filename), F.coalesce(F.octet_length(content), F.lit(0))
    pdf = (F.substring(content, 1, 5) == F.lit(b"%PDF-")) | (e == ".pdf")
    return (
        F.when(size == 0, "empty").when(size > MAX_BYTES, "too large").when(e.isin(OFFICE), "office format").when(~e.isin(ENDINGS), "unknown ending")
        .when(pdf, "ok" if readable_pdf else "no PDF reader").when(F.regexp_replace(decoded(content), r"\s+", "") == "", "blank").otherwise("ok")
    )


def pages(uploads: DataFrame, pdf_reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(filename, sha256, page_no, text) of the readable files; pdf_reader gives the texts of a PDF's pages."""
    u = uploads.withColumn("status", status(F.col("filename"), F.col("content"), pdf_reader is not None)).where("status = 'ok'")
    pdf = (F.substring("content", 1, 5) == F.lit(b"%PDF-")) | (ending(F.col("filename")) == ".pdf")
    key = [F.col("filename"), F.sha2("content", 256).alias("sha256")]
    raw = u.where(~pdf).select(*key, F.split(decoded(F.col("content")), PAGE_BREAK).alias("texts"))
    if pdf_reader is not None:

        def extract(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["texts"] = [pdf_reader(c) for c in b.pop("content")]
                yield b

        raw = raw.unionByName(u.where(pdf).select(*key, "content").mapInPandas(extract, "filename string, sha256 string, texts array<string>"))
    kept = F.filter("texts", lambda t: F.regexp_replace(t, r"\s+", "") != "")
    return raw.select("filename", "sha256", F.posexplode(kept).alias("n", "text")).select("filename", "sha256", (F.col("n") + 1).alias("page_no"), "text")


def lab_layout(results: DataFrame, width: int = 76) -> DataFrame:
    """(doc_id, text): a laboratory report's text of results (doc_id, patient, mrn, dob, collected, place, name, value, unit, range, flag)."""
    row = F.concat(F.rpad("name", 32, " "), F.rpad(F.col("value").cast("string"), 11, " "), F.rpad("unit", 13, " "), F.rpad("range", 18, " "), F.coalesce("flag", F.lit("")))
    head = F.concat(F.lit("Patient: "), F.rpad("patient", 24, " "), F.lit("MRN: "), F.col("mrn"), F.lit("\nDOB: "), F.rpad("dob", 20, " "), F.lit("Collected: "), F.col("collected"), F.lit("\n\n"), F.rpad(F.lit("Analyte"), 32, " "), F.rpad(F.lit("Result"), 11, " "), F.rpad(F.lit("Units"), 13, " "), F.rpad(F.lit("Reference Range"), 18, " "), F.lit("Flag\n" + "-" * width + "\n"))
    # A report's rows are bounded by its page.
    g = results.groupBy("doc_id").agg(F.first(head).alias("head"), F.array_sort(F.collect_list(F.struct("place", F.rtrim(row).alias("line")))).alias("rows"))
    return g.select("doc_id", F.concat("head", F.array_join(F.transform("rows", lambda r: r.line), "\n"), F.lit("\n\nEnd of Report\n")).alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents (doc_id, pid, kind, text) as text rows by kind, with a manifest of what was written."""
    docs.select("doc_id", "pid", "kind", "text").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/documents")
    docs.groupBy("pid", "kind").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars")).write.mode("overwrite").json(f"{path}/manifest")


def append_rows(df: DataFrame, path: str) -> None:
    """Audit rows and facts are only ever appended."""
    df.write.mode("append").parquet(path)


def upload_status(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as if uploaded: status, content hash and size of each document."""
    d = read(spark, sf, "documents").select("doc_id", "filename", F.encode("text", "UTF-8").alias("content"))
    return d.select("doc_id", status(F.col("filename"), F.col("content")).alias("status"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))


def upload_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the uploaded corpus: the blank ones dropped, the rest numbered."""
    d = read(spark, sf, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("filename"), F.encode(F.concat(F.lit(" \f"), "text"), "UTF-8").alias("content"))
    return pages(d).select("filename", "page_no", F.length("text").alias("size"))


def pages_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    """The page table without blank pages, numbered from 1 without holes; a document's pages are bounded by the document."""
    from pyspark.sql import Window

    from chartloom.operators.texts import page_rows

    p = page_rows(read(spark, sf, "pages")).where(F.regexp_replace("text", r"\s+", "") != "")
    return p.select("doc_id", "page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")).alias("number"))


def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose content came before under a smaller id, by hash."""
    d = read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "h").where("doc_id <> first").select("doc_id", "first")


_STATUS = f"""case when coalesce(octet_length(encode(text)), 0) = 0 then 'empty' when octet_length(encode(text)) > {MAX_BYTES} then 'too large' when e in ({", ".join(f"'{x}'" for x in OFFICE)}) then 'office format'
  when e not in ({", ".join(f"'{x}'" for x in ENDINGS)}) then 'unknown ending' when text like '%PDF-%' escape '\\' and text like '\\%PDF-%' escape '\\' or e = '.pdf' then 'no PDF reader' when regexp_replace(text, '\\s+', '', 'g') = '' then 'blank' else 'ok' end"""
QUERIES = {"upload_status": upload_status, "upload_pages": upload_pages, "pages_renumbered": pages_renumbered, "content_duplicates": content_duplicates}
ORACLE = {
    "upload_status": f"select doc_id, {_STATUS} status, sha256(text) sha256, cast(octet_length(encode(text)) as integer) bytes from (select *, regexp_extract(lower(trim(coalesce(filename, ''))), '^.+(\\.[^.]*)$', 1) e from documents)",
    "upload_pages": r"select doc_id || '.txt' filename, 1 page_no, cast(length(text) as integer) size from documents where regexp_replace(text, '\s+', '', 'g') <> '' and not contains(text, chr(12))",
    "pages_renumbered": r"with p as (select doc_id, page_no, min(text) as text from pages where text is not null group by 1, 2) select doc_id, page_no, row_number() over (partition by doc_id order by page_no) number from p where regexp_replace(text, '\s+', '', 'g') <> ''",
    "content_duplicates": "with d as (select doc_id, sha256(text) h from documents where text is not null) select doc_id, \"first\" from d join (select h, min(doc_id) \"first\" from d group by 1 having count(*) > 1) using (h) where doc_id <> \"first\"",
}
ORACLE["pages_renumbered"] = dims.as_integers(ORACLE["pages_renumbered"], "number")
