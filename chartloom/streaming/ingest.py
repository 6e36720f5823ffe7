"""Pages arriving as files become facts, and the charts of the persons that they touch are built anew.

Each micro-batch is an ordinary batch plan (extraction needs whole pages and encounters may be defined by later
documents, so nothing here is a stream-stream join). Facts are appended once a batch id: a batch that runs again after a
failure replaces what it wrote. Windowed counts keep state only within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.operators.chart import nodes
from chartloom.operators.extraction import parsed
from chartloom.operators.facts import person_key

PAGES = "doc_id bigint, page_no int, text string, patient_id string"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of pages under a path, so many a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batch_facts(pages: DataFrame, analytes: DataFrame) -> DataFrame:
    """The facts of a batch of pages in the schema of the facts table."""
    owner = pages.groupBy("doc_id").agg(F.max("patient_id").alias("patient_id"))
    none = lambda t: F.lit(None).cast(t)
    f = parsed(pages, analytes).join(owner, "doc_id")
    return f.select(
        F.xxhash64("doc_id", "page_no", "kind", "char_start", "name").alias("fact_id"), "doc_id", "patient_id", "page_no", "char_start", "char_end", F.lit("regex").alias("extractor"), "kind", "name", "value", "unit", "time_iso", "loinc",
        none("double").alias("ref_low"), none("double").alias("ref_high"), none("boolean").alias("abnormal"), F.lit(False).alias("negated"), none("string").alias("meta"),
    )


def ingest(stream: DataFrame, analytes: DataFrame, facts_path: str, charts_path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's facts under its id and write the charts of the persons that it touches; ends when all files are read."""
    spark = stream.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        batch_facts(batch, analytes).write.mode("overwrite").parquet(f"{facts_path}/batch={batch_id}")
        facts = spark.read.parquet(facts_path).drop("batch")
        touched = batch.select(person_key(F.col("patient_id")).alias("pid")).where("pid is not null").distinct()
        mine = facts.withColumn("pid", person_key(F.col("patient_id"))).join(touched, "pid", "left_semi").drop("pid")
        nodes(mine, analytes).write.mode("overwrite").parquet(f"{charts_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and last values of events (ts, event_type, value) by tumbling window; later events than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max_by("value", "ts").alias("last"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "event_type", "n", "last")
