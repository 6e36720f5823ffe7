"""Ranks and neighbours in ordered groups of any size.

A window over a whole group puts the group into one task. Here a group is divided by a bucket that agrees with the
order (a month of the ordering time, say): the window runs inside (group, bucket), and what crosses a bucket comes from
one pre-aggregated row a bucket. A group that holds a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], bucket: str, name: str = "n") -> DataFrame:
    """df with the 1-based rank of each row in its group; the order must begin with what the bucket is cut from."""
    at = [*keys, bucket]
    counts = df.groupBy(*at).agg(F.count("*").alias("_c"))
    before = counts.select(*at, F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*at).orderBy(*order)))
    return inside.join(before, at).withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")


def previous(df: DataFrame, keys: list[str], order: list[str], bucket: str, cols: list[str]) -> DataFrame:
    """df with prev_<col> of the row before in its group (null for the first)."""
    at = [*keys, bucket]
    w = Window.partitionBy(*at).orderBy(*order)
    last = df.groupBy(*at).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    last = last.select(*at, F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_last"))
    inside = df.withColumn("_lag", F.lag(F.struct(*cols)).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    prev = F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_lag"))
    return inside.join(last, at).select(*[F.col(c) for c in df.columns], *[prev[c].alias(f"prev_{c}") for c in cols])
