"""Isotonic calibration of confidences.

`fit` pools adjacent violators by plain averages of the pooled points (not weighted by how many each holds) in the order
of (confidence, label); that is a recurrence over one ordered list, so it runs over the distinct (confidence, label)
pairs with their counts, which confidences of three decimals bound, and in one grouped task. `predict` interpolates
between knots by a range join with the few knots. Defined results: without knots a confidence predicts itself; beyond
the ends the end's value holds; on equal knots the later holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.operators.ordered import ranked
from chartloom.sources.tables import read

# Labelled points of the default calibrator; all are right, so every score is 1.
DEFAULT_POINTS = [(0.70, 1), (0.80, 1), (0.88, 1), (0.92, 1), (0.96, 1)]
#: Invented knots that tell confidences apart.
TEST_KNOTS = [(0.70, 0.20), (0.80, 0.55), (0.88, 0.86), (0.92, 0.91), (0.96, 1.0)]


def pool(points: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """The knots (x, y) of labelled points by pooling adjacent violators."""
    knots: list[list[float]] = []
    for x, y in sorted(points):
        knots.append([x, float(y)])
        while len(knots) > 1 and knots[-2][1] > knots[-1][1]:
            (x1, y1), (x2, y2) = knots[-2:]
            knots[-2:] = [[(x1 + x2) / 2, (y1 + y2) / 2]]
    return [(x, y) for x, y in knots]


#: Points that a fit works through; of more labelled rows, each pair's count is scaled down to its share of so many.
MOST_POINTS = 200_000


def fit(points: DataFrame, by: str | None = None, most: int = MOST_POINTS) -> DataFrame:
    """([by,] k, x, y): the knots of points ([by,] x, y), confidences rounded to three decimals."""
    g = by or "_all"
    p = points if by else points.withColumn(g, F.lit(0))
    # At most 2,002 pairs a group reach the one task: three decimals and two labels, with counts.
    c = p.select(g, F.round("x", 3).alias("x"), F.col("y").cast("int").alias("y")).groupBy(g, "x", "y").agg(F.count("*").alias("n"))
    kind = dict(c.dtypes)[g]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        scale = max(1.0, pdf["n"].sum() / most)
        rows = pool([(x, int(y)) for x, y, n in zip(pdf["x"], pdf["y"], pdf["n"]) for _ in range(-int(-n // scale))])
        return pd.DataFrame([(pdf[g].iloc[0], k, x, y) for k, (x, y) in enumerate(rows)], columns=[g, "k", "x", "y"])

    out = c.groupBy(g).applyInPandas(one, f"{g} {kind}, k int, x double, y double")
    return out if by else out.drop(g)


def predict(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Interpolation between the literal knots, which a fitted calibrator has few of."""
    if not knots:
        return x
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    out = out.when(x >= knots[-1][0], F.lit(float(knots[-1][1])))
    for (x1, y1), (x2, y2) in zip(knots, knots[1:]):
        value = F.lit(float(y2)) if x1 == x2 else F.lit(float(y1)) + (x - x1) / (x2 - x1) * (y2 - y1)
        out = out.when((x >= x1) & (x <= x2), value)
    return out.otherwise(F.lit(float(knots[-1][1])))


def predict_join(points: DataFrame, knots: DataFrame) -> DataFrame:
    """points (id, x) with their score by knots (k, x, y) of any number: the knot below by one range join, then the line."""
    k = knots.select(F.col("k"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    nxt = knots.select((F.col("k") - 1).alias("k"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    seg = k.join(nxt, "k", "left")
    ends = knots.agg(F.min("x").alias("lo"), F.min_by("y", "k").alias("ylo"), F.max("x").alias("hi"), F.max_by("y", "k").alias("yhi"))
    p = points.crossJoin(F.broadcast(ends))  # one row
    inside = p.join(seg, (F.col("x") > F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("x") < F.col("hi")), "left")
    line = F.when(F.col("x1") == F.col("x2"), F.col("y2")).otherwise(F.col("y1") + (F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return inside.select("id", "x", F.when(F.col("lo").isNull(), F.col("x")).when(F.col("x") <= F.col("lo"), F.col("ylo")).when(F.col("x") >= F.col("hi"), F.col("yhi")).otherwise(line).alias("score"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled confidences from ground truth: a lab row's confidence by its extractor and place, right where it has a code."""
    f = read(spark, sf, "facts").where("kind = 'lab'")
    x = F.round(F.when(F.col("extractor") == "regex", 0.8).otherwise(0.6) + (F.col("fact_id") % 20) / 100, 3)
    return f.select(F.col("fact_id").alias("id"), x.alias("x"), F.col("loinc").isNotNull().cast("int").alias("y"))


def isotonic_fit(spark: SparkSession, sf: str) -> DataFrame:
    return fit(labelled(spark, sf))


def isotonic_predict(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("id", predict(F.col("x"), TEST_KNOTS).alias("score"))


def isotonic_predict_join(spark: SparkSession, sf: str) -> DataFrame:
    return predict_join(labelled(spark, sf).select("id", "x"), dims.rows(spark, [(k, *p) for k, p in enumerate(TEST_KNOTS)], "k int, x double, y double")).select("id", "score")


def labelled_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first 60 percent of the labelled rows by position for fitting, the rest for the report."""
    p = labelled(spark, sf).withColumn("all", F.lit(0)).withColumn("bucket", F.floor(F.col("id") / 1024))
    total = p.groupBy("all").agg(F.count("*").alias("total"))
    return ranked(p, ["all"], ["id"], "bucket", "n").join(total, "all").select("id", (F.col("n") <= F.floor(F.col("total") * 0.6)).alias("fitting"))


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Share of right labels by confidence."""
    return labelled(spark, sf).groupBy("x").agg(F.count("*").alias("n"), (F.sum("y") / F.count("*")).alias("right"))


_LAB = "p as (select fact_id id, round(case when extractor = 'regex' then cast(0.8 as double) else cast(0.6 as double) end + cast(fact_id % 20 as double) / 100, 3) x, cast(loinc is not null as integer) y from facts where kind = 'lab')"
_D = lambda v: f"cast({v!r} as double)"
_SEG = " ".join(f"when x >= {_D(a)} and x <= {_D(c)} then {_D(b)} + (x - {_D(a)}) / ({_D(c)} - {_D(a)}) * ({_D(d)} - {_D(b)})" for (a, b), (c, d) in zip(TEST_KNOTS, TEST_KNOTS[1:]))
_PRED = f"case when x <= {_D(TEST_KNOTS[0][0])} then {_D(TEST_KNOTS[0][1])} when x >= {_D(TEST_KNOTS[-1][0])} then {_D(TEST_KNOTS[-1][1])} {_SEG} end"
QUERIES = {"isotonic_fit": isotonic_fit, "isotonic_predict": isotonic_predict, "isotonic_predict_join": isotonic_predict_join, "labelled_split": labelled_split, "reliability": reliability}
ORACLE = {
    "isotonic_predict": f"with {_LAB} select id, {_PRED} score from p",
    "isotonic_predict_join": f"with {_LAB} select id, {_PRED} score from p",
    "labelled_split": f"with {_LAB} select id, row_number() over (order by id) <= floor((select count(*) from p) * 0.6) fitting from p",
    "reliability": f'with {_LAB} select x, count(*) n, sum(y) / count(*) "right" from p group by 1',
}
