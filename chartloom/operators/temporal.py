"""Questions about time that charts answer: trends, visits, changes and gaps.

Series are grouped by (pid, analyte); steps inside a series are found month by month (ordered.previous), so that a
series of any length is spread over tasks. Times are ISO text and compared as such; lengths of time are exact
microseconds, a month of a window is 30 days. Defined results: undated rows are in no series, change or gap; fewer than
four points are no trend; a first value of 0 gives a change of 0 percent; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom import dims
from chartloom.functions.times import iso_micros
from chartloom.operators.chart import CHART_SQL, chart
from chartloom.operators.ordered import previous, ranked
from chartloom.sources.tables import read

DAY = 86_400_000_000


def points(n: DataFrame) -> DataFrame:
    """(pid, loinc, node_id, time, value, unit, ref_high, hi_is_worse, month): the dated results with a value."""
    p = n.where("type = 'LabResult' and time is not null and value is not null")
    return p.select("pid", "loinc", "node_id", "ord", "time", "value", "unit", "display", "ref_low", "ref_high", "hi_is_worse", F.substring("time", 1, 7).alias("month"))


def trends(p: DataFrame, least: int = 4, months: int | None = None, keys: tuple[str, ...] = ("pid", "loinc")) -> DataFrame:
    """One row a series: n, first, last, delta, change_pct, deteriorated, monotonicity (share of steps that worsen).

    With months, only points up to that many times 30 days before the series' last count, and must again be enough.
    """
    keys = list(keys)
    if months:
        last = p.groupBy(*keys).agg(F.count("*").alias("all_n"), F.max(iso_micros(F.col("time"))).alias("last_us")).where(F.col("all_n") >= least)
        p = p.join(last, keys).where(iso_micros(F.col("time")) >= F.col("last_us") - months * 30 * DAY)
    p = previous(p.select(*keys, "time", "ord", "node_id", "value", "unit", "display", "hi_is_worse", "ref_high", "month"), keys, ["time", "ord"], "month", ["value"])
    d = F.col("value") - F.col("prev_value")
    worse = F.when(F.col("hi_is_worse"), d > 0).otherwise(d < 0)
    at = F.struct("time", "ord")
    s = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by(F.struct("value", "time", "unit", "display", "hi_is_worse", "node_id"), at).alias("f"), F.max_by(F.struct("value", "time", "node_id", "ref_high"), at).alias("l"),
        F.count(d).alias("steps"), F.count_if(worse).alias("worse"),
    ).where(F.col("n") >= least)
    delta = F.col("l.value") - F.col("f.value")
    return s.select(
        *keys, F.col("f.display").alias("display"), "n", F.col("f.value").alias("first"), F.col("l.value").alias("last"), F.col("f.time").alias("first_time"), F.col("l.time").alias("last_time"), F.col("f.unit").alias("unit"),
        delta.alias("delta"), F.when(F.col("f.value") != 0, 100.0 * delta / F.col("f.value")).otherwise(0.0).alias("change_pct"),
        F.when(F.col("f.hi_is_worse"), delta > 0).otherwise(delta < 0).alias("deteriorated"), F.when(F.col("steps") > 0, F.col("worse") / F.col("steps")).otherwise(0.0).alias("monotonicity"),
        F.col("l.node_id").alias("last_node"), F.col("l.ref_high").alias("ref_high"), F.col("f.hi_is_worse").alias("hi_is_worse"),
    )


def visits(n: DataFrame) -> DataFrame:
    """(pid, n, last_id, last_ord_id, last_time, prev_id, prev_time): the latest encounters of each person.

    last_id is the first among the latest, last_ord_id the last of them; prev and last are the two last in order.
    """
    e = n.where("type = 'Encounter'").select("pid", "node_id", "time", "ord")
    top = e.groupBy("pid").agg(F.max("ord").alias("n"), F.max("time").alias("last_time"))
    j = e.join(top, "pid").where("ord >= n - 1 or time = last_time")
    return j.groupBy("pid").agg(
        F.max("n").alias("n"), F.min_by("node_id", F.when(F.col("time") == F.col("last_time"), F.col("ord"))).alias("last_id"), F.max_by("node_id", "ord").alias("last_ord_id"), F.max("last_time").alias("last_time"),
        F.max(F.when(F.col("ord") == F.col("n") - 1, F.col("node_id"))).alias("prev_id"), F.max(F.when(F.col("ord") == F.col("n") - 1, F.col("time"))).alias("prev_time"),
    )


def changed(n: DataFrame) -> DataFrame:
    """Nodes after the last but one encounter and up to the last one."""
    v = visits(n).where("n >= 2").select("pid", "prev_time", "last_time")
    c = n.where("type in ('Diagnosis', 'LabResult', 'MedicationOrder', 'Allergy') and time is not null")
    return c.join(v, "pid").where("prev_time < time and time <= last_time")


def gaps(n: DataFrame) -> DataFrame:
    """Diagnoses before the last encounter with the whole days between, the five longest gaps of each person by rank."""
    v = visits(n).where("n >= 2").select("pid", "last_time")
    d = n.where("type = 'Diagnosis' and time is not null").select("pid", "node_id", "code", "display", "time", "ord").join(v, "pid").where("time < last_time")
    d = d.withColumn("days", F.floor((iso_micros(F.col("last_time")) - iso_micros(F.col("time"))) / DAY))
    # The rank is cut before the shuffle, so a person with very many diagnoses sends five rows a task.
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("days"), "ord"))).where("rank <= 5")


def trend_by_analyte(spark: SparkSession, sf: str) -> DataFrame:
    return trends(points(chart(spark, sf))).drop("last_node", "ref_high", "hi_is_worse")


def trend_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    return trends(points(chart(spark, sf)), months=6).select("pid", "loinc", "n", "first", "last", "deteriorated", "monotonicity")


def trend_two_points(spark: SparkSession, sf: str) -> DataFrame:
    """Series of two points or more of each person, the longest first."""
    t = trends(points(chart(spark, sf)), least=2).withColumn("group", F.lit(0))
    return ranked(t, ["pid"], ["group", F.desc("n"), "loinc"], "group", "place").select("pid", "loinc", "n", "first", "last", "delta", "deteriorated", "place")


def trend_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of each series in order, with the direction of the step to each: 1 worse, -1 better, 0 equal."""
    p = previous(points(chart(spark, sf)), ["pid", "loinc"], ["time", "ord"], "month", ["value"])
    p = ranked(p, ["pid", "loinc"], ["time", "ord"], "month", "seq")
    d = F.col("value") - F.col("prev_value")
    return p.select("pid", "loinc", "node_id", "seq", (F.signum(d) * F.when(F.col("hi_is_worse"), 1).otherwise(-1)).cast("int").alias("step"))


def trend_trade(spark: SparkSession, sf: str) -> DataFrame:
    """The same trend over the event stream: each user's series of an event type."""
    e = read(spark, sf, "events").where("value is not null")
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    p = e.select(F.col("user_id").alias("pid"), F.col("event_type").alias("loinc"), F.col("event_id").cast("string").alias("node_id"), F.col("event_id").alias("ord"), t.alias("time"), "value", F.lit("").alias("unit"), F.col("event_type").alias("display"), F.lit(None).cast("double").alias("ref_high"), F.lit(True).alias("hi_is_worse"), F.substring(t, 1, 10).alias("month"))
    return trends(p).select("pid", "loinc", "n", "first", "last", "delta", "change_pct", "deteriorated", "monotonicity")


def latest_encounter(spark: SparkSession, sf: str) -> DataFrame:
    return visits(chart(spark, sf)).select("pid", "last_id", "last_ord_id", "last_time")


def last_two_encounters(spark: SparkSession, sf: str) -> DataFrame:
    return visits(chart(spark, sf)).where("n >= 2").select("pid", "prev_id", "prev_time", F.col("last_ord_id").alias("cur_id"))


def changed_since_last_visit(spark: SparkSession, sf: str) -> DataFrame:
    return changed(chart(spark, sf)).select("pid", "node_id", "type", "time")


def followup_gap_as_coded(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(chart(spark, sf)).select("pid", "node_id", "code", "time", "days", "rank")


def no_followup_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Dated diagnoses without any later encounter: an anti-join against each person's last one, one row a person."""
    n = chart(spark, sf)
    later = n.where("type = 'Encounter'").groupBy("pid").agg(F.max("time").alias("last_time"))
    d = n.where("type = 'Diagnosis' and time is not null")
    return d.join(later, (d.pid == later.pid) & (later.last_time > d.time), "left_anti").select("pid", "node_id", "time")


def already_known(spark: SparkSession, sf: str) -> DataFrame:
    """Of what changed at the last visit, whether the same code or name had been recorded by the visit before, and when first."""
    n = chart(spark, sf)
    what = F.coalesce("loinc", "code", F.lower("display"))
    first = n.where("type <> 'Encounter' and time is not null").groupBy("pid", "type", what.alias("what")).agg(F.min("time").alias("first_time"))
    c = changed(n).select("pid", "node_id", "type", what.alias("what"), "prev_time")
    return c.join(first, ["pid", "type", "what"]).select("pid", "node_id", "first_time", (F.col("first_time") <= F.col("prev_time")).alias("known"))


_V = """v as (select pid, max(ord) n, max(time) last_time, max(case when ord = mo - 1 then node_id end) prev_id, max(case when ord = mo - 1 then time end) prev_time, max(case when ord = mo then node_id end) last_ord_id, min_by(node_id, ord) filter (where time = mt) last_id
      from (select *, max(ord) over (partition by pid) mo, max(time) over (partition by pid) mt from nodes where type = 'Encounter') group by pid)"""
_US = lambda c: f"epoch_us(try_cast({c} as timestamp))"
#: Trends over a relation pts(pid, loinc, ord, time, value, unit, display, hi_is_worse) in SQL.
TREND_SQL = """s as (select *, value - lag(value) over w d, row_number() over w i, count(*) over (partition by pid, loinc) n from pts window w as (partition by pid, loinc order by time, ord)),
tr as (select pid, loinc, any_value(n) n, max(display) filter (where i = 1) display, max(value) filter (where i = 1) "first", max(value) filter (where i = n) "last", max(time) filter (where i = 1) first_time, max(time) filter (where i = n) last_time, max(unit) filter (where i = 1) unit,
       bool_or(hi_is_worse) filter (where i = 1) hi, count(d) steps, count(*) filter (where case when hi_is_worse then d > 0 else d < 0 end) worse from s group by pid, loinc),
t as (select *, "last" - "first" delta, case when "first" <> 0 then 100.0 * ("last" - "first") / "first" else 0.0 end change_pct, case when hi then "last" - "first" > 0 else "last" - "first" < 0 end deteriorated, case when steps > 0 then worse / steps else 0.0 end monotonicity from tr)"""
_PTS = "pts as (select * from nodes where type = 'LabResult' and time is not null and value is not null)"
_CHANGED = "ch as (select nodes.*, prev_time from nodes join v on nodes.pid = v.pid where type in ('Diagnosis', 'LabResult', 'MedicationOrder', 'Allergy') and n >= 2 and prev_time < time and time <= last_time)"

QUERIES = {
    "trend_by_analyte": trend_by_analyte, "trend_trailing_window": trend_trailing_window, "trend_two_points": trend_two_points, "trend_points": trend_points, "trend_trade": trend_trade, "latest_encounter": latest_encounter,
    "last_two_encounters": last_two_encounters, "changed_since_last_visit": changed_since_last_visit, "followup_gap_as_coded": followup_gap_as_coded, "no_followup_antijoin": no_followup_antijoin, "already_known": already_known,
}
ORACLE = {
    "trend_by_analyte": f'with {CHART_SQL}, {_PTS}, {TREND_SQL} select pid, loinc, display, n, "first", "last", first_time, last_time, unit, delta, change_pct, deteriorated, monotonicity from t where n >= 4',
    "trend_trailing_window": f"""with {CHART_SQL}, p0 as (select *, count(*) over (partition by pid, loinc) n0, max({_US('time')}) over (partition by pid, loinc) last_us from nodes where type = 'LabResult' and time is not null and value is not null),
        pts as (select * from p0 where n0 >= 4 and {_US('time')} >= last_us - 6 * 30 * {DAY}), {TREND_SQL} select pid, loinc, n, "first", "last", deteriorated, monotonicity from t where n >= 4""",
    "trend_two_points": f'with {CHART_SQL}, {_PTS}, {TREND_SQL} select pid, loinc, n, "first", "last", delta, deteriorated, row_number() over (partition by pid order by n desc, loinc) place from t where n >= 2',
    "trend_points": f"with {CHART_SQL}, {_PTS}, {TREND_SQL} select pid, loinc, node_id, i seq, cast(sign(d) * case when hi_is_worse then 1 else -1 end as integer) step from s",
    "trend_trade": f"""with pts as (select user_id pid, event_type loinc, event_id ord, strftime(ts, '%Y-%m-%dT%H:%M:%S') time, value, '' unit, event_type display, true hi_is_worse from events where value is not null), {TREND_SQL}
        select pid, loinc, n, "first", "last", delta, change_pct, deteriorated, monotonicity from t where n >= 4""",
    "latest_encounter": f"with {CHART_SQL}, {_V} select pid, last_id, last_ord_id, last_time from v",
    "last_two_encounters": f"with {CHART_SQL}, {_V} select pid, prev_id, prev_time, last_ord_id cur_id from v where n >= 2",
    "changed_since_last_visit": f"with {CHART_SQL}, {_V}, {_CHANGED} select pid, node_id, type, time from ch",
    "followup_gap_as_coded": f"""with {CHART_SQL}, {_V}, g as (select nodes.pid, node_id, code, time, ord, cast(floor(({_US('last_time')} - {_US('time')}) / {DAY}) as bigint) "days" from nodes join v on nodes.pid = v.pid where type = 'Diagnosis' and n >= 2 and time < last_time)
        select pid, node_id, code, time, "days", row_number() over (partition by pid order by "days" desc, ord) rank from g qualify rank <= 5""",
    "no_followup_antijoin": f"with {CHART_SQL} select pid, node_id, time from nodes x where type = 'Diagnosis' and time is not null and not exists (select 1 from nodes y where y.type = 'Encounter' and y.pid = x.pid and y.time > x.time)",
    "already_known": f"""with {CHART_SQL}, {_V}, {_CHANGED}, w as (select pid, type, coalesce(loinc, code, lower(display)) what, min(time) first_time from nodes where type <> 'Encounter' and time is not null group by 1, 2, 3)
        select ch.pid, node_id, first_time, first_time <= prev_time known from ch join w on ch.pid = w.pid and ch.type = w.type and coalesce(ch.loinc, ch.code, lower(ch.display)) = what""",
}
ORACLE["trend_two_points"] = dims.as_integers(ORACLE["trend_two_points"], "place")
ORACLE["trend_points"] = dims.as_integers(ORACLE["trend_points"], "seq")
ORACLE["followup_gap_as_coded"] = dims.as_integers(ORACLE["followup_gap_as_coded"], "rank")
