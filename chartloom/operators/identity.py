"""Identity resolution of demographic records: blocks, scored pairs, clusters and how right they are.

A pair's score is the weighted mean of the features that both records have (a missing feature is no evidence), put
through a logistic curve; equal record numbers decide by themselves. Clusters are connected components of the pairs at
or above the threshold, by iterated joins. Defined results: null and blank dates, sexes and numbers form no block;
records equal in everything but their id are still paired; empty tables give no row (and no rates).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators.components import components
from chartloom.session import written
from chartloom.sources.tables import read

# Weights of the features, the score of equal numbers, the threshold and the base of the logistic curve.
WEIGHTS = {"name": 0.30, "dob": 0.25, "sex": 0.05, "addr": 0.20}
NUMBER_CONFLICT, EQUAL_NUMBERS, TAU, E = 0.08, 0.995, 0.85, 2.718281828
#: Pairs of one key that a task meets at most, about; it decides only the cost.
PAIRS_A_PART = 2_000_000


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity with half transpositions, raised for up to four equal first letters whatever its height."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = list(b), []
    for i, c in enumerate(a):
        window = free[max(0, i - reach) : i + reach + 1]
        if c in window:
            free[max(0, i - reach) + window.index(c)] = None
            hits.append(c)
    if not hits:
        return 0.0
    other = [c for c, f in zip(b, free) if f is None]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, one row each, and their lengths; beyond a text's end lie zeros."""
    size = np.fromiter(map(len, texts), "int32", len(texts))
    out = np.zeros((len(texts), max(int(size.max(initial=0)), 1)), "uint32")
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "uint32")
    return out, size


def jaro_winkler_rows(a: list[str], b: list[str]) -> np.ndarray:
    """`jaro_winkler` of each pair of texts, for all pairs at once, letter by letter."""
    (x, n), (y, m) = letters(a), letters(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    free, hit = np.arange(y.shape[1]) < m[:, None], np.zeros(x.shape, bool)
    every = np.arange(len(a))
    for i in range(x.shape[1]):
        lo, hi = max(0, i - int(reach.max(initial=0))), min(y.shape[1], i + int(reach.max(initial=0)) + 1)
        if lo >= hi:
            break
        fits = (y[:, lo:hi] == x[:, i, None]) & free[:, lo:hi] & (np.abs(np.arange(lo, hi) - i) <= reach[:, None]) & (i < n)[:, None]
        first = fits.argmax(1)
        found = fits[every, first]
        hit[:, i] = found
        free[every[found], lo + first[found]] = False
    taken = (np.arange(y.shape[1]) < m[:, None]) & ~free
    hits = hit.sum(1)
    # The letters that met, in the order of each text: as many on both sides.
    differ = x[hit] != y[taken]
    t = np.bincount(np.repeat(every, hits)[differ], minlength=len(a)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(hits > 0, (hits / n + hits / m + (hits - t) / hits) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    same = np.cumprod((x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None]), 1).sum(1)
    return np.where(hits > 0, jaro + same * 0.1 * (1 - jaro), 0.0)


#: Pairs that are compared at once, and the letters of a text above which a pair is compared by itself.
AT_ONCE, LONG_TEXT = 4096, 64


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """In Arrow batches, as no builtin has this measure."""

    @F.pandas_udf("double")
    def jw(x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.fillna("").tolist(), y.fillna("").tolist()
        out = np.zeros(len(x))
        short = [i for i, (p, q) in enumerate(zip(x, y)) if max(len(p), len(q)) <= LONG_TEXT]
        for k in range(0, len(short), AT_ONCE):
            at = short[k : k + AT_ONCE]
            out[at] = jaro_winkler_rows([x[i] for i in at], [y[i] for i in at])
        for i in set(range(len(x))) - set(short):
            out[i] = jaro_winkler(x[i], y[i])
        return pd.Series(out)

    return jw(a, b)


def ascii_signs(c: Column) -> Column:
    """Letters outside ASCII count as one and the same sign, as engines differ in how they count them."""
    return F.regexp_replace(c, r"[^\x00-\x7f]", "?")


def signs_similarity(a: Column, b: Column) -> Column:
    """1 less the share of letters to change: a builtin that may stand in for the measure above."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def edit_similarity(a: Column, b: Column) -> Column:
    return signs_similarity(ascii_signs(a), ascii_signs(b))


def name_key(c: Column) -> Column:
    return F.trim(F.replace(F.lower(c), F.lit(","), F.lit("")))


def date_parts(c: Column) -> Column:
    """Year, month and day of an ISO date as a struct: read once a row, not once a pair; null parts for what is no date."""
    part = lambda i: F.regexp_extract(c, r"^(\d+)-(\d+)-(\d+)$", i).try_cast("int")
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def parts_similarity(a: Column, b: Column) -> Column:
    """Agreement of two dates by component: the year half, month and day the rest, swapped month and day nearly as much; 0 for what is no date."""
    (ya, ma, da), (yb, mb, db) = ([c[i] for i in "ymd"] for c in (a, b))
    year = F.when(ya == yb, 0.5).when(F.abs(ya - yb) <= 1, 0.1).otherwise(0.0)
    rest = F.when((ma == mb) & (da == db), 0.5).when((ma == db) & (da == mb), 0.4).when(ma == mb, 0.25).when(da == db, 0.2).otherwise(0.0)
    return F.when(ya.isNull() | yb.isNull(), 0.0).otherwise(F.least(F.lit(1.0), year + rest))


def dob_similarity(a: Column, b: Column) -> Column:
    """Agreement of two ISO dates by component."""
    return parts_similarity(date_parts(a), date_parts(b))


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on key, where a key with very many pairs is met in as many parts as its pairs ask for.

    The larger side of such a key is divided and the other repeated, so a filler number that a fiftieth of all rows
    give is no single task.
    """
    n = lambda df, c: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(c))
    # Above PAIRS_A_PART pairs: a table of keys, written first so that its true size decides.
    hot = n(left, "nl").join(n(right, "nr"), key).where(F.col("nl") * F.col("nr") > PAIRS_A_PART)
    hot = written(hot.select(key, F.least(F.greatest("nl", "nr"), F.ceil(F.col("nl") * F.col("nr") / PAIRS_A_PART)).cast("int").alias("parts"), (F.col("nl") >= F.col("nr")).alias("cut_left")))
    one, tasks = F.array(F.lit(0)), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.coalesce(F.col("parts"), F.lit(1))

    def side(df: DataFrame, cut: Column) -> DataFrame:
        at = F.when(F.col("parts").isNull(), one).when(cut, F.array(F.pmod(F.xxhash64(*df.columns), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1))
        # A number of partitions that is given is not joined again by size, which says nothing of the pairs.
        return df.join(hot, key, "left").withColumn("part_", F.explode(at)).drop("parts", "cut_left").repartition(tasks, key, "part_")

    return side(left, F.col("cut_left")).join(side(right, ~F.col("cut_left")), [key, "part_"]).drop("part_")


def blocking_pairs(records: DataFrame) -> DataFrame:
    """(i, j), i < j: distinct pairs of rec that share date of birth and sex, or the record number."""
    r = records.select("rec", F.nullif(F.trim("dob"), F.lit("")).alias("dob"), F.nullif(F.trim("sex"), F.lit("")).alias("sex"), F.nullif(F.trim("mrn"), F.lit("")).alias("mrn"))
    key = r.select("rec", F.explode(F.array_compact(F.array(F.when(F.col("dob").isNotNull() & F.col("sex").isNotNull(), F.xxhash64(F.lit("ds"), "dob", "sex")), F.when(F.col("mrn").isNotNull(), F.xxhash64(F.lit("mrn"), "mrn"))))).alias("k"))
    return key.select(F.col("rec").alias("i"), "k").join(key.select(F.col("rec").alias("j"), "k"), "k").where("i < j").select("i", "j").distinct()


def pair_features(records: DataFrame, similar: Callable[[Column, Column], Column] = jaro_winkler_column, pairs: DataFrame | None = None) -> DataFrame:
    """(i, j, equal_mrn, mean): the weighted mean of what both records have; null where that is nothing.

    What needs one record only (names in lower case, parts of dates) is computed before records meet. Without given
    pairs, records meet in their blocks with all that the mean needs, so no pair is shuffled.
    """
    # The edit similarity folds letters: once a record, not once a pair.
    fold, similar = (ascii_signs, signs_similarity) if similar is edit_similarity else (lambda c: c, similar)
    r = records.select("rec", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ["name", "dob", "sex", "address", "mrn"]])
    r = r.select("rec", fold(name_key(F.col("name"))).alias("name"), fold(F.lower("address")).alias("addr"), "dob", date_parts(F.col("dob")).alias("date"), "sex", "mrn")
    cols = r.columns[1:]
    side = lambda df, s: df.select(F.col("rec").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols], *[c for c in ["k"] if c in df.columns])
    if pairs is not None:
        return means(pairs.join(side(r, "i"), "i").join(side(r, "j"), "j"), similar)
    # A rec of several rows takes the pairs of all of them: such records meet by their distinct pairs.
    several = written(records.where("rec is not null").groupBy("rec").agg(F.count("*").alias("n")).where("n > 1").select("rec"))
    k = lambda *c: F.struct(*[x.alias(f"k{i}") for i, x in enumerate(c)])
    keys = F.array_compact(F.array(
        F.when(F.col("dob").isNotNull() & F.col("sex").isNotNull(), k(F.lit("born"), F.col("dob"), F.col("sex"))),
        F.when(F.col("mrn").isNotNull(), k(F.lit("mrn"), F.col("mrn"), F.lit(""))),
    ))
    single = r.where("rec is not null").join(several, "rec", "left_anti").withColumn("k", F.explode(keys))
    met = spread_join(side(single, "i"), side(single, "j"), "k").where("i < j")
    # Two records of both blocks meet by their births.
    met = met.where((F.col("k.k0") == "born") | ~F.coalesce((F.col("dob_i") == F.col("dob_j")) & (F.col("sex_i") == F.col("sex_j")), F.lit(False)))
    out = means(met, similar)
    if several.isEmpty():
        return out
    blocks = records.select("rec", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("dob", "sex", "mrn")]).withColumn("k", F.explode(keys)).select("rec", "k").distinct()
    some = blocks.join(several, "rec", "left_semi").select(F.col("rec").alias("x"), "k").join(blocks.select(F.col("rec").alias("y"), "k"), "k").where("x <> y")
    some = some.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()
    return out.unionByName(means(some.join(side(r, "i"), "i").join(side(r, "j"), "j"), similar))


def means(p: DataFrame, similar: Callable[[Column, Column], Column]) -> DataFrame:
    """(i, j, equal_mrn, mean) of pairs that hold what both records have."""
    both = lambda c: F.col(f"{c}_i").isNotNull() & F.col(f"{c}_j").isNotNull()
    p = p.withColumn("name_sim", F.when(both("name"), similar(F.col("name_i"), F.col("name_j")))).withColumn("addr_sim", F.when(both("addr"), similar(F.col("addr_i"), F.col("addr_j"))))
    sims = {"name": F.col("name_sim"), "dob": F.when(both("dob"), parts_similarity(F.col("date_i"), F.col("date_j"))), "sex": F.when(both("sex"), (F.col("sex_i") == F.col("sex_j")).cast("double")), "addr": F.col("addr_sim")}
    top, low = F.lit(0.0), F.lit(0.0)
    for k, s in sims.items():
        top, low = top + F.coalesce(WEIGHTS[k] * s, F.lit(0.0)), low + F.when(s.isNotNull(), WEIGHTS[k]).otherwise(0.0)
    conflict = both("mrn") & (F.col("mrn_i") != F.col("mrn_j"))
    low = low + F.when(conflict, NUMBER_CONFLICT).otherwise(0.0)
    return p.select("i", "j", F.coalesce(F.col("mrn_i") == F.col("mrn_j"), F.lit(False)).alias("equal_mrn"), F.when(low > 0, top / low).alias("mean"))


def score(equal: Column, mean: Column) -> Column:
    return F.when(equal, EQUAL_NUMBERS).when(mean.isNull(), 0.0).otherwise(1.0 / (1.0 + F.pow(F.lit(E), -(mean + 1.0))))


def matched(features: DataFrame) -> DataFrame:
    return features.withColumn("score", score(F.col("equal_mrn"), F.col("mean"))).withColumn("same", F.col("score") >= TAU)


def clusters(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec, label) of every record."""
    return components(records.select(F.col("rec").alias("key")), pairs.where("same").select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("key").alias("rec"), "label")


def trade_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose true owner is known: customers, and for each third a copy of an older system (capitals, other number, no address)."""
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    dob = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 7919 % 20000).cast("int")), "yyyy-MM-dd")
    sex = F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M")
    p = c.select(F.concat(F.lit("p"), "c_custkey").alias("rec"), F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"), dob.alias("dob"), sex.alias("sex"), F.concat(F.lit("MRN"), "c_custkey").alias("mrn"), F.col("c_mktsegment").alias("address"), F.lit(True).alias("primary"))
    old = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("q"), "c_custkey").alias("rec"), F.col("c_custkey").alias("owner"), F.upper("c_name").alias("name"), dob.alias("dob"), sex.alias("sex"), F.concat(F.lit("LEG"), "c_custkey").alias("mrn"), F.lit("").alias("address"), F.lit(False).alias("primary"))
    return p.unionByName(old)


def registry_records(spark: SparkSession, sf: str) -> DataFrame:
    """The registry and the older records under one set of columns."""
    p = read(spark, sf, "patients").select(F.concat(F.lit("p:"), "id").alias("rec"), "name", "dob", "sex", "mrn", F.get_json_object("patient_json", "$.address").alias("address"), F.lit(True).alias("primary"))
    r = read(spark, sf, "identity_records").select(F.concat(F.lit("r:"), F.col("rec_id").cast("string")).alias("rec"), "name", "dob", "sex", "mrn", "address")
    return p.unionByName(r, allowMissingColumns=True).withColumn("primary", F.coalesce("primary", F.lit(False)))


def identity_records_union(spark: SparkSession, sf: str) -> DataFrame:
    return registry_records(spark, sf).select("rec", "name", "dob", "primary")


def q_blocking_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return blocking_pairs(registry_records(spark, sf))


def pair_means(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the registry with their weighted means, names by edit similarity."""
    return pair_features(registry_records(spark, sf), edit_similarity)


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the registry with their scores, names by Jaro-Winkler."""
    return matched(pair_features(registry_records(spark, sf)))


def q_dob_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of the dates of patients and payloads that give the same number."""
    p = read(spark, sf, "patients").where("dob is not null").select("id", date_parts(F.col("dob")).alias("a"), F.nullif(F.trim("mrn"), F.lit("")).alias("mrn"))
    q = read(spark, sf, "patient_payloads").where("dob is not null").select("payload_id", date_parts(F.col("dob")).alias("b"), F.nullif(F.trim("mrn"), F.lit("")).alias("mrn"))
    return spread_join(p, q, "mrn").select("id", "payload_id", parts_similarity(F.col("a"), F.col("b")).alias("sim"))


def identity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Each cluster's canonical record (the first primary one, else the first), size and primary records."""
    r = trade_records(spark, sf)
    pairs = written(matched(pair_features(r, edit_similarity)))
    c = clusters(r, pairs).join(r.select("rec", "primary"), "rec")
    return c.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("primary"), F.col("rec"))), F.min("rec")).alias("canonical"), F.count("*").alias("size"), F.count_if("primary").alias("primaries"))


def confusion(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of pairs (i, j, same) against (rec, owner); a rate without cases is 0."""
    side = lambda s: truth.select(F.col("rec").alias(s), F.col("owner").alias(f"o{s}"))
    p = pairs.join(side("i"), "i").join(side("j"), "j").withColumn("true", F.col("oi") == F.col("oj"))
    c = p.agg(F.count("*").alias("pairs_scored"), F.count_if(F.col("same") & F.col("true")).alias("tp"), F.count_if(F.col("same") & ~F.col("true")).alias("fp"), F.count_if(~F.col("same") & F.col("true")).alias("fn"))
    return rates(c)


def rates(c: DataFrame) -> DataFrame:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumn("precision", zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))))
    return c.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def er_confusion(spark: SparkSession, sf: str) -> DataFrame:
    r = trade_records(spark, sf)
    return confusion(matched(pair_features(r, edit_similarity)), r)


def same_surname_pairs(records: DataFrame) -> DataFrame:
    """(i, j): ordered pairs of different records whose names begin with the same word."""
    r = records.select("rec", F.lower(F.element_at(F.split(F.trim("name"), " "), 1)).alias("word")).where("word <> ''")
    return r.select(F.col("rec").alias("i"), "word").join(r.select(F.col("rec").alias("j"), "word"), "word").where("i <> j").select("i", "j")


def negative_margin(spark: SparkSession, sf: str) -> DataFrame:
    """How near the pairs of different owners come to the threshold's weighted mean."""
    r = trade_records(spark, sf)
    side = lambda s: r.select(F.col("rec").alias(s), F.col("owner").alias(f"o{s}"))
    f = pair_features(r, edit_similarity).join(side("i"), "i").join(side("j"), "j").where("oi <> oj")
    return f.agg(F.count("*").alias("negatives"), F.max("mean").alias("max_mean"))


def surname_groups(spark: SparkSession, sf: str) -> DataFrame:
    """How many ordered pairs of older records share the first word of their names, by that word: counted, not emitted."""
    r = read(spark, sf, "identity_records").select(F.lower(F.element_at(F.split(F.trim("name"), " "), 1)).alias("word")).where("word <> ''")
    return r.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word", (F.col("n") * (F.col("n") - 1)).alias("pairs"))


_REG = """reg as (select 'p:' || id rec, "name", dob, sex, mrn, json_extract_string(patient_json, '$.address') address, true "primary" from patients
  union all select 'r:' || rec_id, "name", dob, sex, mrn, address, false from identity_records)"""
_TRADE = """reg as (select 'p' || c_custkey rec, c_custkey owner, c_name "name", strftime(date '1950-01-01' + cast(c_custkey * 7919 % 20000 as integer), '%Y-%m-%d') dob, case when c_custkey % 2 = 0 then 'F' else 'M' end sex, 'MRN' || c_custkey mrn, c_mktsegment address, true "primary" from customer
  union all select 'q' || c_custkey, c_custkey, upper(c_name), strftime(date '1950-01-01' + cast(c_custkey * 7919 % 20000 as integer), '%Y-%m-%d'), case when c_custkey % 2 = 0 then 'F' else 'M' end, 'LEG' || c_custkey, '', false from customer where c_custkey % 3 = 0)"""
_BLOCK = """r as (select rec, nullif(trim("name"), '') "name", nullif(trim(dob), '') dob, nullif(trim(sex), '') sex, nullif(trim(mrn), '') mrn, nullif(trim(address), '') address from reg),
bp as (select x.rec i, y.rec j from r x join r y on x.dob = y.dob and x.sex = y.sex and x.rec < y.rec union select x.rec, y.rec from r x join r y on x.mrn = y.mrn and x.rec < y.rec)"""


def dob_sql(a: str, b: str) -> str:
    p = lambda c, i: rf"try_cast(regexp_extract({c}, '^(\d+)-(\d+)-(\d+)$', {i}) as integer)"
    y1, m1, d1, y2, m2, d2 = [p(c, i) for c in (a, b) for i in (1, 2, 3)]
    return f"""case when {y1} is null or {y2} is null then cast(0.0 as double) else least(cast(1.0 as double), case when {y1} = {y2} then cast(0.5 as double) when abs({y1} - {y2}) <= 1 then cast(0.1 as double) else cast(0.0 as double) end
      + case when {m1} = {m2} and {d1} = {d2} then cast(0.5 as double) when {m1} = {d2} and {d1} = {m2} then cast(0.4 as double) when {m1} = {m2} then cast(0.25 as double) when {d1} = {d2} then cast(0.2 as double) else cast(0.0 as double) end) end"""


_D = lambda x: f"cast({x} as double)"
_ASC = lambda c: rf"regexp_replace({c}, '[^\x00-\x7f]', '?', 'g')"
_SIM = lambda a, b: f"cast(1.0 as double) - cast(levenshtein({_ASC(a)}, {_ASC(b)}) as double) / greatest(length({a}), length({b}))"
_NK = lambda c: f"trim(replace(lower({c}), ',', ''))"
_FEAT = f"""{_BLOCK}, q as (select i, j, x.mrn m1, y.mrn m2, case when x."name" is not null and y."name" is not null then {_SIM(_NK('x."name"'), _NK('y."name"'))} end s_name,
  case when x.dob is not null and y.dob is not null then {dob_sql('x.dob', 'y.dob')} end s_dob, case when x.sex is not null and y.sex is not null then cast(x.sex = y.sex as double) end s_sex,
  case when x.address is not null and y.address is not null then {_SIM('lower(x.address)', 'lower(y.address)')} end s_addr
  from bp join r x on x.rec = i join r y on y.rec = j),
w as (select *, {" + ".join(f"coalesce({_D(v)} * s_{k}, 0)" for k, v in WEIGHTS.items())} top, {" + ".join(f"case when s_{k} is not null then {_D(v)} else {_D(0.0)} end" for k, v in WEIGHTS.items())} + case when m1 <> m2 then {_D(NUMBER_CONFLICT)} else {_D(0.0)} end low from q),
pf as (select i, j, coalesce(m1 = m2, false) equal_mrn, case when low > 0 then top / low end mean from w),
pm as (select *, case when equal_mrn then true when mean is null then false else 1.0 / (1.0 + pow({_D(E)}, -(mean + 1.0))) >= {TAU} end same from pf)"""
_COMP = """adj as (select i a, j b from pm where same union select j, i from pm where same),
reach(a, b) as (select rec, rec from reg union select reach.a, adj.b from reach join adj on reach.b = adj.a),
lab as (select a rec, min(b) label from reach group by 1)"""

QUERIES = {
    "identity_records_union": identity_records_union, "blocking_pairs": q_blocking_pairs, "pair_means": pair_means, "pair_scores": pair_scores, "dob_similarity": q_dob_similarity, "identity_clusters": identity_clusters,
    "er_confusion": er_confusion, "negative_margin": negative_margin, "surname_groups": surname_groups,
}
ORACLE = {
    "identity_records_union": f'with {_REG} select rec, "name", dob, "primary" from reg',
    "blocking_pairs": f"with {_REG}, {_BLOCK} select i, j from bp",
    "pair_means": f"with {_REG}, {_FEAT} select i, j, equal_mrn, mean from pf",
    "dob_similarity": f"select p.id, payload_id, {dob_sql('p.dob', 'q.dob')} sim from patients p join patient_payloads q on nullif(trim(p.mrn), '') = nullif(trim(q.mrn), '') where p.dob is not null and q.dob is not null",
    "identity_clusters": f"""with recursive {_TRADE}, {_FEAT}, {_COMP} select label, coalesce(min(lab.rec) filter (where "primary"), min(lab.rec)) canonical, count(*) size, count(*) filter (where "primary") primaries from lab join reg on lab.rec = reg.rec group by 1""",
    "er_confusion": f"""with {_TRADE}, {_FEAT}, t as (select same, x.owner = y.owner tr from pm join reg x on x.rec = i join reg y on y.rec = j),
        c as (select count(*) pairs_scored, count(*) filter (where same and tr) tp, count(*) filter (where same and not tr) fp, count(*) filter (where not same and tr) fn from t),
        d as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as "precision", case when tp + fn > 0 then tp / (tp + fn) else 0.0 end recall from c)
        select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end f1 from d""",
    "negative_margin": f"with {_TRADE}, {_FEAT} select count(*) negatives, max(mean) max_mean from pf join reg x on x.rec = i join reg y on y.rec = j where x.owner <> y.owner",
    "surname_groups": """select word, n * (n - 1) pairs from (select lower(string_split(trim("name"), ' ')[1]) word, count(*) n from identity_records group by 1) where word <> '' and n > 1""",
}
