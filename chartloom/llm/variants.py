"""Variant spellings of names typed by people, by metric-space partitioning.

1. Normalised keys: a name becomes its parts (see persons.py); order, case, marks, titles, remarks and nicknames are
   settled there, so only misspellings are left to the metric.
2. Metric space: the distinct parts under Levenshtein's distance (a true metric). Each part is assigned to its nearest
   pivot; the cell of a pivot is divided by the distance to the pivot (rings) and by length (the distance to the empty
   word). By the triangle inequality a part y within r of x has |d(y, p) - d(x, p)| <= r for every pivot p, and its
   nearest pivot p satisfies d(x, p) <= d(x, nearest of x) + 2r: x is replicated to just these cells.
3. Exact radius join inside each cell. An overfull cell is divided further by the distance to another pivot. Swapped
   neighbours (distance 2) are found as equal multisets of letters at that distance.
4. Parts within the radius become forms of the more frequent spelling. Rows that share a form and strong evidence (birth,
   number, address), or, where a number is missing, a form and a near date, or two forms where a date is missing, are
   candidates: every pair that `decide` can take. A block of more than BLOCK near dates is divided by the rows' other
   forms, of which two whole names share one.
5. `decide` compares the whole names, dates and numbers of each candidate; strong pairs are closed transitively, and
   rows that are only an initial and a surname, or have no date, join the one group that fits, until nothing changes.

Equal rows (but for the key) are one profile throughout, so a group of exact copies costs one row. Defined results:
null, blank, test and placeholder names give nothing; repeated keys count once; empty tables give no row; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.persons import FULL_NAMES, PROFILE, SLIP, confidence, decide, parsed, registry_rows
from chartloom.operators.components import components
from chartloom.session import alone, discard, written
from chartloom.sources.tables import read

#: Pivots at most (their distances are one array a row); names a cell holds before it is divided; rows a block holds before it is divided.
PIVOTS, CELL, BLOCK = 256, 2000, 60
#: Candidates are met in parts by their hash, one after the other, so that only one part lies on disk at a time: one for ROWS_A_PASS rows, but for smaller tables up to PASSES of ROWS_A_SMALL_PASS.
PASSES, ROWS_A_SMALL_PASS, ROWS_A_PASS = 4, 30_000, 90_000
#: An open group takes the better of several fitting groups only where its support is so much larger.
MARGIN = 0.15


def radius_join(names: DataFrame, radius: int = 1, pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """(x, y), x < y: all pairs of the distinct names within the radius of Levenshtein's distance; exact."""
    names = written(names.select("name").where("name is not null").distinct())
    n = names.count()
    # A bounded sample by hash order: pivots decide only the cost, never the result.
    chosen = [r.name for r in names.orderBy(F.xxhash64("name"), "name").limit(max(1, min(pivots, 2 * math.isqrt(n)))).collect()]
    centres = F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<string>")
    d = names.select("name", F.length("name").alias("size"), F.transform(centres, lambda p: F.levenshtein("name", p)).alias("d"))
    d = written(d.withColumn("ring", F.array_min("d")).withColumn("cell", F.array_position("d", F.array_min("d")).cast("int") - 1))
    k = max(1, len(chosen))
    second = lambda j: F.element_at("d", ((j + 1) % k).cast("int") + 1)
    # Rows of `full` are bounded by pivots x rings x lengths, whatever the number of names.
    full = F.broadcast(d.groupBy("cell", "ring", "size").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("cell", "ring", "size", F.lit(True).alias("full")))
    at = ["cell", "ring", "size"]
    home = d.join(full, at, "left").select(*at, F.when(F.col("full"), second(F.col("cell"))).otherwise(-1).alias("part"), F.col("name").alias("y"))
    near = F.filter(F.transform("d", lambda x, j: F.struct(j.alias("cell"), x.alias("x"))), lambda s: s.x <= F.col("ring") + 2 * radius)
    rep = d.select("name", "d", "ring", "size", F.explode(near).alias("s"))
    rep = rep.select("name", "d", "size", F.col("s.cell").alias("cell"), F.explode(F.sequence(F.greatest(F.col("s.x") - radius, F.lit(0)), F.least(F.col("s.x") + radius, F.col("ring") + radius))).alias("ring"))
    rep = rep.select("name", "d", "cell", "ring", F.explode(F.sequence(F.greatest(F.col("size") - radius, F.lit(0)), F.col("size") + radius)).alias("size")).join(full, at, "left")
    away = second(F.col("cell"))
    rep = rep.select(*at, F.explode(F.when(F.col("full"), F.sequence(away - radius, away + radius)).otherwise(F.array(F.lit(-1)))).alias("part"), F.col("name").alias("x"))
    return rep.join(home, [*at, "part"]).where((F.col("x") < F.col("y")) & (F.levenshtein("x", "y", radius) >= 0)).select("x", "y")


def swapped(names: DataFrame) -> DataFrame:
    """(x, y), x < y: names that differ by two neighbouring letters put in the other order."""
    n = names.select("name").distinct().withColumn("letters", F.array_join(F.array_sort(F.split("name", "")), ""))
    pairs = n.withColumnRenamed("name", "x").join(n.withColumnRenamed("name", "y"), "letters").where((F.col("x") < F.col("y")) & (F.levenshtein("x", "y", 2) == 2))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substr("x", i, F.lit(1)) != F.substr("y", i, F.lit(1))))
    swap = F.concat(F.substr("x", F.lit(1), first - 1), F.substr("x", first + 1, F.lit(1)), F.substr("x", first, F.lit(1)), F.substr("x", first + 2))
    return pairs.where(swap == F.col("y")).select("x", "y")


def part_forms(part: DataFrame) -> DataFrame:
    """(part, n, forms): each distinct part with its rows, itself and the more frequent spellings (ties: the smaller) within one slip."""
    return alone(lambda: _part_forms(part))


def _part_forms(part: DataFrame) -> DataFrame:
    counts = written(part.groupBy("part").agg(F.count("*").alias("n")))
    long = counts.where("length(part) >= 4").select(F.col("part").alias("name"))
    pairs = radius_join(long).unionByName(swapped(long))
    for s in "xy":
        pairs = pairs.join(counts.select(F.col("part").alias(s), F.col("n").alias(f"n{s}")), s)
    to_x = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    more = pairs.select(F.when(to_x, F.col("y")).otherwise(F.col("x")).alias("part"), F.when(to_x, F.col("x")).otherwise(F.col("y")).alias("form")).groupBy("part").agg(F.collect_set("form").alias("more"))
    return counts.join(more, "part", "left").select("part", "n", F.array_union(F.array("part"), F.coalesce("more", F.array().cast("array<string>"))).alias("forms"))


def profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct profiles of the people in rows (key, name, dob, mrn, address), and (member, key) of their rows.

    A profile's key is a number, in the order of the smallest keys of their rows.
    """
    people = written(parsed(rows))
    one = written(people.groupBy(*PROFILE).agg(F.min("key").alias("first")).sort("first").select(F.monotonically_increasing_id().alias("key"), *PROFILE))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in PROFILE]
    h = F.xxhash64(*PROFILE)
    member = people.withColumn("h", h).alias("p").join(one.withColumn("h", h).alias("q"), (F.col("p.h") == F.col("q.h")) & same[0] & same[1] & same[2] & same[3] & same[4])
    member = written(member.select(F.col("p.key").alias("member"), F.col("q.key").alias("key")))
    discard(people)
    return one, member


def evidence(c: str = "dob") -> tuple[Column, Column]:
    """(strong, wide): pieces of a birth date, number and address that two damaged copies still share.

    Strong: the date up to a day or swapped month and day, the number up to a slip, the address. Wide: dates with two
    equal components or less than SLIP days apart; they count only beside a whole name where a number is missing.
    """
    y, m, d = F.floor(F.col(c) / 10000), F.floor(F.col(c) / 100) % 100, F.col(c) % 100
    day = F.unix_date(F.make_date(y.cast("int"), m.cast("int"), d.cast("int")))
    none = F.array().cast("array<string>")
    date = F.array(F.concat_ws("-", F.lit("c0"), F.floor(day / 2)), F.concat_ws("-", F.lit("c1"), F.floor((day + 1) / 2)), F.concat_ws("-", F.lit("sw"), y, F.least(m, d), F.greatest(m, d)))
    numbers = F.array(F.concat(F.lit("n"), F.array_join(F.array_sort(F.split("mrn", "")), "")), F.concat(F.lit("h"), F.substring("mrn", 1, 4)), F.concat(F.lit("t"), F.substring("mrn", 5, 4)))
    strong = F.concat(F.when(F.col(c).isNotNull(), date).otherwise(none), F.when(F.col("mrn").isNotNull(), numbers).otherwise(none), F.array_compact(F.array(F.concat(F.lit("a"), "home"))))
    wide = F.array(
        F.concat_ws("-", F.lit("ym"), y, m), F.concat_ws("-", F.lit("md"), m, d), F.concat_ws("-", F.lit("yd"), y, d),
        F.concat_ws("-", F.lit("d0"), F.floor(day / (2 * SLIP))), F.concat_ws("-", F.lit("d1"), F.floor((day + SLIP) / (2 * SLIP))),
    )
    return strong, F.when(F.col(c).isNotNull(), wide).otherwise(none)


def name_tokens(people: DataFrame) -> DataFrame:
    """(key, tokens): (n, t, at) of each name's parts, by the part's place; parts that `same_part` takes as one share a t.

    A part has its forms, its full names' forms, and the known parts that it begins with. n, how many rows hold the
    token, only orders: every row that has a token has it with the same n.
    """
    none = F.array().cast("array<string>")
    full = F.create_map(*[x for k, v in FULL_NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    # A part of three letters may lie one slip from a full name of four, which the radius join leaves out.
    four = F.array(*map(F.lit, sorted({f for v in FULL_NAMES.values() for f in v if len(f) <= 4})))
    fulls = F.concat(F.coalesce(F.element_at(full, F.col("part")), none), F.when(F.length("part") == 3, F.filter(four, lambda f: F.levenshtein("part", f) <= 1)).otherwise(none))
    part = people.select("key", F.posexplode("parts").alias("at", "part"))
    part = part.select("key", "at", F.explode(F.array_union(F.array("part"), fulls)).alias("part"))
    forms = part_forms(part)
    begin = forms.where("length(part) > 3").select("part", F.explode(F.transform(F.sequence(F.lit(3), F.length("part") - 1), lambda i: F.substr("part", F.lit(1), i))).alias("form"))
    held = forms.select("part", F.explode("forms").alias("form")).unionByName(begin)
    held = held.join(forms.select(F.col("part").alias("form"), "n"), "form").groupBy("part").agg(F.collect_set(F.struct("n", F.xxhash64("form").alias("t"))).alias("tokens"))
    return part.join(written(held), "part").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("tokens", lambda s: F.struct(s.n.alias("n"), s.t.alias("t"), F.col("at").alias("at"))))))).alias("tokens"))


def blocked_pairs(people: DataFrame, block: int = BLOCK, passes: int | None = None) -> DataFrame:
    """(a, b, weight), a < b: every pair that `decide` can take; weight sums the rarity (log2 of rows over holders) of what they share.

    Every hit of two names is a shared token, and `decide` takes no pair without a hit. So these keys lose no pair:
    an equal number; a token and strong evidence; for whole names, which have two hits, a token and wide evidence,
    or two tokens where a date is missing. Of two shared tokens the rarer is not the most common of either row,
    so wide keys leave each row's most common token out, unless several of its parts hold it.
    Of the pairs that meet at a part of a number only those with near numbers are kept, and at a wide key only those
    with two hits: what `decide` may take beside goes by another key, and the others are never written.

    The keys are met in `passes` parts by their hash; every key is met in one of them.
    """
    return alone(lambda: _blocked_pairs(people, block, passes))


def parts_of(total: int) -> int:
    return min(1 + total // ROWS_A_SMALL_PASS, PASSES + total // ROWS_A_PASS)


def _blocked_pairs(people: DataFrame, block: int, passes: int | None) -> DataFrame:
    total = people.count()
    passes = passes or parts_of(total)
    row = alone(lambda: _token_rows(people))
    strong, wide = evidence()
    row = row.select("*", F.col("dob").isNull().alias("open"), F.col("mrn").isNull().alias("free"))
    each = lambda ts, es, of: F.flatten(F.transform(ts, lambda t: F.transform(es, lambda e: F.struct(F.xxhash64(t, e).alias("k"), of(t, e)))))
    # Only a key of a part of a number carries the number.
    of_number = lambda t, e: F.when(F.substring(e, 1, 1).isin("n", "h", "t"), F.col("mrn")).alias("number")
    number = F.when(~F.col("free"), F.array(F.struct(F.xxhash64(F.lit("mrn"), "mrn").alias("k"), F.lit(None).cast("string").alias("number")))).otherwise(F.array().cast("array<struct<k: bigint, number: string>>"))
    firm = row.select("key", "one", "free", "mrn", strong.alias("strong")).select("key", F.inline(F.concat(each("one", "strong", of_number), number)))
    # At most two digits of near numbers differ.
    alike_numbers = "number_x is null or number_y is null or levenshtein(number_x, number_y, 2) >= 0"
    # Near dates count where a number is missing.
    # `mine` has a short hash of each token of each part, `place` its part.
    near = row.select("key", "free", "rare", wide.alias("wide"), F.transform("tokens", lambda s: F.hash(s.t)).alias("mine"), F.transform("tokens", lambda s: s["at"].cast("int")).alias("place"))
    near = near.select("key", "free", "mine", "place", F.inline(each("rare", "wide", lambda t, e: F.hash(t).alias("t"))))
    # Two hits are of two parts on either side.
    two_hits = " and ".join(f"size(array_distinct(filter(place_{s}, (p, i) -> array_contains(mine_{o}, mine_{s}[i])))) >= 2" for s, o in ("xy", "yx"))
    # Without a date: two tokens of two parts, from the rows without one; a number is missing too.
    two = F.array_distinct(F.flatten(F.transform("tokens", lambda s: F.transform(F.filter("tokens", lambda r: (r.at != s.at) & (r.t >= s.t)), lambda r: F.xxhash64(s.t, r.t)))))
    undated = row.select("key", "free", "open", F.explode(two).alias("k"))

    def divided(counted: DataFrame) -> DataFrame:
        """A full block's rows by the other token that whole names share, which may be the same one from two parts."""
        full = counted.where(F.col("n") > block)
        again = F.size(F.filter("mine", lambda t: t == F.col("t"))) > 1
        other = F.concat(F.transform(F.filter("mine", lambda t: t != F.col("t")), lambda t: F.xxhash64("k", t)), F.when(again, F.array(F.xxhash64("k", F.lit("twice")))).otherwise(F.array().cast("array<bigint>")))
        return full.select("key", "free", "mine", "place", F.explode(F.array_distinct(other)).alias("k"))

    def near_pairs(keys: DataFrame) -> DataFrame:
        counted = written(_counted(keys, "free"))
        paired = lambda df: _paired(df, total, "free", carried=["mine", "place"], where=two_hits)
        small = paired(counted.where(F.col("n") <= block))
        if counted.where(F.col("n") > block).isEmpty():
            return small
        return written(small).unionByName(paired(_counted(divided(counted), "free")))

    out = []
    for i in range(passes):
        part = lambda keys: keys.where(F.pmod("k", F.lit(passes)) == i)
        out.append(alone(lambda: _paired(_counted(part(firm)), total, carried=["number"], where=alike_numbers)))
        out.append(alone(lambda: near_pairs(part(near))))
        out.append(alone(lambda: _paired(_counted(part(undated), "open"), total, "open", "free")))
    return reduce(DataFrame.unionByName, out).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def _token_rows(people: DataFrame) -> DataFrame:
    """The rows with their tokens; one: each token once; twice: those of several parts; rare: all but the most common, unless it is of several parts."""
    row = people.select("key", "dob", "mrn", "home").join(name_tokens(people), "key")
    row = row.withColumn("one", F.array_distinct(F.transform("tokens", lambda s: F.struct(s.n.alias("n"), s.t.alias("t")))))
    row = row.withColumn("twice", F.filter(F.transform("one", lambda s: s.t), lambda t: F.size(F.filter("tokens", lambda s: s.t == t)) > 1))
    top = F.element_at("one", -1)
    row = row.withColumn("rare", F.transform(F.filter("one", lambda s: (s != top) | F.array_contains("twice", s.t)), lambda s: s.t))
    return row.withColumn("one", F.transform("one", lambda s: s.t)).withColumn("tokens", F.transform("tokens", lambda s: F.struct(s.t.alias("t"), s.at.alias("at"))))


def _counted(keys: DataFrame, *some: str) -> DataFrame:
    """The keys (key, k, ...) of blocks of two rows or more, of which one has each flag of `some`, with the rows n of their block."""
    w = Window.partitionBy("k")
    c = keys.select("*", F.count("*").over(w).alias("n"), *[F.max(f).over(w).alias(f"some_{f}") for f in some]).where("n >= 2")
    for f in some:
        c = c.where(f"some_{f}")
    return c.drop(*[f"some_{f}" for f in some])


def _paired(counted: DataFrame, total: int, *either: str, carried: Iterable[str] = (), where: str = "true") -> DataFrame:
    """(a, b, w) of the counted rows that share a key, where one of the two has each flag of `either`, and `where` holds for their `carried`; a pair once, w summed."""
    held = counted.select("key", "k", "n", *either, *carried)
    x, y = (held.select(F.col("key").alias(s), "k", F.col("n").alias(f"n_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in (*either, *carried)]) for s in "xy")
    if either:
        # From the flagged rows only; a pair of two of them is met once.
        j = x.where(f"{either[0]}_x").join(y, "k").where(f"x <> y and (not {either[0]}_y or x < y)")
        for f in either[1:]:
            j = j.where(f"{f}_x or {f}_y")
    else:
        j = x.join(y, "k").where("x < y")
    w = F.log2(F.lit(float(max(total, 2))) / F.col("n_x"))
    return j.where(where).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def decided(people: DataFrame, pairs: DataFrame, passes: int | None = None) -> DataFrame:
    """(a, b, kind, score) of the pairs that are strong or weak; the profiles meet their pairs in `passes` parts by a."""
    passes = passes or parts_of(people.count())
    part = lambda df, c, i: df.where(F.pmod(F.xxhash64(c), F.lit(passes)) == i)
    return reduce(DataFrame.unionByName, [written(_decided(part(people, "key", i), people, part(pairs, "a", i))) for i in range(passes)])


def _decided(first: DataFrame, people: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda df, s: df.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in PROFILE])
    both = pairs.select("a", "b").join(side(first, "a"), "a").join(side(people, "b"), "b").select("a", "b", *[f"{c}_{s}" for s in "ab" for c in PROFILE]).fillna(0, ["dob_a", "dob_b"])

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for a, b, pa, ia, da, ma, ha, pb, ib, db, mb, hb in t.itertuples(index=False):
                x, y = (list(pa), ia, da and int(da), ma, ha), (list(pb), ib, db and int(db), mb, hb)
                if kind := decide(x, y):
                    out.append((a, b, kind, confidence(x, y)))
            yield pd.DataFrame(out, columns=["a", "b", "kind", "score"])

    key = people.schema["key"].dataType.simpleString()
    return both.mapInPandas(judge, f"a {key}, b {key}, kind string, score double")


def settle(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, label): strong pairs closed; open groups join the one group that their weak pairs support, until stable."""
    label = components(people, pairs.where("kind = 'strong'"))
    weak = written(pairs.where("kind = 'weak'").select("a", "b", "score"))
    state = people.select("key", ((F.size("parts") < 2) | F.col("dob").isNull()).alias("open"))
    while True:
        open_ = label.join(state, "key").groupBy("label").agg(F.every("open").alias("open"))
        side = lambda s: label.select(F.col("key").alias(s), F.col("label").alias(f"l{s}"))
        w = weak.join(side("a"), "a").join(side("b"), "b").where("la <> lb")
        to = w.select(F.col("la").alias("x"), F.col("lb").alias("y"), "score").unionByName(w.select(F.col("lb").alias("x"), F.col("la").alias("y"), "score"))
        # The support of a neighbour group: the chance that one at least of the pairs is right.
        to = to.groupBy("x", "y").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("s"))
        to = to.join(open_.select(F.col("label").alias("x"), F.col("open").alias("ox")), "x").where("ox").join(open_.select(F.col("label").alias("y"), F.col("open").alias("oy")), "y")
        best = to.groupBy("x").agg(
            F.count_if(~F.col("oy")).alias("n"), F.max_by("y", F.when(~F.col("oy"), F.struct("s", "y"))).alias("closed"), F.min("y").alias("any"),
            F.max(F.when(~F.col("oy"), F.col("s"))).alias("s1"), F.sum(F.when(~F.col("oy"), F.col("s"))).alias("s"),
        )
        # With several fitting groups the best must stand out from all others together.
        chosen = written(best.where((F.col("n") <= 1) | (2 * F.col("s1") - F.col("s") > MARGIN)).select(F.col("x").alias("a"), F.coalesce("closed", "any").alias("b")))
        if chosen.isEmpty():
            discard(weak)
            return label
        merged = components(label.select(F.col("label").alias("key")), chosen)
        label = written(label.join(merged.select(F.col("key").alias("label"), F.col("label").alias("final")), "label").select("key", F.col("final").alias("label")))


def groups(rows: DataFrame) -> DataFrame:
    """(key, label) of every row (key, name, dob, mrn, address) that means a person; rows of one person carry one label."""
    people, member = profiles(rows)
    label = settle(people, alone(lambda: decided(people, blocked_pairs(people))))
    return member.join(label, "key").select(F.col("member").alias("key"), "label")


def linked_variants(patients: DataFrame, payloads: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of the rows of one person whose names differ byte for byte."""
    rows = registry_rows(patients).unionByName(payloads.select(F.col("payload_id").alias("key"), "name", "dob", "mrn", F.lit(None).cast("string").alias("address"))).where("key is not null").dropDuplicates(["key"])
    g = alone(lambda: groups(rows).join(rows.select("key", "name"), "key"))
    a, b = (g.select("label", F.col("key").alias(f"key_{s}"), F.col("name").alias(f"name_{s}")) for s in "ab")
    return a.join(b, "label").where("key_a < key_b and name_a <> name_b").select("key_a", "key_b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_variants(read(spark, sf_dir, "patients"), read(spark, sf_dir, "patient_payloads"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name part of both tables with its rows and its forms: the vocabulary of variant spellings."""
    rows = registry_rows(read(spark, sf_dir, "patients")).unionByName(read(spark, sf_dir, "patient_payloads").select(F.col("payload_id").alias("key"), "name", "dob", "mrn", F.lit(None).cast("string").alias("address")))
    return part_forms(parsed(rows).select("key", F.explode("parts").alias("part")))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLE: dict[str, str] = {}
