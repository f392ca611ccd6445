"""Joins that Spark has no single operator for: as-of months, radius, nearest value, guards and diagnostics."""

from __future__ import annotations

import math
import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.functions.rules import EARTH_MILES, haversine
from roadlens.operators.metrics import stored, with_slots

# Functions that run inside tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def as_of_month(rows: DataFrame, priors: DataFrame, date: str, month: str, keys: list[str], latest: str) -> DataFrame:
    """Left join on keys and the row's month, months after the latest one clipped to it."""
    clipped = F.least(F.trunc(date, "MM"), F.lit(latest).cast("date"))
    return rows.withColumn(month, clipped).join(priors, [*keys, month], "left")


def latest_before(rows: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, value: str, tie: str | None = None) -> DataFrame:
    """rows with the value of the newest fact of their key that is not later than they are, null if that fact's value is null.

    Of facts at one time the one with the largest `tie` column (else the largest value) counts. Rows and facts are unioned and swept in
    time order inside each key; nothing is joined by inequality.
    """
    held = F.struct(F.col(value).alias("v"))
    order = F.col(tie or value)
    known = facts.select(key, F.col(fact_at).alias("_at"), order.alias("_tie"), held.alias("_held"), F.lit(0).alias("_row"))
    nothing = F.lit(None).cast(known.schema["_held"].dataType)
    tagged = rows.withColumns({"_at": F.col(at), "_held": nothing, "_row": F.lit(1)})
    sweep = Window.partitionBy(key).orderBy("_at", "_row", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tagged.unionByName(known, allowMissingColumns=True)
    return both.withColumn(value, F.last("_held", ignorenulls=True).over(sweep)["v"]).where("_row = 1").drop("_at", "_held", "_row", "_tie")


def guard_fan_out(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and copies of those that would multiply rows of left; no rows mean the join is safe."""
    return right.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").join(left.select(*keys).distinct(), keys, "left_semi")


def guarded_join(left: DataFrame, right: DataFrame, keys: list[str], factor: float = 1.0, how: str = "left") -> DataFrame:
    """left joined with right (left or inner); raises before anything is joined if that would have more than factor times left's rows.

    The size of the result comes from counts by key of both sides, which read the key columns alone and are combined before their shuffle.
    """
    counts = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    met = counts(left, "_l").join(counts(right.na.drop(subset=keys), "_r"), keys, "left")
    found = F.coalesce("_r", F.lit(0))
    sizes = met.agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_l") * (F.greatest(found, F.lit(1)) if how == "left" else found)), F.lit(0)).alias("made")).first()
    if sizes.made > factor * sizes.n:
        raise ValueError(f"join fans out: {sizes.made} rows from {sizes.n}")
    return left.join(right, keys, how)


def _cells(band: Column, high: float) -> Column:
    """How many cells a band of latitude has: each at least as wide as the band is high."""
    farthest = F.least(F.lit(90.0), F.greatest(F.abs(band * high), F.abs((band + 1) * high)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(farthest)) / high)).cast("long")


def _sphere(rows: DataFrame, lat: str, lon: str, name: str) -> DataFrame:
    """rows with <name>x, <name>y, <name>z: the place as a vector of length 1."""
    phi, theta = F.radians(lat), F.radians(lon)
    return rows.withColumns({f"{name}x": F.cos(phi) * F.cos(theta), f"{name}y": F.cos(phi) * F.sin(theta), f"{name}z": F.sin(phi)})


def within_radius(left: DataFrame, right: DataFrame, miles: float, salts: int = 8) -> DataFrame:
    """Pairs at most so many miles apart: left (id, lat, lon) and right (rid, rlat, rlon), at all latitudes and over 180 degrees.

    Bands of latitude are half as high as the radius and cut into cells of their own width. The right side visits all cells of its own and
    the neighbouring bands that its circle can reach (near a pole, whole bands), so pairs come from an equi-join on cells. Straight lines
    between the places, without trigonometry, leave out most of the pairs that are too far, and the exact distance decides. Rows of one cell
    on the left side are dealt over `salts` keys, so that a city is no hot key. Both sides are dealt by number: they are small beside the
    pairs, and Spark would join them in the few tasks that their own size asks for.
    """
    high = miles / 69.0 / 2  # a degree of latitude is a little longer
    round_ = lambda lon: F.pmod(lon + 180.0, F.lit(360.0))
    band = F.floor(F.col("lat") / high).cast("long")
    n = _cells(F.col("_y"), high)
    placed = left.withColumn("_y", band).withColumn("_x", F.least(F.floor(round_(F.col("lon")) * n / 360), n - 1).cast("long"))
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))

    reach = miles / EARTH_MILES
    shrunk = F.cos(F.radians(F.col("rlat")))
    half = F.when(shrunk <= math.sin(reach), 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / shrunk)))) + 1e-9
    spread = right.withColumn("_dy", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    spread = spread.withColumn("_y", F.floor(F.col("rlat") / high).cast("long") + F.col("_dy")).withColumn("_n", n)
    first, last = (F.floor((F.col("rlon") + 180.0 + sign * half) * F.col("_n") / 360).cast("long") for sign in (-1, 1))
    all_cells = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    some = F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.col("_n")))
    spread = spread.withColumn("_x", F.explode(F.when(last - first + 1 >= F.col("_n"), all_cells).otherwise(some)))
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("_dy", "_n")

    spark, keys = left.sparkSession, ["_y", "_x", "_salt"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    one, other = (_sphere(rows, lat, lon, name).repartition(tasks, *keys) for rows, lat, lon, name in ((placed, "lat", "lon", "_l"), (spread, "rlat", "rlon", "_r")))
    chord = sum((F.col(f"_l{c}") - F.col(f"_r{c}")) * (F.col(f"_l{c}") - F.col(f"_r{c}")) for c in "xyz")
    pairs = one.join(other, keys).where(chord <= (2 * math.sin(min(reach, math.pi) / 2)) ** 2 * (1 + 1e-6) + 1e-12)
    pairs = pairs.drop(*keys, *[f"_{side}{c}" for side in "lr" for c in "xyz"])
    distance = haversine(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon"))
    return pairs.withColumn("miles", distance).where(F.col("miles") <= miles)


def nearest_within(left: DataFrame, right: DataFrame, miles: float, k: int, prefer: str) -> DataFrame:
    """id, rid, place: for each left row the first k of the right rows within so many miles, by `prefer` (never null), distance and rid.

    Sides as for within_radius. A left row that has k rows of the lowest value of `prefer` in a smaller circle needs no other pairs, so
    circles grow from a 64th of the radius and only rows that are still open go on; the last circle takes all values.
    """
    order = Window.partitionBy("id").orderBy(prefer, "miles", "rid")
    best = right.agg(F.min(prefer)).first()[0]
    parts, open_ = [], left
    for share in (64, 16, 4):
        found = within_radius(open_, right.where(F.col(prefer) == best), miles / share).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        full = F.max("place").over(Window.partitionBy("id")) == k
        parts.append(stored(found.withColumn("_full", full).where("_full").select("id", "rid", "place")))
        open_ = stored(open_.join(parts[-1].where("place = 1").select("id"), "id", "left_anti"))
    rest = within_radius(open_, right, miles).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return reduce(DataFrame.unionByName, [*parts, rest.select("id", "rid", "place")])


def _nearest_groups(asked: list[tuple], held: dict, k: int) -> dict[tuple, list[tuple]]:
    """For each (value, group) in sweep order, the k nearest groups of the sweep so far without its own: (gap, group, entity).

    held: the last value and entity of groups, of which the nearest k + 1 are kept (ties: by name). Rows of equal values see each other.
    """
    out: dict[tuple, list[tuple]] = {}
    at = 0
    while at < len(asked):
        value, end = asked[at][0], at
        while end < len(asked) and asked[end][0] == value:
            held[asked[end][1]] = (value, asked[end][2])
            end += 1
        nearest = sorted(held.items(), key=lambda g: (abs(value - g[1][0]), g[0]))
        held = dict(nearest[: k + 1])
        for _, group, _ in asked[at:end]:
            out[value, group] = [(abs(value - v), g, e) for g, (v, e) in nearest[: k + 1] if g != group][:k]
        at = end
    return out


def nearest_values(rates: DataFrame, entity: str, group: str, value: str, k: int) -> DataFrame:
    """For each entity the k entities of other groups with the closest values, one for each group; ties by group, then by name.

    Values are compared at 12 decimals and gaps are rounded to 9. A sweep in value order keeps the last value of the k + 1 nearest
    groups, which is all that a later row can need; one from below and one from above give both sides. The sweeps run over ranges of values,
    each in a task of its own, and every range is handed what the ranges before it leave: k + 1 groups each. Entities of one group and
    value share an answer, so they are swept once.
    """
    known = rates.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(
        F.col(entity).alias("_e"), F.col(group).alias("_g"), F.round(F.col(value).cast("double"), 12).alias("_v")
    )
    known = stored(known)
    points = with_slots(known.groupBy("_v", "_g").agg(F.min("_e").alias("_e")), "_v")
    ends = {sign: F.max(F.struct((sign * F.col("_v")).alias("v"), "_e")) for sign in (1, -1)}  # of equal values an entity is one's own choice
    nearest = {}
    for sign, end in ends.items():
        best = points.groupBy("_slot", "_g").agg(end.alias("b")).withColumn("r", F.row_number().over(Window.partitionBy("_slot").orderBy(F.desc("b.v"), "_g")))
        nearest[sign] = best.where(F.col("r") <= k + 1).select("_slot", "_g", (sign * F.col("b.v")).alias("v"), "b._e").collect()  # k + 1 a range

    def carried(slot: int, sign: int) -> dict:
        held: dict = {}
        for row in sorted(nearest[sign], key=lambda r: sign * r["_slot"]):
            if sign * row["_slot"] < sign * slot:
                held[row["_g"]] = (row["v"], row["_e"])
        return held

    kind = f"_v double, _g {points.schema['_g'].dataType.simpleString()}, gap double, {group} {points.schema['_g'].dataType.simpleString()}, similar {points.schema['_e'].dataType.simpleString()}, place int"

    def sweep(table):
        import pandas as pd

        slot = int(table["_slot"].iloc[0])
        rows = sorted(zip(table["_v"], table["_g"], table["_e"], strict=True))
        below = _nearest_groups(rows, carried(slot, 1), k)
        above = _nearest_groups(rows[::-1], carried(slot, -1), k)
        out = []
        for (v, g), found in below.items():
            best: dict = {}
            for gap, other, e in [*found, *above[v, g]]:
                one = (round(gap, 9), e)
                best[other] = min(best.get(other, one), one)
            ranked = sorted((gap, other, e) for other, (gap, e) in best.items())[:k]
            out += [(v, g, gap, other, e, place + 1) for place, (gap, other, e) in enumerate(ranked)]
        return pd.DataFrame(out, columns=["_v", "_g", "gap", group, "similar", "place"])

    answers = points.groupBy("_slot").applyInPandas(sweep, kind)
    return known.join(answers, ["_v", "_g"]).select(F.col("_e").alias(entity), "place", group, "similar", "gap")


def compare_pairs(pairs: DataFrame, rates: DataFrame, entity: str, value: str) -> DataFrame:
    """a, b, their values, the difference and the lower one as winner (null for ties)."""
    side = lambda s: rates.select(F.col(entity).alias(s), F.col(value).alias(f"{value}_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    va, vb = F.col(f"{value}_a"), F.col(f"{value}_b")
    return joined.select(
        "a", "b", f"{value}_a", f"{value}_b", F.round(va - vb, 6).alias("diff"), F.when(va < vb, F.col("a")).when(vb < va, F.col("b")).alias("winner")
    )


def key_overlap(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """rows, matched: how many keys of left occur in right after normalising."""
    keys = right.select(key.alias("k")).distinct().withColumn("hit", F.lit(1))
    return left.select(key.alias("k")).join(keys, "k", "left").agg(F.count(F.lit(1)).alias("rows"), F.count("hit").alias("matched"))
