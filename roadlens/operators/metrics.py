"""Model and data quality measures as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.sources.files import new_folder

#: Up to so many values are sorted by one task (or one for each key), without ranges.
ONE_TASK = 1_000_000
#: Ranges that more ordered values are cut into, and those that each large key is cut into; each range is sorted by one task.
SLOTS, KEYED_SLOTS = 256, 1024
#: A key is large if it has more than ONE_TASK rows and more than this share of all rows, so there are at most 1000 of them.
LARGE = 0.001


def stored(rows: DataFrame) -> DataFrame:
    """rows, written once to the shared folder and read back: quantiles, sums of slots and running sums all go over them."""
    path = new_folder(rows.sparkSession, "ordered")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_slots(rows: DataFrame, order: str, slots: int = SLOTS) -> DataFrame:
    """rows with _slot: the range of `order` that a row falls into, between approximate quantiles; equal values share a slot.

    The quantiles come from a mergeable sketch, so no task sorts all values; at most `slots` of them go to the driver, and a row finds its
    slot by halving inside generated code.
    """
    found = rows.agg(F.percentile_approx(order, [i / slots for i in range(1, slots)], 10_000)).first()[0] or []
    bounds = sorted(set(found))

    def slot(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) > F.lit(bounds[middle]), slot(middle + 1, high)).otherwise(slot(low, middle))

    return rows.withColumn("_slot", slot(0, len(bounds)))


def with_keyed_slots(rows: DataFrame, order: str, keys: list[str], slots: int = KEYED_SLOTS) -> DataFrame:
    """rows with _slot: for large keys the range of the key's own quantiles that a row falls into, for all others 0.

    The quantiles of large keys come from sketches that are merged by key, so a key with half of all rows is cut as finely as any other; the
    bounds of at most 1 / LARGE keys are broadcast, and a row finds its slot by halving its key's bounds.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    large = counts.where((F.col("_n") > ONE_TASK) & (F.col("_n") > LARGE * total)).select(*keys)
    if not large.limit(1).count():
        return rows.withColumn("_slot", F.lit(0))
    quantiles = F.percentile_approx(order, [i / slots for i in range(1, slots)], 10_000)
    bounds = rows.join(F.broadcast(large), keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.array_distinct(quantiles)).alias("_bounds"))
    steps = [1 << i for i in reversed(range(slots.bit_length()))]
    below = lambda at: F.coalesce(F.get("_bounds", at) < F.col(order), F.lit(False))
    slot = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(below(at + step - 1), at + step).otherwise(at))
    return rows.join(F.broadcast(stored(bounds)), keys, "left").withColumn("_slot", slot).drop("_bounds")


def preceding(values: DataFrame, order: str, columns: list[str], keys: list[str] | None = None, slots: int | None = None) -> DataFrame:
    """values with before_<column>: sums over all rows of equal keys that come before in order, 0 without any.

    Up to ONE_TASK values are summed in one window. Beyond that running sums go over one slot each, and the sums of earlier slots are added
    from a table of a row for each slot.
    """
    keys = keys or []
    held = stored(values)
    if slots is None and held.count() <= ONE_TASK:  # few enough for one task to sort
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return held.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns})
    slotted = with_keyed_slots(held, order, keys, slots or KEYED_SLOTS) if keys else with_slots(held, order, slots or SLOTS)
    inside = Window.partitionBy(*keys, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = slotted.groupBy(*keys, "_slot").agg(*[F.sum(c).alias(c) for c in columns])
    sums = sums.select(*keys, "_slot", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    joined = slotted.join(sums if keys else F.broadcast(sums), [*keys, "_slot"])  # at most `slots` rows
    total = lambda c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    return joined.withColumns({f"before_{c}": total(c) for c in columns}).drop("_slot", *[f"_{c}" for c in columns])


def auc(scored: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, auc: tie-aware area under the ROC curve; null where a class is missing.

    Scores are first counted by value, and values are ranked in ranges, so no task holds all of them.
    """
    keys = keys or []
    values = scored.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("q", F.col("n") - F.col("p"))
    ranked = preceding(values, score, ["q"], keys)
    wins = F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.try_divide(wins, F.sum("p") * F.sum("q")).alias("auc"))


def percent_ranks(rows: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """rows with their percent rank by value among rows of equal keys (0 for a single row).

    Rows are written once and ranked in one pass over (key, range) groups; what lies in a key's lower ranges is added from their counts.
    """
    held = stored(rows)
    if held.count() <= ONE_TASK:
        return held.withColumn(name, F.percent_rank().over(Window.partitionBy(*keys).orderBy(value)))
    slotted = with_keyed_slots(held, value, keys)
    sizes = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_slot", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_lower"), F.sum("_m").over(Window.partitionBy(*keys)).alias("_total"))
    before = F.rank().over(Window.partitionBy(*keys, "_slot").orderBy(value)) - 1 + F.col("_lower")
    null_safe = [slotted[k].eqNullSafe(sizes[k]) for k in (*keys, "_slot")]
    joined = slotted.join(sizes.select(*[F.col(k) for k in (*keys, "_slot")], "_lower", "_total"), null_safe).drop(*[sizes[k] for k in (*keys, "_slot")])
    share = F.coalesce(F.try_divide(before.cast("double"), F.col("_total") - 1), F.lit(0.0))
    return joined.withColumn(name, share).select(*rows.columns, name)


def calibration_check(scored: DataFrame, raw: str, calibrated: str, buckets: int = 10) -> DataFrame:
    """bucket, n, outside, falling: values outside (0, 1), and values lower than that of the row before them in raw order.

    The first row of each range is compared with the last one of the ranges before it, so falls between ranges count too.
    """
    rows = with_slots(stored(scored.select(F.col(raw).alias("_raw"), F.col(calibrated).alias("_cal"))), "_raw")
    last = rows.groupBy("_slot").agg(F.max(F.struct("_raw", "_cal"))["_cal"].alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.orderBy("_slot")))  # at most SLOTS rows
    own = Window.partitionBy("_slot").orderBy("_raw", "_cal")
    compared = rows.join(F.broadcast(last), "_slot").withColumn("_before", F.coalesce(F.lag("_cal").over(own), "_last"))
    bucket = F.least(F.lit(buckets - 1), F.floor(F.col("_raw") * buckets)).cast("int")
    outside = F.count_if((F.col("_cal") <= 0) | (F.col("_cal") >= 1))
    return compared.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), outside.alias("outside"), F.count_if(F.col("_cal") < F.col("_before")).alias("falling")
    )


def brier_and_loss(scored: DataFrame, score: str, label: str) -> DataFrame:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    loss = -(F.col(label) * F.ln(p) + (1 - F.col(label)) * F.ln(1 - p))
    return scored.agg(F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 9).alias("brier"), F.round(F.avg(loss), 9).alias("log_loss"))


def calibration(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """ece, expected_over_observed from equal-width bins."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    binned = scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("p"), F.sum(label).alias("y"))
    return binned.agg(
        F.round(F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 9).alias("ece"),
        F.round(F.try_divide(F.sum("p"), F.sum("y")), 9).alias("expected_over_observed"),
    )


def top_share_lift(scored: DataFrame, score: str, label: str, tie: str, parts: int = 10) -> DataFrame:
    """lift of the label in the highest 1/parts of scores, ties by id: the cut is found from counts by score.

    Rows above the score at which the share is reached are all in and are only summed; of that score's own rows the smallest ids fill the
    rest, found from counts by id over ranges of ids.
    """
    by_score = stored(scored.groupBy(score).agg(F.count(F.lit(1)).alias("m"), F.sum(label).cast("double").alias("y")))
    total = by_score.agg(F.sum("m").alias("n"), F.try_divide(F.sum("y"), F.sum("m")).alias("base")).first()
    n, want = total.n or 0, (total.n or 0) // parts
    ranked = preceding(by_score, score, ["m"]).withColumn("above", F.lit(n) - F.col("before_m") - F.col("m"))
    whole = ranked.where(F.col("above") + F.col("m") <= want).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"))
    cut = ranked.where((F.col("above") < want) & (F.col("above") + F.col("m") > want)).first()
    if cut is not None:
        own = scored.where(F.col(score) == F.lit(cut[score])).groupBy(tie).agg(F.count(F.lit(1)).alias("c"), F.sum(label).cast("double").alias("y"))
        taken = F.least(F.col("c"), F.lit(want - cut["above"]) - F.col("before_c"))  # of an id's equal rows, as many as there is room for
        part = preceding(own, tie, ["c"]).where(taken > 0).agg(F.sum(taken).alias("m"), F.sum(F.col("y") * taken / F.col("c")).alias("y"))
        whole = whole.unionByName(part)
    share = F.try_divide(F.sum("y"), F.sum("m"))
    return whole.agg(F.sum("m").cast("long").alias("n"), F.round(F.try_divide(share, F.lit(total.base).cast("double")), 6).alias("lift"))


def latency(rows: DataFrame, ms: str, failed: str, at: str) -> DataFrame:
    """n, nearest-rank p50, p95 and p99, least, most, error_pct, rps of a request log."""
    by_value = rows.groupBy(ms).agg(F.count(F.lit(1)).alias("m"), F.sum(failed).alias("e"), F.min(at).alias("first"), F.max(at).alias("last"))
    total = by_value.agg(F.sum("m").alias("n"))
    run = preceding(by_value, ms, ["m"]).withColumn("upto", F.col("before_m") + F.col("m")).join(F.broadcast(total))  # one row
    rank = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1), F.col(ms)))
    span = F.unix_micros(F.max("last").cast("timestamp")) - F.unix_micros(F.min("first").cast("timestamp"))
    return run.agg(
        F.sum("m").alias("n"),
        rank(50).alias("p50"),
        rank(95).alias("p95"),
        rank(99).alias("p99"),
        F.min(ms).alias("least"),
        F.max(ms).alias("most"),
        F.round(F.sum("e") * 100.0 / F.sum("m"), 6).alias("error_pct"),
        F.round(F.try_divide(F.sum("m"), span / 1e6), 6).alias("rps"),
    )


def falls(
    cube: DataFrame, axis: str, order: list[str], scope: str | None = None, rate: str = "risk", weight: str = "n", tolerance: float = 2.0, least: int = 100
) -> DataFrame:
    """scope, axis, soft, hard: how often the weighted rate falls from one band of an axis to the next, by scope (or over all).

    A fall of more than `tolerance` per cent between bands of at least `least` tests is hard, any other one soft. Bands outside the order are left out.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(axis))
    key = F.col(scope) if scope else F.lit("all")
    bands = cube.where(place > 0).groupBy(key.alias("scope"), place.alias("_place"))
    bands = bands.agg(F.try_divide(F.sum(F.col(rate) * F.col(weight)), F.sum(weight)).alias("_rate"), F.sum(weight).alias("_n"))
    up = Window.partitionBy("scope").orderBy("_place")  # as many rows as there are bands
    steps = bands.withColumns({"_before": F.lag("_rate").over(up), "_before_n": F.lag("_n").over(up)})
    fall = 100 * F.try_divide(F.col("_before") - F.col("_rate"), F.col("_before"))
    hard = (fall > tolerance) & (F.least("_n", "_before_n") >= least)
    return steps.groupBy("scope").agg(F.lit(axis).alias("axis"), F.count_if((fall > 0) & ~hard).alias("soft"), F.count_if(hard).alias("hard"))


def fall_list(
    cube: DataFrame, axis: str, order: list[str], rates: dict[str, str], scope: str | None = None, weight: str = "n", tolerance: float = 2.0, least: int = 100
) -> DataFrame:
    """component, scope, axis, lower_band, higher_band, lower_rate, higher_rate, fall_pct, hard: every fall of a component's weighted rate.

    rates: component -> its rate column. All components come from one aggregation by scope and band; falls are told apart as in `falls`.
    """
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(axis))
    key = F.col(scope) if scope else F.lit("all")
    means = [F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(f"_r_{name}") for name, c in rates.items()]
    bands = cube.where(place > 0).groupBy(key.alias("scope"), F.col(axis).alias("_band"), place.alias("_place")).agg(F.sum(weight).alias("_n"), *means)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("component"), F.col(f"_r_{name}").alias("rate")) for name in rates]))
    up = Window.partitionBy("scope", "component").orderBy("_place")  # as many rows as there are bands
    steps = bands.select("scope", "_band", "_place", "_n", each.alias("_c")).select("scope", "_band", "_place", "_n", "_c.*")
    steps = steps.select(
        "component", "scope", F.lit(axis).alias("axis"), F.lag("_band").over(up).alias("lower_band"), F.col("_band").alias("higher_band"),
        F.lag("rate").over(up).alias("lower_rate"), F.col("rate").alias("higher_rate"), F.least("_n", F.lag("_n").over(up)).alias("_least"),
    )
    fall = 100 * F.try_divide(F.col("lower_rate") - F.col("higher_rate"), F.col("lower_rate"))
    found = steps.withColumn("fall_pct", fall).where("fall_pct > 0")
    return found.withColumn("hard", (F.col("fall_pct") > tolerance) & (F.col("_least") >= least)).drop("_least")


def trend_votes(cube: DataFrame, entity: str, axis: str, midpoints: dict[str, float], rate: str, more_than: int = 3, cut: float = 0.1) -> DataFrame:
    """trend, models: how entities with more than so many cells vote, by the correlation of the axis' midpoints with the rate."""
    middle = F.try_element_at(F.create_map(*[F.lit(x) for p in midpoints.items() for x in p]), F.col(axis))
    found = cube.withColumn("_m", middle).where("_m is not null").groupBy(entity).agg(
        F.corr("_m", rate).alias("_r"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > more_than)
    return found.groupBy(
        F.when(F.col("_r") > cut, "rising").when(F.col("_r") < -cut, "falling").otherwise("flat").alias("trend")
    ).agg(F.count(F.lit(1)).alias("models"))


def risk_categories(scored: DataFrame, score: str, label: str, amber: float = 0.10, red: float = 0.40) -> DataFrame:
    """category, n, share, lift of GREEN, AMBER and RED scores."""
    category = F.when(F.col(score) < amber, "GREEN").when(F.col(score) < red, "AMBER").otherwise("RED")
    by = scored.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("_y"), F.count(label).alias("_m"))
    total = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  # over three rows
    lift = F.try_divide(F.try_divide("_y", "_m"), F.try_divide(total("_y"), total("_m")))
    return by.select("category", "n", F.round(F.col("n") / total("n"), 6).alias("share"), F.round(lift, 6).alias("lift"))


def golden_diff(current: DataFrame, golden: DataFrame, rate: str, tolerance: float = 0.01) -> DataFrame:
    """One row: shapes of two tables and whether they are equal, means of a rate, their difference and whether it is within the tolerance."""
    side = lambda df, s: df.agg(F.count(F.lit(1)).alias(f"rows_{s}"), F.lit(len(df.columns)).alias(f"columns_{s}"), F.avg(rate).alias(f"_mean_{s}"))
    both = side(current, "now").join(F.broadcast(side(golden, "golden")))  # one row each
    diff = F.abs(F.col("_mean_now") - F.col("_mean_golden"))
    same = (F.col("rows_now") == F.col("rows_golden")) & (F.col("columns_now") == F.col("columns_golden"))
    means = [F.round(f"_mean_{s}", 9).alias(f"mean_{s}") for s in ("now", "golden")]
    return both.select(
        "rows_now",
        "rows_golden",
        "columns_now",
        "columns_golden",
        same.alias("same_shape"),
        *means,
        F.round(diff, 9).alias("diff"),
        (diff <= tolerance).alias("ok"),
    )


def schema_check(rows: DataFrame, required: list[str], numbers: list[str], prefix: str) -> DataFrame:
    """name, present, numeric of the required columns and of all that begin with the prefix; numeric is null for columns that may be text."""
    types = {f.name: isinstance(f.dataType, T.NumericType) for f in rows.schema.fields}
    names = required + [c for c in rows.columns if c.startswith(prefix) and c not in required]
    found = [(c, c in types, types.get(c, False) if c in numbers or c.startswith(prefix) else None) for c in names]
    return rows.sparkSession.createDataFrame(found, "name string, present boolean, numeric boolean")
