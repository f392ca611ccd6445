"""Bands, scores, costs, dates and nested values as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges, labels, costs and weights that results depend on.
AGE_BANDS = [(3, "0-2"), (6, "3-5"), (11, "6-10"), (16, "11-15")]
MILEAGE_BANDS = [(30_000, "0-30k"), (60_000, "30k-60k"), (100_000, "60k-100k")]
SERVING_AGE_BANDS = [(3, "0-3"), (5, "3-5"), (10, "6-10"), (15, "11-15")]
AGE_KEYS = {
    "0-2": ["0-2", "0-1", "1-2", "2-3", "0-3"],
    "3-5": ["3-5", "3-4", "4-5"],
    "6-10": ["6-10", "5-6", "6-7", "7-8", "8-9", "9-10", "5-10"],
    "11-15": ["11-15", "10-11", "11-12", "12-13", "13-14", "14-15", "10-15"],
}
GAP_BANDS = [(300, "early"), (365, "on_time"), (400, "slightly_late"), (500, "late")]
USAGE_BANDS = [(5_000, "low"), (10_000, "average"), (15_000, "high")]
Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
TYPICAL_COSTS = {"brakes": 180, "suspension": 350, "tyres": 100, "steering": 250, "visibility": 60, "lamps": 80, "body": 450}
COST_RANGES = {
    "brakes": (80, 350),
    "suspension": (150, 600),
    "tyres": (60, 200),
    "steering": (100, 500),
    "visibility": (20, 150),
    "lamps": (30, 200),
    "body": (200, 1000),
}
MIDPOINT_COSTS = {"brakes": 200, "suspension": 350, "tyres": 150, "steering": 300, "visibility": 80, "lamps": 60, "body": 400}
BASE_RISKS = {"brakes": 0.05, "suspension": 0.04, "tyres": 0.03, "steering": 0.02, "visibility": 0.02, "lamps": 0.03, "body": 0.02}
NEGLECT_WEIGHTS = {"brakes": (0.19, 0.55, -0.02), "tyres": (0.20, 0.35, -0.03), "suspension": (0.36, 0.53, 0.06)}
AVERAGE_FAIL_RATE = 0.28
EARTH_MILES = 3959.0
PLATT_A, PLATT_B = 6.781078410783767, -3.0256923848070487
COMPONENTS = list(TYPICAL_COSTS)


def below(value: Column, edges: list[tuple[float, str]], last: str, closed: bool = False) -> Column:
    """The label of the first edge that the value is under (or at, if closed), else the last label."""
    return reduce(lambda rest, e: F.when(value <= e[0] if closed else value < e[0], F.lit(e[1])).otherwise(rest), reversed(edges), F.lit(last))


def age_band(age: Column) -> Column:
    return F.when(age.isNull() | F.isnan(age.cast("double")) | (age < 0), "Unknown").otherwise(below(age, AGE_BANDS, "15+"))


def mileage_band(miles: Column) -> Column:
    return F.when(
        miles.isNull() | F.isnan(miles.cast("double")) | (miles < 0) | (miles > 500_000), "Unknown"
    ).otherwise(below(miles, MILEAGE_BANDS, "100k+"))


def serving_age_band(age: Column) -> Column:
    return below(age, SERVING_AGE_BANDS, "15+", closed=True)


def tests_band(n_prior: Column) -> Column:
    """The age band that the number of earlier tests stands for (right-closed bins)."""
    return below(F.coalesce(n_prior, F.lit(0)), [(0, "0-2"), (2, "3-5"), (5, "6-10"), (10, "11-15")], "15+", closed=True)


def closed_mileage_band(miles: Column) -> Column:
    return below(F.coalesce(miles, F.lit(50_000)), MILEAGE_BANDS, "100k+", closed=True)


def age_key(band: Column) -> Column:
    """Finer age bands as the keys of the priors."""
    key = F.lit("15+")
    for name, members in reversed(AGE_KEYS.items()):
        key = F.when(band.isin(members), F.lit(name)).otherwise(key)
    return F.when(band.isNull() | (band == "UNKNOWN"), "Unknown").otherwise(key)


def gap_band(days: Column) -> Column:
    return below(days, GAP_BANDS, "very_late")


def usage_band(annual: Column) -> Column:
    return below(annual, USAGE_BANDS, "very_high")


def confidence_class(n: Column) -> Column:
    return F.when(n >= 1000, "High").when(n >= 100, "Medium").when(n >= 20, "Low").otherwise("Very Low")


def negligence(advisories: Column, tests: Column) -> tuple[Column, Column]:
    """Advisories for each test, at most 1 and 0 without tests, and its band."""
    ratio = F.least(F.coalesce(F.try_divide(advisories.cast("double"), tests.cast("double")), F.lit(0.0)), F.lit(1.0))
    return ratio, F.when(ratio <= 0, "clean").when(ratio < 0.3, "low").when(ratio < 0.6, "high").otherwise("chronic")


def cut_class(value: Column, high: float, medium: float, names: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    return F.when(value >= high, names[0]).when(value >= medium, names[1]).otherwise(names[2])


def verdict(p: Column) -> Column:
    return below(p, [(0.15, "Good reliability"), (0.30, "Moderate reliability"), (0.45, "Below average reliability")], "High risk vehicle")


def decay(counts: dict[str, Column], step: float = 0.2) -> tuple[Column, Column]:
    """Decay index (0.2 for each advisory, at most 1, of the worst system) and that system's name, the first of equal ones; CLEAN at 0."""
    parts = {name: F.least(step * c, F.lit(1.0)) for name, c in counts.items()}
    top = F.greatest(*parts.values())
    return top, F.when(top <= 0, "CLEAN").otherwise(first_argmax(parts))


def mechanisms(counts: dict[str, Column], tests: Column) -> tuple[Column, Column]:
    """How many mechanisms occur, and the most frequent one's name (the first of equal ones); CLEAN without any, NO_HISTORY without tests."""
    kinds = reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in counts.values()])
    named = {name.upper(): c.cast("double") for name, c in counts.items()}
    return kinds, F.when(kinds > 0, first_argmax(named)).when(tests > 0, "CLEAN").otherwise("NO_HISTORY")


def recommendation(p: Column, days_left: Column, expired: Column, has_cost: Column) -> Column:
    """struct(primary, secondary, card)."""
    primary = F.when(p >= 0.5, "GET_QUOTES").when(p >= 0.3, "PRE_MOT_CHECK").when(
        expired | F.coalesce(days_left <= 30, F.lit(False)), "BOOK_MOT"
    ).otherwise("SET_REMINDER")
    secondary = F.when(primary.isin("GET_QUOTES", "PRE_MOT_CHECK"), "SET_REMINDER").when(primary == "BOOK_MOT", "GET_QUOTES").otherwise("FIND_GARAGE")
    card = F.when(
        has_cost & primary.isin("GET_QUOTES", "PRE_MOT_CHECK"), "COST_ESTIMATE"
    ).when(expired | F.coalesce(days_left <= 90, F.lit(False)), "MOT_COUNTDOWN").otherwise("REMINDER_PITCH")
    return F.struct(primary.alias("primary"), secondary.alias("secondary"), card.alias("card"))


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, (0, 1) without trials."""
    z = Z_SCORES[confidence]
    p, n = F.try_divide(k.cast("double"), n.cast("double")), n.cast("double")
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    margin = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n)) / scale
    return F.coalesce(F.greatest(F.lit(0.0), centre - margin), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + margin), F.lit(1.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(value.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return EARTH_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def tens(value: Column) -> Column:
    """To the nearest 10, halves to even."""
    return (F.bround(value / 10) * 10).cast("long")


def expected_cost(risks: dict[str, Column], p_fail: Column) -> Column:
    """struct(cost_min, cost_mid, cost_max) given a failure; null without positive risks."""
    per_test = reduce(lambda a, b: a + b, [F.when(r > 0, r * TYPICAL_COSTS[c]).otherwise(0.0) for c, r in risks.items()])
    mid = F.try_divide(per_test, p_fail)
    low, high = F.greatest(0.6 * mid, F.lit(150.0)), 1.7 * mid
    return F.when((p_fail > 0) & (per_test > 0), F.struct(tens(low).alias("cost_min"), tens(mid).alias("cost_mid"), tens(high).alias("cost_max")))


def scaled_cost(risks: dict[str, Column], p_fail: Column) -> Column:
    """struct(expected, range_low, range_high), scaled by the failure risk over the average one."""
    total = reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) * MIDPOINT_COSTS[c] for c, r in risks.items()])
    total = total * F.when(p_fail > 0, F.greatest(F.lit(0.5), F.least(F.lit(3.0), p_fail / AVERAGE_FAIL_RATE))).otherwise(1.0)
    total = F.greatest(total, F.lit(100.0))
    return F.struct(tens(total).alias("expected"), tens(F.greatest(total * 0.5, F.lit(50.0))).alias("range_low"), tens(total * 2).alias("range_high"))


def component_costs(component: Column, age: Column) -> Column:
    """struct(cost_min, cost_max, typical, age_adjusted) of a component, 15 % more from ten years on; null for an unknown one."""
    table = {c: (*COST_RANGES[c], TYPICAL_COSTS[c]) for c in COMPONENTS}
    old = F.coalesce(age >= 10, F.lit(False))

    def cost(i: int) -> Column:
        base = F.try_element_at(F.create_map(*[F.lit(x) for c, costs in table.items() for x in (c, costs[i])]), component)
        return F.when(old, F.bround(base * 1.15)).otherwise(base).cast("long")

    known = component.isin(list(table))
    return F.when(known, F.struct(cost(0).alias("cost_min"), cost(1).alias("cost_max"), cost(2).alias("typical"), old.alias("age_adjusted")))


def component_risks(p: Column, advisories: dict[str, Column], decay: dict[str, Column], prior_failure: dict[str, Column]) -> dict[str, Column]:
    """Base risk times history multiplier times risk ratio, within 0.01 and 0.5."""
    out = {}
    for name, base in BASE_RISKS.items():
        multiplier = F.lit(1.0)
        if name in advisories:
            multiplier = multiplier + 0.5 * F.least(F.greatest(advisories[name], F.lit(0)), F.lit(3))
        if name in decay:
            multiplier = multiplier + 2 * decay[name]
        if name in prior_failure:
            multiplier = multiplier + F.when(prior_failure[name] == 1, 1.0).otherwise(0.0)
        out[name] = F.round(F.least(F.greatest(base * multiplier * p / AVERAGE_FAIL_RATE, F.lit(0.01)), F.lit(0.5)), 4)
    return out


def data_confidence(has_mileage: Column, n_prior: Column, days_since: Column) -> Column:
    points = 2 * has_mileage + F.when(n_prior > 0, 2).otherwise(0) + F.when(n_prior >= 3, 1).otherwise(0) + F.when(
        F.coalesce(days_since, F.lit(999)) < 400, 1
    ).otherwise(0)
    return cut_class(points, 5, 3, ("High", "Medium", "Low"))


def platt(raw: Column, a: float = PLATT_A, b: float = PLATT_B) -> Column:
    clipped = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), raw))
    return 1 / (1 + F.exp(-(a * clipped + b)))


def debt_score(brakes: Column, suspension: Column, steering: Column, tyres: Column, trend: Column, days_since: Column, annual: Column) -> Column:
    """Maintenance debt: weighted log advisories, raised while a trend persists or worsens, times a usage factor of 1 or more."""
    worse, same = (F.coalesce((F.upper(trend) == v).cast("int"), F.lit(0)) for v in ("WORSENING", "STABLE"))
    raised = 1 + 0.5 * (same + worse) + worse
    domains = 1.3 * F.log1p(suspension + steering) + 1.2 * F.log1p(brakes) + F.log1p(tyres)
    usage = 1 + 0.7 * F.log1p(F.coalesce(annual, F.lit(8000)) / 5000) + 0.3 * F.log1p(F.coalesce(days_since, F.lit(730)) / 30)
    return F.greatest(usage, F.lit(1.0)) * domains * raised


def first_argmax(columns: dict[str, Column]) -> Column:
    """Name of the largest column, the first of equal ones; nulls count as 0."""
    pairs = [F.struct(F.coalesce(c, F.lit(0.0)).alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(columns.items())]
    return F.array_max(F.array(*pairs))["n"]


def top_components(columns: dict[str, Column], k: int) -> Column:
    """Names of the k largest columns, the first of equal ones first."""
    pairs = [F.struct((-F.coalesce(c, F.lit(0.0))).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(columns.items())]
    return F.transform(F.slice(F.array_sort(F.array(*pairs)), 1, k), lambda p: p["n"])


def map_or(table: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(table, key), default)


def tolerant_date(text: Column) -> Column:
    """First ten characters, dots as hyphens; null if that is no date."""
    return F.try_to_timestamp(F.replace(F.substring(text, 1, 10), F.lit("."), F.lit("-")), F.lit("yyyy-MM-dd")).cast("date")
