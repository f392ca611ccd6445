"""The feature table of nested histories against plain Python over dictionaries."""

import datetime
import math

import pytest

from roadlens import registry
from roadlens.operators import features as FE
from roadlens.operators import relational as O
from roadlens.plans.base import Tables
from roadlens.plans.flows import nested_histories

registry.load()
WORDS = {
    "brakes": ["brake", "braking", "disc", "pad", "caliper", "abs"], "suspension": [
        "suspension", "shock", "absorber", "spring", "wishbone", "arm", "bush", "bearing"
    ],
    "steering": [
        "steering", "rack", "tie rod", "track rod", "ball joint", "power steering"
    ], "tyres": ["tyre", "tire", "wheel", "rim"], "structure": ["chassis", "subframe", "sill", "floor", "structural", "body"],
}
SIGNS = {
    "corrosion": [
        "corroded", "corrosion", "rust", "rusted", "oxidation", "pitting"
    ], "wear": ["worn", "wear", "excessive wear", "deteriorated", "perished"],
    "leak": ["leak", "leaking", "fluid", "oil", "hydraulic"], "damage": ["damaged", "cracked", "broken", "fractured", "bent", "distorted"],
}


def part_of(text):
    return next((c for c, words in WORDS.items() if any(w in text.lower() for w in words)), None)


def plain(v, today, rates):
    tests = sorted(v["tests"] or [], key=lambda t: t["test_date"], reverse=True)
    n, out = len(tests), {"make": v["make"]}
    when = tests[0]["test_date"] if tests else today
    out |= {"test_month": str(when.month), "is_winter_test": int(when.month in (10, 11, 12, 1, 2, 3)), "day_of_week": str(when.weekday())}
    out["prev_cycle_outcome_band"] = {"PASSED": "pass", "FAILED": "fail"}.get(tests[0]["result"], "unknown") if tests else "first_test"
    gap = (tests[0]["test_date"] - tests[1]["test_date"]).days if n > 1 else 0
    out["days_since_last_test"] = gap
    out["gap_band"] = next(
        (name for edge, name in ((300, "early"), (365, "on_time"), (400, "slightly_late"), (500, "late")) if gap < edge), "very_late"
    ) if n > 1 else "first_test"
    mile = lambda x, unit: round(x * 0.621371) if (unit or "mi").lower() == "km" else x
    out |= {"test_mileage": 0, "has_prev_mileage": 0, "mileage_plausible_flag": 0, "mileage_anomaly_flag": 0}
    if tests and tests[0]["odometer"] is not None:
        now, odd = mile(tests[0]["odometer"], tests[0]["unit"]), False
        if n > 1 and tests[1]["odometer"] is not None:
            before = mile(tests[1]["odometer"], tests[0]["unit"])
            if gap > 0 and now > before and (now - before) / gap * 365 > 50000:
                odd, now = True, before
        out |= {"test_mileage": now, "has_prev_mileage": 1, "mileage_plausible_flag": int(not odd), "mileage_anomaly_flag": int(odd)}
    advisories = [
        (i, d["text"] or d["type"] or "") for i, t in enumerate(tests) for d in t["defects"] or [] if "advisory" in f"{d['text']} {d['type']}".lower()
    ]
    by_part = {c: [i for i, text in advisories if part_of(text) == c] for c in WORDS}
    out["prev_count_advisory"] = out["raw_behavioral_count"] = len(advisories)
    a, b = (sum(i == k for i, _ in advisories) for k in (0, 1))
    out["advisory_trend"] = "unknown" if n < 2 else "increasing" if a > b else "decreasing" if a < b else "stable"
    out |= {f"prev_adv_{c}": len(by_part[c]) for c in ("brakes", "suspension", "steering", "tyres")}
    out["multi_system_advisory_count"] = sum(bool(x) for x in by_part.values())
    failed = [t for t in tests if t["result"] == "FAILED"]
    broken = {c: [i for i, t in enumerate(tests) if t["result"] == "FAILED" and any("fail" in f"{d['text']} {d['type']}".lower() and part_of(d["text"] or "") == c for d in t["defects"] or [])] for c in ("brakes", "tyres", "suspension")}

    def streak(hits):
        return next((i for i in range(n) if i not in hits), n)

    for c in ("brakes", "tyres", "suspension"):
        hits, bad = set(by_part[c]), set(broken[c])
        out |= {
            f"has_prior_advisory_{c}": int(bool(hits)), f"tests_since_last_advisory_{c}": min(hits, default=999), f"advisory_streak_len_{c}": streak(hits)
        }
        out |= {f"advisory_in_last_1_{c}": int(0 in hits), f"advisory_in_last_2_{c}": int(bool(hits & {0, 1}))}
        out |= {
            f"has_prior_failure_{c}": int(bool(bad)),
            f"has_ever_failed_{c}": int(bool(bad)),
            f"failure_streak_len_{c}": streak(bad),
            f"tests_since_last_failure_{c}": min(bad, default=999),
        }
    for c in ("tyres", "suspension"):
        out[f"miles_since_last_advisory_{c}"] = min(
            8000, out["test_mileage"] // max(n, 1)
        ) if by_part[c] and out["has_prev_mileage"] and out["test_mileage"] > 0 else 0
    recent = lambda days: sum((today - t["test_date"]).days <= days for t in failed)
    out |= {
        "n_prior_fails": len(failed),
        "n_prior_tests": n,
        "prior_fail_rate_smoothed": len(failed) / n if n else 0,
        "fails_last_365d": recent(365),
        "fails_last_730d": recent(730),
        "recent_fail_intensity": recent(365),
    }
    out["fail_rate_trend"] = sum(t["result"] == "FAILED" for t in tests[:2]) - sum(t["result"] == "FAILED" for t in tests[2:4]) if n >= 4 else 0
    signs = {m: sum(any(w in text.lower() for w in words) for _, text in advisories) for m, words in SIGNS.items()}
    for m, count in signs.items():
        out |= {f"text_{m}_index": count, f"text_{m}_index_log": math.log1p(count), f"has_{m}_history": int(count > 0)}
    out["mechanism_count"] = sum(x > 0 for x in signs.values())
    out["dominant_mechanism"] = max(signs, key=signs.get).upper() if out["mechanism_count"] else "CLEAN" if n else "NO_HISTORY"
    out |= {
        "has_advisory_history": int(bool(advisories)),
        "max_severity_score": 2 if failed else int(bool(advisories)),
        "severity_escalation_flag": int(out["fail_rate_trend"] > 0),
    }
    decay = {
        label: min(0.2 * len(by_part[c]), 1.0) for label, c in (("BRAKE", "brakes"), ("SUSP", "suspension"), ("STEER", "steering"), ("STRUCT", "structure"))
    }
    out |= {
        "mech_decay_brake": decay["BRAKE"],
        "mech_decay_suspension": decay["SUSP"],
        "mech_decay_structure": decay["STRUCT"],
        "mech_decay_steering": decay["STEER"],
    }
    out["mech_decay_index"] = out["mech_decay_index_normalized"] = max(decay.values())
    out["mech_risk_driver"] = max(decay, key=decay.get) if out["mech_decay_index"] else "CLEAN"
    letters = "".join(c for c in v["postcode"].strip().upper().replace(" ", "")[:2])
    area = letters if letters.isalpha() and len(letters) == 2 else letters[:1] if letters[:1].isalpha() else None
    out["local_corrosion_index"] = {"SW": 0.4, "M": 0.6}.get(area, 0.5)
    out["local_corrosion_delta"] = out["local_corrosion_index"] - 0.5
    out |= {"station_strictness_bias": 0, "station_fail_rate_smoothed": 0.25, "station_x_prev_outcome_fail_rate": 0.25, "suspension_risk_profile": 0}
    out |= {"annualized_mileage_v2": 10000, "usage_band_hybrid": "average"}
    if n > 1 and out["has_prev_mileage"] and not out[
        "mileage_anomaly_flag"
    ] and tests[1]["odometer"] is not None and gap > 0 and tests[0]["odometer"] > tests[1]["odometer"]:
        use = (tests[0]["odometer"] - tests[1]["odometer"]) / gap * 365
        out |= {
            "annualized_mileage_v2": use, "usage_band_hybrid": "low" if use < 5000 else "average" if use < 10000 else "high" if use < 15000 else "very_high"
        }
    out["days_late"] = max(0, (today - tests[0]["expiry"]).days) if tests and tests[0]["expiry"] else 0
    model = f"{v['make']} {v['model']}" if v["model"] else v["make"]
    out |= {
        "mileage_cohort_ratio": 1.0,
        "advisory_cohort_delta": 0.0,
        "days_since_pass_ratio": gap / 365,
        "make_fail_rate_smoothed": 0.28,
        "model_fail_rate_smoothed": rates.get(model, 0.28),
    }
    out |= dict.fromkeys(("model_age_fail_rate_eb", "make_age_fail_rate_eb", "eb_unified_prior", "segment_fail_rate_smoothed"), 0.28)
    out["front_end_advisory_intensity"] = len(by_part["steering"]) + len(by_part["suspension"]) + len(by_part["tyres"])
    out["brake_system_stress"] = len(by_part["brakes"]) + math.log1p(n) / 3
    out["commercial_wear_proxy"] = math.log1p(out["annualized_mileage_v2"] / 10000) + max(0, gap - 365) / 365 + math.log1p(n) / 3
    out["mdps_score"] = out["days_late"] / 365
    ratio = out["historic_negligence_ratio_smoothed"] = min(len(advisories) / n, 1.0) if n else 0.0
    out["negligence_band"] = "clean" if ratio == 0 else "low" if ratio < 0.3 else "high" if ratio < 0.6 else "chronic"
    out["high_risk_model_flag"] = int(model.upper().strip() == "PEUGEOT 307")
    return out


def test_features_equal_plain_python(spark, folder):
    tables, today = Tables(spark, folder), datetime.date(2024, 2, 1)
    histories = {r.vehicle_id: r.asDict(recursive=True) for r in nested_histories(tables).collect()}
    failed = {}
    for r in tables.history().select("vehicle_id", "failed").collect():
        failed.setdefault(r.vehicle_id % 7, []).append(r.failed)
    from roadlens.plans.base import MODELS

    rates = {MODELS[k % len(MODELS)]: sum(x) / len(x) for k, x in failed.items()}
    got = registry.QUERIES["udf05_history_features"](spark, folder)
    assert got.columns == ["vehicle_id", *FE.FEATURE_NAMES] and len(FE.FEATURE_NAMES) == 104
    assert O.contract_problems(got.drop("vehicle_id"), FE.FEATURE_NAMES) == [] and O.select_contract(got, FE.FEATURE_NAMES, extra=["vehicle_id"]).columns == FE.FEATURE_NAMES
    rows = got.collect()
    assert len(rows) == len(histories) and any(not h["tests"] for h in histories.values())
    for r in rows:
        want = plain(histories[r.vehicle_id], today, rates)
        assert set(want) == set(FE.FEATURE_NAMES)
        for name in FE.FEATURE_NAMES:
            assert r[name] == (want[name] if isinstance(want[name], str) else pytest.approx(want[name], abs=1e-9)), (r.vehicle_id, name)


def test_features_with_priors(spark):
    schema = f"registration string, make string, model string, postcode string, manufacture_date date, tests {FE.TESTS}"
    day = datetime.date(2023, 5, 1)
    one = {"test_date": day, "result": "PASSED", "odometer": 20000, "unit": "mi", "expiry": None, "defects": None}
    rows = [("A", "FORD", "KA", "N1", datetime.date(2020, 1, 1), [one]), ("B", "SEAT", None, None, None, None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    priors = FE.Priors(
        model=frame([("FORD KA", 0.3)], "model_id string, rate double"), make=frame([("FORD", 0.2), ("SEAT", 0.4)], "make string, rate double"),
        model_age=frame([("FORD KA", "3-5", 0.31)], "model_id string, age_band string, rate double"),
        make_age=frame([("SEAT", "3-5", 0.41)], "make string, age_band string, rate double"),
        segment=frame([("FORD", "3-5", "0-30k", 0.22)], "make string, age_band string, mileage_band string, rate double"), overall_age_rate=0.27,
        cohort=frame([("FORD KA", "3-5", 40000.0, 2.0)], "model_id string, age_band string, mileage double, advisories double"), overall_mileage=50000.0,
        overall_advisories=1.5,
    )
    got = {r.registration: r for r in FE.history_features(frame(rows, schema), "2024-02-01", priors).collect()}
    a, b = got["A"], got["B"]
    assert (
        a.model_fail_rate_smoothed, a.make_fail_rate_smoothed, a.model_age_fail_rate_eb, a.make_age_fail_rate_eb, a.segment_fail_rate_smoothed
    ) == (0.3, 0.2, 0.31, 0.27, 0.22)
    assert (
        b.model_fail_rate_smoothed, b.make_fail_rate_smoothed, b.model_age_fail_rate_eb, b.eb_unified_prior, b.segment_fail_rate_smoothed
    ) == (0.28, 0.4, 0.41, 0.41, 0.4)
    assert (a.mileage_cohort_ratio, a.advisory_cohort_delta, b.mileage_cohort_ratio, b.advisory_cohort_delta) == (0.5, -2.0, 0.0, -1.5)
    assert b.dominant_mechanism == "NO_HISTORY" and b.gap_band == "first_test" and a.n_prior_tests == 1
