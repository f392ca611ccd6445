"""Units that no other equals are not shuffled with what belongs to them; those that others equal are found as by brute force."""

import numpy as np

from roadlens.llm import substring_dedup as S


def test_only_possible_repeats_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)  # digest 0 is broadcast, the others are shuffled
    rng = np.random.default_rng(3)
    digests = rng.integers(-(1 << 63), 1 << 63, (60, 2), dtype=np.int64)
    digests[1, 0] = digests[2, 0]  # equal halves are no repeat
    picks = [0] * 80 + list(range(1, 60)) + list(range(10, 30)) * 2
    rng.shuffle(picks)
    rows = [(k // 4, k % 3, k, k + 1, k, 5, int(digests[d, 0]), int(digests[d, 1])) for k, d in enumerate(map(int, picks))]
    rows += rows[:7]  # a row that stands twice is one document and repeats nothing
    table = spark.createDataFrame(rows, "doc_id long, text_hash long, start int, end int, place int, words int, d1 long, d2 long")
    first = {}
    for r in sorted(rows):
        first.setdefault(r[6:], r[:3])
    found = S.later_units(table)
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[:3] > first[r[6:]])
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [i for i, x in enumerate(plan) if "Aggregate [d1" in x and "d2" in x]
    assert grouped and all(any("found(d1" in x for x in plan[i : i + 8]) for i in grouped)
