"""Row-by-row comparison of a query with its oracle."""

import math

import pandas as pd


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return str(value) if isinstance(value, pd.Timestamp) else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(
        (tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)),
        key=lambda r: [f"{v:.7g}" if isinstance(v, float) else repr(v) for v in r],
    )


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b or str(a) == str(b)


def check(name: str, spark, duck, folder, queries, oracles) -> None:
    got, want = queries[name](spark, folder).toPandas(), duck.execute(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]
