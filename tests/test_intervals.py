import random

import pytest
from wardline.operators.intervals import coverage, usable

SCHEMA = "patient_id string, normalized_term string, a int, b int, stretch string"


def brute(rows):
    """Days covered, one by one."""
    out = set()
    by = {}
    for p, t, a, b in rows:
        if a is None and b is None:
            continue
        a, b = (b if a is None else a), (a if b is None else b)
        by.setdefault((p, t), set()).update(range(min(a, b), max(a, b) + 1))
    for k, days in by.items():
        days = sorted(days)
        start = days[0]
        for x, y in zip(days, [*days[1:], None]):
            if y != x + 1:
                out.add((*k, "period", start, x))
                if y is not None:
                    out.add((*k, "gap", x + 1, y - 1))
                    start = y
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)
    return {tuple(r) for r in coverage(df, ["patient_id", "normalized_term"], "a", "b").collect()}


def test_merges_nested_adjacent_and_swapped(spark):
    rows = [("p", "x", 1, 3), ("p", "x", 2, 2), ("p", "x", 4, 5), ("p", "x", 9, 8), ("p", "x", None, 12), ("p", "x", None, None), ("p", "x", 1, 3)]
    assert got(spark, rows) == {("p", "x", "period", 1, 5), ("p", "x", "gap", 6, 7), ("p", "x", "period", 8, 9), ("p", "x", "gap", 10, 11), ("p", "x", "period", 12, 12)}


def test_empty_and_null_keys(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, None, 1, 2), (None, None, 4, 4)]) == {(None, None, "period", 1, 2), (None, None, "gap", 3, 3), (None, None, "period", 4, 4)}


@pytest.mark.parametrize("seed", range(4))
def test_against_days_one_by_one(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, *range(-5, 30)])
    rows = [(r.choice(["p", "q"]), r.choice(["x", "y", None]), day(), day()) for _ in range(r.choice([3, 40]))]
    assert got(spark, rows) == brute(rows)


def test_usable_rows(spark):
    ev = spark.createDataFrame(
        [(1, "drug", True, None, 1, None), (2, "drug", None, False, 1, 1), (3, "drug", True, True, 1, 1), (4, "lab", True, False, 1, 1), (5, None, True, False, 1, 1), (6, "drug", True, False, None, None)],
        "event_id int, normalized_term string, is_active boolean, history boolean, day_offset_start int, day_offset_end int",
    )
    ref = spark.createDataFrame([("drug", "medication"), ("drug", "medication"), ("lab", "measurement")], "term string, kind string")
    assert [r.event_id for r in usable(ev, ref).collect()] == [1]
