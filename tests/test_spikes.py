import datetime as dt

import numpy as np
import pytest
from wardline.operators import spikes
from wardline.operators.series import in_blocks, keyed, medians, starts

EVENT = "event_id bigint, patient_id string, normalized_term string, value double, unit string, source_entity string, day_offset_start int, day_offset_end int, is_active boolean, is_started boolean, is_ended boolean, history boolean, charted_at timestamp, loaded_at timestamp"
UNIT = "term string, unit_code string, factor double, shift double"
REF = "term string, kind string, common_unit string, phys_low double, phys_high double"


def rows_of(values, p="p", term="hr", unit="bpm", begin=0):
    out = []
    for i, v in enumerate(values):
        t = dt.datetime(2025, 1, 1) + dt.timedelta(hours=i)
        out.append((begin + i, p, term, v, unit, "hr", i // 24, i // 24, True, False, False, False, t, t))
    return out


def found(spark, rows, limit=20_000):
    df = spikes.implausible(spark.createDataFrame(rows, EVENT), spark.createDataFrame([("hr", "bpm", 1.0, 0.0), ("gcs", "points", 1.0, 0.0)], UNIT), spark.createDataFrame([("hr", "measurement", "bpm", 10.0, 320.0), ("gcs", "measurement", "points", 3.0, 15.0), ("drug", "medication", None, None, None)], REF), limit)
    return {r.event_id: r.kind for r in df.collect()}


def noise(n, seed=0, level=80.0, sd=4.0):
    return [float(x) for x in np.round(np.random.default_rng(seed).normal(level, sd, n))]


def test_spikes_of_one_and_two_readings(spark):
    v = noise(40)
    v[10], v[20], v[21] = 240.0, 160.0, 163.0
    assert found(spark, rows_of(v)) == {10: "spike", 20: "spike", 21: "spike"}


def test_steps_trends_and_ends_are_no_spikes(spark):
    assert found(spark, rows_of([*noise(20), *noise(20, 1, 140.0)])) == {}
    assert found(spark, rows_of([60 + 2 * i + x - 80 for i, x in enumerate(noise(40, 2))])) == {}
    v = noise(30, 3)
    v[0], v[-1] = 200.0, 210.0
    assert found(spark, rows_of(v)) == {}


def test_impossible_values_at_any_length(spark):
    assert found(spark, rows_of([-99.0, 80.0, 9999.0, 320.0, 10.0])) == {0: "impossible", 2: "impossible"}


def test_short_series_have_no_spikes_and_runs(spark):
    assert found(spark, rows_of([80.0, 81.0, 300.0, 79.0, 82.0, 80.0, 81.0])) == {}
    assert found(spark, rows_of([80.0] * 7)) == {}


def test_stuck_runs_but_not_in_steady_terms(spark):
    v = noise(40, 5)
    v[12:18] = [77.0] * 6
    v[11], v[18] = 79.0, 82.0
    assert found(spark, rows_of(v)) == {i: "stuck" for i in range(12, 18)}
    v[17] = 90.0
    assert found(spark, rows_of(v)) == {}
    steady = [12.0] * 9 + [11.0] + [12.0] * 10 + [13.0] * 7
    assert found(spark, rows_of(steady, term="gcs", unit="points") + rows_of(noise(20), begin=100)) == {}


def test_copies_share_the_fate_and_do_not_count(spark):
    v = noise(40, 6)
    v[10] = 250.0
    v[20:25] = [77.0] * 5
    v[19], v[25] = 80.0, 81.0
    rows = rows_of(v)
    copy = lambda i, e: (e, *rows[i][1:-1], rows[i][-1] + dt.timedelta(days=9))
    got = found(spark, rows + [copy(10, 1000), copy(22, 1001), copy(22, 1002)])
    assert got == {10: "spike", 1000: "spike"}


def test_edges(spark):
    assert found(spark, []) == {}
    rows = rows_of([80.0, None, float("nan"), 81.0])
    rows += [(100, None, "hr", 5.0, None, None, None, None, None, None, None, None, None, None), (101, "p", "drug", 5000.0, None, None, 1, 1, True, None, None, None, None, None), (102, "p", None, 5000.0, None, None, 1, 1, True, None, None, None, None, None)]
    assert found(spark, rows) == {100: "impossible"}


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_series_in_blocks(spark, seed):
    v = noise(800, seed)
    at = [37, 101, 102, 250, 399, 400, 555, 700]
    for i in at:
        v[i] = 250.0
    v[600:608] = [80.0] * 8
    assert found(spark, rows_of(v)) == found(spark, rows_of(v), limit=120)


@pytest.fixture(scope="module")
def mixed():
    """One hot series and many short ones, with faults of all kinds, copies, and one reading without any time."""
    r, rows = np.random.default_rng(4), []
    for p in range(40):
        n = 900 if p == 0 else int(r.integers(4, 30))
        v = noise(n, p, float(r.integers(60, 120)), float(r.integers(2, 6)))
        for i in range(5, n - 3, 37):
            v[i] += float(r.choice([-40, 60, 90]))
        if n > 20:
            v[10:17] = [v[9] + 1] * 7
        rows += rows_of(v, f"p{p}", begin=1000 * p)
    rows += [(e + 50_000, *x, late + dt.timedelta(days=3)) for e, *x, late in rows[::11]]
    rows.append((99_999, "p0", "hr", 85.0, "bpm", "hr", None, None, True, False, False, False, None, None))
    return rows


@pytest.fixture(scope="module")
def whole(spark, mixed):
    return found(spark, mixed)


@pytest.mark.parametrize(("partitions", "aqe", "limit"), [(2, "true", 20_000), (64, "false", 20_000), (400, "true", 20_000), (3, "true", 40)])
def test_verdicts_do_not_depend_on_partitions_and_blocks(spark, mixed, whole, partitions, aqe, limit):
    assert {"spike", "stuck"} <= set(whole.values())
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        assert found(spark, mixed, limit) == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_blocks_hold_all_rows_once_and_near_the_limit(spark):
    """Outlying times, one instant of many rows, null keys."""
    rows = [(None, i, 0 if i < 3 else 10**15 + i // 2, i * 7919 % 10_007) for i in range(3000)] + [("b", 5000 + i, 77, i * 1_000_003) for i in range(700)] + [("c", 9000 + i, i, 0) for i in range(50)]
    df, twins = in_blocks(keyed(spark.createDataFrame(rows, "k string, row_id bigint, t bigint, chash bigint"), ["k"]), 100)
    assert not twins
    got = df.collect()
    core = [r for r in got if r.core]
    assert sorted(r.row_id for r in core) == sorted(r[1] for r in rows)
    assert {r.k for r in core if r.hot} == {None, "b"} and {r.block for r in core if r.k == "c"} == {0}
    for k in (None, "b"):
        mine = sorted((r.t, r.chash >> 2, r.block) for r in core if r.k == k)
        assert [b for *_, b in mine] == sorted(b for *_, b in mine)
        size = np.bincount([b for *_, b in mine])
        assert size.min() >= 70 and size.max() <= 230
        for b in range(1, len(size)):
            seen = [r for r in got if r.k == k and not r.core and r.block == b]
            assert sum((r.t, r.chash >> 2) < min(x[:2] for x in mine if x[2] == b) for r in seen) >= 64


def test_more_copies_than_fit_into_a_block(spark):
    v = noise(150, 9)
    v[40], v[90] = 250.0, 9999.0
    rows = rows_of(v)
    rows += [(1000 + 100 * j + i, *rows[j][1:]) for j in (40, 60, 90) for i in range(70)]
    want = {40: "spike", 90: "impossible"} | {1000 + 100 * j + i: k for j, k in ((40, "spike"), (90, "impossible")) for i in range(70)}
    assert found(spark, rows, 50) == want == found(spark, rows)


def test_medians_and_starts():
    seg = np.array([0, 0, 0, 1, 1, 3])
    m, n = medians(seg, np.array([3.0, 1.0, np.nan, 5.0, 7.0, 2.0]), 4)
    assert m[0] == 2 and m[1] == 6 and np.isnan(m[2]) and m[3] == 2 and list(n) == [2, 2, 0, 1]
    assert list(starts(np.array([1, 1, 2]), np.array([5, 6, 6]))) == [0, 1, 2]


def test_search_goes_on_until_nothing_is_left():
    for seed in range(12):
        r = np.random.default_rng(seed)
        y = r.normal(0, 1, 1000) + np.where(r.random(1000) < 0.7, np.exp(np.abs(r.normal(0, 4, 1000))), 0)
        of, n = np.zeros(1000, int), np.array([1000])
        found, _ = spikes.Faults().candidates(of, y, n, np.zeros(1000, bool))
        assert (spikes.Faults().candidates(of, y, n, found)[0] == found).all()
