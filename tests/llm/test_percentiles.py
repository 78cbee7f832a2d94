import math
import random

import numpy as np
import pytest
from wardline.llm import percentiles as P

SCHEMA = "g string, day int, v double, n string"


def exact(xs, q):
    xs = sorted(xs)
    return xs[math.floor(q * (len(xs) - 1))]


def test_error_bound_and_merging(spark):
    r = random.Random(1)
    rows = [(g, r.randrange(5), r.choice([-1, 1, 1]) * math.exp(r.gauss(0, 4)), "clash") for g in ("a", "b") for _ in range(800)] + [("a", 1, 0.0, "clash")] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    daily = P.sketch(df, ["g", "day"], "v", 0.01)
    parts = [P.merge(["g"], daily.filter(f"day = {d}")) for d in range(5)]
    whole = P.quantiles(P.merge(["g"], *parts), ["g"], [0.5, 0.9, 0.99], 0.01)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, P.quantiles(P.sketch(df, ["g"], "v", 0.01), ["g"], [0.5, 0.9, 0.99], 0.01).collect()))
    for row in whole.collect():
        xs = [v for g, _, v, _ in rows if g == row.g]
        assert row.n == len(xs)
        for q, got in ((0.5, row.p50), (0.9, row.p90), (0.99, row.p99)):
            assert abs(got - exact(xs, q)) <= 0.01 * abs(exact(xs, q)) * (1 + 1e-9)


def test_odd_values(spark):
    inf = float("inf")
    rows = [("a", 1, x, "") for x in (inf, -inf, float("nan"), None, 0.0, -0.0, 5e-324, 1.7e308)] + [(None, 1, 2.0, ""), ("b", 1, None, "")]
    got = {r.g: r for r in P.quantiles(P.sketch(spark.createDataFrame(rows, SCHEMA), ["g"], "v"), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {"a", None}
    assert got["a"].n == 6 and got["a"].p0 == -inf and got["a"].p100 == inf and got["a"].p50 == 0.0
    assert got[None].p50 == pytest.approx(2.0, rel=0.01)


def test_empty(spark):
    assert P.quantiles(P.sketch(spark.createDataFrame([], SCHEMA), ["g"], "v"), ["g"], [0.5]).collect() == []
    with pytest.raises(ValueError):
        P.gamma(0.0)


def test_ties_and_bucket_edges(spark):
    g = P.gamma(0.01)
    xs = [g**i for i in range(1, 40)] + [7.0] * 100
    got = P.quantiles(P.sketch(spark.createDataFrame([("a", 1, float(x), "") for x in xs], SCHEMA), ["g"], "v"), ["g"], [0.5]).first()
    assert got.p50 == pytest.approx(np.sort(xs)[math.floor(0.5 * (len(xs) - 1))], rel=0.0101)
