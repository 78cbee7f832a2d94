import numpy as np
import pytest
from wardline.operators import vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, similarity string"


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(V, "VECTORS", 40)
        monkeypatch.setattr(V, "QUERIES", 3)
        monkeypatch.setattr(V, "SENT", 0)
    m = np.random.default_rng(1).normal(size=(150, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(m)] + [(900, None, ""), (901, [0.0] * 8, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in V.nearest_many(df, df.filter("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query, []).append((-r.similarity, r.key))
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    assert set(got) == set(range(0, 150, 10))
    for q, found in got.items():
        assert [k for _, k in sorted(found)] == list(np.argsort(-s[q], kind="stable")[:5])


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (2, [2.0, 0.0], "")], SCHEMA)
    assert V.nearest_many(none, none, 3).collect() == [] and V.nearest_many(one, none, 3).collect() == []
    assert [(r.query, r.key) for r in V.nearest_many(one, one.filter("vec_id = 2"), 2).collect()] == [(2, 1), (2, 1)]


def test_an_odd_first_row_takes_nothing_from_the_others(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(0, [1.0, 2.0, 3.0])] + [(i, [float(x) for x in r.normal(size=4)]) for i in range(1, 6)] + [(9, [0.0] * 4), (10, None), (11, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = sorted((x.query, x.key) for x in V.nearest_many(df, df, 3).collect())
    assert len(want) == 15 and {q for q, _ in want} == set(range(1, 6))
    monkeypatch.setattr(V, "SENT", 0)
    assert sorted((x.query, x.key) for x in V.nearest_many(df, df, 3).collect()) == want


def test_the_vectors_are_not_moved(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id bigint, embedding array<double>").repartition(5)
    plan = V.nearest_many(df, df.filter("vec_id < 3"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Explode" not in plan and "Generate" not in plan
