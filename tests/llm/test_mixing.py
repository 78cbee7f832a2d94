import math
import random

import pytest
from wardline.llm import mixing as M

COUNTS = "doc_id bigint, source string, n_tokens bigint, block string"
TARGETS = "source string, target_share double, max_repeats int, share string"


def test_plan_reaches_targets_within_caps():
    tokens, targets, caps = {"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 8}
    p = M.plan(tokens, targets, caps)
    assert p.exponent == 1.0 and p.weights == pytest.approx(targets)
    assert p.total == 400  # c: 80 tokens make a fifth
    q = M.plan(tokens, targets, caps, total=800)
    assert 0 < q.exponent < 1 and all(800 * w <= caps[s] * tokens[s] * (1 + 1e-6) for s, w in q.weights.items())
    assert sum(q.weights.values()) == pytest.approx(1)
    r = M.plan(tokens, targets, caps, total=10**9)
    assert r.total == 1000 + 200 + 80 and {s: round(r.total * w) for s, w in r.weights.items()} == {"a": 1000, "b": 200, "c": 80}


def test_a_small_source_holds_nobody_back():
    tokens, targets = {"a": 6000, "b": 3000, "c": 50}, {"a": 0.5, "b": 0.4, "c": 0.1}
    p = M.plan(tokens, targets, {"a": 1, "b": 1, "c": 4}, total=4000)
    assert 4000 * p.weights["c"] == pytest.approx(200) and 0 < p.exponents["c"] < 1 and p.exponent == p.exponents["c"]
    assert p.exponents["a"] == p.exponents["b"] == 1.0 and p.weights["a"] / p.weights["b"] == pytest.approx(1.25)
    assert M.powered({s: n / 9050 for s, n in tokens.items()}, p.exponent, targets)["c"] == pytest.approx(p.weights["c"])


@pytest.mark.parametrize("seed", range(30))
def test_weights_are_the_nearest_to_the_targets_within_caps(seed):
    r = random.Random(seed)
    tokens = {s: int(10 ** r.uniform(1, 5)) for s in "abcdef"[: r.randint(1, 6)]}
    share = {s: r.random() + 0.01 for s in tokens}
    targets = {s: x / sum(share.values()) for s, x in share.items()}
    caps = {s: r.randint(1, 5) for s in tokens}
    total = max(1, int(r.random() * 1.2 * sum(tokens.values())))
    p = M.plan(tokens, targets, caps, total)
    most = {s: caps[s] * n / p.total for s, n in tokens.items()}
    assert sum(p.weights.values()) == pytest.approx(1) and all(w <= most[s] * (1 + 1e-6) for s, w in p.weights.items())
    # sources below their cap stand to each other as their targets do, those at the cap have less than that
    free = {s for s, w in p.weights.items() if w < most[s] * (1 - 1e-5)}
    level = max((p.weights[s] / targets[s] for s in free), default=0)
    for s in tokens:
        assert p.weights[s] / targets[s] == pytest.approx(level, rel=1e-4) if s in free else not level or p.weights[s] / targets[s] <= level * (1 + 1e-4)


def test_plan_by_entropy():
    tokens = {"a": 900, "b": 90, "c": 10}
    p = M.plan(tokens, None, {s: 1000 for s in tokens}, total=100, target_entropy=0.9)
    assert M.entropy(p.weights) == pytest.approx(0.9, abs=1e-6) and 0 < p.exponent < 1
    assert M.plan(tokens, None, {s: 1000 for s in tokens}, total=100, target_entropy=9.0).weights == pytest.approx({s: 1 / 3 for s in tokens})
    few = M.plan(tokens, None, {"a": 1, "b": 1, "c": 2}, total=500, target_entropy=9.0)
    assert all(500 * w <= {"a": 900, "b": 90, "c": 20}[s] * (1 + 1e-6) for s, w in few.weights.items())


def test_plan_edges():
    assert M.plan({}, {"a": 1.0}).weights == {}
    assert M.plan({"a": 5, "b": 0}, {"a": 0.5, "b": 0.5}).weights == {"a": 1.0}
    assert M.plan({"a": 5}, {"a": 1.0}, {"a": 0}).total == 0


def mixed(spark, rows, targets, **more):
    uses, report = M.mix(spark.createDataFrame([(*r, "clash") for r in rows], COUNTS), spark.createDataFrame([(*t, "clash") for t in targets], TARGETS), **more)
    return uses.collect(), {r.source: r for r in report.collect()}


def test_selection(spark, monkeypatch):
    monkeypatch.setattr(M, "ORDERED", 9)
    r = random.Random(4)
    rows = [(i, s, r.randint(5, 60)) for i, s in enumerate(r.choices(["a", "b", "c", "d", None], [60, 25, 5, 5, 5], k=600))]
    targets = [("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 5), ("gone", 0.0, 1)]
    uses, report = mixed(spark, rows, targets, block_tokens=1500)
    size = {i: n for i, _, n in rows}
    per = {}
    for u in uses:
        assert u.n_tokens == size[u.doc_id] and u.source in "abc"
        per.setdefault(u.doc_id, []).append(getattr(u, "pass"))
    caps = {"a": 1, "b": 2, "c": 5}
    by = {i: s for i, s, _ in rows}
    for i, passes in per.items():
        assert sorted(passes) == list(range(len(passes))) or len(set(passes)) == len(passes)
        assert len(passes) <= caps[by[i]]
    total = sum(u.n_tokens for u in uses)
    for s, share, _ in targets[:3]:
        assert abs(sum(u.n_tokens for u in uses if u.source == s) - report[s].total * share) <= 60
        assert report[s].share == pytest.approx(sum(u.n_tokens for u in uses if u.source == s) / total)
        assert report[s].most_uses == max(len(p) for i, p in per.items() if by[i] == s)
    assert report["gone"].tokens == 0 and report["gone"].share == 0.0
    blocks = {}
    for u in uses:
        blocks.setdefault(u.block, []).append(u)
    assert set(blocks) == set(range(len(blocks))) and len(blocks) > 3
    for b in blocks.values():
        assert abs(sum(u.n_tokens for u in b if u.source == "a") / sum(u.n_tokens for u in b) - 0.4) < 0.12


def test_same_on_every_run_and_whole_sources(spark):
    rows = [(i, "a", 10) for i in range(20)] + [(100, "b", 50)]
    targets = [("a", 0.5, 1), ("b", 0.5, 4)]
    one, report = mixed(spark, rows, targets)
    assert sorted(map(tuple, one)) == sorted(map(tuple, mixed(spark, rows, targets)[0]))
    assert report["b"].tokens == 200 and report["a"].tokens == 200 and report["b"].most_uses == 4


def test_empty(spark):
    uses, report = mixed(spark, [], [("a", 1.0, 1)])
    assert uses == [] and report["a"].share == 0.0
    uses, report = mixed(spark, [(1, "a", 5), (2, None, 5), (3, "a", 0)], [])
    assert uses == [] and report == {}
    uses, report = mixed(spark, [(1, "a", 5), (1, "a", 5), (2, "a", None)], [("a", 1.0, None), (None, 0.3, 1)])
    assert sum(u.n_tokens for u in uses) == 10 and math.isclose(report["a"].share, 1.0)
