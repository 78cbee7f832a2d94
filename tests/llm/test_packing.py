import random

import numpy as np
import pytest
from wardline.llm import packing as P

SCHEMA = "doc_id bigint, n_tokens bigint, container string"


def packed(spark, sizes, capacity=64):
    return P.pack(spark.createDataFrame([(i, n, "clash") for i, n in enumerate(sizes)], SCHEMA), capacity)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_histogram(seed):
    r = np.random.default_rng(seed)
    h = r.integers(0, 40, 65) * (r.random(65) < 0.4)
    got = np.zeros(65, int)
    for count, content in P.patterns(h, 64):
        assert count > 0 and sum(n * m for n, m in content) <= 64
        for n, m in content:
            got[n] += count * m
    assert (got[1:] == h[1:]).all()
    assert len(P.patterns(h * 1_000_000, 64)) <= 2 * 65


def greedy(sizes, capacity):
    """Longest first into the pack with the most room, item by item."""
    packs = []
    for n in sorted(sizes, reverse=True):
        best = min(range(len(packs)), key=lambda i: packs[i], default=None)
        if best is not None and packs[best] + n <= capacity:
            packs[best] += n
        else:
            packs.append(n)
    return len(packs)


@pytest.mark.parametrize("seed", range(3))
def test_as_many_packs_as_item_by_item(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 64) for _ in range(300)]
    assert sum(c for c, _ in P.patterns(np.bincount(sizes, minlength=65), 64)) == greedy(sizes, 64)


def test_containers(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 7)
    r = random.Random(5)
    sizes = [r.choice([0, 3, 3, 3, 20, 40, 64, 65, 200, r.randint(1, 90)]) for _ in range(400)]
    rows = packed(spark, sizes).collect()
    load, by = {}, {}
    for x in rows:
        if x.n_tokens:
            load[x.container] = load.get(x.container, 0) + x.n_tokens
        by.setdefault(x.doc_id, []).append(x)
    assert max(load.values()) <= 64 and set(load) == set(range(len(load)))
    for i, n in enumerate(sizes):
        own = sorted(by[i], key=lambda x: x.piece)
        assert sum(x.n_tokens for x in own) == n
        assert [x.token_from for x in own] == [64 * k for k in range(len(own))]
        assert len(own) == max(1, -(-n // 64))


def test_edges(spark):
    assert packed(spark, []).collect() == []
    assert [(x.doc_id, x.n_tokens, x.container) for x in packed(spark, [None, 0]).collect()] == [(1, 0, 0)]
    f = P.fill(packed(spark, []), 64).first()
    assert (f.items, f.containers, f.tokens, f.used) == (0, 0, 0, None)
    f = P.fill(packed(spark, [64, 32, 32]), 64).first()
    assert (f.items, f.containers, f.tokens, f.used) == (3, 2, 128, 1.0)
    same = spark.createDataFrame([(1, 40, ""), (1, 40, "")], SCHEMA)
    assert sorted(x.container for x in P.pack(same, 64).collect()) == [0, 1]
