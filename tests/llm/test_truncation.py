import random

import numpy as np
from wardline.llm import truncation as T

SCHEMA = "doc_id bigint, text string, lang string, source string, truncated string"
SUBJECTS = ["The patient", "The night nurse", "Cardiology", "The family", "A second sample", "The ventilator"]
VERBS = ["remained comfortable", "was reviewed again", "asked for an update", "showed improvement", "needed no changes", "was repositioned"]
ENDS = ["throughout the evening", "after the morning round", "despite the earlier concern", "without any complication", "before the planned transfer"]


def written(r):
    n = r.randint(4, 12)
    text = " ".join(f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(ENDS)}." for _ in range(n))
    if r.random() < 0.3:
        text += "\n\nPLAN\n" + "\n".join(r.sample(["- Wean support as tolerated", "- Repeat echocardiogram", "- Mobilize to chair"], 2))
    return text


def corpus(seed=1, n=500):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t, source = written(r), r.choice(["a", "b"])
        if source == "b" and len(t) > 300:
            t = t[:300]
            cut.add(i)
        elif r.random() < 0.05:
            t = t[: r.randint(50, len(t) - 20)]
            cut.add(i)
        if r.random() < 0.05 and i not in cut and t.endswith("."):
            t = t[:-1]
        if r.random() < 0.2:
            t += r.choice(["\n\nSigned: AB, RN 10:22", "\n[END OF NOTE]", "\ncc: unit file", "  \n"])
        rows.append((i, t, r.choice(["en", "en", None]), source, "clash"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    got = {r.doc_id for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).filter("truncated").collect()}
    # a cut that falls on the end of a sentence or line can't be told from an end
    hidden = {i for i in cut if T.tail(rows[i][1])[0].endswith(".")}
    assert len(got - cut) <= 2
    assert len(got & cut) >= 0.93 * len(cut - hidden)


def test_edges(spark):
    rows, _ = corpus(2, 200)
    rows += [(900, None, None, None, ""), (901, "", "en", "a", ""), (902, "  \n ", "en", "a", ""), (903, "The patient remained comf�", "en", "a", ""), (903, "The patient remained comf�", "en", "a", ""), (904, "x" * 300_000, None, None, ""), (905, "Der Patient schläft.", "de", "c", "")]
    got = {}
    for r in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r.truncated)
    assert not {900, 901, 902} & set(got)
    assert got[903] == [True, True] and len(got[904]) == 1
    assert T.truncated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rates(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", ""), (2, "b", "en", "s", ""), (3, "c", "en", None, "")], SCHEMA)
    judged = spark.createDataFrame([(1, "en", "s", 3.0, True), (2, "en", "s", -3.0, False)], "doc_id bigint, lang string, source string, log_odds double, truncated boolean")
    assert {r.source: (r.documents, r.truncated, r.rate) for r in T.rates(judged, docs).collect()} == {"s": (2, 1, 0.5), "": (1, 0, 0.0)}


def test_tails():
    assert T.tail("It was cut he\n\nSigned: AB, RN 10:22\n[END OF NOTE]") == ("It was cut he", False, False)
    assert T.tail("It was cut he [more]") == ("It was cut he", False, True)
    assert T.tail("It was cut he...") == ("It was cut he", False, True)
    assert T.tail("Ma�") == ("Ma", True, False)
    assert T.tail("All is well.") == ("All is well.", False, False)


def test_model_counts_against_brute_force(spark):
    rows, _ = corpus(3, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    ends = T._ends(df, "doc_id", "text", frozenset())
    got = {(r.o, r.c): (r.more, r.line, r.stop) for r in T._model(df, "text", T._wanted(ends), frozenset()).collect()}
    texts = [T.tail(t)[0] for _, t, *_ in rows]
    want_cells = {(o, c) for r in ends.collect() for o, c in enumerate(r.cells)}
    want = {}
    for t in texts:
        codes, _ = T.codes_of([t])
        what = T.outcomes(codes)
        for o, c in T.cells(codes):
            for i in range(len(codes)):
                k = (o, int(c[i]))
                if what[i] < 3 and k in want_cells:
                    want.setdefault(k, np.zeros(3, int))[what[i]] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_counts_are_of_the_context_itself(spark):
    # so many contexts that hashes of 22 bits meet; contexts are told apart by their characters here
    r = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x5600)]
    rows = [(i, "".join(r.choices(letters, k=200)), "zh", "a", "") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.o, x.c): (x.more, x.line, x.stop) for x in T._model(df, "text", T._wanted(T._ends(df, "doc_id", "text", frozenset())), frozenset()).collect()}
    texts = [t for _, t, *_ in rows]
    final = {(o, t[-n:]): int(c) for t, cs in zip(texts, T.final_cells(texts)) for (o, n), c in zip(enumerate(T.ORDERS), cs)}
    want = {}
    for t in texts:
        for o, n in enumerate(T.ORDERS):
            for i in range(n, len(t)):
                if (k := (o, t[i - n : i])) in final:
                    want[o, final[k]] = want.get((o, final[k]), 0) + 1
    assert got == {k: (n, 0, 0) for k, n in want.items()}


def test_tally_holds_more_contexts_than_slots(monkeypatch):
    monkeypatch.setattr(T, "SLOTS", 3)
    r = np.random.default_rng(5)
    keys = r.integers(-(2**63), 2**63, 40)
    c, what = keys[r.integers(0, 40, 2000)], r.integers(0, 3, 2000).astype(np.int8)
    tally, got = T.Tally(), {}
    for i in range(0, 2000, 500):
        tally.add(c[i : i + 500], what[i : i + 500])
    for k, n in zip(*[np.concatenate(x) for x in zip(tally.sorted(), tally.slots())]):
        got[int(k)] = got.get(int(k), 0) + n
    assert {k: tuple(v) for k, v in got.items()} == {int(k): tuple(np.bincount(what[c == k], minlength=3)) for k in keys}


def test_packed_and_plain_filters_let_the_same_places_pass():
    r = np.random.default_rng(6)
    f, c = r.random(2**15) < 0.7, r.integers(-(2**63), 2**63, 5000)
    use = r.random(5000) < 0.5
    at = T.passing(f, c, use)
    assert 0 < len(at) < use.sum() and at.tolist() == T.passing(np.packbits(f, bitorder="little"), c, use).tolist()
