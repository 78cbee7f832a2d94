import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from wardline.operators import text as T

SPAN = "array<struct<id:string,start:int,end:int,label:string,confidence:double,text:string>>"


def test_tokens(spark):
    texts = {1: "  two  words\n", 2: "", 3: None, 4: "one", 5: "é ñ x\r\ny", 6: " \n "}
    rows = T.tokens(spark.createDataFrame(list(texts.items()), "k int, text string"), "k").orderBy("k", "i").collect()
    want = [(k, i, m.start(), m.end(), m.group()) for k, t in texts.items() if t for i, m in enumerate(re.finditer(r"\S+", t))]
    assert [tuple(r) for r in rows] == want


@pytest.mark.parametrize("n", [0, 1, 100, 512, 513, 896, 897, 1000])
def test_windows(spark, n):
    got = [(r.chunk, r.first, r.last) for r in T.chunks(spark.createDataFrame([(1, n)], "k int, n int")).orderBy("chunk").collect()]
    want, start = [], 0
    while start < n:
        end = min(start + 512, n)
        want.append((len(want), start, end))
        if end == n:
            break
        start += 384
    assert got == want


def bio(tokens, spans):
    out, last = [], None
    for _, a, b in tokens:
        hit = [s for s in spans if s[1] > a and s[0] < b]
        label = max(hit, key=lambda s: (T.LABEL_PRIORITY.get(s[2], 0), s[2]))[2] if hit else None
        out.append("O" if label is None else ("I-" if label == last else "B-") + label)
        last = label
    return out


def test_bio_round(spark):
    r = random.Random(3)
    text = " ".join("w" * r.randint(1, 6) for _ in range(60))
    spans = sorted((a, a + r.randint(1, 12), r.choice(["TIME", "C_ENT", "PLAN", "ODD"])) for a in r.sample(range(len(text) - 12), 9))
    df = spark.createDataFrame([("k", text, [(f"e{i}", *s, None, "") for i, s in enumerate(spans)])], f"k string, text string, spans {SPAN}")
    toks = T.tokens(df, "k")
    labels = T.bio_labels(toks, T.exploded(df, "k"), "k")
    got = [x.label for x in labels.orderBy("i").collect()]
    places = [(0, m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    assert got == bio(places, spans)
    islands = T.bio_spans(labels, "k").orderBy("start").collect()
    want, cur = [], None
    for (_, a, b), x in zip(places, got):
        if x == "O":
            cur = None
        elif x[0] == "B":
            want.append(cur := [a, b, x[2:]])
        else:
            cur[1] = b
    assert [[s.start, s.end, s.label] for s in islands] == want
    assert [s.id for s in islands] == [f"e{i + 1}" for i in range(len(want))]


def test_bio_spans_with_confidence(spark):
    rows = [("k", i, i * 2, i * 2 + 1, x, c) for i, (x, c) in enumerate([("I-A", 0.9), ("B-A", 0.7), ("I-A", 0.8), ("I-B", 0.9), ("B-A", 0.5), ("I-A", 0.9), ("B-B", 0.61), ("B-B", 0.9)])]
    got = T.bio_spans(spark.createDataFrame(rows, "k string, i int, start int, end int, label string, confidence double"), "k", 0.6).orderBy("start").collect()
    assert [(s.start, s.end, s.label, s.confidence) for s in got] == [(2, 5, "A", 0.8), (12, 13, "B", 0.61), (14, 15, "B", 0.9)]


@pytest.mark.parametrize("seed", range(3))
def test_without_overlaps(spark, seed):
    r = random.Random(seed)
    spans = [(f"e{i}", a := r.randint(0, 80), a + r.randint(0, 20), "X", r.choice([None, 0.5, 0.9]), "") for i in range(30)]
    kept = []
    for s in sorted(spans, key=lambda s: (-(1.0 if s[4] is None else s[4]), s[1], s[2], s[0])):
        if s[2] - s[1] >= 1 and all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    df = spark.createDataFrame([(1, spans), (2, None), (3, [])], f"k int, spans {SPAN}").select("k", T.without_overlaps(F.col("spans")).alias("s")).orderBy("k").collect()
    assert [x.id for x in df[0].s] == [k[0] for k in kept] and df[1].s is None and df[2].s == []


def test_rendering(spark):
    df = spark.createDataFrame([("No fever on day 3.", [("e1", 3, 8, "C_ENT", 0.9, ""), ("e2", 12, 17, "TIME", 0.9, "")])], f"text string, spans {SPAN}")
    r = df.select(T.tagged(F.col("text"), F.col("spans")).alias("t"), T.pair_marked(F.col("text"), F.lit(12), F.lit(17), F.lit(3), F.lit(8)).alias("m")).first()
    assert r.t == 'No <c_ent id="e1">fever</c_ent> on <time id="e2">day 3</time>.'
    assert r.m == "No <CHILD>fever</CHILD> on <HEAD>day 3</HEAD>."
    m = spark.createDataFrame([("[TABLE]a[TABLE][TABLE]",), ("none",), ("",), (None,)], "t string").select(T.marks(F.col("t")).alias("m")).collect()
    assert [x.m for x in m] == [[0, 8, 15], [], [], None]


@pytest.mark.parametrize("far", [None, 40])
def test_pairs(spark, far):
    r = random.Random(1)
    spans = [("k", f"e{i}", r.randint(0, 300), r.choice(["C_ENT", "TIME", "NEGATION", "TABLE"])) for i in range(40)]
    got = {(x.head, x.child, x.label) for x in T.allowed_pairs(spark.createDataFrame(spans, "k string, id string, start int, label string"), ["k"], farthest=far).collect()}
    assert got == {(a[1], b[1], rel) for a in spans for b in spans for x, y, rel in T.ALLOWED if a[1] != b[1] and a[3] == x and b[3] == y and (far is None or abs(a[2] - b[2]) <= far)}


def test_relations_and_training(spark):
    rel = spark.createDataFrame([("k", 0, "a", "b", "X", 0.5), ("k", 1, "a", "b", "Y", 0.7), ("k", 2, "a", "b", "Z", 0.7), ("k", 3, "a", "c", "X", None)], "k string, ord int, head string, child string, label string, confidence double")
    assert sorted((r.child, r.label) for r in T.best_relations(rel, ["k"]).collect()) == [("b", "Y"), ("c", "X")]
    pairs = spark.createDataFrame([("k", "a", "b", "Y", 90), ("k", "a", "d", "Y", 20), ("k", "a", "e", "Y", 60), ("k", "a", "c", "X", 150)], "k string, head string, child string, label string, distance int")
    assert sorted((r.child, r.label) for r in T.training_pairs(pairs, rel, ["k"], share=0.0).collect()) == [("b", "Y"), ("d", "NO_RELATION")]
    assert sorted(r.child for r in T.training_pairs(pairs, rel, ["k"], share=1.0).collect()) == ["b", "d", "e"]
    df = spark.createDataFrame([(i,) for i in range(50)], "k int")
    parts = [r.part for r in T.divided(df, "k", 8).collect()]
    assert parts.count("dev") == 8 and parts.count("train") == 42
    assert {r.part for r in T.divided(df, "k", 0).collect()} == {"train"}


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, g string")
    got = {r.label: r for r in T.metrics(df, "t", "g").collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].precision, got["c"].f1) == (1.0, 0.5, pytest.approx(1 / 3), 0.0)
    assert {r.accuracy for r in got.values()} == {0.5}
    assert {r.label: r.weight for r in T.class_weights(df.withColumnRenamed("t", "label")).collect()} == {"a": 2.0, "b": 4.0, "c": 4.0}


def test_tables_and_days(spark):
    note = "x\n| Time | Na | K |\n|---|---|---|\n| 1/2 | <135 | 4.1 | extra |\n| 1/3 |  | hemolyzed |\nend\n| A |\n| 5 |"
    df = spark.createDataFrame([(1, note, "2025-01-01 10:00:00"), (2, None, None), (3, "", None)], "k int, text string, a string")
    cells = T.pipe_cells(df, "k").orderBy("line", "column").collect()
    assert [(c.line, c.header, c.cell) for c in cells] == [(3, "Time", "1/2"), (3, "Na", "<135"), (3, "K", "4.1"), (3, None, "extra"), (4, "Time", "1/3"), (4, "K", "hemolyzed"), (7, "A", "5")]
    v, s = T.parsed_value(F.col("c"))
    got = spark.createDataFrame([("<135",), ("4.1",), ("hemolyzed",), ("84/52",)], "c string").select(v.alias("v"), s.alias("s")).collect()
    assert [tuple(x) for x in got] == [(135.0, "<"), (4.1, None), (None, None), (84.0, None)]
    days = spark.createDataFrame([(1, "HD#3, on hospital day 5, day 1; 2025-01-04, 12/30 and 1/3/25, 02/30", "2025-01-01 10:00:00"), (2, "day 2", None)], "k int, text string, a string")
    assert sorted(r.day for r in T.stated_days(days, "k", "a").filter("k = 1").collect()) == [-2, 0, 2, 2, 3, 4]
    cues = T.negation_cues(spark.createDataFrame([(1, "No fever, no evidence of sepsis. Not now; nothing."), (2, None)], "k int, text string"), "k").collect()
    assert sorted((c.cue, c.n) for c in cues) == [("no", 1), ("no evidence of", 1), ("not", 1)]


def test_modifiers_names_and_codes(spark):
    from wardline.functions.text import comparison_of, modifier_of, name_order, sex_code

    op, number = comparison_of(F.col("p"))
    rows = spark.createDataFrame([("↑ lactate > 4.5",), ("remains stable",), ("No fever",), ("fell below 90",), ("at least ≥ 3",), ("",), (None,), ("high",)], "p string").select(modifier_of(F.col("p")).alias("m"), op.alias("op"), number.alias("n")).collect()
    assert [tuple(r) for r in rows] == [("uptrended", ">", 4.5), ("unchanged", None, None), ("absent", None, None), ("downtrended", "<", 90.0), (None, ">=", 3.0), (None, None, None), (None, None, None), ("high", None, None)]
    names = spark.createDataFrame([("Bexock, Quinmond", "Male"), ("Lummond  Kashowan ", "m"), ("UNA ORN", "U"), (None, None)], "n string, s string").select(name_order(F.col("n")).alias("n"), sex_code(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in names] == [("Quinmond Bexock", "M"), ("Lummond Kashowan", "M"), ("Una Orn", None), (None, None)]


def test_document_modifiers_read_every_line(spark, tmp_path):
    from wardline.queries_text import document_modifiers

    texts = ["Lactate rising\nPressors stable\r\nCreatinine improved\n[END OF NOTE]", "Fever worse", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.modifier: r.n for r in document_modifiers(spark, str(tmp_path)).collect()} == {"uptrended": 2, "unchanged": 1, "downtrended": 1, None: 2}


def test_labels_and_islands_of_whole_rows_agree_with_the_joins(spark):
    r = random.Random(8)
    rows = []
    for u in range(25):
        t = "".join(r.choice(["ab ", "c", "d\n", " ", "\u00e9\u00a0", "xyz "]) for _ in range(r.randint(0, 120)))
        spans = [(f"s{i}", (a := r.randint(-2, len(t))), a + r.randint(-1, 25), r.choice(["C_ENT", "TIME", "PLAN", "NEGATION", "TABLE"]), None, "") for i in range(r.randint(0, 12))]
        rows.append((f"u{u}", t, spans or None, "clash"))
    rows += [("null", None, None, ""), ("empty", "", [], "")]
    df = spark.createDataFrame(rows, "uid string, text string, spans array<struct<id:string,start:int,end:int,label:string,confidence:double,text:string>>, i string")
    by_row = T.labelled(df.select("uid", "text", "spans"))
    lab = by_row.select("uid", F.inline("labels"))
    by_join = T.bio_labels(T.tokens(df.select("uid", "text"), "uid"), T.exploded(df, "uid"), "uid")
    row = lambda d: sorted(map(tuple, d.select("uid", "i", "start", "end", "label").collect()))
    assert row(lab) == row(by_join) and len(row(lab)) > 300
    one = by_row.select("uid", F.inline(T.joined_spans(F.col("labels"))))
    two = T.bio_spans(by_join, "uid")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_islands_with_confidence(spark):
    words = [(0, 0, 2, "B-X", 0.9), (1, 3, 5, "I-X", 0.4), (2, 6, 8, "I-X", 0.8), (3, 9, 10, "O", 1.0), (4, 11, 12, "I-Y", 1.0), (5, 13, 14, "B-Y", 0.7), (6, 15, 16, "I-Y", 0.75)]
    df = spark.createDataFrame([("u", words)], "uid string, w array<struct<i:int,start:int,end:int,label:string,confidence:double>>")
    for least in (None, 0.5):
        one = df.select("uid", F.inline(T.joined_spans(F.col("w"), least)))
        two = T.bio_spans(df.select("uid", F.inline("w")), "uid", least)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_widened_labels():
    assert T.widened(["O", "B-X", "I-X", "O", "B-Y", "O", "O"]) == ["B-X", "I-X", "I-X", "I-X", "B-Y", "I-Y", "O"]
    assert T.widened(["B-X", "O", "O", "B-X"]) == ["B-X", "I-X", "B-X", "I-X"]
    assert T.widened([]) == [] and T.widened(["O"]) == ["O"]


def test_models_are_plugged_in(spark):
    df = spark.createDataFrame([(1, "aa BB cc"), (2, None), (3, "")], "k int, t string").coalesce(1)

    def model():
        return lambda texts: [[{"start": 3, "end": 5, "label": "X", "confidence": 0.9}, {"start": 0, "end": 2, "label": "Y", "confidence": 0.2}] if t else [] for t in texts]

    got = {r.k: r.found for r in T.extracted(df, model, "t", 0.5).collect()}
    assert [(s.id, s.start, s.label) for s in got[1]] == [("e1", 3, "X")] and got[2] is None and got[3] == []
    rel = lambda: lambda texts: [("R", 0.95) if "1" in t else ("NO_RELATION", 0.99) if "2" in t else ("R", 0.6) for t in texts]
    pairs = spark.createDataFrame([("1", "clash"), ("2", "clash"), ("3", "clash"), (None, "clash")], "m string, relation string")
    assert [(r.m, r.relation, r.confidence) for r in T.related(pairs, rel, "m").collect()] == [("1", "R", 0.95)]


def test_the_surest_time_and_negation_hold(spark):
    spans = spark.createDataFrame([("u", "c1", 10, "C_ENT"), ("u", "c2", 50, "C_ENT"), ("u", "t1", 0, "TIME"), ("u", "t2", 30, "TIME"), ("u", "n1", 5, "NEGATION"), ("u", "c3", 90, "C_ENT")], "uid string, id string, start int, label string")
    rel = [("u", "c1", "t1", "TIME_RELATION", 0.7), ("u", "c1", "t2", "TIME_RELATION", 0.9), ("u", "c1", "n1", "NEGATION_RELATION", 0.8), ("u", "c2", "t1", "TIME_RELATION", None), ("u", "c2", "t2", "TIME_RELATION", None), ("u", "c2", "n1", "NEGATION_RELATION", 0.1), ("u", "c2", "gone", "TIME_RELATION", 1.0)]
    got = {r.id: (r.time_id, r.negation_id, r.negated, r.n_times, r.n_negations) for r in T.settled(spans, spark.createDataFrame(rel, "uid string, head string, child string, label string, confidence double"), ["uid"]).collect()}
    assert got == {"c1": ("t2", "n1", False, 2, 1), "c2": ("t2", "n1", True, 2, 1), "c3": (None, None, False, 0, 0)}


def annotated_rows(r, n, words):
    rows = []
    for u in range(n):
        t = " ".join(r.choice(["ab", "c", "d\n", "", "\u00e9\u00a0", "xyz"]) for _ in range(r.randint(0, words)))
        spans = [(f"s{i}", (a := r.randint(-2, len(t))), a + r.randint(-1, 25), r.choice(["C_ENT", "TIME", "PLAN", "NEGATION", None]), None, "") for i in range(r.randint(0, 12))]
        rows.append((f"u{u}", t, spans or None))
    return [*rows, ("null", None, None), ("bare", None, [("s", 0, 4, "TIME", None, "")]), ("empty", "", [])]


def batch(rows):
    part = lambda j: pa.array([None if s is None else [x[j] for x in s] for _, _, s in rows], pa.list_(pa.int32() if j < 3 else pa.string()))
    return pa.array([t for _, t, _ in rows], pa.string()), part(1), part(2), part(3)


def python_passes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython ["), plan.count("Exchange")


def test_islands_are_made_in_one_pass_of_short_runs(spark, tmp_path, monkeypatch):
    from wardline.queries_text import bio_islands

    r = random.Random(4)
    df = spark.createDataFrame(annotated_rows(r, 90, 80), f"uid string, text string, spans {SPAN}").coalesce(1)
    df.write.parquet(f"{tmp_path}/training_data.parquet")
    got = bio_islands(spark, str(tmp_path))
    assert python_passes(got) == (1, 0)
    by_join = T.bio_spans(T.bio_labels(T.tokens(df, "uid"), T.exploded(df, "uid").filter("label is not null"), "uid"), "uid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_join.select(*got.columns).collect())) and got.count() > 100

    rows = annotated_rows(r, 60, 80)
    want = [x for a in T.entity_runs(iter([batch(rows)])) for x in a.to_pylist()]
    for size, n in ((100, 512), (1 << 20, 1), (1 << 20, len(rows)), (1 << 20, 7)):
        monkeypatch.setattr(T, "RUN_BYTES", size)
        monkeypatch.setattr(T, "RUN_TEXTS", n)
        assert [x for a in T.entity_runs(iter([batch(rows), batch([]), batch(rows)])) for x in a.to_pylist()] == want * 2


def test_widened_labels_are_made_once_in_short_runs(spark, tmp_path, monkeypatch):
    from wardline.queries_text import bio_widened

    r = random.Random(6)
    rows = annotated_rows(r, 90, 80)
    df = spark.createDataFrame(rows, f"uid string, text string, spans {SPAN}").coalesce(1)
    df.write.parquet(f"{tmp_path}/training_data.parquet")
    got = bio_widened(spark, str(tmp_path))
    assert python_passes(got) == (1, 0)
    by_join = T.bio_labels(T.tokens(df, "uid"), T.exploded(df, "uid").filter("label is not null"), "uid").orderBy("uid", "i").collect()
    want = [(u, i, x) for u, t, _ in rows if t for i, x in enumerate(T.widened([x.label for x in by_join if x.uid == u]))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000

    whole = [x for a in T.label_runs(iter([batch(rows)]), True) for x in a.to_pylist()]
    assert [x is None for x in whole] == [t is None for _, t, _ in rows]
    assert [(u, w["i"], w["label"]) for (u, _, _), x in zip(rows, whole) for w in x or ()] == want
    monkeypatch.setattr(T, "RUN_TEXTS", 7)
    runs = list(T.label_runs(iter([batch(rows), batch([]), batch(rows)]), True))
    assert [x for a in runs for x in a.to_pylist()] == whole * 2 and max(map(len, runs)) == 7
    monkeypatch.setattr(T, "RUN_BYTES", 100)
    runs = list(T.label_runs(iter([batch(rows)]), True))
    assert [x for a in runs for x in a.to_pylist()] == whole and max(a.values.nbytes for a in runs) < 10_000


def test_spans_of_chunks_are_found_within_their_rows(spark, tmp_path, monkeypatch):
    from wardline.queries_text import span_chunks

    r = random.Random(9)
    rows = annotated_rows(r, 60, 700)
    rows += [(None, "a b", [("s", 0, 1, "TIME", None, "")]), ("holes", "  a b ", [None, ("s", None, 1, "TIME", None, ""), ("s", 0, 9, "TIME", None, ""), ("s", 2, None, "TIME", None, "")])]
    rows += [(f"n{n}", " " + "w " * n, [("s", 0, 2 * n, "TIME", None, ""), ("s", -3, 1, "TIME", None, ""), ("s", -3, 2, "TIME", None, "")]) for n in (0, 1, 128, 129, 224, 225)]
    spark.createDataFrame(rows, f"uid string, text string, spans {SPAN}").coalesce(1).write.parquet(f"{tmp_path}/training_data.parquet")
    got = span_chunks(spark, str(tmp_path))
    assert python_passes(got) == (1, 0) and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = []
    for u, t, spans in rows:
        places = [m.span() for m in re.finditer(r"[^ \t\n\r\f\v]+", t or "")]
        for k in range(max(0, -(-(len(places) - 128) // 96)) + 1 if places and u else 0):
            a, b = places[96 * k][0], places[min(96 * k + 128, len(places)) - 1][1]
            for i, s in enumerate(spans or ()):
                if s and None not in s[1:3] and s[2] > s[1] and s[2] > a and s[1] < b:
                    want.append((u, k, i, max(s[1], a) - a, min(s[2], b) - a, s[3] or ""))
    assert sorted((*x[:5], x[5] or "") for x in map(tuple, got.collect())) == sorted(want) and len(want) > 300 and {1, 2, 3} <= {x[1] for x in want}

    texts = pa.array([t for _, t, _ in rows], pa.string())
    whole = [x for a in T.place_runs(iter([texts])) for x in a.to_pylist()]
    assert whole == [{"start": None, "end": None} if t is None else {"start": [m.start() for m in T._WORD.finditer(t)], "end": [m.end() for m in T._WORD.finditer(t)]} for _, t, _ in rows]
    monkeypatch.setattr(T, "RUN_TEXTS", 7)
    parts = list(T.place_runs(iter([texts, texts.slice(0, 0), texts])))
    assert [x for a in parts for x in a.to_pylist()] == whole * 2 and max(map(len, parts)) == 7
