import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wardline.llm.splitting import best_cut, pieces, split_oversized

SCHEMA = "uid string, text string, spans array<struct<id:string,start:int,end:int,label:string,confidence:double,text:string>>, relations array<struct<head:string,child:string,label:string,confidence:double>>, piece string, _t int"


def sound(text, limit, overlap):
    p = pieces(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][2] == len(text)
    assert "".join(text[a:b] for _, a, b in p) == text
    for i, (f, a, b) in enumerate(p):
        assert f <= a < b or text == ""
        assert b - f <= limit
        if i:
            assert a == p[i - 1][2] and a - f <= overlap
            assert a - f >= overlap * 0.7 or f == 0
    return p


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n\r\ñ́é‍👩"), min_size=1, max_size=900), st.sampled_from([(60, 10), (100, 50), (40, 0)]))
def test_any_text(text, sizes):
    sound(text, *sizes)


def test_natural_boundaries():
    r = random.Random(2)
    text = ""
    while len(text) < 9000:
        text += " ".join("word" * r.randint(1, 3) for _ in range(r.randint(4, 14))) + ". " + ("\n\n" if r.random() < 0.1 else "")
    p = sound(text, 2000, 200)
    assert all(text[a - 1].isspace() for _, a, _ in p[1:])
    assert all(text[f - 1].isspace() for f, _, _ in p[1:])
    assert sum(text[:a].rstrip(" ").endswith(("\n", ".")) for _, a, _ in p[1:]) == len(p) - 1


def test_strongest_boundary_wins():
    text = "a" * 45 + "\n\n" + "b" * 8 + ". " + "c" * 43
    assert best_cut(text, 0, len(text)) == 47


def test_no_place_to_break_and_line_ends():
    assert [b - f for f, _, b in sound("x" * 5000, 2000, 200)] == [1250, 1450, 1450, 1450]
    text = "\r\n" * 3000
    for _, a, _ in sound(text, 2000, 200)[1:]:
        assert not (text[a - 1] == "\r" and text[a] == "\n")
    text = "é" * 2500
    assert all(not unicodedata.combining(text[a]) for _, a, _ in sound(text, 2000, 200)[1:])


def test_very_long_text():
    text = ("word " * 199 + "end.\n") * 1000
    assert len(sound(text, 2000, 200)) > 500


def test_bad_sizes():
    with pytest.raises(ValueError):
        pieces("x", 100, 60)


def test_spans_and_relations(spark):
    base = "Sentence number one is here. " * 150
    span = lambda i, a, b: (i, a, b, "C_ENT", None, base[a:b])
    spans = [span("e3", 4000, 4010), span("e1", 5, 20), span("e2", 30, 40), span("big", 10, 4200), span("e1", 5, 20)]
    rel = [("e1", "e2", "R", 0.5), ("e1", "e2", "R", 0.5), ("e1", "e3", "R", None), ("e1", "gone", "R", None)]
    df = spark.createDataFrame([("u", base, spans, rel, "clash", 1), ("short", "x" * 2000, None, None, None, None), ("none", None, None, None, None, None), ("empty", "", [], [], None, None), ("nulls", "y " * 1001, None, None, None, None)], SCHEMA)
    rows = split_oversized(df).orderBy("uid", "piece").collect()
    assert {r.uid for r in rows} == {"u", "nulls"}
    mine = [r for r in rows if r.uid == "u"]
    assert [r.piece for r in mine] == list(range(mine[0].n_pieces))
    for r in mine:
        assert r.text == base[r.piece_from : r.piece_to] and len(r.text) <= 2000
        for s in r.spans:
            assert r.text[s.start : s.end] == s.text
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)
    assert [(x.head, x.child) for x in mine[0].relations] == [("e1", "e2")]
    assert mine[0].spans_cut == ["big"] and mine[1].spans_cut is None
    assert sum(any(s.id == "e3" for s in r.spans) for r in mine) >= 1
    nul = [r for r in rows if r.uid == "nulls"]
    assert all(r.spans is None and r.relations is None for r in nul)


def test_relations_that_no_piece_holds_are_listed(spark):
    base = "Sentence number one is here. " * 150
    span = lambda i, a, b: (i, a, b, "C_ENT", None, base[a:b])
    spans = [span("a", 5, 20), span("b", 4100, 4120), span("c", 30, 40), span("twice", 10, 20), span("twice", 4000, 4010), span("big", 100, 4200), span(None, 1, 2)]
    rel = [("a", "b", "R", 0.5), ("a", "b", "R", 0.5), ("a", "c", "R", None), ("a", "gone", "R", None), ("a", "twice", "R", None), ("twice", "b", "R", None), ("a", "big", "R", None), (None, "a", "R", None)]
    rows = split_oversized(spark.createDataFrame([("u", base, spans, rel, "", 1), ("v", base, spans, None, "", 1), ("w", base, None, rel, "", 1)], SCHEMA)).orderBy("uid", "piece").collect()
    mine = [r for r in rows if r.uid == "u"]
    assert {(x.head, x.child) for x in mine[0].relations_cut} == {("a", "b"), ("a", "big")} and len(mine[0].relations_cut) == 2
    assert {(x.head, x.child) for r in mine for x in r.relations} == {("a", "c"), ("a", "twice"), ("twice", "b")}
    assert all(r.relations_cut is None for r in rows if r.piece)
    assert [r.relations_cut for r in rows if r.uid in "vw" and r.piece == 0] == [None, []]


def test_cuts_keep_spans_whole():
    text = ("word " * 199 + "end.\n") * 10
    plain = pieces(text, 2000, 200)
    spans = [(a - 400, a + 300) for _, a, _ in plain[1:]] + [(0, 6000)]
    kept = pieces(text, 2000, 200, spans)
    whole_in = lambda p, x, y: any(f <= x and y <= b for f, _, b in p)
    assert not any(whole_in(plain, x, y) for x, y in spans) and all(whole_in(kept, x, y) for x, y in spans[:-1])
    assert all(text[a - 1].isspace() for _, a, _ in kept[1:]) and max(b - f for f, _, b in kept) <= 2000
    assert pieces(text, 2000, 200, [(a, a + 1700) for a in range(0, 8000, 300)])  # no boundary is free of spans


def test_empty_table_and_missing_columns(spark):
    assert split_oversized(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.n_pieces for r in split_oversized(spark.createDataFrame([("a", "z" * 2001)], "uid string, text string")).collect()] == [2, 2]
