import datetime as dt

import numpy as np
import pytest
from wardline.operators import units

EVENT = "event_id bigint, patient_id string, normalized_term string, value double, unit string, source_entity string, day_offset_start int, day_offset_end int, charted_at timestamp, loaded_at timestamp, terms string"
UNIT = "term string, unit_code string, factor double, shift double"
REF = "term string, kind string, common_unit string, phys_low double, phys_high double"
UNITS = [("temp", "C", 1.0, 0.0), ("temp", "F", 0.555556, -17.777778), ("temp", "K", 1.0, -273.15), ("hr", "bpm", 1.0, 0.0), ("gas", "mmHg", 1.0, 0.0), ("gas", "kPa", 7.50062, 0.0), ("wbc", "10^9/L", 1.0, 0.0), ("wbc", "cells/uL", 0.001, 0.0)]
TERMS = [("temp", "measurement", "C", 20.0, 46.0), ("hr", "measurement", "bpm", 10.0, 320.0), ("gas", "measurement", "mmHg", 5.0, 250.0), ("wbc", "measurement", "10^9/L", 0.05, 500.0)]


def event(i, term, value, unit=None, text=None, p="p", hour=None):
    t = dt.datetime(2025, 1, 1) + dt.timedelta(hours=i if hour is None else hour)
    return (i, p, term, value, unit, text, 0, 0, t, t, "clash")


def convert(spark, events, baselines=None, limit=20_000):
    df = units.convert_units(spark.createDataFrame(events, EVENT), spark.createDataFrame(UNITS, UNIT), spark.createDataFrame(TERMS, REF), spark.createDataFrame(baselines, "baseline_id bigint, patient_id string, normalized_term string, anchor string, value double, unit string") if baselines is not None else None, limit)
    return {(r.source_table, r.row_id): r for r in df.collect()}


@pytest.mark.parametrize(
    ("unit", "text", "code"),
    [
        ("F", None, "F"), ("°F", None, "F"), ("deg F", None, "F"), ("Fahrenheit", None, "F"), ("kelvin", None, "K"), (None, "temp 98.6 F", "F"), (None, '"temp (deg F) 98.6"', "F"), (None, "temp: 98.6F", "F"),
        (None, "98.6 deg F temp", "F"), (None, "temp of 98.6 °F today", "F"), (None, "TEMP 37 C", "C"),
    ],
)
def test_stated_units(spark, unit, text, code):
    r = convert(spark, [event(1, "temp", 98.6, unit, text)])[("event_df", 1)]
    assert (r.unit_code, r.decoded) == (code, False)


def test_spellings_belong_to_their_term(spark):
    got = convert(spark, [event(1, "wbc", 7000.0, "/uL"), event(2, "hr", 70.0, "/min"), event(3, "wbc", 7.0, "x10^9/L"), event(4, "wbc", 7.0, None, "wbc (10^9/L) 7")])
    assert [got["event_df", i].unit_code for i in (1, 2, 3, 4)] == ["cells/uL", "bpm", "10^9/L", "10^9/L"]
    assert got["event_df", 1].value_common == pytest.approx(7.0)


def test_missing_units_are_decoded_by_level(spark):
    known = [event(i, "gas", v, "mmHg") for i, v in enumerate([80.0, 82.0, 79.0, 81.0, 85.0, 78.0])]
    rows = [*known, event(10, "gas", 10.6, None, "gas", hour=2), event(11, "gas", 83.0, None, "gas"), event(12, "gas", -99.0), event(13, "gas", 0.0), event(14, "gas", 9999.0)]
    got = convert(spark, rows, [(1, "p", "gas", "latest", 11.0, None), (2, "p", "gas", "latest", 80.0, None), (3, "q", "temp", "latest", 98.0, "f"), (4, "p", "gas", "x", None, "kPa"), (5, None, None, None, 1.0, None)])
    assert got["event_df", 10].unit_code == "kPa" and got["event_df", 10].decoded and got["event_df", 10].other
    assert {got["event_df", i].unit_code for i in (11, 12, 13, 14)} == {"mmHg"}
    assert got["baselines_df", 1].unit_code == "kPa" and got["baselines_df", 2].unit_code == "mmHg" and got["baselines_df", 3].value_common == pytest.approx(36.67, abs=0.01)
    assert ("baselines_df", 4) not in got and ("baselines_df", 5) not in got


def test_edges_give_defined_results(spark):
    rows = [event(1, None, 5.0, "C"), event(2, "temp", None, "C"), event(3, "temp", float("nan"), "C"), event(4, "unknown", 5.0, "C"), event(5, "temp", 37.0, "parsec"), event(6, "temp", 37.0, "", "x" * 200_000), event(7, "hr", 60.0, None, None, None), event(7, "hr", 60.0, None, None, None)]
    got = convert(spark, rows)
    assert set(got) == {("event_df", 5), ("event_df", 6), ("event_df", 7)} and got["event_df", 5].unit_code == "C"
    assert convert(spark, []) == {}


def test_blocks_of_hot_series_agree_with_whole_series(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(600):
        v = float(np.round(80 + r.normal(0, 4), 1))
        kpa = r.random() < 0.2
        rows.append(event(i, "gas", round(v / 7.50062, 1) if kpa else v, None if r.random() < 0.3 else ("kPa" if kpa else "mmHg"), p="hot"))
    whole, cut = convert(spark, rows), convert(spark, rows, limit=50)
    assert {k: x.unit_code for k, x in whole.items()} == {k: x.unit_code for k, x in cut.items()}


def test_viterbi_against_all_paths():
    """The decoded run is the best of all paths by the model's own scores."""
    import itertools

    T = units.Terms(["t"], [["a", "b"]], np.array([[1.0, 4.0]]), np.zeros((1, 2)), np.array([2]), np.array([0]), np.array([-np.inf]), np.array([np.inf]), np.array([True]), [{}])
    d = units.Decoder(T, np.array([np.log(10.0)]), np.array([0.5]), line=-1.0)  # line -1: nothing is in line, so nothing but the common unit passes the check after
    free = units.Decoder(T, d.mid, d.spread, line=1e9)
    assert set(d.decode({"stated": np.array([-1])}, np.zeros(1, int), np.array([3.0]), np.array([-1]), np.zeros(1, np.int64), np.array([0]), 1)) == {0}
    r = np.random.default_rng(1)
    prior, stay = np.log([free.usual, 1 - free.usual]), free.stay
    move = np.log((1 - stay) * np.exp(prior)[None, :] + stay * np.eye(2))
    for _ in range(30):
        # without stated readings level and spread are those of the term
        v = np.exp(r.normal(np.log(10), 0.3, 5)) / np.where(r.random(5) < 0.5, 4.0, 1.0)
        y = np.log(v[:, None] * T.factor[0])
        emit = -(free.freedom + 1) / 2 * np.log1p(((y - d.mid[0]) / d.spread[0]) ** 2 / free.freedom)
        score = lambda p: prior[p[0]] + emit[0, p[0]] + sum(move[a, b] + emit[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
        best = np.array(max(itertools.product((0, 1), repeat=5), key=score))
        z0 = np.abs(y[:, 0] - d.mid[0]) / d.spread[0]
        got = units.Decoder(T, d.mid, d.spread, line=1.0).decode({"stated": np.full(5, -1)}, np.zeros(5, int), v, np.full(5, -1), np.zeros(5, np.int64), np.arange(5), 1)
        zb = np.abs(y[np.arange(5), best] - d.mid[0]) / d.spread[0]
        fits = (zb <= 1.0) | (zb <= 0.75)
        assert list(got) == list(np.where(fits & (z0 > 1.0), best, 0))
