import itertools
import random

import pytest
from wardline.operators import cohort
from wardline.plans.compiler import Catalog, active, candidates, candidates_by_joins, trend_anchors, window
from wardline.plans.evidence import read_intent
from wardline.plans.ir import Anchor, IntentError, Leaf, Node, Temporal, checked, from_json, problems_of

PUMP = "left heart pump"
PATIENTS = [("p1", "Ann Smith-Jones", 50, "F"), ("p2", "Bob Lee", 61, "M"), ("p3", "Cy Orn", None, "F"), ("p4", "Dee Hu", 44, "M")]
EVENT = "event_id int, patient_id string, normalized_term string, value double, unit string, is_active boolean, is_started boolean, is_ended boolean, history boolean, day_offset_start int, day_offset_end int, source_entity string, is_worsening boolean, level_entry string"
EVENTS = [
    ("p1", PUMP, None, None, "AS", 2, None), ("p1", PUMP, None, None, "E", None, 5), ("p1", PUMP, None, None, "A", 3, 4), ("p1", "lactate", 3.0, "mmol/L", "A", 3, 3), ("p1", "lactate", 1.0, "mmol/L", "A", 3, 3),
    ("p1", "creatinine", 1.0, "mg/dL", "A", 0, 0), ("p1", "creatinine", 2.0, "mg/dL", "A", 6, 6), ("p2", "lactate", 3.0, "mmol/L", "A", 3, 3), ("p2", "hypertension", None, None, "AH", None, None),
    ("p3", PUMP, None, None, "AS", 1, 1), ("p3", "spo2", 88.0, None, "A", 1, 1), ("p4", "delirium", None, None, "", 1, 2), ("p4", "diabetes", None, None, "AH", -1, None),
]


@pytest.fixture(scope="module")
def micro(spark):
    rows = [(i, p, t, v, u, "A" in f, "S" in f, "E" in f, "H" in f, a, b, None, None, None) for i, (p, t, v, u, f, a, b) in enumerate(EVENTS, 1)]
    events = spark.createDataFrame(rows, EVENT)
    maps = spark.createDataFrame([("lactate", "perfusion", None, None), ("spo2", "perfusion", "active", 2), ("delirium", "perfusion", "inactive", 1)], "term string, concept_class string, status string, priority int")
    base = spark.createDataFrame([("p1", "creatinine", "admission_start", 1.0, "mg/dL"), ("p2", "creatinine", "latest", 9.0, "mg/dL")], "patient_id string, normalized_term string, anchor string, value double, unit string")
    return Catalog(spark.createDataFrame(PATIENTS, "patient_id string, patient_name string, age int, sex string"), events, active(maps), base, cohort.trends(events), PUMP)


def who(catalog, tree, **more):
    a = {r.patient_id for r in candidates(catalog, tree, **more).collect()}
    b = {r.patient_id for r in candidates_by_joins(catalog, tree, **more).collect()}
    assert a == b
    return a


def on(relation, kind=None, event=None, day=None, off=0):
    if relation in ("HISTORY", "BASELINE"):
        return (Temporal(relation),)
    return (Temporal(relation, Anchor("admission", day_offset=day) if day is not None else Anchor("concept", PUMP, kind, event, off)),)


CASES = [
    (Leaf("lactate"), "p1 p2"), (Leaf("lactate", temporal=on("OVERLAPS", "INTERVAL")), "p1"), (Leaf("lactate", modifier="absent", temporal=on("OVERLAPS", "INTERVAL")), "p2 p3 p4"),
    (Leaf("lactate", op=">", value=3.0), ""), (Leaf("lactate", op=">", value=2.0), "p1 p2"), (Leaf("creatinine", temporal=on("FROM", "EVENT", "stop")), "p1"),
    (Leaf("hypertension", temporal=on("OVERLAPS", day=0)), "p2"), (Leaf("hypertension", temporal=on("OVERLAPS", day=1)), ""), (Leaf("diabetes", temporal=on("UNTIL", day=-1)), "p4"),
    (Leaf("hypertension", temporal=on("UNTIL", day=-1)), "p2"), (Leaf("delirium"), ""), (Leaf("delirium", modifier="absent"), "p1 p2 p3 p4"), (Leaf("diabetes", temporal=on("HISTORY")), "p4"),
    (Leaf("diabetes", modifier="absent", temporal=on("HISTORY")), "p1 p2 p3"), (Leaf("spo2", op="<", value=90.0, unit="%"), ""), (Leaf(None, "perfusion"), "p1 p2 p3"), (Leaf("diabetes", "perfusion"), "p1 p2 p3 p4"),
    (Leaf("creatinine", op=">", value=0.5, temporal=on("BASELINE")), "p1"), (Leaf("creatinine", temporal=on("BASELINE")), "p1"), (Leaf("creatinine", modifier="absent", temporal=on("BASELINE")), "p2 p3 p4"),
    (Leaf("creatinine", modifier="uptrended"), "p1"), (Leaf("lactate", modifier="unchanged"), ""), (Leaf("creatinine", temporal=on("FROM", "EVENT", None)), "p1"),
    (Leaf("lactate", temporal=on("OVERLAPS", "EVENT", "start", off=1)), "p1"), (Node("OR", ()), ""), (Node("AND", ()), "p1 p2 p3 p4"), (Node("AND", (Leaf(),)), "p1 p2 p3 p4"),
    (Node("AND", (Leaf("lactate"), Node("OR", (Leaf("creatinine"), Leaf("hypertension"))))), "p1 p2"), (Node("AND", (Leaf("lactate"),), on("OVERLAPS", "INTERVAL")), "p1"),
    (Node("AND", (Leaf("lactate", temporal=on("FROM", day=0)),), on("OVERLAPS", "INTERVAL")), "p1 p2"), (Node("AND", (), (), ("Bob", "P4")), "p2 p4"), (Node("AND", (), (), ("smith-jones",)), ""), (Node("XOR", (Leaf("lactate"), Leaf("creatinine"))), "p1"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_micro_cohort(micro, i):
    tree, want = CASES[i]
    assert who(micro, tree) == set(want.split())


def test_literal_units(micro):
    assert who(micro, Leaf("lactate", unit="%")) == {"p1", "p2"}
    assert who(micro, Leaf("lactate", unit="%"), literal_units=True) == set()


def test_repeated_patients_and_rows(spark, micro):
    twice = Catalog(micro.patients.union(micro.patients), micro.events.union(micro.events), micro.class_map.union(micro.class_map), micro.baselines, micro.trends, PUMP)
    assert sorted(r.patient_id for r in candidates(twice, Leaf("lactate", "perfusion")).collect()) == ["p1", "p2", "p3"]


def test_empty_events(spark, micro):
    none = Catalog(micro.patients, micro.events.limit(0), micro.class_map, micro.baselines, micro.trends, PUMP)
    assert who(none, Leaf("lactate")) == set()
    assert len(who(none, Leaf("lactate", modifier="absent"))) == 4


@pytest.mark.parametrize("seed", range(6))
def test_both_forms_agree_on_random_trees(micro, seed):
    r = random.Random(seed)
    scopes = [(), on("OVERLAPS", "INTERVAL"), on("UNTIL", "EVENT", "start"), on("FROM", "EVENT", "stop"), on("UNTIL", day=0), on("HISTORY"), on("BASELINE"), on("FROM", day=1), (*on("FROM", day=0), *on("UNTIL", "EVENT", "stop"))]

    def tree(depth):
        if depth == 0 or r.random() < 0.4:
            numeric = r.random() < 0.3
            return Leaf(r.choice(["lactate", "creatinine", PUMP, "diabetes", "none"]), r.choice([None, None, "perfusion"]), ">" if numeric else None, 1.5 if numeric else None, None, r.choice(["present", "absent", None]), None, r.choice(scopes))
        return Node(r.choice(["AND", "OR"]), tuple(tree(depth - 1) for _ in range(r.randint(1, 3))), r.choice([(), on("OVERLAPS", "INTERVAL")]))

    who(micro, tree(3))


def test_windows_and_trend_anchors():
    assert window(on("UNTIL", day=0)).with_history and not window(on("UNTIL", day=1)).with_history
    assert not window((*on("FROM", day=-5), *on("UNTIL", day=0))).with_history
    with pytest.raises(IntentError):
        window((*on("UNTIL", day=0), *on("FROM", day=1)))
    want = {
        (): ("admission_start", "latest"), on("OVERLAPS", "INTERVAL"): ("pump_earliest", "pump_latest"), on("OVERLAPS", "EVENT", "start"): ("prepump_latest", "pump_earliest"),
        on("OVERLAPS", "EVENT", "stop"): ("pump_latest", "postpump_earliest"), on("UNTIL", "EVENT", "stop"): ("prepump", "pump"), on("UNTIL", "EVENT", "start"): ("admission_start", "prepump_latest"),
        on("UNTIL", "INTERVAL"): ("admission_start", "pump"), on("FROM", "EVENT", "start"): ("pump", "admission_end"), on("FROM", "INTERVAL"): ("pump", "admission_end"),
        on("FROM", "EVENT", "stop"): ("postpump_earliest", "admission_end"), on("FROM", day=0): ("admission_start", "admission_end"), on("UNTIL", day=999): ("admission_start", "admission_end"),
        (*on("FROM", "EVENT", "start"), *on("UNTIL", "EVENT", "stop")): ("pump_earliest", "pump_latest"),
    }
    for t, pair in want.items():
        assert trend_anchors(t, PUMP) == pair
    for t in (on("FROM", day=3), on("HISTORY"), (Temporal("FROM", Anchor("concept", "other", "EVENT", "start")),), (*on("FROM", day=0), *on("UNTIL", day=999))):
        with pytest.raises(IntentError):
            trend_anchors(t, PUMP)


def test_validation():
    good = {"parse_status": "ok", "logic": "AND", "patient_references": [], "clauses": [{"term": "lactate", "op": ">", "value": 2, "modifier": None, "temporal": [{"relation": "FROM", "anchor": {"form": "admission", "day_offset": 1}}]}]}
    assert problems_of(good) == [] and isinstance(checked(good), Node)
    assert from_json(good).children[0].temporal[0].anchor.day_offset == 1
    bad = [
        None, {"clauses": []}, {**good, "logic": "XOR"}, {**good, "clauses": [{"term": ""}]}, {**good, "clauses": [{"term": "x", "op": ">="}]}, {**good, "clauses": [{"term": "x", "op": ">"}]}, {**good, "clauses": [{"term": "x", "modifier": "odd"}]},
        {**good, "clauses": [{"term": "x", "op": "<", "value": "5"}]}, {**good, "clauses": [{"term": "x", "temporal": []}]}, {**good, "clauses": [{"term": "x", "temporal": [{"relation": "NEAR"}]}]}, {**good, "clauses": [7]},
        {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": {"form": "concept", "term": "y", "kind": "EVENT", "event": "end"}}]}]}, {**good, "clauses": [{"term": "x", "temporal": ["FROM"]}]},
        {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": {"form": "concept", "term": "y", "kind": "INTERVAL"}}]}]}, {**good, "clauses": [{"term": "x", "temporal": [{"relation": "OVERLAPS", "anchor": {"form": "concept", "term": "y", "kind": "INTERVAL", "day_offset": 1}}]}]},
        {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": {"form": "admission", "term": "y", "day_offset": 1}}]}]}, {**good, "clauses": [{"term": "x", "temporal": [{"relation": "BASELINE", "anchor": {"form": "admission"}}]}]},
        {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": None}]}]}, {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": {"form": "concept", "kind": "EVENT", "term": " "}}]}]}, {**good, "clauses": [{"term": "x", "modifier_text": 5}]},
        {**good, "clauses": [{"term": "x", "temporal": [{"relation": "HISTORY"}, {"relation": "FROM", "anchor": {"form": "admission"}}]}]},
    ]
    for b in bad:
        assert problems_of(b)
        with pytest.raises(IntentError):
            checked(b)
    # an event without a kind of change is allowed and stands for the admission day; an intent that can't be read has no clauses
    loose = {**good, "clauses": [{"term": "x", "temporal": [{"relation": "FROM", "anchor": {"form": "concept", "term": "y", "kind": "EVENT", "event": None}}]}]}
    assert problems_of(loose) == [] and window(checked(loose).children[0].temporal).low.day == 0
    assert problems_of({"parse_status": "not_parsable", "error_message": "no question"}) == []
    assert problems_of({**good, "clauses": [{"term": "x", "temporal": [{"relation": "OVERLAPS", "anchor": {"form": "concept", "term": "y", "kind": "INTERVAL"}}]}]}) == []


def test_evidence(micro):
    tree = Node("AND", (Leaf("lactate", op=">", value=2.0, temporal=on("OVERLAPS", "INTERVAL")), Leaf("spo2", modifier="absent")))
    found = candidates(micro, tree)
    e = cohort.event_evidence(micro, tree, found)
    assert sorted(r.event_id for r in e.collect()) == [1, 2, 3, 4]
    assert [r.event_id for r in e.filter("normalized_term = 'lactate'").collect()] == [4]
    both = cohort.with_context(e, micro, found, 1).collect()
    assert [r.context for r in both] == sorted(r.context for r in both)
    assert sorted(r.event_id for r in both) == [1, 2, 3, 4, 6, 7]
    assert "is_worsening" not in both[0].asDict() and list(both[0].asDict())[:4] == ["patient_id", "patient_name", "age", "sex"]
    assert sorted(r.event_id for r in cohort.with_context(e, micro, found, 11).collect()) == [1, 2, 3, 4]
    assert cohort.event_evidence(micro, Leaf("creatinine", modifier="uptrended"), found) is None
    t = cohort.trend_evidence(micro, Leaf("creatinine", modifier="uptrended"), found).collect()
    assert [(r.val_start, r.val_end, r.delta, r.patient_name) for r in t] == [(1.0, 2.0, 1.0, "Ann Smith-Jones")]


def test_summaries(spark):
    rows = [(i, "p", "x", v, None, True, False, None, False, d, None, None, None, None) for i, (v, d) in enumerate([(1.0, 5), (3.0, 7), (3.0, 6), (None, 9), (float("nan"), 1), (1.0, 8)])]
    r = cohort.summaries(spark.createDataFrame(rows, EVENT)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.n_total, r.n_numeric, r.min, r.max, r.median, r.earliest_day, r.latest_day, r.min_day, r.max_day) == (6, 4, 1.0, 3.0, 2.0, 1, 9, 5, 6)
    assert r.std == pytest.approx(1.155)
    assert cohort.summaries(spark.createDataFrame([], EVENT)).collect() == []
    g = cohort.group_count(spark.createDataFrame(rows, EVENT)).first()
    assert (g.n_rows, g.n_patients, g.n_groups) == (6, 1, 0)


def test_device_days(spark):
    e = lambda p, s, t, a, b: (0, p, PUMP, None, None, True, s, t, False, a, b, None, None, None)
    rows = [e("a", True, False, 2, None), e("a", False, True, None, 4), e("b", True, False, 2, 2), e("c", True, False, 5, 5), e("c", False, True, 3, 3)]
    got = cohort.device_days(spark.createDataFrame(rows, EVENT)).collect()
    assert sorted((r.patient_id, r.day_offset_start) for r in got) == [("a", 2), ("a", 3), ("a", 4)]
    assert {r.source_entity for r in got} == {cohort.PUMP_ENTRY}
    made = spark.createDataFrame([('"extrapolated pump entry"',), (None,), ("x",)], "s string")
    assert [r.m for r in made.select(cohort.is_made(made.s).alias("m")).collect()] == [True, False, False]


def test_device_days_of_long_stays(spark):
    e = lambda p, s, t, a: (0, p, PUMP, None, None, True, s, t, False, a, a, None, None, None)
    last = {"a": 3660, "b": 3661, "c": 2 * cohort.STRETCH}
    rows = [x for p, n in last.items() for x in (e(p, True, False, 0), e(p, False, True, n))]
    got = cohort.device_days(spark.createDataFrame(rows, EVENT)).collect()
    assert sorted((r.patient_id, r.day_offset_start) for r in got) == [(p, day) for p, n in last.items() for day in range(n + 1)]


def test_combinations_of_scope_are_all_planned(micro):
    relations, kinds = ["FROM", "UNTIL", "OVERLAPS"], [("INTERVAL", None), ("EVENT", "start"), ("EVENT", "stop"), ("EVENT", None), ("ODD", None)]
    for r, (k, e) in itertools.product(relations, kinds):
        who(micro, Leaf("lactate", temporal=on(r, k, e)))


def test_repairs_of_form_and_sense_are_counted_apart():
    good = {"parse_status": "ok", "logic": "AND", "clauses": [{"term": "lactate"}]}
    form, sense = {"clauses": 5}, {**good, "clauses": [{"term": "lactate", "op": ">"}]}
    asked = []

    def reader(*answers):
        it = iter(answers)

        def read(q):
            asked.append(q)
            x = next(it)
            if isinstance(x, Exception):
                raise x
            return x

        return read

    assert read_intent("q", reader(form, sense, good), pause=0) == good
    assert asked[0] == "q" and "The form of" in asked[1] and "The sense of" in asked[2]
    assert read_intent("q", reader(OSError("busy"), good), pause=0) == good
    for answers in ((form, form), (sense, sense), (form, sense, form), (OSError("down"), OSError("down"))):
        with pytest.raises(IntentError):
            read_intent("q", reader(*answers), pause=0)


def test_plan_is_told(micro):
    from wardline.plans.compiler import explained

    said = explained(micro, Leaf("lactate", op=">", value=2.0))
    assert "== Physical Plan ==" in said and "HashAggregate" in said


def test_trends_of_a_question_are_those_of_all(micro):
    tree = Node("AND", (Leaf("creatinine", modifier="uptrended"), Leaf(None, "perfusion", modifier="unchanged", temporal=on("OVERLAPS", "INTERVAL"))))
    some = cohort.trends_for(micro.events, micro.class_map, tree, PUMP)
    pairs = {("admission_start", "latest"), ("pump_earliest", "pump_latest")}
    row = lambda d: {tuple(r) for r in d.collect()}
    want = {r for r in row(micro.trends) if (r[3], r[4]) in pairs and r[1] in ("creatinine", "lactate", "spo2")}
    assert row(some) == want and want
    assert cohort.trends_for(micro.events, micro.class_map, Leaf("lactate"), PUMP) is None
