"""Queries over the test tables, with their SQL, for the operators of the core."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog import table
from wardline.operators import cohort, concepts, intervals, spikes, units, vectors
from wardline.plans import compiler, evidence
from wardline.plans.compiler import Catalog, candidates, candidates_by_joins
from wardline.plans.ir import Leaf, Node, from_json
from wardline.queries_text import QUERIES as TEXT_QUERIES
from wardline.queries_text import SQL as TEXT_SQL

PUMP = "left heart pump"

Query = Callable[[SparkSession, str], DataFrame]


def catalog(spark: SparkSession, sf_dir: str, tree: Leaf | Node | None = None) -> Catalog:
    """The tables of a folder, with the trends that a tree asks for."""
    t = lambda n: table(spark, sf_dir, n)
    events, classes = t("event_df"), compiler.active(t("term_concept_class_map_df"))
    return Catalog(t("patient_df"), events, classes, t("baselines_df"), cohort.trends_for(events, classes, tree, PUMP) if tree else None, PUMP)


# the problems that are not about training data ------------------------------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return spikes.implausible(t("event_df"), t("unit_reference"), t("term_reference")).select("event_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = intervals.usable(table(spark, sf_dir, "event_df"), table(spark, sf_dir, "term_reference"))
    return intervals.coverage(used, ["patient_id", "normalized_term"], "day_offset_start", "day_offset_end")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return units.recorded_otherwise(units.convert_units(t("event_df"), t("unit_reference"), t("term_reference"), t("baselines_df")))


def p2_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible readings among those whose unit is written just as in the reference."""
    t = lambda n: table(spark, sf_dir, n)
    bad = spikes.implausible(t("event_df"), t("unit_reference"), t("term_reference")).filter("kind = 'impossible'")
    clean = t("event_df").join(F.broadcast(t("unit_reference").select(F.col("term").alias("normalized_term"), F.col("unit_code").alias("unit"))), ["normalized_term", "unit"], "left_semi")
    return clean.join(bad, "event_id", "left_semi").select("event_id")


def p2_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stuck readings of the series whose unit column can always be read and that have one reading at a time."""
    t = lambda n: table(spark, sf_dir, n)
    series_ = ["patient_id", "normalized_term"]
    content = ["value", "unit", "source_entity", "day_offset_start", "day_offset_end", "is_active", "is_started", "is_ended", "history"]
    e = t("event_df").filter(F.col("patient_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).withColumn("t", units.instant(t("event_df")))
    told = units.with_stated_unit(e, units.read_terms(t("unit_reference"), t("term_reference")), text=None)
    at = told.select(*series_, "t", "stated", *content).distinct().groupBy(*series_, "t").agg(F.count(F.lit(1)).alias("n"), F.min("stated").alias("stated"))
    clean = at.groupBy(*series_).agg(F.max("n").alias("n"), F.min("stated").alias("stated")).filter("n = 1 and stated >= 0").select(*series_)
    stuck = spikes.implausible(t("event_df"), t("unit_reference"), t("term_reference")).filter("kind = 'stuck'")
    return e.join(stuck, "event_id", "left_semi").join(clean, series_, "left_semi").select("event_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the common unit, of rows whose unit is written just as in the reference."""
    t = lambda n: table(spark, sf_dir, n)
    got = units.convert_units(t("event_df"), t("unit_reference"), t("term_reference"), t("baselines_df"))
    rows = t("event_df").select(F.lit("event_df").alias("source_table"), F.col("event_id").alias("row_id"), "normalized_term", "unit").unionByName(t("baselines_df").select(F.lit("baselines_df").alias("source_table"), F.col("baseline_id").alias("row_id"), "normalized_term", "unit"))
    clean = rows.join(F.broadcast(t("unit_reference").select(F.col("term").alias("normalized_term"), F.col("unit_code").alias("unit"))), ["normalized_term", "unit"], "left_semi").select("source_table", "row_id")
    return got.join(clean, ["source_table", "row_id"], "left_semi").select("source_table", "row_id", "normalized_term", "unit_code", "other", F.round("value_common", 4).alias("value_common"))


# temporal predicates ----------------------------------------------------------------------------------------------------


def at(relation: str, day: int | None = None, kind: str | None = None, event: str | None = None, term: str = PUMP, offset: int = 0) -> dict:
    """One temporal object in its JSON form."""
    if relation in ("HISTORY", "BASELINE"):
        return {"relation": relation}
    if day is not None:
        return {"relation": relation, "anchor": {"form": "admission", "day_offset": day}}
    return {"relation": relation, "anchor": {"form": "concept", "term": term, "kind": kind, "event": event, "day_offset": offset}}


def leaf(term: str | None = None, cls: str | None = None, modifier: str = "present", temporal: list | None = None, **more) -> dict:
    return {"resolved_term": term, "resolved_class": cls, "modifier": modifier, "temporal": temporal, **more}


def asked(tree: dict, joins: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        node = from_json(tree)
        return (candidates_by_joins if joins else candidates)(catalog(spark, sf_dir, node), node)

    return query


DURING = [at("OVERLAPS", kind="INTERVAL")]
BEFORE = [at("UNTIL", kind="EVENT", event="start")]

#: Comparisons by the names of their queries.
COMPARED = {"ge": ">=", "le": "<=", "eq": "=", "ne": "!="}

TREES: dict[str, dict] = {
    "term_exists_window": leaf("lactate", temporal=[at("FROM", 2), at("UNTIL", 5)], op=">", value=4.0),
    "term_exists_anytime": leaf("delirium"),
    "term_from_admission_day": leaf("troponin i", temporal=[at("FROM", 4)]),
    "class_exists_window": leaf(cls="vasopressor", temporal=DURING),
    "term_absent_until_anchor": {"logic": "AND", "clauses": [leaf("delirium", modifier="absent", temporal=BEFORE), leaf("delirium", temporal=DURING)]},
    "class_absent_window": {"logic": "AND", "clauses": [leaf(PUMP), leaf(cls="sedative", modifier="absent", temporal=DURING)]},
    "term_absent_vacuous": leaf("lactate", modifier="absent", temporal=DURING),
    "history_present": leaf("hypertension", temporal=[at("HISTORY")]),
    "history_absent": leaf("hypertension", modifier="absent", temporal=[at("HISTORY")]),
    "history_class_present": leaf(cls="organ support", temporal=[at("HISTORY")]),
    "history_class_absent": leaf(cls="organ support", modifier="absent", temporal=[at("HISTORY")]),
    "baseline_numeric": leaf("creatinine", temporal=[at("BASELINE")], op=">", value=2.0),
    "baseline_class_numeric": leaf(cls="renal marker", temporal=[at("BASELINE")], op=">", value=50.0),
    "baseline_nonnumeric": leaf("mechanical ventilation", temporal=[at("BASELINE")]),
    "baseline_class_nonnumeric": leaf(cls="vasopressor", temporal=[at("BASELINE")]),
    "baseline_absent": leaf("mechanical ventilation", modifier="absent", temporal=[at("BASELINE")]),
    "baseline_class_absent": leaf(cls="vasopressor", modifier="absent", temporal=[at("BASELINE")]),
    "overlap_admission_day": leaf("heart rate", temporal=[at("OVERLAPS", 3)], op=">", value=110.0),
    "from_until_two_anchors": leaf("lactate", temporal=[at("FROM", kind="EVENT", event="start"), at("UNTIL", kind="EVENT", event="stop", offset=1)], op=">", value=3.0),
    "from_anchor_until_day": leaf("temperature", temporal=[at("FROM", kind="EVENT", event="start", offset=-1), at("UNTIL", 12)]),
    "from_anchor_stop": leaf("creatinine", temporal=[at("FROM", kind="EVENT", event="stop")]),
    "overlap_anchor_event": leaf("spo2", temporal=[at("OVERLAPS", kind="EVENT", event="start", offset=1)], op="<", value=92.0),
    "until_admission_incl_history": leaf("hypertension", temporal=[at("UNTIL", -1)]),
    "until_admission_absent": leaf("hypertension", modifier="absent", temporal=[at("UNTIL", 0)]),
    "until_admission_later": leaf("diabetes mellitus", temporal=[at("UNTIL", 3)]),
    "bool_tree_or": {"logic": "OR", "clauses": [leaf("limb ischemia"), leaf("hemolysis"), leaf("lactate dehydrogenase", op=">", value=900.0)]},
    "bool_tree_nested": {"logic": "AND", "clauses": [leaf(PUMP), {"logic": "OR", "clauses": [leaf("fever"), {"logic": "AND", "clauses": [leaf("pneumonia"), leaf("cefepime", modifier="absent")]}]}]},
    "temporal_inherited": {"logic": "AND", "temporal": DURING, "clauses": [leaf("norepinephrine"), leaf("spo2", op="<", value=90.0, temporal=[at("FROM", 0)])]},
    "term_or_class_leaf": leaf("milrinone", "inotrope", temporal=[at("FROM", 1), at("UNTIL", 6)]),
    "term_and_class_absent": leaf("milrinone", "inotrope", modifier="absent", temporal=[at("FROM", 1), at("UNTIL", 6)]),
    "unit_ilike": leaf("temperature", op=">", value=100.0, unit="f"),
    **{f"compare_{n}": leaf("sodium", op=op, value=140.0, temporal=[at("FROM", 1), at("UNTIL", 4)]) for n, op in COMPARED.items()},
    "overlap_unknown_anchor": leaf("heart rate", temporal=[{"relation": "OVERLAPS", "anchor": None}], op=">", value=110.0),
    "from_event_without_change": leaf("delirium", temporal=[at("FROM", kind="EVENT", event=None)]),
    "until_stop_anchor": leaf("fever", temporal=[at("UNTIL", kind="EVENT", event="stop", offset=-1)]),
    "overlap_discharge": leaf("heart rate", temporal=[at("FROM", 2), at("UNTIL", 999)], op=">", value=120.0),
    "bool_tree_empty_or": {"logic": "OR", "clauses": [{"logic": "OR", "clauses": []}, leaf("hemolysis")]},
    "bool_tree_empty_and": {"logic": "AND", "clauses": [{"logic": "AND", "clauses": []}, leaf("hemolysis")]},
    "patient_ref_filter": {"logic": "AND", "patient_references": ["p000000007", "bex"], "clauses": [leaf("heart rate")]},
}

TREND_TREES: dict[str, dict] = {
    "trend_up": leaf("creatinine", modifier="uptrended"),
    "trend_down": leaf(cls="perfusion marker", modifier="downtrended", temporal=[at("OVERLAPS", kind="INTERVAL")]),
    "trend_unchanged": leaf("heart rate", "vital sign", modifier="unchanged", temporal=[at("FROM", 0)]),
    "trend_discharge": leaf("creatinine", modifier="uptrended", temporal=[at("UNTIL", 999)]),
    "trend_start_to_stop": leaf("creatinine", modifier="uptrended", temporal=[at("FROM", kind="EVENT", event="start"), at("UNTIL", kind="EVENT", event="stop")]),
    # one for each scope that is told by the device
    **{f"trend_{r.lower()}_{e or 'interval'}": leaf("lactate", modifier="downtrended", temporal=[at(r, kind="EVENT" if e else "INTERVAL", event=e)]) for r, e in compiler.DEVICE_TRENDS},
}

MAP_SQL = "(SELECT term, concept_class FROM term_concept_class_map_df WHERE coalesce(status, 'active') = 'active')"
IV = f"(SELECT patient_id, min(day_offset_start) AS a, max(coalesce(day_offset_end, day_offset_start)) AS b FROM event_df WHERE normalized_term = '{PUMP}' AND is_active GROUP BY 1)"
ST = f"(SELECT patient_id, min(day_offset_start) AS d FROM event_df WHERE normalized_term = '{PUMP}' AND is_started GROUP BY 1)"
SP = f"(SELECT patient_id, max(day_offset_end) AS d FROM event_df WHERE normalized_term = '{PUMP}' AND is_ended GROUP BY 1)"


def _within(low: str, high: str) -> str:
    return f"coalesce(e.day_offset_start, e.day_offset_end, 0) <= {high} AND coalesce(e.day_offset_end, e.day_offset_start, 0) >= {low}"


EARLY = "(coalesce(e.day_offset_end, e.day_offset_start) <= 2 OR e.history)"


def _term(t: str, cond: str = "true", join: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM event_df e {join} WHERE e.patient_id = p.patient_id AND e.normalized_term = '{t}' AND e.is_active AND {cond})"


def _class(c: str, cond: str = "true", join: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM event_df e JOIN {MAP_SQL} m ON m.term = e.normalized_term AND m.concept_class = '{c}' {join} WHERE e.patient_id = p.patient_id AND e.is_active AND {cond})"


def _who(cond: str) -> str:
    return f"SELECT DISTINCT p.patient_id FROM patient_df p WHERE {cond}"


_J = {"iv": f"JOIN {IV} iv ON iv.patient_id = e.patient_id", "st": f"JOIN {ST} st ON st.patient_id = e.patient_id", "sp": f"JOIN {SP} sp ON sp.patient_id = e.patient_id"}
_ON = _within("iv.a", "iv.b")

TREE_SQL = {
    "term_exists_window": _who(_term("lactate", f"e.value > 4 AND {_within('2', '5')}")),
    "term_exists_anytime": _who(_term("delirium")),
    "term_from_admission_day": _who(_term("troponin i", _within("4", "1000000000"))),
    "class_exists_window": _who(_class("vasopressor", _ON, _J["iv"])),
    "term_absent_until_anchor": _who(f"NOT {_term('delirium', _within('-1000000000', 'st.d'), _J['st'])} AND {_term('delirium', _ON, _J['iv'])}"),
    "class_absent_window": _who(f"{_term(PUMP)} AND NOT {_class('sedative', _ON, _J['iv'])}"),
    "term_absent_vacuous": _who(f"NOT {_term('lactate', _ON, _J['iv'])}"),
    "history_present": _who(_term("hypertension", "e.history")),
    "history_absent": _who(f"NOT {_term('hypertension', 'e.history')}"),
    "history_class_present": _who(_class("organ support", "e.history")),
    "history_class_absent": _who(f"NOT {_class('organ support', 'e.history')}"),
    "baseline_numeric": _who("EXISTS (SELECT 1 FROM baselines_df b WHERE b.patient_id = p.patient_id AND b.normalized_term = 'creatinine' AND b.anchor = 'admission_start' AND b.value > 2)"),
    "baseline_class_numeric": _who(f"EXISTS (SELECT 1 FROM baselines_df b JOIN {MAP_SQL} m ON m.term = b.normalized_term AND m.concept_class = 'renal marker' WHERE b.patient_id = p.patient_id AND b.anchor = 'admission_start' AND b.value > 50)"),
    "baseline_nonnumeric": _who(_term("mechanical ventilation", EARLY)),
    "baseline_class_nonnumeric": _who(_class("vasopressor", EARLY)),
    "baseline_absent": _who(f"NOT {_term('mechanical ventilation', EARLY)}"),
    "baseline_class_absent": _who(f"NOT {_class('vasopressor', EARLY)}"),
    "overlap_admission_day": _who(_term("heart rate", f"e.value > 110 AND {_within('3', '3')}")),
    "from_until_two_anchors": _who(_term("lactate", f"e.value > 3 AND {_within('st.d', 'sp.d + 1')}", f"{_J['st']} {_J['sp']}")),
    "from_anchor_until_day": _who(_term("temperature", _within("st.d - 1", "12"), _J["st"])),
    "from_anchor_stop": _who(_term("creatinine", _within("sp.d", "1000000000"), _J["sp"])),
    "overlap_anchor_event": _who(_term("spo2", f"e.value < 92 AND {_within('st.d + 1', 'st.d + 1')}", _J["st"])),
    "until_admission_incl_history": _who(f"{_term('hypertension', _within('-1000000000', '-1'))} OR {_term('hypertension', 'e.history')}"),
    "until_admission_absent": _who(f"NOT {_term('hypertension', _within('-1000000000', '0'))} AND NOT {_term('hypertension', 'e.history')}"),
    "until_admission_later": _who(_term("diabetes mellitus", _within("-1000000000", "3"))),
    "bool_tree_or": _who(f"{_term('limb ischemia')} OR {_term('hemolysis')} OR {_term('lactate dehydrogenase', 'e.value > 900')}"),
    "bool_tree_nested": _who(f"{_term(PUMP)} AND ({_term('fever')} OR ({_term('pneumonia')} AND NOT {_term('cefepime')}))"),
    "temporal_inherited": _who(f"{_term('norepinephrine', _ON, _J['iv'])} AND {_term('spo2', 'e.value < 90 AND ' + _within('0', '1000000000'))}"),
    "term_or_class_leaf": _who(f"{_term('milrinone', _within('1', '6'))} OR {_class('inotrope', _within('1', '6'))}"),
    "term_and_class_absent": _who(f"NOT {_term('milrinone', _within('1', '6'))} AND NOT {_class('inotrope', _within('1', '6'))}"),
    "unit_ilike": _who(_term("temperature", "e.value > 100 AND e.unit ILIKE '%f%'")),
    **{f"compare_{n}": _who(_term("sodium", f"e.value {op} 140 AND {_within('1', '4')}")) for n, op in COMPARED.items()},
    "overlap_unknown_anchor": _who(_term("heart rate", f"e.value > 110 AND {_within('0', '0')}")),
    "from_event_without_change": _who(_term("delirium", _within("0", "1000000000"))),
    "until_stop_anchor": _who(_term("fever", _within("-1000000000", "sp.d - 1"), _J["sp"])),
    "overlap_discharge": _who(_term("heart rate", f"e.value > 120 AND {_within('2', '999')}")),
    "bool_tree_empty_or": _who(_term("hemolysis")),
    "bool_tree_empty_and": _who(_term("hemolysis")),
    "patient_ref_filter": _who(f"(p.patient_id = 'p000000007' OR p.patient_name ILIKE '%p000000007%' OR p.patient_id = 'bex' OR p.patient_name ILIKE '%bex%') AND {_term('heart rate')}"),
}

_DAY = "coalesce(day_offset_start, day_offset_end)"
ANCHORED_SQL = f"""
used AS (
  SELECT patient_id, normalized_term, unit, value, {_DAY} AS day FROM event_df
  WHERE is_active AND NOT coalesce(history, false) AND value IS NOT NULL AND {_DAY} IS NOT NULL AND normalized_term IS NOT NULL
), pump AS {IV}, last_day AS (SELECT patient_id, max(day) AS z FROM used GROUP BY 1
), x AS (
  SELECT u.*, a, b, z, min(CASE WHEN day BETWEEN 0 AND 2 THEN day END) OVER k AS s, max(day) OVER k AS l, max(CASE WHEN day < a THEN day END) OVER k AS pl,
         min(CASE WHEN day BETWEEN a AND b THEN day END) OVER k AS de, max(CASE WHEN day BETWEEN a AND b THEN day END) OVER k AS dl, min(CASE WHEN day > b THEN day END) OVER k AS po
  FROM used u JOIN last_day USING (patient_id) LEFT JOIN pump USING (patient_id) WINDOW k AS (PARTITION BY u.patient_id, u.normalized_term, u.unit)
), marked AS (
  SELECT *, 'admission_start' AS anchor FROM x WHERE day = s UNION ALL SELECT *, 'admission_end' FROM x WHERE day = z UNION ALL SELECT *, 'latest' FROM x WHERE day = l
  UNION ALL SELECT *, 'prepump' FROM x WHERE day < a UNION ALL SELECT *, 'prepump_latest' FROM x WHERE day < a AND day = pl
  UNION ALL SELECT *, 'pump' FROM x WHERE day BETWEEN a AND b UNION ALL SELECT *, 'pump_earliest' FROM x WHERE day BETWEEN a AND b AND day = de
  UNION ALL SELECT *, 'pump_latest' FROM x WHERE day BETWEEN a AND b AND day = dl UNION ALL SELECT *, 'postpump_earliest' FROM x WHERE day > b AND day = po
), anchored AS (
  SELECT patient_id, normalized_term, unit, anchor, median(value) AS value, min(day) AS f, max(day) AS t FROM marked GROUP BY ALL
), pairs(anchor1, anchor2) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in cohort.TREND_PAIRS)}
), trends AS (
  SELECT x.patient_id, x.normalized_term, x.unit, anchor1, anchor2,
         CASE WHEN y.value - x.value > 0.1 * abs(x.value) THEN 'uptrended' WHEN y.value - x.value < -0.1 * abs(x.value) THEN 'downtrended' ELSE 'unchanged' END AS change,
         x.f AS anchor1_start, x.t AS anchor1_end, y.f AS anchor2_start, y.t AS anchor2_end, x.value AS val_start, y.value AS val_end, y.value - x.value AS delta
  FROM pairs JOIN anchored x ON x.anchor = anchor1
  JOIN anchored y ON y.anchor = anchor2 AND y.patient_id = x.patient_id AND y.normalized_term = x.normalized_term AND y.unit IS NOT DISTINCT FROM x.unit
)"""


def _trend(cond: str, join: str = "") -> str:
    return f"EXISTS (SELECT 1 FROM trends t {join} WHERE t.patient_id = p.patient_id AND {cond})"


def _of(c: str) -> str:
    return f"JOIN {MAP_SQL} m ON m.term = t.normalized_term AND m.concept_class = '{c}'"


_PAIR = "t.anchor1 = '{}' AND t.anchor2 = '{}' AND t.change = '{}'"
TREND_SQL = {
    "trend_up": f"WITH {ANCHORED_SQL} " + _who(_trend("t.normalized_term = 'creatinine' AND " + _PAIR.format("admission_start", "latest", "uptrended"))),
    "trend_down": f"WITH {ANCHORED_SQL} " + _who(_trend(_PAIR.format("pump_earliest", "pump_latest", "downtrended"), _of("perfusion marker"))),
    "trend_unchanged": f"WITH {ANCHORED_SQL} " + _who(_trend("t.normalized_term = 'heart rate' AND " + _PAIR.format("admission_start", "admission_end", "unchanged")) + " OR " + _trend(_PAIR.format("admission_start", "admission_end", "unchanged"), _of("vital sign"))),
}
#: Pairs of anchors by the scope of a trend, as questions name it.
_SCOPES = {
    "discharge": ("admission_start", "admission_end"), "start_to_stop": ("pump_earliest", "pump_latest"), "overlaps_interval": ("pump_earliest", "pump_latest"), "overlaps_start": ("prepump_latest", "pump_earliest"), "overlaps_stop": ("pump_latest", "postpump_earliest"),
    "until_stop": ("prepump", "pump"), "until_start": ("admission_start", "prepump_latest"), "until_interval": ("admission_start", "pump"), "from_start": ("pump", "admission_end"), "from_interval": ("pump", "admission_end"), "from_stop": ("postpump_earliest", "admission_end"),
}
for _name, _anchors in _SCOPES.items():
    _what, _how = ("creatinine", "uptrended") if _name in ("discharge", "start_to_stop") else ("lactate", "downtrended")
    TREND_SQL[f"trend_{_name}"] = f"WITH {ANCHORED_SQL} " + _who(_trend(f"t.normalized_term = '{_what}' AND " + _PAIR.format(*_anchors, _how)))

# tables that are built, evidence ---------------------------------------------------------------------------------------


def anchor_query(kind: str, event: str | None, names: list[str]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from wardline.plans.ir import Anchor

        d = compiler.anchor_days(table(spark, sf_dir, "event_df"), Anchor("concept", PUMP, kind, event))
        return d.toDF("patient_id", *names)

    return query


#: Patients who had a lactate above 4 while on the device, and what speaks for it.
EVIDENCE_TREE = {"logic": "AND", "clauses": [leaf("lactate", temporal=DURING, op=">", value=4.0), leaf(cls="vasopressor", temporal=[at("UNTIL", 0)])]}
_EV = ["event_id", "patient_id", "normalized_term", "value", "unit", "day_offset_start", "day_offset_end", "history"]


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame, DataFrame]:
    c, tree = catalog(spark, sf_dir), from_json(EVIDENCE_TREE)
    found = candidates(c, tree)
    return c, found, cohort.event_evidence(c, tree, found)


def event_evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, e = _evidence(spark, sf_dir)
    return cohort.presented(e, c.patients).select(*_EV, "patient_name", "age", "sex")


def event_summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.summaries(_evidence(spark, sf_dir)[2])


def budget_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.group_count(_evidence(spark, sf_dir)[2])


#: A question about ten patients by name, and one about all.
FEW_TREE = {"logic": "AND", "patient_references": [f"p{i:09d}" for i in range(1, 11)], "clauses": [leaf("lactate", temporal=[at("FROM", 1), at("UNTIL", 6)]), leaf(cls="vasopressor")]}


def _context(tree: dict) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Evidence with context as a run gives it: the candidates are counted, and few enough of them get all their events."""
        _, n, events, context, _ = evidence.evidence_for(catalog(spark, sf_dir), from_json(tree))
        rows = events if context is None else events.unionByName(context)
        return rows.select("context", *_EV).withColumn("n_candidates", F.lit(n))

    return query


context_dedup_first, context_many = _context(FEW_TREE), _context(EVIDENCE_TREE)


def _packed(budget: Callable[[DataFrame], int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many data points each patient has in the package of a question, by the budget."""
        c = catalog(spark, sf_dir)
        found, n, events, context, trends = evidence.evidence_for(c, from_json(EVIDENCE_TREE))
        p = evidence.package(c.patients, n, found, events, context, trends, False, budget(events))
        return p.patients.select("patient_id", F.size("evidence").alias("n"), F.get_json_object(F.get("evidence", F.lit(0)), "$.type").alias("kind"))

    return query


def package_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header of a package tells whose budget holds the summaries of few patients only."""
    c = catalog(spark, sf_dir)
    found, n, events, context, trends = evidence.evidence_for(c, from_json(EVIDENCE_TREE))
    h = evidence.package(c.patients, n, found, events, context, trends, False, 6).header
    row = (h["retrieved_candidates"], h["query_scope"], h["subsampled"], h["cta_allowed"], 1 <= h["shown_candidates"] <= n)
    return spark.createDataFrame([row], "retrieved_candidates bigint, query_scope string, subsampled boolean, cta_allowed boolean, shown_some boolean")


# questions ---------------------------------------------------------------------------------------------------------------

#: A concept of a user's own, and what is asked with it.
SHOCK = {
    "definition_polarity": "positive", "aliases": {"positive": ["shock", {"term": "circulation", "modifier": "failing"}], "negative": ["calm circulation", {"term": "circulation", "modifier": "not failing"}]},
    "definition": {"any_of": [{"feature": "serum lactate", "op": ">", "value": 4}, {"all_of": [{"feature": "noradrenaline"}, {"feature": "mean bp", "op": "<", "value": 60}]}]},
}


def _anchor(term: str, kind: str, event: str | None = None) -> dict:
    return {"form": "concept", "term": term, "kind": kind, "event": event, "day_offset": None}


QUESTIONS: dict[str, dict] = {
    "intent_resolved": {"parse_status": "ok", "logic": "AND", "clauses": [
        {"term": "Serum_Lactate", "op": ">", "value": 4, "temporal": [{"relation": "OVERLAPS", "anchor": _anchor("Impella  Device", "INTERVAL")}]},
        {"term": "pressors", "modifier": "present", "temporal": [{"relation": "UNTIL", "anchor": {"form": "admission", "day_offset": 3}}]},
    ]},
    "intent_or": {"parse_status": "ok", "logic": "OR", "clauses": [{"term": "mean arterial presure", "op": "<", "value": 50}, {"term": "sedation", "modifier": "absent", "temporal": [{"relation": "UNTIL", "anchor": _anchor("lv unloading device", "EVENT", "start")}]}]},
    "intent_custom": {"parse_status": "ok", "logic": "AND", "clauses": [{"term": "Shock", "temporal": [{"relation": "FROM", "anchor": {"form": "admission", "day_offset": 1}}]}, {"term": "hr", "op": ">", "value": 100}]},
    "intent_custom_flipped": {"parse_status": "ok", "logic": "AND", "clauses": [{"term": "calm circulation"}]},
    "intent_custom_modifier": {"parse_status": "ok", "logic": "AND", "clauses": [{"term": "circulation", "modifier_text": "surely not failing now"}]},
    "intent_unresolved": {"parse_status": "ok", "logic": "AND", "clauses": [{"term": "lac"}, {"term": "moon phase"}, {"term": "hr", "temporal": [{"relation": "FROM", "anchor": _anchor("sunrise", "EVENT", "start")}]}]},
}


def _planned(spark: SparkSession, sf_dir: str, name: str) -> tuple[Catalog, concepts.Plan]:
    c = catalog(spark, sf_dir)
    r = concepts.Resolver(compiler.active(table(spark, sf_dir, "alias_to_canonical_df")), c.class_map, [concepts.custom_concept("shock", SHOCK)])
    return c, concepts.planned(evidence.read_intent(name, lambda _: QUESTIONS[name]), r)


def answered(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, plan = _planned(spark, sf_dir, name)
        return candidates(c, plan.tree)

    return query


def intent_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every phrase of the questions was taken to mean, null where nothing was found."""
    rows = set()
    for name in QUESTIONS:
        plan = _planned(spark, sf_dir, name)[1]
        rows |= {(name, said, meant) for said, meant in plan.mappings.items()} | {(name, said, None) for said in plan.unresolved}
    return spark.createDataFrame(sorted(rows, key=str), "question string, phrase string, canonical string")


def trend_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = from_json(TREND_TREES["trend_up"])
    c = catalog(spark, sf_dir, tree)
    return cohort.trend_evidence(c, tree, candidates(c, tree))


def baselines_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.baselines(table(spark, sf_dir, "event_df"))


def trends_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.trends(table(spark, sf_dir, "event_df"))


def pump_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.device_days(table(spark, sf_dir, "event_df"))


# concepts ---------------------------------------------------------------------------------------------------------------


def active_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.active(table(spark, sf_dir, "alias_to_canonical_df")).select("alias_id", concepts.normalized_column(F.col("alias")).alias("alias"), "target_kind", "canonical", "priority")


def class_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compiler.active(table(spark, sf_dir, "term_concept_class_map_df"))
    g = m.groupBy("concept_class").agg(F.array_sort(F.collect_list(F.struct("priority", "term"))).alias("t"))
    return g.select("concept_class", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("terms"))


def alias_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "event_df").filter("normalized_term is null and source_entity is not null").select(F.col("source_entity").alias("phrase"))
    return concepts.best_aliases(said, compiler.active(table(spark, sf_dir, "alias_to_canonical_df")))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 the 32 nearest of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.nearest_many(e, e.filter("vec_id % 100 = 0"), 32).select("query", "key", F.round("similarity", 5).alias("similarity"))


def patient_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by parts of names, with hyphens and case made alike in what is asked."""
    return compiler.referenced(table(spark, sf_dir, "patient_df"), ("Quin", "p000000012")).select("patient_id")


QUERIES: dict[str, Query] = {
    "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found,
    **{n: asked(t) for n, t in TREES.items()},
    **{f"{n}_joins": asked(TREES[n], joins=True) for n in ("term_absent_until_anchor", "bool_tree_nested")},
    **{n: asked(t) for n, t in TREND_TREES.items()},
    "interval_anchor": anchor_query("INTERVAL", None, ["first_day", "last_day"]), "start_anchor": anchor_query("EVENT", "start", ["day"]), "stop_anchor": anchor_query("EVENT", "stop", ["day"]),
    "baselines_build": baselines_build, "trends_build": trends_build, "pump_extrapolation": pump_extrapolation,
    "event_evidence_union": event_evidence_union, "event_summary_stats": event_summary_stats, "budget_group_count": budget_group_count, "context_dedup_first": context_dedup_first, "context_many": context_many, "trend_evidence": trend_evidence,
    "package_rows": _packed(lambda _: 10**9), "package_summaries": _packed(lambda e: cohort.group_count(e).first().n_groups), "package_header": package_header,
    **{n: answered(n) for n in QUESTIONS if n != "intent_unresolved"}, "intent_mappings": intent_mappings,
    "p2_impossible": p2_impossible, "p2_stuck": p2_stuck, "p6_clean": p6_clean,
    "active_aliases": active_aliases, "class_expansion": class_expansion, "alias_best_match": alias_best_match, "vector_topk": vector_topk, "patient_search": patient_search,
    **TEXT_QUERIES,
}

_FOUND = _who(f"{_term('lactate', 'e.value > 4 AND ' + _ON, _J['iv'])} AND ({_class('vasopressor', _within('-1000000000', '0'))} OR {_class('vasopressor', 'e.history')})")
EVIDENCE_SQL = f"""
found AS ({_FOUND}),
mine AS (SELECT e.* FROM event_df e WHERE patient_id IN (SELECT patient_id FROM found)),
evidence AS (
  SELECT e.* FROM mine e JOIN {IV} iv ON iv.patient_id = e.patient_id WHERE normalized_term = 'lactate' AND value > 4 AND {_ON}
  UNION ALL SELECT e.* FROM mine e JOIN {MAP_SQL} m ON m.term = e.normalized_term AND m.concept_class = 'vasopressor' WHERE {_within("-1000000000", "0")}
  UNION ALL SELECT e.* FROM mine e JOIN {MAP_SQL} m ON m.term = e.normalized_term AND m.concept_class = 'vasopressor' WHERE e.history
  UNION ALL SELECT e.* FROM mine e WHERE normalized_term = '{PUMP}'
)"""
_COLS = ", ".join(_EV)
#: A unit as it is compared, and the ways to write it.
_KEY = r"lower(regexp_replace(replace(replace({}, 'µ', 'u'), 'μ', 'u'), '[\s\x{{00a0}}.,;:]', '', 'g'))"
_SPELT = ", ".join(f"('{code}', '{way}')" for code, ways in units.SPELLINGS.items() for way in ways)
_SHOWN = f"patient_name IS NOT NULL AND age IS NOT NULL AND sex IS NOT NULL AND trim(coalesce(source_entity, ''), '\"') <> '{cohort.PUMP_ENTRY}'"
_FROM1 = _within("1", "1000000000")
_FEW = _who(f"p.patient_id IN ({', '.join(repr(r) for r in FEW_TREE['patient_references'])}) AND {_term('lactate', _within('1', '6'))} AND {_class('vasopressor')}")

SQL: dict[str, str] = {
    "p5_found": """
WITH used AS (
  SELECT e.patient_id, e.normalized_term,
         least(coalesce(day_offset_start, day_offset_end), coalesce(day_offset_end, day_offset_start)) AS a,
         greatest(coalesce(day_offset_start, day_offset_end), coalesce(day_offset_end, day_offset_start)) AS b
  FROM event_df e
  WHERE e.is_active AND NOT coalesce(e.history, false) AND coalesce(day_offset_start, day_offset_end) IS NOT NULL
    AND e.normalized_term IN (SELECT term FROM term_reference WHERE kind IN ('medication', 'device', 'condition'))
), marked AS (
  SELECT *, max(b) OVER (PARTITION BY patient_id, normalized_term ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM used
), grouped AS (
  SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id, normalized_term ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM marked
), periods AS (
  SELECT patient_id, normalized_term, g, min(a) AS a, max(b) AS b FROM grouped GROUP BY ALL
), gaps AS (
  SELECT patient_id, normalized_term, b + 1 AS a, lead(a) OVER (PARTITION BY patient_id, normalized_term ORDER BY a) - 1 AS b FROM periods
)
SELECT patient_id, normalized_term, 'period' AS stretch, CAST(a AS INTEGER) AS day_from, CAST(b AS INTEGER) AS day_to FROM periods
UNION ALL
SELECT patient_id, normalized_term, 'gap', CAST(a AS INTEGER), CAST(b AS INTEGER) FROM gaps WHERE b IS NOT NULL""",
    **TREE_SQL,
    **{f"{n}_joins": TREE_SQL[n] for n in ("term_absent_until_anchor", "bool_tree_nested")},
    **TREND_SQL,
    "interval_anchor": f"SELECT patient_id, a AS first_day, b AS last_day FROM {IV}",
    "start_anchor": f"SELECT patient_id, d AS day FROM {ST}",
    "stop_anchor": f"SELECT patient_id, d AS day FROM {SP}",
    "baselines_build": f"WITH {ANCHORED_SQL} SELECT patient_id, normalized_term, anchor, value, unit FROM anchored WHERE anchor IN ('admission_start', 'latest')",
    "trends_build": f"WITH {ANCHORED_SQL} SELECT * FROM trends",
    "pump_extrapolation": f"""
WITH s AS (
  SELECT patient_id, min(CASE WHEN is_started THEN day_offset_start END) AS a, max(CASE WHEN is_ended THEN coalesce(day_offset_end, day_offset_start) END) AS b
  FROM event_df WHERE normalized_term = '{PUMP}' GROUP BY 1
), d AS (SELECT patient_id, unnest(range(a, b + 1)) AS day FROM s WHERE b >= a)
SELECT patient_id, '{PUMP}' AS normalized_term, CAST(day AS INTEGER) AS day_offset_start, CAST(day AS INTEGER) AS day_offset_end, true AS is_active, '{cohort.PUMP_ENTRY}' AS source_entity FROM d""",
    "event_evidence_union": f"WITH {EVIDENCE_SQL} SELECT {', '.join('e.' + c for c in _EV)}, patient_name, age, sex FROM evidence e JOIN patient_df p ON p.patient_id = e.patient_id WHERE trim(coalesce(source_entity, ''), '\"') <> '{cohort.PUMP_ENTRY}'",
    "event_summary_stats": f"""WITH {EVIDENCE_SQL}, x AS (SELECT *, coalesce(day_offset_end, day_offset_start) AS d, min(value) OVER k AS lo, max(value) OVER k AS hi FROM evidence WINDOW k AS (PARTITION BY patient_id, normalized_term, unit, is_active, is_started, is_ended))
SELECT patient_id, normalized_term, unit, is_active, is_started, is_ended, count(*) AS n_total, count(value) AS n_numeric, min(value) AS min, max(value) AS max, median(value) AS median,
  round(stddev_samp(value), 3) AS std, min(day_offset_start) AS earliest_day, coalesce(max(day_offset_end), max(day_offset_start)) AS latest_day,
  CASE WHEN count(value) > 1 THEN min(CASE WHEN value = lo THEN d END) END AS min_day, CASE WHEN count(value) > 1 THEN min(CASE WHEN value = hi THEN d END) END AS max_day FROM x GROUP BY ALL""",
    "budget_group_count": f"""WITH {EVIDENCE_SQL} SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients,
  count(DISTINCT CASE WHEN patient_id IS NOT NULL AND normalized_term IS NOT NULL AND is_active IS NOT NULL AND is_started IS NOT NULL AND is_ended IS NOT NULL
    THEN concat_ws('|', patient_id, normalized_term, coalesce(unit, '_none_'), is_active, is_started, is_ended) END) AS n_groups FROM evidence""",
    "context_dedup_first": f"""WITH few AS ({_FEW}), mine AS (SELECT e.* FROM event_df e WHERE patient_id IN (SELECT patient_id FROM few)),
speaking AS (SELECT e.* FROM mine e WHERE normalized_term = 'lactate' AND {_within("1", "6")} UNION ALL SELECT e.* FROM mine e JOIN {MAP_SQL} m ON m.term = e.normalized_term AND m.concept_class = 'vasopressor'),
both_ AS (SELECT false AS context, {_COLS}, source_entity FROM speaking UNION ALL SELECT true, {_COLS}, source_entity FROM mine),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, normalized_term, day_offset_start, day_offset_end ORDER BY context, value ASC NULLS LAST, unit ASC NULLS LAST, event_id) AS rn FROM both_)
SELECT context, {_COLS}, CAST((SELECT count(*) FROM few) AS INTEGER) AS n_candidates FROM r WHERE rn = 1 AND trim(coalesce(source_entity, ''), '\"') <> '{cohort.PUMP_ENTRY}'""",
    "context_many": f"WITH {EVIDENCE_SQL} SELECT false AS context, {', '.join('e.' + c for c in _EV)}, CAST((SELECT count(*) FROM found) AS INTEGER) AS n_candidates FROM evidence e JOIN patient_df p ON p.patient_id = e.patient_id WHERE trim(coalesce(source_entity, ''), '\"') <> '{cohort.PUMP_ENTRY}'",
    "package_rows": f"WITH {EVIDENCE_SQL} SELECT e.patient_id, CAST(count(*) AS INTEGER) AS n, 'event' AS kind FROM evidence e JOIN patient_df p ON p.patient_id = e.patient_id WHERE {_SHOWN} GROUP BY 1",
    "package_summaries": f"""WITH {EVIDENCE_SQL} SELECT patient_id, CAST(count(*) AS INTEGER) AS n, 'summary' AS kind FROM (SELECT DISTINCT e.patient_id, normalized_term, unit, is_active, is_started, is_ended FROM evidence e JOIN patient_df p ON p.patient_id = e.patient_id
  WHERE {_SHOWN} AND is_active IS NOT NULL AND is_started IS NOT NULL AND is_ended IS NOT NULL) x GROUP BY 1""",
    "package_header": f"WITH {EVIDENCE_SQL} SELECT count(*) AS retrieved_candidates, 'cohort' AS query_scope, true AS subsampled, count(*) > 4 AS cta_allowed, true AS shown_some FROM found",
    "intent_resolved": _who(f"{_term('lactate', 'e.value > 4 AND ' + _ON, _J['iv'])} AND {_class('vasopressor', _within('-1000000000', '3'))}"),
    "intent_or": _who(f"{_term('mean arterial pressure', 'e.value < 50')} OR NOT {_class('sedative', _within('-1000000000', 'st.d'), _J['st'])}"),
    "intent_custom": _who(f"({_term('lactate', 'e.value > 4 AND ' + _FROM1)} OR ({_term('norepinephrine', _FROM1)} AND {_term('mean arterial pressure', 'e.value < 60 AND ' + _FROM1)})) AND {_term('heart rate', 'e.value > 100')}"),
    **dict.fromkeys(("intent_custom_flipped", "intent_custom_modifier"), _who(f"{_term('lactate', 'e.value <= 4')} AND ({_term('norepinephrine')} OR {_term('mean arterial pressure', 'e.value >= 60')})")),
    "intent_mappings": """SELECT * FROM (VALUES ('intent_resolved', 'Serum_Lactate', 'lactate'), ('intent_resolved', 'Impella  Device', 'left heart pump'), ('intent_resolved', 'pressors', 'vasopressor'), ('intent_or', 'mean arterial presure', 'mean arterial pressure'),
  ('intent_or', 'sedation', 'sedative'), ('intent_or', 'lv unloading device', 'left heart pump'), ('intent_custom', 'Shock', 'shock'), ('intent_custom', 'hr', 'heart rate'), ('intent_custom_flipped', 'calm circulation', 'shock'), ('intent_custom_modifier', 'circulation', 'shock'),
  ('intent_unresolved', 'lac', 'lactate'), ('intent_unresolved', 'hr', 'heart rate'), ('intent_unresolved', 'moon phase', NULL), ('intent_unresolved', 'sunrise', NULL)) v(question, phrase, canonical)""",
    "p2_impossible": """SELECT event_id FROM event_df e JOIN unit_reference u ON u.term = e.normalized_term AND u.unit_code = e.unit JOIN term_reference r ON r.term = e.normalized_term AND r.kind = 'measurement'
  WHERE NOT isnan(value) AND (value * factor + "shift" < phys_low - 1e-6 * greatest(abs(phys_low), abs(phys_high)) OR value * factor + "shift" > phys_high + 1e-6 * greatest(abs(phys_low), abs(phys_high)))""",
    "p2_stuck": f"""WITH sp(code, spelt) AS (VALUES {_SPELT}), un AS (SELECT term, unit_code, any_value(factor) AS factor, any_value("shift") AS "shift", unit_code AS spelt FROM unit_reference GROUP BY ALL),
ways AS (SELECT term, k, min(unit_code) AS unit_code FROM (SELECT term, unit_code, {_KEY.format('unit_code')} AS k FROM un UNION ALL SELECT term, unit_code, {_KEY.format('sp.spelt')} FROM un JOIN sp ON sp.code = un.unit_code) w GROUP BY 1, 2),
x0 AS (SELECT e.*, w.unit_code FROM event_df e LEFT JOIN ways w ON w.term = e.normalized_term AND w.k = {_KEY.format('e.unit')}),
x AS (SELECT e.*, coalesce(charted_at, loaded_at, TIMESTAMP '1970-01-01 00:00:00') AS t FROM x0 e WHERE patient_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
d AS (SELECT DISTINCT patient_id, normalized_term, t, value, unit, unit_code, source_entity, day_offset_start, day_offset_end, is_active, is_started, is_ended, history FROM x WHERE normalized_term IN (SELECT term FROM term_reference WHERE kind = 'measurement')),
clean AS (SELECT patient_id, normalized_term FROM (SELECT patient_id, normalized_term, t, count(*) AS c, bool_and(unit_code IS NOT NULL) AS ok FROM d GROUP BY 1, 2, 3) y GROUP BY 1, 2 HAVING max(c) = 1 AND bool_and(ok)),
r AS (SELECT d.patient_id, d.normalized_term, d.t, d.value, d.unit_code, coalesce(d.value = lag(d.value) OVER w AND d.unit_code = lag(d.unit_code) OVER w, false) AS same, row_number() OVER w AS rn, count(*) OVER (PARTITION BY d.patient_id, d.normalized_term) AS n
  FROM d JOIN clean c ON c.patient_id = d.patient_id AND c.normalized_term = d.normalized_term WINDOW w AS (PARTITION BY d.patient_id, d.normalized_term ORDER BY d.t)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY patient_id, normalized_term ORDER BY t) AS g FROM r), z AS (SELECT *, count(*) OVER (PARTITION BY patient_id, normalized_term, g) AS size FROM g),
s AS (SELECT patient_id, normalized_term, sum(CASE WHEN rn > 1 AND NOT (size >= 6 AND same) THEN 1 ELSE 0 END) AS pairs, sum(CASE WHEN same AND size < 6 THEN 1 ELSE 0 END) AS ties FROM z GROUP BY 1, 2),
m AS (SELECT normalized_term, sum(CASE WHEN same THEN 1 ELSE 0 END) <= 0.5 * sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS moving FROM z GROUP BY 1),
f AS (SELECT z.* FROM z JOIN s ON s.patient_id = z.patient_id AND s.normalized_term = z.normalized_term JOIN m ON m.normalized_term = z.normalized_term JOIN un u ON u.term = z.normalized_term AND u.unit_code = z.unit_code JOIN term_reference q ON q.term = z.normalized_term
  WHERE size >= 6 AND n >= 8 AND pairs > 0 AND ties <= 0.5 * pairs AND moving AND z.value * u.factor + u."shift" BETWEEN coalesce(q.phys_low, -1e300) AND coalesce(q.phys_high, 1e300))
SELECT x.event_id FROM x JOIN f ON f.patient_id = x.patient_id AND f.normalized_term = x.normalized_term AND f.t = x.t""",
    "p6_clean": """WITH x AS (SELECT 'event_df' AS source_table, event_id AS row_id, normalized_term, value, unit FROM event_df UNION ALL SELECT 'baselines_df', baseline_id, normalized_term, value, unit FROM baselines_df)
SELECT source_table, row_id, normalized_term, unit AS unit_code, factor <> 1 OR "shift" <> 0 AS other, round(value * factor + "shift", 4) AS value_common FROM x JOIN unit_reference u ON u.term = normalized_term AND u.unit_code = unit WHERE value IS NOT NULL AND NOT isnan(value)""",
    "trend_evidence": f"WITH {ANCHORED_SQL} SELECT t.*, patient_name, age, sex FROM trends t JOIN patient_df p ON p.patient_id = t.patient_id WHERE normalized_term = 'creatinine' AND anchor1 = 'admission_start' AND anchor2 = 'latest' AND change = 'uptrended'",
    "active_aliases": r"""SELECT alias_id, lower(trim(regexp_replace(regexp_replace(alias, '[-_]', ' ', 'g'), '\s+', ' ', 'g'))) AS alias, target_kind, canonical, coalesce(priority, 100) AS priority
FROM alias_to_canonical_df WHERE coalesce(status, 'active') = 'active'""",
    # the table of the longest common subsequence, a row for each letter of the phrase, running maxima along a row
    "alias_best_match": r"""WITH norm AS (SELECT DISTINCT lower(trim(regexp_replace(source_entity, '[-_\s]+', ' ', 'g'))) AS phrase FROM event_df WHERE normalized_term IS NULL AND source_entity IS NOT NULL),
a AS (SELECT lower(trim(regexp_replace(alias, '[-_\s]+', ' ', 'g'))) AS alias, target_kind, canonical, coalesce(priority, 100) AS priority FROM alias_to_canonical_df WHERE coalesce(status, 'active') = 'active'),
j AS (SELECT phrase, alias FROM norm, (SELECT DISTINCT alias FROM a) b WHERE phrase <> '' AND alias <> '' AND levenshtein(phrase, alias) <= (length(phrase) + length(alias)) * 0.08 + 1e-9),
l AS (SELECT phrase, alias, string_split(alias, '') AS b FROM j),
t AS (SELECT phrase, alias, list_reduce(string_split(phrase, ''), lambda acc, ch: list_transform(range(1, len(b) + 1), lambda q: list_max(list_transform(range(1, q + 1), lambda k: CASE WHEN b[k] = ch THEN coalesce(acc[k - 1], 0) + 1 ELSE acc[k] END))), list_transform(b, lambda z: CAST(0 AS BIGINT))) AS r FROM l),
s AS (SELECT phrase, alias, 200.0 * r[len(r)] / (length(phrase) + length(alias)) AS score FROM t),
w AS (SELECT s.phrase, target_kind, canonical, s.alias, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY s.phrase, target_kind ORDER BY score DESC, priority, canonical, s.alias) AS rn FROM s JOIN a ON a.alias = s.alias WHERE score >= CASE WHEN length(s.phrase) < 6 AND length(s.alias) < 6 THEN 97 ELSE 92 END)
SELECT phrase, target_kind, canonical, alias, score FROM w WHERE rn = 1""",
    "class_expansion": "SELECT concept_class, string_agg(term, ', ' ORDER BY coalesce(priority, 100), term) AS terms FROM term_concept_class_map_df WHERE coalesce(status, 'active') = 'active' GROUP BY 1",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query, v.vec_id AS key, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, key) AS rn FROM s) SELECT query, key, round(similarity, 5) AS similarity FROM r WHERE rn <= 32""",
    "patient_search": "SELECT patient_id FROM patient_df WHERE patient_id IN ('quin', 'p000000012') OR patient_name ILIKE '%quin%' OR patient_name ILIKE '%p000000012%'",
    **TEXT_SQL,
}
