"""Boolean temporal predicates over patients, as DataFrames.

Two physical forms give the same patients. ``candidates`` is the one to run: every leaf becomes a condition on the
event rows, all of them are evaluated in one pass, and one aggregation by patient turns them into flags over which the
tree is a boolean column; cost grows with the number of distinct anchors, not of leaves. ``candidates_by_joins`` gives
each leaf a semi-join of its own and serves to check the first.
"""

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import normalized
from wardline.plans.ir import Anchor, IntentError, Leaf, Node, Temporal, leaves, scoped

INF = 10**9
COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "=": operator.eq, "!=": operator.ne}


@dataclass(frozen=True)
class Catalog:
    """The tables of a cohort. class_map holds active rows only (see active_class_map)."""

    patients: DataFrame
    events: DataFrame
    class_map: DataFrame
    baselines: DataFrame | None = None
    trends: DataFrame | None = None
    device: str = "left heart pump"


def active(df: DataFrame) -> DataFrame:
    """Rows whose status is active, a null one counting as active, and a null priority as 100."""
    return df.filter(F.coalesce("status", F.lit("active")) == "active").withColumn("priority", F.coalesce("priority", F.lit(100)))


@dataclass(frozen=True)
class Bound:
    """One end of a window: a day, or a column of an anchor plus an offset."""

    day: int = 0
    column: str | None = None
    anchor: Anchor | None = None

    def value(self) -> Column:
        return F.lit(self.day) if self.column is None else F.col(self.column) + F.lit(self.day)


@dataclass(frozen=True)
class Window:
    low: Bound
    high: Bound
    with_history: bool = False

    @property
    def anchors(self) -> list[Anchor]:
        return [b.anchor for b in (self.low, self.high) if b.anchor is not None]


def anchor_name(a: Anchor) -> str:
    """A name for the days of an anchor that any term can have."""
    return "_a" + "".join(c if c.isalnum() and c.isascii() else f"_{ord(c):x}_" for c in f"{a.kind}|{a.event}|{a.term}")


def bound(a: Anchor, upper: bool) -> Bound:
    """The bound that an anchor gives; an event without a kind of change, or an unknown kind, stands for the admission day."""
    if a.form == "admission":
        return Bound(a.day_offset)
    if a.form == "concept" and a.kind == "INTERVAL":
        return Bound(a.day_offset, anchor_name(a) + ("_stop" if upper else "_start"), a)
    if a.form == "concept" and a.kind == "EVENT" and a.event in ("start", "stop"):
        return Bound(a.day_offset, anchor_name(a) + "_day", a)
    return Bound(0)


def window(temporal: tuple[Temporal, ...]) -> Window:
    """Days that a scope covers, both ends included."""
    low, high = Bound(-INF), Bound(INF)
    if not temporal:
        return Window(low, high)
    if len(temporal) == 1:
        t = temporal[0]
        if t.relation == "FROM":
            return Window(bound(t.anchor, False), high)
        if t.relation == "UNTIL":
            b = bound(t.anchor, True)
            return Window(low, b, t.anchor.form == "admission" and t.anchor.day_offset <= 0)
        if t.relation == "OVERLAPS" and t.anchor.form in ("admission", "concept"):
            return Window(bound(t.anchor, False), bound(t.anchor, True))
        return Window(Bound(0), Bound(0))
    if [t.relation for t in temporal] != ["FROM", "UNTIL"]:
        raise IntentError(["temporal: two entries must be FROM, then UNTIL"])
    return Window(bound(temporal[0].anchor, False), bound(temporal[1].anchor, True))


def mode(temporal: tuple[Temporal, ...]) -> str:
    if len(temporal) == 1 and temporal[0].relation in ("HISTORY", "BASELINE"):
        return temporal[0].relation.lower()
    return "window"


def anchor_days(events: DataFrame, a: Anchor) -> DataFrame:
    """patient_id and the days of an anchor: first start and last end while active, or first start, or last end."""
    name = anchor_name(a)
    e = events.filter(F.col("normalized_term") == normalized(a.term))
    if a.kind == "INTERVAL":
        e = e.filter("is_active")
        return e.groupBy("patient_id").agg(F.min("day_offset_start").alias(name + "_start"), F.max(F.coalesce("day_offset_end", "day_offset_start")).alias(name + "_stop"))
    if a.event == "start":
        return e.filter("is_started").groupBy("patient_id").agg(F.min("day_offset_start").alias(name + "_day"))
    return e.filter("is_ended").groupBy("patient_id").agg(F.max("day_offset_end").alias(name + "_day"))


#: Trend anchors of the device by relation, event of the device: fixed values.
DEVICE_TRENDS = {
    ("OVERLAPS", None): ("pump_earliest", "pump_latest"),
    ("OVERLAPS", "start"): ("prepump_latest", "pump_earliest"),
    ("OVERLAPS", "stop"): ("pump_latest", "postpump_earliest"),
    ("UNTIL", "stop"): ("prepump", "pump"),
    ("UNTIL", "start"): ("admission_start", "prepump_latest"),
    ("UNTIL", None): ("admission_start", "pump"),
    ("FROM", "start"): ("pump", "admission_end"),
    ("FROM", None): ("pump", "admission_end"),
    ("FROM", "stop"): ("postpump_earliest", "admission_end"),
}


def trend_anchors(temporal: tuple[Temporal, ...], device: str) -> tuple[str, str]:
    """The pair of anchors that a scope means for a trend; IntentError for scopes that no trend is kept for."""
    if not temporal:
        return ("admission_start", "latest")
    on_device = lambda a: a.form == "concept" and normalized(a.term or "") == normalized(device)
    if len(temporal) == 1:
        t = temporal[0]
        if on_device(t.anchor) and (t.relation, t.anchor.event) in DEVICE_TRENDS:
            return DEVICE_TRENDS[t.relation, t.anchor.event]
        if t.anchor.form == "admission" and t.anchor.day_offset in (0, 999) and t.relation not in ("HISTORY", "BASELINE"):
            return ("admission_start", "admission_end")
    elif len(temporal) == 2:
        a, b = temporal
        if (a.relation, b.relation) == ("FROM", "UNTIL") and on_device(a.anchor) and on_device(b.anchor) and (a.anchor.event, b.anchor.event) == ("start", "stop"):
            return ("pump_earliest", "pump_latest")
    raise IntentError(["unsupported trend anchor"])


# conditions on rows of events, trends and baselines ------------------------------------------------------------------


def overlaps(w: Window) -> Column:
    start, end = F.coalesce("day_offset_start", "day_offset_end", F.lit(0)), F.coalesce("day_offset_end", "day_offset_start", F.lit(0))
    return (start <= w.high.value()) & (end >= w.low.value())


def early() -> Column:
    return (F.coalesce("day_offset_end", "day_offset_start") <= 2) | F.col("history")


def measure(leaf: Leaf, literal_units: bool = False) -> list[Column]:
    out = []
    if leaf.numeric:
        out.append(COMPARE[leaf.op](F.col("value"), F.lit(leaf.value)))
    if leaf.unit:
        out.append(F.contains(F.lower("unit"), F.lit(leaf.unit.lower())) if literal_units else F.col("unit").ilike(f"%{leaf.unit}%"))
    return out


def is_true(conds: list[Column]) -> Column:
    return F.coalesce(reduce(operator.and_, conds), F.lit(False))


@dataclass
class _Build:
    """Collects the flags that the leaves of a tree need, each computed once."""

    catalog: Catalog
    literal_units: bool = False
    strict: bool = False
    events: dict[str, Column] = field(default_factory=dict)
    event_terms: set[str] = field(default_factory=set)
    event_classes: set[str] = field(default_factory=set)
    trends: dict[str, Column] = field(default_factory=dict)
    baselines: dict[str, Column] = field(default_factory=dict)
    anchors: dict[str, Anchor] = field(default_factory=dict)
    known: dict[tuple, str] = field(default_factory=dict)

    def flag(self, where: str, about: tuple, cond: Column) -> Column:
        table = getattr(self, where)
        if (where, *about) not in self.known:
            self.known[where, *about] = name = f"_{where}{len(table)}"
            table[name] = cond
        return F.coalesce(F.col(self.known[where, *about]), F.lit(False))

    def targets(self, leaf: Leaf) -> list[tuple[str, str, Column]]:
        out = []
        if leaf.term:
            self.event_terms.add(leaf.term)
            out.append(("term", leaf.term, F.col("normalized_term") == leaf.term))
        if leaf.concept_class:
            self.event_classes.add(leaf.concept_class)
            out.append(("class", leaf.concept_class, F.array_contains("_classes", leaf.concept_class)))
        return out

    def leaf(self, leaf: Leaf) -> Column | None:
        """A boolean of the flags; None where the leaf says nothing."""
        m = mode(leaf.temporal)
        parts = []
        if leaf.is_trend:
            pair = trend_anchors(leaf.temporal, self.catalog.device)
            change = leaf.modifier.strip().lower()
            for kind, name, at in self.targets(leaf):
                parts.append(self.flag("trends", (kind, name, *pair, change), is_true([at, F.col("anchor1") == pair[0], F.col("anchor2") == pair[1], F.col("change") == change])))
            return reduce(operator.or_, parts) if parts else None
        w = window(leaf.temporal) if m == "window" else None
        if w:
            for a in w.anchors:
                self.anchors[anchor_name(a)] = a
        what = () if leaf.is_absent else (leaf.op, leaf.value, leaf.unit)
        extra = [] if leaf.is_absent else measure(leaf, self.literal_units)
        for kind, name, at in self.targets(leaf):
            base = [at, F.col("is_active"), *extra]
            if m == "history":
                found = self.flag("events", (kind, name, "history", *what), is_true([*base, F.col("history")]))
            elif m == "baseline" and leaf.numeric and not leaf.is_absent:
                found = self.flag("baselines", (kind, name, *what), is_true([at, F.col("anchor") == "admission_start", *extra]))
            elif m == "baseline":
                found = self.flag("events", (kind, name, "baseline", *what), is_true([*base, early()]))
            else:
                reach = overlaps(w) | F.col("history") if w.with_history else overlaps(w)
                found = self.flag("events", (kind, name, w, *what), is_true([*base, reach]))
            parts.append(~found if leaf.is_absent else found)
        if not parts:
            return None
        return reduce(operator.and_ if leaf.is_absent else operator.or_, parts)

    def tree(self, node: Node | Leaf) -> Column | None:
        if isinstance(node, Leaf):
            return self.leaf(node)
        parts = [c for c in (self.tree(x) for x in node.children) if c is not None]
        if not parts:
            return F.lit(False) if node.logic == "OR" else None
        return reduce(operator.or_ if node.logic == "OR" else operator.and_, parts)


def with_classes(df: DataFrame, class_map: DataFrame, classes: set[str]) -> DataFrame:
    """df with _classes, the array of those of the classes that its term belongs to. The map is a dimension table."""
    if not classes:
        return df.withColumn("_classes", F.array().cast("array<string>"))
    of = class_map.filter(F.col("concept_class").isin(*sorted(classes))).groupBy(F.col("term").alias("normalized_term")).agg(F.collect_set("concept_class").alias("_classes"))
    return df.join(of, "normalized_term", "left")


def referenced(patients: DataFrame, refs: tuple[str, ...]) -> DataFrame:
    """Patients whose id equals, or whose name contains, one of the references; all of them without references."""
    refs = tuple(r for r in (normalized(x) for x in refs) if r)
    if not refs:
        return patients
    cond = [(F.col("patient_id").cast("string") == r) | F.col("patient_name").ilike(f"%{r}%") for r in refs]
    return patients.filter(F.coalesce(reduce(operator.or_, cond), F.lit(False)))


def flags_of(rows: DataFrame, class_map: DataFrame, conds: dict[str, Column], terms: set[str], classes: set[str], anchors: list[DataFrame]) -> DataFrame:
    """patient_id and one boolean for each condition that some row of the patient meets."""
    some = F.col("normalized_term").isin(*sorted(terms)) if terms else F.lit(False)
    if classes:
        of = class_map.filter(F.col("concept_class").isin(*sorted(classes))).select(F.col("term").alias("normalized_term")).distinct()
        if terms:
            of = of.unionByName(of.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "normalized_term string")).distinct()
        rows = rows.join(F.broadcast(of), "normalized_term", "left_semi")  # terms of a class map: a dimension table
    else:
        rows = rows.filter(some)
    rows = with_classes(rows, class_map, classes)
    for a in anchors:
        rows = rows.join(a, "patient_id", "left")
    return rows.groupBy("patient_id").agg(*[F.max(c).alias(n) for n, c in conds.items()])


def candidates(catalog: Catalog, tree: Node | Leaf, literal_units: bool = False) -> DataFrame:
    """patient_id of the patients for whom the tree is true, each once."""
    patients = referenced(catalog.patients, tree.patient_references if isinstance(tree, Node) else ())
    b = _Build(catalog, literal_units)
    truth = b.tree(scoped(tree))
    out = patients.select("patient_id").distinct()
    if truth is None:
        return out
    days = [anchor_days(catalog.events, a) for a in b.anchors.values()]
    for conds, rows, more in ((b.events, catalog.events, days), (b.baselines, catalog.baselines, []), (b.trends, catalog.trends, [])):
        if conds:
            out = out.join(flags_of(rows, catalog.class_map, conds, b.event_terms, b.event_classes, more), "patient_id", "left")
    return out.filter(truth).select("patient_id")


def explained(catalog: Catalog, tree: Node | Leaf) -> str:
    """The physical plan of a tree, with its scans, pushed filters and exchanges, for looking into a question."""
    jdf = candidates(catalog, tree)._jdf
    return jdf.queryExecution().explainString(catalog.patients.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def candidates_by_joins(catalog: Catalog, tree: Node | Leaf, literal_units: bool = False) -> DataFrame:
    """The same patients, each leaf by a join of its own."""
    patients = referenced(catalog.patients, tree.patient_references if isinstance(tree, Node) else ()).select("patient_id").distinct()

    def having(leaf: Leaf) -> DataFrame | None:
        b = _Build(catalog, literal_units)
        truth = b.leaf(leaf)
        if truth is None:
            return None
        sets = []
        for where, rows in (("events", catalog.events), ("baselines", catalog.baselines), ("trends", catalog.trends)):
            for cond in getattr(b, where).values():
                r = with_classes(rows, catalog.class_map, b.event_classes)
                for a in b.anchors.values():
                    r = r.join(anchor_days(catalog.events, a), "patient_id")
                sets.append(r.filter(cond).select("patient_id").distinct())
        if leaf.is_absent:
            return reduce(lambda p, s: p.join(s, "patient_id", "left_anti"), sets, patients)
        return patients.join(reduce(DataFrame.union, sets).distinct(), "patient_id", "left_semi")

    def of(node: Node | Leaf) -> DataFrame | None:
        if isinstance(node, Leaf):
            return having(node)
        parts = [d for d in (of(c) for c in node.children) if d is not None]
        if not parts:
            return patients.filter(F.lit(False)) if node.logic == "OR" else None
        if node.logic == "OR":
            return reduce(DataFrame.union, parts).distinct()
        return reduce(lambda x, y: x.join(y, "patient_id", "left_semi"), parts)

    out = of(scoped(tree))
    return patients if out is None else out


def all_anchor_terms(tree: Node | Leaf) -> list[str]:
    """Normalised terms of all concept anchors in scope somewhere."""
    found = {normalized(t.anchor.term) for x in leaves(scoped(tree)) for t in x.temporal if t.anchor.form == "concept" and t.anchor.term}
    return sorted(t for t in found if t)
