"""Baselines, trends, device persistence and evidence rows of a cohort."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.catalog import bounded_rows
from wardline.functions.text import strict_number
from wardline.plans.compiler import Catalog, all_anchor_terms, anchor_days, anchor_name, early, measure, mode, overlaps, trend_anchors, window
from wardline.plans.ir import Leaf, Node, leaves, scoped

PUMP_ENTRY = "extrapolated pump entry"
KEYS = ["patient_id", "normalized_term", "unit"]
#: Pairs of anchors that trends are kept for: fixed values.
TREND_PAIRS = (
    ("admission_start", "latest"), ("pump_earliest", "pump_latest"), ("prepump_latest", "pump_earliest"), ("pump_latest", "postpump_earliest"), ("prepump", "pump"),
    ("admission_start", "prepump_latest"), ("admission_start", "pump"), ("pump", "admission_end"), ("postpump_earliest", "admission_end"), ("admission_start", "admission_end"),
)


#: The anchors that readings are marked with.
ANCHORS = ("admission_start", "admission_end", "latest", "prepump", "prepump_latest", "pump", "pump_earliest", "pump_latest", "postpump_earliest")


def anchored(events: DataFrame, device: str = "left heart pump", names: tuple[str, ...] = ANCHORS, of: Column | None = None) -> DataFrame:
    """patient_id, normalized_term, unit, anchor, value, first_day, last_day, n: medians of numeric readings around admission and device.

    Rows used are active, not history, with a value and a day. admission_start is the first day in 0..2 with a value,
    latest the last one; admission_end the last charted day of the patient; prepump, pump and postpump lie before,
    within and after the days of the device (first start to last end), ..._earliest and ..._latest are the first and
    last day of those. Only the anchors ``names`` of the rows ``of`` are made, and only what these need is read. All
    anchors of a key come from one grouping by key and day, so no reading is shuffled twice. The median is exact and
    taken over the readings of one key and anchor.
    """
    day = F.coalesce("day_offset_start", "day_offset_end")
    used = events.filter(F.col("is_active") & ~F.coalesce("history", F.lit(False)) & F.col("value").isNotNull() & day.isNotNull() & F.col("normalized_term").isNotNull())
    used = used.select(*KEYS, "value", day.alias("day"))
    x = used if of is None else used.filter(of)
    if "admission_end" in names:
        x = x.join(used.groupBy("patient_id").agg(F.max("day").alias("_end")), "patient_id")
    else:
        x = x.withColumn("_end", F.lit(None).cast("int"))
    if any("pump" in n for n in names):
        on = events.filter((F.col("normalized_term") == device) & F.col("is_active"))
        x = x.join(on.groupBy("patient_id").agg(F.min("day_offset_start").alias("_on"), F.max(F.coalesce("day_offset_end", "day_offset_start")).alias("_off")), "patient_id", "left")
    else:
        x = x.withColumns({"_on": F.lit(None).cast("int"), "_off": F.lit(None).cast("int")})
    pre, during, post = F.col("day") < F.col("_on"), (F.col("day") >= F.col("_on")) & (F.col("day") <= F.col("_off")), F.col("day") > F.col("_off")
    start = (F.col("day") >= 0) & (F.col("day") <= 2)
    at = {
        "admission_start": F.min(F.when(start, F.col("day"))), "latest": F.max("day"), "prepump_latest": F.max(F.when(pre, F.col("day"))), "pump_earliest": F.min(F.when(during, F.col("day"))),
        "pump_latest": F.max(F.when(during, F.col("day"))), "postpump_earliest": F.min(F.when(post, F.col("day"))),
    }
    at = {f"_{n}": c for n, c in at.items() if n in names}
    if at:
        days = x.groupBy(*KEYS).agg(*[c.alias(n) for n, c in at.items()])
        x = x.join(days.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *at), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    d = F.col("day")
    among = {"prepump": pre, "pump": during, "admission_end": d == F.col("_end"), "prepump_latest": pre, "pump_earliest": during, "pump_latest": during, "postpump_earliest": post}
    meets = {n: among.get(n, F.lit(True)) & (d == F.col(f"_{n}")) if f"_{n}" in at else among[n] for n in ANCHORS if n in names}
    marked = x.select(*KEYS, "value", "day", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in meets.items()]), lambda a: a.isNotNull())).alias("anchor"))
    return marked.groupBy(*KEYS, "anchor").agg(F.median("value").alias("value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


def baselines(events: DataFrame, device: str = "left heart pump") -> DataFrame:
    """patient_id, normalized_term, anchor, value, unit for the anchors admission_start and latest."""
    return anchored(events, device, ("admission_start", "latest")).select("patient_id", "normalized_term", "anchor", "value", "unit")


def trends(events: DataFrame, device: str = "left heart pump", tolerance: float = 0.10, pairs: tuple[tuple[str, str], ...] = TREND_PAIRS, of: Column | None = None) -> DataFrame:
    """Change of the median between two anchors, for pairs of anchors (those that trends are kept for) and the rows ``of``.

    change is uptrended or downtrended where the difference exceeds the tolerance as a share of the first median.
    """
    a = anchored(events, device, tuple(n for n in ANCHORS if any(n in p for p in pairs)), of)
    by = a.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("anchor", F.struct("value", "first_day", "last_day")))).alias("m"))
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("anchor1"), F.lit(y).alias("anchor2")) for x, y in pairs])).alias("p")
    t = by.select(*KEYS, "m", each).select(*KEYS, "p.*", F.try_element_at("m", F.col("p.anchor1")).alias("x"), F.try_element_at("m", F.col("p.anchor2")).alias("y")).filter("x is not null and y is not null")
    delta, room = F.col("y.value") - F.col("x.value"), tolerance * F.abs(F.col("x.value"))
    change = F.when(delta > room, "uptrended").when(delta < -room, "downtrended").otherwise("unchanged")
    return t.select(
        *KEYS, "anchor1", "anchor2", change.alias("change"), F.col("x.first_day").alias("anchor1_start"), F.col("x.last_day").alias("anchor1_end"),
        F.col("y.first_day").alias("anchor2_start"), F.col("y.last_day").alias("anchor2_end"), F.col("x.value").alias("val_start"), F.col("y.value").alias("val_end"), delta.alias("delta"),
    )


def trends_for(events: DataFrame, class_map: DataFrame, tree: Node | Leaf, device: str = "left heart pump") -> DataFrame | None:
    """The trends that the leaves of a tree ask for: their terms and pairs of anchors, and no others; None without such leaves."""
    asked = [x for x in leaves(scoped(tree)) if x.is_trend]
    if not asked:
        return None
    pairs = tuple(dict.fromkeys(trend_anchors(x.temporal, device) for x in asked))
    terms, classes = {x.term for x in asked if x.term}, {x.concept_class for x in asked if x.concept_class}
    if classes:
        of = class_map.filter(F.col("concept_class").isin(*sorted(classes))).select("term").distinct()
        terms |= {r.term for r in bounded_rows(of, MAX_TERMS, "the class map")}
    return trends(events, device, pairs=pairs, of=F.col("normalized_term").isin(*sorted(t for t in terms if t)))


#: Terms of the classes of one question at most.
MAX_TERMS = 100_000
#: Days that are written out from one array.
STRETCH = 10_000


def device_days(events: DataFrame, device: str = "left heart pump") -> DataFrame:
    """One active row for every day between the start and the stop of the device of each patient, marked as made.

    Columns: patient_id, normalized_term, day_offset_start, day_offset_end, is_active, source_entity. A patient without
    a stop, or whose stop lies before the start, gets none.
    """
    e = events.filter(F.col("normalized_term") == device)
    span = e.groupBy("patient_id").agg(F.min(F.when(F.col("is_started"), F.col("day_offset_start"))).alias("a"), F.max(F.when(F.col("is_ended"), F.coalesce("day_offset_end", "day_offset_start"))).alias("b"))
    span = span.filter(F.col("b") >= F.col("a")).select("patient_id", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    # in stretches, so that no array of days is long
    part = span.select("patient_id", "b", F.explode(F.sequence("a", "b", F.lit(STRETCH).cast("bigint"))).alias("from"))
    d = part.select("patient_id", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH - 1, F.col("b")))).alias("day")).withColumn("day", F.col("day").cast("int"))
    return d.select("patient_id", F.lit(device).alias("normalized_term"), F.col("day").alias("day_offset_start"), F.col("day").alias("day_offset_end"), F.lit(True).alias("is_active"), F.lit(PUMP_ENTRY).alias("source_entity"))


def is_made(c: Column) -> Column:
    """Whether a source_entity marks a row that was made; null does not."""
    return F.regexp_replace(c, '^"+|"+$', "").eqNullSafe(F.lit(PUMP_ENTRY))


# evidence ------------------------------------------------------------------------------------------------------------

DROPPED = ("is_worsening", "level_entry")


def _about(rows: DataFrame, catalog: Catalog, leaf: Leaf) -> list[DataFrame]:
    out = []
    if leaf.term:
        out.append(rows.filter(F.col("normalized_term") == leaf.term))
    if leaf.concept_class:
        m = catalog.class_map.filter(F.col("concept_class") == leaf.concept_class).select(F.col("term").alias("normalized_term"))
        out.append(rows.join(m, "normalized_term").select(*rows.columns))
    return out


def event_evidence(catalog: Catalog, tree: Node | Leaf, patients: DataFrame) -> DataFrame | None:
    """Event rows that speak for the leaves, of the given patients, and all rows of the anchor terms; repeats are kept.

    Scope, threshold and unit of a leaf hold, whether a row is active does not matter. Trend leaves give none.
    Demographics are added, columns for internal use and made device rows left out; sorted by patient, days and term.
    """
    mine = catalog.events.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    parts = []
    for leaf in leaves(scoped(tree)):
        if leaf.is_trend:
            continue
        m = mode(leaf.temporal)
        for rows in _about(mine, catalog, leaf):
            for c in measure(leaf):
                rows = rows.filter(c)
            if m == "history":
                parts.append(rows.filter("history"))
            elif m == "baseline":
                parts.append(rows.filter(early()))
            else:
                w = window(leaf.temporal)
                within = rows
                for a in {anchor_name(a): a for a in w.anchors}.values():
                    within = within.join(anchor_days(catalog.events, a), "patient_id")
                parts.append(within.filter(overlaps(w)).select(*rows.columns))
                if w.with_history:
                    parts.append(rows.filter("history"))
    parts += [mine.filter(F.col("normalized_term") == t) for t in all_anchor_terms(tree)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def presented(rows: DataFrame, patients: DataFrame) -> DataFrame:
    """With name, age and sex in front, without internal columns and made rows, ordered."""
    d = rows.drop(*DROPPED).filter(~is_made(F.col("source_entity"))) if "source_entity" in rows.columns else rows.drop(*DROPPED)
    d = d.join(patients.select("patient_id", "patient_name", "age", "sex"), "patient_id")
    lead = ["patient_id", "patient_name", "age", "sex"]
    return d.select(*lead, *[c for c in d.columns if c not in lead])


def ordered(rows: DataFrame) -> DataFrame:
    by = [c for c in ("context", "patient_id", "day_offset_start", "day_offset_end", "normalized_term") if c in rows.columns]
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in by])


def trend_evidence(catalog: Catalog, tree: Node | Leaf, patients: DataFrame) -> DataFrame | None:
    """Trend rows of the trend leaves, of the given patients, with demographics; repeats are kept, no order is set."""
    wanted = [x for x in leaves(scoped(tree)) if x.is_trend]
    if not wanted:
        return None
    mine = catalog.trends.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    parts = []
    for leaf in wanted:
        a, b = trend_anchors(leaf.temporal, catalog.device)
        parts += [r.filter((F.col("anchor1") == a) & (F.col("anchor2") == b) & (F.col("change") == leaf.modifier.strip().lower())) for r in _about(mine, catalog, leaf)]
    return presented(reduce(DataFrame.unionByName, parts), catalog.patients) if parts else None


def with_context(evidence: DataFrame, catalog: Catalog, patients: DataFrame, n_patients: int, most: int = 10) -> DataFrame:
    """Evidence marked context = false; for up to ``most`` patients all their events are added as context = true.

    Of rows equal in patient, term and days the first is kept, evidence before context, then by value and unit; this
    is done only where context was added. Rows are ordered.
    """
    e = evidence.withColumn("context", F.lit(False))
    if n_patients > most:
        return ordered(presented(e, catalog.patients))
    ctx = catalog.events.join(patients.select("patient_id").distinct(), "patient_id", "left_semi").withColumn("context", F.lit(True))
    both = e.unionByName(ctx)
    tie = [c for c in ("value", "unit", "event_id") if c in both.columns]
    w = Window.partitionBy("patient_id", "normalized_term", "day_offset_start", "day_offset_end").orderBy("context", *[F.col(c).asc_nulls_last() for c in tie])
    return ordered(presented(both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"), catalog.patients))


SUMMARY_KEYS = ["patient_id", "normalized_term", "unit", "is_active", "is_started", "is_ended"]


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each patient, term, unit and flags: counts, extremes with their days, median, spread, first and last day."""
    v = strict_number(F.col("value"))
    day = F.coalesce("day_offset_end", "day_offset_start")
    x = rows.withColumns({"_v": v, "_d": day})
    g = x.groupBy(*SUMMARY_KEYS).agg(
        F.count(F.lit(1)).alias("n_total"), F.count("_v").alias("n_numeric"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.median("_v").alias("median"),
        F.round(F.stddev_samp("_v"), 3).alias("std"), F.min("day_offset_start").alias("earliest_day"), F.coalesce(F.max("day_offset_end"), F.max("day_offset_start")).alias("latest_day"),
        F.min(F.when(F.col("_v").isNotNull(), F.struct("_v", "_d"))).alias("_lo"), F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v"), -F.col("_d")))).alias("_hi"),
    )
    many = F.col("n_numeric") > 1
    return g.select(*SUMMARY_KEYS, "n_total", "n_numeric", "min", "max", "median", "std", "earliest_day", "latest_day", F.when(many, F.col("_lo._d")).alias("min_day"), F.when(many, -F.col("_hi.col2")).alias("max_day"))


def group_count(rows: DataFrame) -> DataFrame:
    """One row: rows, patients, and groups that summaries would give; groups with a null flag or patient don't count."""
    known = [c for c in SUMMARY_KEYS if c != "unit"]
    group = F.when(~F.exists(F.array(*[F.col(c).isNull() for c in known]), lambda missing: missing), F.struct(*known, F.struct(F.col("unit").isNull().alias("none"), "unit").alias("of")))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("patient_id").alias("n_patients"), F.count_distinct(group).alias("n_groups"))


def thinned(patients: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """n patients in the order of a seeded hash: a sample that is the same on every run."""
    return patients.orderBy(F.xxhash64(F.lit(seed), "patient_id"), "patient_id").limit(n)
