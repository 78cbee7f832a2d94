"""From an intent to candidates and a compact package of evidence, within budgets of data points."""

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import strict_number
from wardline.operators import cohort
from wardline.operators.concepts import Resolver, planned
from wardline.plans.compiler import Catalog, candidates
from wardline.plans.ir import IntentError, Leaf, Node, sense_problems, shape_problems
from wardline.session import cut_lineage

MAX_EVIDENCE, MAX_CONTEXT, FEW_PATIENTS = 120, 400, 10


def span_of(a: Column, b: Column) -> Column:
    """One day, or the first and last of a stretch, as an array; empty where neither is known."""
    return F.when(a.eqNullSafe(b) | b.isNull(), F.filter(F.array(a), lambda d: d.isNotNull())).otherwise(F.array(a, b))


def event_items(rows: DataFrame) -> DataFrame:
    """patient_id, item: one data point for each row, as JSON without nulls, NaN and infinities."""
    s = F.struct(
        F.lit("event").alias("type"), F.col("normalized_term").alias("term"), "unit", span_of(F.col("day_offset_start"), F.col("day_offset_end")).alias("timestamp"),
        strict_number(F.col("value")).alias("value"), "is_active", "is_started", "is_ended",
    )
    return rows.select("patient_id", F.to_json(s).alias("item"))


def trend_items(rows: DataFrame) -> DataFrame:
    s = F.struct(
        F.lit("trend").alias("type"), F.col("normalized_term").alias("term"), "unit", span_of(F.col("anchor1_start"), F.col("anchor1_end")).alias("anchor1_day"), span_of(F.col("anchor2_start"), F.col("anchor2_end")).alias("anchor2_day"),
        strict_number(F.col("val_start")).alias("anchor1_median"), strict_number(F.col("val_end")).alias("anchor2_median"), strict_number(F.col("delta")).alias("delta"), "change",
    )
    return rows.select("patient_id", F.to_json(s).alias("item"))


def summary_items(rows: DataFrame) -> DataFrame:
    """One data point for each patient, term, unit and flags; groups with a null flag are left out of a package."""
    g = cohort.summaries(rows).filter("normalized_term is not null and is_active is not null and is_started is not null and is_ended is not null")
    stats = F.struct("n_total", "n_numeric", "min", "max", "median", "std", F.col("min_day").alias("min_entry_timestamp"), F.col("max_day").alias("max_entry_timestamp"))
    s = F.struct(F.lit("summary").alias("type"), F.col("normalized_term").alias("term"), "unit", "is_active", "is_started", "is_ended", stats.alias("stats"), "earliest_day", "latest_day")
    return g.select("patient_id", F.to_json(s).alias("item"))


@dataclass
class Package:
    """What an answer may rest on. patients has id, age, sex and the lists evidence and context of JSON items."""

    header: dict[str, Any]
    patients: DataFrame


def _counts(rows: DataFrame | None) -> tuple[int, int, int]:
    if rows is None:
        return 0, 0, 0
    r = cohort.group_count(rows).first()
    return r.n_rows, r.n_patients, r.n_groups


def package(patients: DataFrame, n_candidates: int, candidates_: DataFrame, events: DataFrame | None, context: DataFrame | None, trends: DataFrame | None, subset: bool, max_evidence: int = MAX_EVIDENCE, max_context: int = MAX_CONTEXT, seed: int = 11) -> Package:
    """Data points within the budgets: rows as they are if they fit, else summaries, else summaries of fewer patients.

    Patients without an age or sex are left out of the package, as no item may lack them. Fewer patients are at least
    one, taken in the order of a seeded hash. Context that fits neither as rows nor as summaries is reduced to the
    terms of the evidence, else dropped.
    """
    full = patients.filter("patient_name is not null and age is not null and sex is not null")
    n_rows, n_patients, n_groups = _counts(events)
    n_trends = trends.count() if trends is not None else 0
    header: dict[str, Any] = {"retrieved_candidates": n_candidates, "query_scope": "subset" if subset else "cohort", "subsampled": False, "cta_allowed": not subset and n_candidates > 4}
    ids = candidates_.select("patient_id")
    parts: list[tuple[str, DataFrame]] = []
    if n_rows + n_trends <= max_evidence:
        shown = event_items
    elif n_groups + n_trends <= max_evidence:
        shown = summary_items
    else:
        shown = summary_items
        of_trends = trends.select("patient_id").distinct().count() if n_trends else 0
        each = (n_groups / n_patients if n_patients else 0) + (n_trends / of_trends if of_trends else 0)
        n = max(1, min(int(0.9 * max_evidence / each) if each else n_candidates, n_candidates))
        ids = cohort.thinned(ids, n, seed)
        header |= {"subsampled": True, "shown_candidates": n}
    mine = lambda d: d.join(F.broadcast(ids) if header["subsampled"] else ids, "patient_id", "left_semi")  # noqa: E731 - at most max_evidence ids
    if events is not None:
        parts.append(("evidence", shown(mine(events))))
    if trends is not None:
        parts.append(("evidence", trend_items(mine(trends))))
    if context is not None:
        ctx = mine(context)
        c_rows, _, c_groups = _counts(ctx)
        if c_rows <= max_context:
            parts.append(("context", event_items(ctx)))
        elif c_groups <= max_context:
            parts.append(("context", summary_items(ctx)))
        else:
            terms = [d.select("normalized_term") for d in (events, trends) if d is not None]
            some = ctx.join((terms[0].union(terms[1]) if len(terms) == 2 else terms[0]).distinct(), "normalized_term", "left_semi") if terms else None
            if some is not None and _counts(some)[2] <= max_context:
                parts.append(("context", summary_items(some)))
    empty = full.sparkSession.createDataFrame([], "patient_id string, kind string, item string")
    items = empty
    for kind, p in parts:
        items = items.unionByName(p.select("patient_id", F.lit(kind).alias("kind"), "item"))
    lists = items.groupBy("patient_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in ("evidence", "context")])
    out = cut_lineage(lists.join(full, "patient_id").select("patient_id", F.concat("patient_name", F.lit(" ("), "patient_id", F.lit(")")).alias("id"), "age", "sex", "evidence", "context"))
    n = out.agg(F.coalesce(F.sum(F.size("evidence")), F.lit(0)).alias("e"), F.coalesce(F.sum(F.size("context")), F.lit(0)).alias("c")).first()
    return Package(header | {"datapoints": int(n.e), "contextual_datapoints": int(n.c)}, out)


def evidence_for(catalog: Catalog, tree: Node | Leaf, few: int = FEW_PATIENTS) -> tuple[DataFrame, int, DataFrame | None, DataFrame | None, DataFrame | None]:
    """Candidates, their number, event rows that speak for the tree, context rows and trend rows."""
    found = cut_lineage(candidates(catalog, tree))
    n = found.count()
    events = cohort.event_evidence(catalog, tree, found)
    context = None
    if events is not None:
        marked = cohort.with_context(events, catalog, found, n, few)
        events, context = marked.filter("not context"), marked.filter("context") if n <= few else None
    return found, n, events, context, cohort.trend_evidence(catalog, tree, found)


@dataclass
class Answer:
    """The outcome of a run: a status, and what was reached of plan, package and text."""

    status: str
    message: str = ""
    plan: Any = None
    package: Package | None = None
    text: str | None = None
    trace: dict[str, Any] = field(default_factory=dict)


def plain_text(header: dict[str, Any], patients: DataFrame) -> str:
    """A fixed wording for where no answerer is given."""
    n = header["retrieved_candidates"]
    return f"{n} patient{'s' if n != 1 else ''} matched; {header['datapoints']} data points of evidence" + (f", {header['shown_candidates']} shown." if header["subsampled"] else ".")


def read_intent(question: str, intent_of: Callable[[str], dict[str, Any]], repairs: int = 1, tries: int = 2, pause: float = 0.6) -> dict[str, Any]:
    """The intent of a question, valid in form and sense.

    A reader that fails is asked again after a pause, up to ``tries`` times for each request. An intent whose form is
    wrong is asked for again up to ``repairs`` times with its problems appended, and so is one that makes no sense; the
    two are counted apart. IntentError if problems are left.
    """
    left = {"form": repairs, "sense": repairs}
    asked = question
    while True:
        raw = _patiently(intent_of, asked, tries, pause)
        of = "form" if (found := shape_problems(raw)) else "sense"
        found = found or sense_problems(raw)
        if not found:
            return raw
        if not left[of]:
            raise IntentError(found)
        left[of] -= 1
        time.sleep(pause)
        asked = f"{question}\n\nThe {of} of the last reading was not valid: {'; '.join(found)}"


def _patiently(f: Callable[[str], dict[str, Any]], asked: str, tries: int, pause: float) -> dict[str, Any]:
    for attempt in range(1, tries + 1):
        try:
            return f(asked)
        except Exception as e:  # whatever a user's reader may raise
            if attempt == tries:
                raise IntentError([f"the reader failed: {e}"]) from e
            time.sleep(pause * attempt)
    raise IntentError(["the reader was not asked"])


def run(question: str, catalog: Catalog, resolver: Resolver, intent_of: Callable[[str], dict[str, Any]], answer: Callable[[dict[str, Any], DataFrame], str] = plain_text, repairs: int = 1, pause: float = 0.6) -> Answer:
    """A question in words to an answer: ``intent_of`` reads it as an intent, ``answer`` words the package.

    Statuses: ok, intent parsing failed, some queried concepts not resolved, query failed, no patients matched query.
    """
    try:
        raw = read_intent(question, intent_of, repairs, pause=pause)
    except IntentError as e:
        return Answer("intent parsing failed", str(e))
    if raw.get("parse_status") in ("error", "not_parsable"):
        return Answer("intent parsing failed", raw.get("error_message") or "")
    plan = planned(raw, resolver)
    if plan.unresolved or plan.unresolved_custom:
        return Answer("some queried concepts not resolved", ", ".join(map(str, [*plan.unresolved, *plan.unresolved_custom])), plan)
    try:
        found, n, events, context, trends = evidence_for(catalog, plan.tree)
    except IntentError as e:
        return Answer("query failed", str(e), plan)
    if not n:
        return Answer("no patients matched query", "", plan)
    packed = package(catalog.patients, n, found, events, context, trends, bool(plan.tree.patient_references))
    return Answer("ok", "", plan, packed, answer(packed.header, packed.patients), {"mappings": plan.mappings, "class_terms": plan.class_terms})
