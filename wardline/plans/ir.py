"""Intents: boolean trees of clinical predicates with temporal scope, as immutable values, and their validation."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

#: Words of the JSON form of an intent, which stored intents use.
RELATIONS = ("FROM", "UNTIL", "OVERLAPS", "HISTORY", "BASELINE")
MODIFIERS = ("uptrended", "downtrended", "unchanged", "high", "low", "normal", "present", "absent")
TRENDS = ("uptrended", "downtrended", "unchanged")
COMPARISONS = (">", "<", ">=", "<=", "=", "!=")


class IntentError(ValueError):
    """An intent that cannot be planned; problems lists why."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Anchor:
    form: str | None = None
    term: str | None = None
    kind: str | None = None
    event: str | None = None
    day_offset: int = 0


@dataclass(frozen=True)
class Temporal:
    relation: str
    anchor: Anchor = Anchor()


@dataclass(frozen=True)
class Leaf:
    """A resolved predicate; term and concept_class may both be given."""

    term: str | None = None
    concept_class: str | None = None
    op: str | None = None
    value: float | None = None
    unit: str | None = None
    modifier: str | None = None
    modifier_text: str | None = None
    temporal: tuple[Temporal, ...] = ()

    @property
    def is_trend(self) -> bool:
        return (self.modifier or "").strip().lower() in TRENDS

    @property
    def is_absent(self) -> bool:
        return (self.modifier or "").strip().lower() == "absent"

    @property
    def numeric(self) -> bool:
        return bool(self.op) and self.value is not None


@dataclass(frozen=True)
class Node:
    logic: str = "AND"
    children: tuple["Node | Leaf", ...] = ()
    temporal: tuple[Temporal, ...] = ()
    patient_references: tuple[str, ...] = field(default=())


def scoped(node: "Node | Leaf", outer: tuple[Temporal, ...] = ()) -> "Node | Leaf":
    """The tree with every leaf carrying its own temporal scope, or else that of its nearest ancestor."""
    own = node.temporal or outer
    if isinstance(node, Leaf):
        return replace(node, temporal=own)
    return replace(node, temporal=own, children=tuple(scoped(c, own) for c in node.children))


def leaves(node: "Node | Leaf") -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    return [x for c in node.children for x in leaves(c)]


def temporal_from(raw: Any) -> tuple[Temporal, ...]:
    out = []
    for t in raw or ():
        a = t.get("anchor") or {}
        out.append(
            Temporal(
                (t.get("relation") or "").upper(),
                Anchor(a.get("form"), a.get("resolved_term") or a.get("term"), (a.get("kind") or None) and a["kind"].upper(), (a.get("event") or None) and a["event"].lower(), int(a.get("day_offset") or 0)),
            )
        )
    return tuple(out)


def from_json(raw: dict) -> "Node | Leaf":
    """A tree from its JSON form; an object with ``clauses`` is a node, any other a leaf."""
    if "clauses" in raw:
        return Node((raw.get("logic") or "AND").upper(), tuple(from_json(c) for c in raw["clauses"] or ()), temporal_from(raw.get("temporal")), tuple(raw.get("patient_references") or ()))
    return Leaf(raw.get("resolved_term"), raw.get("resolved_class"), raw.get("op"), raw.get("value"), raw.get("unit"), raw.get("modifier"), raw.get("modifier_text"), temporal_from(raw.get("temporal")))


Rule = tuple[Callable[[Any], bool], str]


def _one_of(*allowed: str | None) -> Rule:
    return lambda v: (v is None or isinstance(v, str)) and v in allowed, "must be " + " or ".join("null" if x is None else x for x in allowed)


_NUMBER: Rule = (lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool), "must be a number or null")
_DAYS: Rule = (lambda v: v is None or isinstance(v, int) and not isinstance(v, bool), "must be a whole number or null")
_TEXT: Rule = (lambda v: v is None or isinstance(v, str), "must be a text or null")
_TEXTS: Rule = (lambda v: v is None or isinstance(v, list) and all(isinstance(x, str) for x in v), "must be a list of texts")
_SCOPE: Rule = (lambda v: v is None or isinstance(v, list) and 1 <= len(v) <= 2, "must be null or hold one or two entries")

#: What each field of the JSON form may hold. Objects inside are gone through by shape_problems.
SHAPES: dict[str, dict[str, Rule]] = {
    "intent": {"parse_status": _one_of("ok", "not_parsable", "error", None), "error_message": _TEXT, "logic": _one_of("AND", "OR", None), "patient_references": _TEXTS},
    "clause": {"term": _TEXT, "resolved_term": _TEXT, "resolved_class": _TEXT, "op": _one_of(">", "<", None), "value": _NUMBER, "unit": _TEXT, "modifier": _one_of(*MODIFIERS, None), "modifier_text": _TEXT, "temporal": _SCOPE},
    "scope": {"relation": _one_of(*RELATIONS)},
    "anchor": {"form": _one_of("concept", "admission"), "term": _TEXT, "kind": _one_of("EVENT", "INTERVAL", None), "event": _one_of("start", "stop", None), "day_offset": _DAYS},
}


def _fields(raw: Any, what: str, at: str) -> list[str]:
    if not isinstance(raw, dict):
        return [f"{at}: must be an object"]
    return [f"{at}.{name}: {said}" for name, (good, said) in SHAPES[what].items() if not good(raw.get(name))]


def shape_problems(raw: Any, at: str = "intent") -> list[str]:
    """What in a parsed intent has the wrong form, by path. Clauses may be groups of clauses."""
    out = _fields(raw, "intent", at)
    if not isinstance(raw, dict) or raw.get("parse_status") in ("not_parsable", "error"):
        return out
    clauses = raw.get("clauses")
    if not isinstance(clauses, list) or not clauses:
        return [*out, f"{at}.clauses: must be a list with at least one entry"]
    for i, c in enumerate(clauses):
        here = f"{at}.clauses[{i}]"
        if isinstance(c, dict) and "clauses" in c:
            out += shape_problems(c, here)
            continue
        found = _fields(c, "clause", here)
        out += found
        if isinstance(c, dict) and isinstance(c.get("temporal"), list):
            for j, t in enumerate(c["temporal"]):
                there = f"{here}.temporal[{j}]"
                out += _fields(t, "scope", there)
                if isinstance(t, dict) and t.get("anchor") is not None:
                    out += _fields(t["anchor"], "anchor", f"{there}.anchor")
    return out


def sense_problems(raw: dict, at: str = "intent") -> list[str]:
    """What in an intent of the right form does not fit together, by path."""
    if raw.get("parse_status") in ("not_parsable", "error"):
        return []
    out = []
    for i, c in enumerate(raw["clauses"]):
        here = f"{at}.clauses[{i}]"
        if "clauses" in c:
            out += sense_problems(c, here)
            continue
        if not any((c.get(k) or "").strip() for k in ("term", "resolved_term", "resolved_class")):
            out.append(f"{here}.term: missing")
        if (c.get("op") is None) != (c.get("value") is None):
            out.append(f"{here}: op and value must be given together")
        scopes = c.get("temporal") or []
        if len(scopes) == 2 and [t["relation"] for t in scopes] != ["FROM", "UNTIL"]:
            out.append(f"{here}.temporal: two entries must be FROM, then UNTIL")
        for j, t in enumerate(scopes):
            out += [f"{here}.temporal[{j}]{p}" for p in _scope_problems(t["relation"], t.get("anchor"))]
    return out


def _scope_problems(relation: str, a: dict | None) -> list[str]:
    if relation in ("HISTORY", "BASELINE"):
        return [f".anchor: {relation} has none"] if a is not None else []
    if a is None:
        return [f".anchor: {relation} needs one"]
    given = {k for k in ("term", "kind", "event", "day_offset") if a.get(k) is not None}
    if a["form"] == "admission":
        return [f".anchor.{k}: must be null for an admission anchor" for k in sorted(given - {"day_offset"})]
    out = [] if (a.get("term") or "").strip() else [".anchor.term: missing"]
    if "kind" not in given:
        return [*out, ".anchor.kind: must be EVENT or INTERVAL"]
    if a["kind"] == "INTERVAL":
        out += [f".anchor.{k}: must be null for an INTERVAL" for k in sorted(given & {"event", "day_offset"})]
        if relation != "OVERLAPS":
            out.append(".anchor.kind: an INTERVAL goes with OVERLAPS only")
    return out


def problems_of(raw: Any) -> list[str]:
    """What keeps a parsed intent from being planned, by path; an empty list if nothing does."""
    return shape_problems(raw) or sense_problems(raw)


def checked(raw: Any) -> "Node | Leaf":
    if p := problems_of(raw):
        raise IntentError(p)
    return from_json(raw)
