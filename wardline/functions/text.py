"""Scalar functions on strings and vectors, as Python helpers for plans and as columns for data."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


WORD_BREAKS = re.compile(r"[-_\s]+")


def normalized(text: str | None) -> str:
    """The words of a text in lower case, single spaces between them; hyphens and underlines part words as spaces do."""
    return " ".join(w for w in WORD_BREAKS.split((text or "").lower()) if w)


def normalized_column(c: Column) -> Column:
    """The same on a column; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), rf"(?U){WORD_BREAKS.pattern}", " "))


def lcs_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 by longest common subsequence: 200 LCS / (length a + length b); 100 for two empty strings."""
    la, lb = F.length(a), F.length(b)
    zeros = F.array_repeat(F.lit(0), lb + 1)

    def row(acc: Column, ch: Column) -> Column:
        step = lambda done, j: F.concat(
            done,
            F.array(F.when(F.substring(b, j, F.lit(1)) == ch, F.element_at(acc, j) + 1).otherwise(F.greatest(F.element_at(acc, j + 1), F.element_at(done, -1)))),
        )
        return F.aggregate(F.sequence(F.lit(1), lb), F.array(F.lit(0)), step)

    last = F.aggregate(F.split(a, ""), zeros, row)
    return F.when((la == 0) & (lb == 0), 100.0).when((la == 0) | (lb == 0), 0.0).otherwise(200.0 * F.element_at(last, -1) / (la + lb))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def strict_number(c: Column) -> Column:
    """A double without NaN and infinities, for JSON; null where there is none."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


#: Words and signs of change in free text, by the modifier that they mean: fixed values.
MODIFIER_WORDS = (
    ("unchanged", r"stable|unchanged|no change|steady|same as|→|<->"),
    ("uptrended", r"↑|up ?trend|increas|ris(e|en|ing)\b|rose\b|worse|higher|elevating|going up"),
    ("downtrended", r"↓|down ?trend|decreas|fall(s|en|ing)?\b|fell\b|dropp(ed|ing)|lower|going down|improv"),
    ("high", r"\bhigh\b|elevated"),
    ("low", r"\blow\b|reduced"),
    ("normal", r"\bnormal\b|within limits"),
    ("absent", r"\b(no|not|without|denies|negative for|absent)\b"),
    ("present", r"\b(present|noted|positive for|with)\b"),
)


def modifier_of(c: Column) -> Column:
    """The modifier that a phrase means, the first in the order of MODIFIER_WORDS that it names; null where it names none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(MODIFIER_WORDS):
        out = F.when(c.rlike(f"(?i)({words})"), name).otherwise(out)
    return out


def comparison_of(c: Column) -> tuple[Column, Column]:
    """Comparison sign and number of a phrase such as ``> 4.5`` or ``less than 90``; nulls where there is none."""
    sign = F.regexp_extract(c, r"(?i)(>=|<=|≥|≤|>|<|above|over|more than|greater than|below|under|less than)\s*-?[0-9]", 1)
    number = F.regexp_extract(c, r"(?i)(?:>=|<=|≥|≤|>|<|above|over|more than|greater than|below|under|less than)\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    s = F.lower(sign)
    op = F.when(s.isin(">", "above", "over", "more than", "greater than"), ">").when(s.isin("<", "below", "under", "less than"), "<").when(s.isin(">=", "≥"), ">=").when(s.isin("<=", "≤"), "<=")
    return op, F.when(op.isNotNull(), number)


def sex_code(c: Column) -> Column:
    """F or M from the usual codes, else null."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("f", "female", "w", "woman"), "F").when(s.isin("m", "male", "man"), "M")


def name_order(c: Column) -> Column:
    """First name, then last name, single spaces, first letters upper case; ``Last, First`` is turned round."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    turned = F.when(F.contains(s, F.lit(",")), F.concat_ws(" ", F.trim(F.regexp_extract(s, r"^[^,]*,(.*)$", 1)), F.trim(F.regexp_extract(s, r"^([^,]*),", 1)))).otherwise(s)
    return F.initcap(F.lower(F.trim(turned)))
