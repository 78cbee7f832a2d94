"""Oversized texts cut into pieces at natural boundaries, by recursive bisection, with overlaps."""

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest: empty line, line, sentence, clause, white space, mark.
BOUNDARIES = [re.compile(p) for p in (r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+", r"\r\n|\n|\r", r"[.!?…。！？]+[\"')\]»”]*\s+", r"[,;:—–]\s+", r"\s+", r"[;,|/\-_:.]")]


def whole(text: str, cut: int) -> bool:
    """Whether a cut divides neither a line end nor a letter from its combining marks or joiners."""
    if cut <= 0 or cut >= len(text):
        return True
    a, b = text[cut - 1], text[cut]
    return not (a == "\r" and b == "\n" or a == "‍" or b in "‍️" or (b > "˿" and unicodedata.combining(b)))


def best_cut(text: str, a: int, b: int, lost: Callable[[int], bool] | None = None) -> int:
    """The strongest boundary in the middle half of a..b, the one nearest to the midpoint; else the midpoint.

    Boundaries at which something would be ``lost`` are taken only where there is no other.
    """
    mid, room = (a + b) // 2, (b - a) // 4
    low, high = max(a + 1, mid - room), min(b - 1, mid + room)
    for p, free in [(p, free) for free in ((True, False) if lost else (False,)) for p in BOUNDARIES]:
        # look outwards from the midpoint, so that a long text is not read in full for every cut
        step = 256
        while True:
            x, y = max(low, mid - step), min(high, mid + step)
            # a match may begin before the window that its end must lie in
            ends = [m.end() for m in p.finditer(text, max(a, x - 8), min(b, y + 8)) if x <= m.end() <= y]
            for e in sorted(set(ends), key=lambda e: (abs(e - mid), e)):
                if whole(text, e) and not (free and lost(e)):
                    return e
            if x == low and y == high:
                break
            step *= 4
    cut = mid
    while cut > low and not whole(text, cut):
        cut -= 1
    return cut if whole(text, cut) else mid


def crossing(spans: list[tuple[int, int]], reach: int) -> Callable[[int], bool] | None:
    """Whether a cut divides a span that the overlap of ``reach`` behind it doesn't hold whole."""
    if not spans:
        return None
    start, end = (np.array(x, np.int64) for x in zip(*sorted(spans)))
    far = np.maximum.accumulate(end)
    # the spans that begin before cut - reach: does the one that goes farthest end behind the cut
    return lambda cut: bool((i := int(np.searchsorted(start, cut - reach))) and far[i - 1] > cut)


def cuts(text: str, limit: int, overlap: int, spans: list[tuple[int, int]] = ()) -> list[int]:
    """Begin of every piece without its overlap, and the end of the text; pieces but the first leave room for the overlap."""
    if len(text) <= limit:
        return [0, len(text)]
    # spans that fit into a piece are kept whole where a boundary allows it
    lost = crossing([(x, y) for x, y in spans if 0 < y - x <= limit - overlap], overlap - overlap // 4)
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            out.append(a)
            continue
        c = best_cut(text, a, b, lost)
        todo += [(c, b), (a, c)]
    return [*out, len(text)]


def overlap_from(text: str, cut: int, overlap: int) -> int:
    """Where the repeated text begins: the first word boundary in the first quarter of the overlap, else all of it."""
    low = max(0, cut - overlap)
    if low == 0:
        return 0
    m = re.compile(r"\s(?=\S)").search(text, max(0, low - 1), min(cut, low + overlap // 4))
    at = m.end() if m else low
    while at < cut and not whole(text, at):
        at += 1
    return at


def pieces(text: str, limit: int = 2000, overlap: int = 200, spans: list[tuple[int, int]] = ()) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin without, end) of each piece, in code points."""
    if not 0 <= overlap <= limit // 2:
        raise ValueError("overlap must be between 0 and half of the limit")
    c = cuts(text, limit, overlap, spans)
    return [(overlap_from(text, a, overlap) if a and overlap else a, a, b) for a, b in zip(c, c[1:])]


PIECES = "array<struct<piece_from:int,own_from:int,piece_to:int,text:string>>"


def split_oversized(df: DataFrame, limit: int = 2000, overlap: int = 200, text: str = "text", spans: str = "spans", relations: str = "relations") -> DataFrame:
    """Texts over the limit in pieces: the other columns, piece, n_pieces, piece_from, own_from, piece_to, text, spans, relations.

    Lengths and places count code points. piece_from..piece_to is the piece with its overlap, own_from its part that
    no earlier piece holds. Cuts keep spans whole where a boundary allows it. spans are those that lie in the piece,
    with places counted from its begin, in the order of the text; a span that no piece holds is listed by id in
    spans_cut of the first piece. relations are those whose head and child the piece holds, each once; relations
    between existing spans that no piece holds together are listed once in relations_cut of the first piece. Null
    lists stay null. Texts within the limit, empty and null ones give no row. Columns named like the new ones are
    replaced.
    """
    new = ["piece", "n_pieces", "piece_from", "own_from", "piece_to", "spans_cut", "relations_cut", "_id", "_p", "_t", "_ids", "_all"]
    rest = [c for c in df.columns if c not in {text, spans, relations, *new}]
    have = {c for c in (spans, relations) if c in df.columns}
    big = df.filter(F.length(text) > limit).select(*rest, *have, F.col(text).alias("_t"))
    at = [F.transform(spans, lambda s: s[c]) if spans in have else F.lit(None).cast("array<int>") for c in ("start", "end")]  # noqa: B023
    p = big.withColumn("_p", cut_udf(limit, overlap)("_t", *at)).drop("_t")
    lists = []
    if spans in have:
        inside = F.transform("_p", lambda x: F.transform(F.filter(spans, lambda s: (s["start"] >= x["piece_from"]) & (s["end"] <= x["piece_to"])), lambda s: s["id"]))
        lists = [inside.alias("_ids"), F.transform("_p", lambda x: F.struct(x["piece_from"], x["piece_to"])).alias("_all")]
    p = p.select(*rest, *have, *lists, F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("piece", "_x"))
    p = p.select(*rest, *have, *(("_ids", "_all") if lists else ()), "piece", "n_pieces", "_x.piece_from", "_x.own_from", "_x.piece_to", F.col("_x.text").alias(text))
    first = lambda c: F.when(F.col("piece") == 0, c)
    if spans in have:
        fits = lambda s: F.exists("_all", lambda x: (s["start"] >= x["piece_from"]) & (s["end"] <= x["piece_to"]))
        p = p.withColumn("spans_cut", first(F.transform(F.filter(spans, lambda s: ~F.coalesce(fits(s), F.lit(False))), lambda s: s["id"])))
        if relations in have:
            both = lambda ids, r: F.array_contains(ids, r["head"]) & F.array_contains(ids, r["child"])
            of = F.transform(spans, lambda s: s["id"])
            p = p.withColumn("relations_cut", first(F.array_distinct(F.filter(relations, lambda r: F.coalesce(both(of, r), F.lit(False)) & ~F.coalesce(F.exists("_ids", lambda ids: both(ids, r)), F.lit(False))))))
            p = p.withColumn(relations, F.array_distinct(F.filter(relations, lambda r: both(F.get("_ids", F.col("piece")), r))))
        mine = F.filter(spans, lambda s: (s["start"] >= F.col("piece_from")) & (s["end"] <= F.col("piece_to")))
        by_place = F.array_sort(mine, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["end"] < y["end"], -1).when(x["end"] > y["end"], 1).otherwise(0))
        p = p.withColumn(spans, F.transform(by_place, lambda s: s.withField("start", s["start"] - F.col("piece_from")).withField("end", s["end"] - F.col("piece_from"))))
    return p.drop("_ids", "_all")


def cut_udf(limit: int, overlap: int):
    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("piece_from", pa.int32()), ("own_from", pa.int32()), ("piece_to", pa.int32()), ("text", pa.string())]))
        out = []
        for t, x, y in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            places = [(a, b) for a, b in zip(x or (), y or ()) if a is not None and b is not None]
            out.append(None if t is None else [{"piece_from": f, "own_from": a, "piece_to": b, "text": t[f:b]} for f, a, b in pieces(t, limit, overlap, places)])
        return pa.array(out, kind)

    return cut
