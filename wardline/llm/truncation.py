"""Texts that stop before their author did, found by a backward character n-gram model.

The model reads the characters before a place backwards, in several orders, and holds how often such a context stands
before the end of a line or sentence, before a full stop, or before anything else, at all places inside all texts. The
final context of every text, without white space, closing marks and broken characters behind it, is then weighed: the
log-odds that the text goes on, against that it ends there, from the longest orders that were seen, with a prior for
its language and source and for lengths at which the source piles up. Only contexts that end some text are counted, by
a 64-bit hash. Filters of a size derived from the number of such contexts let few others pass, and a join on the hashes
drops these, so counts are those of the context itself whatever the size of the corpus.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.catalog import bounded_rows
from wardline.operators.skew import looked_up
from wardline.session import cut_lineage

#: Characters in a context, from the shortest.
ORDERS = (2, 4, 6, 9, 13, 18)
#: Bits of a filter for each context in it, probes for each context, and the largest filter as a power of two. They bear
#: on how many foreign contexts reach the join that drops them, not on counts.
FILTER_BITS, PROBES, MOST_BITS = 32, 4, 28
#: Contexts of one order that a task counts in place, as a power of two; others are sorted.
SLOTS = 16
#: Customary closing lines: fixed values.
CLOSING = re.compile(
    r"^\s*(\[[^\]\n]{1,40}\]|\*{2,}[^\n]{1,40}\*{2,}|-{2,}\s?[^\n]{1,40}|page \d+( of \d+)?|cc: ?[^\n]{1,40}|(electronically |digitally )?(signed|dictated|reviewed|authored|transcribed|verified|printed|scanned)( by| on)?[: ][^\n]{1,40})\s*$",
    re.IGNORECASE,
)
#: Customary signs that text was left out behind them: fixed values.
CUT_MARK = re.compile(r"(\s*(…|\.{2,}|\[\s*(more|\.\.\.|…|truncated|cut|cont|snip)[^\]\n]*\]?|<\s*(more|cut|truncated|snip)[^>\n]*>?|\(\s*(more|cont|cut|truncated|snip)[^)\n]*\)?))+$", re.IGNORECASE)
#: A line counts as a closing line only where this share of all texts ends in it, so there are at most 1 / COMMON of them.
COMMON = 0.0002
MARKS = ".!?…。！？"
#: Sizes at which a source may cut its texts off: of the whole text and of what is left without its ending.
SIZES = ("bytes", "chars", "own", "own_bytes")


def template(line: str) -> str:
    """A line with digits and initials made alike."""
    return re.sub(r"\b[A-Z]{2}\b", "AA", re.sub(r"[0-9]+", "0", line.strip()))


def tail(text: str, closing: frozenset[str] = frozenset()) -> tuple[str, bool, bool]:
    """The text without white space, closing lines, signs of a cut and broken characters at its end.

    Also whether a broken character, and whether a sign of a cut stood there.
    """
    t, broken, marked = text.rstrip(), False, False
    for _ in range(4):
        if t.endswith("�"):
            t, broken = t.rstrip("�"), True
        if m := CUT_MARK.search(t, max(0, len(t) - 40)):
            t, marked = t[: m.start()].rstrip(), True
        at = max(t.rfind("\n"), t.rfind("\r")) + 1
        line = t[at:]
        if at == 0 or len(line) > 60 or not (CLOSING.match(line) or template(line) in closing):
            break
        t = t[:at].rstrip()
    return t, broken, marked


def last_lines(texts: list[str | None]) -> list[tuple[str | None, str | None]]:
    """Template of the last line, and the last character of the text before it, where both exist and the line is short."""
    out = []
    for t in texts:
        t = (t or "").rstrip()
        at = max(t.rfind("\n"), t.rfind("\r")) + 1
        line, before = t[at:], t[:at].rstrip()
        out.append((template(line), before[-1]) if before and 0 < len(line) <= 60 else (None, None))
    return out


BASE = 0x9E3779B97F4A7C15 | 1


def cells(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, 64-bit hash of the context that ends with each place), from sums of powers of BASE modulo 2**64."""
    up, down = (np.multiply.accumulate(np.full(len(codes), x, np.uint64)) for x in (BASE, pow(BASE, -1, 2**64)))
    sums = np.cumsum(codes * down, dtype=np.uint64)
    for o, n in enumerate(ORDERS):
        h = sums.copy()
        h[n:] -= sums[:-n]
        h *= up
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        yield o, h.view(np.int64)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each behind signs 1 that no context reaches over, digits alike; and the place of each text's last one."""
    pad = "\x01" * max(ORDERS)
    joined = "".join([pad + t for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    ends = np.cumsum(np.array([len(t) + len(pad) for t in texts], np.int64)) - 1
    return codes, ends


def final_cells(texts: list[str]) -> np.ndarray:
    """The hash of the final context in each order, one row for each text."""
    ends = [t[-max(ORDERS) :] for t in texts]
    codes, last = codes_of(ends)
    out = np.zeros((len(texts), len(ORDERS)), np.int64)
    for o, c in cells(codes):
        out[:, o] = c[last]
    return out


def outcomes(codes: np.ndarray) -> np.ndarray:
    """What follows each place: 0 more text, 1 the end of a line or sentence, 2 a full stop, 3 the end of the text or its begin."""
    marks = [ord(c) for c in MARKS]
    mark = codes == marks[0]
    for m in marks[1:3]:
        mark |= codes == m
    far = np.flatnonzero(codes >= 0x2026)
    mark[far] = np.isin(codes[far], np.array(marks, np.uint32))
    line = (codes == 10) | (codes == 13)
    space = (codes == 32) | (codes == 0xA0) | (codes == 9) | (codes == 11) | (codes == 12) | line
    edge = codes == 1

    def ahead(x: np.ndarray, n: int, beyond: bool) -> np.ndarray:
        """x of the place n further on."""
        return np.append(x[n:], np.full(min(n, len(x)), beyond))

    out = np.zeros(len(codes), np.int8)
    out[ahead(mark, 1, False) & (ahead(space, 2, False) | ahead(edge, 2, True))] = 2
    out[ahead(line, 1, False) | mark & ahead(space, 1, False)] = 1
    out[ahead(edge, 1, True) | edge | space] = 3
    return out


@dataclass(frozen=True)
class Rule:
    """How final contexts are judged."""

    support: float = 4.0
    dropped: float = 0.03
    base: float = 0.015
    rate: float = 0.03
    threshold: float = 0.0
    pile: int = 5
    sign: float = 3.0


def _closing(documents: DataFrame, text: str) -> frozenset[str]:
    """Templates of last lines that follow on texts of different kinds: added behind them, not written by their author.

    Counted over all documents; a line is learnt where 8 texts, and a share of COMMON of all, end in it. Lines of capitals alone are headings; a list or a table goes on in lines of its own
    kind only, so what follows a full stop in a quarter of cases or more, and something else too, is a closing mark.
    """

    @F.arrow_udf("struct<line:string,before:string>")
    def last(texts: pa.Array) -> pa.Array:
        pairs = last_lines(texts.to_pylist())
        return pa.array([{"line": a, "before": b} for a, b in pairs], pa.struct([("line", pa.string()), ("before", pa.string())]))

    x = documents.select(last(F.col(text)).alias("x")).select("x.*").filter("line is not null")
    stop = F.col("before").isin(*MARKS)
    g = x.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(stop, 1).otherwise(0)).alias("stops"), F.count_distinct("before").alias("kinds"))
    least = max(8.0, COMMON * documents.count())
    g = g.filter((F.col("n") >= least) & (F.col("stops") >= F.col("n") / 4) & (F.col("kinds") >= 4) & ~F.col("line").rlike("^[^a-z]*[A-Z ]+$") & ~F.col("line").rlike(r"[|]"))
    return frozenset(r.line for r in bounded_rows(g.select("line"), round(1 / COMMON), "the list of closing lines"))


def _ends(documents: DataFrame, key: str, text: str, closing: frozenset[str]) -> DataFrame:
    """key, lang, source, size measures and hashes of final contexts of every text that isn't empty."""
    kind = pa.struct([("chars", pa.int32()), ("bytes", pa.int32()), ("own", pa.int32()), ("own_bytes", pa.int32()), ("broken", pa.bool_()), ("marked", pa.bool_()), ("last", pa.string()), ("cells", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<chars:int,bytes:int,own:int,own_bytes:int,broken:boolean,marked:boolean,last:string,cells:array<bigint>>")
    def ends(texts: pa.Array) -> pa.Array:
        ts = texts.to_pylist()
        own = [tail(t or "", closing) for t in ts]
        c = final_cells([o[0] for o in own])
        rows = []
        for t, (o, b, m), x in zip(ts, own, c.tolist()):
            rows.append({"chars": len(t or ""), "bytes": len((t or "").encode("utf-8", "surrogatepass")), "own": len(o), "own_bytes": len(o.encode("utf-8", "surrogatepass")), "broken": b, "marked": m, "last": o[-1:], "cells": x})
        return pa.array(rows, kind)

    d = documents.filter(F.col(text).isNotNull()).select(key, F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), ends(F.col(text)).alias("e"))
    return d.select(key, "lang", "source", "e.*").filter("own > 0")


@dataclass(frozen=True)
class Wanted:
    """The final contexts: o and c of each once, and for each order a filter that all of them pass."""

    keys: DataFrame
    filters: list[np.ndarray]


def _wanted(ends: DataFrame) -> Wanted:
    keys = ends.select(F.posexplode("cells").alias("o", "c")).distinct()
    found = {r.o: r.n for r in keys.groupBy("o").agg(F.count(F.lit(1)).alias("n")).collect()}
    bits = [min(MOST_BITS, max(15, (FILTER_BITS * found.get(o, 0)).bit_length())) for o in range(len(ORDERS))]
    mask = F.element_at(F.array(*[F.lit(2**b - 1).cast("bigint") for b in bits]), F.col("o") + 1)
    a, b = F.col("c").bitwiseAND(mask), F.shiftrightunsigned("c", 32).bitwiseOR(F.lit(1))
    x = keys.select("o", F.explode(F.array(*[(a + b * j).bitwiseAND(mask) + 1 for j in range(PROBES)])).alias("c"))
    g = x.groupBy("o", F.expr("bitmap_bucket_number(c)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("m"))
    out = [np.zeros(2**b // 8, np.uint8) for b in bits]
    for r in g.collect():  # at most 2 ** MOST_BITS bits an order
        at = (r.b - 1) * 4096
        out[r.o][at : at + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return Wanted(keys, out)


def passing(bits: np.ndarray, c: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Places in use whose context passes the filter, which holds a bit or a truth value for each of its positions."""
    packed = bits.dtype != bool
    mask = np.int64(len(bits) * (8 if packed else 1) - 1)
    has = lambda k: ((bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1).view(bool) if packed else bits[k]
    at = np.flatnonzero(has(c & mask) & use)
    for j in range(1, PROBES):
        u = c[at]
        step = (u.view(np.uint64) >> np.uint64(32)).view(np.int64) | 1
        at = at[has((u + step * j) & mask)]
    return at


class Tally:
    """Outcomes behind the contexts of one order: in slots of a fixed number, and sorted where a slot is another's."""

    def __init__(self) -> None:
        self.key, self.n, self.rest, self.size = np.zeros(2**SLOTS, np.int64), np.zeros(3 * 2**SLOTS, np.int64), [], 0

    def add(self, c: np.ndarray, what: np.ndarray) -> None:
        s = (c.view(np.uint64) >> np.uint64(64 - SLOTS)).view(np.int64)
        free = self.key[s] == 0
        self.key[s[free]] = c[free]
        own = self.key[s] == c
        self.n += np.bincount(s[own] * 3 + what[own], minlength=len(self.n))
        if not own.all():
            self.rest.append((c[~own], what[~own]))
            self.size += len(self.rest[-1][0])

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """What isn't in slots, which is forgotten."""
        c, what = (np.concatenate(x) for x in zip(*self.rest)) if self.rest else (np.zeros(0, np.int64), np.zeros(0, np.int8))
        c, at = np.unique(c, return_inverse=True)
        self.rest, self.size = [], 0
        return c, np.bincount(at * 3 + what, minlength=3 * len(c)).reshape(-1, 3)

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n.reshape(-1, 3)
        some = np.flatnonzero(n.any(1))
        return self.key[some], n[some]


def _model(documents: DataFrame, text: str, wanted: Wanted, closing: frozenset[str]) -> DataFrame:
    """o, c, more, line, stop: outcomes behind the wanted contexts, over all places of all texts.

    What was added behind a text is left out, lest a cut before it pass for the end of a line.
    """
    sent = documents.sparkSession.sparkContext.broadcast(wanted.filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.unpackbits(f, bitorder="little").view(bool) if len(f) <= 2**19 else f for f in sent.value]
        tallies = [Tally() for _ in ORDERS]

        def batch(o: int, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(c), o, np.int32)), pa.array(c), *(pa.array(np.ascontiguousarray(n[:, j])) for j in range(3))], names=["o", "c", "more", "line", "stop"])

        def add(texts: list[str]) -> Iterator[pa.RecordBatch]:
            codes, _ = codes_of(texts)
            what = outcomes(codes)
            use = what < 3
            for o, c in cells(codes):
                at = passing(filters[o], c, use)
                tallies[o].add(c[at], what[at])
                if tallies[o].size > 1_000_000:
                    yield batch(o, *tallies[o].sorted())

        held, size = [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.append(t := tail(t, closing)[0])
                    size += len(t)
                    if size > 250_000:
                        yield from add(held)
                        held, size = [], 0
        if held:
            yield from add(held)
        for o, tally in enumerate(tallies):
            yield batch(o, *tally.sorted())
            yield batch(o, *tally.slots())

    part = documents.select(text).mapInArrow(run, "o int, c bigint, more bigint, line bigint, stop bigint")
    return part.groupBy("o", "c").agg(*[F.sum(x).alias(x) for x in ("more", "line", "stop")]).join(wanted.keys, ["o", "c"], "left_semi")


def _piles(ends: DataFrame, rule: Rule) -> DataFrame:
    """source, measure, size: sizes at which a source piles up against those within three per cent of them."""
    x = ends.select("source", F.explode(F.create_map(*[y for m in SIZES for y in (F.lit(m), F.col(m))])).alias("measure", "size"))
    n = x.groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("n"))
    reach = F.greatest(F.lit(8), F.floor(F.col("size") * 0.03)).cast("int")
    # neighbours by bands of size, so that each size meets those of its own band and the next ones only
    band = F.floor(F.log2(F.col("size") + 1) * 16).cast("int")
    n = n.withColumns({"band": band, "reach": reach})
    near = n.select(F.col("source").alias("s2"), F.col("measure").alias("m2"), F.col("size").alias("z2"), F.col("n").alias("n2"), F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2)).alias("b2"))
    high = n.filter(F.col("n") >= rule.pile)
    met = high.join(near, (F.col("source") == F.col("s2")) & (F.col("measure") == F.col("m2")) & (F.col("band") == F.col("b2")), "left")
    beside = (F.abs(F.col("z2") - F.col("size")) <= F.col("reach")) & (F.col("z2") != F.col("size"))
    g = met.groupBy("source", "measure", "size", "n", "reach").agg(F.coalesce(F.sum(F.when(beside, F.col("n2"))), F.lit(0)).alias("around"))
    usual = F.col("around") / (2 * F.col("reach"))
    return g.filter((F.col("n") >= rule.pile) & (F.col("n") > 6 * usual + 4 * F.sqrt(usual + 0.25))).select("source", "measure", "size")


def truncated(documents: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with a text of its own: key, lang, source, log_odds, truncated.

    log_odds is that of having been cut against being whole. Null and empty texts, and those of white space or closing
    marks alone, give no row and are no case. A null language or source is a group of its own (named ""). A text that
    ends in a broken character is cut. Copies get equal results.
    """
    rule = rule or Rule()
    documents = documents.select(key, text, "lang", "source")
    closing = _closing(documents, text)
    ends = cut_lineage(_ends(documents, key, text, closing))
    model = _model(documents, text, _wanted(ends), closing)
    x = ends.select(key, F.posexplode("cells").alias("o", "c")).join(model, ["o", "c"])
    seen = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "more", "line", "stop"))).alias("m"))
    # shares of the outcomes, drawn from the shorter orders to the longer ones
    k = rule.support
    start = F.struct(F.lit(rule.base).alias("line"), F.lit(rule.base).alias("stop"))

    def longer(a: Column, m: Column) -> Column:
        n = m["more"] + m["line"] + m["stop"]
        return F.struct(((m["line"] + k * a["line"]) / (n + k)).alias("line"), ((m["stop"] + k * a["stop"]) / (n + k)).alias("stop"))

    p = seen.select(key, F.aggregate("m", start, longer).alias("p"))
    ended = F.col("last").isin(*MARKS)
    d = ends.join(p, key, "left").withColumn("p", F.coalesce("p", start))
    whole = F.when(ended, F.col("p.line") + F.col("p.stop")).otherwise(F.col("p.line") + rule.dropped * F.col("p.stop"))
    d = d.withColumn("fit", F.greatest(whole, F.lit(1e-6)) / rule.base)

    # the pile a text lies in, the first in the order of names where it lies in several
    piles = cut_lineage(_piles(ends, rule))
    for m in SIZES:
        of = piles.filter(F.col("measure") == m).select("source", F.col("size").alias(m), F.concat_ws(":", F.lit(m), "size").alias(f"_{m}"))
        d = looked_up(d, of, ["source", m], "left", key)
    low = F.when(F.col("broken") | (F.col("fit") < 0.2), 1.0).otherwise(0.0)
    d = cut_lineage(d.select(key, "lang", "source", "broken", "marked", "fit", low.alias("low"), F.coalesce(*[F.col(f"_{m}") for m in SIZES]).alias("pile")))
    rates = d.groupBy("lang", "source").agg(((F.sum("low") + 20 * rule.rate) / (F.count(F.lit(1)) + 20)).alias("rate"))
    pile_rates = d.filter("pile is not null").groupBy("source", "pile").agg(((F.sum("low") + 1) / (F.count(F.lit(1)) + 2)).alias("pile_rate"))
    d = looked_up(looked_up(d, rates, ["lang", "source"], "inner", key), pile_rates, ["source", "pile"], "left", key)
    prior = F.least(F.greatest(F.coalesce("pile_rate", "rate"), F.lit(1e-4)), F.lit(0.999))
    odds = F.when(F.col("broken"), 20.0).otherwise(F.ln(prior / (1 - prior)) - F.ln("fit") + F.when(F.col("marked"), rule.sign).otherwise(0.0))
    return d.select(key, F.col("lang"), F.col("source"), odds.alias("log_odds"), (odds > rule.threshold).alias("truncated"))


def rates(judged: DataFrame, documents: DataFrame) -> DataFrame:
    """source, documents, truncated, rate: how often each source cuts its texts off, of all documents that it has."""
    n = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    cut = judged.filter("truncated").groupBy("source").agg(F.count(F.lit(1)).alias("truncated"))
    return n.join(cut, "source", "left").select("source", "documents", F.coalesce("truncated", F.lit(0).cast("bigint")).alias("truncated"), (F.coalesce("truncated", F.lit(0)) / F.col("documents")).alias("rate"))
