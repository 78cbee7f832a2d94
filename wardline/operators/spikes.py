"""Readings that cannot be true for their source: impossible values, spikes and stuck runs.

Spikes are sought by phase-space thresholding: the value and its first and second differences of a series are held
against three robust ellipsoids whose size follows the universal threshold sqrt(2 ln n); readings outside any of them
are candidates and are bridged by their neighbours. The ellipsoids are drawn anew on the bridged series, and the search
is repeated, until it finds no more. An exact check follows: one or two candidates in a row must stand far off
from the readings before and after them, and these must agree, both measured by the robust spread of the differences
of the series. Runs of zero differences in one unit and the physical bounds of the term find the other faults.

All that is said of a series is taken over the whole of it, and all that is said of a term over all of its series: the
pass over the readings gives candidates with their surroundings and counts in buckets of fixed width, and the verdicts
are reached on the summed counts. So they depend on the rows alone, not on how these are spread over tasks and blocks.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators import series, units
from wardline.operators.skew import looked_up
from wardline.session import cut_lineage

KINDS = ("impossible", "spike", "stuck")
#: Buckets for each doubling of a quantity, and the number that keeps those of small quantities above zero.
FINE, ABOVE = 2**14, 1100 * 2**14
#: What is counted in buckets: the value, its step from the reading before, first and second difference, resolution.
SAMPLES = ("level", "step", "rise", "bend", "grain")
#: What an ellipsoid is drawn from.
SHAPE = ("centre", "wide", "slope", "curve", "turn", "spread")
LEVEL, STEP, RISE, BEND, GRAIN = range(5)


def bucket(x: np.ndarray) -> np.ndarray:
    """Number of the bucket of each value, in the order of the values; 0 for zero."""
    a = np.abs(x)
    k = np.floor(np.log2(np.where(a > 0, a, 1)) * FINE).astype(np.int64) + ABOVE
    return np.where(a > 0, np.sign(x).astype(np.int64) * k, 0)


def worth(b: np.ndarray) -> np.ndarray:
    """The value that stands for a bucket."""
    return np.where(b == 0, 0.0, np.sign(b) * np.exp2((np.abs(b) - ABOVE + 0.5) / FINE))


def worth_column(b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.signum(b.cast("double")) * F.pow(F.lit(2.0), (F.abs(b) - ABOVE + 0.5) / FINE))


#: Ranks among n values: both sides of the middle, and the quartiles.
RANKS = (lambda n: (n - 1) // 2, lambda n: n // 2, lambda n: (n - 1) // 4, lambda n: n - 1 - (n - 1) // 4)


def middle(seg: np.ndarray, x: np.ndarray, k: int, ranks: tuple = RANKS[:2]) -> np.ndarray:
    """Median, and with all RANKS the quartiles, of the values in buckets, by segment. Buckets keep the order of the values."""
    low, high, *more = (np.where(np.isnan(v), np.nan, worth(bucket(np.nan_to_num(v)))) for v in series.ranked(seg, x, k, *ranks)[:-1])
    return (low + high) / 2 if not more else [(low + high) / 2, *more]


@dataclass(frozen=True)
class Walk:
    """A series with its found readings bridged, and its differences."""

    w: np.ndarray
    before: np.ndarray
    d1: np.ndarray
    d2: np.ndarray
    inner: np.ndarray
    step: np.ndarray

    @staticmethod
    def of(seg: np.ndarray, y: np.ndarray, found: np.ndarray) -> "Walk":
        m = len(y)
        at, w = np.arange(m), bridged(seg, y, found)
        left, right = np.ones(m, bool), np.ones(m, bool)
        left[1:], right[:-1] = seg[1:] != seg[:-1], seg[1:] != seg[:-1]
        before, after = np.where(left, at, at - 1), np.where(right, at, at + 1)
        good = ~found
        step = np.where(left | ~good | ~good[before], np.nan, np.abs(w - w[before]))
        return Walk(w, before, (w[after] - w[before]) / 2, w[after] - 2 * w + w[before], ~(left | right), step)

    def samples(self, found: np.ndarray, grain: np.ndarray) -> list[np.ndarray]:
        """What is counted of each reading, in the order of SAMPLES; NaN where it doesn't count."""
        inner = lambda d: np.where(self.inner, np.abs(d), np.nan)
        return [np.where(found, np.nan, self.w), self.step, inner(self.d1), inner(self.d2), grain]

    def sums(self) -> list[np.ndarray]:
        d2 = np.where(self.inner, self.d2, 0)
        return [self.w * d2, d2, self.w, self.w**2]


@dataclass(frozen=True)
class Faults:
    """Faults of readings in time order, copies removed."""

    far: float = 8.0
    agree: float = 6.0
    least: int = 8
    run: int = 6
    steady: float = 0.5
    weight: float = 8.0

    def runs(self, seg: np.ndarray, raw: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Readings in long runs of equal recorded values in one unit; and of all readings which make a pair with the one
        before, and which of these pairs are equal."""
        same = np.zeros(len(raw), bool)
        same[1:] = (seg[1:] == seg[:-1]) & (raw[1:] == raw[:-1]) & (state[1:] == state[:-1])
        begin = np.flatnonzero(~same)
        size = np.diff(np.append(begin, len(raw)))
        pair = np.zeros(len(raw), bool)
        pair[1:] = seg[1:] == seg[:-1]
        return np.repeat(size, size) >= self.run, pair, same

    def shape(self, seg: np.ndarray, walk: Walk, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows in the order of SHAPE, one column for each series: robust centre and spreads, and the turn of the ellipsoid."""
        k = len(n)
        s = walk.samples(found, np.zeros(0))
        centre, low, high = middle(seg, s[LEVEL], k, RANKS)
        sums = [np.bincount(seg, x, k) for x in walk.sums()]
        return drawn(centre, low, high, middle(seg, s[STEP], k), middle(seg, s[RISE], k), middle(seg, s[BEND], k), sums, n)

    def search(self, seg: np.ndarray, walk: Walk, found: np.ndarray, n: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """One round: readings outside the ellipsoids besides those found."""
        lim = np.sqrt(2 * np.log(np.maximum(n, 2)))
        c, su, s1, s2, theta, spread = shape
        low = np.maximum(1e-9, 1e-6 * np.abs(np.nan_to_num(c)))
        a, b, d = (lim * np.maximum(np.nan_to_num(s), low) for s in (su, s1, s2))
        u = walk.w - np.nan_to_num(c)[seg]
        x, y = (u / a[seg]) ** 2, (walk.d1 / b[seg]) ** 2
        outside = (x + y > 1) | (y + (walk.d2 / d[seg]) ** 2 > 1)
        # the ellipse of value and second difference is turned
        cos, sin = np.cos(theta), np.sin(theta)
        den = np.maximum(cos**4 - sin**4, 1e-12)
        ax, bx = (a**2 * cos**2 - d**2 * sin**2) / den, (d**2 * cos**2 - a**2 * sin**2) / den
        turn_u, turn_d = u * cos[seg] + walk.d2 * sin[seg], walk.d2 * cos[seg] - u * sin[seg]
        fit = (ax > 0) & (bx > 0)
        outside |= np.where(fit[seg], turn_u**2 / np.where(fit, ax, 1)[seg] + turn_d**2 / np.where(fit, bx, 1)[seg] > 1, x + (walk.d2 / d[seg]) ** 2 > 1)
        # beside a spike stand good readings with large differences: only what is off the local level is a candidate
        return outside & ~found & walk.inner & (np.abs(walk.w - local_level(seg, walk.w)) > self.far / 2 * np.nan_to_num(spread)[seg])

    def exhaust(self, seg: np.ndarray, y: np.ndarray, n: np.ndarray, found: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Searches with one shape until nothing is new; marks what it finds and tells in which series that was."""
        fresh = np.zeros(len(n), bool)
        rows, of, seg_ = np.arange(len(y)), np.arange(len(n)), seg
        while len(rows):
            new = self.search(seg_, Walk.of(seg_, y[rows], found[rows]), found[rows], n[of], shape[:, of])
            found[rows[new]] = True  # one reading at least for each series that goes on, so the search ends
            on = np.bincount(seg_[new], minlength=len(of)) > 0
            fresh[of[on]] = True
            rows, of, seg_ = narrowed(on, rows, of, seg_)
        return fresh

    def candidates(self, seg: np.ndarray, y: np.ndarray, n: np.ndarray, bad: np.ndarray, known: list[np.ndarray] = (), hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phase-space thresholding; the candidates, and the series in which the last round of their own found some.

        A round estimates the shape of each series on what is bridged so far and searches with it; series go on while
        a round finds something. bad: bridged from the start. Series marked hot are not seen whole: their rounds are
        those of the known shapes.
        """
        found, fresh = bad.copy(), np.zeros(len(n), bool)
        hot = np.zeros(len(n), bool) if hot is None else hot
        rows, of, seg_ = narrowed(~hot | (len(known) > 0), np.arange(len(y)), np.arange(len(n)), seg)
        e = 0
        while len(rows):
            part = found[rows]
            shape = self.shape(seg_, Walk.of(seg_, y[rows], part), part, n[of])
            if e < len(known):
                shape = np.where(hot[of], known[e][:, of], shape)
            fresh[of] = new = self.exhaust(seg_, y[rows], n[of], part, shape)
            found[rows] = part
            e += 1
            rows, of, seg_ = narrowed(np.where(hot[of], e < len(known), new), rows, of, seg_)
        return found, fresh

    def spike(self) -> Column:
        """The exact check on a candidate and its surroundings: one or two candidates in a row, far off from neighbours
        that agree. Of columns y and e (readings from two before to two after, and how far each is off its local level),
        mask (bits: found, bad, in the series), n, spread, level, grain and usual."""
        size = F.greatest(F.abs(F.coalesce("level", F.lit(0.0))), F.lit(1e-9))
        spread = F.coalesce("spread", F.lit(0.0))
        s = F.greatest(F.sqrt((F.col("n") * spread * spread + self.weight * F.pow(F.coalesce("usual", F.lit(0.0)) * size, F.lit(2))) / (F.col("n") + self.weight)), "grain")
        bit = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) > 0
        y, e = ([F.col(c)[j] for j in range(5)] for c in ("y", "e"))
        # candidates that hardly leave the local level of the bridged series are ordinary readings again
        off = [bit(j) & (bit(j + 5) | (e[j] > (self.far - 1) * s)) for j in range(5)]

        def stands(first: int, last: int) -> Column:
            p, q = y[first - 1], y[last + 1]
            near, mid = F.abs(p - q), (p + q) / 2
            conds = [bit(first + 9), bit(last + 11), ~off[first - 1], ~off[last + 1], near <= self.agree * s]
            conds += [c for j in range(first, last + 1) for c in (off[j], F.abs(y[j] - mid) > F.greatest(self.far * s, 1.5 * near))]
            return F.coalesce(reduce(lambda a, b: a & b, conds), F.lit(False))

        return (F.col("n") >= self.least) & ~bit(7) & bit(2) & (stands(2, 2) | stands(2, 3) | stands(1, 2))


def narrowed(on: np.ndarray, rows: np.ndarray, of: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, of and seg of the series that are on, these numbered from 0."""
    stay = on[seg]
    return rows[stay], of[on], (np.cumsum(on) - 1)[seg[stay]]


def drawn(centre: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, rise: np.ndarray, bend: np.ndarray, sums: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """A shape from medians, quartiles and the sums of Walk.sums."""
    c = np.nan_to_num(centre)
    wd, d, w, ww = sums
    theta = np.arctan2(wd - c * d, np.maximum(ww - 2 * c * w + n * c * c, 1e-300))
    spread = np.nan_to_num(step) / 0.954  # |difference| of two normal values has the median 0.954 sd
    return np.stack([c, (high - low) / 1.349, 1.4826 * rise, 1.4826 * bend, theta, spread])


def local_level(seg: np.ndarray, w: np.ndarray, half: int = 3) -> np.ndarray:
    """Median of the readings up to ``half`` places before and after, in the same series."""
    near = np.full((len(w), 2 * half + 1), np.nan)
    near[:, half] = w
    for j in range(1, half + 1):
        same = seg[j:] == seg[:-j]
        near[j:, half - j] = np.where(same, w[:-j], np.nan)
        near[:-j, half + j] = np.where(same, w[j:], np.nan)
    near.sort(axis=1)
    m, at = (~np.isnan(near)).sum(1), np.arange(len(w))
    return (near[at, (m - 1) // 2] + near[at, m // 2]) / 2


def bridged(seg: np.ndarray, y: np.ndarray, found: np.ndarray) -> np.ndarray:
    """y with the found readings replaced by the line between their good neighbours in the series."""
    if not found.any():
        return y
    at = np.arange(len(y))
    prev = np.maximum.accumulate(np.where(found, -1, at))
    nxt = np.minimum.accumulate(np.where(found, len(y), at)[::-1])[::-1]
    ok_p = (prev >= 0) & (seg[np.maximum(prev, 0)] == seg)
    ok_n = (nxt < len(y)) & (seg[np.minimum(nxt, len(y) - 1)] == seg)
    p, q = y[np.maximum(prev, 0)], y[np.minimum(nxt, len(y) - 1)]
    share = (at - prev) / np.maximum(nxt - prev, 1)
    line = np.where(ok_p & ok_n, p + (q - p) * share, np.where(ok_p, p, np.where(ok_n, q, y)))
    return np.where(found, line, y)


#: Rows of the pass over the readings: events that may be at fault, and counts of terms and of series in blocks.
EVENT, OF_TERM, TERM_PAIRS, OF_SERIES, SERIES_PAIRS = range(5)
_FIELDS = {
    "what": pa.int32(), "event_id": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "tix": pa.int32(), "hot": pa.bool_(), "impossible": pa.bool_(), "stuck": pa.bool_(), "n": pa.float64(), "spread": pa.float64(), "level": pa.float64(),
    "grain": pa.float64(), "mask": pa.int32(), "y": pa.list_(pa.float64()), "e": pa.list_(pa.float64()), "sample": pa.int32(), "bucket": pa.int64(), "count": pa.int64(), "sums": pa.list_(pa.float64()),
}
_PASS = ", ".join(f"{k} {dict(zip(map(str, (pa.int32(), pa.int64(), pa.bool_(), pa.float64())), ('int', 'bigint', 'boolean', 'double'))).get(str(t), 'array<double>')}" for k, t in _FIELDS.items())


def _rows(what: int, n: int, /, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Record batches of the pass; columns not given are null."""
    given = {"what": np.full(n, what, np.int32)} | columns
    cols = []
    for name, kind in _FIELDS.items():
        x = given.get(name)
        if x is None:
            cols.append(pa.nulls(n, kind))
        elif pa.types.is_list(kind):
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), pa.float64())))
        else:
            cols.append(pa.array(x, kind))
    if n:
        yield from pa.table(cols, names=list(_FIELDS)).to_batches(max_chunksize=50_000)


def _counted(ids: list[np.ndarray], b: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct (ids, bucket) with their counts."""
    order = np.lexsort((b, *ids))
    first = series.starts(*[x[order] for x in (*ids, b)]) if len(b) else np.zeros(0, np.int64)
    at = order[first]
    return [x[at] for x in ids], b[at], np.diff(np.append(first, len(b)))


def _around(x: np.ndarray, seg: np.ndarray, at: np.ndarray, none: float) -> np.ndarray:
    """x from two places before to two after each place, ``none`` beyond the series."""
    out = np.full((len(at), 5), none, x.dtype)
    for j in range(5):
        k = at + j - 2
        ok = (k >= 0) & (k < len(x))
        k = np.where(ok, k, 0)
        ok &= seg[k] == seg[at]
        out[ok, j] = x[k[ok]]
    return out


@dataclass(frozen=True)
class Pass:
    """Chunks of whole blocks of series to rows of the pass. With ``estimate``, only the counts that the next shape of
    the series in blocks is drawn from."""

    terms: units.Terms
    decode: units.Decoder
    faults: Faults
    shapes: int
    estimate: bool = False

    def __call__(self, x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        f, terms = self.faults, self.terms
        begin = series.starts(x["s1"], x["s2"], x["block"])
        state, y = self.decode(x, begin)
        first = series.starts(x["s1"], x["s2"], x["block"], x["t"], x["chash"])
        y, raw, st, tix, core = y[first], x["value"][first], state[first], x["tix"][first], x["core"][first]
        k = len(begin)
        seg = np.repeat(np.arange(k), np.diff(np.append(begin, len(x["s1"]))))[first]
        ids = x["s1"][begin], x["s2"][begin]
        low, high = terms.low[tix], terms.high[tix]
        room = 1e-6 * np.maximum(np.abs(low), np.abs(high))
        room[~np.isfinite(room)] = 0
        bad = (y < low - room) | (y > high + room) | ~np.isfinite(y)
        y = np.where(np.isfinite(y), y, 0)
        grain = np.abs(resolution(raw) * terms.factor[tix, st])
        hot = ~np.isnan(x["of_n"][begin]) if "of_n" in x else np.full(k, self.estimate)
        n = np.bincount(seg, minlength=k).astype(float)
        known = []
        if "of_n" in x:
            n = np.where(hot, x["of_n"][begin], n)
            known = [np.stack([x[f"{c}{e}"][begin] for c in SHAPE]) for e in range(self.shapes)]
        found, fresh = f.candidates(seg, y, n, bad, known, hot)
        walk = Walk.of(seg, y, found)
        samples = walk.samples(found, grain)
        of_hot = hot[seg] & core
        if hot.any():
            kinds = range(len(SAMPLES)) if self.estimate else (LEVEL, STEP)
            for j in kinds:
                rows = np.flatnonzero(of_hot & ~np.isnan(samples[j]))
                (s1, s2), b, c = _counted([ids[0][seg[rows]], ids[1][seg[rows]]], bucket(samples[j][rows]))
                yield from _rows(OF_SERIES, len(b), s1=s1, s2=s2, sample=np.full(len(b), j), bucket=b, count=c)
        if self.estimate:
            sums = np.stack([np.bincount(seg[core], v[core], k) for v in walk.sums()], axis=1)
            yield from _rows(SERIES_PAIRS, k, s1=ids[0], s2=ids[1], count=np.bincount(seg[core], minlength=k), bucket=fresh.astype(np.int64), sums=sums)
            return
        cold = ~hot
        level, spread, grain = middle(seg, samples[LEVEL], k), np.nan_to_num(middle(seg, samples[STEP], k) / 0.954), middle(seg, grain, k) / 2
        term = tix[series.starts(seg)].astype(np.int64)
        share = spread / np.maximum(np.abs(np.nan_to_num(level)), 1e-9)
        some = cold & (n >= 4) & (spread > 0)
        (t,), b, c = _counted([term[some]], bucket(share[some]))
        yield from _rows(OF_TERM, len(b), tix=t, bucket=b, count=c)
        # how often neighbours differ: in the series outside of its long runs, in the term at all
        long, pair, same = f.runs(seg, raw, st)
        pair, same = pair & core, same & core
        m = len(terms.names)
        yield from _rows(TERM_PAIRS, m, tix=np.arange(m), bucket=np.bincount(tix[same], minlength=m), count=np.bincount(tix[pair], minlength=m))
        out = pair & ~(long & same)
        pairs, ties = np.bincount(seg[out], minlength=k), np.bincount(seg[out & same], minlength=k)
        h = np.flatnonzero(hot)
        yield from _rows(SERIES_PAIRS, len(h), s1=ids[0][h], s2=ids[1][h], bucket=ties[h], count=pairs[h])
        stuck = long & ((pairs > 0) & (ties <= f.steady * pairs) & (n >= f.least) | hot)[seg]
        dev = np.abs(y - local_level(seg, walk.w))
        hit = np.flatnonzero((bad | stuck | found) & core)
        mask = sum(_around(v.astype(np.int32), seg, hit, 0) << s for v, s in ((found, 0), (bad, 5), (np.ones(len(y), bool), 10)))
        mask = (mask << np.arange(5)).sum(1)
        size = np.diff(np.append(first, len(x["s1"])))[hit]
        ev = np.repeat(first[hit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        rep = lambda v: np.repeat(v, size, axis=0)
        of = seg[hit]
        yield from _rows(
            EVENT, len(ev), event_id=x["row_id"][ev], s1=rep(ids[0][of]), s2=rep(ids[1][of]), tix=rep(tix[hit]), hot=rep(hot[of]), impossible=rep(bad[hit]), stuck=rep(stuck[hit]), n=rep(n[of]), spread=rep(spread[of]),
            level=rep(np.nan_to_num(level[of])), grain=rep(np.nan_to_num(grain[of])), mask=rep(mask), y=rep(_around(y, seg, hit, 0.0)), e=rep(_around(dev, seg, hit, 0.0)),
        )


def _ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, n, the values at both sides of the middle and the quartiles, from counts of buckets."""
    g = counts.groupBy(*by, "bucket").agg(F.sum("count").alias("c"))
    of = Window.partitionBy(*by)
    g = g.withColumns({"cum": F.sum("c").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "m": F.sum("c").over(of)})
    at = lambda r: F.min(F.when(F.col("cum") > F.expr(r), F.col("bucket")))
    g = g.groupBy(*by).agg(*[at(r).alias(a) for a, r in (("lo", "(m - 1) div 2"), ("hi", "m div 2"), ("q1", "(m - 1) div 4"), ("q3", "m - 1 - (m - 1) div 4"))])
    return g.select(*by, ((worth_column(F.col("lo")) + worth_column(F.col("hi"))) / 2).alias("mid"), worth_column(F.col("q1")).alias("q1"), worth_column(F.col("q3")).alias("q3"))


def _shape(counts: DataFrame, e: int) -> DataFrame:
    """s1, s2, of_n, of_grain and the shape of each series in blocks, from the rows of an estimating pass."""
    r = _ranks(counts.filter(F.col("what") == OF_SERIES), [*series.SERIES, "sample"])
    one = lambda j, c: F.max(F.when(F.col("sample") == j, F.col(c)))
    r = r.groupBy(*series.SERIES).agg(one(LEVEL, "mid").alias("c"), one(LEVEL, "q1").alias("q1"), one(LEVEL, "q3").alias("q3"), one(STEP, "mid").alias("step"), one(RISE, "mid").alias("rise"), one(BEND, "mid").alias("bend"), one(GRAIN, "mid").alias("grain"))
    s = counts.filter(F.col("what") == SERIES_PAIRS).groupBy(*series.SERIES).agg(F.sum("count").cast("double").alias("of_n"), *[F.sum(F.col("sums")[j]).alias(f"x{j}") for j in range(4)])
    c = F.coalesce("c", F.lit(0.0))
    turn = F.atan2(F.col("x0") - c * F.col("x1"), F.greatest(F.col("x3") - 2 * c * F.col("x2") + F.col("of_n") * c * c, F.lit(1e-300)))
    values = {"centre": c, "wide": (F.col("q3") - F.col("q1")) / 1.349, "slope": 1.4826 * F.col("rise"), "curve": 1.4826 * F.col("bend"), "turn": turn, "spread": F.coalesce("step", F.lit(0.0)) / 0.954}
    return r.join(s, series.SERIES, "right").select(*series.SERIES, "of_n", (F.col("grain") / 2).alias("of_grain"), *[F.coalesce(v, F.lit(0.0)).alias(f"{k}{e}") for k, v in values.items()])


def implausible(event_df: DataFrame, unit_reference: DataFrame, term_reference: DataFrame, limit: int = 20_000, faults: Faults | None = None) -> DataFrame:
    """Readings of measured terms that cannot be true: event_id, kind (impossible, spike or stuck).

    Copies (equal content and instant under another event_id) count as one reading of the series and share its fate.
    Null or NaN values and terms of other kinds give no row; series of fewer than eight readings can only hold
    impossible values; a reading at either end of a series is no spike. Series longer than ``limit`` are read in
    blocks; what is measured by the series or the term is taken over all of its readings.
    """
    faults = faults or Faults()
    terms = units.read_terms(unit_reference, term_reference)
    measured = F.broadcast(event_df.sparkSession.createDataFrame([(n,) for n, m in zip(terms.names, terms.measured) if m], "normalized_term string"))  # at most MAX_UNITS rows
    events = event_df.join(measured, "normalized_term", "left_semi")
    decode = units.Decoder(terms, *units.population(units.level_source(events, terms), terms))
    every, twins = units.readings(events, terms, None, limit)
    rows = series.lone(every, twins).drop("source", "single")
    order = ["t", "chash", "row_id"]
    blocks = rows.filter("hot")
    shapes, e = None, 0
    if not blocks.isEmpty():
        blocks = cut_lineage(blocks.drop("hot"))
        while True:
            given = blocks if shapes is None else looked_up(blocks, shapes.drop("of_grain"), series.SERIES, "left", "row_id")
            counts = cut_lineage(series.over_series(given, order, Pass(terms, decode, faults, e, True), _PASS))
            if shapes is not None and counts.filter((F.col("what") == SERIES_PAIRS) & (F.col("bucket") > 0)).isEmpty():
                break
            new = _shape(counts, e)
            shapes = cut_lineage(new if shapes is None else shapes.join(new.drop("of_n", "of_grain"), series.SERIES))
            e += 1
    all_ = rows.drop("hot") if shapes is None else looked_up(rows.drop("hot"), shapes.drop("of_grain"), series.SERIES, "left", "row_id")
    out = cut_lineage(series.over_series(all_, order, Pass(terms, decode, faults, e), _PASS))

    pairs = out.filter(F.col("what") == TERM_PAIRS).groupBy("tix").agg(F.sum("bucket").alias("ties"), F.sum("count").alias("pairs"))
    share = out.filter(F.col("what") == OF_TERM).select("tix", "bucket", "count")
    found = out.filter(F.col("what") == EVENT)
    if shapes is not None:
        r = _ranks(out.filter(F.col("what") == OF_SERIES), [*series.SERIES, "sample"])
        last = r.groupBy(*series.SERIES).agg(F.max(F.when(F.col("sample") == LEVEL, F.col("mid"))).alias("_level"), (F.coalesce(F.max(F.when(F.col("sample") == STEP, F.col("mid"))), F.lit(0.0)) / 0.954).alias("_spread"))
        of = out.filter(F.col("what") == SERIES_PAIRS).groupBy(*series.SERIES).agg(((F.sum("count") > 0) & (F.sum("bucket") <= faults.steady * F.sum("count"))).alias("_changing"))
        term = found.filter("hot").select(*series.SERIES, "tix").distinct()
        ends = cut_lineage(of.join(last, series.SERIES, "left").join(shapes.select(*series.SERIES, "of_n", "of_grain"), series.SERIES).join(term, series.SERIES))
        b = F.col("_spread") / F.greatest(F.abs(F.col("_level")), F.lit(1e-9))
        k = F.floor(F.log2(b) * FINE).cast("bigint") + ABOVE
        share = share.unionByName(ends.filter("_spread > 0").select("tix", k.alias("bucket"), F.lit(1).cast("bigint").alias("count")))
        found = looked_up(found, ends.drop("tix"), series.SERIES, "left", "event_id")
        pick = lambda c, h: F.when(F.col("hot"), F.col(h)).otherwise(F.col(c))
        found = found.withColumns({"stuck": F.col("stuck") & (~F.col("hot") | F.coalesce("_changing", F.lit(False))), "n": pick("n", "of_n"), "spread": pick("spread", "_spread"), "level": pick("level", "_level"), "grain": pick("grain", "of_grain")})
    usual = _ranks(share, ["tix"]).select("tix", F.col("mid").alias("usual"))
    of_term = pairs.join(usual, "tix", "left").select("tix", "usual", (F.col("ties") <= faults.steady * F.col("pairs")).alias("moving"))
    found = found.join(F.broadcast(of_term), "tix", "left")  # at most MAX_UNITS rows
    kind = F.when(F.col("impossible"), KINDS[0]).when(faults.spike(), KINDS[1]).when(F.col("stuck") & F.col("moving"), KINDS[2])
    return series.for_twins(found.select("event_id", kind.alias("kind")).filter("kind is not null"), every, twins, "event_id")


def resolution(raw: np.ndarray) -> np.ndarray:
    """Largest of 1, 0.1, 0.01 and 0.001 in which the recorded value is whole."""
    out = np.full(len(raw), 0.001)
    for d, step in ((2, 0.01), (1, 0.1), (0, 1.0)):
        out[np.abs(raw * 10**d - np.rint(raw * 10**d)) < 1e-6] = step
    return out
