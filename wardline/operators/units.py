"""Quantities recorded in different units, converted to the common unit of their term.

A stated unit, in the unit column or standing in the text after the number, fixes the hidden state of a reading.
The unit of the others is decoded: a hidden Markov model per series (patient and term) has the unit as its state,
the deviation of the log value from the smooth level of the series as its emission, and sticky transitions; Viterbi
runs between neighbouring stated readings, which cut the chain exactly. As an exact check after it, a decoded unit
other than the common one holds only where that unit brings the value in line and the common one does not.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.catalog import bounded_rows
from wardline.operators import series

#: Ways in which units are written, by their clean code.
SPELLINGS = {
    "bpm": ["bpm", "/min", "beats/min", "b.p.m.", "beats per minute", "beats/minute"],
    "breaths/min": ["breaths/min", "/min", "rpm", "br/min", "breaths per minute", "resp/min"],
    "mmHg": ["mmHg", "mm Hg", "torr"],
    "kPa": ["kPa", "kilopascal", "kilopascals"],
    "C": ["C", "°C", "deg C", "degC", "celsius", "degrees C"],
    "F": ["F", "°F", "deg F", "degF", "fahrenheit", "degrees F"],
    "K": ["K", "kelvin"],
    "%": ["%", "pct", "percent"],
    "fraction": ["fraction", "(0-1)", "0-1", "frac", "ratio"],
    "mg/dL": ["mg/dL", "mg per dL", "mg%", "mgdL"],
    "umol/L": ["umol/L", "micromol/L", "umol per L", "uM", "mcmol/L"],
    "mmol/L": ["mmol/L", "mM", "mmol per L", "millimol/L"],
    "mEq/L": ["mEq/L", "mEq per L"],
    "g/dL": ["g/dL", "gm/dL", "g per dL", "grams/dL", "g%"],
    "g/L": ["g/L", "grams/L", "g per L", "gm/L"],
    "10^9/L": ["10^9/L", "x10^9/L", "10*9/L", "x10*9/L", "x10e9/L", "10e9/L", "Giga/L", "G/L"],
    "cells/uL": ["cells/uL", "/uL", "cells/mm3", "/cmm", "/mm3", "cells/cmm", "cells per uL"],
    "K/uL": ["K/uL", "thou/uL", "k/cmm", "10^3/uL", "x10^3/uL", "thousand/uL"],
    "ng/mL": ["ng/mL", "ng per mL"],
    "ng/L": ["ng/L", "ng per L"],
    "pg/mL": ["pg/mL", "pg per mL"],
    "ug/L": ["ug/L", "mcg/L", "ug per L"],
    "mg/L": ["mg/L", "mg per L"],
    "U/L": ["U/L", "units/L", "unit/L", "u per L"],
    "IU/L": ["IU/L"],
    "ukat/L": ["ukat/L", "microkat/L"],
    "kg": ["kg", "kgs", "kilos", "kilograms", "kilo"],
    "lb": ["lb", "lbs", "pounds", "pound", "#"],
    "mL": ["mL", "milliliters", "millilitres", "mls"],
    "L": ["L", "liters", "litre", "litres", "liter"],
    "cc": ["cc", "ccs"],
    "pH": ["pH", "ph units", "ph unit"],
    "points": ["points", "pts", "/15", "point", "pt"],
}

MAX_UNITS = 10_000


#: Left out of a spelling: white space, stops and the like; the two signs for micro become u.
_OUT = "µμ \u00a0\t\r\n.,;:"


def key_of(text: str) -> str:
    """A spelling without case, space, stops and the two signs for micro."""
    return text.translate({ord(c): "u" if i < 2 else None for i, c in enumerate(_OUT)}).lower()


def key(c: Column) -> Column:
    return F.lower(F.translate(c, _OUT, "uu"))


@dataclass(frozen=True)
class Terms:
    """The measured terms: units, their factors and shifts, the place of the common unit, spellings, physical bounds."""

    names: list[str]
    codes: list[list[str]]
    factor: np.ndarray
    shift: np.ndarray
    n_units: np.ndarray
    common: np.ndarray
    low: np.ndarray
    high: np.ndarray
    measured: np.ndarray
    spellings: list[dict[str, int]] = field(repr=False)


def read_terms(unit_reference: DataFrame, term_reference: DataFrame | None = None) -> Terms:
    """From the reference tables, at most MAX_UNITS rows each. A term without units gets its common unit alone."""
    units: dict[str, dict[str, tuple[float, float]]] = {}
    for r in bounded_rows(unit_reference.select("term", "unit_code", "factor", "shift"), MAX_UNITS, "unit_reference"):
        if r.term is not None and r.unit_code is not None:
            units.setdefault(r.term, {})[r.unit_code] = (1.0 if r.factor is None else r.factor, r["shift"] or 0.0)
    bounds, usual = {}, {}
    if term_reference is not None:
        for r in bounded_rows(term_reference.select("term", "kind", "common_unit", "phys_low", "phys_high"), MAX_UNITS, "term_reference"):
            if r.term is not None and r.kind == "measurement":
                bounds[r.term], usual[r.term] = (r.phys_low, r.phys_high), r.common_unit
                units.setdefault(r.term, {r.common_unit or "": (1.0, 0.0)})
    names = sorted(units)
    k = max([1, *(len(units[n]) for n in names)])
    factor, shift = np.ones((len(names), k)), np.zeros((len(names), k))
    codes, spellings, common = [], [], []
    for i, n in enumerate(names):
        own = sorted(units[n], key=lambda c: (c != usual.get(n), units[n][c] != (1.0, 0.0), c))  # the common unit comes first
        codes.append(own)
        common.append(0)
        words: dict[str, int] = {}
        for j, c in enumerate(own):
            factor[i, j], shift[i, j] = units[n][c]
            words.setdefault(key_of(c), j)
        for j, c in enumerate(own):
            for s in SPELLINGS.get(c, []):
                words.setdefault(key_of(s), j)
        spellings.append(words)
    side = lambda j, d: np.array([d if bounds.get(n, (None, None))[j] is None else bounds[n][j] for n in names], float)
    return Terms(names, codes, factor, shift, np.array([len(c) for c in codes], int), np.array(common, int), side(0, -np.inf), side(1, np.inf), np.array([n in bounds for n in names], bool), spellings)


def with_stated_unit(df: DataFrame, terms: Terms, term: str = "normalized_term", unit: str = "unit", text: str | None = "source_entity") -> DataFrame:
    """Inner join with the terms; adds tix (term number) and stated (number of the stated unit, -1 where none is)."""
    spark = df.sparkSession
    rows = [(n, i, terms.spellings[i]) for i, n in enumerate(terms.names)]
    dim = F.broadcast(spark.createDataFrame(rows, "_term string, tix int, _lex map<string,int>"))  # at most MAX_UNITS rows
    df = df.join(dim, F.col(term) == F.col("_term"))
    found = F.try_element_at("_lex", key(F.col(unit)))
    if text:
        lone = F.col(unit).isNull() & F.col(text).isNotNull()
        df = df.withColumn("_t", F.when(lone, F.translate(F.col(text), "\"*'", "")))
        df = df.withColumn("_w", F.when(F.col("_t").isNotNull(), F.split(F.ltrim(F.regexp_extract("_t", r"(?:^|[\s(:=])[-+]?[0-9]++(?:\.[0-9]++)?+(.*)$", 1)), r"\s+", 4)))
        first = lambda n: F.try_element_at("_lex", key(F.array_join(F.slice("_w", 1, n), "")))
        brackets = F.when(F.contains("_t", F.lit("(")), F.try_element_at("_lex", key(F.regexp_extract("_t", r"\((\([^()]*\)|[^()]*)\)", 1))))
        found = F.when(F.col(unit).isNotNull(), found).otherwise(F.coalesce(brackets, first(3), first(2), first(1)))
    return df.withColumn("stated", F.coalesce(found, F.lit(-1))).drop("_term", "_lex", "_t", "_w")


def population(stated: DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Median and robust spread of the log of converted values, by term, from readings with a stated unit."""
    spark = stated.sparkSession
    n, k = terms.factor.shape
    dim = F.broadcast(spark.createDataFrame([(i, [float(x) for x in terms.factor[i]], [float(x) for x in terms.shift[i]]) for i in range(n)], "tix int, _f array<double>, _s array<double>")) if n else None
    # of terms without such readings the middle of the bounds, or else nothing, is known
    low, high = np.maximum(terms.low, 1e-3), terms.high
    bounded = np.isfinite(low) & np.isfinite(high) & (high > low)
    mid = np.log(np.where(bounded, (low + high) / 2, 1.0))
    spread = np.where(bounded, np.maximum(0.3, np.log(np.where(bounded, high, 1.0) / np.where(bounded, low, 1.0)) / 4), 1e6)
    if dim is None:
        return mid, spread
    known = stated.filter(F.col("stated") >= 0).join(dim, "tix")
    x = F.col("value") * F.get("_f", F.col("stated")) + F.get("_s", F.col("stated"))
    bins = known.select("tix", F.floor(F.ln(F.when(x > 0, x)) * 100).cast("int").alias("bin")).filter("bin is not null").groupBy("tix", "bin").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("tix")
    bins = bins.withColumns({"cum": F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(of)})
    at = lambda q: (F.min(F.when(F.col("cum") >= F.col("all") * F.lit(q), F.col("bin"))) + 0.5) / 100
    # one row for each term reaches the driver
    for r in bins.groupBy("tix").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3")).collect():
        mid[r.tix], spread[r.tix] = r.q2, max(0.02, (r.q3 - r.q1) / 1.349)
    return mid, spread


@dataclass(frozen=True)
class Decoder:
    """Viterbi over the readings without a stated unit, for chunks of whole series in time order."""

    terms: Terms
    mid: np.ndarray
    spread: np.ndarray
    stay: float = 0.7
    usual: float = 0.9
    freedom: float = 4.0
    line: float = 4.0

    def __call__(self, x: dict[str, np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each row and its value in the common unit; rows with single = true stand outside the order."""
        T, n = self.terms, len(x["value"])
        tix, v, state = x["tix"], x["value"].astype(float), x["stated"].astype(np.int64).copy()
        seg = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        open_ = state < 0
        state[open_ & (T.n_units[tix] == 1)] = 0
        open_ = state < 0
        if open_.any():
            state[open_] = self.decode(x, tix, v, state, seg, np.flatnonzero(open_), len(begin))
        with np.errstate(over="ignore", invalid="ignore"):
            return state, v * T.factor[tix, state] + T.shift[tix, state]

    def decode(self, x: dict, tix: np.ndarray, v: np.ndarray, state: np.ndarray, seg: np.ndarray, rows: np.ndarray, n_seg: int) -> np.ndarray:
        T, k = self.terms, self.terms.factor.shape[1]
        log = lambda y: np.where(y > 0, np.log(np.where(y > 0, y, 1)), np.nan)
        with np.errstate(over="ignore", invalid="ignore"):
            known = np.flatnonzero((state >= 0))
            lx = log(v[known] * T.factor[tix[known], state[known]] + T.shift[tix[known], state[known]])
            known, lx = known[np.isfinite(lx)], lx[np.isfinite(lx)]
            # level: median of the nearest stated readings of the series, four on either side
            at = np.searchsorted(known, rows)[:, None] + np.arange(-4, 4)[None, :]
            inside = (at >= 0) & (at < len(known))
            near = np.where(inside, at, 0)
            if len(known):
                inside &= seg[known[near]] == seg[rows][:, None]
                around = np.sort(np.where(inside, lx[near], np.nan), axis=1)  # NaN last
            else:
                around = np.full(near.shape, np.nan)
            m = inside.sum(1)
            pick = lambda j: around[np.arange(len(rows)), np.clip(j, 0, 7)]
            pop, wide = self.mid[tix[rows]], self.spread[tix[rows]]
            own = (pick((m - 1) // 2) + pick(m // 2)) / 2
            own = np.where(m > 0, own, pop)
            dev = np.sort(np.abs(around - own[:, None]), axis=1)
            mad = np.where(m > 0, (dev[np.arange(len(rows)), np.clip((m - 1) // 2, 0, 7)] + dev[np.arange(len(rows)), np.clip(m // 2, 0, 7)]) / 2, 0) * 1.4826
            # a series of few readings says less of its level and spread than the term does
            weight = m / (m + 0.25)
            level = weight * own + (1 - weight) * pop
            within = np.sqrt((m * np.maximum(mad, 0.01) ** 2 + 2 * (0.4 * wide) ** 2) / (m + 2))
            sd = np.where(m > 0, within * np.sqrt(1 + 1 / np.maximum(m, 1)), wide)
            y = log(v[rows][:, None] * T.factor[tix[rows]] + T.shift[tix[rows]])
            z = np.abs(y - level[:, None]) / sd[:, None]
            z[~np.isfinite(z)] = np.inf
            emit = -(self.freedom + 1) / 2 * np.log1p(np.minimum(z, 1e6) ** 2 / self.freedom)  # Student's t: strange values say little
            z_term = np.abs(y - pop[:, None]) / np.maximum(wide, 0.05)[:, None]
            fits = (z <= self.line) | (z_term <= self.line * 0.75)
        have = np.arange(k)[None, :] < T.n_units[tix[rows]][:, None]
        emit[~have] = -np.inf
        others = np.maximum(T.n_units[tix[rows]] - 1, 1)[:, None]
        prior = np.where(np.arange(k)[None, :] == 0, self.usual, (1 - self.usual) / others)
        prior[~have] = 0
        move = (1 - self.stay) * prior[:, None, :] + self.stay * np.eye(k)[None]
        with np.errstate(divide="ignore"):
            move, prior = np.log(move), np.log(prior)  # move[row, from, to]
        alone = x["single"][rows] if "single" in x else np.zeros(len(rows), bool)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1] + 1) | (seg[rows[1:]] != seg[rows[:-1]]) | alone[1:] | alone[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(rows)))
        by = np.argsort(-size, kind="stable")
        begin, size = begin[by], size[by]

        def pinned(r: np.ndarray, step: int, single: np.ndarray) -> np.ndarray:
            """The stated unit of the neighbouring row in the series, or -1."""
            to = r + step
            ok = (to >= 0) & (to < len(seg)) & ~single
            to = np.where(ok, to, 0)
            ok &= seg[to] == seg[r]
            if "single" in x:
                ok &= ~x["single"][to]
            return np.where(ok, state[to], -1)

        left, right = pinned(rows[begin], -1, alone[begin]), pinned(rows[begin + size - 1], 1, alone[begin])
        score, back = np.empty_like(emit), np.zeros(emit.shape, np.int64)
        i = begin
        score[i] = emit[i] + np.where((left >= 0)[:, None], move[i, np.maximum(left, 0)], prior[i])
        for j in range(1, int(size[0])):
            i = begin[: np.searchsorted(-size, -j)] + j  # runs longer than j
            step = score[i - 1][:, :, None] + move[i]
            back[i], score[i] = step.argmax(1), step.max(1) + emit[i]
        last = begin + size - 1
        score[last] += np.where((right >= 0)[:, None], move[last, :, np.maximum(right, 0)], 0)
        best = np.zeros(len(rows), np.int64)
        best[last] = score[last].argmax(1)
        for j in range(int(size[0]) - 1, 0, -1):
            i = begin[: np.searchsorted(-size, -j)] + j
            best[i - 1] = back[i, best[i]]
        r = np.arange(len(rows))
        return np.where(fits[r, best] & (z[:, 0] > self.line), best, 0)


def instant(df: DataFrame) -> Column:
    """Microseconds of charted_at, else of loaded_at, else 0."""
    have = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("charted_at", "loaded_at") if c in df.columns]
    return F.coalesce(*have, F.lit(0).cast("bigint"))


def valued(df: DataFrame) -> DataFrame:
    return df.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("normalized_term").isNotNull())


def readings(event_df: DataFrame, terms: Terms, baselines_df: DataFrame | None = None, limit: int = 20_000) -> tuple[DataFrame, bool]:
    """Rows with a value and a term that has units, from both tables in one layout, keyed by series and cut into blocks;
    and whether there are twins, more copies of a reading than fit into a block.

    Columns: s1 and s2 (the series of patient and term), source (0 event_df, 1 baselines_df), row_id, tix, stated, value,
    t (microseconds), chash (hash of the content, equal in copies), single (a baseline: outside the order of time),
    block, core, hot, twin. Readings without charted_at are placed by loaded_at, else at 0. Baselines of a series in blocks
    are read in its first one.
    """
    content = [c for c in ("value", "unit", "source_entity", "day_offset_start", "day_offset_end", "is_active", "is_started", "is_ended", "history") if c in event_df.columns]
    keys = ["patient_id", "normalized_term"]
    ev = valued(event_df.select(F.col("event_id").cast("bigint").alias("row_id"), *keys, F.col("value").cast("double").alias("value"), "unit", "source_entity", instant(event_df).alias("t"), F.xxhash64(*content).alias("chash")))
    ev, twins = series.in_blocks(series.keyed(ev, keys), limit)
    ev = with_stated_unit(ev, terms)
    ev = ev.select("s1", "s2", F.lit(0).alias("source"), "row_id", "tix", "stated", "value", "t", "chash", F.lit(False).alias("single"), "block", "core", "hot", "twin")
    if baselines_df is None:
        return ev, twins
    base = with_stated_unit(series.keyed(valued(baselines_df), keys), terms, text=None)
    zero = F.lit(0).cast("bigint")
    base = base.select("s1", "s2", F.lit(1).alias("source"), F.col("baseline_id").cast("bigint").alias("row_id"), "tix", "stated", F.col("value").cast("double").alias("value"), zero.alias("t"), zero.alias("chash"), F.lit(True).alias("single"), F.lit(0).alias("block"), F.lit(True).alias("core"), F.lit(False).alias("hot"), F.lit(False).alias("twin"))
    return ev.unionByName(base), twins


def level_source(event_df: DataFrame, terms: Terms) -> DataFrame:
    """All readings with their stated units, for the level of each term; texts are read only where the unit is missing."""
    e, out = valued(event_df), ["tix", "stated", "value"]
    written = with_stated_unit(e.filter(F.col("unit").isNotNull()), terms, text=None).select(*out)
    return written.unionByName(with_stated_unit(e.filter(F.col("unit").isNull() & F.col("source_entity").isNotNull()), terms).select(*out))


def convert_units(event_df: DataFrame, unit_reference: DataFrame, term_reference: DataFrame | None = None, baselines_df: DataFrame | None = None, limit: int = 20_000) -> DataFrame:
    """Every value with a term, in the common unit: source_table, row_id, normalized_term, unit_code, decoded, other, value_common.

    decoded: the unit was not stated but decoded. other: the unit has a factor other than 1 or a shift other than 0.
    Null or NaN values, null terms and terms without units give no row; an unknown spelling counts as not stated; a
    value that is in line in no unit is held to be in the common one. Series longer than ``limit`` are read in blocks.
    """
    terms = read_terms(unit_reference, term_reference)
    rows, twins = readings(event_df, terms, baselines_df, limit)
    decode = Decoder(terms, *population(level_source(event_df, terms), terms))
    other = (terms.factor != 1) | (terms.shift != 0)

    def run(x: dict[str, np.ndarray]) -> list[pa.RecordBatch]:
        state, y = decode(x, series.starts(x["s1"], x["s2"], x["block"]))
        core = x["core"]
        tix, s = x["tix"][core], state[core]
        return pa.table({"source": pa.array(x["source"][core], pa.int32()), "row_id": x["row_id"][core], "tix": pa.array(tix, pa.int32()), "state": pa.array(s, pa.int32()), "decoded": (x["stated"][core] < 0), "other": other[tix, s], "value_common": y[core]}).to_batches(max_chunksize=100_000)

    out = series.over_series(series.lone(rows, twins).drop("hot"), ["single", "t", "chash", "row_id"], run, "source int, row_id bigint, tix int, state int, decoded boolean, other boolean, value_common double")
    if twins:
        out = out.filter("source = 1").unionByName(series.for_twins(out.filter("source = 0"), rows.filter("source = 0"), twins))
    names = F.array(*[F.lit(n) for n in terms.names]) if terms.names else F.array().cast("array<string>")
    codes = F.array(*[F.array(*[F.lit(c) for c in cs]) for cs in terms.codes]) if terms.names else F.array().cast("array<array<string>>")
    return out.select(
        F.when(F.col("source") == 0, "event_df").otherwise("baselines_df").alias("source_table"), "row_id", F.get(names, F.col("tix")).alias("normalized_term"),
        F.get(F.get(codes, F.col("tix")), F.col("state")).alias("unit_code"), "decoded", "other", "value_common",
    )


def recorded_otherwise(converted: DataFrame) -> DataFrame:
    """The rows recorded in a unit other than the common one: source_table, row_id."""
    return converted.filter("other").select("source_table", "row_id")
