"""Measured series: one partition pass over readings in time order.

Rows are spread by a 128-bit hash of the series key, sorted by time inside each partition and handed to numpy in
chunks that always hold whole series. Series longer than a limit are cut into blocks of consecutive readings with
overlapping edges, so that no key, however hot, is held by one task.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.skew import looked_up
from wardline.session import cut_lineage

#: Cells that a stretch of a hot series is divided into at once.
PARTS = 256
#: Rows of the neighbouring blocks that a block sees on either side, at least.
EDGE = 64
SERIES = ["s1", "s2"]


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds s1 and s2, a 128-bit hash of the keys that names the series of a row. Null keys are keys like others."""
    return df.withColumns({"s1": F.xxhash64(*keys), "s2": F.xxhash64(F.lit("second"), *keys)})


def in_blocks(df: DataFrame, limit: int, t: str = "t", tie: str = "chash") -> tuple[DataFrame, bool]:
    """Adds block (int), core, hot and twin (boolean) to rows of keyed series; and whether there are twins.

    Series of up to ``limit`` rows are block 0, not hot.

    Longer ones are cut by rank in the order of t and tie, into blocks of about ``limit`` rows: cells of equal width
    are counted, those that hold more than a quarter of the limit are divided again, by t and, where they hold one
    instant, by tie; cells in a row make a block. Cells within EDGE rows of a border are copied to the neighbouring
    block with core = false. Rows of equal t and tie (copies) stay together; where there are more than ``limit`` of
    them, they are marked as twins and count as one row, see lone. Counts, not samples, decide, so the cuts depend on
    the rows alone. t and tie are bigints without nulls.
    """
    x = df.withColumns({"_t": F.col(t), "_h": F.shiftright(tie, 2)})  # two bits less, so that no difference overflows
    size = [F.count(F.lit(1)).alias("_n"), *[f(c).alias(a) for c, lo, hi in (("_t", "_t0", "_t1"), ("_h", "_h0", "_h1")) for f, a in ((F.min, lo), (F.max, hi))]]
    found = cut_lineage(x.groupBy(*SERIES).agg(*size).filter(F.col("_n") > limit))
    if found.isEmpty():
        return df.withColumns({"block": F.lit(0), "core": F.lit(True), "hot": F.lit(False), "twin": F.lit(False)}), False
    nodes, leaves, path = [], [], []
    rows = x
    while True:
        k = len(nodes)
        by_t = F.col("_t0") < F.col("_t1")
        lo, hi = F.when(by_t, F.col("_t0")).otherwise(F.col("_h0")), F.when(by_t, F.col("_t1")).otherwise(F.col("_h1"))
        node = found.select(*SERIES, *path, by_t.alias(f"_by{k}"), lo.alias(f"_lo{k}"), hi.alias("_hi")).withColumn(f"_w{k}", F.expr(f"(_hi - _lo{k}) div {PARTS} + 1")).drop("_hi")
        nodes.append(node)
        rows = looked_up(rows, node, [*SERIES, *path], "inner", "row_id").withColumn(f"_c{k}", _cell(k))
        path = [*path, f"_c{k}"]
        cells = cut_lineage(rows.groupBy(*SERIES, *path).agg(*size))
        wide = (F.col("_n") > max(1, limit // 4)) & ((F.col("_t0") < F.col("_t1")) | (F.col("_h0") < F.col("_h1")))
        leaves.append(cells.filter(~wide).select(*SERIES, F.array(*path).alias("path"), F.when(F.col("_n") > limit, 1).otherwise(F.col("_n")).alias("_n"), (F.col("_n") > limit).alias("_twin")))
        found = cells.filter(wide)
        if found.isEmpty():
            break
    every = leaves[0]
    for x_ in leaves[1:]:
        every = every.unionByName(x_)
    of = Window.partitionBy(*SERIES)
    running = of.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumns({"_cum": F.sum("_n").over(running) - F.col("_n"), "_all": F.sum("_n").over(of)})
    every = every.withColumn("block", F.least(F.floor(F.col("_cum") / limit), F.greatest(F.floor(F.col("_all") / limit) - 1, F.lit(0).cast("bigint"))).cast("int"))
    one = Window.partitionBy(*SERIES, "block")
    head = F.col("_cum") - F.min("_cum").over(one) < EDGE
    tail = F.max(F.col("_cum") + F.col("_n")).over(one) - F.col("_cum") - F.col("_n") < EDGE
    coded = cut_lineage(every.select(*SERIES, "path", "_twin", (F.col("block") * 8 + F.when(F.col("_twin"), 4).otherwise(0) + F.when(head & (F.col("block") > 0), 2).otherwise(0) + F.when(tail & (F.col("block") < F.max("block").over(of)), 1).otherwise(0)).alias("code")))
    out, code = df.withColumns({"_t": F.col(t), "_h": F.shiftright(tie, 2)}), []
    for k, node in enumerate(nodes):
        mine = coded.filter(F.size("path") == k + 1).select(*SERIES, *[F.col("path")[j].alias(f"_c{j}") for j in range(k)], F.struct(F.col("path")[k].alias("c"), "code").alias("e"))
        m = mine.groupBy(*SERIES, *path[:k]).agg(F.map_from_entries(F.collect_list("e")).alias("_m"))  # up to PARTS entries
        m = m.select(*SERIES, *path[:k], F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.try_element_at("_m", i)).alias(f"_codes{k}"))
        node = cut_lineage(node.join(m, [*SERIES, *path[:k]], "left"))
        out = looked_up(out, node, [*SERIES, *path[:k]], "left", "row_id").withColumn(path[k], _cell(k))
        code.insert(0, F.get(f"_codes{k}", F.col(path[k])))
    out = out.withColumn("_code", F.coalesce(*code))
    b = F.shiftright("_code", 3)
    place = lambda at, core: F.array(F.struct(at.cast("int").alias("block"), F.lit(core).alias("core")))
    none = F.array().cast("array<struct<block:int,core:boolean>>")
    has = lambda bit: F.col("_code").bitwiseAND(F.lit(bit)) > 0
    blocks = F.when(F.col("_code").isNull(), place(F.lit(0), True)).otherwise(F.concat(place(b, True), F.when(has(2), place(b - 1, False)).otherwise(none), F.when(has(1), place(b + 1, False)).otherwise(none)))
    out = out.withColumn("_p", F.explode(blocks)).select(*df.columns, "_p.block", "_p.core", F.col("_code").isNotNull().alias("hot"), F.coalesce(has(4), F.lit(False)).alias("twin"))
    return out, not coded.filter("_twin").isEmpty()


TWINS = [*SERIES, "t", "chash"]


def lone(rows: DataFrame, twins: bool) -> DataFrame:
    """rows (row_id and what is equal in copies) with one row, that of the lowest row_id, for each group of twins."""
    if not twins:
        return rows.drop("twin")
    by = [*TWINS, "block"]
    one = rows.filter("twin").groupBy(*by).agg(F.min("row_id").alias("row_id"), *[F.first(c).alias(c) for c in rows.columns if c not in (*by, "row_id")])
    return rows.filter(~F.col("twin")).unionByName(one).drop("twin")


def for_twins(judged: DataFrame, rows: DataFrame, twins: bool, key: str = "row_id") -> DataFrame:
    """judged (one row a ``key``), with the row of the lowest key of each group of twins repeated for all others of it."""
    if not twins:
        return judged
    of = rows.filter("twin and core").select("row_id", *TWINS)
    first = cut_lineage(of.groupBy(*TWINS).agg(F.min("row_id").alias("_first")))
    found = cut_lineage(judged.join(first.select(F.col("_first").alias(key)), key, "left_semi"))
    others = looked_up(of, first, TWINS, "inner", "row_id").filter("row_id <> _first").select(F.col("row_id").alias("_other"), F.col("_first").alias(key))
    more = looked_up(others, found, [key], "inner", "_other").drop(key).withColumnRenamed("_other", key)
    return judged.unionByName(more.select(*judged.columns))


def _cell(k: int) -> Column:
    return F.expr(f"CAST((CASE WHEN _by{k} THEN _t ELSE _h END - _lo{k}) div _w{k} AS INT)")


def chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole blocks of series, ``least`` rows or more at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns(x: pa.Table) -> dict[str, np.ndarray]:
        return {c: x.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in x.column_names}

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        x = pa.Table.from_batches(held)
        cut = starts(*[x.column(c).to_numpy() for c in (*SERIES, "block")])
        if len(cut) > 1:
            yield columns(x.slice(0, k := int(cut[-1])))
            x = x.slice(k)
        held, n = x.combine_chunks().to_batches(), x.num_rows
        least = max(least, 2 * n)
    if n:
        yield columns(pa.Table.from_batches(held))


def over_series(df: DataFrame, order: list[str], f: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str, least: int = 200_000) -> DataFrame:
    """Runs ``f`` over chunks of whole blocks of keyed series. df holds numbers and booleans only."""
    by = [*SERIES, "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in chunks(batches, least):
            yield from f(x)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def starts(*ids: np.ndarray) -> np.ndarray:
    """Where a series begins: row numbers, the first of them 0."""
    n = len(ids[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for x in ids:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def ranked(seg: np.ndarray, x: np.ndarray, k: int, *at: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The values at each of the ranks at(n) of the n values of x in each of the segments 0..k-1, and n; NaN is no value."""
    ok = ~np.isnan(x)
    seg, x = seg[ok], x[ok]
    x = x[np.lexsort((x, seg))]
    n = np.bincount(seg, minlength=k)
    begin, some = np.cumsum(n) - n, n > 0
    out = [np.full(k, np.nan) for _ in at]
    for o, f in zip(out, at):
        o[some] = x[(begin + f(n))[some]]
    return [*out, n]


def medians(seg: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of x and count in each of the segments 0..k-1; NaN where there are no values."""
    low, high, n = ranked(seg, x, k, lambda m: (m - 1) // 2, lambda m: m // 2)
    return (low + high) / 2, n
