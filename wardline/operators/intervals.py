"""Overlapping and gapped intervals, merged by a sweep over their boundaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(event_df: DataFrame, term_reference: DataFrame, kinds: tuple[str, ...] = ("medication", "device", "condition")) -> DataFrame:
    """Active, not historical rows of terms of the kinds, with at least one day."""
    terms = term_reference.filter(F.col("kind").isin(*kinds)).select(F.col("term").alias("normalized_term")).distinct()
    days = F.coalesce("day_offset_start", "day_offset_end").isNotNull()
    return event_df.filter(F.col("is_active") & ~F.coalesce("history", F.lit(False)) & days).join(terms, "normalized_term", "left_semi")


def coverage(df: DataFrame, keys: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """Continuous periods per key and the gaps between them: keys, stretch (period or gap), day_from, day_to.

    Every interval adds one at its first day and takes one off the day after its last. The boundaries of a key are
    summed by day first, on the side of the scan, so that a key has at most one row for each distinct day however
    many intervals it holds; the running sum is the number of intervals open on a day. Days where it leaves zero begin
    a period, days where it returns to zero begin a gap; intervals that follow on the next day are one period.

    A missing day equals the other one, rows without any day are left out, days in the wrong order are exchanged.
    Null keys form a group like any other value. Repeated rows change nothing. An empty table gives no row.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    a, b = F.coalesce(col(start), col(end)).cast("bigint"), F.coalesce(col(end), col(start)).cast("bigint")
    d = df.select(*keys, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).filter(F.col("_a").isNotNull())
    marks = d.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("day"), F.lit(1).alias("d")), F.struct((F.col("_b") + 1).alias("day"), F.lit(-1).alias("d")))).alias("_m"))
    net = marks.groupBy(*keys, F.col("_m.day").alias("day")).agg(F.sum("_m.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy(*keys).orderBy("day")
    open_ = net.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turns = open_.filter((F.col("n") == 0) | (F.col("n") == F.col("d")))
    out = turns.withColumn("_next", F.lead("day").over(w)).filter(F.col("_next").isNotNull())
    return out.select(*keys, F.when(F.col("n") > 0, "period").otherwise("gap").alias("stretch"), F.col("day").cast("int").alias("day_from"), (F.col("_next") - 1).cast("int").alias("day_to"))
