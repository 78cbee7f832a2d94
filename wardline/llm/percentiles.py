"""Percentiles of very large columns from counts in signed logarithmic buckets.

A value v > 0 falls into bucket ceil(ln v / ln g) with g = (1 + e) / (1 - e); every value of a bucket lies within the
relative error e of the bucket's estimate 2 g^i / (g + 1). Negative values have buckets of their own, zero one more.
A sketch is a table of counts (keys, bucket, n): sketches of partitions, days or clusters are put together by adding
the counts of equal buckets, in any order, without any loss of accuracy.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets are numbered sign * (index + OFFSET), so that order of bucket is order of value; indices lie within
#: OFFSET of zero for every finite double at errors of 0.0005 or more.
OFFSET = 1_000_000
INFINITE = 2**40


def gamma(error: float) -> float:
    if not 0.0005 <= error < 1:
        raise ValueError("error must be at least 0.0005 and below 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """Number of the bucket of a value; null for null and NaN. Infinite values have a bucket at either end."""
    v = value.cast("double")
    index = F.ceil(F.ln(F.abs(v)) / F.lit(math.log(gamma(error)))).cast("bigint") + OFFSET
    inf = F.lit(float("inf"))
    return F.when(F.isnan(v), None).when(v == inf, INFINITE).when(v == -inf, -INFINITE).when(v == 0, F.lit(0).cast("bigint")).when(v > 0, index).otherwise(-index)


def estimate(number: Column, error: float) -> Column:
    """The value that stands for a bucket."""
    g = gamma(error)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.abs(number) - OFFSET)
    return F.when(number == 0, 0.0).when(number >= INFINITE, float("inf")).when(number <= -INFINITE, float("-inf")).when(number > 0, size).otherwise(-size)


def sketch(df: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Counts by keys and bucket. Null and NaN values are left out; null keys are a group of their own."""
    b = df.select(*keys, bucket(F.col(value), error).alias("bucket")).filter("bucket is not null")
    return b.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(keys: list[str], *sketches: DataFrame) -> DataFrame:
    """One sketch from several, or from one with more keys than are wanted."""
    parts = [s.select(*keys, "bucket", "n") for s in sketches]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "bucket").agg(F.sum("n").cast("bigint").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], qs: list[float], error: float = 0.01) -> DataFrame:
    """keys, n and p<percent> for each q: the value of rank floor(q (n - 1)) counted from 0, within the relative error.

    Works on counts alone: a group has as many rows as buckets in use, at most a few thousand for real data.
    Groups without values give no row.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    running = counts.withColumns({"_c": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(Window.partitionBy(*keys))})
    name = lambda q: "p" + f"{q * 100:g}".replace(".", "_")
    at = [F.min(F.when(F.col("_c") > F.floor(F.lit(q) * (F.col("_all") - 1)), F.col("bucket"))).alias(name(q)) for q in qs]
    found = running.groupBy(*keys).agg(F.max("_all").cast("bigint").alias("n"), *at)
    return found.select(*keys, "n", *[estimate(F.col(name(q)), error).alias(name(q)) for q in qs])
