"""Joins whose large side may have a key that holds a great share of its rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that are broadcast at most; larger sides meet their rows by key and salt.
MAX_BROADCAST = 20_000
#: Parts that the rows of every key are cut into where the small side is not broadcast.
SALTS = 64


def looked_up(big: DataFrame, small: DataFrame, keys: list[str], how: str, spread_by: str) -> DataFrame:
    """big joined with small, which has one row a key, whatever the sizes of both and of the groups of big.

    A side of up to MAX_BROADCAST rows is broadcast. A larger one is repeated once for each of SALTS parts, and the
    rows of big are cut into these by a hash of ``spread_by``, so that a hot key is spread over as many tasks.
    """
    if small.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(F.lit("salt"), spread_by), F.lit(SALTS)).cast("int")
    wide = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", salt).join(wide, [*keys, "_salt"], how).drop("_salt")


def salted_join(big: DataFrame, small: DataFrame, key: str, count: str, spread_by: str, how: str = "left", most: int = 1_000_000) -> DataFrame:
    """big joined with small on key, where small has one row a key and tells in ``count`` how many rows big has of it.

    Keys with more than ``most`` rows are cut into parts by a hash of ``spread_by``; their rows of small are repeated
    once a part. The number of such keys is not limited.
    """
    hot = small.filter(F.col(count) > most).select(key, F.ceil(F.col(count) / most).cast("int").alias("_parts"))
    if hot.isEmpty():
        return big.join(small.drop(count), key, how)
    left = looked_up(big, hot, [key], "left", spread_by)
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts")), F.lit(0).cast("bigint"))).drop("_parts")
    parts = F.coalesce(F.ceil(F.col(count) / most), F.lit(1).cast("bigint"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop(count)
    return left.join(right, [key, "_salt"], how).drop("_salt")
