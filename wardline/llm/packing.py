"""Containers of fixed capacity filled by shortest-pack-first over the histogram of lengths."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut_lineage

#: Items of one length that are ranked in one task.
RANKED = 100_000


def patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of packs, [(length, items of it a pack)]) so that the packs hold histogram[length] items of each length.

    Lengths are placed longest first, each into the pack with the most room; packs of one pattern are one entry with a
    count, so the work and the result grow with the capacity, not with the number of items: a length opens at most one
    pattern and divides at most one.
    """
    room: list[tuple[int, int, int, tuple]] = []  # (-room, order, count, content)
    order = 0
    for length in range(min(capacity, len(histogram) - 1), 0, -1):
        left = int(histogram[length])
        while left:
            if room and -room[0][0] >= length:
                neg, o, count, content = heapq.heappop(room)
                used = min(count, left)
                if used < count:
                    heapq.heappush(room, (neg, o, count - used, content))
                order += 1
                heapq.heappush(room, (neg + length, order, used, add(content, length)))
                left -= used
            else:
                # no pack has room: as many new ones as the items of this length fill, each with as many as it holds
                fit = capacity // length
                packs, rest = divmod(left, fit)
                for count, each in ((packs, fit), (1, rest)):
                    if count and each:
                        order += 1
                        heapq.heappush(room, (each * length - capacity, order, count, ((length, each),)))
                left = 0
    return [(count, list(content)) for _, _, count, content in sorted(room, key=lambda x: x[1])]


def add(content: tuple, length: int) -> tuple:
    if content and content[-1][0] == length:
        return (*content[:-1], (length, content[-1][1] + 1))
    return (*content, (length, 1))


def items(counts: DataFrame, key: str, capacity: int) -> DataFrame:
    """key, piece, n_tokens, token_from: one row for each item that fits, several for one beyond the capacity."""
    n = F.ceil(F.greatest("n_tokens", F.lit(1)) / capacity).cast("int")
    cut = counts.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    at = F.col("piece").cast("bigint") * capacity
    return cut.select(key, "piece", F.least(F.col("n_tokens") - at, F.lit(capacity)).cast("int").alias("n_tokens"), at.alias("token_from"))


def pack(counts: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Containers for all rows of (key, n_tokens): key, piece, token_from, n_tokens, container, slot.

    A row beyond the capacity is divided into full containers' worth and a rest; no other is divided. Rows without
    tokens take no room and stand in container 0. Null sizes give no row; equal keys are packed as rows of their own.
    The histogram of lengths, at most capacity + 1 counts, is all that reaches the driver; items are ranked within
    their length in parts of some RANKED rows, and find their container by rank.
    """
    spread = cut_lineage(items(counts.filter(F.col("n_tokens").isNotNull()), key, capacity))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in spread.groupBy("n_tokens").count().collect():
        histogram[r.n_tokens] = r["count"]
    parts = [max(1, -(-int(n) // RANKED)) for n in histogram]
    salt = F.pmod(F.xxhash64(key, "piece"), F.get(F.array(*[F.lit(p) for p in parts]), F.col("n_tokens"))).cast("int") if max(parts) > 1 else F.lit(0)
    salted = spread.withColumn("_salt", salt)
    before = salted.groupBy("n_tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("n_tokens", "_salt", (F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece")) - 1
    ranked = salted.withColumn("_within", within).join(before, ["n_tokens", "_salt"]).withColumn("_rank", F.col("_within") + F.col("_before"))

    starts, bases, each = [], [], []
    given = np.zeros(capacity + 1, np.int64)
    base = 0
    for count, content in patterns(histogram, capacity):
        for length, m in content:
            starts.append((length << 44) + int(given[length]))
            bases.append(base)
            each.append(m)
            given[length] += count * m
        base += count
    by = np.argsort(np.array(starts, np.int64), kind="stable")
    start, first, size = (np.array(x, np.int64)[by] for x in (starts, bases, each))

    @F.arrow_udf("struct<container:bigint,slot:int>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(start):
            return pa.StructArray.from_arrays([pa.array(np.zeros(len(n), np.int64)), pa.array(np.zeros(len(n), np.int32))], ["container", "slot"])
        i = np.maximum(np.searchsorted(start, (n << 44) + r, side="right") - 1, 0)
        at = r - (start[i] & ((1 << 44) - 1))
        none = n == 0
        return pa.StructArray.from_arrays([pa.array(np.where(none, 0, first[i] + at // size[i])), pa.array(np.where(none, 0, at % size[i]).astype(np.int32))], ["container", "slot"])

    return ranked.withColumn("_p", place("n_tokens", "_rank")).select(key, "piece", "token_from", "n_tokens", "_p.container", "_p.slot")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: items, containers, tokens and the share of the room that is used (null without containers)."""
    return packed.agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.max("container") + 1, F.lit(0)).alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    ).withColumn("used", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
