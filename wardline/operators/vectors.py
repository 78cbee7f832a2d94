"""Exact nearest neighbours of a set of query vectors among all vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in the query vectors that are sent to every task at most (8 bytes each); more queries are met by blocks.
SENT = 8_000_000
#: Vectors and queries in a block; a pair of blocks is scored by one matrix product.
VECTORS, QUERIES = 32_768, 2_048

_KINDS = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("similarity", pa.float64())])


def unit(x: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of unit length; rows without length, or of another dimension, become NaN."""
    none = [np.nan] * dimension
    m = np.array([r if r is not None and len(r) == dimension else none for r in x.to_pylist()], float).reshape(-1, dimension)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def common_dimension(vectors: DataFrame, embedding: str) -> int:
    """The dimension that most vectors have, the lower one of equals; 0 without vectors."""
    g = vectors.groupBy(F.size(embedding).alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0")
    top = g.orderBy(F.desc("n"), "d").first()
    return top.d if top else 0


def best_of(asked: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> pa.Table:
    """The k highest scores of each row of s, ties by the lower id. ids ascend."""
    if s.shape[1] > k:
        edge = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        few = np.flatnonzero((s >= edge).any(0))  # columns that are among the best of some query, all ties included
        ids, s = ids[few], s[:, few]
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    sim = np.take_along_axis(s, best, 1)
    ok = np.isfinite(sim).ravel()
    return pa.table({"query": np.repeat(asked, best.shape[1])[ok], "key": ids[best].ravel()[ok], "similarity": sim.ravel()[ok]}, schema=_KINDS)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query, key, similarity: for every query the k vectors with the highest cosine, itself among them if it is one.

    Queries of up to SENT numbers in all go to every task, and one pass over the vectors, which are not moved, keeps the
    best k of each partition. More queries meet the vectors by blocks: every pair of a block of queries and one of
    vectors is one task's matrix product. Either way the best k of all are taken at the end, and nothing is left out.
    Ties go to the lower key; vectors without length or of another dimension than most of the vectors have no neighbours
    and are none. Null embeddings are left out.
    """
    spark = vectors.sparkSession
    d = common_dimension(vectors, embedding)
    empty = spark.createDataFrame([], "query bigint, key bigint, similarity double")
    if not d:
        return empty
    fit = F.size(embedding) == d
    v = vectors.filter(fit).select(F.col(key).cast("bigint").alias("key"), F.col(embedding).alias("x"))
    q = queries.filter(fit).select(F.col(key).cast("bigint").alias("query"), F.col(embedding).alias("y"))
    n = q.count()
    if not n:
        return empty
    found = _sent(v, q, k, d) if n * d <= SENT else _by_blocks(v, q, n, k, d)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return found.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _sent(v: DataFrame, q: DataFrame, k: int, d: int) -> DataFrame:
    t = q.toArrow()  # at most SENT numbers
    sent = v.sparkSession.sparkContext.broadcast((t.column("query").to_numpy(), unit(t.column("y"), d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, y = sent.value
        step = max(1, 4_000_000 // VECTORS)
        held: list[pa.RecordBatch] = []
        best: list[pa.Table] = [_KINDS.empty_table() for _ in range(0, len(asked), step)]

        def score() -> None:
            x = pa.Table.from_batches(held)
            ids = x.column("key").to_numpy()
            order = np.argsort(ids, kind="stable")
            m, ids = unit(x.column("x"), d)[order], ids[order]
            for i, at in enumerate(range(0, len(asked), step)):
                s = np.nan_to_num(y[at : at + step] @ m.T, nan=-np.inf)
                best[i] = top(pa.concat_tables([best[i], best_of(asked[at : at + step], ids, s, k)]), k)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= VECTORS:
                score()
        if held:
            score()
        for t in best:
            yield from t.to_batches()

    return v.mapInArrow(run, "query bigint, key bigint, similarity double")


def top(t: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    query, key, sim = (t.column(c).to_numpy() for c in ("query", "key", "similarity"))
    order = np.lexsort((key, -sim, query))
    query = query[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    return t.take(order[rank < k])


def _by_blocks(v: DataFrame, q: DataFrame, n: int, k: int, d: int) -> DataFrame:
    nv, nq = max(1, -(-v.count() // VECTORS)), max(1, -(-n // QUERIES))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    v = v.withColumn("vb", part("key", nv)).withColumn("qb", all_(nq))
    q = q.withColumn("qb", part("query", nq)).withColumn("vb", all_(nv))

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _KINDS.empty_table()
        ids = a.column("key").to_numpy()
        order = np.argsort(ids, kind="stable")
        s = np.nan_to_num(unit(b.column("y"), d) @ unit(a.column("x"), d)[order].T, nan=-np.inf)
        return best_of(b.column("query").to_numpy(), ids[order], s, k)

    return v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(score, "query bigint, key bigint, similarity double")
