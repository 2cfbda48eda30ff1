"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments, described by their means and deviations.  With
|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, the lower bound of a distance that these give is an
upper bound of the inner product: the sum over segments of n * (mq * mx + dq * dx).
It is tried from few long segments to many short ones; what can still reach a query's
k-th best score found so far gets its exact product.

Query blocks meet all blocks of rows: each task holds one block of either."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table
from sitelens.llm.vectors import BLOCK, QUERY_EVERY, best, packs, ranked, unpacked, usable

#: Numbers of segments, coarse to fine.
LEVELS = (4, 16, 32)
#: Queries of one block.
QUERY_BLOCK = 512
#: Rows compared between two rises of the threshold.
STRIDE = 512


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means, then deviations, of equal segments, each times the root of the segment's
    length: the product of two such rows bounds the vectors' inner product.  A last, shorter
    segment is filled up with zeros, which changes no inner product."""
    n = -(-x.shape[1] // segments)
    if n * segments != x.shape[1]:
        x = np.pad(x, ((0, 0), (0, n * segments - x.shape[1])))
    parts = x.reshape(len(x), segments, n)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(n)


def block_top(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each query's k best of a block of rows (integers in double precision, so products
    and their comparison are exact); rows with the query's own id are left out."""
    levels = tuple(s for s in levels if s <= x.shape[1])
    q_stats, x_stats = [segment_stats(q, s) for s in levels], [segment_stats(x, s) for s in levels]
    found = [(np.empty(0, dtype=np.int64), np.empty(0)) for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)
    for start in range(0, len(ids), STRIDE):
        rows = slice(start, start + STRIDE)
        alive = ids[rows][None, :] != q_ids[:, None]
        for a, b in zip(q_stats, x_stats, strict=True):
            if not alive.any():
                break
            bound = a @ b[rows].T
            # Rounding of the statistics must not lose a tie.
            alive &= bound >= (floor - 1e-6 * np.abs(floor) - 1e-3)[:, None]
        some_q, some_x = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(some_q):
            continue
        exact = np.where(alive[np.ix_(some_q, some_x)], q[some_q] @ x[rows][some_x].T, -np.inf)
        for n, row in zip(some_q, exact, strict=True):
            hit = np.flatnonzero((row > -np.inf) & (row >= floor[n]))
            if not len(hit):
                continue
            has_ids, has = found[n]
            found[n] = best(np.concatenate([has_ids, ids[rows][some_x[hit]]]), np.concatenate([has, row[hit]]), k)
            if len(found[n][1]) == k:
                floor[n] = found[n][1][-1]
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Both tables have vec_id and v (array of double holding integers, all usable).  Vectors
    of another dimension than the query's aren't candidates.  An id that is repeated counts
    once, with its best score; a repeated query id gets one answer over its vectors.  Ties
    go to the smaller id; fewer than k candidates give fewer rows; empty tables none."""
    rows = stored(packs(vectors), "rows", compression="zstd")
    slots = max(8, rows.count())
    asked = packs(queries, rows=QUERY_BLOCK).select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
    )
    pairs = rows.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")).join(asked, "slot").where("dim = q_dim")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, x = unpacked(r.ids, r.matrix, r.dim)
                q_ids, q = unpacked(r.q_ids, r.q_matrix, r.dim)
                found = block_top(q_ids, q, ids, x, k)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(q_ids, [len(f[0]) for f in found]),
                        "vec_id": np.concatenate([f[0] for f in found]),
                        "score": np.concatenate([f[1] for f in found]).astype(np.int64),
                    }
                )

    few = pairs.select("ids", "matrix", "dim", "q_ids", "q_matrix")
    return ranked(few.mapInPandas(top, "query_id long, vec_id long, score long"), k)


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and v: floor(64 * x) of every component of the usable rows."""
    return usable(embeddings).withColumn("v", F.transform("v", lambda x: F.floor(x * 64).cast("double")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20
"""

assert BLOCK % STRIDE == 0
