"""Vector tables as packed blocks: the form in which tasks compare many with many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one packed block; a block of float64 of 64 dimensions is 1 MB.
BLOCK = 2_048
#: Every so manyth id is a query (fixed by the contract).
QUERY_EVERY = 20

PACKED = "dim int, n int, ids binary, matrix binary"


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part: id and vector present, all
    components finite; with ``zero=False`` also some component other than 0."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite
    return df.where(keep if zero else keep & F.exists(v, lambda x: x != 0))


def packs(df: DataFrame, keys: tuple[str, ...] = (), rows: int = BLOCK) -> DataFrame:
    """Rows of (keys, vec_id, v) as blocks of up to ``rows`` rows of one key and dimension.

    Packs what a task happens to read: no shuffle, whatever the keys' sizes."""
    schema = df.select(*keys).schema if keys else None
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema) if schema else ""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def out(key: tuple, part: list) -> pd.DataFrame:
            ids = np.array([x[0] for x in part], dtype=np.int64)
            matrix = np.stack([x[1] for x in part]).astype(np.float64)
            row = dict(zip(keys, key[:-1], strict=True))
            return pd.DataFrame([row | {"dim": key[-1], "n": len(ids), "ids": ids.tobytes(), "matrix": matrix.tobytes()}])

        n_held = 0
        for batch in batches:
            for *key, vec_id, v in zip(*(batch[k] for k in keys), batch["vec_id"], batch["v"], strict=True):
                own = held.setdefault((*key, len(v)), [])
                own.append((vec_id, v))
                n_held += 1
                if len(own) >= rows:
                    n_held -= len(own)
                    yield out((*key, len(v)), held.pop((*key, len(v))))
                if n_held >= 16 * rows:
                    for k, part in held.items():
                        yield out(k, part)
                    held, n_held = {}, 0
        for k, part in held.items():
            yield out(k, part)

    return df.select(*keys, "vec_id", "v").mapInPandas(pack, head + PACKED)


def unpacked(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(matrix, dtype=np.float64).reshape(-1, dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last: equal
    vectors have equal scores wherever they stand, which matrix products don't promise."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, an id once, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    first = first[:k]
    return ids[first], scores[first]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of several blocks -> each query's first k, with rank."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    numbered = once.withColumn("rank", F.row_number().over(order))
    return numbered.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
