"""As-of lookup that spreads one busy key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: Column,
    right_time: Column,
    payload: Column,
    name: str,
    bucket_seconds: int = 3600,
    right_key: str | None = None,
) -> DataFrame:
    """``left`` + column ``name``: the newest ``payload`` of ``right`` at or before its time.

    Both sides are unioned and read in time order per (key, time bucket), so no
    pairs are formed and a key that owns most rows is split by time.  What was
    last seen in earlier buckets is carried in from one row per bucket."""

    def bucket(t: Column) -> Column:
        return F.floor(F.unix_seconds(t) / bucket_seconds)

    row = F.struct(*left.columns)
    asks = left.select(
        F.col(key).alias("_k"), left_time.alias("_t"), bucket(left_time).alias("_b"), row.alias("_row")
    ).withColumn("_ask", F.lit(1))
    seen = right.select(
        F.col(right_key or key).alias("_k"), right_time.alias("_t"), bucket(right_time).alias("_b"), payload.alias("_p")
    ).withColumn("_ask", F.lit(0))
    rows = asks.unionByName(seen, allowMissingColumns=True)
    last = F.last("_p", ignorenulls=True)
    so_far = Window.partitionBy("_k", "_b").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", last.over(so_far)).filter("_ask = 1")
    tops = rows.groupBy("_k", "_b").agg(
        F.max_by("_p", F.when(F.col("_ask") == 0, F.col("_t"))).alias("_p")
    )
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_k", "_b", last.over(earlier).alias("_far"))
    return near.join(carried, ["_k", "_b"], "left").select(
        "_row.*", F.coalesce("_near", "_far").alias(name)
    )
