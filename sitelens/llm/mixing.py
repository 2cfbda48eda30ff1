"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash.  A document's virtual finish time is
the source's cumulative words up to it divided by the source's target, so all sources
reach their target at time 1.  Sources with a target above their size pass several
times.  In order of finish time documents are taken until the budget is used up.

Only DataFrame operations.  A source may hold any share of the rows: running sums are
taken within (source, hash range) and offset by the ranges' totals; the cut in the
global order is found by refining a histogram of finish times, so that no task sorts
more than one narrow range of it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import WORD, n_words, stored, table

#: Weights by rank of the source, repeating, and the most passes over a source (fixed by the contract).
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Rows that one running sum may sort, about.
RANGE_ROWS = 20_000
#: Equal parts of one refinement of the finish times.
PARTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size -> also rank (1 for the first) and target.

    The budget is the sum of all sizes.  A target stops at ``passes`` times the size, the
    excess goes to the others by weight: with the sources in order of size per weight, the
    level (budget left / weight left) rises while sources are filled up and falls behind
    the last of them, so the highest level is the one that holds for the rest.  A few
    columns per source: this is the only unpartitioned window."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    full = F.col("source_size") * passes
    everything = Window.partitionBy()
    filling = Window.orderBy(full / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)))
        / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    level = F.max("level").over(everything)
    return leveled.withColumn("target", F.least(full.cast("double"), F.col("weight") * level)).drop("level")


def _cut(copies: DataFrame, budget: int) -> tuple[float, int] | None:
    """(finish, rank) of the last copy taken in the global order; None if all are.

    What finishes by time 1 fits the budget, as no source is beyond its target then.  The
    rest is narrowed down: PARTS equal ranges of time, the one in which the budget ends,
    and again, until that range is small enough to be sorted."""
    later = copies.where("finish > 1")
    first = copies.agg(
        F.coalesce(F.sum(F.when(F.col("finish") <= 1, F.col("size"))), F.lit(0)).alias("used"),
        F.max("finish").alias("high"),
        F.sum(F.when(F.col("finish") > 1, 1)).alias("n"),
    ).first()
    used, low, high, n = first["used"], 1.0, first["high"], first["n"]
    if not n:
        return None
    while n > RANGE_ROWS and low + (high - low) / PARTS > low:
        width = (high - low) / PARTS
        part = F.least(F.ceil((F.col("finish") - low) / width), F.lit(PARTS))
        rows = later.where(F.col("finish").between(low, high) & (F.col("finish") > low)).groupBy(part.alias("part"))
        held = sorted(
            rows.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b")).collect(),
            key=lambda r: r["part"],
        )
        for r in held:
            if used + r["s"] > budget:
                break
            used += r["s"]
        else:
            return None if high == first["high"] else (high, 2**31 - 1)
        below = max([low, *(x["b"] for x in held if x["part"] < r["part"])])
        if (below, r["b"], r["n"]) == (low, high, n):
            break
        low, high, n = below, r["b"], r["n"]
    within = later.where((F.col("finish") > low) & (F.col("finish") <= high))
    running = F.sum("size").over(Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0))
    last = (
        within.withColumn("total", running)
        .where(F.col("total") <= budget - used)
        .agg(F.max(F.struct("finish", "rank")).alias("last"))
        .first()["last"]
    )
    return (last["finish"], last["rank"]) if last else (low, 2**31 - 1)


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the key that orders the shuffle.

    A null text has size 0; a null source is a source of its own, ranked last; null ids
    are shuffled like the empty string.  Documents of size 0 have taken 0.  Repeated rows
    count each for itself; ties of the hash are ordered by size and id.  Other columns
    are left out.  An empty table, or one without any word, takes nothing."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "sizes")
    per_source = stored(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, passes), "targets"
    )
    whole = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.max("n").alias("n")).first()
    digits = max(1, math.ceil(math.log(max(1, (whole["n"] or 0) / RANGE_ROWS), 16)))
    rows = sized.withColumn("part", F.substring("key", 1, digits)).join(
        per_source.select(F.col("source").alias("its"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("its"))
    ).drop("its")
    inside = Window.partitionBy("rank", "part").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("rank", "part")
        .agg(F.sum("size").alias("in_part"))
        .select("rank", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    )
    summed = rows.withColumn("so_far", F.sum("size").over(inside)).join(offsets, ["rank", "part"])
    queued = stored(summed.withColumn("so_far", F.col("so_far") + F.col("offset")).drop("offset", "part"), "queue")

    def finish(p: int) -> Column:
        return F.try_divide(F.col("source_size") * p + F.col("so_far"), F.col("target"))

    real = queued.where("size > 0")
    passed = F.explode(F.array(*(finish(p) for p in range(passes))))
    cut = _cut(real.select("size", "rank", passed.alias("finish")), whole["size"])
    taken: Column = F.lit(0)
    for p in range(passes):
        done = F.lit(True) if cut is None else (finish(p) < cut[0]) | ((finish(p) == cut[0]) & (F.col("rank") <= cut[1]))
        taken = taken + F.when((F.col("size") > 0) & done, F.col("size")).otherwise(F.lit(0))
    return queued.withColumn("taken", taken.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "key"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: each document as often as the mix takes it, not at all if never.

    A document without words has no share in the mix and stays once."""
    taken = mix(docs).groupBy("doc_id").agg(F.max(F.coalesce(F.try_divide("taken", "size"), F.lit(1))).cast("int").alias("times"))
    known = docs.withColumn("its", F.col("doc_id")).join(taken.withColumnRenamed("doc_id", "other"), F.col("its").eqNullSafe(F.col("other")))
    copies = known.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sql(docs: str = "documents", seed: str = "mix") -> str:
    """CTEs whose last, ``mixed``, has a row per document with taken words."""
    return rf"""
sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM {docs}
), per_source AS (
  SELECT *, (ARRAY[5, 2, 1])[(rank - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source IS NULL, source) AS rank
        FROM sized GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM per_source WINDOW filling AS (ORDER BY 3 * source_size / weight, rank)
), goals AS (
  SELECT source, rank, source_size, least((3 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM levels
), queued AS (
  SELECT s.*, g.rank, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY g.rank ORDER BY s.key, s.size, s.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT doc_id, key, size, rank, pass, ((source_size * pass + so_far)::DOUBLE / target) AS finish
  FROM queued, (VALUES (0), (1), (2)) t(pass) WHERE size > 0
), kept AS (
  SELECT doc_id, key, sum(size)::BIGINT AS taken
  FROM (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS total FROM copies)
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id, key
), mixed AS (
  SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
  FROM queued q LEFT JOIN kept k ON q.doc_id = k.doc_id
)"""


SQL = f"WITH {mix_sql()}\nSELECT doc_id, size, source_size, target, taken FROM mixed"
