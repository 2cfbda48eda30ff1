"""Product codes of vectors by exact integer k-means with norm-of-sum bounds.

Each of 16 parts has its own codebook.  A part's nearest entry is found by distances to all
entries once; after that a part keeps, for each group of entries, a lower bound on the distance
to the nearest of them and a stamp: the round in which the bound was exact.  The codebooks of
all rounds are retained, so a later round lowers a bound by the *net* displacement of the entries
between the stamp's round and now (the norm of the sum of their moves), which is never more than
the sum of the norms that accumulated drifts would take.  Only groups whose bound doesn't exceed
the exact distance to the present entry are scanned again.

State between rounds is a table in the shared folder; a codebook of 64 entries a part is all
that passes through the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table

#: Parts of a vector, entries of a codebook, rounds of k-means, steps of a component's unit (fixed by the contract).
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Consecutive entries that share a lower bound.
GROUP = 8
#: Integer components are held within these bounds, so that distances fit 64 bits.
LARGEST = 1 << 27

#: codes: an entry for each part; bounds: a float32 and stamps: a byte for each part and group.
STATE = "vec_id long, label string, q array<long>, codes binary, bounds binary, stamps binary"
OWN = ("vec_id", "label", "q")
HELD = ("codes", "bounds", "stamps")


def integers(embeddings: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows that take part, with ``q``: floor(256 x) of each component x, as longs.

    Dropped: rows whose vector is null or holds null or non-finite components.  Components past
    2^27 in size (x past 524 288) are held there."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    return embeddings.where(v.isNotNull() & finite).withColumn("q", held)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of 16 x width integers, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if (sizes == PARTS * width).all():
        return flat.reshape(len(sizes), PARTS * width)
    out = np.zeros((len(sizes), PARTS * width), dtype=np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = flat
    return out


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors of a part to the given entries."""
    total = np.zeros((len(part), len(book)), dtype=np.int64)
    for d in range(part.shape[1]):
        total += (part[:, d, None] - book[None, :, d]) ** 2
    return total


def net_displacement(history: list[np.ndarray], part: int) -> np.ndarray:
    """For each stamp and group the farthest that an entry now is from where it was then."""
    now = history[-1][part]
    out = np.zeros((len(history), -(-len(now) // GROUP)))
    for stamp, then in enumerate(history):
        moved = np.sqrt(((now - then[part]) ** 2).sum(axis=1).astype(float))
        out[stamp] = [moved[g : g + GROUP].max() for g in range(0, len(moved), GROUP)]
    return out


def assign(x: np.ndarray, history: list[np.ndarray], codes: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, int]:
    """Each part's squared distance to its nearest entry, ties to the lower one, and the number
    of groups scanned.  codes, bounds and stamps (rows x parts [x groups]) are brought up to date;
    a bound leaves out the entry that the part is assigned to."""
    now, width = len(history) - 1, history[0].shape[2]
    every = np.arange(len(x))
    error, scanned = np.zeros((len(x), PARTS), dtype=np.int64), 0
    for p in range(PARTS):
        part, book = x[:, p * width : (p + 1) * width], history[now][p]
        before = codes[:, p].astype(np.int64)
        at_first = ((part - book[before]) ** 2).sum(axis=1)
        code, least = before.copy(), at_first.copy()
        lower = bounds[:, p] - np.take_along_axis(net_displacement(history, p), stamps[:, p].astype(np.int64), axis=0)
        # Strictly farther, with a margin far above rounding: such a group can't even tie.
        scan = lower <= (np.sqrt(at_first.astype(float)) * (1 + 1e-6) + 1e-3)[:, None]
        second = np.full(scan.shape, np.inf)
        for g in range(scan.shape[1]):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            scanned += len(rows)
            found = distances(part[rows], book[g * GROUP : (g + 1) * GROUP])
            best = found.argmin(axis=1)
            d = found[np.arange(len(rows)), best]
            better = (d < least[rows]) | ((d == least[rows]) & (g * GROUP + best < code[rows]))
            code[rows[better]], least[rows[better]] = g * GROUP + best[better], d[better]
            lower[rows, g] = np.sqrt(d.astype(float))
            if found.shape[1] > 1:
                second[rows, g] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(float))
        # A group that wasn't scanned keeps its bound and stamp, and with it the net displacement.
        fresh = scan.copy()
        # An entry that was left is in its group's bound again; the new one is out of it.
        left = every[code != before]
        group = before[left] // GROUP
        lower[left, group] = np.minimum(lower[left, group], np.sqrt(at_first[left].astype(float)))
        fresh[left, group] = True
        taken = every[scan[every, code // GROUP]]
        lower[taken, code[taken] // GROUP] = second[taken, code[taken] // GROUP]
        low = np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
        bounds[:, p] = np.where(fresh, low, bounds[:, p])
        stamps[:, p] = np.where(fresh, now, stamps[:, p])
        codes[:, p], error[:, p] = code, least
    return error, scanned


def _unpacked(batch: pa.RecordBatch, history: list[np.ndarray]) -> tuple:
    n, groups = batch.num_rows, -(-history[0].shape[1] // GROUP)
    x = matrix(batch.column("q"), history[0].shape[2])
    shapes = (n, PARTS), (n, PARTS, groups), (n, PARTS, groups)
    kinds = np.uint8, np.float32, np.uint8
    if len(history) == 1:  # nothing is known yet: every group is open
        return x, np.zeros(shapes[0], np.uint8), np.full(shapes[1], -np.inf, np.float32), np.zeros(shapes[2], np.uint8)
    read = [b"".join(batch.column(c).to_pylist()) for c in HELD]
    return x, *(np.frombuffer(b, k).reshape(s).copy() for b, k, s in zip(read, kinds, shapes, strict=True))


def _packed(a: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in a], pa.binary())


def step(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The state after parts are assigned to the newest codebook of the history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, *held = _unpacked(batch, history)
                assign(x, history, *held)
                yield pa.RecordBatch.from_arrays([*map(batch.column, OWN), *map(_packed, held)], [*OWN, *HELD])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook whose entries are the floored means of their parts; unused ones stay.

    A task sums its own parts, so what is shuffled is bounded by codebooks, not rows."""
    entries, width = book.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("q"), width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(n > 0)
        lists = pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(n[n > 0]), lists], ["part", "entry", "n", "sums"])

    rows = state.select("q", "codes").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    places = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    out = book.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return out


class Codebooks:
    """Codebooks of all rounds, fitted on every row of ``rows`` (vec_id, label, q)."""

    def __init__(self, rows: DataFrame):
        width = -(-(rows.agg(F.max(F.size("q"))).first()[0] or 0) // PARTS)
        # At most 64 rows; a tied id is ordered by its vector.
        first = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
        start = matrix(pa.array([r["q"] for r in first], pa.list_(pa.int64())), width)
        self.history = [np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2))]

    def fit(self, rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
        """The state of the rows after the last round; its bounds serve the final assignment."""
        state = rows
        for _ in range(rounds):
            state = stored(step(state, self.history), "bounds", compression="zstd")
            self.history.append(moved(state, self.history[-1]))
        return state

    def sha256(self) -> str:
        """Of all entries' integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def encode(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of the rows that take part.

    embeddings: vec_id, embedding, label; other columns are left out.  A null vec_id stays and
    sorts last when the first entries are chosen; repeated rows count as often as they occur.
    With fewer than 64 rows there are as many entries as rows.  Vectors whose length isn't a
    multiple of 16, or shorter than the longest, are filled up with zeros; an empty vector is
    all zeros.  Null labels are one label.  An empty table has no rows."""
    rows = integers(embeddings).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "q")
    kept = stored(rows, "integers")
    if kept.isEmpty():
        return kept.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = Codebooks(kept)
    state = books.fit(kept)
    history = books.history

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, codes, bounds, stamps = _unpacked(batch, history)
                error, _ = assign(x, history, codes, bounds, stamps)
                code = pa.array([c.tobytes().hex() for c in codes])
                own = [batch.column("vec_id"), batch.column("label"), code, pa.array(error.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(own, ["vec_id", "label", "code", "error"])

    coded = stored(state.mapInArrow(last, "vec_id long, label string, code string, error long"), "codes")
    # A null label is a label of its own; sums come first, so a frequent label is no large group.
    marked = coded.withColumn("label", F.coalesce(F.concat(F.lit("+"), "label"), F.lit("")))
    sums = marked.groupBy("label").agg(F.sum("error").alias("label_error"))
    return marked.join(sums, "label").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """All rounds in DuckDB: nearest entries and means by plain grouping, one round after the other."""
    text = """
WITH v AS (
  SELECT vec_id, label, row_number() OVER () AS r, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT r, vec_id, p, q[p * w + 1 : p * w + w] AS part FROM (SELECT *, len(q) // 16 AS w FROM v), range(16) t(p)
), book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST) - 1 AS e, part AS entry
  FROM parts JOIN (SELECT r FROM v ORDER BY vec_id NULLS LAST LIMIT 64) USING (r)
)"""
    for k in range(ROUNDS + 1):
        text += f""", near{k} AS (
  SELECT r, p, any_value(part) AS part, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT r, p, e, part, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(part, entry)])::BIGINT AS d
        FROM parts JOIN book{k} USING (p)) GROUP BY r, p
)"""
        if k < ROUNDS:
            text += f""", means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS entry FROM (
    SELECT p, best.e AS e, i, floor(sum(part[i]) / count(*))::BIGINT AS m
    FROM near{k}, LATERAL (SELECT unnest(range(1, len(part) + 1)) AS i) GROUP BY ALL) GROUP BY p, e
), book{k + 1} AS (
  SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN means{k} m USING (p, e)
)"""
    return text + f""", coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


SQL = _sql()
