"""Merkle manifest of a table: a hash tree for each language, one above their roots, and a proof
for every row, by time-forward processing.

Every node has a label (level, place).  Nodes are worked off in the order of their labels, and
each sends its digest forward in time to its parent's label.  The queue that holds messages until
their label's turn is Spark's sorted shuffle: it delivers the digests of ``2 ** CLIMB`` consecutive
nodes to the task of the subtree above them, where a heap orders the labels of that subtree.  A
second sweep in reversed order delivers to each subtree the part of the proofs above it, so every
leaf gets its own proof though no task ever holds more than one such subtree at a time."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table

#: Levels that one step of the sweep climbs; a subtree has two to this power of leaves.
CLIMB = 12
#: Rows of one range when rows are put in order.
RANGE = 500_000
#: Every so manyth crc32 of a doc_id is tampered with (fixed by the contract).
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof is one byte, then the sibling's digest if there is one.
ALONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    """sha256 (binary) of a row's fields, each with its length."""
    return F.unhex(F.sha2(F.concat(*(_field(fields[name]) for name in FIELDS)), 256))


def digest(*children: bytes) -> bytes:
    """sha256 of the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def numbered(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``df`` with ``place``: the row's number from 0 within its ``by`` (a long), in the given order.

    Rows are dealt out by ranges and counted in each range; a range starts at the counts of
    those before.  So a value of ``by`` may span many tasks.  The last sort key deals equal rows out."""
    spark = df.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    df = df.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(by), *order, F.col("tie")]
    ranged = df.repartitionByRange(n_parts, *keys).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            own = batch.column(by).to_numpy()
            if not len(own):
                continue
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            start = np.repeat(new, np.diff([*new, len(own)]))
            row = np.arange(len(own)) - start
            if last is not None and own[0] == last:
                row[: new[1] if len(new) > 1 else len(own)] += seen
            last, seen = own[-1], int(row[-1]) + 1
            yield batch.append_column("row", pa.array(row, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", row long"
    rows = stored(ranged.mapInArrow(count, schema), "ordered")
    counts = rows.groupBy(by, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.join(starts, [by, "part"]).withColumn("place", F.col("start") + F.col("row")).drop("part", "row", "start", "tie")


def climbed(n: int) -> int:
    """Levels from n nodes to one."""
    return max(0, int(n) - 1).bit_length()


def sweep(digests: list[bytes], levels: int) -> tuple[bytes, dict[tuple[int, int], bytes]]:
    """The digest ``levels`` above consecutive nodes, and all digests by label.

    Messages (label of the receiver, slot, digest) wait in a heap; the smallest label is next."""
    known = {(0, k): d for k, d in enumerate(digests)}
    if levels == 0:
        return digests[0], known
    queue = [((1, k >> 1), k & 1, d) for k, d in enumerate(digests)]
    heapq.heapify(queue)
    while True:
        label, _, first = heapq.heappop(queue)
        received = [first]
        while queue and queue[0][0] == label:
            received.append(heapq.heappop(queue)[2])
        known[label] = own = digest(*received)
        level, place = label
        if level == levels:
            return own, known
        heapq.heappush(queue, ((level + 1, place >> 1), place & 1, own))


def suffixes(known: dict[tuple[int, int], bytes], levels: int, above: bytes) -> list[bytes]:
    """The proof of each lowest node: the reversed sweep hands a node's proof to its children,
    each of which puts its own sibling before it."""
    held = {(levels, 0): above}
    for level, place in sorted((x for x in known if x[0] < levels), reverse=True):
        sibling = known.get((level, place ^ 1))
        step = ALONE if sibling is None else (LEFT if place & 1 else RIGHT) + sibling
        held[level, place] = step + held[level + 1, place >> 1]
    return [held[0, k] for k in range(sum(1 for x in known if x[0] == 0))]


def steps(proof: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling) of each level, lowest first."""
    out, at = [], 0
    while at < len(proof):
        side = proof[at : at + 1]
        size = 0 if side == ALONE else 32
        out.append((side, proof[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def folded(start: bytes, proof: list[tuple[bytes, bytes]]) -> bytes:
    for side, sibling in proof:
        start = digest(sibling, start) if side == LEFT else digest(start, sibling) if side == RIGHT else digest(start)
    return start


class Forest:
    """Hash trees over the rows of (tree, place, n, digest): n is the number of a tree's leaves."""

    def __init__(self, leaves: DataFrame, climb: int = CLIMB):
        self.climb = climb
        #: Nodes of every step's lowest level, with the number of nodes there.
        self.steps: list[DataFrame] = []
        #: (tree, root) of the trees that end with a step.
        self.roots: list[DataFrame] = []
        nodes = leaves.select("tree", "place", "n", "digest")
        while not nodes.isEmpty():
            self.steps.append(nodes)
            nodes = stored(self._forward(nodes), "nodes")
            self.roots.append(nodes.where("n = 1").select("tree", F.col("digest").alias("root")))
            nodes = nodes.where("n > 1")

    def _forward(self, nodes: DataFrame) -> DataFrame:
        climb = self.climb

        def up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("place")
            n = int(part["n"].iloc[0])
            own, _ = sweep(list(part["digest"]), min(climb, climbed(n)))
            return pd.DataFrame([(key[0], key[1], -(-n >> climb), own)], columns=["tree", "place", "n", "digest"])

        return self.grouped(nodes).applyInPandas(up, "tree long, place long, n long, digest binary")

    def grouped(self, nodes: DataFrame):
        return nodes.withColumn("subtree", F.shiftright("place", self.climb)).groupBy("tree", "subtree")

    def backward(self, above: DataFrame) -> DataFrame:
        """(tree, subtree, subroot, above) for each subtree of leaves: the proof steps above it.

        above: (tree, subroot, proof) with the steps above each tree's root."""
        ended = above.select("tree", F.lit(0).cast("long").alias("subtree"), "subroot", F.col("proof").alias("above"))
        received = None
        for k in range(len(self.steps) - 1, -1, -1):
            # Trees that end with this step get what is above their root; the others what the step above sent.
            small = self.steps[k].where((F.col("place") == 0) & (F.col("n") <= 1 << self.climb)).select("tree")
            own = ended.join(small, "tree", "left_semi")
            received = own if received is None else received.unionByName(own)
            if k:
                received = stored(self.down(self.steps[k], received), "proofs")
        return ended if received is None else received

    def down(self, nodes: DataFrame, received: DataFrame) -> DataFrame:
        """What the nodes of a step send to the subtrees below them: each its own proof."""
        climb = self.climb

        def send(key: tuple, mine: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            mine = mine.sort_values("place")
            levels = min(climb, climbed(int(mine["n"].iloc[0])))
            _, known = sweep(list(mine["digest"]), levels)
            proofs = suffixes(known, levels, sent["above"].iloc[0])
            return pd.DataFrame({"tree": mine["tree"], "subtree": mine["place"], "subroot": sent["subroot"].iloc[0], "above": proofs})

        schema = "tree long, subtree long, subroot binary, above binary"
        return self.grouped(nodes).cogroup(received.groupBy("tree", "subtree")).applyInPandas(send, schema)

    def proved(self, leaves: DataFrame, received: DataFrame) -> DataFrame:
        """The leaves with proof, folded root and subroot (hex).  doc_id is text here, as pandas
        has no long column with nulls."""
        climb = self.climb

        def prove(key: tuple, mine: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            mine = mine.sort_values("place")
            levels = min(climb, climbed(int(mine["n"].iloc[0])))
            digests = list(mine["digest"])
            _, known = sweep(digests, levels)
            rows = []
            proofs = suffixes(known, levels, sent["above"].iloc[0])
            for doc_id, own, changed, proof in zip(mine["doc_id"], digests, mine["changed"], proofs, strict=True):
                path = steps(proof)
                again = own if changed is None else changed
                rows.append((doc_id, own.hex(), digest(*(s for _, s in path if s)).hex(), folded(again, path).hex()))
            out = pd.DataFrame(rows, columns=["doc_id", "leaf", "proof_sha256", "folded_root"])
            return out.assign(subroot=sent["subroot"].iloc[0].hex())

        schema = "doc_id string, leaf string, proof_sha256 string, folded_root string, subroot string"
        return self.grouped(leaves).cogroup(received.groupBy("tree", "subtree")).applyInPandas(prove, schema)


def manifest(docs: DataFrame, climb: int = CLIMB) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    docs: doc_id, source, lang, n_chars, text; other columns are no part of a leaf.  A null field
    is `-`.  Leaves of a language go by doc_id, null first, then by their digest: repeated rows
    are neighbouring leaves, interchangeable since equal.  A null doc_id is never tampered with,
    a null n_chars stays.  The proof of a single row without siblings is the hash of nothing.  An
    empty table has no rows."""
    kept = {name: F.col(name) for name in FIELDS}
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0) & F.col("n_chars").isNotNull()
    changed = kept | {"n_chars": F.col("n_chars") + F.lit(1)}
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(kept).alias("digest"), F.when(tampered, leaf(changed)).alias("changed")
    )
    read = stored(read, "leaves")
    # The languages in order are the leaves of the tree above; their places are the trees' numbers.
    named = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("name")
    sizes = stored(read.groupBy(named).agg(F.count("*").alias("n")).withColumn("one", F.lit(0).cast("long")), "sizes")
    trees = stored(numbered(sizes, "one", [F.col("name")]).select("name", "n", F.col("place").alias("tree")), "trees")
    own = read.withColumn("name", named).join(trees, "name").select("tree", "n", "doc_id", "digest", "changed")
    leaves = stored(numbered(own, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")]), "placed")
    forest = Forest(leaves, climb)
    spark, n_trees = docs.sparkSession, trees.count()
    if n_trees == 0:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    subroots = forest.roots[0]
    for more in forest.roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = stored(subroots, "subroots")
    zero = F.lit(0).cast("long")
    upper = subroots.select(zero.alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), F.col("root").alias("digest"))
    top = Forest(upper, climb)
    # One tree, so one row in one of the steps' results.
    root = bytes(next(row["root"] for ended in top.roots[::-1] for row in ended.collect()))
    ends = spark.createDataFrame([(0, root, b"")], "tree long, subroot binary, proof binary")
    # The proofs of the languages' roots are what the upper tree's lowest step sends down.
    lifted = top.down(top.steps[0], top.backward(ends)).select(F.col("subtree").alias("tree"), F.col("above").alias("proof"))
    above = stored(lifted.join(subroots.withColumnRenamed("root", "subroot"), "tree").select("tree", "subroot", "proof"), "above")
    rows = forest.proved(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), forest.backward(above))
    whole = F.lit(root.hex())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))
), fields AS (
  SELECT doc_id, lang, 'L' || coalesce('+' || lang, '') AS name,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, name, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY name) AS n
  FROM leaves
), nodes AS (
  SELECT name, 0 AS level, place, n, leaf AS h FROM placed
  UNION ALL
  SELECT name, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY name, level, place // 2
), subroots AS (
  SELECT name, level AS depth, h AS subroot, row_number() OVER (ORDER BY name) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
  FROM upper WHERE n > 1 GROUP BY level, place // 2
), path AS (
  SELECT p.doc_id, p.name, p.leaf, p.place AS own, l.level,
    CASE WHEN l.level < s.depth THEN (p.place // (1 << l.level)) ELSE s.place // (1 << (l.level - s.depth)) END AS at,
    l.level >= s.depth AS high, l.level - s.depth AS up, s.subroot
  FROM placed p JOIN subroots s USING (name), LATERAL (SELECT unnest(range(s.depth + (SELECT max(level) FROM upper))) AS level) l
), sibling AS (
  SELECT p.name, p.own, p.level, p.at % 2 AS odd, coalesce(u.h, n.h) AS h
  FROM path p
  LEFT JOIN upper u ON p.high AND u.level = p.up AND u.place = xor(p.at, 1)
  LEFT JOIN nodes n ON NOT p.high AND n.name = p.name AND n.level = p.level AND n.place = xor(p.at, 1)
), proofs AS (
  SELECT name, own, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256,
    list({odd: odd, h: h} ORDER BY level) AS steps
  FROM sibling GROUP BY name, own
), folds AS (
  SELECT p.name, p.place AS own, 0 AS k, coalesce(p.changed, p.leaf) AS h, f.steps
  FROM placed p LEFT JOIN proofs f ON f.name = p.name AND f.own = p.place
  UNION ALL
  SELECT name, own, k + 1, sha256(CASE WHEN steps[k + 1].h IS NULL THEN h WHEN steps[k + 1].odd = 1 THEN steps[k + 1].h || h ELSE h || steps[k + 1].h END), steps
  FROM folds WHERE k < coalesce(len(steps), 0)
)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM placed p JOIN subroots s USING (name) CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
LEFT JOIN proofs f ON f.name = p.name AND f.own = p.place
JOIN folds e ON e.name = p.name AND e.own = p.place AND e.k = coalesce(len(e.steps), 0)
"""
