"""SimHash near-duplicates: fingerprints that differ in at most two bits, and their components.

A fingerprint is cut into two halves.  Of two fingerprints that differ in at most two bits, one
half differs in at most one, so the two share that half or a *variant* of it in which one bit is
a wildcard.  All halves and variants are index entries; entries of equal key are joined and the
pairs verified.  Entries that very many fingerprints share are not joined: the bits that the key
leaves open are cut in halves in turn, by the same rule, until no key has more than ``MOST``
fingerprints.  Eight open bits hold 256 fingerprints at most, so this ends, and no link is lost."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table
from sitelens.llm.order_minhash import components

BITS = 64
#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ (fixed by the contract).
WORDS, SEED, APART = 3, 42, 2
#: Fingerprints of one key that are compared with each other; keys of more are cut further.
MOST = 128
#: Shingles hashed at a time, so that a very long text needs little memory.
AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's three-word shingles as a signed 64-bit number; 0 without words."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(WORDS, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), AT_ONCE):
        spans = zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (long) of each row; lower-casing is of A-Z, words end at ASCII white space."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash("text").alias("fingerprint"))


def _ones(width: Column) -> Column:
    """A number whose lowest ``width`` bits are set (fewer than 64)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1


def cut(entries: DataFrame) -> DataFrame:
    """Entries of (fp, fixed, wild) with the open bits cut in halves.

    fixed: bits that members of a key have in common; wild: bits in which the two of a pair
    differ.  The rest is one run of open bits, which may hold the differences that are left: one
    of its halves has at most half of them."""
    held = F.col("fixed").bitwiseOR(F.col("wild"))
    entries = entries.withColumn("open", F.bitwise_not(held)).withColumn("left", F.lit(APART) - F.bit_count("wild"))
    lowest = F.col("open").bitwiseAND(-F.col("open"))
    entries = entries.withColumn("half", (F.bit_count("open") / 2).cast("int")).withColumn("low", F.bit_count(lowest - 1).cast("int"))
    # A choice is a half and the place of its wildcard, or none; -1 fixes all open bits.
    whole, half = F.array(F.lit(-1)), F.col("half")
    exact = F.array(half, 2 * half + 1)
    choices = F.when(F.col("left") == 0, whole).when(F.col("left") == 1, exact).otherwise(F.sequence(F.lit(0), 2 * half + 1))
    entries = entries.withColumn("choice", F.explode(choices))
    place = F.col("choice") % (half + 1)
    start = F.col("low") + F.floor(F.col("choice") / (half + 1)).cast("int") * half
    one = F.call_function("shiftleft", F.lit(1).cast("long"), start + place)
    bit = F.when(place < half, one).otherwise(F.lit(0).cast("long"))
    own = F.call_function("shiftleft", _ones(half), start).bitwiseAND(F.bitwise_not(bit))
    every = F.col("choice") == -1
    return entries.select(
        "fp",
        F.col("fixed").bitwiseOR(F.when(every, F.col("open")).otherwise(own)).alias("fixed"),
        F.col("wild").bitwiseOR(F.when(every, F.lit(0).cast("long")).otherwise(bit)).alias("wild"),
    )


def links(distinct: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in at most two bits.

    A fingerprint has at most 2 080 such partners, so the result grows with the rows alone."""
    zero = F.lit(0).cast("long")
    # The first cut: all 64 bits are open, which no signed number of ones expresses.
    width = BITS // 2
    entries = (
        distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * width + 1))).alias("choice"))
        .withColumn("start", F.floor(F.col("choice") / (width + 1)).cast("int") * width)
        .withColumn("place", F.col("choice") % (width + 1))
    )
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("start") + F.col("place"))
    entries = entries.withColumn("wild", F.when(F.col("place") < width, one).otherwise(zero))
    own = F.call_function("shiftleft", F.lit((1 << width) - 1), F.col("start"))
    entries = entries.select("fp", own.bitwiseAND(F.bitwise_not("wild")).alias("fixed"), "wild")
    found: DataFrame | None = None
    while True:
        # Equal keys have equal hashes; different keys of one hash are told apart below.
        entries = entries.withColumn("key", F.xxhash64("fixed", "wild", F.col("fp").bitwiseAND(F.col("fixed"))))
        # Merged by hint, not broadcast: Spark takes exploded entries to be as small as the rows
        # they come from, and stored ones as small as their files.
        sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge")
        shared = stored(entries.join(sizes, "key"), "variants")
        few = shared.where(F.col("n") <= most)
        a = few.select("key", "fixed", "wild", F.col("fp").alias("a"))
        b = few.select("key", "fixed", "wild", F.col("fp").alias("b")).hint("merge")
        differing = F.col("a").bitwiseXOR(F.col("b"))
        verified = (
            (F.col("a") < F.col("b"))
            & (differing.bitwiseAND(F.col("fixed").bitwiseOR(F.col("wild"))) == F.col("wild"))
            & (F.bit_count(differing) <= APART)
        )
        near = a.join(b, ["key", "fixed", "wild"]).where(verified).select("a", "b")
        found = near if found is None else found.union(near)
        many = shared.where(F.col("n") > most)
        if many.isEmpty():
            return found.distinct()
        entries = cut(many.select("fp", "fixed", "wild"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id of the rows whose fingerprints are reached over links.
    A text that is null, empty or all white space has fingerprint zero, which links like any
    other.  Repeated rows, and rows of one doc_id with several texts, are rows of their own
    fingerprints.  A null doc_id takes part but is never the smallest; a component of such rows
    alone has a null component_id.  Other columns are left out; an empty table gives none."""
    read = stored(fingerprints(docs), "fingerprints")
    distinct = stored(read.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    rooted = components(links(distinct.select("fp")))
    known = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = known.join(least, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0"))
    # Many equal rows are a small file.
    return read.hint("merge").join(owner, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
