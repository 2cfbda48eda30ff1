"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number.
A sketch is the hash of the KEEP labelled shingles with the smallest hashes under one seed,
written in text order: equal sketches speak for a small edit distance, not just for shared
words.  Texts that share a sketch are candidates; a pair is near if the longest common
subsequence L of its labelled shingle sequences has L / (n1 + n2 - L) >= 0.8, found by an
alignment within the band which that similarity allows.

Equal word sequences collapse first.  The members of a group of candidates are compared with
its smallest, so that thousands of near copies cost one comparison each; then candidates whose
components still differ are compared in blocks of bounded size, where shared shingles, counted
for a whole block at once, decide who is aligned.  No link between components is missed.
Classes are the connected components of the near pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import stored, table, worker_cache

#: Words of a shingle and the least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of a text, labelled shingles of a sketch.  Texts of similarity j share a sketch
#: with about j ** KEEP, 0.41 at 0.8, and are missed with (1 - j ** KEEP) ** SKETCHES: 5e-8.
SKETCHES, KEEP = 32, 4
#: Characters of a chunk of candidates, about; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000
#: Ranks held at a time while a text is sketched.
MOST_RANKS = 1 << 16
#: Near pairs of different components.
ACROSS = pa.schema({"a": pa.int64(), "b": pa.int64(), "similarity": pa.float64(), "a_component": pa.int64(), "b_component": pa.int64()})

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse, ``size`` at least; a worker keeps them."""
    cache = worker_cache("order_minhash")
    if len(cache.get("powers", ((),))[0]) < size:
        factors = np.full((2, 2 * size), [[_STEP], [_BACK]], dtype=np.uint64)
        factors[:, 0] = 1
        cache["powers"] = tuple(np.cumprod(factors, axis=1, dtype=np.uint64))
    return cache["powers"]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order.

    A word's hash is a polynomial of its bytes modulo 2 ** 64: a difference of sums over the
    whole text, moved back by the word's place."""
    raw = np.frombuffer(" ".join((text or "").split()).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.uint64)
    power, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    gaps = np.flatnonzero(raw == ord(" "))
    begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    return _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * _ODD)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles in order; one for all its words if they are fewer than
    SHINGLE; none without words."""
    return _shingled(word_hashes(text))


def _shingled(h: np.ndarray) -> np.ndarray:
    """Shingles of a sequence of word hashes."""
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    total = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = _mixed(total + h[k : len(total) + k]) + _ODD
    return total


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes combined with their occurrence numbers: all distinct."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, dtype=np.int64)
    if len(first) == len(s):
        return h
    number = np.empty(len(h), dtype=np.uint64)
    number[order] = (np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))).astype(np.uint64)
    return np.where(number > 0, _mixed(h + number * _ODD), h)


_SEEDS = _mixed((np.arange(1, SKETCHES + 1, dtype=np.uint64)) * _ODD) | np.uint64(1)


def sketches(h: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of a non-empty sequence of shingle hashes."""
    own = labelled(h)
    keep = min(KEEP, len(own))
    at = np.empty((SKETCHES, keep), dtype=np.int64)
    # So many seeds at a time that the ranks of a very long text stay small.
    step = max(1, MOST_RANKS // len(own))
    for n in range(0, SKETCHES, step):
        ranks = own * _SEEDS[n : n + step, None]
        ranks ^= ranks >> np.uint64(31)
        rows = np.arange(len(ranks))
        for k in range(keep):
            least = at[n : n + step, k] = ranks.argmin(axis=1)
            ranks[rows, least] = _LAST
    at.sort(axis=1)
    total = np.arange(SKETCHES, dtype=np.uint64)
    for k in range(keep):
        total = _mixed(total + own[at[:, k]]) + _ODD
    return total


def common_subsequence(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Length of the longest common subsequence if at most ``most`` elements of both are outside
    it, else None.  A row of the alignment is one number, a bit for each element of ``a``
    (a zero where the length grows); matches outside the band of ``most`` don't count."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    short = min(n, m)
    other = np.flatnonzero(a[:short] != b[:short])
    start = int(other[0]) if len(other) else short
    a, b = a[start:], b[start:]
    tail = min(len(a), len(b))
    if tail:
        other = np.flatnonzero(a[::-1][:tail] != b[::-1][:tail])
        tail = int(other[0]) if len(other) else tail
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    width = (1 << 2 * most + 1) - 1
    for j, word in enumerate(b.tolist()):
        match = places.get(word, 0)
        if match:
            match &= width << j - most if j > most else width >> most - j
            both = row & match
            row = (row + both | row - both) & every
    length = start + tail + len(a) - row.bit_count()
    return length if n + m - 2 * length <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """L / (n1 + n2 - L) of two texts, given by their word hashes, if it is at least ``least``,
    else None.  L counts the labelled shingles that can be aligned."""
    return aligned(labelled(_shingled(a)), labelled(_shingled(b)), least)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """``similarity`` of two sequences of labelled shingles."""
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return None
    # L / (n - L) >= s means L >= n s / (1 + s); n - 2 L elements differ.
    need = int(np.ceil(n * least / (1 + least) - 1e-9))
    if min(len(a), len(b)) < need:
        return None
    # The shingles in common are at least as many as can be aligned.
    if len(np.intersect1d(a, b, assume_unique=True)) < need:
        return None
    length = common_subsequence(a, b, n - 2 * need)
    return None if length is None or length < need else length / (n - length)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id, same (a digest of the word sequence) and sketches of documents with words: the
    one pass over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            ids, same, keys = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text)
                if len(h):
                    ids.append(doc_id)
                    same.append(xxh3_128_digest(" ".join(text.split()).encode("utf-8", "surrogatepass")))
                    keys.append(np.unique(sketches(h)).view(np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": ids, "same": same, "sketches": keys})

    return docs.where("doc_id IS NOT NULL").mapInPandas(run, "doc_id long, same binary, sketches array<long>")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The near ones of (a, b), with their similarity; texts has (rep, text)."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text")), "a").join(
        texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text")), "b"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, a_text, b_text in zip(batch["a"], batch["b"], batch["a_text"], batch["b_text"], strict=True):
                s = aligned(labelled(shingles(a_text)), labelled(shingles(b_text)))
                if s is not None:
                    rows.append((a, b, s))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    found = both.select("a", "b", "a_text", "b_text").mapInPandas(verify, "a long, b long, similarity double")
    # An id with several texts is near where one of them is.
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def blocks(members: DataFrame) -> DataFrame:
    """(sketch, i, j, rep, component): the pairs of candidates in different components, dealt out.

    members has (sketch, rep, component, chars).  In a group, the component with most members is
    apart from the rest; both are split by a hash into chunks of about CHUNK_CHARS.  Each pair
    of chunks is a block, but for two of the greatest component, and for two of the rest if that is
    one component too: all their pairs are connected."""
    counts = members.groupBy("sketch", "component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    most = F.max(F.struct("n", "component"))
    groups = counts.groupBy("sketch").agg(most["component"].alias("main"), F.sum("chars").alias("all"), F.max(F.struct("n", "component", "chars"))["chars"].alias("inside"), F.count("*").alias("parts"))
    groups = groups.where("parts > 1").select(
        "sketch",
        "main",
        "parts",
        F.ceil(F.col("inside") / CHUNK_CHARS).alias("k_main"),
        F.ceil((F.col("all") - F.col("inside")) / CHUNK_CHARS).alias("k_rest"),
    )
    salt = F.xxhash64("rep", "sketch")
    placed = members.join(groups, "sketch").withColumn("is_main", F.col("component") == F.col("main"))
    # Chunks of the rest come first: 0 to k_rest - 1, then those of the main component.
    chunk = F.when(F.col("is_main"), F.col("k_rest") + F.pmod(salt, F.col("k_main"))).otherwise(F.pmod(salt, F.col("k_rest")))
    placed = placed.withColumn("chunk", chunk)
    rest_begin = F.when(F.col("parts") > 2, F.lit(0).cast("long")).otherwise(F.col("k_rest"))
    partners = F.when(F.col("is_main"), F.sequence(F.lit(0).cast("long"), F.col("k_rest") - 1)).otherwise(
        F.sequence(rest_begin, F.col("k_rest") + F.col("k_main") - 1)
    )
    dealt = placed.withColumn("partner", F.explode(partners))
    return dealt.select(
        "sketch", F.least("chunk", "partner").alias("i"), F.greatest("chunk", "partner").alias("j"), "chunk", "rep", "component"
    )


def _across(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Near pairs of the blocks that connect different components: (a, b, similarity, a_component,
    b_component).  Pairs that a block has connected already are passed over.

    texts has (rep, text, sketches): a pair is compared in the smallest sketch that both have."""

    def verify(key: tuple, block: pa.Table) -> pa.Table:
        sketch, i, j = (k.as_py() for k in key)
        block = block.take(np.lexsort((block["component"].to_numpy(), block["rep"].to_numpy())))
        rep, chunk, named = (block[c].to_numpy() for c in ("rep", "chunk", "component"))
        component = np.unique(named, return_inverse=True)[1]
        # Sketches below the block's: who shares one of them is compared there.
        lists = block["sketches"].combine_chunks()
        below = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())[below < sketch]
        lower_names, lower = np.unique(below[below < sketch], return_inverse=True)
        lower_begin = np.searchsorted(owner, np.arange(len(rep) + 1))
        marked = np.zeros(len(lower_names), dtype=bool)
        first, rows = np.flatnonzero(chunk == i), []

        def others(x: int, fits: np.ndarray | bool = True) -> np.ndarray:
            other = (component != component[x]) & fits
            other &= (chunk == j) if i != j else (np.arange(len(rep)) > x)
            mine = lower[lower_begin[x] : lower_begin[x + 1]]
            if len(mine) and other.any():
                marked[mine] = True
                other[owner[marked[lower]]] = False
                marked[mine] = False
            return np.flatnonzero(other)

        # Most pairs are compared in another block: only texts that meet one here are shingled.
        met = np.zeros(len(rep), dtype=bool)
        for x in first:
            left = others(x)
            if len(left):
                met[x] = met[left] = True
                if met.all():
                    break
        if not met.any():
            return pa.Table.from_pylist([], schema=ACROSS)
        parts = [labelled(shingles(t.as_py() if m else None)) for t, m in zip(block["text"], met, strict=True)]
        sizes = np.array([len(p) for p in parts])
        names, place = np.unique(np.concatenate(parts), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        held = np.zeros(len(names), dtype=np.int32)
        for x in first[met[first]]:
            # A text without words is near none.
            need = np.maximum(np.ceil((sizes + sizes[x]) * SIMILARITY / (1 + SIMILARITY) - 1e-9), 1).astype(int)
            left = others(x, np.minimum(sizes, sizes[x]) >= need)
            if not len(left):
                continue
            own = place[begin[x] : begin[x] + sizes[x]]
            held[own] = 1
            shared = np.array([held[place[begin[y] : begin[y] + sizes[y]]].sum() for y in left])
            held[own] = 0
            for y in left[shared >= need[left]]:
                if component[x] != component[y] and rep[x] != rep[y]:
                    total, least = int(sizes[x] + sizes[y]), int(need[y])
                    length = common_subsequence(parts[x], parts[y], total - 2 * least)
                    if length is not None and length >= least:
                        pair = sorted((rep[x], rep[y]))
                        rows.append((*pair, length / (total - length), named[x], named[y]))
                        component[component == component[y]] = component[x]
        return pa.Table.from_pylist([dict(zip(ACROSS.names, r, strict=True)) for r in rows], schema=ACROSS)

    # Work per byte is high: as many tasks as the session deals out, not merged by their bytes.
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = dealt.join(texts, "rep").select("sketch", "i", "j", "chunk", "rep", "component", "text", "sketches").repartition(n, "sketch", "i", "j")
    schema = "a long, b long, similarity double, a_component long, b_component long"
    # Most blocks are a few rows, for which a pandas frame costs more than the comparison.
    return both.groupBy("sketch", "i", "j").applyInArrow(verify, schema)


def near_pairs(entries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Near pairs (a, b, similarity), a < b, and the (node, root) of their components, which
    are those of all near candidates.  entries has (rep, sketch), docs the texts (doc_id, text).

    First each group's members are compared with its smallest; then all candidates whose
    components differ still."""
    groups = entries.groupBy("sketch").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    left = stored(entries.join(groups, "sketch").select("sketch", "rep", "leader"), "candidates")
    # Only candidates' texts are read from here on.
    reps = docs.withColumnRenamed("doc_id", "rep").join(left.select("rep").distinct(), "rep", "left_semi")
    reps = stored(reps.where("text IS NOT NULL").distinct(), "candidate-texts", compression="zstd")
    tried = left.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    near = stored(_near(tried, reps), "near")
    rooted = components(near)
    sizes = reps.groupBy("rep").agg(F.sum(F.length("text") + 1).alias("chars"))
    known = sizes.join(rooted.withColumnRenamed("node", "rep"), "rep", "left")
    members = left.select("sketch", "rep").join(known.select("rep", "chars", F.coalesce("root", "rep").alias("component")), "rep")
    members = stored(members, "members")
    lists = members.groupBy("rep").agg(F.collect_set("sketch").alias("sketches"))
    across = stored(_across(blocks(members), reps.join(lists, "rep")), "near")
    above = components(across.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    # A component that another one joins: its own nodes follow, and it may be a single node.
    own = across.select(F.explode(F.array("a_component", "b_component")).alias("node")).distinct().withColumn("root", F.col("node"))
    every = rooted.unionByName(own).distinct()
    up = above.select(F.col("node").alias("root"), F.col("root").alias("further"))
    rooted = every.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    pairs = near.unionByName(across.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    return stored(pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "pairs"), stored(rooted, "roots")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (a, b); root is the component's smallest node.

    Each node points to its smallest neighbour, pointers are followed to their ends, and the
    edges between different ends go on to the next round."""
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        point = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
        while True:
            ends = point.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = stored(point.join(ends, "root").select("node", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "roots")
            point = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = point
        else:
            below = point.select(F.col("node").alias("root"), F.col("root").alias("further"))
            total = stored(total.join(below, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "roots")
        a, b = (point.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = stored(
            edges.join(a, "a").join(b, "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(),
            "edges",
        )
    return edges.toDF("node", "root") if total is None else total


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id) and n_links (near texts found for the
    document's word sequence) of every row.

    A text that is null or has no words is a class of its own; a null doc_id has a null
    class; repeated rows are equal rows of one class; rows of one id with several texts are one
    document, near what one of the texts is near.  Texts that differ in white space only
    are equal.  Other columns are left out; an empty table gives an empty table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = stored(_sketched(texts), "sketched", compression="zstd")
    first = stored(read.groupBy("same").agg(F.min("doc_id").alias("rep")), "same")
    member = stored(read.select("doc_id", "same").join(first, "same").select("doc_id", "rep").distinct(), "members")
    own = read.join(first.withColumnRenamed("rep", "doc_id"), ["same", "doc_id"], "left_semi")
    own = own.dropDuplicates(["same", "doc_id"])
    entries = stored(own.select(F.col("doc_id").alias("rep"), F.explode("sketches").alias("sketch")), "entries")
    near, rooted = near_pairs(entries, texts)
    links = near.select("a", "b").union(near.select("b", "a")).toDF("rep", "other").groupBy("rep").agg(F.count("*").alias("n_links"))
    known = (
        member.join(rooted.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .groupBy("doc_id")  # an id with several texts belongs to the smallest of their classes
        .agg(F.min(F.coalesce("root", "rep")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


#: Name of a column that no table has.
SAME = "_same_words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of each class the document with the smallest id stays, each of its
    texts once (texts that differ in white space only are equal).

    Rows without an id stay as they are."""
    kept = classes(docs).where("doc_id <> class_id").select("doc_id").distinct()
    once = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_anti")
    once = once.withColumn(SAME, F.md5(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).cast("binary"))).dropDuplicates(["doc_id", SAME])
    return once.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
