"""Token-id files: canonical length-limited Huffman codes of ids, decoded in independent blocks.

Code lengths come from the counts of all ids (package-merge, at most LIMIT bits), codes are
canonical, so the file needs only the lengths.  A document's ids are cut into blocks; its
record holds the bit offset of each block, from which a table-driven decoder starts, all
blocks of a batch side by side.

Layout of the files: rows of a Parquet table, in ascending doc_id order over the files'
``part`` and ``row``; each row is one document's record (ids, checkpoints, bits), so that
Spark's committed writer and any shared store hold them and a lost task is simply repeated."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import shared_folder, stored, table, worker_cache

#: Longest code in bits; the decoding table has 2 to this power entries.
LIMIT = 20
#: Ids between two checkpoints.
BLOCK = 256
#: Id appended to each document (fixed by the contract).
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps, bytes of text cut at once, and ids coded or decoded side by side, about.
KEPT_WORDS = 500_000
CUT_BYTES = 32_000_000
SIDE_BY_SIDE = 1_000_000


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge; one lone id gets 1 bit."""
    coins = sorted((n, x) for x, n in counts.items() if n > 0)
    if not coins:
        return {}
    if len(coins) == 1:
        return {coins[0][1]: 1}
    if len(coins) > 1 << limit:
        raise ValueError(f"{len(coins)} ids don't fit codes of {limit} bits")
    # Level by level: which of the cheapest 2n-2 items of the merged list are packages.
    merged = [n for n, _ in coins]
    flags: list[list[bool]] = []
    for _ in range(limit - 1):
        packages = [merged[k] + merged[k + 1] for k in range(0, len(merged) - 1, 2)]
        both = list(heapq.merge(((n, False) for n, _ in coins), ((n, True) for n in packages)))
        flags.append([x for _, x in both])
        merged = [n for n, _ in both]
    lengths = [0] * len(coins)
    take = 2 * len(coins) - 2
    for level in reversed(flags):
        packages = sum(level[:take])
        for k in range(take - packages):
            lengths[k] += 1
        take = 2 * packages
    for k in range(take):
        lengths[k] += 1
    return {x: n for (_, x), n in zip(coins, lengths, strict=True)}


class Code:
    """Canonical code of (id -> length): shorter codes first, then smaller ids."""

    def __init__(self, lengths: dict[int, int]) -> None:
        order = sorted((n, x) for x, n in lengths.items())
        self.limit = max((n for n, _ in order), default=1)
        size = max(lengths, default=0) + 1
        self.length, self.code = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64)
        self.table_id = np.zeros(1 << self.limit, dtype=np.uint32)
        self.table_length = np.ones(1 << self.limit, dtype=np.uint8)
        at = 0
        for n, x in order:
            room = 1 << (self.limit - n)
            self.length[x], self.code[x] = n, at >> (self.limit - n)
            self.table_id[at : at + room], self.table_length[at : at + room] = x, n
            at += room

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of documents of ``counts`` ids, one after the other: bits of all as big-endian 32-bit
        words, at which word each begins (and the last ends), and the bit in its document at which
        each id begins.

        A document begins with a word of its own and ends with one more.  Every code ends in one of
        two neighbouring words; the codes of a word are added."""
        lengths = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(counts)
        before = ends[last - counts]
        word_start = np.concatenate([[0], np.cumsum((ends[last] - before + 31) // 32 + 1)])
        begins = ends[:-1] - np.repeat(before, counts)
        words = np.zeros(int(word_start[-1]), dtype=np.uint64)
        if len(ids):
            word = (begins >> 5) + np.repeat(word_start[:-1], counts)
            # The code stands in the upper end of 64 bits that begin with its word.
            shifted = self.code[ids] << (64 - lengths - (begins & 31)).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4"), word_start, begins

    def decode(self, bits: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """ids of blocks of ``counts`` ids that begin at bit ``offsets``, one after the other."""
        words = np.concatenate([bits.astype(np.uint64), np.zeros(2, dtype=np.uint64)])
        order = np.argsort(-counts, kind="stable")
        at, left = offsets[order].astype(np.int64), counts[order]
        to = (np.cumsum(counts) - counts)[order]
        out = np.empty(int(counts.sum()), dtype=np.uint32)
        live = len(order)
        for k in range(int(left[0]) if live else 0):
            live = int(np.searchsorted(-left, -k, side="left"))
            now = at[:live]
            word = now >> 5
            pair = (words[word] << np.uint64(32)) | words[word + 1]
            window = (pair << (now & 31).astype(np.uint64)) >> np.uint64(64 - self.limit)
            out[to[:live] + k] = self.table_id[window]
            now += self.table_length[window]
        return out


#: A run of letters and the signs that may end it: two words to the tokenizer, whose case it drops.
_PLAIN = "^(?P<word>[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<end>[!-/:-@\\[-`{-~]*)$"
#: The letters that stand for a word's bytes in the tokenizer's vocabulary, where a letter has two.
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _BYTES} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_BYTES}))}
_LETTERS = {k: "".join(map(_SHOWN.__getitem__, chr(k).encode())) for k in range(0xC0, 0x100)}


class Encoder:
    """Ids of texts: the tokenizer drops white space and joins nothing across it, so each distinct
    chunk between blanks is encoded once, and the ids of lower-cased words are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kept: dict[str, bytes] = {}
        # Words go to the tokenizer's model past its rules for cases and characters, which leave them as they are.
        self.model = self.tokenizer.model
        probe = ["".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])), "the", "a"]
        self.plain = all(self.word(w) == self.chunk(w) for w in probe)

    def chunk(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a run of lower-case letters."""
        parts = self.model.tokenize(word if word.isascii() else word.translate(_LETTERS))
        return np.fromiter((x.id for x in parts), dtype=self.kind, count=len(parts)).tobytes()

    def held(self, values: pa.Array, make: Callable[[str], bytes]) -> list[bytes]:
        """Ids of distinct words or chunks, which no other ``make`` may give."""
        out, kept = [], self.kept
        for x in values.to_numpy(zero_copy_only=False).tolist():
            ids = kept.get(x)
            if ids is None:
                kept[x] = ids = make(x)
            out.append(ids)
        return out

    def table(self, chunks: pa.Array) -> pa.ListArray:
        """Ids of distinct chunks, and the end id as one more."""
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        cut = pc.extract_regex(chunks, _PLAIN)
        plain = pc.and_(cut.is_valid(), pa.scalar(self.plain))
        words, ends = (cut.field(k).filter(plain) for k in ("word", "end"))
        words, ends = pc.utf8_lower(words).dictionary_encode(), ends.dictionary_encode()
        parts = self.held(words.dictionary, self.word)
        first = len(parts)
        parts += self.held(ends.dictionary, self.chunk)
        rest = len(parts)
        parts += self.held(chunks.filter(pc.invert(plain)), self.chunk)
        # Two parts for each chunk: its word and end, or the whole and nothing.
        at = np.full((len(chunks), 2), len(parts), dtype=np.int64)
        own = plain.to_numpy(zero_copy_only=False)
        at[own, 0], at[own, 1] = words.indices.to_numpy(), ends.indices.to_numpy() + first
        at[~own, 0] = np.arange(rest, len(parts))
        ids = self.ragged([*parts, b""]).take(pa.array(at.reshape(-1)))
        sizes = ids.value_lengths().to_numpy().reshape(-1, 2).sum(axis=1)
        flat = np.append(ids.flatten().to_numpy(), np.array([END], dtype=self.kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes, 1], dtype=np.int32)), pa.array(flat))

    def ragged(self, parts: list[bytes]) -> pa.ListArray:
        size = np.dtype(self.kind).itemsize
        at = np.cumsum([0, *map(len, parts)], dtype=np.int64) // size
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype=self.kind)))

    def ids(self, texts: pa.Array) -> pa.Array:
        """Little-endian ids (of ``kind``) of whole texts, each with the end id; a null text is empty."""
        blank = texts.fill_null("")
        for other in "\n\t":
            blank = pc.replace_substring(blank, other, " ")
        cut = pc.split_pattern(blank, " ")
        chunks = cut.flatten().dictionary_encode()
        n = cut.value_lengths().to_numpy()
        last = np.cumsum(n)
        # The end id is the last chunk of each text.
        order = np.insert(chunks.indices.to_numpy(), last, len(chunks.dictionary))
        ids = self.table(chunks.dictionary).take(pa.array(order))
        size = np.dtype(self.kind).itemsize
        bounds = ids.offsets.to_numpy()[np.concatenate([[0], last + np.arange(1, len(n) + 1)])].astype(np.int64) * size
        flat = np.ascontiguousarray(ids.flatten().to_numpy())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(flat)]).cast(pa.binary())


def encoder(path: str) -> Encoder:
    cache = worker_cache("huffman")
    if cache.get("encoder", (None,))[0] != path:
        cache["encoder"] = path, Encoder(path)
    return cache["encoder"][1]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, two or four bytes each as the vocabulary needs) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            sizes = pc.binary_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // CUT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if b > a:
                    yield pa.RecordBatch.from_arrays([part["doc_id"], own.ids(part["text"])], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in all documents; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            own = np.bincount(flat_ids(batch["ids"], kind)[0], minlength=len(totals))
            own[: len(totals)] += totals
            totals = own
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def flat_ids(ids: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a binary column without nulls, one after the other, and their numbers."""
    size = np.dtype(kind).itemsize
    n = pc.binary_length(ids).to_numpy().astype(np.int64) // size
    wide = ids.cast(pa.large_binary())
    first = int(np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset]) if len(ids) else 0
    data = wide.buffers()[2]
    flat = np.frombuffer(data, dtype=kind, offset=first, count=int(n.sum())) if data is not None and len(ids) else np.zeros(0, dtype=kind)
    return flat, n


RECORD = "doc_id long, n_tokens long, checkpoints binary, bits binary"


def code_documents(tokens: DataFrame, lengths: dict[int, int], kind: str) -> DataFrame:
    """The record of each document of (doc_id, ids)."""
    few = sorted(lengths.items())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(dict(few))
        for batch in batches:
            flat, counts = flat_ids(batch["ids"], kind)
            ends = np.cumsum(counts)
            group = (ends - counts) // SIDE_BY_SIDE
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                n = counts[a:b]
                bits, word_start, begins = code.encode(flat[ends[a] - n[0] : ends[b - 1]], n)
                at, bits = (np.cumsum(n) - n).tolist(), bits.tobytes()
                marks = [begins[i : i + k : BLOCK].astype(mark_kind(k)).tobytes() for i, k in zip(at, n.tolist(), strict=True)]
                bounds = (4 * word_start).tolist()
                own = [bits[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [batch["doc_id"].slice(a, b - a), pa.array(n), pa.array(marks, pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "checkpoints", "bits"])

    return tokens.mapInArrow(encode, RECORD)


def mark_kind(n: int) -> str:
    """How the checkpoints of a document of ``n`` ids are written."""
    return "<u4" if n < 2**27 else "<u8"


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> dict[int, int]:
    """Write the ids of all texts to ``folder`` in ascending doc_id order; returns the code's lengths.

    docs: doc_id, text; other columns are left out.  A null text is empty and has the end id
    only.  A null doc_id comes first; rows of one doc_id are ordered by their bits' hash, so
    repeated rows are equal records next to each other.  An empty table writes no rows.
    Texts are tokenised once, into a compressed table; the coded form, the smallest, is what is
    dealt out by ranges of doc_id."""
    path = path or tokenizer_path()
    kind = encoder(path).kind
    tokens = stored(tokenise(docs, path), "tokens", compression="zstd")
    lengths = code_lengths(id_counts(tokens, kind))
    # Stored, as ranges are found by one more pass over what they deal out.
    coded = stored(code_documents(tokens, lengths, kind), "coded", compression="none")
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The second key splits an id that many rows have.
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("bits"), F.col("bits")
    ranged = coded.repartitionByRange(n_parts, *order[:2])
    ordered = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ids = 0
        for batch in batches:
            n = batch["n_tokens"].to_numpy()
            yield batch.assign(row=np.arange(rows, rows + len(batch)), before=ids + np.cumsum(n) - n)
            rows, ids = rows + len(batch), ids + int(n.sum())

    ordered.mapInPandas(number, f"{RECORD}, part int, row long, before long").write.option("compression", "none").parquet(folder)
    return lengths


def read_ids(spark: SparkSession, folder: str, lengths: dict[int, int]) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit, binary) from the files of ``write_ids``.

    start: ids of all documents before, in the files' order (the parts' totals are summed
    over one row per file)."""
    files = spark.read.schema(f"{RECORD}, part int, row long, before long").parquet(folder)
    per_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    few = sorted(lengths.items())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(dict(few))
        for batch in batches:
            n = batch["n_tokens"].to_numpy()
            # Groups of documents of about SIDE_BY_SIDE ids.
            group = (np.cumsum(n) - n) // SIDE_BY_SIDE
            for _, own in batch.groupby(group):
                yield _decoded(code, own)

    return files.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "checkpoints", "bits").mapInPandas(
        decode, "doc_id long, start long, n_tokens long, ids binary"
    )


def _decoded(code: Code, own: pd.DataFrame) -> pd.DataFrame:
    n = own["n_tokens"].to_numpy()
    words = [np.frombuffer(b, dtype=">u4") for b in own["bits"]]
    word_start = np.cumsum([0, *map(len, words)])[:-1]
    offsets, counts = [], []
    for count, first, marks in zip(n, word_start, own["checkpoints"], strict=True):
        at = np.frombuffer(marks, dtype=mark_kind(count)).astype(np.int64)
        offsets.append(at + 32 * first)
        counts.append(np.minimum(BLOCK, count - BLOCK * np.arange(len(at))))
    ids = code.decode(np.concatenate(words), np.concatenate(offsets), np.concatenate(counts)).astype("<u4").tobytes()
    end = np.cumsum(n)
    out = own[["doc_id", "start", "n_tokens"]].copy()
    out["ids"] = [ids[4 * (b - k) : 4 * b] for b, k in zip(end, n, strict=True)]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/token-ids-{uuid4().hex}"
    lengths = write_ids(docs, folder)
    return read_ids(spark, folder, lengths).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

