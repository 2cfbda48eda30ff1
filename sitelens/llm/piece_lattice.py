"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units across which no piece reaches.  Each distinct unit is exploded into
its substrings of bounded length, these are joined to the piece table, the edges found are
grouped by unit, and Spark's ``aggregate`` folds them to the unit's segmentation.

The public model is a byte-pair one: SentencePiece doesn't return the path of the highest
summed score for it, but applies merges in order of score.  So the fold takes the edges in
that order and keeps the inner boundaries of a unit as the bits of a long (an array beyond 62
characters): an edge is taken if it covers exactly two of the pieces so far.

Workers handle Arrow tables in slices of ROWS and load no pandas: several of them live beside
an executor's heap.

Units that occur often travel to the tasks as a table of bounded size; the others' ids are
joined to the documents that hold them.  Between jobs, ids are 16-bit integers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sitelens.llm.common import stored, table, worker_cache

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Units whose ids travel to the tasks, and words whose ids a worker keeps.
HEAD, KEPT_WORDS = 150_000, 60_000
#: Documents that a worker hands on at once.
ROWS = 500
#: Most pieces of a table that is sent to all tasks.
MOST_PIECES = 1 << 15
#: Ids between jobs, and the one that stands for a unit that is still open.
STORED, HOLE = "<u2", (1 << 16) - 1
#: Characters of a unit whose boundaries fit a long.
SHORT = 62
#: Bits of a character's place in a unit, in an edge written as one long.
PLACE = 24
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


class Pieces:
    """The piece table: ids of ordinary pieces and of bytes, and which neighbours a piece can hold."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.text = [model.id_to_piece(k) for k in every]
        self.byte = {int(self.text[k][3:-1], 16): k for k in every if model.is_byte(k)}
        special = {k for k in every if model.is_byte(k) or model.is_control(k) or model.is_unknown(k)}
        self.id = {self.text[k]: k for k in every if k not in special}
        self.rank = {p: -model.get_score(k) for p, k in self.id.items()}
        self.longest = max(map(len, self.id))
        self.pairs = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.bytes_of = {k: b for b, k in self.byte.items()}
        self.is_byte = np.array([k in self.bytes_of for k in every])
        self.shown = ["" if k in special else self.text[k] for k in every]
        self.column = pa.array(self.shown, pa.string())
        self.width = pc.binary_length(self.column).to_numpy()

    @staticmethod
    def words(text: str) -> list[str]:
        """Words with the blanks in front of them; the text has one more in front."""
        return _WORD.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def units(self, word: str) -> list[str]:
        """Cuts a word where no piece holds both neighbours."""
        at, out = 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in self.pairs:
                out.append(word[at:k])
                at = k
        return [*out, word[at:]]

    def ids(self, unit: str, cuts: list[int]) -> list[int]:
        """Ids of a unit's parts; a character without a piece is its bytes."""
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
            k = self.id.get(unit[a:b])
            out += [k] if k is not None else [self.byte[x] for x in unit[a:b].encode("utf-8", "replace")]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes are joined, the blank put in front is taken off again."""
        runs = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        out = []
        for run in np.split(ids, runs):
            if len(run) and self.is_byte[run[0]]:
                out.append(bytes(map(self.bytes_of.__getitem__, run.tolist())).decode("utf-8", "replace"))
            else:
                out += map(self.shown.__getitem__, run.tolist())
        return "".join(out).replace(BLANK, " ")[1:]

    def decoded(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, null for null: pieces are put in row for all lists at once, but for those with bytes."""
        valid, n = lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(n)
        shown = self.column.take(pa.array(flat))
        # The pieces of a list lie next to each other.
        at = np.concatenate([[0], np.cumsum(self.width[flat])])[np.concatenate([[0], ends])]
        joined = pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), shown.buffers()[2] or pa.py_buffer(b""))
        texts = pc.utf8_slice_codeunits(pc.replace_substring(joined, BLANK, " "), 1).to_pylist()
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(self.is_byte[flat]), side="right")).tolist():
            texts[k] = self.decode(flat[ends[k] - n[k] : ends[k]])
        return pa.array([x if v else None for x, v in zip(texts, valid.tolist(), strict=True)], pa.string())


def pieces(path: str) -> Pieces:
    cache = worker_cache("piece_lattice")
    if cache.get("pieces", (None,))[0] != path:
        cache["pieces"] = path, Pieces(path)
    return cache["pieces"][1]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def unit_counts(docs: DataFrame, path: str) -> DataFrame:
    """unit and n of all texts, dealt out by unit.

    Spark counts the words; only distinct ones are cut."""
    text = F.concat(F.lit(BLANK), F.translate("text", " ", BLANK))
    words = F.regexp_extract_all(text, F.lit(_WORD.pattern), F.lit(0))
    counted = docs.where("text <> ''").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            units: Counter[str] = Counter()
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                for u in own.units(word):
                    units[u] += n
            yield pa.RecordBatch.from_arrays([pa.array(units.keys(), pa.string()), pa.array(units.values(), pa.int64())], ["unit", "n"])

    return counted.mapInArrow(cut, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _ends(edge: Column) -> dict[str, Column]:
    """Begin and end of an edge written as a long."""
    mask = F.lit((1 << PLACE) - 1).cast("long")
    return {"a": F.shiftright(edge, PLACE).bitwiseAND(mask).cast("int"), "b": edge.bitwiseAND(mask).cast("int")}


def _short_cuts(edges: Column, size: Column) -> Column:
    """Cuts of a unit of at most SHORT characters; bit k of the state: a boundary before character k."""

    def below(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")) - F.lit(1).cast("long")

    def bit(state: Column, k: Column) -> Column:
        return F.call_function("shiftright", state, k.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    def take(state: Column, edge: Column) -> Column:
        e = _ends(edge)
        inner = state.bitwiseAND(below(e["b"])).bitwiseAND(F.bitwise_not(below(e["a"] + 1)))
        fits = bit(state, e["a"]) & bit(state, e["b"]) & (F.bit_count(inner) == 1)
        return F.when(fits, state.bitwiseAND(F.bitwise_not(inner))).otherwise(state)

    whole = F.call_function("shiftleft", F.lit(1).cast("long"), (size + 1).cast("int")) - F.lit(1).cast("long")
    state = F.aggregate(edges, whole, take)
    inside = F.when(size > 1, F.sequence(F.lit(1), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.filter(inside, lambda k: bit(state, k))


def _long_cuts(edges: Column, size: Column) -> Column:
    """The same with an array of boundaries, for units of any length."""

    def take(state: Column, edge: Column) -> Column:
        e = _ends(edge)
        inner = F.filter(state, lambda k: (k > e["a"]) & (k < e["b"]))
        fits = F.array_contains(state, e["a"]) & F.array_contains(state, e["b"]) & (F.size(inner) == 1)
        return F.when(fits, F.array_except(state, inner)).otherwise(state)

    state = F.aggregate(edges, F.sequence(F.lit(0), size.cast("int")), take)
    return F.filter(state, lambda k: (k > 0) & (k < size))


def unit_cuts(units: DataFrame, path: str) -> DataFrame:
    """unit, n and cuts (inner boundaries of its pieces) of distinct (unit, n).

    The units must be dealt out by unit already, as ``unit_counts`` gives them: then edges
    meet their unit without another shuffle."""
    spark, own = units.sparkSession, pieces(path)
    several = [(p, k) for k, p in enumerate(sorted((p for p in own.id if len(p) > 1), key=lambda p: (own.rank[p], own.id[p])))]
    if len(several) > MOST_PIECES:
        raise ValueError(f"{len(several)} pieces are too many to be sent to all tasks")
    piece = spark.createDataFrame(several, "piece string, rank long")
    size = F.char_length("unit")
    # Place -1 is a row for the unit itself, which stays if no piece is found in it.
    # Units are told apart by a number first, which sorts faster than their text.
    begun = units.withColumn("k", F.monotonically_increasing_id())
    begun = begun.select("k", "unit", "n", F.explode(F.sequence(F.lit(-1), (size - 2).cast("int"))).alias("a"))
    last = F.when(F.col("a") >= 0, F.least(F.col("a") + own.longest, size)).otherwise(F.lit(1))
    ends = F.explode(F.sequence((F.col("a") + 2).cast("int"), last.cast("int")))
    spans = begun.select("k", "unit", "n", "a", ends.alias("b")).withColumn(
        "piece", F.when(F.col("a") >= 0, F.substring("unit", F.col("a") + 1, F.col("b") - F.col("a")))
    )
    found = spans.join(F.broadcast(piece), "piece", "left").where("a < 0 OR rank IS NOT NULL")
    # Rank, begin and end as one long: a third of a struct's memory, and its order is theirs.
    edge = F.shiftleft(F.shiftleft(F.col("rank"), PLACE) + F.col("a"), PLACE) + F.col("b")
    grouped = found.groupBy("k", "unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    cuts = F.when(size <= SHORT, _short_cuts(F.col("edges"), size)).otherwise(_long_cuts(F.col("edges"), size))
    return grouped.select("unit", "n", cuts.alias("cuts"))


def unit_ids(cut: DataFrame, path: str) -> DataFrame:
    """unit, n and ids (binary, STORED) of (unit, n, cuts)."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            pairs = zip(batch["unit"].to_pylist(), batch["cuts"].to_pylist(), strict=True)
            made = pa.array([np.array(own.ids(u, c), dtype=STORED).tobytes() for u, c in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["unit"], batch["n"], made], ["unit", "n", "ids"])

    return cut.select("unit", "n", "cuts").mapInArrow(ids, "unit string, n long, ids binary")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and n_pieces of the whole text of every row of (doc_id, text).

    A null or empty text has no ids.  Repeated rows are encoded alike, each for itself; a
    null doc_id stays null; other columns are left out; an empty table stays empty."""
    from sitelens.llm.recurrent_lm import frequent  # loads pandas, which the workers do without

    path = path or model_path()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(unit_ids(unit_cuts(unit_counts(docs, path), path), path), "units", compression="zstd")
    named = cut.select(F.col("unit").cast("binary").alias("word"), "n")
    words = [w.decode() for w, _ in frequent(named, HEAD)]
    least = None if not words else spark.createDataFrame([(w,) for w in words], "unit string")
    head = {} if least is None else {r["unit"]: bytes(r["ids"]) for r in cut.join(least, "unit").select("unit", "ids").toLocalIterator()}
    shipped = spark.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pieces(path), shipped.value
        hole = np.array([HOLE], dtype=STORED).tobytes()
        closed_words: dict[str, bytes] = {}

        def written(words: list[str], open_units: list[str]) -> Iterator[bytes]:
            for w in words:
                ids = closed_words.get(w)
                if ids is not None:
                    yield ids
                    continue
                units = own.units(w)
                missing = [u for u in units if u not in known]
                ids = b"".join(known.get(u, hole) for u in units)
                if missing:
                    open_units += missing
                elif len(closed_words) < KEPT_WORDS:
                    closed_words[w] = ids
                yield ids

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, opened = [], []
                for text in part["text"]:
                    opened.append([])
                    ids.append(b"".join(written(own.words(text.as_py() or ""), opened[-1])))
                columns = [part["doc_id"], pa.array(ids, pa.binary()), pa.array(opened, pa.list_(pa.string())), pa.array(map(len, opened), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "open_units", "n_open"])

    begun = docs.mapInArrow(run, "doc_id long, ids binary, open_units array<string>, n_open long")
    begun = stored(begun.withColumn("row", F.monotonically_increasing_id()), "begun", compression="zstd")
    rare = begun.where("n_open > 0")
    opened = rare.select("row", F.posexplode("open_units").alias("at", "unit"))
    found = opened.join(cut.select("unit", F.col("ids").alias("own")), "unit")
    closed = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "own"))).alias("closed"))

    def filled(ids: bytes, closed_units: list[dict]) -> bytes:
        have = np.frombuffer(ids, dtype=STORED)
        full, at = [], 0
        for hole, c in zip(np.flatnonzero(have == HOLE).tolist(), closed_units, strict=True):
            full += [have[at:hole].tobytes(), c["own"]]
            at = hole + 1
        return b"".join([*full, have[at:].tobytes()])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = [filled(x, c) if c is not None else x for x, c in zip(part["ids"].to_pylist(), part["closed"].to_pylist(), strict=True)]
                n = np.array(list(map(len, own)), dtype=np.int64) // 2
                flat = np.frombuffer(b"".join(own), dtype=STORED).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids, pa.array(n)], ["doc_id", "ids", "n_pieces"])

    # Only documents with open units are moved; the others go from their file to the output.
    none = F.lit(None).cast(closed.schema["closed"].dataType)
    whole = begun.where("n_open = 0").select("doc_id", "ids", none.alias("closed"))
    joined = rare.select("row", "doc_id", "ids").join(closed, "row").select("doc_id", "ids", "closed")
    return whole.unionByName(joined).mapInArrow(fill, "doc_id long, ids array<int>, n_pieces long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with ids) and decoded, the text that the ids stand for; null for null ids."""
    path = path or model_path()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, own.decoded(part["ids"])], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(text, StructType([*encoded.schema.fields]).add("decoded", StringType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_pieces", "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: ids of every document that the mix kept, a row for each copy."""
    return encode(docs.select("doc_id", "text"))
