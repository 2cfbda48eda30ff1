"""Scoring by a gated recurrent language model, in numpy.

Words are lower-cased; the most frequent training words have a place in the model, all
others share one (OTHER), whose probability is divided among them by their counts.  The
output softmax is factored: a word's class, then the word within its class.  Training is
truncated backpropagation over windows of many documents side by side; scoring carries the
state across windows to the end of each document, so a document's score is the log
probability of its whole text.

Counts cover all training documents; the recurrent weights are fitted in rounds on a hash
share of them, by every task on its own rows, and averaged (weighted by words)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import fold, stored, table, worker_cache

#: Words with a place in the model, classes, sizes of the embedding and of the state.
PLACES, CLASSES, EMBEDDING, STATE = 1_022, 32, 16, 24
#: Words whose counts travel to the tasks; the counts of others are joined.
HEAD = 200_000
#: Rounds over disjoint parts of the training documents, words of a task in a round, about,
#: and tasks' models that are averaged at once on the driver, at most.
ROUNDS, TASK_WORDS, AVERAGED = 3, 400_000, 32
#: Words between two updates; documents side by side; step size.
WINDOW, LANES, RATE = 24, 64, 0.05
#: Distinct words a task counts before it hands them on; words scored side by side.
HELD_WORDS, SCORED = 500_000, 1_500_000
END = b""
OTHER, END_AT = 0, 1


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, as UTF-8; then END, which no word equals."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n of all texts of (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words(text))
                if len(held) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words of (word, n), at most ``most``, most frequent first.

    The least count comes from a histogram over powers of 2 ** (1/16), a few hundred rows,
    so that nothing sorts all words; words of the range that would pass the bound are out."""
    step = F.floor(F.log2("n") * 16).alias("step")
    histogram = sorted(counts.groupBy(step).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, held = None, 0
    for r in histogram:
        held += r["words"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("n") * 16) >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Places and classes of the model's words: classes of equal square-rooted mass, so that
    frequent words are in small classes."""

    def __init__(self, counts: list[tuple[bytes, int]], n_all: int) -> None:
        """counts: most frequent first, without END; n_all: all training words."""
        kept = [(w, n) for w, n in counts if w != END][:PLACES]
        n_end = dict(counts).get(END, 1)
        self.place = {w: k + 2 for k, (w, _) in enumerate(kept)} | {END: END_AT}
        self.n_other = max(0, n_all - n_end - sum(n for _, n in kept))
        counted = np.array([self.n_other + 1, n_end + 1, *(n for _, n in kept)], dtype=np.float64)
        mass = np.sqrt(counted)
        order = np.argsort(-mass, kind="stable")
        at = np.minimum((np.cumsum(mass[order]) - mass[order] / 2) / mass.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        _, at = np.unique(at, return_inverse=True)
        self.size = len(mass)
        self.class_of = np.empty(self.size, dtype=np.int64)
        self.class_of[order] = at
        self.n_classes = int(at.max()) + 1
        self.members = [np.sort(order[at == c]) for c in range(self.n_classes)]
        self.slot = np.empty(self.size, dtype=np.int64)
        for own in self.members:
            self.slot[own] = np.arange(len(own))
        in_class = np.bincount(self.class_of, counted)
        # Where the output's biases start: the frequencies.
        self.class_log = np.log(in_class / in_class.sum())
        self.word_log = np.log(counted / in_class[self.class_of])

    def places(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, tokens, repeat(OTHER)), dtype=np.int32, count=len(tokens))


class Model:
    """Gated recurrent unit with a class-factored softmax; parameters in one flat vector."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None, seed: int = 11) -> None:
        self.vocabulary = v = vocabulary
        shapes = {
            "embed": (v.size, EMBEDDING), "inp": (EMBEDDING, 3 * STATE), "rec": (STATE, 3 * STATE), "bias": (3 * STATE,),
            "cls": (STATE, v.n_classes), "cls_bias": (v.n_classes,), "out": (v.size, STATE), "out_bias": (v.size,),
        }
        size = sum(map(math.prod, shapes.values()))
        fresh = flat is None
        if fresh:
            rng = np.random.default_rng(seed)
            flat = (rng.standard_normal(size) * 0.1).astype(np.float32)
        self.flat, self.part, at = flat, {}, 0
        for name, shape in shapes.items():
            self.part[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        if fresh:
            self.part["cls_bias"][:], self.part["out_bias"][:] = v.class_log, v.word_log

    def like(self) -> "Model":
        return Model(self.vocabulary, np.zeros_like(self.flat))

    def inputs(self) -> np.ndarray:
        """What each word adds to the three gates."""
        return self.part["embed"] @ self.part["inp"] + self.part["bias"]

    def step(self, given: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state, and what the way back needs."""
        pushed = state @ self.part["rec"]
        gates = 1 / (1 + np.exp(-(given[:, : 2 * STATE] + pushed[:, : 2 * STATE])))
        update, reset = gates[:, :STATE], gates[:, STATE:]
        fresh = np.tanh(given[:, 2 * STATE :] + reset * pushed[:, 2 * STATE :])
        return fresh + update * (state - fresh), update, reset, fresh, pushed[:, 2 * STATE :]

    def output(self, states: np.ndarray, targets: np.ndarray, grad: "Model | None" = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log probability of each target, and with ``grad`` the slope of their sum by state."""
        p, v = self.part, self.vocabulary
        n = np.arange(len(targets))
        own = v.class_of[targets]
        logits = states @ p["cls"] + p["cls_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        total = odds.sum(axis=1, keepdims=True)
        logp = logits[n, own] - np.log(total[:, 0])
        back = None
        if grad is not None:
            delta = -odds / total
            delta[n, own] += 1
            grad.part["cls"] += states.T @ delta
            grad.part["cls_bias"] += delta.sum(axis=0)
            back = delta @ p["cls"].T
        order = np.argsort(own, kind="stable")
        edges = np.searchsorted(own[order], np.arange(v.n_classes + 1))
        for c in range(v.n_classes):
            rows = order[edges[c] : edges[c + 1]]
            members = v.members[c]
            if not len(rows) or len(members) == 1:
                continue
            weights = p["out"][members]
            logits = states[rows] @ weights.T + p["out_bias"][members]
            logits -= logits.max(axis=1, keepdims=True)
            slot, k = v.slot[targets[rows]], np.arange(len(rows))
            odds = np.exp(logits)
            total = odds.sum(axis=1, keepdims=True)
            logp[rows] += logits[k, slot] - np.log(total[:, 0])
            if grad is not None:
                delta = -odds / total
                delta[k, slot] += 1
                grad.part["out"][members] += delta.T @ states[rows]
                grad.part["out_bias"][members] += delta.sum(axis=0)
                back[rows] += delta @ weights
        return logp, back


class Trainer:
    """Adagrad on windows of LANES documents; a lane goes on with the next document where one ends."""

    def __init__(self, model: Model) -> None:
        self.model, self.squares = model, np.full_like(model.flat, 1e-4)
        self.state = np.zeros((LANES, STATE), dtype=np.float32)
        self.last = np.full(LANES, END_AT, dtype=np.int64)
        self.seen = 0

    def window(self, targets: np.ndarray) -> None:
        """targets: [lanes, steps] places of the first lanes."""
        model, (n, steps) = self.model, targets.shape
        given_of = model.inputs()
        previous = np.concatenate([self.last[:n, None], targets[:, :-1]], axis=1)
        state, kept, outputs = self.state[:n], [], []
        for t in range(steps):
            # The end of a document clears the state: documents don't know of each other.
            state = state * (previous[:, t] != END_AT)[:, None]
            new, *rest = model.step(given_of[previous[:, t]], state)
            kept.append((state, *rest))
            outputs.append(new)
            state = new
        grad = model.like()
        stacked = np.concatenate(outputs)
        _, back = model.output(stacked, targets.T.reshape(-1), grad)
        back = back.reshape(steps, len(targets), STATE)
        carried = np.zeros_like(state)
        given_slopes = np.empty((steps, len(targets), 3 * STATE), dtype=np.float32)
        for t in reversed(range(steps)):
            before, update, reset, fresh, pushed = kept[t]
            slope = back[t] + carried
            by_fresh = slope * (1 - update) * (1 - fresh * fresh)
            by_update = slope * (before - fresh) * update * (1 - update)
            by_reset = by_fresh * pushed * reset * (1 - reset)
            to_given = np.concatenate([by_update, by_reset, by_fresh], axis=1)
            to_pushed = np.concatenate([by_update, by_reset, by_fresh * reset], axis=1)
            grad.part["rec"] += before.T @ to_pushed
            given_slopes[t] = to_given
            carried = (slope * update + to_pushed @ model.part["rec"].T) * (previous[:, t] != END_AT)[:, None]
        flat = given_slopes.reshape(-1, 3 * STATE)
        by_word = np.zeros((model.vocabulary.size, 3 * STATE), dtype=np.float32)
        np.add.at(by_word, previous.T.reshape(-1), flat)
        grad.part["embed"] += by_word @ model.part["inp"].T
        grad.part["inp"] += model.part["embed"].T @ by_word
        grad.part["bias"] += flat.sum(axis=0)
        slope = np.clip(grad.flat / targets.size, -1, 1)
        self.squares += slope * slope
        model.flat += RATE * slope / np.sqrt(self.squares)
        self.state[:n], self.last[:n] = state, targets[:, -1]
        self.seen += targets.size


def fit(docs: DataFrame, vocabulary: Vocabulary, n_all: int) -> np.ndarray:
    """Weights fitted on all ``n_all`` words of (text, key) in ROUNDS; key spreads the documents
    over rounds and tasks, whose number follows from the words: how the table is partitioned
    doesn't matter."""
    flat = Model(vocabulary).flat
    tasks = math.ceil(n_all / (ROUNDS * TASK_WORDS)) or 1

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer = Trainer(Model(vocabulary, flat.copy()))
        waiting: list[np.ndarray] = []
        n = 0

        def run(places: np.ndarray) -> None:
            # The first lanes have one word more where the words don't come out even.
            steps, more = divmod(len(places), LANES)
            cut = more * (steps + 1)
            longer = places[:cut].reshape(more, steps + 1).astype(np.int64)
            lanes = np.concatenate([longer[:, :steps], places[cut:].reshape(LANES - more, steps).astype(np.int64)])
            for start in range(0, steps, WINDOW):
                trainer.window(lanes[:, start : start + WINDOW])
            if more:
                trainer.window(longer[:, steps:])

        for batch in batches:
            for text in batch["text"]:
                waiting.append(vocabulary.places(words(text)))
                n += len(waiting[-1])
                if n >= 40 * LANES * WINDOW:
                    run(np.concatenate(waiting))
                    waiting, n = [], 0
        if waiting:
            run(np.concatenate(waiting))
        if trainer.seen:
            yield pd.DataFrame({"seen": [trainer.seen], "flat": [trainer.model.flat.tobytes()]})

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(len(flat)), 0
        for batch in batches:
            for n, x in zip(batch["seen"], batch["flat"], strict=True):
                total += n * np.frombuffer(x, dtype=np.float32)
                seen += n
        if seen:
            yield pd.DataFrame({"seen": [seen], "flat": [(total / seen).astype(np.float32).tobytes()]})

    for k in range(ROUNDS):
        own = docs.where(F.pmod("key", F.lit(ROUNDS)) == k).repartition(tasks, "key").sortWithinPartitions("key", "text")
        models = own.select("text").mapInPandas(train, "seen long, flat binary").repartition(AVERAGED)
        rows = models.mapInPandas(average, "seen long, flat binary").collect()
        if rows:
            rows.sort(key=lambda r: (r["seen"], r["flat"]))
            seen = sum(r["seen"] for r in rows)
            flat = (sum(r["seen"] * np.frombuffer(r["flat"], dtype=np.float32).astype(np.float64) for r in rows) / seen).astype(np.float32)
    return flat


def log_probabilities(model: Model, places: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence of places, from a clear state to its end.

    Longest first, so that those still running are the first lanes; states are kept for a
    window and go through the output layer together."""
    order = sorted(range(len(places)), key=lambda k: -len(places[k]))
    lengths = np.array([len(places[k]) for k in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([places[k] for k in order])
    given_of = model.inputs()
    total = np.zeros(len(order))
    state = np.zeros((len(order), STATE), dtype=np.float32)
    live, held, goals, lanes, n_held = len(order), [], [], [], 0
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        previous = flat[starts[:live] + t - 1] if t else np.full(live, END_AT)
        state = model.step(given_of[previous], state[:live])[0]
        held.append(state)
        goals.append(flat[starts[:live] + t])
        lanes.append(live)
        n_held += live
        if n_held >= 100_000 or t == lengths[0] - 1:
            logp, _ = model.output(np.concatenate(held), np.concatenate(goals))
            at = 0
            for n in lanes:
                total[:n] += logp[at : at + n]
                at += n
            held, goals, lanes, n_held = [], [], [], 0
    out = np.empty(len(order))
    out[order] = total
    return out


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of
    (doc_id, text); ``training`` tells the rows to learn from.

    Null and empty texts are an end alone.  Repeated rows are scored alike; other columns are
    left out.  Without training rows all words are unknown; an empty table stays empty."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", training.alias("training"))
    counts = stored(word_counts(docs.where("training")), "counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = whole["n"], whole["v"]
    head = frequent(counts)
    vocabulary = Vocabulary(head, n_all)
    n_in = sum(1 for w, _ in head if w in vocabulary.place)
    # OTHER's share is divided among its words and one unknown, as the base is.
    other_total = math.log10(vocabulary.n_other + 0.5 * (n_types - n_in + 1))
    learned = docs.where("training").select("text", F.xxhash64("doc_id", "text").alias("key"))
    flat = fit(learned, vocabulary, n_all) if n_all else Model(vocabulary).flat
    shipped = spark.sparkContext.broadcast((head, flat))
    run_id = uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("recurrent_lm")
        if cache.get("lm", (None,))[0] != run_id:
            own_head, own_flat = shipped.value
            cache["lm"] = (
                run_id,
                {w: k for k, (w, _) in enumerate(own_head)},
                np.log10(np.array([n for _, n in own_head] or [1]) + 0.5),
                np.array([vocabulary.place.get(w, OTHER) for w, _ in own_head] or [0], dtype=np.int32),
                Model(vocabulary, own_flat.copy()),
            )
        _, place_in_head, logs, place_of, model = cache["lm"]

        def flush(rows: list[tuple], texts: list[np.ndarray]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "other_sum", "n_other", "tail"])
            out["model_sum"] = log_probabilities(model, texts) / math.log(10)
            return out.astype({"doc_id": "Int64"})

        rows, texts, n = [], [], 0
        for batch in batches:
            for doc_id, text, trained in zip(batch["doc_id"], batch["text"], batch["training"], strict=True):
                tokens = words(text)
                at = np.fromiter(map(place_in_head.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
                known = at >= 0
                inside = at[known]
                places = np.zeros(len(tokens), dtype=np.int32)
                places[known] = place_of[inside]
                places[-1] = END_AT
                logs_in = logs[inside]
                tail = [tokens[k] for k in np.flatnonzero(~known)]
                rows.append(
                    (
                        None if pd.isna(doc_id) else int(doc_id), not trained, len(tokens), len(inside), float(logs_in.sum()),
                        float(logs_in[place_of[inside] == OTHER].sum()), int((places == OTHER).sum()), tail,
                    )
                )
                texts.append(places)
                n += len(tokens)
                if n >= SCORED:
                    yield flush(rows, texts)
                    rows, texts, n = [], [], 0
        if rows:
            yield flush(rows, texts)

    schema = (
        "doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, other_sum double, n_other long, "
        "tail array<binary>, model_sum double"
    )
    # Rows get a number once and for all: the table is written before it is read twice.
    part = docs.select(F.col("doc_id").cast("long"), "text", "training").mapInPandas(run, schema)
    scored = stored(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode("tail").alias("word"))
    # END is in the head whenever anything was learned.
    least = math.log10(0.5)
    sums = (
        tail.join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.coalesce(F.log10(F.col("n") + 0.5), F.lit(least))).alias("tail_sum"), F.count("n").alias("tail_known"))
    )
    whole_sum = F.coalesce("tail_sum", F.lit(0.0))
    base_total = math.log10(n_all + 0.5 * (n_types + 1))
    return (
        scored.drop("tail")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (F.col("head_sum") + whole_sum - F.col("n_tokens") * base_total).alias("base_score"),
            (F.col("model_sum") + F.col("other_sum") + whole_sum - F.col("n_other") * other_total).alias("score"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) != 1)
