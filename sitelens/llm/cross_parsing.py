"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text yields the longest match at a place of a
text; cutting the text greedily into longest matches, the language that explains it with
the fewest phrases wins, each phrase counted as the bits of a pointer into that language's
sample and divided by the text's letters.

Phrases don't cross words: a word (with the blank that ends it) is parsed once per worker
and language and kept, so the cost of a text is a look-up per word.  The automata are built
in the workers from a bounded sample, of which a copy travels with the task."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import fold, stored, table, worker_cache

#: Characters of labelled text learned per language, at most.
SAMPLE_CHARS = 60_000
#: Language sample candidates drawn per language before the strict cut, about.
DRAWN = 400
#: Words whose phrase counts a worker keeps.
KEPT_WORDS = 400_000
UNDETERMINED = "und"
#: The stage rejects what takes over MARGIN times the bits per letter that this share of the
#: labelled held-out texts of the winning language stays within.
WITHIN, MARGIN = 0.99, 1.5
_LETTERS = re.compile(r"[^\W\d_]+")
LETTER = r"\p{L}"
#: Characters of a match that are looked up at once.
HEAD = 3


class SuffixAutomaton:
    """Smallest automaton of all substrings of texts: a dictionary of transitions per state,
    and the states of all their substrings of HEAD characters."""

    def __init__(self, *texts: str) -> None:
        step: list[dict[str, int]] = [{}]
        link, length = [-1], [0]

        def state(step_of: dict[str, int], link_of: int, length_of: int) -> int:
            step.append(step_of)
            link.append(link_of)
            length.append(length_of)
            return len(step) - 1

        def twin(at: int, c: str, to: int) -> int:
            """A copy of ``to`` for the shorter substrings that come from ``at``."""
            own = state(step[to].copy(), link[to], length[at] + 1)
            while at >= 0 and step[at].get(c) == to:
                step[at][c] = own
                at = link[at]
            link[to] = own
            return own

        for text in texts:
            last = 0
            for c in text:
                to = step[last].get(c)
                if to is not None:
                    # Another text began so.
                    last = to if length[to] == length[last] + 1 else twin(last, c, to)
                    continue
                new = state({}, 0, length[last] + 1)
                at = last
                while at >= 0 and c not in step[at]:
                    step[at][c] = new
                    at = link[at]
                if at >= 0:
                    to = step[at][c]
                    link[new] = to if length[to] == length[at] + 1 else twin(at, c, to)
                last = new
        self.step = step
        self.heads = {"": 0}
        for _ in range(HEAD):
            self.heads = {head + c: to for head, state in self.heads.items() for c, to in step[state].items()}

    def phrases(self, word: str) -> int:
        """Phrases of the greedy parse: longest matches, or one character that never occurs."""
        step, heads, n, at, count = self.step, self.heads, len(word), 0, 0
        while at < n:
            begin, state = at, heads.get(word[at : at + HEAD])
            if state is None:
                state = 0
            else:
                at += HEAD
            while at < n and (to := step[state].get(word[at])) is not None:
                state, at = to, at + 1
            if at == begin:
                at += 1
            count += 1
        return count


class Parser(dict):
    """Place of a white-space-separated word in a table of phrase counts per language and letters."""

    def __init__(self, samples: dict[str, str]) -> None:
        super().__init__()
        self.languages = sorted(samples)
        # What is parsed has a blank at its end alone, so each word of a sample, with its blank, is a
        # text of its own: no state is spent on what crosses words.
        self.automata = [SuffixAutomaton(" ", *(w + " " for w in dict.fromkeys(samples[x].split()))) for x in self.languages]
        self.bits = np.array([math.log2(len(samples[x]) + 2) for x in self.languages])
        self.used, self.counts = 0, np.zeros((4096, len(self.languages) + 1), dtype=np.int32)

    def __missing__(self, chunk: str) -> int:
        words = _LETTERS.findall(chunk.lower())
        if self.used == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        row = self.counts[self.used]
        for n, automaton in enumerate(self.automata):
            row[n] = sum(automaton.phrases(w + " ") for w in words)
        row[-1] = sum(map(len, words))
        self[chunk] = self.used
        self.used += 1
        return self.used - 1

    def totals(self, text: str) -> np.ndarray:
        """Phrases per language and, last, letters of a whole text."""
        if len(self) > KEPT_WORDS:
            self.clear()
            self.used = 0
            self.counts = np.zeros((4096, len(self.languages) + 1), dtype=np.int32)
        chunks = text.split()
        total = np.zeros(len(self.languages) + 1, dtype=np.int64)
        for start in range(0, len(chunks), KEPT_WORDS):
            rows = np.fromiter(map(self.__getitem__, chunks[start : start + KEPT_WORDS]), dtype=np.int64)
            total += self.counts[rows].sum(axis=0, dtype=np.int64)
        return total

    def decide(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, score and bits per letter of a text.

        The score is the runner-up's share of both rates: a half for a tie, 1 if no other
        language is known."""
        totals = self.totals(text) if text else None
        if totals is None or not totals[-1] or not self.languages:
            return UNDETERMINED, 0.0, None
        rates = totals[:-1] * self.bits / totals[-1]
        order = np.argsort(rates, kind="stable")
        win = rates[order[0]]
        score = 1.0 if len(order) == 1 else float(rates[order[1]] / (win + rates[order[1]]))
        return self.languages[order[0]], score, float(win)


def training_samples(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language -> lower-cased words of sampled texts, about ``chars`` characters at most.

    labelled: doc_id, text, lang.  Texts are drawn by a hash of the row: about DRAWN rows of
    each language, however many it has, then in hash order until the length is reached (the
    last text is cut).  Rows without language or letters teach nothing."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return {}
    chance = F.create_map(*(F.lit(x) for lang, n in many.items() for x in (lang, min(1.0, DRAWN / n))))
    drawn = rows.where(F.pmod("key", F.lit(1_000_003)) < chance[F.col("lang")] * 1_000_003)
    running = Window.partitionBy("lang").orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1)
    held = drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(running), F.lit(0)))
    held = held.where(F.col("before") < chars).select("lang", F.substring("text", 1, chars).alias("text"), "before")
    parts: dict[str, list[str]] = {}
    for r in sorted(held.collect(), key=lambda r: (r["lang"], r["before"])):
        parts.setdefault(r["lang"], []).append(" ".join(_LETTERS.findall(r["text"].lower())))
    samples = {lang: (" ".join(["", *texts]))[:chars] + " " for lang, texts in parts.items()}
    if missing := set(many) - set(samples):
        # A language whose rows the draw passed over keeps its first rows by hash.
        rest = rows.where(F.col("lang").isin(sorted(missing))).groupBy("lang").agg(F.min_by(F.substring("text", 1, chars), "key").alias("text"))
        samples |= {r["lang"]: f" {' '.join(_LETTERS.findall(r['text'].lower()))} " for r in rest.collect()}
    return samples


def predict(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and bits_per_letter (null if undetermined).

    A text that is null or without letters is ``und`` with score 0.  Only the text is read;
    all input columns are kept (ones named like the results are replaced).  Equal texts are
    judged alike; of languages with equal rates the first by name wins; without samples all
    is ``und``."""
    kept = docs.drop("lang_pred", "score", "bits_per_letter")
    known = tuple(sorted(samples.items()))

    @F.pandas_udf("lang_pred string, score double, bits_per_letter double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("cross_parsing")
        if cache.get("parser", (None,))[0] != known:
            cache["parser"] = known, Parser(dict(known))
        decide = cache["parser"][1].decide
        for batch in batches:
            yield pd.DataFrame(list(map(decide, batch)), columns=["lang_pred", "score", "bits_per_letter"])

    return kept.withColumn("judged", judged(F.col(text))).select(*(F.col(f"`{c}`") for c in kept.columns), "judged.*")


def held_out() -> Column:
    """Rows that the contract keeps from the training."""
    return fold(F.col("doc_id"), 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = training_samples(docs.where(~held_out()))
    judged = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), samples)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "bits_per_letter")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents without letters go, and those that the winning language
    explains worse than its own held-out texts, by MARGIN.

    A language without labelled held-out texts has no measure and keeps its documents; so do all
    documents with letters if no language could be learned."""
    samples = training_samples(docs.where(~held_out()))
    if not samples:
        return docs.where(F.col("text").rlike(LETTER))
    judged = stored(predict(docs, samples).where(F.col("lang_pred") != UNDETERMINED), "judged", compression="zstd")
    own = judged.where(held_out() & (F.col("lang") == F.col("lang_pred")))
    reached = own.groupBy("lang_pred").agg((F.percentile_approx("bits_per_letter", WITHIN, 10_000) * MARGIN).alias("most"))
    kept = judged.join(reached, "lang_pred", "left").where(F.col("most").isNull() | (F.col("bits_per_letter") <= F.col("most")))
    return kept.select(*docs.columns)

