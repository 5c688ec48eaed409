"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model's outcomes are the end of a text, the most frequent words, and classes of the other words by their last bytes.
A word of a class has the class's probability times (c + 1) / (n + v + 1), c its own count, n and v the class's tokens
and words in training; the spare 1 stands for all words that training never saw. Those are one event here: the
probabilities of all words that training saw, and of that event, sum to at most 1, and every text has one.

Counts of words and of neighbouring outcomes cover the whole training part. The log-bilinear scores u.r + b of outcome
pairs are trained in numpy by noise-contrastive estimation on all those pairs, with the noise's expectation in place of
drawn noise. Normalised log-probabilities of all outcomes after each context come from one matrix product, and a text's
tokens look theirs up in it.

Counts of the FREQUENT most frequent words are broadcast, a table of fixed size. Other words meet their counts in a join.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, map_batches, slices
from quire.llm.sharding import size_class
from quire.plans.session import ship_package

FREQUENT = 1 << 18
OUTCOMES, WORDS, TAIL = 1024, 700, 2
END = 0
DIMENSIONS, NOISE, STEPS, RATE = 64, 25.0, 250, 0.05
#: Words that a worker counts before it hands them on.
COUNTED = 300_000


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(train: DataFrame) -> DataFrame:
    """word (lower-cased UTF-8), c: each partition adds up its words first."""
    ship_package(train.sparkSession)

    def run(batches):
        counted: Counter = Counter()

        def made():
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["word", "c"])
            counted.clear()

        for batch in batches:
            for text in batch.column("text"):
                words = text.as_py().lower().split()
                for at in range(0, len(words), COUNTED):
                    counted.update(words[at : at + COUNTED])
                    if len(counted) >= COUNTED:
                        yield from made()
        if counted:
            yield from made()

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Words with broadcast counts, the outcomes of all words, and what a class's words share."""

    def __init__(self, frequent: list[tuple[bytes, int]], tails: list[tuple[bytes, int, int]], rest: tuple[int, int], ends: int, outcomes: int = OUTCOMES, words: int = WORDS) -> None:
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.ends = ends
        own = min(words, len(frequent))
        self.first_tail, self.other = 1 + own, outcomes - 1
        self.tails = {t: self.first_tail + i for i, (t, _, _) in enumerate(tails)}
        counts = np.array([c for _, c in frequent], dtype=np.float64)
        self.log_count = np.log10(counts + 1)
        self.outcome = np.array([i + 1 if i < own else self.tail(w) for i, (w, _) in enumerate(frequent)], dtype=np.int64)
        #: log10 of n + v + 1 for classes, 0 for words of their own
        self.log_class = np.zeros(outcomes)
        for i, (_, n, v) in enumerate(tails):
            self.log_class[self.first_tail + i] = np.log10(n + v + 1)
        self.log_class[self.other] = np.log10(rest[0] + rest[1] + 1)
        self.is_class = np.zeros(outcomes, bool)
        self.is_class[self.first_tail :] = True

    def tail(self, word: bytes) -> int:
        return self.tails.get(word[-TAIL:], self.other)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the place among the frequent ones (-1: none) and the outcome."""
        get = self.index.get
        place = np.array([get(w, -1) for w in words], dtype=np.int64)
        outcome = self.outcome[place] if len(self.outcome) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(place < 0).tolist():
            outcome[i] = self.tail(words[i])
        return place, outcome


def train_nce(pairs: np.ndarray, dimensions: int = DIMENSIONS, noise: float = NOISE, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """log10 P(next | context) for all outcomes (rows: contexts) from the counts of outcome pairs."""
    size, total = len(pairs), max(pairs.sum(), 1.0)
    contexts = pairs.sum(axis=1, keepdims=True)
    q = (pairs.sum(axis=0) + 1) / (total + size)  # the noise: outcomes by frequency
    data = (pairs / total).astype(np.float32)
    noised = (noise * contexts / total * q).astype(np.float32)
    shift = np.log(noise * q).astype(np.float32)
    random = np.random.default_rng(7)
    parts = [random.normal(0, 0.1, (size, dimensions)).astype(np.float32), random.normal(0, 0.1, (size, dimensions)).astype(np.float32), np.log(q).astype(np.float32)]
    means, squares = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        u, r, b = parts
        # a pair is real with probability s; data pull its score up, the noise pulls it down
        s = 1 / (1 + np.exp(-np.clip(u @ r.T + b - shift, -30, 30)))
        pull = noised * s - data * (1 - s)
        for i, g in enumerate((pull @ r, pull.T @ u, pull.sum(axis=0))):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            fade = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            parts[i] = parts[i] - fade * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-12)
    u, r, b = (p.astype(np.float64) for p in parts)
    scores = u @ r.T + b
    scores -= scores.max(axis=1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)


def pair_counts(train: DataFrame, vocabulary, outcomes: int = OUTCOMES) -> np.ndarray:
    """Counts of neighbouring outcomes; a text begins after an end and ends with one. At most outcomes**2 sums reach the driver."""

    def run(batches):
        own = vocabulary.value
        sums = np.zeros(outcomes * outcomes, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                outcome = np.concatenate(([END], own.look_up(text.as_py().lower().split())[1], [END]))
                np.add.at(sums, outcome[:-1] * outcomes + outcome[1:], 1)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])

    found = train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(outcomes * outcomes)
    pairs[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return pairs.reshape(outcomes, outcomes)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most so many words with their counts, the most frequent first: whole classes of alike counts, from the top.

    Only a histogram of classes and the chosen words leave their tasks, so no task sorts all words.
    """
    classed = counts.withColumn("class", size_class(F.col("c")))
    held, least = 0, None
    for r in sorted(classed.groupBy("class").count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["class"]
    if least is None:
        return []
    chosen = classed.where(F.col("class") >= least).select("word", "c").toArrow().to_pylist()
    return sorted(((bytes(r["word"]), r["c"]) for r in chosen), key=lambda x: (-x[1], x[0]))


def fit(train: DataFrame, counts: DataFrame, ends: int, outcomes: int = OUTCOMES, words: int = WORDS, frequent: int = FREQUENT):
    """The vocabulary and the table of log-probabilities, both of bounded size, as broadcasts."""
    context = train.sparkSession.sparkContext
    top = most_frequent(counts, frequent)
    own = train.sparkSession.createDataFrame([(w,) for w, _ in top[:words]], "word binary")
    others = counts.join(F.broadcast(own), "word", "left_anti")
    by_tail = others.groupBy(F.expr(f"substring(word, -{TAIL}, {TAIL})").alias("tail")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    tails = [(bytes(r["tail"]), r["n"], r["v"]) for r in by_tail.orderBy(F.desc("n"), "tail").limit(outcomes - 2 - words).toArrow().to_pylist()]
    all_n, all_v = others.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rest = (all_n - sum(n for _, n, _ in tails), all_v - sum(v for _, _, v in tails))
    vocabulary = context.broadcast(Vocabulary(top, tails, rest, ends, outcomes, words))
    return vocabulary, context.broadcast(train_nce(pair_counts(train, vocabulary, outcomes)).astype(np.float32))


def score(docs: DataFrame, outcomes: int = OUTCOMES, words: int = WORDS, frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities. A null or empty text is one token, its end. Without training rows all counts
    are 0. Rows that repeat a doc_id count as often as they occur. Very long texts are scored whole. Other columns aren't
    read, whatever their names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    every = texts(docs)
    train = every.where("NOT held_out")
    counts = scratch.table(word_counts(train), "counts")
    ends = train.count()
    n_words, v_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_words + ends, v_words + (ends > 0)
    vocabulary, table = fit(train, counts, ends, outcomes, words, frequent)

    def run(batch):
        own, log_p = vocabulary.value, table.value
        for start, stop in slices(batch, "text"):
            part = batch.slice(start, stop - start)
            out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "counted", "modelled", "rare", "often")}
            for text in part.column("text"):
                found = text.as_py().lower().split()
                place, outcome = own.look_up(found)
                seen = place >= 0
                logs = own.log_count[place[seen]]
                path = np.concatenate(([END], outcome, [END]))
                modelled = log_p[path[:-1], path[1:]].sum(dtype=np.float64) - own.log_class[outcome].sum() + logs[own.is_class[outcome[seen]]].sum()
                rare = Counter(found[i] for i in np.flatnonzero(~seen).tolist())
                out["n_tokens"].append(len(found) + 1)
                out["known"].append(int(seen.sum()) + (own.ends > 0))
                out["counted"].append(float(logs.sum() + np.log10(own.ends + 1)))
                out["modelled"].append(float(modelled))
                out["rare"].append(list(rare))
                out["often"].append(list(rare.values()))
            yield {"doc_id": part.column("doc_id"), "held_out": part.column("held_out")} | out

    rows = map_batches(every, run, "doc_id long, held_out boolean, n_tokens long, known long, counted double, modelled double, rare array<binary>, often array<long>")
    rows = scratch.table(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    rare = rows.select("at", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("at", F.col("x.rare").alias("word"), F.col("x.often").alias("often"))
    met = rare.join(counts, "word", "left")
    sums = met.groupBy("at").agg(F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("rare_known"), F.sum(F.col("often") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"))
    joined = rows.drop("rare", "often").join(sums, "at", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_log"])
    base = F.col("counted") + F.col("rare_log") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("modelled") + F.col("rare_log")).alias("score"))
