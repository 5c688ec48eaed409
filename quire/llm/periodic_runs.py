"""Periodic runs of words in a text, and texts with each run collapsed to its first period.

Karp-Miller-Rosenberg naming: the words of a text get numbers, and a stretch of 2**k words gets the number of the pair of
its halves' names, so two stretches of 2**k words are equal if their names are. How far a text goes on alike from two
places, forwards or backwards, then comes by taking levels from the highest down, for many pairs of places at once in
numpy. No stretch is told by a hash and no suffixes are sorted.

A run of period p has at least p places in a row whose word comes again p words later (12 - p if that is more), so it
has one on a grid of that pitch: all pairs (i, i + p) with i on the grid of p and equal words are candidates, some
n log n for n words, and are extended both ways. Levels are built only as far as some candidate agrees. Texts are
independent: one narrow pass, nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, slices, word_blocks

#: A run has LEAST words, and two periods, at least.
LEAST = 12
#: Candidates that are extended at once.
AT_ONCE = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Names:
    """Names of all stretches of 2**k words, level by level, each made when first asked for."""

    def __init__(self, words: np.ndarray) -> None:
        self.levels = [words.astype(np.int32)]
        self.n = len(words)

    def __getitem__(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            pairs = below[:-half].astype(np.int64) * (int(below.max()) + 1) + below[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        return self.levels[k]

    def _equal(self, k: int, left: np.ndarray, right: np.ndarray, back: bool) -> np.ndarray:
        """Whether the stretches of 2**k words that begin, or end, at the two places are equal; left < right."""
        size = 1 << k
        inside = left >= size if back else right + size <= self.n
        out = np.zeros(len(left), bool)
        if inside.any():
            shift, names = size if back else 0, self[k]
            out[inside] = names[left[inside] - shift] == names[right[inside] - shift]
        return out

    def alike(self, left: np.ndarray, right: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from each pair of places on, or before them."""
        top, sign = 0, -1 if back else 1
        # two halves in a row agree somewhere, so the next level is worth its making
        while (self._equal(top, left, right, back) & self._equal(top, left + (sign << top), right + (sign << top), back)).any():
            top += 1
        way = np.zeros(len(left), np.int64)
        for k in range(top, -1, -1):
            way += self._equal(k, left + sign * way, right + sign * way, back).astype(np.int64) << k
        return way


def grid(n: int, least: int):
    """Pairs (place, period) on the grids of all periods, AT_ONCE or so at a time."""
    periods = np.arange(1, n // 2 + 1, dtype=np.int64)
    pitch = np.maximum(periods, least - periods)
    counts = -(-(n - periods) // pitch)
    ends = np.cumsum(counts)
    at = 0
    while at < len(periods):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own = counts[at:stop]
        step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        yield step * np.repeat(pitch[at:stop], own), np.repeat(periods[at:stop], own)
        at = stop


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows of start, end and period, by start, then period, of all maximal runs of a text's numbered words.

    A stretch that has several of the periods is one run with the smallest: they are multiples of it, and lead to the
    same stretch.
    """
    found = [np.empty((0, 3), np.int64)]
    n = len(words)
    if n >= least:
        names = Names(words)
        for place, period in grid(n, least):
            hit = names.levels[0][place] == names.levels[0][place + period]
            place, period = place[hit], period[hit]
            if not len(place):
                continue
            start = place - names.alike(place, place + period, back=True)
            end = place + period + names.alike(place, place + period)
            long = end - start >= np.maximum(least, 2 * period)
            found.append(_smallest(np.stack((start[long], end[long], period[long]), axis=1)))
    runs = _smallest(np.concatenate(found))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows with one start and end, the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def numbered_words(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)) for words in word_blocks(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: it goes if any run holds it after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def collapse(text: bytes, kept: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    out, at = [], 0
    for words in word_blocks(text):
        out += [w for w, stays in zip(words, kept[at : at + len(words)].tolist(), strict=True) if stays]
        at += len(words)
    return b" ".join(out)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, runs (start, length and period, in words, by start, then period) and collapsed.

    A run is a maximal stretch of words with a smallest period q and max(least, 2 * q) words at least; collapsed has the
    words that no run holds after its first q words. A null text is empty and has no words. A very long text is held
    whole, as numbers of words and their names (4 bytes a word for each level of names that equal stretches need). Rows
    that repeat an id are rows of their own, a null id stays null; other columns aren't read, whatever their names; no
    documents give no rows. Runs that tie in their start are told apart by period.
    """

    def scan(batch):
        ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
        for low, high in slices(batch, "text"):
            sizes, runs, texts = [], [], []
            for i in range(low, high):
                text = column[i].as_py()
                words = numbered_words(text)
                found = find_runs(words, least)
                sizes.append(len(words))
                runs.append([{"start": s, "length": e - s, "period": p} for s, e, p in found.tolist()])
                texts.append(collapse(text, kept_words(len(words), found)).decode("utf-8", "replace"))
            yield {"doc_id": ids[low:high], "n_words": sizes, "runs": runs, "collapsed": texts}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), scan, SCHEMA)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """docs, where about one document in ten repeats a stretch of its words to its end: h, the crc32 of doc_id in decimal, chooses which (h % 10 = 0) and what.

    A null id counts as empty text, whose h is 0; a text without words stays.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, F.transform(F.array(words), lambda w: _repeated(w, F.floor(h / 10)))[0]).otherwise(F.col("text")))


def _repeated(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    place = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " ")).otherwise(F.lit(""))


def run_digests(docs: DataFrame) -> DataFrame:
    """periodic_runs() as counts and digests, with the longest run (ties: the smallest start, then period)."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic_runs(docs).withColumn("top", longest)
    start, length, period = -F.col("top.back"), F.col("top.length"), -F.col("top.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * top.length) div -top.less").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
