"""Packing into sequences by shortest-pack-first over the length histogram.

Token ids are cut into pieces of at most the sequence's length. Only the histogram of piece lengths goes to the driver
(as many rows as a sequence has places at most). Lengths are placed longest first, each time into the packs that hold
least so far, a whole count of equal packs at once; the resulting patterns with their counts are joined back to the
pieces by a piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, global_rank, map_batches
from quire.llm.tokens import frequent_table, id_encoder, on_workers, packed_ids

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order of placing) with their counts."""
    open_packs: dict[int, list[tuple[list[int], int]]] = {}
    levels: list[int] = []  # filled so far, ascending
    done: list[tuple[list[int], int]] = []

    def add(filled: int, pattern: list[int], count: int) -> None:
        if filled == capacity:
            done.append((pattern, count))
            return
        if filled not in open_packs:
            open_packs[filled] = []
            insort(levels, filled)
        open_packs[filled].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left:
            if not levels or levels[0] + length > capacity:
                # as many equal pieces in each new pack as fit
                made.append((length, [length], left))
                break
            filled = levels[0]
            pattern, count = open_packs[filled].pop()
            if not open_packs[filled]:
                del open_packs[filled]
                levels.pop(bisect_left(levels, filled))
            used = min(left, count)
            if used < count:
                add(filled, pattern, count - used)
            add(filled + length, [*pattern, length], used)
            left -= used
        for x in made:
            _new_packs(x, capacity, add)
    return done + [x for packs in open_packs.values() for x in packs]


def _new_packs(made: tuple[int, list[int], int], capacity: int, add) -> None:
    """`count` pieces of one length that fit in no open pack: shortest-first fills new packs evenly."""
    length, _, count = made
    fit = capacity // length
    packs = -(-count // fit)
    each, more = divmod(count, packs)
    if more:
        add(length * (each + 1), [length] * (each + 1), more)
    add(length * each, [length] * each, packs - more)


def placements(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[int], list[int], list[int]]]:
    """By length: rank at which a run begins, its first sequence, its offset there, in rising rank."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            starts, sequences, offsets = out.setdefault(length, ([], [], []))
            starts.append(used.get(length, 0))
            sequences.append(first)
            offsets.append(offset)
            used[length] = used.get(length, 0) + count
            offset += length
        first += count
    return out


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of the capacity."""
    encoder = on_workers(docs.sparkSession, id_encoder, path, frequent_table(docs.sparkSession, path))
    end, width = packed_ids([END_ID]), 4 * capacity

    def cut(batch):
        own = encoder()
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            begun, held, rows = 0, b"", []
            for part in (*own.parts(text.as_py().decode("utf-8", "replace")), end):
                held += part
                while len(held) >= width:
                    rows.append((begun, capacity, zlib.crc32(held[:width])))
                    held, begun = held[width:], begun + capacity
            if held:
                rows.append((begun, len(held) // 4, zlib.crc32(held)))
            total = begun + len(held) // 4
            for start, length, crc in rows:
                for k, v in zip(out, (doc_id, start, length, crc, total), strict=True):
                    out[k].append(v)
        yield out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece, its end id. Rows that repeat a doc_id are documents of their own. Pieces of
    equal length take their places in the order of doc_id (null first) and start; those that tie in both are alike. Very
    long texts are cut at multiples of the capacity as they are encoded. Other columns aren't read, whatever their names; an
    empty table gives no rows.
    """
    import numpy as np

    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.table(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    before, at = {}, 0
    for length in sorted(histogram):
        before[length], at = at, at + histogram[length]
    laid = {k: tuple(np.array(x) for x in v) for k, v in placements(pack_lengths(histogram, capacity)).items()}
    plan = spark.sparkContext.broadcast((laid, before))

    def place(batch):
        runs, firsts = plan.value
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            starts, first, offset = runs[int(length)]
            rank = ranks[own] - firsts[int(length)]
            run = np.searchsorted(starts, rank, side="right") - 1
            sequences[own], offsets[own] = first[run] + rank - starts[run], offset[run]
        yield {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": sequences, "offset": offsets}

    ranked = global_rank(scratch, cut, ["length", "doc_id", "start"], "ranked")
    return map_batches(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), place, PLACED)
