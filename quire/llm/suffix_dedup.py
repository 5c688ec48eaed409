"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through DEPTH bytes, by passes over digits of DIGIT bytes, the most significant first; a digit
stands for its bytes by a 64-bit hash. Suffixes whose group has one member drop out after each pass, and groups that are
left after the last are exactly the repeated windows of DEPTH bytes: their bytes are compared. Only the windows of a
digit with over MOST anchors, where a share of them has over MOST rows too, are told by 128-bit digests of their bytes.

Not every suffix takes part in the first, distributed pass. Equal windows hold equal digits in the same places, so both
have their least digit, the leftmost of equals, in the same place: the anchor. Windows with one anchor follow one
another, so the pass deals one row for each anchor instead, about 1 for 75 bytes. Anchors whose digit is found once in
the corpus end there, with all their windows. The others take the bytes of their windows to the remaining passes, which
run inside the tasks that hold a digit's anchors.

Texts are moved once: distinct texts are written as a bucketed table, and later joins with it shuffle only small rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, map_batches, split_join
from quire.plans.session import ship_package

DEPTH, DIGIT = 200, 50
#: Bytes that a worker looks at together.
CHUNK = 1 << 20
#: Anchors of a digit beyond which its windows are dealt in SHARES, and rows of a share beyond which they are dealt one by one: no task holds more of one digit.
MOST, SHARES = 20_000, 4
BASE, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(max(n, 2 * CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[int(base)] = np.multiply.accumulate(steps)
    return held[:n]


def digits(data: np.ndarray, digit: int = DIGIT) -> np.ndarray:
    """Hashes of the `digit` bytes from each place of data (uint8)."""
    n = len(data) - digit + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    h = (sums[digit:] - sums[:n]) * powers(UNBASE, n)
    for mix in (MIX_1, MIX_2):
        h ^= h >> np.uint64(33)
        h *= mix
    h ^= h >> np.uint64(33)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """digit, place, first and last window of each anchor. data: texts one after another; ends: where each ends."""
    width = depth - digit + 1
    hashed = digits(data, digit)
    empty = np.empty(0, np.int64)
    if len(data) < depth:
        return empty.view(np.uint64), empty, empty, empty
    low = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(low) + 1, np.int8)
    long = ends - starts >= depth
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - depth + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    if not len(windows):
        return empty.view(np.uint64), empty, empty, empty
    place = (low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1))))
    tails = np.concatenate((heads[1:], [len(windows)])) - 1
    return hashed[place[heads]], place[heads], windows[heads], windows[tails]


def chunks(texts: list[bytes], depth: int = DEPTH, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least `depth` bytes joined to chunks: bytes, ends, row of each, its offset. Long texts come in parts that overlap by less than a window."""
    parts, rows, offsets, held = [], [], [], 0

    def joined():
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)

    for row, text in enumerate(texts):
        if len(text) < depth:
            continue
        for offset in range(0, len(text) - depth + 1, most):
            part = text[offset : offset + most + depth - 1]
            if held and held + len(part) > most:
                yield joined()
                parts, rows, offsets, held = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(offset)
            held += len(part)
    if parts:
        yield joined()


def find_anchors(texts: DataFrame, depth: int, digit: int) -> DataFrame:
    """key (the digit), b, d (the text), first, last (windows) and lead (bytes from the first window to it) of all anchors."""

    def run(batch):
        b, d = batch.column("b").to_numpy(), batch.column("d").to_numpy()
        for data, ends, rows, offsets in chunks([x.as_py() for x in batch.column("text")], depth):
            key, place, first, last = anchors(data, ends, depth, digit)
            part = np.searchsorted(ends, place, side="right")
            shift = offsets[part] - np.concatenate(([0], ends[:-1]))[part]
            yield {"key": key.view(np.int64), "b": b[rows[part]], "d": d[rows[part]], "first": first + shift, "last": last + shift, "lead": place - first}

    return map_batches(texts.select("b", "d", F.col("text").cast("binary").alias("text")), run, "key long, b long, d long, first long, last long, lead int")


CONTEXTS = "key long, crowded boolean, b long, d long, firsts array<long>, data binary"


def contexts(joined: DataFrame, depth: int, digit: int, most: int) -> DataFrame:
    """The bytes of each anchor's windows, once for each text. joined: b, d, text, found (array of key, n, first, last, lead).

    Where a digit has over `most` anchors, its windows go in SHARES by how far they begin before it. All windows of a
    share hold the same bytes around the digit, nearly a whole window; those bytes are the key, so the crowd falls apart.
    """
    step = -(-(depth - digit + 1) // SHARES)

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("key", "crowded", "b", "d", "firsts", "data")}
        for b, d, text, found in zip(*(batch.column(c) for c in ("b", "d", "text", "found")), strict=True):
            text, b, d = text.as_py(), b.as_py(), d.as_py()
            own: dict[tuple[int, bool, bytes], list[int]] = {}
            for x in found.as_py():
                first, last, place = x["first"], x["last"], x["first"] + x["lead"]
                if x["n"] <= most:
                    own.setdefault((x["key"], False, text[first : last + depth]), []).append(first)
                    continue
                for near in range(0, depth - digit + 1, step):
                    low, high = max(first, place - near - step + 1), min(last, place - near)
                    if low <= high:
                        core = text[place - near : place - near - step + 1 + depth]
                        key = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=near.to_bytes(8, "little")).digest(), "little", signed=True)
                        own.setdefault((key, True, text[low : high + depth]), []).append(low)
            for (key, crowded, data), firsts in own.items():
                for k, v in zip(out, (key, crowded, b, d, firsts, data), strict=True):
                    out[k].append(v)
            if len(out["key"]) > 20_000:
                yield out
                out = {k: [] for k in out}
        yield out

    return map_batches(joined.select("b", "d", F.col("text").cast("binary").alias("text"), "found"), run, CONTEXTS)


def windows(rows: DataFrame, depth: int) -> DataFrame:
    """Each window of the contexts by itself: its digest, b, d, start."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("window", "b", "d", "start")}
        for b, d, firsts, data in zip(*(batch.column(c).to_pylist() for c in ("b", "d", "firsts", "data")), strict=True):
            for i in range(len(data) - depth + 1):
                window = hashlib.blake2b(data[i : i + depth], digest_size=16).digest()
                for first in firsts:
                    for k, v in zip(out, (window, b, d, first + i), strict=True):
                        out[k].append(v)
            if len(out["b"]) > 20_000:
                yield out
                out = {k: [] for k in out}
        yield out

    return map_batches(rows.select("b", "d", "firsts", "data"), run, "window binary, b long, d long, start long")


def same_bytes(buffer: np.ndarray, at: np.ndarray, weight: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which windows of the groups are repeated by their bytes too; a hash may be one for different bytes."""
    windows, order = np.lib.stride_tricks.sliding_window_view(buffer, depth), np.argsort(group)
    ordered = group[order]
    pairs, torn = np.flatnonzero(ordered[1:] == ordered[:-1]), [np.empty(0, group.dtype)]
    for start in range(0, len(pairs), 1 << 14):
        x = pairs[start : start + (1 << 14)]
        differ = (windows[at[order[x]]] != windows[at[order[x + 1]]]).any(axis=1)
        torn.append(ordered[x[differ]])
    keep = np.ones(len(at), bool)
    for g in np.unique(np.concatenate(torn)):
        own = np.flatnonzero(group == g)
        often: dict[bytes, int] = {}
        for i in own:
            often[windows[at[i]].tobytes()] = often.get(windows[at[i]].tobytes(), 0) + int(weight[i])
        keep[own] = [often[windows[at[i]].tobytes()] > 1 for i in own]
    return keep


def radix(keys: np.ndarray, data: list[bytes], often: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: row, first and last window in its data. often: how many times a row's data occurs."""
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    begins = np.cumsum(lengths) - lengths
    buffer = np.frombuffer(b"".join(data), np.uint8)
    hashed = digits(buffer, digit)
    n = lengths - depth + 1
    row = np.repeat(np.arange(len(data)), n)
    at = np.repeat(begins, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    group = keys[row].view(np.uint64)
    for place in range(0, depth, digit):
        code = (group ^ (group >> np.uint64(31))) * MIX_1 + hashed[at + min(place, depth - digit)]
        order = np.argsort(code)
        ordered = code[order]
        heads = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        number = np.cumsum(heads) - 1
        more = np.add.reduceat(often[row[order]], np.flatnonzero(heads)) > 1 if len(order) else heads
        keep = np.sort(order[more[number]])
        at, row, group = at[keep], row[keep], code[keep]
        if not len(at):
            break
    if len(at):
        keep = same_bytes(buffer, at, often[row], group, depth)
        at, row = at[keep], row[keep]
    if not len(at):
        return row, at, at
    heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))))
    tails = np.concatenate((heads[1:], [len(at)])) - 1
    return row[heads], at[heads] - begins[row[heads]], at[tails] - begins[row[heads]]


MARKS = "b long, d long, start long, end long"


def resolve(rows: DataFrame, depth: int, digit: int) -> DataFrame:
    """The remaining passes. rows: contexts dealt and sorted by key. Marks are byte ranges of texts."""
    ship_package(rows.sparkSession)

    def marks(table: pa.Table):
        firsts = table.column("firsts").to_pylist()
        row, first, last = radix(table.column("key").to_numpy(), table.column("data").to_pylist(), np.fromiter(map(len, firsts), np.int64, len(firsts)), depth, digit)
        counts = np.array([len(firsts[r]) for r in row], dtype=np.int64)
        begun = np.array([x for r in row for x in firsts[r]], dtype=np.int64)
        row, first, last = np.repeat(row, counts), np.repeat(first, counts), np.repeat(last, counts)
        b, d = table.column("b").to_numpy(), table.column("d").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(b[row]), pa.array(d[row]), pa.array(begun + first), pa.array(begun + last + depth)], names=["b", "d", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < 4 * CHUNK:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last digit's anchors may go on
            if cut:
                yield marks(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
            size = sum(x.nbytes for x in held) if cut else 0
        if held:
            yield marks(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, MARKS)


def remove(joined: DataFrame) -> DataFrame:
    """digest, n_removed, n_spans, kept_sha256, spans for texts with marks. joined: digest, text, marks (array of start, end)."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("digest", "n_removed", "n_spans", "kept_sha256", "spans")}
        for digest, text, marks in zip(*(batch.column(c) for c in ("digest", "text", "marks")), strict=True):
            text, spans = text.as_py(), []
            for start, end in sorted((m["start"], m["end"]) for m in marks.as_py()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
            kept, at = hashlib.sha256(), 0
            for start, end in spans:
                kept.update(text[at:start])
                at = end
            kept.update(text[at:])
            for k, v in zip(out, (digest.as_py(), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]), strict=True):
                out[k].append(v)
        yield out

    return map_batches(joined.select("digest", F.col("text").cast("binary").alias("text"), "marks"), run, "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def repeated_spans(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, most: int = MOST) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go).

    A null text is empty. A text that occurs more than once, and has `depth` bytes, goes whole. Rows that repeat a
    doc_id are documents of their own. `depth` must be a multiple of `digit`. Very long texts are cut into parts that
    overlap, so no window is missed. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    half = lambda a: F.conv(F.hex(F.substring("digest", a, 7)), 16, 10).cast("long")
    keyed = keyed.withColumns({"b": half(1), "d": half(9)})
    rows = scratch.table(keyed.select("doc_id", "n_bytes", "digest"), "rows")
    name = f"quire_texts_{uuid.uuid4().hex}"
    distinct = keyed.groupBy("b", "d").agg(F.first("digest").alias("digest"), F.first("text").alias("text"), F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    distinct.write.bucketBy(buckets, "b", "d").option("path", scratch.path("texts")).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    found = scratch.table(find_anchors(texts.where(F.col("n_bytes") >= depth), depth, digit), "anchors")
    often = scratch.table(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = split_join(found, often, "key", "n", found.count())
    per_text = shared.groupBy("b", "d").agg(F.collect_list(F.struct("key", "n", "first", "last", "lead")).alias("found"))
    taken = scratch.table(contexts(texts.join(per_text, ["b", "d"]), depth, digit, most), "contexts")
    scratch.discard("anchors", "often")
    plain = ["key", "b", "d", "firsts", "data"]
    in_tasks, marks = taken.where("NOT crowded").select(plain), None
    crowd = taken.where("crowded")
    if not crowd.isEmpty():
        sizes = scratch.table(crowd.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("firsts")).alias("m")).where("m > 1"), "sizes")
        met = scratch.table(split_join(crowd, sizes, "key", "n", crowd.count()), "crowd")
        in_tasks = in_tasks.unionByName(met.where(F.col("n") <= most).select(plain))
        single = windows(met.where(F.col("n") > most), depth)
        if not met.where(F.col("n") > most).isEmpty():
            single = scratch.table(single, "single")
            repeated = scratch.table(single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "windows")
            marks = split_join(single, repeated, "window", "n", single.count()).select("b", "d", "start", (F.col("start") + depth).alias("end"))
    resolved = resolve(in_tasks.repartition(buckets, "key").sortWithinPartitions("key"), depth, digit)
    marks = resolved if marks is None else resolved.unionByName(marks)
    per_text = marks.groupBy("b", "d").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    removed = scratch.table(remove(texts.where("n = 1").join(per_text, ["b", "d"])), "removed")
    scratch.discard("contexts", "sizes", "crowd", "single", "windows")

    whole = (F.col("n") > 1) & (F.col("n_bytes") >= depth)
    groups = texts.select("digest", "n", "n_bytes").join(removed, "digest", "left").select(
        "digest",
        "n",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>"))).alias("spans"),
    )
    result = split_join(rows, scratch.table(groups, "groups"), "digest", "n", rows.count())
    scratch.discard("texts")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
