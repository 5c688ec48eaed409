"""Benchmark decontamination: the words of documents that lie in passages of benchmark items, by a prefix-filtered set join.

A window is WINDOW consecutive words of an item (a shorter item is one window of all its words) and holds the set of its
shingles of SHINGLE words. A document contains a window only if it contains all its shingles. So shingles are ordered by
rarity, counted over all documents, and the rarest is the prefix that a window needs: for containment one is enough, and
a window with a shingle that no document has is gone before any join. Documents and windows meet on that shingle; the
place that it would give the window must lie inside the document (positional and length bounds), and the words there are
compared with the window's at last. Hashes choose candidates only.

No text of a document is shuffled: tasks read it twice, keep what a bit filter of bounded size lets through, and send a
few words around each shingle of the prefixes. Shingles in over 1/HEAVY of what is sent, known from their counts, are
joined by broadcast where the rows lie, as long as those are few windows, else in a sort-merge join, whose large
partitions Spark splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import FEW_GROUPS, HEAVY, Scratch, map_batches, slices

WINDOW, SHINGLE = 10, 5
#: Bytes to A-Z in lower case, and to a space where they don't belong to a word: all of ASCII but letters and digits.
FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: Bytes whose words are hashed at once; bits of a filter at most (16 MB) and for each key.
BLOCK, FILTER_BITS, BITS_A_KEY = 1 << 20, 1 << 27, 64
#: Windows of an item that go on together.
WINDOWS_AT_ONCE = 1 << 13

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a folded text."""
    codes = np.frombuffer(data, np.uint8)
    inside = codes != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, high = starts[at], ends[stop - 1]
        own = starts[at:stop] - low
        place = np.arange(high - low) - np.repeat(own, np.diff(own, append=high - low))
        value = np.where(inside[low:high], (codes[low:high].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095], np.uint64(0))
        hashes[at:stop] = np.add.reduceat(value, own)
        at = stop
    return starts, ends, _mixed(hashes)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * _FACTOR + words[i : i + n]
    return _mixed(total)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id (as a string), window (its words, space-joined), size (in words), tokens (hashes of its shingles in order)."""

    def cut(batch: pa.RecordBatch):
        for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
            data = text.as_py().translate(FOLDED)
            _, _, hashes = hashed_words(data)
            words = data.split()
            size = min(window, len(words))
            if not size:
                continue
            width = min(shingle, size)
            tokens = shingles(hashes, width).view(np.int64)
            held = size - width + 1
            for low in range(0, len(words) - size + 1, WINDOWS_AT_ONCE):
                places = range(low, min(low + WINDOWS_AT_ONCE, len(words) - size + 1))
                yield {"item_id": [name] * len(places), "window": [b" ".join(words[i : i + size]).decode() for i in places], "size": [size] * len(places), "tokens": [tokens[i : i + held] for i in places]}

    return map_batches(items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), cut, "item_id string, window string, size int, tokens array<long>")


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Two bits for each key (long) in a table of 2**15 to FILTER_BITS bits, as bytes. What passes has to be checked."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (keys.count() * BITS_A_KEY).bit_length()))
    probes = F.array(F.col(column).bitwiseAND(bits - 1) + 1, F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1) + 1)  # Spark's bitmaps count bits from 1
    places = keys.select(F.explode(probes).alias("bit"))
    table = np.zeros((bits // (1 << 15), 1 << 12), np.uint8)
    for row in places.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("set")).collect():
        table[row["bucket"] - 1] = np.frombuffer(row["set"], np.uint8)
    return table.ravel()


def passing(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that a bit filter lets through."""
    low = np.uint64(len(table) * 8 - 1)
    first = keys & low
    at = np.flatnonzero(table[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8) & 1)
    second = keys[at] >> np.uint64(32) & low
    return at[(table[second >> np.uint64(3)] >> (second & np.uint64(7)).astype(np.uint8) & 1) > 0]


def counted_shingles(docs: DataFrame, table, sizes: list[int]) -> DataFrame:
    """h, n: how often documents hold each shingle that the filter lets through. Tasks count before they send."""

    def count(batch: pa.RecordBatch):
        column = batch.column("text")
        for low, high in slices(batch, "text"):
            found = [np.empty(0, np.uint64)]
            for i in range(low, high):
                _, _, words = hashed_words(column[i].as_py().translate(FOLDED))
                for size in sizes:
                    keys = shingles(words, size)
                    found.append(keys[passing(table.value, keys)])
            keys, often = np.unique(np.concatenate(found), return_counts=True)
            yield {"h": keys.view(np.int64), "n": often}

    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_batches(texts, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def meeting_places(docs: DataFrame, table, sizes: list[int], window: int) -> DataFrame:
    """Two kinds of rows. For each document at, doc_id and n_words; for each of its shingles that the filter lets through
    at, h, pos (its word number), context (the words around it, where a window may lie) and before (how many of these come first)."""
    schema = "at long, doc_id long, n_words long, h long, pos long, before int, context string"

    def scan(batch: pa.RecordBatch):
        column, rows, ids = batch.column("text"), batch.column("at").to_pylist(), batch.column("doc_id").to_pylist()
        for low, high in slices(batch, "text"):
            own = {c: [] for c in ("at", "doc_id", "n_words", "h", "pos", "before", "context")}
            for i in range(low, high):
                data = column[i].as_py().translate(FOLDED)
                starts, ends, words = hashed_words(data)
                n = len(words)
                _append(own, rows[i], ids[i], n, None, None, None, None)
                for size in sizes:
                    keys = shingles(words, size)
                    for pos in passing(table.value, keys).tolist():
                        first, last = max(0, pos - (window - size)), min(n, pos + window) - 1
                        _append(own, rows[i], None, None, int(keys[pos : pos + 1].view(np.int64)[0]), pos, pos - first, b" ".join(data[starts[first] : ends[last]].split()).decode())
                        if len(own["at"]) >= WINDOWS_AT_ONCE:
                            yield own
                            own = {c: [] for c in own}
            yield own

    texts = docs.select(F.monotonically_increasing_id().alias("at"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_batches(texts, scan, schema)


def _append(columns: dict[str, list], *values) -> None:
    for held, value in zip(columns.values(), values, strict=True):
        held.append(value)


def heavy_join(rows: DataFrame, others: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join on key. others: written, perhaps many rows for a key, with the number of the key's `rows` in `size`.

    Keys with over total/HEAVY rows meet theirs by broadcast if at most FEW_GROUPS of others have such keys; the rest in
    a shuffle, and all of them where those are more.
    """
    heavy = others.where(F.col(size) > max(1, total // HEAVY))
    if heavy.count() > FEW_GROUPS:
        return rows.join(others, key)
    near = rows.join(F.broadcast(heavy), key)
    far = rows.join(F.broadcast(heavy.select(key).distinct()), key, "left_anti").join(others.where(F.col(size) <= max(1, total // HEAVY)), key)
    return near.unionByName(far)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, spans and items.

    spans: start and length, in words, of the maximal runs of words that lie in occurrences of windows of items (item_id,
    text); items: the ids, as strings in order, of the items with windows that occur. A null text has no words, and an
    item without words has no windows. Very long texts and items are taken whole. Rows of docs that repeat an id are rows
    of their own; items that repeat an id are one item with the windows of all; an item without an id has its words
    found, but isn't listed. Other columns aren't read, whatever their names. Without documents there are no rows,
    without items nothing is found.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    raw = scratch.table(item_windows(items, window, shingle), "raw")
    kept = raw.groupBy("window").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.min("item_id").alias("low"), F.max("item_id").alias("high"))
    windows = scratch.table(kept.withColumn("wid", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle))).distinct().collect())
    tokens = windows.select("wid", F.posexplode("tokens").alias("offset", "h"))

    live = windows.join(rarest(docs, tokens, sizes), "wid").select("wid", "window", "size", "h", "offset", "n", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).alias("item_id"), (F.col("low") != F.col("high")).alias("shared"))
    live = scratch.table(live, "live")
    table = spark.sparkContext.broadcast(bit_filter(live.select("h").distinct(), "h"))
    found = scratch.table(meeting_places(docs, table, sizes, window), "found")
    total = live.select("h", "n").distinct().agg(F.sum("n")).first()[0] or 0
    words = F.split("context", " ")
    there = F.array_join(F.slice(words, F.col("before") - F.col("offset") + 1, F.col("size")), " ")
    met = heavy_join(found.where("h IS NOT NULL").select("at", "h", "pos", "before", "context"), live, "h", "n", total)
    hits = met.where((F.col("offset") <= F.col("before")) & (there == F.col("window"))).select("at", (F.col("pos") - F.col("offset")).alias("start"), F.col("size").cast("long").alias("size"), "wid", "item_id", "shared")
    hits = scratch.table(hits, "hits")

    covered = hits.groupBy("at").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("places")).select("at", joined_spans(F.col("places")).alias("spans"))
    named = items_of(scratch, hits, raw, windows).groupBy("at").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    rows = found.where("h IS NULL").select("at", "doc_id", "n_words")
    none = "CAST(array() AS array<struct<start: long, length: long>>)"
    return rows.join(covered, "at", "left").join(named, "at", "left").select("doc_id", "n_words", F.coalesce("spans", F.expr(none)).alias("spans"), F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"))


def rarest(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """wid, h, offset, n: for each window whose shingles documents all hold, the one they hold least often."""
    table = docs.sparkSession.sparkContext.broadcast(bit_filter(tokens.select("h").distinct(), "h"))
    ranked = tokens.join(counted_shingles(docs, table, sizes), "h", "left")
    first = F.min_by(F.struct("h", "offset"), F.struct("n", "h", "offset"))
    return ranked.groupBy("wid").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), first.alias("p")).where("n > 0").select("wid", "p.*", "n")


def joined_spans(places) -> F.Column:
    """Maximal runs of words in sorted places (start, size), as start and length."""
    none = F.array().cast("array<struct<start: long, length: long>>")

    def add(held, x):
        last = F.element_at(held, -1)
        end = last["start"] + last["length"]
        longer = F.array_append(F.slice(held, F.lit(1), F.size(held) - 1), F.struct(last["start"].alias("start"), (F.greatest(end, x["start"] + x["size"]) - last["start"]).alias("length")))
        return F.when((F.size(held) > 0) & (x["start"] <= F.try_element_at(held, F.lit(-1))["start"] + F.try_element_at(held, F.lit(-1))["length"]), longer).otherwise(F.array_append(held, F.struct(x["start"].alias("start"), x["size"].alias("length"))))

    return F.aggregate(places, none, add)


def items_of(scratch: Scratch, hits: DataFrame, raw: DataFrame, windows: DataFrame) -> DataFrame:
    """at, item_id, distinct: the items whose windows occur. A window of one item brings it along; those of several are looked up."""
    alone = hits.where("NOT coalesce(shared, false) AND item_id IS NOT NULL").select("at", "item_id")
    shared = scratch.table(hits.where("shared").select("at", "wid").distinct(), "shared")
    often = shared.groupBy("wid").agg(F.count("*").alias("n"))
    holders = raw.where("item_id IS NOT NULL").select("item_id", "window").distinct().join(windows.select("wid", "window").join(often, "wid"), "window").select("wid", "item_id", "n")
    several = heavy_join(shared, scratch.table(holders, "holders"), "wid", "n", shared.count())
    return alone.unionByName(several.select("at", "item_id")).distinct()


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination() with its counts, and a digest of the items."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["length"])
    found = contamination(docs, items).withColumn("n_hit", length)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ') AS x, least({WINDOW}, len(w)) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT r, unnest(range(1, len(w) + 1)) AS s, unnest(w) AS word FROM d),
l AS (SELECT r, s, list_filter([word, {", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))}], lambda x: x IS NOT NULL) AS x FROM e WINDOW o AS (PARTITION BY r ORDER BY s)),
m AS (SELECT r, s, n, array_to_string(list_slice(x, 1, n), ' ') AS x FROM l, sizes WHERE len(x) >= n),
f AS (SELECT m.r, m.s, m.n, w.item_id FROM m JOIN w ON m.x = w.x AND m.n = w.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM f) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, coalesce(CAST(len(w) AS BIGINT), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)"""


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
