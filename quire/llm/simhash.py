"""SimHash near-duplicates through a hierarchical index in Gray order.

Equal fingerprints are one node. Two fingerprints with at most 4 differing bits agree in one of 5 blocks of bits, so each
is dealt to 5 buckets by (block, its bits there) and no link is lost. A bucket that grows too full is dealt again by
blocks of its remaining bits, level after level. Inside a bucket fingerprints are sorted by Gray rank, so neighbours
share most bits. Upper nodes hold what all below them share, as masked bit patterns; a pair of nodes is compared by the
differences of its shared bits, which add up on the way down. It is pruned whole beyond 4, and linked whole once even
the bits that aren't shared can't exceed 4. A bucket emits the links of a spanning forest, never all pairs. Components
follow by alternating large-star and small-star rounds on written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, chosen, map_batches, numbered, split_join, word_blocks
from quire.plans.session import ship_package

SHINGLE = 4
BITS = 4
FAN_OUT = 8
#: Fingerprints in a bucket beyond which it is dealt again, and how often at most (17 bits of 64 then remain).
FULL, DEPTH = 20_000, 3
#: Pairs of nodes that are compared at once.
FRONTIER = 1 << 20
SEED = 42


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    import xxhash

    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    carried: list[bytes] = []  # words that the next block's first shingles begin with
    for block in word_blocks(data.lower()):
        words = carried + block
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64)
            n += len(hashes)
            for at in range(0, len(hashes), 1 << 16):
                counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        carried = words[max(0, len(words) - shingle + 1) :]
    if not n:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. A null text has no words."""

    def run(batch):
        made = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], dtype=np.uint64)
        yield {"doc_id": batch.column("doc_id"), "fp": made.view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(shift))
    return fp


class Forest:
    """Sets of members 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        new = ra != rb
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(ra[new], rb[new]), np.maximum(ra[new], rb[new])], axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                self.links.append((x, y))
        if parent:
            table = np.arange(len(self.root))
            for x in list(parent):
                table[x] = find(x)
            self.root = table[self.root]


def link(fp: np.ndarray, bucket: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest among the fingerprints (uint64, distinct in a bucket) of each bucket."""
    order = np.lexsort((gray_rank(fp), bucket))
    fp, bucket = fp[order], bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    # Levels of nodes from the leaves up. A node covers the rows [first, last) and shares `mask` bits of `value`.
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [{"value": fp, "mask": np.full(len(fp), full), "first": np.arange(len(fp)), "last": np.arange(1, len(fp) + 1), "tree": np.repeat(np.arange(len(edges) - 1), np.diff(edges))}]
    while len(levels[-1]["tree"]) > len(edges) - 1:
        low = levels[-1]
        begins = np.searchsorted(low["tree"], np.arange(len(edges) - 1))
        place = np.arange(len(low["tree"])) - begins[low["tree"]]
        heads = np.flatnonzero(place % FAN_OUT == 0)
        ones = np.bitwise_and.reduceat(low["value"] & low["mask"], heads)
        zeros = np.bitwise_and.reduceat(~low["value"] & low["mask"], heads)
        tails = np.concatenate((heads[1:], [len(low["tree"])]))
        levels.append({"value": ones, "mask": ones | zeros, "first": low["first"][heads], "last": low["last"][tails - 1], "tree": low["tree"][heads], "child": heads, "end": tails})
    forest = Forest(len(fp))
    top = len(levels) - 1
    roots = np.arange(len(levels[top]["tree"]))
    stack = [(top, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(depth, a[half:], b[half:]), (depth, a[:half], b[:half])]
            continue
        now = levels[depth]
        shared = now["mask"][a] & now["mask"][b]
        differ = np.bitwise_count((now["value"][a] ^ now["value"][b]) & shared).astype(np.int64)
        keep = differ <= bits
        a, b, differ, shared = a[keep], b[keep], differ[keep], shared[keep]
        if not len(a):
            continue
        whole = differ + 64 - np.bitwise_count(shared) <= bits
        if whole.any():
            forest.join(*((a[whole], b[whole]) if depth == 0 else _star(now, a[whole], b[whole])))
        a, b = a[~whole], b[~whole]
        if not len(a):
            continue
        sizes_a, sizes_b = now["end"][a] - now["child"][a], now["end"][b] - now["child"][b]
        n = sizes_a * sizes_b
        at = np.repeat(np.arange(len(a)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = now["child"][a][at] + k // sizes_b[at], now["child"][b][at] + k % sizes_b[at]
        once = x <= y if depth > 1 else x < y
        stack.append((depth - 1, x[once], y[once]))
    if not forest.links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.array(forest.links)
    return fp[pairs[:, 0]], fp[pairs[:, 1]]


def _star(now: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first row of node x to all rows of x and y."""
    firsts, froms, tos = now["first"][x], [], []
    for node in (x, y):
        n = now["last"][node] - now["first"][node]
        froms.append(np.repeat(firsts, n))
        tos.append(np.repeat(now["first"][node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.concatenate(froms), np.concatenate(tos)


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the free bits (a mask) into parts of nearly equal number."""
    places = [i for i in range(64) if free >> i & 1]
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def deal(rows: DataFrame, scratch: Scratch, bits: int, full: int = FULL, depth: int = DEPTH) -> DataFrame:
    """fp and bucket, so that any two fingerprints within `bits` meet in a bucket.

    Fixed bits of a bucket are the blocks on its path: over full buckets lose the fixed bits from what may differ and
    are dealt by blocks of the others.
    """

    def dealt(frame: DataFrame, free) -> DataFrame:
        masks = [m - (1 << 64) if m >> 63 else m for m in _blocks(free, bits + 1)]
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
        return frame.withColumn("x", F.explode(each)).select("fp", "path", F.col("x.i").alias("i"), F.xxhash64("bucket", "x.i", "x.v").alias("bucket"))

    every = (1 << 64) - 1
    out: list[DataFrame] = []
    open_sets = [(dealt(rows.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("bucket")), every), every)]
    for level in range(depth):
        later = []
        for k, (frame, free) in enumerate(open_sets):
            frame = scratch.table(frame, f"deal{level}-{k}")
            sizes = frame.groupBy("bucket").count().where(F.col("count") > full)
            crowded = scratch.table(sizes, f"full{level}-{k}")
            if level == depth - 1 or crowded.isEmpty():
                out.append(frame)
                continue
            total = frame.count()
            inside = split_join(frame, crowded, "bucket", "count", total).drop("count")
            out.append(frame.join(crowded.select("bucket"), "bucket", "left_anti"))
            for i, mask in enumerate(_blocks(free, bits + 1)):
                later.append((dealt(inside.where(F.col("i") == i), free & ~mask), free & ~mask))
        open_sets = later
    found = out[0].select("fp", "bucket")
    for frame in out[1:]:
        found = found.unionByName(frame.select("fp", "bucket"))
    return found


def links(rows: DataFrame, scratch: Scratch, bits: int = BITS, full: int = FULL) -> DataFrame:
    """a, b: links that connect whatever a chain of links within `bits` connects. rows: distinct fp."""
    ship_package(rows.sparkSession)
    dealt = deal(rows, scratch, bits, full)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held_fp: list[np.ndarray] = []
        held_bucket: list[np.ndarray] = []
        size = 0

        def made(fp, bucket):
            a, b = link(fp, bucket, bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_fp.append(batch.column("fp").to_numpy().view(np.uint64))
            held_bucket.append(batch.column("bucket").to_numpy())
            size += len(held_fp[-1])
            if size >= 1 << 18:
                fp, bucket = np.concatenate(held_fp), np.concatenate(held_bucket)
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield from made(fp[:cut], bucket[:cut])
                held_fp, held_bucket, size = [fp[cut:]], [bucket[cut:]], len(fp) - cut
        if size:
            yield from made(np.concatenate(held_fp), np.concatenate(held_bucket))

    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").select("fp", "bucket").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that is reachable, for every node of edges (a, b).

    Rounds of large-star and small-star until nothing changes; each is written, so an executor's loss costs one round.
    A node's smallest neighbour is found with map-side combining, and nodes with many neighbours get it by broadcast.
    """

    def least(frame: DataFrame, name: str) -> DataFrame:
        # frame: u, v. For each u the smallest of u and its neighbours.
        mins = frame.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        return scratch.table(mins.withColumn("m", F.least("u", "m")), name)

    scratch = Scratch(edges.sparkSession, "stars")
    edges = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * edges.count()
        large = split_join(both, least(both, f"large{step}"), "u", "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, f"star{step}")
        small = split_join(large, least(large, f"small{step}"), "u", "n", large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        scratch.discard(*([f"edges{step}", f"large{step - 1}", f"star{step - 1}", f"small{step - 1}"] if step else ["edges0"]))
        edges = scratch.table(small, f"edges{step + 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        step += 1
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, full: int = FULL) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint, component_id.

    The component is named by the smallest doc_id in it. Rows without a doc_id take part and get the component's name;
    it is null only where no row of the component has one. A null text has no words, like an empty one: fingerprint 0.
    Very long texts are cut into words block by block. Repeated rows have one fingerprint and are one node, but rows of the
    result each. Other columns aren't read, whatever their names; an empty table gives no rows. A bucket that is still full
    after three deals, of fingerprints that share all bits dealt by, is told apart in one task.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, shingle), "fingerprints")
    total = rows.count()
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "nodes")
    found = components(scratch.table(links(nodes.select("fp"), scratch, bits, full), "links"))
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", "n", F.coalesce("component", "fp").alias("component"))
    labelled = scratch.table(labelled, "labelled")
    names = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("fps"))
    names = scratch.table(names, "names")
    per_fp = split_join(labelled, names, "component", "fps", nodes.count()).select("fp", "n", "component_id")
    per_fp = scratch.table(per_fp, "per_fp")
    joined = split_join(rows, per_fp, "fp", "n", total)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(rows: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the numbered rows of each group (at, component) the one with the smallest doc_id (null last)."""
    named = scratch.table(rows.select("at", F.col("row.doc_id").alias("id")).join(groups, "at"), "named_rows")
    best = named.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")).alias("best"))
    best = scratch.table(best.where("n > 1").select("component", "n", F.col("best.at").alias("keep_at")), "best")
    gone = scratch.table(split_join(named, best, "component", "n", named.count()).where("at <> keep_at").select("at"), "gone")
    return chosen(rows, gone, "left_anti").select("row.*")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id (null last) of each component, with all columns of docs; nulls, repeated rows and empty tables as in near_duplicates()."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = numbered(docs, scratch)
    groups = near_duplicates(rows.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")))
    return one_of_each(rows, groups.select(F.col("doc_id").alias("at"), F.col("component_id").alias("component")), scratch)
