"""Near copies of whole texts: Jaccard similarity of word shingles of THRESHOLD or more, without a loss.

The SimHash index gives the first links: it finds the tight copies, each link checked by the whole sets. Fingerprints of
64 bits can't find all pairs of that similarity (at 0.8 they differ in 9 bits on average), so the rest follows exactly.
Two sets that similar share one of the first fifth of their shingles, in any order that is the same for all sets. These
shingles of each set are dealt, shingles that a sample of the rows shows to be common last, and what meets is compared by
the whole sets: first all sets with a shingle against a few of them, then, where a shingle has more sets than that, all
pairs that still have different labels. Such pairs must share more than one of the dealt shingles, how many follows from their sizes, which
tells most of them apart where they meet. Nothing rests on a sketch: the sample decides the order only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import HEAVY, Scratch, chosen, look_up, map_batches, numbered, perhaps_heavy, split_join, word_blocks
from quire.llm.simhash import components, fingerprint, links, one_of_each
from quire.plans.session import ship_package

WIDTH = 5
#: Jaccard similarity of near copies, as a fraction: a / b.
THRESHOLD = (4, 5)
#: Rows that are sampled for common shingles, and in how many of them a shingle is common. Both bound the broadcast.
SAMPLE, COMMON = 20_000, 4
#: Pairs that a worker compares at once, and sets of a shingle that meet in one cell.
PAIRS, CELL = 1 << 18, 4096
#: A set's shingles are counted in 2**k parts, by their leading bits, with 4 shingles a part at most as far as k allows.
LEAST_K, MOST_K = 9, 16
#: Sets of a shingle, about, that all its sets are held against before all pairs are.
HEADS = 32
#: 64-bit words of the bitmap that a set's dealt shingles leave.
MARKS = 8
#: Pairs with one set beyond which the set is sent to several tasks.
CROWD = 4096


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text in UTF-8; a text of fewer words has one, one without words none."""
    import xxhash

    blocks = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_blocks(data.lower())]
    if not blocks:
        return np.empty(0, np.uint64)
    each = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
    width = min(width, len(each))
    n = len(each) - width + 1
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    found = (found ^ (found >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    found = (found ^ (found >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(found ^ (found >> np.uint64(31)))


def _name(found: np.ndarray) -> int:
    """A name of a set, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _counts(found: np.ndarray) -> bytes:
    """How many shingles of the set each part has, a byte each; empty where that is too many for a byte."""
    k = min(max((len(found) // 4).bit_length(), LEAST_K), MOST_K)
    counts = np.bincount((found >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _dealt_size(size):
    """How many shingles of a set are dealt: of two near copies each shares one of these."""
    return size - -(-size * THRESHOLD[0] // THRESHOLD[1]) + 1


def _marks(dealt: np.ndarray) -> bytes:
    """A bitmap of the dealt shingles."""
    bits = np.zeros(MARKS * 64, np.uint8)
    bits[(dealt % np.uint64(MARKS * 64)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _may_share(marks_a: np.ndarray, marks_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sets share as many dealt shingles, by their bitmaps, as near copies of these sizes have to.

    Near copies share t = (a + b) * THRESHOLD / (1 + THRESHOLD) shingles, so each lacks a - t, or b - t, of its own in
    the other. The set whose dealt shingles end first in the common order finds its shared ones among those dealt of
    the other. The bitmap hides a shingle only behind another one of the same set.
    """
    least = -(-(size_a + size_b) * THRESHOLD[0] // sum(THRESHOLD))
    dealt_a, dealt_b = _dealt_size(size_a), _dealt_size(size_b)
    needed = least + np.minimum(dealt_a - size_a, dealt_b - size_b)
    bits = lambda marks: np.bitwise_count(marks).sum(axis=1, dtype=np.int64)
    hidden = np.minimum(dealt_a - bits(marks_a), dealt_b - bits(marks_b))
    return bits(marks_a & marks_b) + hidden >= needed


def _at_most_shared(a: bytes, b: bytes) -> int:
    """What two sets may share by their counts: of a part no more than the smaller number. Finer parts are added up to coarser ones."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (v if len(v) == n else v.reshape(n, -1).sum(axis=1, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _coarse(counts) -> np.ndarray:
    """A row for each of the counts, with 2**LEAST_K parts. What a byte can't tell is 255, as then nothing is known of the set."""
    n = 1 << LEAST_K
    out = np.full((len(counts), n), 255, np.uint8)
    for i, x in enumerate(counts):
        if len(x) == n:
            out[i] = np.frombuffer(x, np.uint8)
        elif x:
            summed = np.frombuffer(x, np.uint8).reshape(n, -1).sum(axis=1, dtype=np.int64)
            if summed.max() < 256:
                out[i] = summed
    return out


def _left_open(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b: rows of parts, see _coarse) may be near copies by what their parts can share."""
    shared = np.empty(len(a), np.int64)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        shared[i : i + 4096] = np.minimum(parts[x], parts[y]).sum(axis=1, dtype=np.int64)
    unknown = (parts == 255).any(axis=1)
    least = np.minimum(size_a, size_b)
    return _enough(np.where(unknown[a] | unknown[b], least, np.minimum(shared, least)), size_a, size_b)


def _data(rows: DataFrame) -> DataFrame:
    return rows.select("at", F.coalesce("row.text", F.lit("")).cast("binary").alias("text"))


def _common(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, and their numbers there."""

    def run(batch):
        found = [shingles(x.as_py()) for x in batch.column("text")]
        yield {"hash": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)}

    sampled = _data(rows).where(F.pmod(F.xxhash64("at"), F.lit(max(total, 1))) < SAMPLE)
    often = map_batches(sampled.select("text"), run, "hash long").groupBy("hash").count().where(F.col("count") >= COMMON).toArrow()
    hashes = often.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], often.column("count").to_numpy()[order]


def _signs(rows: DataFrame, total: int) -> DataFrame:
    """at, set (a hash of the set), size (of the set), fp (the text's fingerprint), counts (see _counts), marks (see _marks) and hashes, the shingles that are dealt, in the common order."""
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, total))

    def run(batch):
        hashes, counts = common.value
        out: dict[str, list] = {k: [] for k in ("set", "size", "fp", "counts", "marks")}
        dealt: list[np.ndarray] = []
        for text in batch.column("text"):
            data = text.as_py()
            found = shingles(data)
            n = len(found)
            often = np.zeros(n, np.int64)
            if n and len(hashes):
                place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                often = np.where(hashes[place] == found, counts[place], 0)
            dealt.append(found[np.lexsort((found, often))[: _dealt_size(n)]])
            for k, v in zip(out, (_name(found), n, int(np.uint64(fingerprint(data, WIDTH)).view(np.int64)), _counts(found), _marks(dealt[-1])), strict=True):
                out[k].append(v)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in dealt]))).astype(np.int32)
        values = np.concatenate([np.empty(0, np.uint64), *dealt]).view(np.int64)
        yield out | {"at": batch.column("at"), "hashes": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    return map_batches(_data(rows), run, "at long, set long, size long, fp long, counts binary, marks binary, hashes array<long>")


def _enough(shared, size_a, size_b):
    """Whether sets of these sizes that share so many shingles are near copies: shared / (a + b - shared) >= THRESHOLD."""
    return shared * sum(THRESHOLD) >= (size_a + size_b) * THRESHOLD[0]


def _grouped(frame: DataFrame, made, schema: str, group: str) -> DataFrame:
    """made(columns but the first) for runs of whole groups. Rows are dealt by the first column and sorted by the first ones through the one after `group`. No group may be large."""
    ship_package(frame.sparkSession)
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = frame.columns
    at = names.index(group)

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            size += batch.num_rows
            if size >= 1 << 17:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                before = np.flatnonzero(columns[at] != columns[at][-1])
                cut = int(before[-1]) + 1 if len(before) else 0  # the last group may go on
                if cut:
                    yield from made(*[c[:cut] for c in columns[1:]])
                held = [[c[cut:] for c in columns]]
                size = len(columns[0]) - cut
        if size:
            yield from made(*[np.concatenate(c) for c in zip(*held, strict=True)][1:])

    return frame.repartition(n, names[0]).sortWithinPartitions(*names[: at + 2]).mapInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


SHARED = "hash long, node long, bulk long"


def _dealt(nodes: DataFrame) -> DataFrame:
    """hash, node and bulk: the size of the set and, in its low 32 bits, how many of its shingles come after this one."""
    each = nodes.select(F.col("at").alias("node"), "size", F.posexplode("hashes").alias("place", "hash"))
    return each.select("hash", "node", (F.shiftleft("size", 32) + F.col("size") - 1 - F.col("place")).alias("bulk"))


def _shared(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The dealt rows of shingles that two or more sets have.

    Shingles that many sets have are counted with map-side combining and told to the rows; for the others one shuffle does.
    """

    def made(hashes, node, bulk):
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        keep = np.diff(np.concatenate((np.flatnonzero(first), [len(hashes)])))[np.cumsum(first) - 1] > 1
        if keep.any():
            yield _batch(hash=hashes[keep], node=node[keep], bulk=bulk[keep])

    dealt = _dealt(nodes)
    bound = max(1, nodes.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0] // HEAVY * 2)
    common = scratch.table(perhaps_heavy(dealt, "hash", bound), "common")
    crowded = dealt.join(F.broadcast(common), "hash", "left_semi").groupBy("hash").count().where("count > 1").select("hash")
    crowded = scratch.table(crowded, "crowded")
    light = _grouped(dealt.join(F.broadcast(common), "hash", "left_anti").select(F.col("hash").alias("key"), "hash", "node", "bulk"), made, SHARED, "hash")
    return scratch.table(dealt.join(F.broadcast(crowded), "hash", "left_semi").select(light.columns).unionByName(light), "shared")


def _unlinked(shared: DataFrame, marks: DataFrame, scratch: Scratch, name: str, heads: int = 0) -> DataFrame:
    """a, b: pairs of sets with different labels that may be near copies by the shingles that both have.

    shared: hash, node, bulk, label; marks: node, marks, counts. A shingle's sets are cut into parts of CELL at most. With heads,
    each part is a cell, and about so many sets of the shingle, as far as possible the same for all shingles, go to all
    its cells and meet all sets there, so rows and pairs grow with the sets. Without, shingles of up to HEADS sets are left
    out, as all their sets were heads before, and each pair of parts meets in a cell of its own; there pairs grow with the
    square of a group that is alike, so those that the counts of both sets' parts rule out never become rows. Cells with one least set lie in one task, as they mostly hold the same pairs, which
    then leave it once.
    """

    def made(cell, label, node, bulk, head, marks, counts=None):
        size, rest = bulk >> 32, bulk & ((1 << 32) - 1)
        nodes, firsts = np.unique(node, return_index=True)
        sizes = size[firsts]
        parts = None if heads else _coarse(counts[firsts])
        bitmap = np.frombuffer(b"".join(marks), np.uint64).reshape(-1, MARKS)
        edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        if heads:
            partners = np.flatnonzero(head)
            begins, ends = (np.repeat(np.searchsorted(partners, x), np.diff(edges)) for x in (edges[:-1], edges[1:]))
        else:
            # rows are sorted by label inside a cell: a row's partners begin where its label ends
            partners, ends = np.arange(len(cell)), np.repeat(edges[1:], np.diff(edges))
            turns = np.flatnonzero(np.concatenate((label[1:] != label[:-1], [True])) | np.concatenate((cell[1:] != cell[:-1], [True]))) + 1
            begins = turns[np.searchsorted(turns, np.arange(len(cell)), side="right")]
        before = np.concatenate(([0], np.cumsum(ends - begins)))
        held, known = np.empty((0, 2), np.int64), np.empty(0, np.int64)  # pairs to give; all that were looked at, by their places among nodes
        for start in range(0, int(before[-1]), PAIRS):
            k = np.arange(start, min(start + PAIRS, int(before[-1])))
            x = np.searchsorted(before, k, side="right") - 1
            y = partners[begins[x] + k - before[x]]
            fits = (label[x] != label[y]) & _enough(1 + np.minimum(rest[x], rest[y]), size[x], size[y])
            x, y = x[fits], y[fits]
            fits = _may_share(bitmap[x], bitmap[y], size[x], size[y])
            a, b = (np.searchsorted(nodes, node[z[fits]]) for z in (x, y))
            new = np.setdiff1d(np.minimum(a, b) * len(nodes) + np.maximum(a, b), known)
            known = np.union1d(known, new)
            a, b = new // len(nodes), new % len(nodes)
            if parts is not None:
                fits = _left_open(a, b, sizes[a], sizes[b], parts)
                a, b = a[fits], b[fits]
            held = np.concatenate([held, np.stack([nodes[a], nodes[b]], axis=1)])
            if len(held) > PAIRS:
                yield _batch(a=held[:, 0], b=held[:, 1])
                held = held[:0]
            if len(known) > 4 * PAIRS:
                known = known[:0]
        if len(held):
            yield _batch(a=held[:, 0], b=held[:, 1])

    mixed = shared.groupBy("hash").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("least")).where("lo <> hi")
    mixed = scratch.table(mixed.select("hash", "n", "least", F.ceil(F.col("n") / CELL).cast("long").alias("parts")), f"mixed{name}")
    if not heads:
        mixed = mixed.where(F.col("n") > HEADS)
    open_ = split_join(shared, mixed, "hash", "n", shared.count()).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    open_ = open_.withColumn("head", F.shiftrightunsigned(F.xxhash64("node", F.lit("head")), 2) <= F.lit(float(heads << 62)) / F.col("n"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    if heads:
        open_ = open_.withColumn("other", F.explode(F.when(F.col("head"), every).otherwise(F.array("own")))).withColumn("cell", F.xxhash64("hash", "other"))
    else:
        open_ = open_.withColumn("other", F.explode(every)).withColumn("cell", F.xxhash64("hash", F.least("own", "other"), F.greatest("own", "other")))
    key = F.when(F.col("parts") > 1, F.col("cell")).otherwise(F.xxhash64("least"))
    told = ["marks"] if heads else ["marks", "counts"]
    return _grouped(open_.join(marks.select("node", *told), "node").select(key.alias("key"), "cell", "label", "node", "bulk", "head", *told), made, "a long, b long", "cell")


def _with(pairs: DataFrame, table: DataFrame, columns: list[str], side: str, bound: int) -> DataFrame:
    """pairs with columns of table (by at) for that side, named of_a and so on. What has over `bound` pairs, if any does (bound > 0), goes to several tasks."""
    copies = table.select(F.col("at").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    if not bound:
        return pairs.join(copies, side)
    often = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > bound).select(side, F.ceil(F.col("n") / bound).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    salted = pairs.join(often, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), parts)).drop("parts")
    copies = copies.join(often, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return salted.join(copies, [side, "salt"]).drop("salt")


def _crowd(pairs: DataFrame) -> int:
    """Pairs of one set beyond which it goes to several tasks, so that at most HEAVY sets do; 0 if none has so many."""
    bound = max(CROWD, pairs.count() // HEAVY)
    most = max((pairs.groupBy(x).count().agg(F.max("count")).first()[0] or 0 for x in "ab"), default=0)
    return bound if most > bound else 0


def _perhaps(pairs: DataFrame, signs: DataFrame, bound: int) -> DataFrame:
    """The pairs that the counts of their sets' parts leave open."""

    def run(batch):
        size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
        share = np.minimum(size_a, size_b)
        for i, (a, b) in enumerate(zip(batch.column("counts_a"), batch.column("counts_b"), strict=True)):
            if (a := a.as_py()) and (b := b.as_py()):
                share[i] = _at_most_shared(a, b)
        keep = _enough(share, size_a, size_b)
        yield {c: batch.column(c).to_numpy()[keep] for c in "ab"}

    with_both = _with(_with(pairs, signs, ["size", "counts"], "a", bound), signs, ["size", "counts"], "b", bound)
    return map_batches(with_both, run, "a long, b long")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _verified(pairs: DataFrame, rows: DataFrame, signs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b: keys of rows) whose sets are near copies, written. pairs: distinct, written."""

    def run(batch):
        yield {"at": batch.column("at"), "found": pa.array([shingles(x.as_py()).view(np.int64) for x in batch.column("text")], pa.list_(pa.int64()))}

    bound = _crowd(pairs)
    pairs = scratch.table(_perhaps(pairs, signs, bound), f"open{name}")
    wanted = pairs.select(F.col("a").alias("at")).distinct().unionByName(pairs.select(F.col("b").alias("at")).distinct()).distinct()
    wanted = scratch.table(wanted, f"wanted{name}")
    sets = scratch.table(map_batches(_data(chosen(rows, wanted, "left_semi")), run, "at long, found array<long>"), f"sets{name}")
    both = _with(_with(pairs, sets, ["found"], "a", bound), sets, ["found"], "b", bound)
    found = both.where(_enough(F.size(F.array_intersect("found_a", "found_b")), F.size("found_a"), F.size("found_b"))).select("a", "b")
    found = scratch.table(found, f"links{name}")
    scratch.discard(f"open{name}", f"wanted{name}", f"sets{name}")
    return found


def _labels(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the smallest linked set, or that one's, for all linked sets. Sets with one label are connected; it needn't hold the other way."""
    both = found.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("other")))
    label = scratch.table(both.groupBy("node").agg(F.min("other").alias("label")).withColumn("label", F.least("node", "label")), f"label{name}")
    up = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return scratch.table(look_up(label, up, "label").select("node", F.coalesce("next", "label").alias("label")), f"labels{name}")


def _tight(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b, written: pairs of sets that the SimHash index links, or that have one fingerprint. nodes: at, fp."""
    prints = scratch.table(nodes.groupBy("fp").agg(F.count("*").alias("m"), F.min("at").alias("first")), "prints")
    found = scratch.table(links(prints.select("fp"), scratch), "print_links")
    of_a, of_b = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"of_{x}")) for x in "ab")
    across = found.join(of_a, "a").join(of_b, "b").select(*_ordered("of_a", "of_b"))
    crowds = scratch.table(prints.where("m > 1"), "crowds")
    within = split_join(nodes, crowds, "fp", "m", nodes.count()).where("at <> first").select(*_ordered("at", "first"))
    return scratch.table(across.unionByName(within).distinct(), "tight")


def similar_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """at, component of each numbered row: equal for rows that a chain of near copies connects."""
    signs = scratch.table(_signs(rows, rows.count()), "signs")
    # rows with one set: the first stands for all
    equal = scratch.table(signs.groupBy("set").agg(F.count("*").alias("n"), F.min("at").alias("node")).where("n > 1"), "equal")
    copies = scratch.table(split_join(signs.select("set", "at"), equal, "set", "n", signs.count()).where("at <> node").select("at", "node"), "copies")
    nodes = chosen(signs, copies.select("at"), "left_anti")

    tight = _tight(nodes.select("at", "fp"), scratch)
    linked = _verified(tight, rows, signs, scratch, "0")

    shared, looked_at = _shared(nodes, scratch), tight
    marks = nodes.select(F.col("at").alias("node"), "marks", "counts")
    for name, heads in (("1", HEADS), ("2", 0)):
        # whole components before all pairs are looked at
        label = _labels(linked, scratch, name) if heads else scratch.table(components(linked).withColumnRenamed("component", "label"), "components")
        labelled = look_up(shared, label, "node").withColumn("label", F.coalesce("label", "node"))
        met = _unlinked(labelled, marks, scratch, name, heads).distinct().join(looked_at, ["a", "b"], "left_anti")
        pairs = scratch.table(met, f"pairs{name}")
        looked_at = looked_at.unionByName(pairs)
        # the labels of whole components stand for the links so far, those of the first round don't
        so_far = linked if heads else label.select(F.col("node").alias("a"), F.col("label").alias("b"))
        linked = _verified(pairs, rows, signs, scratch, name).unionByName(so_far)
    scratch.discard("shared")

    parts = components(linked).select(F.col("node").alias("at"), "component")
    alone = chosen(signs.select("at"), scratch.table(parts.select("at").unionByName(copies.select("at")), "placed"), "left_anti")
    of_copies = look_up(copies, scratch.table(parts.withColumnRenamed("at", "node"), "parts"), "node").select("at", F.coalesce("component", "node").alias("component"))
    return parts.unionByName(alone.select("at", F.col("at").alias("component"))).unionByName(of_copies)


def drop_similar(docs: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id (null last) of each group of near copies, with all columns of docs.

    Null, empty and blank texts are one group. A text of fewer than WIDTH words is one shingle. Very long texts are cut
    into words block by block. Rows without an id, or that repeat one, are told apart by a written key. Columns may
    have any names. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = numbered(docs, scratch)
    return one_of_each(rows, similar_groups(rows, scratch), scratch)
