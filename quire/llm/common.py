"""What the operators of this subpackage share: scratch tables, skew-safe joins, global ranks, text passes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.session import ship_package

#: ASCII white space, the only separators between words.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as a Java or RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: The end of a word.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Counters of a sketch, and how many groups sketches are merged in before one task merges those.
TRACKED, MERGERS = 8192, 64
#: A group is heavy when it holds over 1/HEAVY of all rows, so there are at most HEAVY heavy groups.
HEAVY = 4096


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Where it is unset, local sessions get a folder of their own and others an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if kept := spark.sparkContext.getCheckpointDir():
        return kept
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Written tables of one operator call: they cut the lineage and survive the loss of an executor.

    The operator's result reads them, so they stay until its caller has used it: released() or the end of the driver
    program deletes them.
    """

    open: dict[str, Scratch] = {}

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/quire-{name}-{uuid.uuid4().hex}"
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.jvm = spark.sparkContext._jvm
        if not Scratch.open:
            atexit.register(clear, ())
        Scratch.open[self.root] = self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns the written rows."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def discard(self, *names: str) -> None:
        """Deletes tables that no later result reads."""
        for name in names:
            path = self.jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.hadoop).delete(path, True)


def clear(keep: Collection[str]) -> None:
    """Deletes all scratch tables but those under the roots to keep."""
    for root in [x for x in Scratch.open if x not in keep]:
        with suppress(Exception):  # at the end of the program its JVM may be gone already
            Scratch.open.pop(root).discard("")


@contextmanager
def released() -> Iterator[None]:
    """At its end deletes the scratch tables of all operators called inside: their results must have been written by then."""
    before = set(Scratch.open)
    try:
        yield
    finally:
        clear(before)


def packed(docs: DataFrame):
    """All columns of docs as one struct, so that no helper column clashes with theirs; `select("row.*")` restores them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


#: Keys of dropped rows that are broadcast at most, some 32 MB; and groups that are broadcast whole.
FEW_KEYS, FEW_GROUPS = 1 << 20, 1 << 14


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """row (all columns of docs) and at, a key of the row, written: ids may be null or repeat."""
    return scratch.table(docs.select(packed(docs), F.monotonically_increasing_id().alias("at")), "numbered")


def chosen(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The numbered rows whose `at` is among keys (how: left_semi) or isn't (left_anti). keys: at, distinct, written.

    Up to FEW_KEYS keys go to the rows, which stay where they lie; more meet them in a shuffle.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, "at", how)


def perhaps_heavy(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """key (long): at most 2 * rows / bound keys, among them all with over bound rows, by mergeable frequent-items sketches of the Misra-Gries family.

    A sketch is off by rows / (0.75 * TRACKED) at most, so bound must be above twice that.
    """
    sketches = rows.groupBy((F.spark_partition_id() % MERGERS).alias("merger")).agg(F.expr(f"approx_top_k_accumulate({key}, {TRACKED})").alias("sketch"))
    # grouped by a constant: a global aggregate would also merge the null sketches of empty partitions, which fails
    merged = sketches.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {TRACKED})")).alias("x"))
    return found.where(F.col("x.count") * 2 > bound).select(F.col("x.item").alias(key))


def look_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join with what was found for some keys, one written row each, that goes to the rows where FEW_KEYS allows it."""
    return rows.join(F.broadcast(found) if found.count() <= FEW_KEYS else found, key, "left")


def group_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """split_join for wide rows: up to FEW_GROUPS written groups are broadcast whole, so the rows are read once."""
    if groups.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), key)
    return split_join(rows, groups, key, size, total)


def split_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups, which has one row per key and the key's number of rows in `size`.

    Keys with over total/HEAVY rows, at most HEAVY of them, are broadcast and joined where their rows lie; the rest
    meet in an ordinary shuffle, where no key has more than total/HEAVY rows. `total`: the sum of `size`.
    """
    bound = max(1, total // HEAVY)
    heavy = groups.where(F.col(size) > bound)
    light = groups.where(F.col(size) <= bound)
    near = rows.join(F.broadcast(heavy), key)
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return near.unionByName(far)


def global_rank(scratch: Scratch, df: DataFrame, keys: list, name: str) -> DataFrame:
    """Adds `rank` (long, gapless from 0) in the order of keys, without one task that sees all rows.

    Rows are dealt by ranges of the keys, sorted inside each range and written with their place in the range; the
    ranges' row counts, one small row for each, give the rest.
    """
    spark = scratch.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(placed, name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumns({"_part": part, "_place": place}).transform(lambda x: _ranked(spark, x))


def _ranked(spark: SparkSession, placed: DataFrame) -> DataFrame:
    before, offsets = 0, []
    for row in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((row["_part"], before))
        before += row["count"]
    starts = spark.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "_at")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """fn makes from each Arrow batch columns by name; lists, numpy or Arrow arrays."""
    ship_package(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for made in fn(batch):
                yield pa.RecordBatch.from_arrays([_array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def word_blocks(data: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, those of some `most` bytes at a time, so that no list holds a very long text."""
    at = 0
    while at < len(data):
        end = at + most
        if end < len(data):
            end = found.start() if (found := _SPACE.search(data, end)) else len(data)
        if words := (data if at == 0 and end >= len(data) else data[at:end]).split():
            yield words
        at = end


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of the batch with about `most` bytes of the column each, so that what is held in Python stays bounded."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
