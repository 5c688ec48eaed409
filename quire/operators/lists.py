"""Nested lists from blocks in order.

A list paragraph has a level and a key; it lies in the item of the nearest earlier list paragraph of a lower level, and
is in one list with the item before it of the same level and key if no lower level lies between. Blocks that neither
are list paragraphs nor attach to an item (tables do) end all lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels_of(blocks: DataFrame, level: str) -> list[int]:
    """The levels that occur, 256 at most."""
    return sorted(r[0] for r in blocks.where(f"{level} IS NOT NULL").select(F.col(level).cast("int").alias("level")).distinct().collect())


def nest(blocks: DataFrame, keys: list[str], order: str, level: str, key: str, attaches: str, levels: list[int] | None = None) -> DataFrame:
    """blocks with run, parent_at, list_at, root_at, item_end, new_list and last_item, all null outside lists.

    order (long) tells blocks apart within keys; level is null where a block is no list paragraph; attaches is true for
    blocks that belong to the item before them. run numbers the stretches of list blocks. parent_at is the order of the
    item that a block lies in (of an attached block: the list paragraph before it), list_at that of the first item of
    its list, root_at that of the first item of the outermost list, item_end that of the first block of the run after
    the item and all in it (null: the item ends with the run). new_list and last_item mark the ends of a list.

    The nearest earlier smaller value comes from running last places, one for each level that occurs (there are 256
    levels at most; `levels` names them where they are known), so it is one pass of window functions over blocks in order,
    however deep lists nest.
    """
    levels = levels_of(blocks, level) if levels is None else levels
    ordered = Window.partitionBy(*keys).orderBy(order)
    until, after = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    at, own = F.col(order), F.col(level).cast("int")
    # a block that is no list paragraph and doesn't attach, or attaches to nothing, ends a run
    listed = own.isNotNull()
    breaks = ~listed & ~F.coalesce(F.col(attaches), F.lit(False))
    marked = blocks.withColumn("_breaks", F.sum(breaks.cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    started = F.max(F.when(listed, at)).over(Window.partitionBy(*keys, "_breaks").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_started", started).withColumn("run", F.when(F.col("_started").isNotNull() & ~breaks, F.col("_breaks")))
    within = Window.partitionBy(*keys, "run").orderBy(order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)

    none = F.lit(None).cast("long")
    past = {x: F.col(f"_past{i}") for i, x in enumerate(levels)}
    next_ = {x: F.col(f"_next{i}") for i, x in enumerate(levels)}
    marked = marked.withColumns({f"_past{i}": F.max(F.when(own == x, at)).over(before) for i, x in enumerate(levels)} | {f"_next{i}": F.min(F.when(own == x, at)).over(after) for i, x in enumerate(levels)})
    marked = marked.withColumns({f"_key{i}": F.max_by(F.col(key), F.when(own == x, at)).over(before) for i, x in enumerate(levels)} | {f"_after{i}": F.min_by(F.col(key), F.when(own == x, at)).over(after) for i, x in enumerate(levels)})
    latest = lambda chosen: F.greatest(*[F.when(chosen(x), c) for x, c in past.items()], none, none)
    soonest = lambda chosen: F.least(*[F.when(chosen(x), c) for x, c in next_.items()], none, none)
    same = lambda prefix, kind: F.coalesce(*[F.when(own == x, F.col(f"{prefix}{i}")) for i, x in enumerate(levels)], F.lit(None).cast(kind))
    kind = dict(blocks.dtypes)[key]

    marked = marked.withColumns({"_lower": latest(lambda x: own > x), "_lower_next": soonest(lambda x: own > x), "item_end": F.when(listed, soonest(lambda x: own >= x)), "_same": same("_past", "long"), "_same_next": same("_next", "long"), "_key": same("_key", kind), "_after": same("_after", kind)})
    joins = F.col("_same").isNotNull() & (F.col("_lower").isNull() | (F.col("_same") > F.col("_lower"))) & F.col("_key").eqNullSafe(F.col(key))
    joined = F.col("_same_next").isNotNull() & (F.col("_lower_next").isNull() | (F.col("_same_next") < F.col("_lower_next"))) & F.col("_after").eqNullSafe(F.col(key))
    marked = marked.withColumns({"new_list": F.when(listed, ~joins), "last_item": F.when(listed, ~joined), "parent_at": F.when(listed, F.col("_lower")).when(F.col("run").isNotNull(), F.col("_started"))})
    # the first item of a block's list: the last start of a list at its level; of the outermost list: the last start without a parent
    starts = {f"_list{i}": F.max(F.when((own == x) & F.col("new_list"), at)).over(within.rowsBetween(Window.unboundedPreceding, 0)) for i, x in enumerate(levels)}
    marked = marked.withColumns(starts)
    root = F.max(F.when(F.col("new_list") & F.col("parent_at").isNull(), at)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumns({"list_at": same("_list", "long"), "root_at": F.when(F.col("run").isNotNull(), root)})
    return marked.select(*blocks.columns, "run", "parent_at", "list_at", "root_at", "item_end", "new_list", "last_item")


def written(nested: DataFrame, keys: list[str], order: str, text: str, opening: Column, item_open: str = "  [", item_close: str = "],\n", closing: str = ")", separator: str = "\n\n") -> DataFrame:
    """keys, root_at, markup: each outermost list as text, from the rows of nest() and the texts of their blocks.

    No list is put together from its inner ones: each item tells what opens at its place and what closes after its last
    block, and these strings join in order, inner ends first. opening: what begins the list that a new_list row starts.
    """
    rows = nested.where("run IS NOT NULL")
    ordered = Window.partitionBy(*keys, "run").orderBy(order)
    listed = F.col("new_list").isNotNull()
    own = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumn("_before", F.lag(F.struct(F.col(order).alias("at"), own.alias("text"), listed.alias("listed"))).over(ordered))
    before = F.col("_before")
    # something stands before a block in its item unless that item's own empty text comes right before it
    follows = F.col("parent_at").isNotNull() & ~((before["at"] == F.col("parent_at")) & before["listed"] & (before["text"] == ""))
    apart = F.when(follows & (F.col("new_list") | ~listed & (own != "")), separator).otherwise("")
    opened = F.concat(apart, F.when(F.col("new_list"), opening).otherwise(""), F.when(listed, item_open).otherwise(""), own)
    closed = F.concat(F.lit(item_close), F.when(F.col("last_item"), closing).otherwise(""))
    last = F.lit((1 << 63) - 1)
    event = lambda place, kind, depth, said: F.struct(place.alias("place"), F.lit(kind).alias("kind"), depth.alias("depth"), said.alias("said"))
    events = F.array(event(F.col(order), 1, F.lit(0).cast("long"), opened), F.when(listed, event(F.coalesce("item_end", last), 0, -F.col(order), closed)))
    told = rows.select(*keys, "root_at", F.explode(F.array_compact(events)).alias("e"))
    return told.groupBy(*keys, "root_at").agg(F.array_sort(F.collect_list("e")).alias("_e")).select(*keys, "root_at", F.array_join(F.transform("_e", lambda x: x["said"]), "").alias("markup"))
