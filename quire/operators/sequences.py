"""Operators on ordered rows: runs of equal neighbours, running state, counters, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_runs(df: DataFrame, keys: list[str], order: list[str], same: list[str], name: str = "run") -> DataFrame:
    """Numbers, from 1, the runs of neighbouring rows that agree in all columns of `same`; nulls agree with nulls."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(ordered) == 1
    changed = first
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(ordered))
    return df.withColumn("_changed", changed.cast("int")).withColumn(name, F.sum("_changed").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def running_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def coming_first(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The first value that isn't null from each row on: a forward as-of join, where the rows that bring values lie among the others."""
    return df.withColumn(name, F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)))


def earlier_count(df: DataFrame, keys: list[str], order: list[str], event: Column, name: str, start: int = 1) -> DataFrame:
    """`start` plus the number of earlier rows with the event."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.lit(start) + F.coalesce(F.sum(event.cast("int")).over(before), F.lit(0)))


def offsets(df: DataFrame, keys: list[str], order: list[str], span: str, name: str) -> DataFrame:
    """The sum of the spans before each row."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(span).over(before), F.lit(0)))


def first_by(df: DataFrame, keys: list[Column], order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its first row."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*[F.col(k) for k in _names(df, keys)], "_v.*")


def last_by(df: DataFrame, keys: list[Column], order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its last row: later entries win."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*[F.col(k) for k in _names(df, keys)], "_v.*")


def _names(df: DataFrame, keys: list) -> list[str]:
    return [k if isinstance(k, str) else df.select(k).columns[0] for k in keys]


def joined_blocks(df: DataFrame, keys: list[str], order: list[str], text: Column, name: str, separator: str = "\n\n") -> DataFrame:
    """Blocks in order, without white space at their ends, empty ones left out, joined."""
    from quire.functions.text import trim_end

    block = trim_end(text)
    kept = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(block != "", F.struct(*order, block.alias("_block"))))).alias("_blocks"))
    return kept.select(*keys, F.array_join(F.transform("_blocks", lambda b: b["_block"]), separator).alias(name))
