"""Numbers by first use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_use_numbers(uses: DataFrame, keys: list[str], order: str, what: str, name: str = "number") -> DataFrame:
    """uses with a number from 1: how many things were used for the first time, within keys, up to the first use of this one.

    what names the thing; a use with a null there is a thing of its own. So media that several places show get one number,
    placeholders one each, both from one count. order tells uses apart within keys. First uses are found by grouping and
    counted in order; a thing that is used everywhere is one row of that count.
    """
    thing = F.coalesce(F.struct(F.col(what).alias("of"), F.when(F.col(what).isNull(), F.col(order)).alias("at")))
    named = uses.withColumn("_thing", thing)
    first = named.groupBy(*keys, "_thing").agg(F.min(order).alias("_first"))
    count = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")).cast("long")
    numbered = first.withColumn(name, count).drop("_first")
    ours, theirs = named.alias("a"), numbered.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_thing"]]
    joined = ours.join(theirs, [*same])
    return joined.select(*[F.col(f"a.`{c}`") for c in uses.columns], F.col(f"b.{name}"))
