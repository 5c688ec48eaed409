"""Tables: bands, column widths, heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(index: Column, size: Column) -> Column:
    """0 or 1 in turns of `size` rows or columns, 1 at least."""
    return (F.floor(index / F.greatest(size, F.lit(1))) % 2).cast("int")


def column_widths(cells: DataFrame, keys: list[str], column: str, span: str, width: str) -> DataFrame:
    """keys, slot, width: each cell shares its width among the columns it spans, the rest to the last; the widest share wins.

    Slots are no keys of an aggregate, which would hold those of all tables in a task: a table's shares are gathered and
    sorted in its own row.
    """
    n = F.greatest(F.col(span), F.lit(1))
    offsets = F.sequence(F.lit(0), n.cast("int") - 1)
    share = lambda o: (F.floor(F.col(width) / n) + F.when(o == n - 1, F.col(width) % n).otherwise(0)).cast("long")
    own = F.transform(offsets, lambda o: F.struct((F.col(column) + o).alias("slot"), share(o).alias("width")))
    tables = cells.where(F.col(width).isNotNull()).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(own))).alias("_shares"))
    # in the order of slots and widths, the last share of a slot is the widest
    last = F.filter("_shares", lambda x, i: ~F.get("_shares", i + 1)["slot"].eqNullSafe(x["slot"]))
    return tables.select(*keys, F.explode(last).alias("_share")).select(*keys, "_share.slot", "_share.width")


def characters_in_line(width_twips: Column, half_points: Column) -> Column:
    """Characters that fit in a line: the width in points over 0.55 of the font size, 1 at least; null without width or size."""
    f = lambda x: x.cast("float")
    size = F.greatest(f(f(f(half_points) / 2) * f(F.lit(0.55))), f(F.lit(1.0)))
    fit = F.greatest(F.floor(f(f(f(width_twips) / 20) / size)), F.lit(1)).cast("long")
    return F.when((width_twips > 0) & (half_points > 0), fit)


def line_count(text: Column, in_line: Column) -> Column:
    """Lines that a text takes: each of its lines counts its trimmed characters, 1 at least."""
    from quire.functions.text import trim_space

    lengths = F.transform(F.split(text, "\n"), lambda line: F.greatest(F.char_length(trim_space(line)), F.lit(1)).cast("long"))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda sum_, n: sum_ + F.ceil(n / in_line).cast("long"))
