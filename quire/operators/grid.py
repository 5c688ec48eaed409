"""Cells of tables in their grid: columns under spans, merges down the rows, edges, widths.

Cells come as rows with the keys of their table, their row, their place in it, a span (columns) and a merge: null,
`restart` (the first of a merge down) or anything else (goes on with the merge above, if one covers its column).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.plans.session import ship_package, spread


class Placer:
    """Walks the cells of one table in order. Its state is what reaches down from the row above: one entry for each merge."""

    def __init__(self) -> None:
        self.row, self.column = None, 0
        self.above: list[tuple[int, int, int]] = []  # first column, columns, number of the cell that began the merge
        self.below: list[tuple[int, int, int]] = []

    def place(self, row: int, number: int, span: int, merge: str | None) -> tuple[int, int | None]:
        """The cell's first column, and the number of the cell that it continues."""
        if row != self.row:
            self.row, self.column = row, 0
            self.above, self.below = self.below, []
        at = self.column
        covering = next((m for m in self.above if m[0] <= at < m[0] + m[1]), None)
        if merge not in (None, "restart") and covering:
            self.below.append(covering)
            self.column = at + max(covering[1], span)
            return at, covering[2]
        if covering:
            self.above = [m for m in self.above if not m[0] <= at < m[0] + m[1]]
        if merge == "restart":
            self.below.append((at, span, number))
        self.column = at + span
        return at, None


def place_cells(cells: DataFrame, keys: list[str], row: str, place: str, span: str, merge: str) -> DataFrame:
    """cells with column_index (long, from 0), origin_row and origin_place (of the cell that a hidden cell continues, else null), hidden, row_span and visible_index.

    A column depends on the spans before it in its row and on the merges of the row above, which may be wider than the
    cells that go on with them. So tables are walked cell by cell, sorted, with a state of a few merges and no table
    held; cells move once, whole, and nothing is joined. A cell that goes on with a merge that isn't there is a cell of its
    own. row_span counts a cell and those that continue it; it is known at the merge's end, so a second walk over the same
    partition goes backwards, holding a count for each open merge. Hidden cells have none. Spans under 0 count as 0, a null
    span as 1; rows that repeat a place are walked in any order, cells without a row or place are left out.
    """
    ship_package(cells.sparkSession)
    own = cells.columns
    known = cells.where(F.col(row).isNotNull() & F.col(place).isNotNull())
    slim = known.withColumns({"_row": F.col(row).cast("long"), "_place": F.col(place).cast("long"), "_span": F.greatest(F.coalesce(F.col(span).cast("long"), F.lit(1)), F.lit(0)), "_merge": F.col(merge).cast("string")})
    read = [*keys, "_row", "_place", "_span", "_merge"]
    added = [("column_index", "long"), ("origin_row", "long"), ("origin_place", "long")]

    def extended(df: DataFrame, fields: list[tuple[str, str]]) -> StructType:
        return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, placer = None, Placer()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in read]
            found: list[list] = [[], [], []]
            for *key, at_row, at_place, wide, kind in zip(*columns, strict=True):
                if key != table:
                    table, placer = key, Placer()
                column, origin = placer.place(at_row, (at_row, at_place), wide, kind)
                for held, value in zip(found, (column, *(origin or (None, None))), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*batch.schema.names, *(n for n, _ in added)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, open_ = None, {}  # cells seen so far of each merge, by the cell that began it
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "_row", "_place", "origin_row", "origin_place")]
            spans: list[int | None] = []
            for *key, at_row, at_place, from_row, from_place in zip(*columns, strict=True):
                if key != table:
                    table, open_ = key, {}
                if from_row is None:
                    spans.append(1 + open_.pop((at_row, at_place), 0))
                else:
                    began = (from_row, from_place)
                    open_[began] = open_.get(began, 0) + 1
                    spans.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.int64())], names=[*batch.schema.names, "row_span"])

    placed = spread(slim, *keys).sortWithinPartitions(*keys, "_row", "_place")
    placed = placed.mapInArrow(walk, extended(placed, added))
    # neither step moves rows, so a table still lies in one partition
    placed = placed.sortWithinPartitions(*keys, F.desc("_row"), F.desc("_place"))
    placed = placed.mapInArrow(count, extended(placed, [("row_span", "long")]))
    return placed.select(*keys, *[c for c in own if c not in keys], "column_index", "origin_row", "origin_place", F.col("origin_row").isNotNull().alias("hidden"), "row_span")


def place_in_order(cells: DataFrame, document: str, table: str, row: str, place: str, span: str, merge: str) -> DataFrame:
    """place_cells() of cells that lie as sources.package.cells() gives them, with table_no, the number of a table among its document's.

    A document's cells follow each other in reading order, so they are walked where they are: nothing is moved or sorted.
    Tables inside cells come between the cells of theirs, so each of a document's tables has a state of its own. Row spans
    are counted once a document is at its end, until when its cells are held; a document was held whole as it was read, too.
    """
    ship_package(cells.sparkSession)
    own = cells.columns
    slim = cells.withColumns({"_row": F.col(row).cast("long"), "_place": F.col(place).cast("long"), "_span": F.greatest(F.coalesce(F.col(span).cast("long"), F.lit(1)), F.lit(0)), "_merge": F.col(merge).cast("string")})
    added = [("table_no", "long"), ("column_index", "long"), ("origin_row", "long"), ("origin_place", "long")]
    walked = StructType([*slim.schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in added)).fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, placers = None, {}
        for batch in batches:
            found: list[tuple] = []
            for of, at_table, at_row, at_place, wide, kind in zip(*(batch.column(c).to_pylist() for c in (document, table, "_row", "_place", "_span", "_merge")), strict=True):
                if of != name:
                    name, placers = of, {}
                if (known := placers.get(at_table)) is None:
                    known = placers[at_table] = (len(placers) + 1, Placer())
                column, origin = known[1].place(at_row, (at_row, at_place), wide, kind)
                found.append((known[0], column, *(origin or (None, None))))
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=[*batch.schema.names, *(n for n, _ in added)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the document that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(document).to_pylist()
            begin = len(names) - 1
            while begin and names[begin - 1] == names[-1]:
                begin -= 1
            if begin or held and held[-1].column(document)[0].as_py() != names[0]:
                yield from counted([*held, batch.slice(0, begin)])
                held = []
            held.append(batch.slice(begin))
        yield from counted(held)

    def counted(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[tuple, int] = {}  # cells that go on with each merge, by the cell that began it
        columns = [[batch.column(c).to_pylist() for c in (document, table, "_row", "_place", "origin_row", "origin_place")] for batch in some]
        for of, tables, _, _, rows, places in columns:
            for began in zip(of, tables, rows, places, strict=True):
                if began[2] is not None:
                    more[began] = more.get(began, 0) + 1
        for batch, (of, tables, rows, places, origins, _) in zip(some, columns, strict=True):
            spans = [None if origin is not None else 1 + more.get(cell, 0) for origin, cell in zip(origins, zip(of, tables, rows, places, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.int64())], names=[*batch.schema.names, "row_span"])

    placed = slim.mapInArrow(walk, walked)
    placed = placed.mapInArrow(count, StructType([*walked.fields, *StructType.fromDDL("row_span long").fields]))
    return placed.select(*own, "table_no", "column_index", "origin_row", "origin_place", F.col("origin_row").isNotNull().alias("hidden"), "row_span")


def edge(column: str, table: str, at_edge: Column, outer: str, inner: str) -> Column:
    """A cell's border on one side: its own, else the table's, the outer one at the table's edge and the inner one elsewhere."""
    return F.coalesce(F.col(column), F.when(at_edge, F.col(f"{table}.{outer}")).otherwise(F.col(f"{table}.{inner}")))
