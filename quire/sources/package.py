"""Packages as tables: parts, content types, relationships and markup nodes.

A package table has doc_id and content, the bytes of one package a row. Nothing is lost in silence: a package that can't
be opened gives one row with its doc_id and error, a part that can't be read one with its part and error too; all other
rows have a null error. max_package_bytes lifts or lowers the bound on what a package may unpack to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import resolve_target
from quire.operators.office import MOST_BYTES, BadPackage, Package, W, local
from quire.operators.tree import within  # noqa: F401  callers find it beside nodes()
from quire.plans.session import ship_package
from quire.sources import build as B

PARTS = "doc_id string, part string, content binary, content_type string, error string"
NODES = "doc_id string, part string, node_id long, end_id long, parent_id long, ord int, depth int, tag string, ns string, attrs map<string, string>, text string, tail string, path string, error string, above array<struct<node_id: long, tag: string>>"
RELATIONS = "doc_id string, source_part string, ord int, rel_id string, kind string, target string, target_mode string, error string"


#: Rows, or bytes of packages, whose rows go on together.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2000, 8 << 20
#: The same for nodes, which come by column.
NODES_AT_ONCE = 4000
#: Digests that a task keeps.
MOST_DIGESTS = 1 << 14
#: What the cells of tables lie in.
BLOCKS = frozenset(("document", "body", "tbl", "tr", "tc"))
CELLS = "doc_id string, tbl long, row long, place long, span string, merge string, error string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or pattern, named by their path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def contents(packages: DataFrame | B.Built) -> tuple[DataFrame, Callable]:
    """The rows to hand to Python, and what gives doc_id and bytes of the packages of a batch there, one by one."""
    if isinstance(packages, B.Built):
        make = packages.make
        rows, of = B.named(packages.rows), lambda batch: B.packages_of(batch, make)
    else:
        rows, of = packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content"), _stored
    ship_package(rows.sparkSession)
    return rows, of


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for doc_id, content in zip(batch.column("doc_id"), batch.column("content"), strict=True):
        yield doc_id.as_py(), content.as_py() or b""


def doc_ids(packages: DataFrame | B.Built) -> DataFrame:
    """The names of all packages, without their contents."""
    return B.named(packages.rows).select("doc_id") if isinstance(packages, B.Built) else packages.select(F.col("doc_id").cast("string").alias("doc_id"))


def by_document(packages: DataFrame | B.Built, fn, schema: str) -> DataFrame:
    """fn(doc_id, bytes) gives rows as dictionaries; one narrow pass, document by document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    given, of = contents(packages)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for doc_id, data in of(batch):
                for row in fn(doc_id, data):
                    rows.append(row)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows, held = [], 0
                held += len(data)
                if held >= BYTES_AT_ONCE and rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return given.mapInArrow(run, schema)


def opened(doc_id: str, content: bytes, most: int | None) -> tuple[Package | None, dict | None]:
    """The package, or the row that tells what is wrong with it."""
    try:
        return Package(content, most or MOST_BYTES), None
    except Exception as e:  # whatever it holds, a package must not end the job
        return None, {"doc_id": doc_id, "error": str(e) if isinstance(e, BadPackage) else f"{type(e).__name__}: {e}"}


def parts(packages: DataFrame | B.Built, only: tuple[str, ...] | None = None, max_package_bytes: int | None = None) -> DataFrame:
    """doc_id, part, content, content_type, error, checksum. only: the parts to give."""

    def unzip(doc_id, content):
        package, wrong = opened(doc_id, content, max_package_bytes)
        if wrong:
            yield wrong
            return
        for name, data in sorted(package.parts.items()):
            if only is None or name in only:
                yield {"doc_id": doc_id, "part": name, "content": data, "content_type": package.content_type(name)}

    return by_document(packages, unzip, PARTS).withColumn("checksum", F.sha2("content", 256))


def content_types(parts: DataFrame, types: DataFrame) -> DataFrame:
    """parts with content_type: that of the part's name, else that of its extension (case matters), else null."""
    exact = types.select("doc_id", F.col("key").alias("part"), F.col("content_type").alias("_exact"))
    by_end = types.select("doc_id", F.col("key").alias("_end"), F.col("content_type").alias("_default"))
    keyed = parts.drop("content_type").withColumn("_end", F.regexp_extract("part", r"(\.[^./]*)$", 1))
    joined = keyed.join(exact, ["doc_id", "part"], "left").join(by_end, ["doc_id", "_end"], "left")
    return joined.withColumn("content_type", F.coalesce("_exact", "_default")).drop("_exact", "_default", "_end")


def relationships(packages: DataFrame | B.Built, max_package_bytes: int | None = None) -> DataFrame:
    """doc_id, source_part, ord, rel_id, kind, target, target_mode, error, resolved_target."""

    def found(doc_id, content):
        package, wrong = opened(doc_id, content, max_package_bytes)
        if wrong:
            yield wrong
            return
        for part in ("", *sorted(package.parts)):
            try:
                listed = package.relations(part)
            except BadPackage as e:
                yield {"doc_id": doc_id, "source_part": part, "error": str(e)}
                continue
            for i, x in enumerate(listed):
                yield {"doc_id": doc_id, "source_part": part, "ord": i, "rel_id": x["id"], "kind": x["kind"], "target": x["target"], "target_mode": x["mode"]}

    return by_document(packages, found, RELATIONS).withColumn("resolved_target", resolve_target(F.col("source_part"), F.col("target"), F.col("target_mode")))


def nodes(packages: DataFrame | B.Built, only: tuple[str, ...] | None = None, max_package_bytes: int | None = None, tags: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, once: tuple[str, ...] = ()) -> DataFrame:
    """The elements of all markup parts in reading order. Those below a node are the ones from node_id to end_id; `above` has the nodes that it lies in, from the root down.

    only: the parts to give; tags: the elements to give, which keep the numbers that they have among all; columns: those to
    give. What isn't asked for isn't made, as it can't be left out once it comes from Python. once: parts that many packages
    may have alike. They bring a column `digest`, the SHA-256 of their bytes; all their nodes come with some of the packages
    that have the same, at least one, and with the others their root alone, whatever its tag.
    """
    from pyspark.sql.types import StructType

    given, of = contents(packages)
    schema = StructType.fromDDL(NODES)
    schema = StructType([f for f in schema if columns is None or f.name in columns])
    if once:
        schema = schema.add("digest", "string")
    names, kept = schema.names, None if tags is None else frozenset(tags)

    def run(batches):
        given_: set[str] = set()  # digests of parts that this task gave whole
        for batch in batches:
            found, held = NodeColumns(names), 0
            for name, data in of(batch):
                package, wrong = opened(name, data, max_package_bytes)
                if wrong:
                    found.add_error(name, None, wrong["error"])
                else:
                    for part in sorted(package.parts):
                        if only is not None and part not in only or not part.endswith((".xml", ".rels")):
                            continue
                        try:
                            tree = package.xml(part)
                        except BadPackage as e:
                            found.add_error(name, part, str(e))
                            continue
                        found.digest, wanted = None, kept
                        if part in once:
                            found.digest = hashlib.sha256(package.parts[part]).hexdigest()
                            if found.digest in given_:
                                tree = ET.Element(tree.tag, tree.attrib)
                            elif len(given_) < MOST_DIGESTS:
                                given_.add(found.digest)
                            wanted = kept if kept is None else kept | {local(tree)}
                        for _ in found.add_tree(name, part, tree, wanted):
                            yield found.taken()
                held += len(data)
                if held >= BYTES_AT_ONCE or found.size >= NODES_AT_ONCE:
                    yield found.taken()
                    held = 0
            if found.size:
                yield found.taken()

    return given.mapInArrow(run, schema)


def cells(packages: DataFrame | B.Built, part: str, max_package_bytes: int | None = None) -> DataFrame:
    """The cells of a part's tables as they are set, a row for each: number of the table's node, row and place from 1, span and merge as written.

    Cells of a package come in one partition, one after the other in reading order, those of nested tables after the cell
    that they lie in; grid.place_in_order() goes on from there without a shuffle.
    """
    given, of = contents(packages)

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for name, data in of(batch):
                package, wrong = opened(name, data, max_package_bytes)
                try:
                    if wrong:
                        found.append((name, *[None] * 5, wrong["error"]))
                    elif part in package.parts:
                        found += [(name, *cell, None) for cell in cells_of(package.xml(part))]
                except BadPackage as e:
                    found.append((name, *[None] * 5, str(e)))
                while len(found) >= NODES_AT_ONCE:
                    yield _cell_rows(found[:NODES_AT_ONCE])
                    del found[:NODES_AT_ONCE]
            if found:
                yield _cell_rows(found)

    return given.mapInArrow(run, CELLS)


def _cell_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = [c.split()[0] for c in CELLS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def cells_of(tree) -> list[tuple[int, int, int, str | None, str | None]]:
    """Table, row, place, span and merge of the cells that lie in nothing but tables, rows and cells, in reading order."""
    found = _flat_cells(tree)
    return list(_all_cells(tree)) if found is None else found


def _flat_cells(tree) -> list[tuple] | None:
    """cells_of() where all tables lie in the body and all properties in their cells, which takes a third of the time; None elsewhere."""
    tags = [node.tag for node in tree.iter()]
    full = {}
    for tag in set(tags):
        if full.setdefault(tag.rpartition("}")[2], tag) != tag:
            return None
    table_tag, row_tag, cell_tag, set_tag, span_tag, merge_tag = map(full.get, ("tbl", "tr", "tc", "tcPr", "gridSpan", "vMerge"))
    if local(tree) != "document":
        return None
    found, n_set = [], 0
    numbers = iter([i for i, tag in enumerate(tags) if tag == table_tag])
    for body in tree:
        if body.tag == full.get("body"):
            for table in body:
                if table.tag != table_tag:
                    continue
                number = next(numbers)
                row = 0
                for line in table:
                    if line.tag != row_tag:
                        continue
                    row, place = row + 1, 0
                    for cell in line:
                        if cell.tag != cell_tag:
                            continue
                        place, span, merge, spans, merges = place + 1, None, None, False, False
                        for node in cell:
                            if node.tag == set_tag:
                                n_set += 1
                                for x in node:
                                    if x.tag == span_tag and not spans:
                                        span, spans = x.get(f"{W}val"), True
                                    elif x.tag == merge_tag and not merges:
                                        merge, merges = x.get(f"{W}val", "continue"), True
                        found.append((number, row, place, span, merge))
    whole = next(numbers, None) is None and len(found) == (tags.count(cell_tag) if cell_tag else 0) and n_set == (tags.count(set_tag) if set_tag else 0)
    return found if whole else None


def _all_cells(tree) -> Iterator[tuple]:
    named: dict[str, str] = {}
    inner = {}  # nodes that were announced by their parent: table, number of the row, own number
    properties = {x for x in {node.tag for node in tree.iter()} if x.rpartition("}")[2] == "tcPr"}
    for number, node in enumerate(tree.iter()):
        told = inner.pop(node, None) if number else (None, None, None)
        if told is None:
            continue
        if (tag := named.get(node.tag)) is None:
            tag = named[node.tag] = local(node)
        if tag not in BLOCKS:
            continue
        table, row, own = told
        if tag == "tc" and table is not None and row is not None:
            yield (table, row, own, *_set_of_cell(node, properties))
        if tag == "tbl":
            table = number
        rows = places = 0
        for child in node:
            if (kind := named.get(child.tag)) is None:
                kind = named[child.tag] = local(child)
            if kind == "tr":
                rows += 1
                inner[child] = (table, None, rows)
            elif kind == "tc":
                places += 1
                inner[child] = (table, own if tag == "tr" else None, places)
            elif kind in BLOCKS:
                inner[child] = (table, None, None)


def _set_of_cell(cell, properties: set[str]) -> tuple[str | None, str | None]:
    """Span and merge of a cell: the first of each in its properties, wherever these lie but in cells inside of it."""
    span = merge = None
    spans = merges = False
    open_ = [(x, False) for x in reversed(cell)]
    while open_:
        node, set_ = open_.pop()
        tag = node.tag
        if set_:
            kind = tag.rpartition("}")[2]
            if kind == "gridSpan" and not spans:
                span, spans = node.get(f"{W}val"), True
            elif kind == "vMerge" and not merges:
                merge, merges = node.get(f"{W}val", "continue"), True
        if not len(node) or tag.rpartition("}")[2] == "tc":
            continue
        if tag in properties:
            open_ += [(x, True) for x in reversed(node)]
        elif any(next(node.iter(x), None) is not None for x in properties):
            open_ += [(x, False) for x in reversed(node)]
    return span, merge


class NodeColumns:
    """Nodes as plain rows and flat arrays, in the form that Arrow takes over with the least work; only the columns named leave."""

    PLAIN = ("doc_id", "part", "node_id", "end_id", "parent_id", "ord", "depth", "tag", "ns", "text", "tail", "path", "error", "digest")
    KINDS = {"node_id": pa.int64(), "end_id": pa.int64(), "parent_id": pa.int64(), "ord": pa.int32(), "depth": pa.int32()}

    def __init__(self, names: list[str]) -> None:
        self.names, self.digest = names, None
        self.clear()

    @property
    def size(self) -> int:
        return len(self.rows)

    def clear(self) -> None:
        self.rows: list[tuple] = []
        # where each row's entries begin, None for a row without an array
        self.above_from, self.above_ids, self.above_tags = [], [], []
        self.attrs_from, self.attr_names, self.attr_values = [], [], []

    def add_error(self, doc_id: str, part: str | None, error: str) -> None:
        self.rows.append((doc_id, part, *[None] * (len(self.PLAIN) - 4), error, None))
        self.above_from.append(None)
        self.attrs_from.append(None)

    def add_tree(self, doc_id: str, part: str, tree, kept: frozenset | None) -> Iterator[None]:
        """Adds the nodes in reading order; yields whenever there are enough to go on."""
        wants_attrs, wants_above, wants_path = (n in self.names for n in ("attrs", "above", "path"))
        sizes = subtree_sizes(tree) if "end_id" in self.names else None
        known: dict[str, tuple[str, str | None]] = {}
        own, place, parent, above, tags, path = 0, 0, None, [], [], ""
        siblings, seen = iter((tree,)), {}
        open_: list[tuple] = []
        while True:
            for node in siblings:
                if (named := known.get(node.tag)) is None:
                    named = known[node.tag] = (local(node), node.tag[1:].partition("}")[0] if node.tag.startswith("{") else None)
                tag, ns = named
                wanted, inner = kept is None or tag in kept, len(node)
                if wants_path:
                    seen[tag] = count = seen.get(tag, 0) + 1
                    here = f"{path}/{tag}[{count}]" if wanted or inner else ""
                else:
                    here = ""
                if wanted:
                    self.rows.append((doc_id, part, own, own + sizes[own] - 1 if sizes else None, parent, place, len(above), tag, ns, node.text, node.tail, here, None, self.digest))
                    if wants_above:
                        self.above_from.append(len(self.above_ids))
                        self.above_ids += above
                        self.above_tags += tags
                    if wants_attrs:
                        self.attrs_from.append(len(self.attr_names))
                        if node.attrib:
                            self.attr_names += node.attrib
                            self.attr_values += node.attrib.values()
                    if len(self.rows) >= NODES_AT_ONCE:
                        yield
                place += 1
                own += 1
                if inner:
                    open_.append((siblings, seen, place, parent, above, tags, path))
                    siblings, seen, place, parent, above, tags, path = iter(node), {}, 0, own - 1, [*above, own - 1], [*tags, tag], here
                    break
            else:
                if not open_:
                    return
                siblings, seen, place, parent, above, tags, path = open_.pop()

    def taken(self) -> pa.RecordBatch:
        """The rows so far, which leave."""
        plain = dict(zip(self.PLAIN, zip(*self.rows, strict=True), strict=True))
        arrays = []
        for name in self.names:
            if name == "above":
                pairs = pa.StructArray.from_arrays([pa.array(self.above_ids, pa.int64()), pa.array(self.above_tags, pa.string())], ["node_id", "tag"])
                arrays.append(pa.ListArray.from_arrays(pa.array([*self.above_from, len(self.above_ids)], pa.int32()), pairs))
            elif name == "attrs":
                arrays.append(pa.MapArray.from_arrays(pa.array([*self.attrs_from, len(self.attr_names)], pa.int32()), pa.array(self.attr_names, pa.string()), pa.array(self.attr_values, pa.string())))
            else:
                arrays.append(pa.array(plain[name], self.KINDS.get(name, pa.string())))
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def subtree_sizes(tree) -> list[int]:
    """How many nodes each node's subtree has, itself included, by its number in reading order."""
    sizes: list[int] = []
    open_: list[tuple[int, object]] = [(0, iter((tree,)))]
    while open_:  # numbers in reading order, sizes when a node is left
        own, rest = open_[-1]
        node = next(rest, None)
        if node is None:
            open_.pop()
            if open_:
                sizes[own] = len(sizes) - own
            continue
        sizes.append(1)
        open_.append((len(sizes) - 1, iter(node)))
    return sizes


def with_above(rows: DataFrame) -> DataFrame:
    """rows with `above`, an array of node_id and tag, for its two arrays."""
    pairs = F.zip_with("above_ids", "above_tags", lambda i, t: F.struct(i.alias("node_id"), t.alias("tag")))
    return rows.withColumn("above", pairs).drop("above_ids", "above_tags")
