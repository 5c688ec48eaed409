"""Operators on trees that lie in tables, a row for each node.

Nodes of a document's part are numbered in reading order; end_id is the last number below a node, and `above` holds
number and tag of the nodes that it lies in, from the root down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import trim_space


def nearest(*tags: str) -> Column:
    """Number of the closest node above with one of the tags; null if there is none."""
    return F.try_element_at(F.filter("above", lambda x: x["tag"].isin(*tags)), F.lit(-1))["node_id"]


def above(steps: int) -> Column:
    """Tag of the node so many steps above; null beyond the root."""
    return F.try_element_at("above", F.lit(-steps))["tag"]


def within(outer: DataFrame, inner: DataFrame, name: str = "outer_id") -> DataFrame:
    """Containment join: each row of inner with the node_id of every row of outer that it lies in, itself included.

    A node brings the numbers of all nodes above it, so both sides meet on equal numbers: work and rows grow with the
    nodes times their depth and with what is found, never with the pairs of a part, however many nodes it has.
    """
    own = F.array_append(F.transform("above", lambda x: x["node_id"]), F.col("node_id"))
    lies_in = inner.withColumn(name, F.explode(own))
    return lies_in.join(outer.select("doc_id", "part", F.col("node_id").alias(name)), ["doc_id", "part", name])


def visible_text(outer: DataFrame, nodes: DataFrame, tags: tuple[str, ...] = ("t", "instrText")) -> DataFrame:
    """doc_id, part, node_id, visible: what the texts below each row of outer say, trimmed, in order, with a space between; null if nothing."""
    said = nodes.where(F.col("tag").isin(*tags)).withColumn("_said", trim_space(F.col("text"))).where("_said <> ''")
    found = within(outer, said.select("doc_id", "part", "node_id", "above", "_said"), "_outer")
    told = found.groupBy("doc_id", "part", F.col("_outer").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("at"), "_said"))).alias("_all"))
    texts = told.select("doc_id", "part", "node_id", F.array_join(F.transform("_all", lambda x: x["_said"]), " ").alias("visible"))
    return outer.select("doc_id", "part", "node_id").join(texts, ["doc_id", "part", "node_id"], "left")


def lies_in(inner: DataFrame, tags: tuple[str, ...], name: str = "outer_id") -> DataFrame:
    """within() for outer nodes that are told by their tags alone: each row of inner with the node_id of every such node that it lies in, itself included.

    A node brings numbers and tags of the nodes above it, so nothing is joined or moved.
    """
    own = F.array_append("above", F.struct("node_id", "tag"))
    return inner.withColumn(name, F.explode(F.transform(F.filter(own, lambda x: x["tag"].isin(*tags)), lambda x: x["node_id"])))


def visible_in(nodes: DataFrame, outer: tuple[str, ...], tags: tuple[str, ...] = ("t", "instrText"), **more: Column) -> DataFrame:
    """visible_text() of the nodes with the tags of `outer`, in one pass: nodes are read once and grouped by what they lie in. more: further aggregates over those rows."""
    said = F.when(F.col("tag").isin(*tags), F.nullif(trim_space(F.col("text")), F.lit("")))
    found = lies_in(nodes.where(F.col("tag").isin(*outer, *tags)).withColumn("_said", said), outer, "_outer")
    texts = F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct(F.col("node_id").alias("at"), "_said"))))
    told = found.groupBy("doc_id", "part", F.col("_outer").alias("node_id")).agg(texts.alias("_all"), *[c.alias(k) for k, c in more.items()])
    return told.select("doc_id", "part", "node_id", F.when(F.size("_all") > 0, F.array_join(F.transform("_all", lambda x: x["_said"]), " ")).alias("visible"), *more)
