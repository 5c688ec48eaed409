"""Inheritance: closures of parent links and layered values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import cut_off


def ancestor_chains(df: DataFrame, keys: list[str], node: str, parent: str) -> DataFrame:
    """keys, node, ancestor, depth: every node with itself at depth 0, its parent at 1 and so on.

    A missing parent ends a chain, and so does a node that the chain already holds: cycles are cut, not followed.
    Chains double in length with each step, so even long ones take few joins; steps are cut off by checkpoints.
    """
    nodes = df.select(*keys, F.col(node).alias("ancestor")).distinct()
    own = df.select(*keys, F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    above = df.select(*keys, F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).where("ancestor IS NOT NULL AND ancestor <> node")
    reach, before = cut_off(own.unionByName(above.join(nodes, [*keys, "ancestor"]).select(own.columns)).groupBy(*keys, "node", "ancestor").agg(F.min("depth").alias("depth"))), 0
    while (now := reach.count()) != before:
        further = reach.select(*keys, F.col("node").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("depth").alias("_more"))
        longer = reach.join(further, [*keys, "ancestor"]).groupBy(*keys, "node", F.col("_top").alias("ancestor")).agg(F.min(F.col("depth") + F.col("_more")).alias("depth"))
        reach, before = cut_off(longer), now
    return reach


def cascade(chains: DataFrame, values: DataFrame, keys: list[str], node: str, columns: list[str]) -> DataFrame:
    """For each node the nearest value of each column along its chain; null means inherit."""
    held = values.select(*keys, F.col(node).alias("ancestor"), *columns)
    near = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c) for c in columns]
    return chains.join(held, [*keys, "ancestor"]).groupBy(*keys, "node").agg(*near)
