"""Pages as markup: every text that a page shows, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_markup, trim_space
from quire.operators.sequences import adjacent_runs, joined_blocks
from quire.operators.tree import nearest
from quire.sources.pages import HIDDEN, HOLDERS, TEXT


def tag_of(place: str) -> Column:
    return F.filter("above", lambda x: x["node_id"] == F.col(place))[0]["tag"]


#: Stands for a line break while texts are put together.
BREAK = "\x00"


def elements(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, parent_id, depth, tag, path and text of the elements: the texts that lie in each one itself, in order, as one."""
    is_text = F.col("tag") == TEXT
    owner = F.when(is_text, F.col("parent_id")).otherwise(F.col("node_id"))
    own = F.first(F.when(~is_text, F.struct("parent_id", "depth", "tag", "path")), ignorenulls=True)
    said = F.array_sort(F.collect_list(F.when(is_text, F.struct("node_id", "text"))))
    held = nodes.where(owner.isNotNull()).groupBy("doc_id", owner.alias("owner")).agg(own.alias("own"), F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"))
    return held.select("doc_id", F.col("owner").alias("node_id"), "own.*", "text")


def page_blocks(nodes: DataFrame, line_break: str = "\n") -> DataFrame:
    """doc_id, at, tag, text: the texts of each block in order, line_break for `br`; inline elements belong to the block they lie in.

    What stands between two inner blocks is a block of its own with the outer one's tag, so no text is lost and none is
    told twice.
    """
    shown = nodes.where(F.col("tag").isin(TEXT, "br")).where(~F.exists("above", lambda x: x["tag"].isin(*HIDDEN)))
    placed = shown.withColumn("block", F.coalesce(nearest(*sorted(HOLDERS)), F.lit(-1))).withColumn("holder", F.when(F.col("block") >= 0, tag_of("block")))
    runs = adjacent_runs(placed, ["doc_id"], ["node_id"], ["block"])
    said = F.when(F.col("tag") == "br", line_break).otherwise(F.col("text"))
    told = runs.groupBy("doc_id", "run").agg(F.min("node_id").alias("at"), F.first("holder").alias("tag"), F.array_sort(F.collect_list(F.struct("node_id", said.alias("said")))).alias("parts"))
    texts = told.select("doc_id", "at", "tag", F.array_join(F.transform("parts", lambda x: x["said"]), "").alias("text"))
    return texts.where(trim_space(F.replace("text", F.lit(line_break or " "), F.lit(" "))) != "")


def page_markup(nodes: DataFrame, line_break: str = "") -> DataFrame:
    """doc_id, markup: headings, items and all other blocks of each page, line_break for `br` (a space in headings, if it is anything); a page that shows nothing has empty markup."""
    blocks = page_blocks(nodes, BREAK)
    heading = F.col("tag").rlike("^h[1-6]$")
    text = trim_space(escape_markup(F.col("text")))
    lines = F.replace(text, F.lit(BREAK), F.when(heading, F.lit(" " if line_break else "")).otherwise(F.lit(line_break)))
    level = F.substring("tag", 2, 1).try_cast("int")
    block = F.when(heading, F.concat(F.repeat(F.lit("="), level), F.lit(" "), lines)).when(F.col("tag") == "li", F.concat(F.lit("- "), lines)).otherwise(lines)
    every = nodes.where("node_id = 0").select("doc_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("block"))
    return joined_blocks(every.unionByName(blocks.select("doc_id", "at", block.alias("block"))), ["doc_id"], ["at"], F.col("block"), "markup")
