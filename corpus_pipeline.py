"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import Scratch, released
from quire.llm.exact_dedup import drop_copies
from quire.llm.mixing import emit_mix
from quire.llm.near_copies import drop_similar
from quire.llm.packing import pack
from quire.llm.quality import keep_good
from quire.llm.queries import documents, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash links first, then exactly, five-word shingles with Jaccard similarity 0.8 or more."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return emit_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", near), ("mixing", mixing), ("packing", packing)]

#: Tokens, sketches and components are beyond SQL. Tests hold the quality, exact and near-copy stages and the packing
#: against brute force one by one; the whole run is only checked for rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it; an empty table gives an empty result."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.discard(STAGES[i - 1][0])
    return docs
