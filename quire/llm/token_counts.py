"""Token counts of whole texts by the two-tier lookup of tokens.py.

The first tier is measured: mergeable frequent-items sketches over the words of all texts give the most frequent ones,
and their lengths in tokens are broadcast. Sketches are merged, words never shuffled. The table saves time only: a word
that isn't in it is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import MERGERS, map_batches
from quire.llm.tokens import CACHE_CHARS, count_encoder, lengths, on_workers

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Words of the first tier, and counters of a sketch.
WORDS, TRACKED = 1 << 14, 1 << 15


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The words between spaces and line feeds that occur most often."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[ \n]")).alias("word")).where(f"word <> '' AND length(word) <= {CACHE_CHARS}")
    sketches = words.groupBy((F.spark_partition_id() % MERGERS).alias("merger")).agg(F.expr(f"approx_top_k_accumulate(word, {TRACKED})").alias("sketch"))
    merged = sketches.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    return [r["word"] for r in merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("x")).select(F.col("x.item").alias("word")).collect()]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: the tokenizer's file, at the same place on every machine. A null text is empty: 0 bytes, 0 tokens. Very long
    texts are looked up block by block. Rows that repeat a doc_id are rows of their own; an empty table gives no rows.
    Other columns aren't read, whatever their names.
    """
    encoder = on_workers(docs.sparkSession, count_encoder, path, lengths(path, frequent_words(docs)))

    def count(batch):
        own = encoder()
        sizes, tokens = [], []
        for data in batch.column("text"):
            raw = data.as_py()
            sizes.append(len(raw))
            tokens.append(sum(own.parts(raw.decode("utf-8", "replace"))))
        yield {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), count, SCHEMA)
