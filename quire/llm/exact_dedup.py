"""Exact duplicates with a heavy-hitter split (native: DataFrame and SQL functions only).

A mergeable frequent-items sketch of the Misra-Gries family finds the digests that many rows share. Their exact counts
and winners are then computed with map-side combining, and those verified winners, at most HEAVY_DIGESTS rows, are
broadcast: rows of large groups are decided where they lie. All other digests are counted and joined by ordinary
shuffles, in which no digest holds more than 1/HEAVY_DIGESTS of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, Scratch, chosen, numbered, perhaps_heavy

#: Most digests that are broadcast. The sketches' error is below rows / HEAVY_DIGESTS: no heavy digest is missed.
HEAVY_DIGESTS = 2048


def normalized(text):
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def decide(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with group_size, keep_id and keep_at, the doc_id and key of the row that stays of its group.

    rows: doc_id, digest, points (code points of the text), at (a key of the row); written.
    """
    total = rows.count()
    bound = max(1, total // HEAVY_DIGESTS)
    hashed = rows.withColumn("hash", F.xxhash64("digest"))
    candidates = perhaps_heavy(hashed, "hash", bound)

    def winners(frame: DataFrame) -> DataFrame:
        order = F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")
        best = frame.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        return best.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"))

    verified = winners(hashed.join(F.broadcast(candidates), "hash", "left_semi").drop("hash"))
    heavy = scratch.table(verified.where(F.col("group_size") > bound), "heavy")
    near = rows.join(F.broadcast(heavy), "digest")
    far = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return near.unionByName(far.join(winners(far), "digest"))


def digested(doc_id, text, at) -> list:
    return [doc_id.alias("doc_id"), F.unhex(F.sha2(normalized(text), 256)).alias("digest"), F.char_length(F.coalesce(text, F.lit(""))).alias("points"), at.alias("at")]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the smallest doc_id (null last), then, among rows
    that repeat both, one of them. A null text is an empty text; a very long one is hashed where it lies. Extra columns
    of docs are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.table(docs.select(*digested(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id())), "rows")
    return decide(rows, scratch).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; nulls, ties and long texts as there.

    Only keys and digests are shuffled; the keys of the rows that go then meet the texts. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = numbered(docs, scratch)
    keyed = scratch.table(rows.select(*digested(F.col("row.doc_id"), F.col("row.text"), F.col("at"))), "rows")
    gone = scratch.table(decide(keyed, scratch).where("at <> keep_at").select("at"), "gone")
    return chosen(rows, gone, "left_anti").select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
