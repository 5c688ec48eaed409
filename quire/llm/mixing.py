"""Mixing sources to target weights (native: DataFrame and SQL functions only).

Tokens are added up per source, targets follow from the weights, and each source's repetition rate is its target over
its size. A document is taken floor(rate) times, plus once more if its hash-seeded draw falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, WORD, Scratch, group_join, packed, split_join

#: Fixed values of the mix: weights of the sources in order, repeating; share of all sizes; most repetitions.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def n_words(text):
    """Number of words: each becomes one letter, then the white space goes."""
    return F.char_length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACES, "")).cast("long")


def rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, n, source_size, target from rows with source_key, source, size.

    Targets stop at `most` times the source's size; the excess goes to the others by weight until none is above. That
    is one level for all: a source gets weight * level, at most its bound. With sources in the order of bound / weight
    the level is what remains after the bounds of those before it, over the weights from it on, where that first stays
    within its own ratio. One row for each source: a dimension, so its windows see few rows.
    """
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "place")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("source_size"))
    sums = sums.withColumn("place", F.row_number().over(by_name) - 1)
    sums = sums.withColumn("weight", F.get(cycle, F.col("place") % len(weights))).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    sums = sums.withColumn("ratio", F.col("bound") / F.col("weight"))
    everything = Window.partitionBy()
    sums = sums.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "used": F.coalesce(F.sum("bound").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    sums = sums.withColumn("level_here", (F.col("budget") - F.col("used")) / F.col("open"))
    sums = sums.withColumn("level", F.min_by(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here")), F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "place"))).over(everything))
    return sums.select("source_key", "n", "source_size", F.least(F.col("weight") * F.col("level"), F.col("bound")).alias("target"))


def draw(doc_id, text, seed: str = SEED):
    """A number in [0, 1) from the seed and the doc_id; without one, from the text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), name)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies.

    A null text has size 0, a null source is a source of its own and comes last. Rows that repeat a doc_id share its
    draw. An empty table gives no rows; if all sizes are 0, nothing is taken. Very long texts count with all their words;
    columns besides doc_id, text and source aren't read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.table(docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw")), "sized")
    per_source = scratch.table(rates(sized, weights, share, most), "rates")
    copied = _copied(split_join(sized.drop("source"), per_source, "source_key", "n", sized.count()))
    return copied.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _copied(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("long"))


def emit_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names.

    Nulls, repeated rows, very long texts and empty tables are as in mix(); a source of size 0 gives nothing.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keyed = docs.select(packed(docs), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    sized = scratch.table(docs.select("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"), n_words(F.col("text")).alias("size")), "sized")
    per_source = scratch.table(rates(sized, weights, share, most), "rates")
    often = _copied(group_join(keyed, per_source, "source_key", "n", sized.count())).where("copies > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('{SEED} ' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS bound FROM sums),
laid AS (
  SELECT *, bound / weight AS ratio FROM weighed),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         coalesce(sum(bound) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS used,
         sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM laid),
level AS (
  SELECT (budget - used) / open AS level FROM levels
  WHERE (budget - used) / open <= ratio ORDER BY ratio, place LIMIT 1),
targets AS (
  SELECT source, source_size, least(weight * level, bound) AS target FROM levels, level),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.draw,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""
