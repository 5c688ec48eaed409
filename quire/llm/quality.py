"""Quality rules with adaptive thresholds.

Each document is measured once. Mergeable quantile sketches per language and source, merged once more per language, give
for each measure a middle and a spread: the median, and its distance to the nearer quartile. A third of junk rows moves
the quartile on its side but neither the median nor the other quartile beyond the range of the good rows. A source's
middle and spread are drawn towards its language's, as if PRIOR more rows of the language were in it, so a source of a
handful of rows is judged by its language and a large one by itself.

A measure is bad beyond the fence of the document's language or of its source: the mirrored quartile plus SPREADS times
the range between quartiles, or plus what chance alone does to a document of so few words, if that is more. So no
cutoff is fixed, and a source that is bad throughout doesn't hide itself.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, group_join, map_batches, packed, split_join, word_blocks
from quire.plans.session import ship_package

SYMBOLS = b"#*$%&|<>"
#: A-Z, and the bytes of a character in UTF-8 after its first.
CAPITALS, CONTINUING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
WINDOW = 8
#: Multiple of the range between the quartiles that a measure may be above the upper one, and of a document's own chance deviation.
SPREADS, CHANCE = 6.0, 6.0
#: Measures that are judged: an expression and how many chances a document has (what is counted in windows comes WINDOW at a time).
JUDGED = {
    "symbol_share": ("try_divide(n_symbols, n_words)", "n_words"),
    "word_length": ("try_divide(word_chars, n_words)", "n_words"),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", f"n_words / {WINDOW}"),
    "dup_share": ("try_divide(n_dup_lines, n_lines)", "n_lines"),
    "top_share": ("try_divide(n_top_word, n_words)", "n_words"),
    "upper_share": ("try_divide(n_upper, word_chars)", "n_words"),
}
#: Accuracy parameter of the sketches: a rank is off by about 1.3 % at most.
SKETCH_K = 400
#: Rows of its language that count towards a source's middle and spread.
PRIOR = 50


def repeat_words(rank: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in windows of `width` words found twice or more. rank: a number for each word, equal for equal words.

    Windows get their numbers by doubling: pairs of numbers of half as long windows are numbered in turn.
    """
    n = len(rank)
    if n <= width or int(rank.max()) + 1 == n:
        return 0
    step = 1
    while step < width:
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, often = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(often) == len(rank):
            return 0
        step *= 2
    twice = (often[rank] > 1).astype(np.int64)
    inside = np.cumsum(np.concatenate((twice, np.zeros(width - 1, np.int64))))
    inside[width:] -= inside[:-width].copy()
    return int((inside > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The values of COLUMNS for a text in UTF-8. Words are taken block by block, so only their numbers are held at once."""
    numbers: dict[bytes, int] = {}
    ranks, chars, symbols, upper = [np.empty(0, np.int64)], 0, 0, 0
    for words in word_blocks(text):
        ranks.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        joined = b"".join(words)
        chars += len(joined.translate(None, CONTINUING))
        symbols += len(joined) - len(joined.translate(None, SYMBOLS))
        upper += len(joined) - len(joined.translate(None, CAPITALS))
    rank = np.concatenate(ranks)
    lines, n_lines = set(), 0
    for line in io.BytesIO(text):
        if line.strip():
            n_lines += 1
            lines.add(line.removesuffix(b"\n"))
    top = int(np.bincount(rank).max()) if len(rank) else 0
    return len(rank), chars, symbols, n_lines - len(lines), repeat_words(rank), n_lines, top, upper


COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_top_word n_upper".split()


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null: empty) and the measures of each row of docs."""

    def run(batch):
        rows = [measure(x.as_py()) for x in batch.column("text")]
        made = {c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}
        yield {c: batch.column(c) for c in ("doc_id", "lang", "source")} | made

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_batches(chosen, run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COLUMNS))


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fences(rows: DataFrame) -> DataFrame:
    """lang, source and, by measure, the middle and spread of the language and of the source. rows: measured documents."""
    shares = rows.where("n_words > 0").select("lang", "source", *[F.expr(e).alias(c) for c, (e, _) in JUDGED.items()])
    sketched = shares.groupBy("lang", "source").agg(F.count("*").alias("judged"), *[F.expr(f"kll_sketch_agg_double({c}, {SKETCH_K})").alias(c) for c in JUDGED])
    by_lang = sketched.groupBy("lang").agg(*[F.expr(f"kll_merge_agg_double({c}, {SKETCH_K})").alias(f"lang_{c}") for c in JUDGED])

    def of(sketch: str) -> tuple:
        low, middle, high = (F.expr(f"kll_sketch_get_quantile_double({sketch}, {q}D)") for q in (0.25, 0.5, 0.75))
        return middle, F.least(high - middle, middle - low)

    weight, out = F.col("judged") / (F.col("judged") + PRIOR), []
    for c in JUDGED:
        for name, own, whole in zip(("middle", "spread"), of(c), of(f"lang_{c}"), strict=True):
            out += [whole.alias(f"lang_{name}_{c}"), (weight * own + (1 - weight) * whole).alias(f"own_{name}_{c}")]
    return sketched.join(by_lang, "lang").select("lang", "source", *out)


def fence(measure: str, whose: str):
    """What the measure may be in a document of this row: whose is lang or own."""
    middle, spread, n = F.col(f"{whose}_middle_{measure}"), F.col(f"{whose}_spread_{measure}"), F.expr(JUDGED[measure][1])
    return middle + spread + F.greatest(SPREADS * 2 * spread, CHANCE * F.sqrt(F.try_divide(middle + F.try_divide(F.lit(1.0), n), n)))


def limits_of(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """One row for each (lang, source) with its number of rows and its fences, written; and the number of all rows."""
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("group_rows"))
    limits = counts.join(fences(rows), ["lang", "source"], "left").withColumn("group", F.struct("lang", "source"))
    return scratch.table(limits.drop("lang", "source"), "fences"), rows.count()


def verdict():
    beyond = F.lit(False)
    for c, (e, _) in JUDGED.items():
        for whose in ("lang", "own"):
            beyond = beyond | F.coalesce((F.col("n_words") > 0) & (F.expr(e) > fence(c, whose)), F.lit(False))
    return ~base_failed() & ~beyond


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails. A null language or source counts as an empty one. Very long texts are
    measured block by block. Rows that repeat a doc_id are rows of their own; an empty table gives no rows.
    Other columns aren't read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(measured(docs), "measured")
    joined = split_join(rows.withColumn("group", F.struct("lang", "source")), limits_of(rows, scratch)[0], "group", "group_rows", rows.count())
    return joined.select("doc_id", *COLUMNS[:5], base_failed().alias("base_failed"), verdict().alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; nulls, empty and long texts as there.

    Measures are written without the texts and give the fences, one row for each language and source. These go to the
    documents, which are measured once more where they lie: that is cheaper than moving or copying texts. An empty table
    stays empty.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    limits, total = limits_of(scratch.table(measured(docs), "measured"), scratch)

    @F.arrow_udf(f"struct<{', '.join(f'{c}: long' for c in COLUMNS)}>")
    def measures(texts: pa.Array) -> pa.Array:
        rows = [measure(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COLUMNS))], names=COLUMNS)

    once = measures.asNondeterministic()  # else the filter below makes Spark call it several times for a row
    group = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).alias("group")
    joined = group_join(docs.select(packed(docs), group), limits, "group", "group_rows", total)
    measured_rows = joined.withColumn("m", once(F.coalesce("row.text", F.lit("")).cast("binary")))
    return measured_rows.select("row", "m.*", *[c for c in limits.columns if c.startswith(("lang_", "own_"))]).where(verdict()).select("row.*")
