"""URL filters: fixed rules first, mined association rules for all other pages.

FP-growth mines which combinations of URL tokens go with a bad label. All tokens of a URL take part: those with too few
bad pages for any rule are left out first, and tokens that are in just the same labelled pages are one class, as any rule
with one of them holds with each other one too. Rules that lead to the bad label and pass the
support and confidence limits are kept, unless a more general rule does the same. A page is blocked if all tokens of a
rule are in its URL. An inverted index lists each rule under its rarest token, so a URL is compared with the rules of
its own tokens only.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.session import ship_package

#: Fixed rules: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Least share and number of labelled pages with a rule's tokens and the bad label, and least share of bad ones among those with the tokens.
SUPPORT, SUPPORT_ROWS, CONFIDENCE = 0.001, 20, 0.8
BAD = "!bad"


def host_and_path(url):
    """Host, with A-Z lower-cased, and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url, host, path):
    """Distinct tokens of a URL: scheme, host parts from the right, path parts from the left, names in the query."""
    scheme = F.array(F.concat(F.lit("s="), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    names = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1)
    each = [(scheme, ""), (labels, "h="), (parts, "p="), (names, "q=")]

    def named(kind: str):  # a second parameter of the lambda would be the place in the array
        return lambda v: F.concat(F.lit(kind), v)

    return F.array_distinct(F.concat(*[F.transform(x, named(k)) for x, k in each]))


def fixed_rule(host, path, rules=RULES):
    """The longest rule that fits, as a struct of text and verdict; null without one."""
    found = F.lit(None)
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def classes(labelled: DataFrame, least: int) -> dict[str, str]:
    """The class of each token with `least` bad rows or more: the smallest token that is in the same rows.

    Two sums of hashes over a token's rows tell the sets of rows apart.
    """
    hashes = [F.pmod(F.xxhash64("tokens", F.lit(i)), F.lit(p)) for i, p in enumerate((2_147_483_647, 2_147_483_629))]
    each = labelled.select(F.explode("tokens").alias("token"), F.col("bad").cast("int").alias("bad"), *[h.alias(f"h{i}") for i, h in enumerate(hashes)])
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")).where(F.col("n_bad") >= least)
    first: dict[tuple, str] = {}
    return {r["token"]: first.setdefault((r["n"], r["n_bad"], r["h0"], r["h1"]), r["token"]) for r in sorted(found.collect())}


def mine(labelled: DataFrame, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE) -> tuple[list[tuple[str, ...]], dict[str, str]]:
    """Combinations of token classes that lead to the bad label, and the classes of tokens. labelled: tokens, bad."""
    total = labelled.count()
    if not total:
        return [], {}
    share = min(1.0, max(support, support_rows / total))
    class_of = classes(labelled, math.ceil(share * total - 1e-6))
    held = labelled.sparkSession.sparkContext.broadcast(class_of)

    @F.arrow_udf("array<string>")
    def items(column: pa.Array) -> pa.Array:
        own = held.value
        return pa.array([sorted({own[t] for t in x or () if t in own}) for x in column.to_pylist()], pa.list_(pa.string()))

    baskets = labelled.select("bad", items("tokens").alias("items")).select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(F.array_sort("antecedent").alias("a")).collect()
    kept: list[frozenset] = []
    for rule in sorted((frozenset(r["a"]) for r in rules), key=lambda r: (len(r), sorted(r))):
        if not any(k <= rule for k in kept):
            kept.append(rule)
    used = frozenset().union(*kept)
    return [tuple(sorted(r)) for r in kept], {t: c for t, c in class_of.items() if c in used}


def inverted_index(rules: list[tuple[str, ...]]) -> dict[str, list[frozenset]]:
    """Each rule under the one of its tokens that the fewest rules have."""
    often: dict[str, int] = {}
    for rule in rules:
        for token in rule:
            often[token] = often.get(token, 0) + 1
    index: dict[str, list[frozenset]] = {}
    for rule in rules:
        index.setdefault(min(rule, key=lambda t: (often[t], t)), []).append(frozenset(rule))
    return index


def url_filter(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, mined (whether a mined rule matches).

    labels: doc_id, quality, toxic for some pages by page_id; a page is bad if toxic or of quality 0. A page with several
    labels counts once for each. Null labels are no labels; a null url has neither host nor path nor tokens. Very long urls
    count with all their tokens. Of fixed rules of one length that fit, the one listed last counts; mined rules that tie all block.
    Repeated rows are rows of their own; pages without labels leave only the fixed rules, no pages give no rows.
    """
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), F.when(F.col("url").isNull(), F.array().cast("array<string>")).otherwise(tokens(F.col("url"), host, path)).alias("tokens"))
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    mined, class_of = mine(parsed.join(marks, "page_id").select("tokens", "bad"), support, support_rows, confidence)
    index = pages.sparkSession.sparkContext.broadcast((inverted_index(mined), class_of))

    @F.arrow_udf("boolean")
    def matches(column: pa.Array) -> pa.Array:
        (rules, classes_of), out = index.value, []
        for held in column.to_pylist():
            own = {classes_of[t] for t in held or () if t in classes_of}
            out.append(any(rule <= own for token in own for rule in rules.get(token, ())))
        return pa.array(out, pa.bool_())

    chosen = parsed.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"))).withColumn("mined", matches("tokens"))
    return chosen.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")
