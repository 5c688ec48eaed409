"""Sections of packages: what each one's page looks like, with the headers and footers that other parts hold; and what their drawings show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trim_space
from quire.operators.firsts import first_use_numbers
from quire.operators.office import R
from quire.operators.sequences import coming_first
from quire.operators.tree import above, nearest
from quire.plans.typeset import BODY, SIDES, attr, link_catalog, whole

KINDS = ("header", "footer")
SIZES = {"width": ("pgSz", "w"), "height": ("pgSz", "h")} | {side: ("pgMar", side) for side in (*SIDES, *KINDS)}


def section_ends(nodes: DataFrame) -> DataFrame:
    """doc_id, section, ends_at, page (a struct of SIZES in twips), header and footer (their texts), of each section end of the body.

    A section end lies in the last paragraph of its section or at the end of the body; ends_at is the number of the last
    node that belongs to its section. Of several references of one kind the last whose part can be read counts.
    """
    body = nodes.where(F.col("part") == BODY)
    is_end, is_inner = (F.col("tag") == "sectPr") & above(1).isin("pPr", "body"), above(1) == "sectPr"
    size = lambda tag, name: F.min_by(whole(attr(name)), F.when(is_inner & (F.col("tag") == tag), F.col("node_id")))
    page = F.when(F.bool_or(is_inner), F.struct(*[size(*x).alias(k) for k, x in SIZES.items()]))
    named = lambda kind: F.array_sort(F.collect_list(F.when(is_inner & (F.col("tag") == f"{kind}Reference"), F.struct("node_id", F.coalesce(attr("id", R), F.lit("")).alias("id")))))
    held = body.where(is_end | is_inner).withColumn("end", F.when(is_end, F.col("node_id")).otherwise(nearest("sectPr")))
    ends = held.groupBy("doc_id", "end").agg(F.bool_or(is_end).alias("_ends"), page.alias("page"), *[named(k).alias(f"_{k}") for k in KINDS]).where("_ends")
    # what parts say and what relationships lead to lie in a map for each package, so references move with their section only
    said = F.nullif(trim_space(F.when(F.col("tag").isin("t", "instrText"), F.col("text"))), F.lit(""))
    texts = nodes.where((F.col("part") != BODY) & F.col("tag").isNotNull()).withColumn("_said", said).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("node_id", "_said")))).alias("_all"))
    texts = texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.array_join(F.transform("_all", lambda x: x["_said"]), " ")))).alias("_texts"))
    out = ends.join(link_catalog(nodes), "doc_id", "left").join(texts, "doc_id", "left")
    last_read = lambda refs: F.try_element_at(F.filter(F.transform(refs, lambda x: F.try_element_at("_texts", F.try_element_at("targets", x["id"]))), lambda t: t.isNotNull()), F.lit(-1))
    section = F.row_number().over(Window.partitionBy("doc_id").orderBy("end"))
    return out.select("doc_id", section.alias("section"), F.col("end").alias("ends_at"), "page", *[last_read(f"_{k}").alias(k) for k in KINDS])


def in_sections(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """blocks (doc_id, at) with section (from 1), page, header and footer: those of the next section end, or of none after the last one.

    An end in a paragraph lies behind the paragraph's own number, so the paragraph belongs to the section that it ends.
    """
    told = F.struct("section", "page", *KINDS)
    both = blocks.withColumn("_end", F.lit(None).cast(ends.select(told.alias("x")).schema["x"].dataType)).unionByName(ends.select("doc_id", F.col("ends_at").alias("at"), told.alias("_end")), allowMissingColumns=True).withColumn("_own", F.col("_end").isNull())
    placed = coming_first(both, ["doc_id"], ["at"], F.col("_end"), "_next")
    last = F.coalesce(F.max("_end.section").over(Window.partitionBy("doc_id")), F.lit(0)) + 1
    placed = placed.withColumn("_last", last).where("_own")
    return placed.select(*[F.col(f"`{c}`") for c in blocks.columns], F.coalesce("_next.section", "_last").alias("section"), *[F.col(f"_next.{c}").alias(c) for c in ("page", *KINDS)])


def placed_assets(nodes: DataFrame) -> DataFrame:
    """doc_id, at, target and asset_id of each drawing of the body, in order of first use.

    A drawing shows the medium that its picture's relationship leads to, one asset for each target; one without a picture
    that leads anywhere gets a placeholder of its own. Both streams share one count, as media are numbered by how many
    assets there are already; placeholders also have their own.
    """
    body = nodes.where(F.col("part") == BODY)
    drawings = body.where(F.col("tag").isin("drawing", "pict")).select("doc_id", F.col("node_id").alias("at"))
    owner, id_ = nearest("drawing", "pict"), F.coalesce(attr("embed", R), attr("link", R), attr("id", R))
    pictures = body.where(F.col("tag").isin("blip", "imagedata") & owner.isNotNull()).groupBy("doc_id", owner.alias("at")).agg(F.min_by(id_, F.col("node_id")).alias("id"))
    uses = drawings.join(pictures, ["doc_id", "at"], "left").join(link_catalog(nodes), "doc_id", "left").withColumn("target", F.try_element_at("targets", F.col("id"))).drop("targets", "id")
    numbered = first_use_numbers(uses, ["doc_id"], "at", "target")
    placeholders = F.count_if(F.col("target").isNull()).over(Window.partitionBy("doc_id").orderBy("at"))
    return numbered.withColumn("asset_id", F.when(F.col("target").isNull(), F.concat(F.lit("asset-fallback-"), placeholders)).otherwise(F.concat(F.lit("asset-"), "number"))).drop("number")
