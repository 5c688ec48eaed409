"""Packages to markup on tables of nodes: styles, pieces, paragraphs, lists, tables and their text as DataFrames.

Python takes packages apart into nodes, and cells to their columns; all else is column expressions, windows and
aggregates. Nodes move with their run, runs with their document, and all that follows groups inside documents, so it
needs no other exchange of them. Written so far: headings, paragraphs with styles by inheritance, runs, breaks, bookmarks, links, fields, nested lists,
tables with spans, merges, fills and borders, nested tables, page sizes and margins. Drawings, equations, notes,
headers, themes, table styles, fonts of the profile and exact row heights are convert()'s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import lists, sequences, styles
from quire.operators.grid import edge, place_cells
from quire.operators.markup import ALIGNED, BREAKS, DEFAULT_FONT, NUMBERINGS, RUNTIME_FILE, VERTICAL
from quire.operators.office import OFF, R, W
from quire.operators.tables import column_widths
from quire.operators.tree import above, nearest
from quire.plans.session import cut_off, spread
from quire.sources import package as P
from quire.sources.build import Built

BODY = "word/document.xml"
PARTS = (BODY, "word/styles.xml", "word/numbering.xml", "word/_rels/document.xml.rels")
#: What is read of nodes here.
NODE_COLUMNS = ("doc_id", "part", "node_id", "end_id", "parent_id", "tag", "attrs", "text", "path", "error", "above")
#: What a piece may lie in between its paragraph and its run.
AROUND = ("hyperlink", "smartTag", "customXml", "sdt", "sdtContent", "fldSimple", "r")
#: Stands between the segments of a paragraph while they are one string; markup can't hold it.
MARK = "\x00"
#: Style fields of text, in the order in which they wrap it, and of paragraphs.
TEXT_FIELDS = ("color", "font", "size", "bold", "italic", "underline", "strike", "super", "sub", "background")
BLOCK_FIELDS = ("align", "before", "after", "line", "break_before", "keep_next")
FIELDS = (*TEXT_FIELDS, *BLOCK_FIELDS)
FLAGS = (("bold", "strong"), ("italic", "emph"), ("underline", "underline"), ("strike", "strike"), ("super", "super"), ("sub", "sub"))
SIDES = ("top", "right", "bottom", "left")
#: Types of FIELDS that aren't strings.
KINDS = {"size": "bigint", "before": "bigint", "after": "bigint", "line": "bigint"} | {f: "boolean" for f in ("bold", "italic", "underline", "strike", "super", "sub", "break_before", "keep_next")}
_FIELDS_DDL = ", ".join(f"{f}: {KINDS.get(f, 'string')}" for f in FIELDS)
_STYLES_DDL = f"map<string, struct<style_name: string, {_FIELDS_DDL}>>"
#: Columns of the catalogs, with their types.
CATALOGS = {"paragraph_styles": _STYLES_DDL, "character_styles": _STYLES_DDL, "defaults": f"struct<{_FIELDS_DDL}>", "numbers": "map<string, string>", "targets": "map<string, string>"}


def attr(name: str, ns: str = W) -> Column:
    return F.try_element_at("attrs", F.lit(f"{ns}{name}"))


def whole(text: Column, signed: bool = False) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$" if signed else r"^\+?[0-9]+$"), text.try_cast("long"))


def absent(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def first(tag: str, value: Column, known: frozenset | None = None, kind: str = "string") -> Column:
    """The value at the first property node of the tag. known: tags that there are; none is looked for where it isn't one of them."""
    return absent(kind) if known is not None and tag not in known else F.min_by(value, F.when(F.col("prop") == tag, F.col("node_id")))


def first_under(under: str, tag: str, value: Column, known: frozenset | None = None, kind: str = "string") -> Column:
    return absent(kind) if known is not None and tag not in known else F.min_by(value, F.when((F.col("tag") == tag) & (above(1) == under), F.col("node_id")))


def switch(tag: str, known: frozenset | None = None) -> Column:
    return first(tag, ~F.coalesce(attr("val"), F.lit("true")).isin(*OFF), known, "boolean")


def given(color: Column) -> Column:
    return F.when(~color.isin("auto", "AUTO"), U.hex_color(color))


def style_fields(known: frozenset | None = None) -> dict[str, Column]:
    """FIELDS as aggregates over the property nodes of one owner; null where nothing is set."""
    raised = first("vertAlign", attr("val"), known)
    spacing = lambda name: first_under("pPr", "spacing", whole(attr(name)), known, "bigint")
    return {
        "color": first("color", F.when(attr("val").isNotNull(), U.hex_color(attr("val"))), known),
        "font": first("rFonts", F.nullif(F.coalesce(attr("ascii"), attr("hAnsi"), attr("eastAsia"), attr("cs")), F.lit("")), known),
        "size": first("sz", whole(attr("val")), known, "bigint"),
        "bold": switch("b", known), "italic": switch("i", known), "underline": switch("u", known), "strike": switch("strike", known),
        "super": F.when(raised == "superscript", True), "sub": F.when(raised == "subscript", True),
        "background": U.highlight(first("highlight", attr("val"), known)),
        "align": first("jc", attr("val"), known),
        "before": spacing("before"), "after": spacing("after"), "line": spacing("line"),
        "break_before": switch("pageBreakBefore", known), "keep_next": switch("keepNext", known),
    }


def is_property() -> Column:
    """Whether a node sets something of its owner: a run, a paragraph, a style or the defaults."""
    owners = ("style", "rPrDefault", "pPrDefault")
    return ((above(1) == "rPr") & (above(2).isin("r", *owners) | (above(2) == "pPr") & above(3).isin("p", *owners))) | ((above(1) == "pPr") & above(2).isin("p", *owners))


def struct_of(fields=FIELDS) -> Column:
    return F.struct(*[F.col(f) for f in fields])


def layered(*layers: Column, fields=FIELDS) -> Column:
    """Structs laid over each other, the first on top."""
    return F.struct(*[F.coalesce(*[x[f] for x in layers]).alias(f) for f in fields])


def style_catalog(nodes: DataFrame) -> DataFrame:
    """doc_id, defaults, paragraph_styles and character_styles (by id: style_name and FIELDS), each style with all that it inherits."""
    rows = nodes.where("part = 'word/styles.xml'")
    fields = style_fields()
    defaults = rows.where(is_property() & nearest("rPrDefault", "pPrDefault").isNotNull()).groupBy("doc_id").agg(*[c.alias(f) for f, c in fields.items()]).select("doc_id", struct_of().alias("defaults"))
    owner = F.coalesce(F.when(F.col("tag") == "style", F.col("node_id")), nearest("style"))
    is_style = F.col("tag") == "style"
    only = lambda c: F.max(F.when(is_style, c))
    own = rows.where(owner.isNotNull() & (is_style | is_property() | (above(1) == "style"))).groupBy("doc_id", owner.alias("at")).agg(
        only(attr("styleId")).alias("node"), only(F.coalesce(attr("type"), F.lit("paragraph"))).alias("kind"), first_under("style", "name", attr("val")).alias("style_name"), first_under("style", "basedOn", attr("val")).alias("parent"), *[c.alias(f) for f, c in fields.items()]
    ).where("node <> '' AND kind IN ('paragraph', 'character')")
    named = ["style_name", *FIELDS]
    own = sequences.last_by(own, ["doc_id", "kind", "node"], ["at"], ["parent", *named])
    if rows.where(is_style).isEmpty():  # nothing to inherit: no rounds of joins then
        resolved = own.drop("parent").where("false")
    else:
        own = cut_off(own)
        resolved = styles.cascade(styles.ancestor_chains(own, ["doc_id", "kind"], "node", "parent"), own, ["doc_id", "kind"], "node", named)
    entry = F.struct(F.col("node"), F.struct(*named))
    of = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, entry)))
    maps = resolved.groupBy("doc_id").agg(of("paragraph").alias("paragraph_styles"), of("character").alias("character_styles"))
    return maps.join(defaults, "doc_id", "full")


def number_catalog(nodes: DataFrame) -> DataFrame:
    """doc_id, numbers: `numId level` to the numbering's form, and `numId` alone to nothing for each number that there is."""
    rows = nodes.where("part = 'word/numbering.xml'")
    num = rows.where((above(1) == "num") & (F.col("tag") == "abstractNumId")).select("doc_id", nearest("num").alias("at"), attr("val").alias("abstract"))
    known = rows.where("tag = 'num'").select("doc_id", F.col("node_id").alias("at"), attr("numId").alias("num")).join(num, ["doc_id", "at"], "left")
    known = sequences.last_by(known.where("num IS NOT NULL"), ["doc_id", "num"], ["at"], ["abstract"])
    levels = rows.where((F.col("tag") == "lvl") & (above(1) == "abstractNum")).select("doc_id", nearest("abstractNum").alias("owner"), F.col("node_id").alias("level_at"), F.coalesce(whole(attr("ilvl")), F.lit(0)).alias("level"))
    forms = rows.where((F.col("tag") == "numFmt") & (above(1) == "lvl")).groupBy("doc_id", nearest("lvl").alias("level_at")).agg(F.min_by(attr("val"), F.col("node_id")).alias("form"))
    owners = rows.where("tag = 'abstractNum'").select("doc_id", F.col("node_id").alias("owner"), attr("abstractNumId").alias("abstract"))
    levels = levels.join(owners, ["doc_id", "owner"]).join(forms, ["doc_id", "level_at"], "left")
    levels = sequences.last_by(levels, ["doc_id", "abstract", "level"], ["level_at"], ["form"])
    leveled = known.join(levels, ["doc_id", "abstract"]).select("doc_id", F.concat_ws(" ", "num", "level").alias("key"), "form")
    every = leveled.unionByName(known.select("doc_id", F.col("num").alias("key"), F.lit("").alias("form")))
    return every.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "form"))).alias("numbers"))


def link_catalog(nodes: DataFrame) -> DataFrame:
    """doc_id, targets: relationship ids of the body to what they point to."""
    plain = lambda name: F.try_element_at("attrs", F.lit(name))
    rows = nodes.where("part = 'word/_rels/document.xml.rels' AND tag = 'Relationship'").select("doc_id", "node_id", F.coalesce(plain("Id"), F.lit("")).alias("id"), T.resolve_target(F.lit(BODY), F.coalesce(plain("Target"), F.lit("")), plain("TargetMode")).alias("target"))
    return sequences.first_by(rows, ["doc_id", "id"], ["node_id"], ["target"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "target"))).alias("targets"))


def layout_catalog(nodes: DataFrame) -> DataFrame:
    """doc_id, section_ends (paragraphs that end a section), page (what sets the first section's page, or nothing)."""
    body = nodes.where(F.col("part") == BODY)
    ends = F.array_sort(F.collect_list(F.when((F.col("tag") == "sectPr") & (above(1) == "pPr"), nearest("p"))))
    sections = body.where((F.col("tag") == "sectPr") & (above(1).isin("pPr", "body"))).groupBy("doc_id").agg(ends.alias("section_ends"), F.min("node_id").alias("at"))
    number = lambda tag, name: first(tag, whole(attr(name))).alias(f"{tag}_{name}")
    sizes = body.where((above(1) == "sectPr") & F.col("tag").isin("pgSz", "pgMar")).withColumn("prop", F.col("tag")).groupBy("doc_id", nearest("sectPr").alias("at")).agg(
        number("pgSz", "w"), number("pgSz", "h"), *[number("pgMar", x) for x in (*SIDES, "header", "footer")]
    )
    inch = lambda c: F.coalesce(U.twips(F.col(c)), F.lit("1in"))
    given_ = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), U.twips(F.col(c)), F.lit(", "))).otherwise("")
    margin = F.concat(F.lit("margin: (top: "), inch("pgMar_top"), F.lit(", right: "), inch("pgMar_right"), F.lit(", bottom: "), inch("pgMar_bottom"), F.lit(", left: "), inch("pgMar_left"), F.lit("), "))
    page = F.concat(F.lit("#set page("), given_("width", "pgSz_w"), given_("height", "pgSz_h"), margin, given_("header-ascent", "pgMar_header"), given_("footer-descent", "pgMar_footer"), F.lit(")\n"))
    return sections.join(sizes, ["doc_id", "at"], "left").select("doc_id", "section_ends", page.alias("page"))


def runs(body: DataFrame, known: frozenset | None = None) -> DataFrame:
    """A row for each run of each paragraph, and one for the paragraph itself (r is null): what is set there, and the pieces in it. known: the tags that there are."""
    kind = F.col("tag")
    linked = known is None or "hyperlink" in known
    located = body.withColumns({
        "p": F.coalesce(F.when(kind == "p", F.col("node_id")), nearest("p")), "r": F.coalesce(F.when(kind == "r", F.col("node_id")), nearest("r")), "link": F.coalesce(F.when(kind == "hyperlink", F.col("node_id")), nearest("hyperlink")) if linked else absent("bigint"),
        "prop": F.col("prop") if "prop" in body.columns else F.when(is_property(), kind),
    }).where("p IS NOT NULL")
    reached = F.forall(F.filter("above", lambda x: x["node_id"] > F.col("p")), lambda x: x["tag"].isin(*AROUND))
    event = attr("fldCharType").isin("begin", "separate", "end")
    in_run = (above(1) == "r") & kind.isin("t", "tab", "br", "cr", "instrText", "fldChar") & ~((kind == "t") & (F.coalesce("text", F.lit("")) == "")) & ((kind != "fldChar") | event)
    shown = F.when(in_run, F.when(kind.isin("t", "tab"), "text").when(kind == "instrText", "instruction").when(kind == "fldChar", "field").when((kind == "br") & (F.coalesce(attr("type"), F.lit("")) == "page"), "break").otherwise("line"))
    shown = shown.when(kind == "hyperlink", "link").when((kind == "fldSimple") & T.is_page_field(F.coalesce(attr("instr"), F.lit(""))), "page").when((kind == "bookmarkStart") & ~F.coalesce(attr("name"), F.lit("_")).startswith("_"), "mark")
    said = F.when(kind.isin("t", "instrText"), F.col("text")).when(kind == "fldChar", attr("fldCharType")).when(kind == "tab", "\t").when(kind == "bookmarkStart", attr("name"))
    target = F.when(kind == "hyperlink", F.struct(attr("id", R).alias("id"), attr("anchor").alias("anchor"))) if linked else absent("struct<id: string, anchor: string>")
    piece = F.when(shown.isNotNull() & reached, F.struct(F.col("node_id").alias("at"), shown.alias("kind"), said.alias("text"), F.col("link"), target.alias("target"), F.col("end_id").alias("end")))
    is_p = kind == "p"
    in_blocks = F.forall("above", lambda x: x["tag"].isin("document", "body", "tbl", "tr", "tc"))
    place = F.struct(F.col("parent_id").alias("container"), above(1).alias("within"), F.size(F.filter("above", lambda x: x["tag"] == "tbl")).alias("nesting"), in_blocks.alias("is_block"))
    return located.groupBy("doc_id", "p", "r").agg(
        F.max(F.when(is_p, place)).alias("place"), first_under("rPr", "rStyle", attr("val"), known).alias("character"), first_under("pPr", "pStyle", attr("val"), known).alias("style_id"), first_under("numPr", "numId", attr("val"), known).alias("num"),
        F.coalesce(first_under("numPr", "ilvl", whole(attr("val")), known, "bigint"), F.lit(0)).alias("level"), F.collect_list(piece).alias("pieces"), *[c.alias(f) for f, c in style_fields(known).items()],
    )


def resolved_runs(rows: DataFrame, catalog: DataFrame | None, profile: dict) -> DataFrame:
    """runs() with para (place, list, heading and resolved style of the paragraph) and style (the resolved one of the run). catalog: of CATALOGS what there is."""
    held = rows if catalog is None else rows.join(catalog.hint("merge"), "doc_id", "left")
    held = held.withColumns({"set": struct_of()} | {c: absent(kind) for c, kind in CATALOGS.items() if catalog is None or c not in catalog.columns})
    styled = F.try_element_at("paragraph_styles", F.col("style_id"))
    style = layered(F.col("set"), styled, F.col("defaults"))
    name = F.coalesce(styled["style_name"], F.when(styled.isNotNull(), F.col("style_id")))
    level = T.heading_level(name)
    if chosen := {k: v["heading_level"] for k, v in profile.items() if v.get("heading_level") is not None}:
        own = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
        level = F.coalesce(F.when(styled.isNotNull(), F.coalesce(F.try_element_at(own, F.col("style_id")), F.try_element_at(own, styled["style_name"]))), level)
    form = F.coalesce(F.try_element_at("numbers", F.concat_ws(" ", "num", "level")), F.lit("bullet"))
    listed = F.when(F.coalesce(F.map_contains_key("numbers", F.coalesce("num", F.lit(" "))), F.lit(False)), F.struct(F.col("level").cast("int").alias("level"), F.col("num"), form.alias("form")))
    own = F.struct(F.col("place"), style.alias("style"), level.alias("heading"), listed.alias("list"))
    whole_paragraph = Window.partitionBy("doc_id", "p")
    held = held.withColumn("para", F.first(F.when(F.col("r").isNull(), own), ignorenulls=True).over(whole_paragraph)).where("para.place.is_block")
    return held.withColumn("style", layered(F.col("set"), F.try_element_at("character_styles", F.col("character")), F.col("para.style"), fields=TEXT_FIELDS))


def wrapped(text: Column, style: Column) -> Column:
    """Escaped text in what its style calls for."""
    calls = [
        F.when(style["color"].isNotNull(), F.concat(F.lit("#text(fill: "), U.render_color(style["color"]), F.lit(")["))),
        F.when(style["font"].isNotNull(), F.concat(F.lit('#text(font: "'), T.escape_string(style["font"]), F.lit('")['))),
        F.when(style["size"].isNotNull(), F.concat(F.lit("#text(size: "), U.points(style["size"], 2), F.lit(")["))),
        *[F.when(style[f], F.lit(f"#{name}[")) for f, name in FLAGS],
    ]
    n = reduce(lambda x, y: x + y, [F.when(c.isNotNull(), 1).otherwise(0) for c in calls])
    return F.concat(F.concat_ws("", *calls), text, F.repeat(F.lit("]"), n))


def without_fields(pieces: DataFrame) -> DataFrame:
    """pieces without their fields' events and instructions, with a `page` where a field shows the page's number.

    A field is a stretch of pieces: begin, its instruction, separate, its result, end; each link has fields of its own.
    What stands between begin and separate is never shown, and neither is the result of a page number. A separate counts
    only right after a begin, with the instruction gathered since then.
    """
    kind, text = F.col("kind"), F.col("text")
    event = F.coalesce(kind == "field", F.lit(False))
    ordered = Window.partitionBy("doc_id", "p", "link").orderBy("at")
    until, before = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)
    told = pieces.withColumn("stretch", F.sum(event.cast("int")).over(until))
    instruction = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == "instruction", F.struct("at", "text"))).over(Window.partitionBy("doc_id", "p", "link", "stretch"))), lambda x: x["text"]), "")
    told = told.withColumn("instruction", F.when(event, instruction))
    told = told.withColumn("last", F.last(F.when(event, F.struct("text", "instruction")), ignorenulls=True).over(before))
    numbers = event & (text == "separate") & F.coalesce((F.col("last.text") == "begin") & T.is_page_field(F.col("last.instruction")), F.lit(False))
    told = told.withColumn("numbers", numbers)
    hides = F.last(F.when(event, (text == "begin") | F.col("numbers")), ignorenulls=True).over(until)
    # what lies in a simple field that shows the page's number
    covered = F.max(F.when(kind == "page", F.col("end"))).over(Window.partitionBy("doc_id", "p").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("hidden", F.coalesce(hides & kind.isin("text", "line", "break"), F.lit(False)) | F.coalesce(covered >= F.col("at"), F.lit(False)))
    kept = told.where("NOT hidden AND (kind IS NULL OR kind NOT IN ('field', 'instruction') OR numbers)")
    return kept.withColumn("kind", F.when(F.col("numbers"), "page").otherwise(kind)).withColumn("text", F.when(~F.col("numbers"), text)).drop("stretch", "instruction", "last", "numbers", "hidden", "end")


def paragraphs(rows: DataFrame, fields: bool = True, links: bool = True) -> DataFrame:
    """doc_id, p, para, content (with MARK where a page breaks) and shows, from resolved_runs(). fields, links: whether there may be any."""
    keep = lambda c: F.first(c, ignorenulls=True).alias(c)
    plain = None
    if not fields and not links:
        # most paragraphs are one text, or none: nothing is to be put together then
        rows = cut_off(rows.withColumn("n_pieces", F.sum(F.size("pieces")).over(Window.partitionBy("doc_id", "p"))))
        one = rows.where("n_pieces = 0 AND r IS NULL OR n_pieces = 1 AND size(pieces) = 1").withColumn("x", F.get("pieces", F.lit(0)))
        one = one.select("doc_id", "p", "para", "style", "x.kind", "x.text", "x.link")
        plain = one.select("doc_id", "p", "para", said_of(F.coalesce("text", F.lit(""))).alias("content"), F.coalesce(F.col("kind").isNotNull() & (F.col("kind") != "mark"), F.lit(False)).alias("shows"))
        rows = rows.where("n_pieces > 1")
    pieces = rows.select("doc_id", "p", "para", "style", "targets", F.explode_outer("pieces").alias("x")).select("doc_id", "p", "para", "style", "targets", "x.*")
    pieces = without_fields(pieces) if fields else pieces.drop("end")
    pieces = pieces.withColumn("alone", F.when(~F.coalesce(F.col("kind") == "text", F.lit(False)), F.coalesce("at", F.lit(-1))))
    parts = sequences.adjacent_runs(pieces, ["doc_id", "p"], ["at"], ["alone", "link", "style"], "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"]), "")
    merged = parts.groupBy("doc_id", "p", "part").agg(F.min("at").alias("at"), *map(keep, ("para", "kind", "link", "style", "target", "targets")), text.alias("text"))
    merged = merged.withColumns({"said": said_of(F.col("text")), "held": F.coalesce(~F.col("kind").isin("link"), F.lit(False)), "shown": F.coalesce(~F.col("kind").isin("link", "mark"), F.lit(False))})
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "")
    if links:
        strings = merged.groupBy("doc_id", "p", F.coalesce("link", "at").alias("place")).agg(*map(keep, ("para", "link", "target", "targets")), F.bool_or("held").alias("held"), F.bool_or("shown").alias("shown"), joined.alias("said"))
        named = F.coalesce(F.try_element_at("targets", F.col("target.id")), F.col("target.id"), F.concat(F.lit("#"), "target.anchor"), F.lit(""))
        is_link = F.col("link").isNotNull()
        linked = F.when(is_link & ((named != "") | F.col("held")), F.concat(F.lit('#link("'), T.escape_string(named), F.lit('")['), "said", F.lit("]"))).when(~is_link, F.col("said")).otherwise("")
        shows = F.when(is_link, (named != "") | F.col("held")).otherwise(F.col("shown"))
        strings = strings.select("doc_id", "p", "para", "place", linked.alias("said"), shows.alias("shows"))
    else:  # each part stands for itself
        strings = merged.select("doc_id", "p", "para", F.col("at").alias("place"), "said", F.col("shown").alias("shows"))
    whole_ = strings.groupBy("doc_id", "p").agg(keep("para"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "").alias("content"), F.bool_or("shows").alias("shows"))
    return whole_ if plain is None else whole_.unionByName(plain)


def said_of(text: Column) -> Column:
    """What a piece writes, by its kind, link and style; text: that of all pieces it stands for."""
    said = F.when(F.col("kind") == "text", wrapped(T.escape_markup(text), F.col("style"))).when(F.col("kind") == "line", "\\\n").when(F.col("kind") == "break", F.when(F.col("link").isNull(), MARK).otherwise("#pagebreak()"))
    said = said.when(F.col("kind") == "page", wrapped(F.lit("#context counter(page).display()"), F.col("style")))
    return F.coalesce(said.when(F.col("kind") == "mark", F.concat(F.lit("#metadata(none) <"), text, F.lit(">"))), F.lit(""))


def paragraph_blocks(found: DataFrame) -> DataFrame:
    """doc_id, at, container, within, nesting, list, text and attaches, of the paragraphs and headings that show or hold something."""
    style, listed, heading = F.col("para.style"), F.col("para.list"), F.col("para.heading")
    layout = style["before"].isNotNull() | style["after"].isNotNull() | style["line"].isNotNull() | F.coalesce(style["break_before"], F.lit(False)) | F.coalesce(style["keep_next"], F.lit(False))
    in_cell = F.col("para.place.within") == "tc"
    broken = F.when(in_cell, F.lit(BREAKS["none"])).when(listed.isNotNull() & heading.isNull(), F.lit(BREAKS["column"])).otherwise(F.lit(BREAKS["page"]))
    segments = F.split("content", MARK)
    between = lambda i: F.when(i > 0, broken)
    space = lambda twips: F.concat(F.lit("#v("), U.twips(twips), F.lit(")"))
    empty = space(F.coalesce(style["line"], style["size"] * 10, F.lit(240)))
    opened = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIGNED.items() for x in pair]), style["align"]), F.lit(""))
    aligned = lambda x: F.concat(opened, x, F.when(opened != "", "]").otherwise(""))
    body = F.array_join(F.transform(segments, lambda x, i: F.concat_ws("\n", between(i), F.when(T.trim_space(x) != "", aligned(x)).otherwise(empty))), "\n")
    plain = F.concat_ws("\n", F.when(style["break_before"], broken), F.when(style["before"] > 0, space(style["before"])), body, F.when(style["after"] > 0, space(style["after"])))
    title = lambda x: F.when(T.trim_space(x) != "", F.concat(F.repeat(F.lit("="), heading), F.lit(" "), T.trim_space(x)))
    headed = F.array_join(F.filter(F.transform(segments, lambda x, i: F.concat_ws("\n", between(i), title(x))), lambda x: x != ""), "\n")
    text = T.trim_end(F.when(heading.isNotNull(), headed).otherwise(plain))
    kept = found.where(F.col("shows") | listed.isNotNull() | layout)
    return kept.select("doc_id", F.col("p").alias("at"), "para.place.container", "para.place.within", "para.place.nesting", F.when(heading.isNull(), listed).alias("list"), text.alias("text"), F.lit(False).alias("attaches"))


#: Tags that are asked for by name below and in style_fields().
LOOKED_FOR = (
    "color", "rFonts", "sz", "b", "i", "u", "strike", "vertAlign", "highlight", "jc", "spacing", "pageBreakBefore", "keepNext", "rStyle", "pStyle", "numId", "ilvl", "hyperlink", "fldChar", "fldSimple", "instrText", "sectPr", "gridSpan", "vMerge", "shd", "vAlign",
    "tcW", "tcBorders", "tcMar", "tblBorders", "tblCellMar", "top", "right", "end", "bottom", "left", "start", "insideH", "insideV", "tblLook", "cnfStyle", "tblInd", "tblCellSpacing", "tblW",
)


def border_line() -> Column:
    """A border as markup writes it; null where the node sets nothing."""
    names = ("val", "sz", "color", "themeColor")
    width = F.coalesce(U.points(whole(attr("sz")), 8), F.lit("1pt"))
    color = given(attr("color"))
    line = F.when(F.coalesce(attr("val"), F.lit("")).isin("none", "nil"), "none").otherwise(F.concat(width, F.when(color.isNotNull(), F.concat(F.lit(" + "), U.render_color(color))).otherwise("")))
    return F.when(F.coalesce(*[attr(n) for n in names]).isNotNull(), line)


def sides(under: str, sides_: dict, value: Column) -> Column:
    """A struct of what the nodes below `under` set for each side, the first name of a side before the second."""
    return F.struct(*[F.coalesce(*[first_under(under, n, value) for n in names]).alias(side) for side, names in sides_.items()])


BORDER_SIDES = {"top": ("top",), "right": ("right", "end"), "bottom": ("bottom",), "left": ("left", "start")}
INNER_SIDES = {"inside_h": ("insideH",), "inside_v": ("insideV",)}


def measure(prefix: str, tag: str, under: str, known: frozenset | None = None) -> list[Column]:
    """Width in twips, and as fiftieths of a percent."""
    size, kind = whole(attr("w")), F.coalesce(attr("type"), F.lit("dxa"))
    return [first_under(under, tag, F.nullif(F.when(~kind.isin("auto", "nil", "pct"), size), F.lit(0)), known, "bigint").alias(prefix), first_under(under, tag, F.nullif(F.when(kind == "pct", size), F.lit(0)), known, "bigint").alias(f"{prefix}_share")]


def table_rows(body: DataFrame, known: frozenset | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables (doc_id, tbl and what they set) and their cells (doc_id, tbl, row, place and what they set), from the nodes of the body. known: the tags that there are."""
    kind = F.col("tag")
    # read once for each node: the aggregates ask for them again and again
    up, up2, val, size, line = (F.col(f"_{n}") for n in ("up", "up2", "val", "size", "line"))
    body = body.withColumns({"_up": above(1), "_up2": above(2)}).withColumns({"_val": attr("val"), "_size": whole(attr("w")), "_line": F.when(up.isin("tcBorders", "tblBorders"), border_line())})
    there = lambda *tags: known is None or known.issuperset(tags)
    first_under = lambda under, tag, value, of="string": F.min_by(value, F.when((kind == tag) & (up == under), F.col("node_id"))) if there(tag) else absent(of)
    sides = lambda under, sides_, value, of="string": F.struct(*[F.coalesce(*[first_under(under, n, value, of) if there(under) else absent(of) for n in names]).alias(side) for side, names in sides_.items()])
    in_blocks = F.forall("above", lambda x: x["tag"].isin("document", "body", "tbl", "tr", "tc"))
    cell = F.coalesce(F.when(kind == "tc", F.col("node_id")), nearest("tc"))
    own = (kind == "tc") & in_blocks | (up == "tcPr") | (up2 == "tcPr")
    numbers = lambda i: F.max(F.when(kind == "tc", F.regexp_extract("path", r"/tr\[(\d+)\]/tc\[(\d+)\]$", i).try_cast("long")))
    merge = first_under("tcPr", "vMerge", F.coalesce(val, F.lit("continue")))
    fill = first_under("tcPr", "shd", F.when(attr("fill") != "auto", U.hex_color(attr("fill"))))
    cells = body.where(own).groupBy("doc_id", cell.alias("tc")).agg(
        F.max(F.when(kind == "tc", nearest("tbl"))).alias("tbl"), F.max(F.when(kind == "tc", up == "tr")).alias("in_row"), F.max(F.when(kind == "tc", F.col("parent_id"))).alias("tr"), numbers(1).alias("row"), numbers(2).alias("place"), F.coalesce(first_under("tcPr", "gridSpan", whole(val), "bigint"), F.lit(1)).alias("span"), merge.alias("merge"), fill.alias("fill"),
        first_under("tcPr", "vAlign", val).alias("valign"), sides("tcBorders", BORDER_SIDES, line).alias("lines"), sides("tcMar", BORDER_SIDES, size, "bigint").alias("insets"), *measure("width", "tcW", "tcPr", known),
    ).where("tbl IS NOT NULL AND in_row")
    mine = F.coalesce(F.when(kind == "tbl", F.col("node_id")), nearest("tbl"))
    is_tbl = (kind == "tbl") & in_blocks
    at_table = is_tbl | (up.isin("tblPr", "tblGrid")) | (up2 == "tblPr") | ((up == "tbl") & (kind == "tr")) | ((up2 == "tr") & (kind == "cnfStyle"))
    row_number = F.regexp_extract("path", r"/tr\[(\d+)\](/trPr\[1\]/cnfStyle\[1\])?$", 1).try_cast("long")
    grid = F.array_sort(F.collect_list(F.when((kind == "gridCol") & (up == "tblGrid"), F.struct(F.col("node_id"), size.alias("w")))))
    tables = body.where(at_table).groupBy("doc_id", mine.alias("tbl")).agg(
        F.max(F.when(is_tbl, F.struct(F.col("parent_id").alias("container"), above(1).alias("within"), F.size(F.filter("above", lambda x: x["tag"] == "tbl")).alias("nesting")))).alias("where"), F.transform(grid, lambda x: x["w"]).alias("grid"), F.count_if((kind == "tr") & (up == "tbl")).alias("n_rows"),
        (F.collect_set(F.when((kind == "cnfStyle") & (attr("firstRow") == "1"), row_number)) if there("cnfStyle") else F.array().cast("array<bigint>")).alias("headed"), F.coalesce(first_under("tblPr", "tblLook", attr("firstRow")) == "1", F.lit(False)).alias("head_first"), first_under("tblPr", "jc", val).alias("align"),
        first_under("tblPr", "tblInd", whole(attr("w"), signed=True), "bigint").alias("indent"), sides("tblBorders", BORDER_SIDES | INNER_SIDES, line).alias("edges"), sides("tblCellMar", BORDER_SIDES, size, "bigint").alias("margins"), *measure("spacing", "tblCellSpacing", "tblPr", known), *measure("wide", "tblW", "tblPr", known),
    ).where(F.col("where").isNotNull())
    return tables, cells


def inset_list(insets: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit(f"{s}: "), F.coalesce(U.twips(insets[s]), F.lit("0pt"))) for s in SIDES]), F.lit(")"))


def any_side(insets: Column) -> Column:
    return F.coalesce(*[insets[s] for s in SIDES]).isNotNull()


def placed_cells(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """The visible cells with their columns, row spans and their table's columns."""
    # dealt once for both windows and the join
    placed = spread(place_cells(cells, ["doc_id", "tbl"], "row", "place", "span", "merge"), "doc_id", "tbl")
    spans = Window.partitionBy("doc_id", "tbl", "row")
    whole_table = Window.partitionBy("doc_id", "tbl")
    placed = placed.withColumn("_sum", F.sum("span").over(spans)).withColumn("widest", F.max("_sum").over(whole_table)).drop("_sum")
    return placed.where("NOT hidden").join(tables.hint("merge"), ["doc_id", "tbl"]).withColumn("n_columns", F.when(F.size("grid") > 0, F.size("grid")).otherwise(F.greatest("widest", F.lit(1))))


def rendered_tables(tables: DataFrame, cells: DataFrame, contents: DataFrame, widths_set: bool = True) -> DataFrame:
    """doc_id, at, container, within, nesting, list, text and attaches of tables; contents: doc_id, container and text of their cells; widths_set: whether cells may set widths."""
    found = cells.join(contents.select("doc_id", F.col("container").alias("tc"), F.col("text").alias("content")).hint("merge"), ["doc_id", "tc"], "left")
    row, at = F.col("row") - 1, F.col("column_index")
    word_default = (F.col("margins.top") == 0) & (F.col("margins.bottom") == 0) & F.coalesce((F.abs(F.col("margins.left") - 108) <= 12) & (F.abs(F.col("margins.right") - 108) <= 12), F.lit(False))
    margins = F.when(any_side(F.col("margins")) & ~F.coalesce(word_default, F.lit(False)), F.col("margins"))
    places = {"top": (row == 0, "inside_h"), "right": (at + F.col("span") >= F.col("n_columns"), "inside_v"), "bottom": (row + 1 >= F.col("n_rows"), "inside_h"), "left": (at == 0, "inside_v")}
    strokes = F.concat_ws(", ", *[F.concat(F.lit(f"{s}: "), edge(f"lines.{s}", "edges", is_edge, s, inner)) for s, (is_edge, inner) in places.items()])
    both = F.struct(*[F.coalesce(F.col(f"insets.{s}"), margins[s]).alias(s) for s in SIDES])
    vertical = F.try_element_at(F.create_map(*[F.lit(x) for pair in VERTICAL.items() for x in pair]), F.col("valign"))
    told = F.concat_ws(
        ", ", F.when(F.col("span") > 1, F.concat(F.lit("colspan: "), "span")), F.when(F.col("row_span") > 1, F.concat(F.lit("rowspan: "), "row_span")), F.concat(F.lit("fill: "), U.render_color(F.col("fill"))), F.when(strokes != "", F.concat(F.lit("stroke: ("), strokes, F.lit(")"))),
        F.when(any_side(F.col("insets")), F.concat(F.lit("inset: "), inset_list(both))), F.concat(F.lit("align: "), vertical),
    )
    said = F.coalesce(F.when(T.trim_space(F.col("content")) != "", F.col("content")), F.lit(" "))
    cell = F.when(told != "", F.concat(F.lit("table.cell("), told, F.lit(")["), said, F.lit("]"))).otherwise(F.concat(F.lit("["), said, F.lit("]")))
    width = F.coalesce("width", F.col("width_share") * 2)
    found = found.withColumns({"cell": cell, "known": width, "gap": margins, "last": row + F.col("row_span")})
    slots = found.where(F.size("grid") == 0).where("known IS NOT NULL AND span > 0").select("doc_id", "tbl", "column_index", "span", "known")
    widths = column_widths(slots, ["doc_id", "tbl"], "column_index", "span", "known").groupBy("doc_id", "tbl").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("long"), "width"))).alias("widths"))
    in_row = Window.partitionBy("doc_id", "tbl", "row")
    entry = F.struct("row", "place", "cell", "last")
    rows = found.withColumn("shown", F.sum("span").over(in_row)).groupBy("doc_id", "tbl").agg(F.array_sort(F.collect_list(entry)).alias("cells"), F.first("gap", ignorenulls=True).alias("gap"), F.max("shown").alias("n_slots"))
    whole_ = tables.join(rows.hint("merge"), ["doc_id", "tbl"], "left")
    whole_ = whole_.join(widths.hint("merge"), ["doc_id", "tbl"], "left") if widths_set else whole_.withColumn("widths", absent("map<bigint, bigint>"))
    return whole_.select("doc_id", F.col("tbl").alias("at"), "where.*", F.lit(None).cast("struct<level: int, num: string, form: string>").alias("list"), table_markup().alias("text"), F.lit(True).alias("attaches"))


def table_markup() -> Column:
    """A table from its cells in order, its widths and what it sets."""
    n_rows = F.col("n_rows").cast("int")
    is_head = lambda i: F.array_contains("headed", (i + 1).cast("long")) | (F.col("head_first") & (i == 0))
    indices = F.when(n_rows > 0, F.sequence(F.lit(0), n_rows - 1)).otherwise(F.array().cast("array<int>"))
    leading = F.coalesce(F.array_min(F.filter(indices, lambda i: ~is_head(i))), n_rows)
    cells = F.coalesce("cells", F.array().cast("array<struct<row: bigint, place: bigint, cell: string, last: bigint>>"))
    reach = F.coalesce(F.array_max(F.transform(F.filter(cells, lambda c: c["row"] <= leading), lambda c: c["last"])), F.lit(0).cast("long"))
    header = F.when(leading > 0, F.least(F.greatest(leading.cast("long"), reach), n_rows.cast("long"))).otherwise(F.lit(0).cast("long"))
    fr = lambda w: F.coalesce(F.concat(w.cast("string"), F.lit("fr")), F.lit("auto"))
    n_slots = F.greatest(F.coalesce("n_slots", F.lit(0)), F.lit(0)).cast("int")
    slots = F.transform(F.sequence(F.lit(0), F.greatest(n_slots, F.lit(1)) - 1), lambda i: fr(F.try_element_at("widths", i.cast("long"))))
    listed = lambda x: F.concat(F.lit("("), F.array_join(x, ", "), F.lit(")"))
    columns = F.when(F.size("grid") > 0, listed(F.transform("grid", fr))).when(F.col("widths").isNotNull(), listed(slots)).otherwise(F.greatest(n_slots, F.lit(1)).cast("string"))
    lines = lambda some, indent: F.array_join(F.transform(some, lambda c: F.concat(F.lit(indent), c["cell"], F.lit(",\n"))), "")
    head = F.when(header > 0, F.concat(F.lit("  table.header(\n"), lines(F.filter(cells, lambda c: c["row"] <= header), "    "), F.lit("  ),\n"))).otherwise("")
    out = F.concat(
        F.lit("#table(\n  stroke: none,\n"), F.when(F.col("spacing").isNotNull(), F.concat(F.lit("  gutter: "), U.twips(F.col("spacing")), F.lit(",\n"))).otherwise(""), F.when(F.col("gap").isNotNull(), F.concat(F.lit("  inset: "), inset_list(F.col("gap")), F.lit(",\n"))).otherwise(""),
        F.lit("  columns: "), columns, F.lit(",\n"), head, lines(F.filter(cells, lambda c: c["row"] > header), "  "), F.lit(")"),
    )
    size = F.coalesce(U.twips(F.col("wide")), F.concat(U.number(F.col("wide_share") / F.lit(50.0)), F.lit("%")))
    around = [
        F.when(F.col("align").isin("center", "right"), F.concat(F.lit("#align("), "align", F.lit(")["))),
        F.when(F.col("indent") > 0, F.concat(F.lit("#pad(left: "), U.twips(F.col("indent")), F.lit(")["))),
        F.concat(F.lit("#block(width: "), size, F.lit(", breakable: true)[")),
    ]
    # told once, between what opens and what closes: an expression that holds itself twice at each step grows beyond all bounds
    return F.concat(F.concat_ws("", *around), out, F.concat_ws("", *[F.when(x.isNotNull(), "]") for x in around]))


def nested_blocks(blocks: DataFrame, keys: list[str], levels: list[int]) -> DataFrame:
    """blocks with the places of lists.nest()."""
    return lists.nest(blocks.withColumns({"level": F.col("list.level"), "key": F.col("list")}), keys, "at", "level", "key", "attaches", levels)


def container_texts(nested: DataFrame, keys: list[str]) -> DataFrame:
    """keys and text: the blocks of each container as one string, list paragraphs as nested lists."""
    pattern = F.try_element_at(F.create_map(*[F.lit(x) for pair in NUMBERINGS.items() for x in pair]), F.col("list.form"))
    opening = F.when(F.col("list.form") == "bullet", "#list(\n").otherwise(F.concat(F.lit("#enum(\n"), F.coalesce(F.concat(F.lit('  numbering: "'), pattern, F.lit('",\n')), F.lit(""))))
    whole_lists = lists.written(nested, keys, "at", "text", opening).select(*keys, F.col("root_at").alias("at"), F.col("markup").alias("text"))
    plain = nested.where("run IS NULL").select(*keys, "at", "text")
    return sequences.joined_blocks(plain.unionByName(whole_lists), keys, ["at"], F.col("text"), "text")


def typeset(packages: DataFrame | Built, profile: dict | None = None, runtime_file: str = RUNTIME_FILE, max_package_bytes: int | None = None) -> DataFrame:
    """doc_id, status (ok or failed), error, markup, and the numbers of sections, paragraphs and tables outside lists; a row for each package.

    profile: paragraph styles by id or name, with their heading_level. A package without a readable body fails. doc_id
    tells packages apart: two of one name are taken for one. An empty table gives no rows.
    """
    shredded = P.nodes(packages, PARTS, max_package_bytes, columns=NODE_COLUMNS)
    nodes = cut_off(shredded.withColumn("prop", F.when(is_property(), F.col("tag"))))
    body = nodes.where((F.col("part") == BODY) & F.col("tag").isNotNull())
    # what there is, by one pass: what there isn't is neither looked for nor joined
    there = nodes.agg(F.collect_set(F.when(F.col("tag").isin("tbl", *LOOKED_FOR), F.col("tag"))).alias("tags"), F.collect_set(F.when(F.col("part").isin(*PARTS), F.col("part"))).alias("parts")).first()
    known = frozenset(there["tags"])
    catalogs = [of(nodes) for part, of in ((PARTS[1], style_catalog), (PARTS[2], number_catalog), (PARTS[3], link_catalog)) if part in there["parts"]]
    catalog = reduce(lambda a, b: a.join(b, "doc_id", "full"), catalogs) if catalogs else None
    rows = resolved_runs(runs(body, known), catalog, profile or {})
    used = rows.groupBy("doc_id").agg(F.min(F.least(F.coalesce("style.font", "para.style.font"), F.coalesce("para.style.font", "style.font"))).alias("font")) if "rFonts" in known else None
    # without_fields() sorts all pieces twice more, which changes nothing where there are no fields
    fields = not known.isdisjoint(("fldChar", "fldSimple", "instrText"))
    text_blocks = cut_off(paragraph_blocks(paragraphs(rows, fields, "hyperlink" in known)))
    levels = lists.levels_of(text_blocks, "list.level")
    layout = layout_catalog(nodes) if "sectPr" in known else None
    by_document = lambda df, more, columns: df.withColumns({c: absent(kind) for c, kind in columns.items()}) if more is None else df.join(more.hint("merge"), "doc_id", "left")
    in_layout = {"section_ends": "array<bigint>", "page": "string"}

    blocks = text_blocks
    if "tbl" in known:
        tables, cells = table_rows(body, known)
        tables = cut_off(tables)
        deepest = tables.agg(F.max("where.nesting")).first()[0]
        placed = cut_off(placed_cells(tables, cells))
        lower = None
        for level in range(deepest or 0, -1, -1):  # from the innermost tables outwards; each level is of one document's depth
            inner = text_blocks.where(F.col("nesting") == level + 1)
            inner = inner if lower is None else inner.unionByName(lower)
            contents = container_texts(nested_blocks(inner, ["doc_id", "container"], levels), ["doc_id", "container"])
            # several results read a level's tables: each is worked out once
            lower = cut_off(rendered_tables(tables.where(F.col("where.nesting") == level), placed.where(F.col("where.nesting") == level), contents, "tcW" in known))
        blocks = text_blocks.where("nesting = 0").unionByName(lower)
    sectioned = by_document(blocks, layout, in_layout).withColumn("section", F.size(F.filter(F.coalesce("section_ends", F.array().cast("array<bigint>")), lambda e: e < F.col("at"))))
    top = nested_blocks(sectioned.drop("section_ends", "page"), ["doc_id", "section"], levels)
    counts = top.where("run IS NULL").groupBy("doc_id").agg(F.count_if(~F.col("attaches")).alias("paragraphs"), F.count_if("attaches").alias("tables"))
    texts = container_texts(top, ["doc_id", "section"])
    ends = texts.where("text <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("all"))
    wrong = F.max_by("error", F.when(F.col("error").isNotNull() & (F.col("part").isNull() | (F.col("part") == BODY)), F.lit(1)))
    status = nodes.groupBy("doc_id").agg(wrong.alias("error"), F.bool_or((F.col("part") == BODY) & F.col("tag").isNotNull()).alias("read"))
    every = by_document(by_document(P.doc_ids(packages).distinct().join(status.hint("merge"), "doc_id", "left"), layout, in_layout), used, {"font": "string"}).join(ends.hint("merge"), "doc_id", "left").join(counts.hint("merge"), "doc_id", "left")
    font = F.concat(F.lit(f'#import "{runtime_file}": *\n#set text(font: "'), T.escape_string(F.coalesce("font", F.lit(DEFAULT_FONT))), F.lit('")\n'))
    ok = F.coalesce("read", F.lit(False))
    markup = F.when(ok, F.concat(font, F.coalesce("page", F.lit("")), F.lit("\n"), F.coalesce("all", F.lit(""))))
    return every.select("doc_id", F.when(ok, "ok").otherwise("failed").alias("status"), F.when(~ok, F.coalesce("error", F.lit(f"missing part: {BODY}"))).alias("error"), markup.alias("markup"), F.when(ok, F.coalesce(F.size("section_ends"), F.lit(0)) + 1).cast("long").alias("sections"), *[F.when(ok, F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("paragraphs", "tables")])
