"""Queries that drive whole packages, built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.office import font_rights
from quire.plans import convert as C
from quire.plans.page_markup import elements, page_markup
from quire.plans.queries import _MARKUP, query, read, sql_values
from quire.plans.typeset import typeset
from quire.sources import build as B
from quire.sources import package as P
from quire.sources.pages import page_nodes

STYLES = (
    f"<w:styles {B.WORD}><w:style w:type=\"paragraph\" w:styleId=\"Base\"><w:name w:val=\"Base\"/><w:pPr><w:jc w:val=\"center\"/></w:pPr><w:rPr><w:i/></w:rPr></w:style>"
    '<w:style w:type="paragraph" w:styleId="Told"><w:name w:val="Told"/><w:basedOn w:val="Base"/><w:rPr><w:b/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Top"><w:name w:val="heading 2"/></w:style></w:styles>'
)
NUMBERS = f'<w:numbering {B.WORD}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
LISTED = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>'


def from_documents(spark, sf_dir):
    """A package for each document, a paragraph for each line."""

    def make(row):
        return {"word/document.xml": B.document("".join(B.paragraph(line) for line in (row["text"] or "").split("\n")))}

    return B.Built(read(spark, sf_dir, "documents").select("doc_id", "text"), make)


_BLOCKS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN x <> '' AND trim(x, ' ' || chr(9)) = '' THEN '#v(0.1667in)' ELSE regexp_replace(" + _MARKUP.format("x") + r", '\s+$', '') END), lambda x: x <> '')"


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'ok' AS status, '#import \"runtime.typ\": *' || chr(10) || '#set text(font: \"Libertinus Serif\")' || chr(10) || chr(10) || "
    f"CASE WHEN len({_BLOCKS}) > 0 THEN array_to_string({_BLOCKS}, chr(10) || chr(10)) || chr(10) ELSE '' END AS markup, CAST(1 AS BIGINT) AS sections FROM documents"
)
def package_roundtrip(spark, sf_dir):
    """Documents as packages and back."""
    return typeset(from_documents(spark, sf_dir)).select("doc_id", "status", "markup", "sections")


def from_conversations(spark, sf_dir):
    """A package for each conversation: system turns as headings, user turns in an inherited style, others as list items."""
    turns = B.spread(read(spark, sf_dir, "conversations"), "conv_id").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    props = {"system": '<w:pStyle w:val="Top"/>', "user": '<w:pStyle w:val="Told"/>'}

    def make(row):
        body = "".join(B.paragraph(t["text"] or "", props.get(t["role"], LISTED)) for t in row["turns"])
        return {"word/document.xml": B.document(body), "word/styles.xml": STYLES, "word/numbering.xml": NUMBERS}

    return B.Built(turns, make)


@query(
    """
WITH t AS (SELECT conv_id, turn, role, """
    + _MARKUP.format("text")
    + """ AS x, CASE WHEN role IN ('system', 'user') THEN turn ELSE -1 END AS own FROM conversations),
c AS (SELECT *, CASE WHEN own = -1 AND lag(own) OVER (PARTITION BY conv_id ORDER BY turn) = -1 THEN 0 ELSE 1 END AS first FROM t),
r AS (SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c),
b AS (SELECT conv_id, run, CASE WHEN any_value(role) = 'system' THEN '== ' || trim(any_value(x)) WHEN any_value(role) = 'user' THEN '#align(center)[#strong[#emph[' || any_value(x) || ']]]'
  ELSE '#enum(' || chr(10) || '  numbering: "a.",' || chr(10) || string_agg('  [' || regexp_replace(x, '\\s+$', '') || '],' || chr(10), '' ORDER BY turn) || ')' END AS block FROM r GROUP BY conv_id, run)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, '#import "runtime.typ": *' || chr(10) || '#set text(font: "Libertinus Serif")' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY run) || chr(10) AS markup FROM b GROUP BY conv_id"""
)
def styled_roundtrip(spark, sf_dir):
    """Headings, inherited styles and lists of whole packages."""
    return typeset(from_conversations(spark, sf_dir)).select("doc_id", "markup")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(5 AS BIGINT) AS n_parts, 'Base,Told,heading 2' AS styles FROM conversations GROUP BY conv_id")
def inspect_packages(spark, sf_dir):
    found = C.inspect(from_conversations(spark, sf_dir))
    return found.select("doc_id", F.size("package_parts").cast("long").alias("n_parts"), F.array_join("styles", ",").alias("styles"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs, CAST(3 AS BIGINT) AS parts FROM documents")
def package_nodes(spark, sf_dir):
    packages = from_documents(spark, sf_dir)
    per_doc = P.nodes(packages, ("word/document.xml",), tags=("p",), columns=("doc_id", "tag")).groupBy("doc_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"))
    return per_doc.join(P.parts(packages).groupBy("doc_id").agg(F.count("*").alias("parts")), "doc_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, '' AS source_part, CAST(0 AS INTEGER) AS ord, 'rId1' AS rel_id, 'word/document.xml' AS resolved_target FROM conversations GROUP BY conv_id")
def package_relationships(spark, sf_dir):
    return P.relationships(from_conversations(spark, sf_dir)).select("doc_id", "source_part", "ord", "rel_id", "resolved_target")


CODES = [*C.MEANINGS, "NO_SUCH_CODE"]


@query(f"SELECT event_id, code, meaning FROM events JOIN {sql_values([(i, c, C.explain(c)) for i, c in enumerate(CODES)], 'place, code, meaning')} ON event_id % {len(CODES)} = place")
def explain_codes(spark, sf_dir):
    """What the code of each event means; codes are dealt by the events' numbers."""
    code = F.array(*map(F.lit, CODES))
    events = read(spark, sf_dir, "events").select("event_id", F.get(code, (F.col("event_id") % len(CODES)).cast("int")).alias("code"))
    return events.withColumn("meaning", C.explain_column(F.col("code")))


@query("""
SELECT p_partkey, CAST(bits AS INTEGER) AS bits, CASE WHEN bits & 2 > 0 THEN 'restricted' WHEN bits & 8 > 0 THEN 'editable' WHEN bits & 4 > 0 THEN 'preview_print' WHEN bits = 0 THEN 'installable' ELSE 'unknown' END AS rights, bits & 256 > 0 AS no_subsetting, bits & 512 > 0 AS bitmap_only
FROM (SELECT p_partkey, p_partkey % 1024 AS bits FROM part)""")
def embedded_license(spark, sf_dir):
    """A font with one table for each part, with all rights that its bits can give."""
    import struct

    import pyarrow as pa

    from quire.plans.session import ship_package

    ship_package(spark)

    def judge(batches):
        for batch in batches:
            fonts = [struct.pack(">IHHHH4sIII", 0x10000, 1, 0, 0, 0, b"OS/2", 0, 28, 10) + struct.pack(">8xH", bits) for bits in batch.column("bits").to_pylist()]
            found = [font_rights(x) for x in fonts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([f[2] for f in found])], names=["p_partkey", "bits", "rights", "no_subsetting", "bitmap_only"])

    bits = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), (F.col("p_partkey") % 1024).cast("int").alias("bits"))
    return bits.mapInArrow(judge, "p_partkey long, bits int, rights string, no_subsetting boolean, bitmap_only boolean")


@query()
def markup_nodes(spark, sf_dir):
    """Pages as nodes with their own texts and their places among siblings of their name."""
    return elements(page_nodes(read(spark, sf_dir, "pages")))


@query()
def page_to_markup(spark, sf_dir):
    """All that pages say as markup blocks."""
    return page_markup(page_nodes(read(spark, sf_dir, "pages")))
