"""Queries that drive tables, links, placeholders, run styles, notes and page set-up of whole packages, built from the tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from quire.operators import tree
from quire.plans import convert as C
from quire.plans.queries import _MARKUP, query, read
from quire.plans.typeset import typeset
from quire.sources import build as B

#: How all markup begins without a page set-up.
TOP = "'#import \"runtime.typ\": *' || chr(10) || '#set text(font: \"Libertinus Serif\")' || chr(10)"
_TRIMMED = "regexp_replace(" + _MARKUP + r", '\s+$', '')"


def _cell(text: str, props: str = "") -> str:
    return f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{B.paragraph(text)}</w:tc>"


@lru_cache(1024)
def _order_row(first: bool, priority: str, status: str) -> str:
    merge = '<w:vMerge w:val="restart"/>' if first else "<w:vMerge/>"
    merged = _cell("all" if first else "", merge + '<w:vAlign w:val="center"/>')
    urgent = '<w:tcBorders><w:bottom w:val="double" w:sz="4" w:color="00FF00"/></w:tcBorders>' if priority.startswith("1") else ""
    return f"<w:tr>{merged}{_cell(priority, urgent)}{_cell(status)}</w:tr>"


def order_packages(spark, sf_dir) -> B.Built:
    """A package for each customer with orders: a table with a spanning head, a merged column, and borders by priority."""
    orders = B.spread(read(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))

    def make(row):
        found = row["orders"]
        grid = '<w:tblGrid><w:gridCol w:w="1440"/><w:gridCol w:w="2880"/><w:gridCol w:w="720"/></w:tblGrid>'
        borders = '<w:tblPr><w:tblBorders><w:top w:val="single" w:sz="8" w:color="FF0000"/></w:tblBorders></w:tblPr>'
        head = f"""<w:tr>{_cell(f"Customer {row['doc_id']}", '<w:gridSpan w:val="3"/><w:shd w:val="clear" w:fill="DDEEFF"/>')}</w:tr>"""
        body = "".join(_order_row(i == 0, x["o_orderpriority"], x["o_orderstatus"]) for i, x in enumerate(found))
        return {"word/document.xml": B.document(f"<w:tbl>{borders}{grid}{head}{body}</w:tbl>")}

    return B.Built(orders, make)


def from_orders(spark, sf_dir):
    """order_packages() as rows of packages."""
    built = order_packages(spark, sf_dir)
    return B.build(built.rows, built.make)


@query(
    f"""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
  CASE WHEN o_orderpriority LIKE '1%' THEN '  table.cell(stroke: (bottom: 0.5pt + rgb("#00FF00")))[' ELSE '  [' END || {_TRIMMED.format("o_orderpriority")} || '],' || chr(10) || '  [' || o_orderstatus || '],' || chr(10) AS cells FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS paragraphs,
  {TOP} || chr(10) || '#table(' || chr(10) || '  stroke: none,' || chr(10) || '  columns: (1440fr, 2880fr, 720fr),' || chr(10)
  || '  table.cell(colspan: 3, fill: rgb("#DDEEFF"), stroke: (top: 1pt + rgb("#FF0000")))[Customer ' || o_custkey || '],' || chr(10)
  || string_agg(CASE WHEN i > 1 THEN '' WHEN n > 1 THEN '  table.cell(rowspan: ' || n || ', align: horizon)[all],' || chr(10) ELSE '  table.cell(align: horizon)[all],' || chr(10) END || cells, '' ORDER BY i) || ')' || chr(10) AS markup
FROM r GROUP BY o_custkey"""
)
def order_tables(spark, sf_dir):
    """Tables with spans, merges, fills and borders."""
    return typeset(order_packages(spark, sf_dir)).select("doc_id", "tables", "paragraphs", "markup")


@query(f"""SELECT CAST(page_id AS VARCHAR) AS doc_id, {TOP} || chr(10) || '#link("' || replace(replace(url, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '")[' || {_MARKUP.format("url")} || ']' || chr(10) AS markup FROM pages WHERE url IS NOT NULL""")
def page_links(spark, sf_dir):
    """Links through external relationships."""

    def make(row):
        return {"word/document.xml": B.document(f'<w:p><w:hyperlink r:id="h1">{B.run(row["url"])}</w:hyperlink></w:p>'), "word/_rels/document.xml.rels": B.relationships({"h1": (row["url"], "External")})}

    pages = read(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("doc_id"), "url")
    return typeset(B.build(B.spread(pages, "doc_id"), make)).select("doc_id", "markup")


CHART = '<w:r><w:drawing><x:graphicData xmlns:x="u" uri="http://schemas.openxmlformats.org/drawingml/2006/chart"/></w:drawing></w:r>'
EQUATION = '<m:oMath xmlns:m="u"><m:t>x+1</m:t></m:oMath>'


@query(
    f"""
WITH l AS (SELECT doc_id, toxic = 1 AS chart FROM labels WHERE toxic IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN chart THEN 'drawing:chart' ELSE 'equation:omml_equation' END AS inventory, 'DOCX_FALLBACK_RENDERED_ASSET' AS codes, 'warning' AS severities,
  CASE WHEN chart THEN '/document[1]/body[1]/p[1]/r[1]/drawing[1]' ELSE '/document[1]/body[1]/p[1]/oMath[1]' END AS paths, 'assets/asset-fallback-1.svg' AS files, 'image/svg+xml' AS kinds, true AS structure_ok FROM l"""
)
def label_fallbacks(spark, sf_dir):
    """What can't be shown: charts for toxic documents, equations for others, with their diagnostics and assets."""
    labels = read(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    made = C.convert(B.Built(B.spread(labels, "doc_id"), lambda row: {"word/document.xml": B.document(f"<w:p>{CHART if row['toxic'] == 1 else EQUATION}</w:p>")}))
    told = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    rows = made.select(
        "doc_id", F.array_join("fallback_inventory", ",").alias("inventory"), told("diagnostics", "code").alias("codes"), told("diagnostics", "severity").alias("severities"), told("diagnostics", "path").alias("paths"),
        told("assets", "emitted_path").alias("files"), told("assets", "media_type").alias("kinds"), (F.size(C.syntax_diagnostics(F.col("markup"))) == 0).alias("structure_ok"),
    )
    return rows


#: Run properties by bit, with what they wrap a text in, from the outside.
WRAPS = (
    ('<w:color w:val="FF0000"/>', '#text(fill: rgb("#FF0000"))['), ('<w:sz w:val="28"/>', "#text(size: 14pt)["), ("<w:b/>", "#strong["), ("<w:i/>", "#emph["),
    ('<w:u w:val="single"/>', "#underline["), ("<w:strike/>", "#strike["), ('<w:vertAlign w:val="superscript"/>', "#super["),
)
_OPEN = " || ".join(f"CASE WHEN (turn * 37 + conv_id) & {1 << i} > 0 THEN '{opened}' ELSE '' END" for i, (_, opened) in enumerate(WRAPS))
_CLOSE = f"repeat(']', bit_count(CAST((turn * 37 + conv_id) & {(1 << len(WRAPS)) - 1} AS INTEGER)))"


@query(
    f"""
WITH t AS (SELECT conv_id, turn, {_OPEN} || {_MARKUP.format("'turn ' || turn || ' of ' || role")} || {_CLOSE} AS block FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS paragraphs, {TOP} || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markup FROM t GROUP BY conv_id"""
)
def run_styles(spark, sf_dir):
    """Direct properties of runs in all combinations, nested in their order."""

    def make(row):
        bits = lambda t: (t["turn"] * 37 + row["doc_id_n"]) & ((1 << len(WRAPS)) - 1)
        return {"word/document.xml": B.document("".join(B.paragraph(f"turn {t['turn']} of {t['role']}", "", "".join(p for i, (p, _) in enumerate(WRAPS) if bits(t) >> i & 1)) for t in row["turns"]))}

    turns = B.spread(read(spark, sf_dir, "conversations"), "conv_id").groupBy(F.col("conv_id").alias("doc_id")).agg(F.first("conv_id").alias("doc_id_n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return typeset(B.build(turns, make)).select("doc_id", "paragraphs", "markup")


_INCHES = "rtrim(rtrim(printf('%.4f', {}), '0'), '.') || 'in'"


@query(
    f"""
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, {TOP} || '#set page(width: 8.5in, height: 11in, margin: (top: 1in, right: ' || {_INCHES.format("(c_nationkey + 1) * 90 / 1440.0")} || ', bottom: 1in, left: ' || {_INCHES.format("(c_custkey % 16 + 1) * 45 / 1440.0")}
  || '), header: [#docx-header[' || {_TRIMMED.format("c_name")} || ']], )' || chr(10) || chr(10) || {_MARKUP.format("c_mktsegment")} || '#footnote[' || {_MARKUP.format("c_name")} || ']' || chr(10) AS markup FROM customer"""
)
def page_setups(spark, sf_dir):
    """Page sizes, margins, headers and notes."""

    def make(row):
        margins = f'<w:pgMar w:top="1440" w:bottom="1440" w:right="{(row["c_nationkey"] + 1) * 90}" w:left="{(row["doc_id_n"] % 16 + 1) * 45}"/>'
        section = f'<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:pgSz w:w="12240" w:h="15840"/>{margins}</w:sectPr>'
        body = f'<w:p>{B.run(row["c_mktsegment"])}<w:r><w:footnoteReference w:id="2"/></w:r></w:p>{section}'
        return {
            "word/document.xml": B.document(body), "word/_rels/document.xml.rels": B.relationships({"h": ("header1.xml", None)}),
            "word/header1.xml": f"<w:hdr {B.WORD}>{B.paragraph(row['c_name'])}</w:hdr>",
            "word/footnotes.xml": f'<w:footnotes {B.WORD}><w:footnote w:id="2">{B.paragraph(row["c_name"])}</w:footnote></w:footnotes>',
        }

    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("doc_id_n"), "c_nationkey", "c_name", "c_mktsegment")
    return C.convert(B.Built(B.spread(customers, "doc_id"), make)).select("doc_id", "markup")


@query(
    f"""
WITH n AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS doc_id, orders + 1 AS rows_, 3 * orders + 1 AS cells, 3 * orders + 1 AS texts_in_rows FROM n"""
)
def nodes_within(spark, sf_dir):
    """Containment join: the cells and paragraphs of a package's table rows."""
    from quire.sources import package as P

    nodes = P.nodes(from_orders(spark, sf_dir), ("word/document.xml",), tags=("tr", "tc", "p"), columns=("doc_id", "node_id", "tag", "above"))
    inside = tree.lies_in(nodes, ("tr",), "row_id")
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return inside.groupBy("doc_id").agg(count("tr").alias("rows_"), count("tc").alias("cells"), count("p").alias("texts_in_rows"))
