"""Packages as tables of nodes: against plain Python walks of the same trees, tables and lists, and against the reader of single documents."""

import random
import re
from html import unescape
from pathlib import Path

import pytest

from quire.operators import grid, lists, tree
from quire.plans.convert import convert_one
from quire.plans.page_markup import page_blocks, page_markup
from quire.plans.typeset import typeset
from quire.sources import package as P
from quire.sources.build import WORD, document, package, paragraph, relationships, run
from quire.sources.pages import page_nodes

NUMBERING = f'<w:numbering {WORD}>' + "".join(f'<w:abstractNum w:abstractNumId="{i}">' + "".join(f'<w:lvl w:ilvl="{n}"><w:numFmt w:val="{form}"/></w:lvl>' for n, form in enumerate(forms)) + "</w:abstractNum>" for i, forms in ((1, ("decimal", "lowerRoman", "bullet")), (2, ("bullet", "upperLetter")))) + '<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num></w:numbering>'
STYLES = (
    f'<w:styles {WORD}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="21"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:pPr><w:jc w:val="right"/><w:spacing w:before="45"/></w:pPr><w:rPr><w:i/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Told"><w:name w:val="Told"/><w:basedOn w:val="Base"/><w:rPr><w:b/><w:i w:val="0"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Top"><w:name w:val="Heading 3"/><w:basedOn w:val="Told"/></w:style>'
    '<w:style w:type="character" w:styleId="Loud"><w:rPr><w:strike/><w:color w:val="30A0C0"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Loop"><w:basedOn w:val="Loop"/><w:rPr><w:u w:val="single"/></w:rPr></w:style></w:styles>'
)
RELS = relationships({"a": ("https://host.example/?q=one", "External"), "b": ("other.xml", None)})


class Maker:
    """Random bodies out of all that typeset() writes."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def text(self) -> str:
        return " ".join(self.r.choice(["oak", "*elm*", "a/", "/b", "[x]", "ash ", "", "日本", "$5"]) for _ in range(self.r.randint(0, 4)))

    def run(self) -> str:
        props = self.r.choice(["", "<w:b/>", '<w:b w:val="0"/>', '<w:rStyle w:val="Loud"/>', '<w:color w:val="auto"/><w:sz w:val="19"/>', '<w:rFonts w:ascii="Some \'Font\'"/>', '<w:vertAlign w:val="superscript"/><w:u w:val="none"/>', '<w:highlight w:val="yellow"/>'])
        inner = "".join(self.r.choice([f"<w:t>{self.text().replace('&', '')}</w:t>", "<w:tab/>", "<w:br/>", '<w:br w:type="page"/>', "<w:t/>"]) if self.r.random() < 0.3 else f"<w:t>{self.text()}</w:t>" for _ in range(self.r.randint(0, 3)))
        return f"<w:r><w:rPr>{props}</w:rPr>{inner}</w:r>"

    def field(self) -> str:
        steps = [f'<w:fldChar w:fldCharType="{x}"/>' for x in ("begin", "separate", "end")]
        steps[1:1] = [f"<w:instrText>{self.r.choice([' PAGE ', 'page', 'DATE x', 'PA'])}</w:instrText>", self.r.choice(["", "<w:instrText>GE</w:instrText>", "<w:t>asked</w:t>"])]
        steps.insert(-1, "<w:t>shown</w:t>")
        if self.r.random() < 0.4:
            del steps[self.r.randrange(len(steps))]
        if self.r.random() < 0.2:
            steps = steps[:3] + steps + steps[3:]
        return "".join(f"<w:r>{x}</w:r>" for x in steps)

    def inline(self) -> str:
        kind, runs = self.r.random(), "".join(self.run() for _ in range(self.r.randint(0, 2)))
        if kind > 0.85:
            return self.field() if kind > 0.9 else f'<w:fldSimple w:instr="{self.r.choice([" PAGE ", "NUMPAGES"])}">{runs}</w:fldSimple>{runs}'
        if kind < 0.15:
            return f'<w:hyperlink {self.r.choice(["r:id=" + chr(34) + "a" + chr(34), "r:id=" + chr(34) + "gone" + chr(34), "w:anchor=" + chr(34) + "here" + chr(34), "r:id=" + chr(34) + "b" + chr(34), ""])}>{runs}</w:hyperlink>'
        if kind < 0.25:
            return f"<w:smartTag>{runs}</w:smartTag><w:ins>{runs}</w:ins>"
        if kind < 0.32:
            return f'<w:bookmarkStart w:name="{self.r.choice(["mark", "_hidden"])}"/>'
        return runs

    def paragraph(self) -> str:
        props = self.r.choice(["", "", '<w:pStyle w:val="Told"/>', '<w:pStyle w:val="Top"/>', '<w:pStyle w:val="Loop"/>', '<w:pStyle w:val="gone"/>', '<w:jc w:val="both"/>', '<w:spacing w:before="30" w:after="60" w:line="300"/>', "<w:pageBreakBefore/>", "<w:keepNext/>", "<w:rPr><w:i/></w:rPr>"])
        if self.r.random() < 0.5:
            props += f'<w:numPr><w:ilvl w:val="{self.r.choice([0, 0, 1, 1, 2, 4])}"/><w:numId w:val="{self.r.choice([1, 1, 1, 2, 9])}"/></w:numPr>'
        return f"<w:p><w:pPr>{props}</w:pPr>{''.join(self.inline() for _ in range(self.r.randint(0, 3)))}</w:p>"

    def cell(self, depth: int) -> str:
        span = self.r.choice(["", "", '<w:gridSpan w:val="2"/>', '<w:gridSpan w:val="3"/>'])
        merge = self.r.choice(["", "", '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:vMerge w:val="continue"/>'])
        more = "".join(x for x in ('<w:tcW w:w="900" w:type="dxa"/>', '<w:tcW w:w="1500" w:type="pct"/>', '<w:shd w:fill="EEDDCC"/>', '<w:vAlign w:val="center"/>', '<w:tcBorders><w:top w:val="single" w:sz="5" w:color="102030"/><w:start w:val="nil"/></w:tcBorders>', '<w:tcMar><w:left w:w="33"/></w:tcMar>') if self.r.random() < 0.2)
        return f"<w:tc><w:tcPr>{span}{merge}{more}</w:tcPr>{self.blocks(self.r.randint(0, 2), depth + 1)}</w:tc>"

    def table(self, depth: int) -> str:
        props = "".join(x for x in ('<w:tblW w:w="2500" w:type="pct"/>', '<w:tblW w:w="7000"/>', '<w:tblInd w:w="77"/>', '<w:jc w:val="center"/>', '<w:tblCellSpacing w:w="21"/>', '<w:tblLook w:firstRow="1"/>', '<w:tblCellMar><w:top w:w="0"/><w:bottom w:w="0"/><w:left w:w="108"/><w:right w:w="100"/></w:tblCellMar>', '<w:tblBorders><w:top w:val="double" w:sz="9"/><w:insideH w:val="single" w:color="ff00aa"/><w:insideV w:val="none"/><w:right w:val="single" w:sz="4"/></w:tblBorders>') if self.r.random() < 0.25)
        grid_ = "<w:tblGrid>" + "".join(f'<w:gridCol w:w="{w}"/>' for w in (700, 800, 900)) + "</w:tblGrid>" if self.r.random() < 0.4 else ""
        rows = "".join(f"<w:tr>{'<w:trPr><w:cnfStyle w:firstRow=' + chr(34) + '1' + chr(34) + '/></w:trPr>' if self.r.random() < 0.15 else ''}{''.join(self.cell(depth) for _ in range(self.r.randint(1, 4)))}</w:tr>" for _ in range(self.r.randint(0, 4)))
        return f"<w:tbl><w:tblPr>{props}</w:tblPr>{grid_}{rows}</w:tbl>"

    def blocks(self, n: int, depth: int = 0) -> str:
        return "".join(self.table(depth) if self.r.random() < (0.25 if depth < 2 else 0) else self.paragraph() for _ in range(n))

    def body(self) -> str:
        end = '<w:sectPr><w:pgSz w:w="9000" w:h="13000"/><w:pgMar w:top="700" w:left="650" w:header="300"/></w:sectPr>'
        middle = f"<w:p><w:pPr>{end.replace('9000', '8000')}</w:pPr>{run('ends')}</w:p>" if self.r.random() < 0.3 else ""
        return self.blocks(self.r.randint(0, 6)) + middle + self.blocks(self.r.randint(0, 4)) + (end if self.r.random() < 0.5 else "")


def test_documents_of_all_kinds(spark):
    made = {f"d{i}": {"word/document.xml": document(Maker(i).body()), "word/_rels/document.xml.rels": RELS} | ({"word/styles.xml": STYLES, "word/numbering.xml": NUMBERING} if i % 4 else {}) for i in range(80)}
    packages = spark.createDataFrame([(k, bytearray(package(v))) for k, v in made.items()] + [("junk", bytearray(b"PK")), ("none", None), ("broken", bytearray(package({"word/document.xml": "<broken"}))), ("bodyless", bytearray(package({"x.xml": "<x/>"})))], "doc_id string, content binary").repartition(3)
    found = {r["doc_id"]: r for r in typeset(packages, {"Told": {"heading_level": 4}}).collect()}
    assert len(found) == 84
    for name, parts in made.items():
        want = convert_one(package(parts), {"paragraph_styles": {"Told": {"heading_level": 4}}})
        assert found[name]["markup"] == want["markup"], name
        assert [found[name][c] for c in ("status", "sections", "paragraphs", "tables")] == ["ok", want["sections"], want["paragraphs"], want["tables"]], name
    assert {k: found[k]["status"] for k in ("junk", "none", "broken", "bodyless")} == dict.fromkeys(("junk", "none", "broken", "bodyless"), "failed")
    assert "archive" in found["junk"]["error"] and "markup of" in found["broken"]["error"] and "missing part" in found["bodyless"]["error"]
    assert typeset(packages.limit(0)).collect() == []


def brute_cells(rows):
    """Each cell's column, whether it is hidden, and its row span, with the whole table held as a matrix of owners."""
    out, above = {}, []
    for i, row in enumerate(rows):
        at, below = 0, []
        for j, (span, merge) in enumerate(row):
            over = [m for m in above if m["at"] <= at < m["at"] + m["span"]]
            if merge in ("continue", "") and over:
                over[0]["rows"] += 1
                out[i, j] = (at, True, over[0])
                below.append(over[0])
                at += max(span, over[0]["span"])
                continue
            above = [m for m in above if m not in over]
            own = {"at": at, "span": span, "rows": 1, "name": (i, j)}
            out[i, j] = (at, False, own)
            if merge == "restart":
                below.append(own)
            at += span
        above = below
    return {k: (at, hidden, None if hidden else own["rows"]) for k, (at, hidden, own) in out.items()}


def test_cells_of_random_tables(spark):
    r = random.Random(3)
    tables = {t: [[(r.choice([1, 1, 2, 3, 0]), r.choice([None, None, "restart", "continue", ""])) for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 7))] for t in range(60)}
    rows = [(t, i, j, span, merge) for t, table in tables.items() for i, row in enumerate(table) for j, (span, merge) in enumerate(row)]
    r.shuffle(rows)
    found = grid.place_cells(spark.createDataFrame(rows, "t int, i int, j int, span int, merge string"), ["t"], "i", "j", "span", "merge")
    assert {(x["t"], x["i"], x["j"]): (x["column_index"], x["hidden"], x["row_span"]) for x in found.collect()} == {(t, *k): v for t, table in tables.items() for k, v in brute_cells(table).items()}


def brute_lists(blocks):
    """Lists by recursion: (kind, text) or (list key, items); an item is its text and what lies in it."""

    def one(at):
        own, items = blocks[at][1:3], []
        while at < len(blocks) and blocks[at][0] == "item" and blocks[at][1:3] == own:
            item, at = [blocks[at][3]], at + 1
            while at < len(blocks):
                if blocks[at][0] == "item" and blocks[at][1] > own[0]:
                    inner, at = one(at)
                    item.append(inner)
                elif blocks[at][0] == "table":
                    item.append(blocks[at][3])
                    at += 1
                else:
                    break
            items.append(item)
        said = "".join("  [" + "\n\n".join(x for x in item if x) + "],\n" for item in items)
        return f"{own[1]}(\n{said})", at

    out, at = [], 0
    while at < len(blocks):
        if blocks[at][0] == "item":
            said, at = one(at)
            out.append(said)
        else:
            out.append(blocks[at][3])
            at += 1
    return out


def test_lists_of_random_levels(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    docs = {d: [(r.choice(["item", "item", "item", "table", "text"]), r.choice([0, 1, 1, 2, 7]), r.choice("abc"[: r.randint(1, 3)]), r.choice(["x", "y", ""]) if True else "") for _ in range(r.randint(1, 14))] for d in range(120)}
    docs = {d: [(k, n, key, text or ("" if k == "item" else "z")) for k, n, key, text in blocks] for d, blocks in docs.items()}
    rows = [(d, 10 * i, n if k == "item" else None, key if k == "item" else None, k == "table", text) for d, blocks in docs.items() for i, (k, n, key, text) in enumerate(blocks)]
    r.shuffle(rows)
    nested = lists.nest(spark.createDataFrame(rows, "d int, at long, level int, key string, attaches boolean, text string"), ["d"], "at", "level", "key", "attaches").cache()
    whole = lists.written(nested, ["d"], "at", "text", F.concat("key", F.lit("(\n"))).select("d", F.col("root_at").alias("at"), F.col("markup").alias("text"))
    found: dict = {}
    for x in sorted(nested.where("run IS NULL").select("d", "at", "text").unionByName(whole).collect()):
        found.setdefault(x["d"], []).append(x["text"])
    assert found == {d: brute_lists(blocks) for d, blocks in docs.items()}
    flat = lists.nest(spark.createDataFrame([(1, 1, None, None, True, "t"), (1, 2, None, None, False, "p")], "d int, at long, level int, key string, attaches boolean, text string"), ["d"], "at", "level", "key", "attaches")
    assert [x["run"] for x in flat.collect()] == [None, None]


def test_containment_and_visible_text(spark):
    from xml.etree import ElementTree as ET

    docs = {f"d{i}": document(Maker(100 + i).body()) for i in range(12)}
    nodes = P.nodes(spark.createDataFrame([(k, bytearray(package({"word/document.xml": v}))) for k, v in docs.items()], "doc_id string, content binary"), ("word/document.xml",)).cache()
    want, said = set(), {}
    for name, text in docs.items():
        order = list(ET.fromstring(text).iter())
        number = {x: i for i, x in enumerate(order)}
        local = lambda x: x.tag.rsplit("}", 1)[-1]
        for x in order:
            if local(x) in ("tbl", "tr"):
                want |= {(name, number[x], number[y]) for y in x.iter()}
            if local(x) == "tbl":
                said[name, number[x]] = " ".join(s for y in x.iter() if local(y) in ("t", "instrText") and (s := (y.text or "").strip())) or None
    found = tree.within(nodes.where("tag IN ('tbl', 'tr')"), nodes.select("doc_id", "part", "node_id", "above"), "held_by")
    assert {(r["doc_id"], r["held_by"], r["node_id"]) for r in found.collect()} == want and len(want) > 100
    visible = tree.visible_text(nodes.where("tag = 'tbl'"), nodes)
    assert {(r["doc_id"], r["node_id"]): r["visible"] for r in visible.collect()} == said
    ends = {(r["doc_id"], r["node_id"]): r["end_id"] for r in nodes.collect()}
    assert all(ends[d, o] >= i for d, o, i in want)


def test_nothing_is_lost_in_silence(spark):
    good = package({"word/document.xml": document(paragraph("x")), "bad.xml": "<a>", "_rels/bad.xml.rels": "<r"})
    packages = spark.createDataFrame([("good", bytearray(good)), ("junk", bytearray(b"PK")), ("large", bytearray(package({"a.xml": " " * 5000})))], "doc_id string, content binary")
    told = lambda df: {(r["doc_id"], r["part"] if "part" in df.columns else r["source_part"]) for r in df.where("error IS NOT NULL").collect()}
    assert told(P.nodes(packages, max_package_bytes=4000)) == {("good", "bad.xml"), ("good", "_rels/bad.xml.rels"), ("junk", None), ("large", None)}
    assert told(P.parts(packages, max_package_bytes=4000)) == {("junk", None), ("large", None)}
    assert told(P.relationships(packages)) == {("good", "bad.xml"), ("junk", None)}
    assert P.nodes(packages).where("doc_id = 'large' AND part = 'a.xml' AND error IS NOT NULL").count() == 1


PAGE = "<title>no</title><div>before<p>one <b>two<br>three<p>four</b> five<ul><li>a<li>b <i>c</i></ul>after</div><h2>Head<br>line</h2><table><tr><td>1<td>2<tr><th>3</table><script>no</script>&amp;end"


def test_page_blocks(spark):
    nodes = page_nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p></p>")], "page_id long, html string"))
    blocks = [(r["tag"], r["text"]) for r in sorted(page_blocks(nodes).collect(), key=lambda r: r["at"])]
    assert blocks == [("div", "before"), ("p", "one two\nthree"), ("p", "four five"), ("li", "a"), ("li", "b c"), ("div", "after"), ("h2", "Head\nline"), ("td", "1"), ("td", "2"), ("th", "3"), (None, "&end")]
    found = {r["doc_id"]: r["markup"] for r in page_markup(nodes, "\\\n").collect()}
    assert found["1"] == "before\n\none two\\\nthree\n\nfour five\n\n- a\n\n- b c\n\nafter\n\n== Head line\n\n1\n\n2\n\n3\n\n&end" and found["4"] == "" and set(found) == {"1", "4"}


def test_all_that_pages_say(spark):
    """Against tags taken out by patterns, over a whole given table."""
    folder = Path("/root/testdata/sf0.001/pages.parquet")
    if not folder.exists():
        pytest.skip("no test data here")
    pages = spark.read.parquet(str(folder))
    inner = re.compile(r"</?(b|i|a|br)\b[^>]*>")
    found: dict = {}
    for r in sorted(page_blocks(page_nodes(pages)).collect(), key=lambda r: (r["doc_id"], r["at"])):
        found.setdefault(r["doc_id"], []).append("".join(r["text"].split()))
    for r in pages.collect():
        text = re.sub(r"(?s)<!--.*?-->|<head>.*?</head>|<!DOCTYPE[^>]*>|<(script|style)>.*?</\1>", "", r["html"])
        blocks = [unescape(inner.sub(" ", x)) for x in re.split(r"<(?!/?(?:b|i|a|br)\b)[^>]*>", text)]
        assert found.get(str(r["page_id"]), []) == [y for x in blocks if (y := "".join(x.split()))]


def test_borders_by_table_styles(spark):
    from quire.operators.body import Body
    from quire.operators.markup import line
    from quire.operators.office import FLAGS, REGIONS, Catalogs, Package
    from quire.plans.table_styles import cell_borders

    r = random.Random(12)
    size = lambda: f'w:val="{r.choice(["single", "double", "nil"])}" w:sz="{r.randint(1, 30)}"{r.choice(["", " w:color=" + chr(34) + "0a0b0c" + chr(34)])}'
    borders = lambda tag, names: f"<w:{tag}>" + "".join(f"<w:{n} {size()}/>" for n in names if r.random() < 0.35) + f"</w:{tag}>"
    outer = ("top", "left", "bottom", "right", "start", "end")
    inner = (*outer, "insideH", "insideV")
    region = lambda name: f'<w:tblStylePr w:type="{name}"><w:tblPr>{borders("tblBorders", inner)}</w:tblPr><w:tcPr>{borders("tcBorders", outer)}</w:tcPr></w:tblStylePr>'

    def style(name, parent):
        bands = "".join(f'<w:{t} w:val="{r.randint(0, 3)}"/>' for t in ("tblStyleRowBandSize", "tblStyleColBandSize") if r.random() < 0.5)
        regions = "".join(region(x) for x in (*REGIONS, "neCell") if r.random() < 0.5)
        return f'<w:style w:type="table" w:styleId="{name}">{f"<w:basedOn w:val={chr(34)}{parent}{chr(34)}/>" if parent else ""}<w:tblPr>{bands}{borders("tblBorders", inner)}</w:tblPr>{regions}</w:style>'

    marks = lambda: "<w:cnfStyle " + " ".join(f'w:{f}="{r.choice([0, 1])}"' for f in FLAGS if r.random() < 0.2) + "/>" if r.random() < 0.3 else ""
    cell_ = lambda: f'<w:tc><w:tcPr>{marks()}<w:gridSpan w:val="{r.choice([1, 1, 2])}"/>{borders("tcBorders", outer) if r.random() < 0.3 else ""}</w:tcPr><w:p/></w:tc>'

    def table():
        look = "<w:tblLook " + " ".join(f'w:{n}="{r.choice(["0", "1", ""])}"' for n in ("firstRow", "lastRow", "firstColumn", "lastColumn", "noHBand", "noVBand") if r.random() < 0.6) + "/>" if r.random() < 0.8 else ""
        rows = "".join(f"<w:tr><w:trPr>{marks()}</w:trPr>{''.join(cell_() for _ in range(r.randint(1, 4)))}</w:tr>" for _ in range(r.randint(1, 5)))
        return f'<w:tbl><w:tblPr><w:tblStyle w:val="{r.choice("ABCDX")}"/>{look}{borders("tblBorders", inner) if r.random() < 0.4 else ""}</w:tblPr>{rows}</w:tbl>'

    docs, want = {}, {}
    for d in range(15):
        styles = f"<w:styles {WORD}>" + "".join(style(n, p) for n, p in (("A", None), ("B", "A"), ("C", "B"), ("D", "gone"))) + "</w:styles>"
        docs[f"d{d}"] = package({"word/document.xml": document("".join(table() for _ in range(4))), "word/styles.xml": styles})
        held = Package(docs[f"d{d}"])
        for t, found in enumerate(x for s in Body(held, Catalogs(held)).read().sections for x in s["blocks"] if x["is"] == "table"):
            want |= {(f"d{d}", t, i, j, side): line(x) for i, row in enumerate(found["rows"], 1) for j, c in enumerate(row["cells"], 1) for side, x in c["borders"].items()}
    nodes = P.nodes(spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary"), ("word/document.xml", "word/styles.xml")).cache()
    rows = cell_borders(nodes).collect()
    number = {(d, n): i for d in docs for i, n in enumerate(sorted({x["tbl"] for x in nodes.where("tag = 'tbl'").selectExpr("doc_id", "node_id AS tbl").collect() if x["doc_id"] == d}))}
    assert {(x["doc_id"], number[x["doc_id"], x["tbl"]], x["row"], x["place"], x["side"]): x["line"] for x in rows} == want and len(want) > 300
