"""Column expressions and relational operators against plain Python, and edge cases of the conversion API."""

import json
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import units as U
from quire.operators import markup, office, sequences, styles, tables
from quire.operators.compare import dice, within_threshold
from quire.operators.fonts import decide
from quire.operators.styles import ancestor_chains
from quire.operators.syntax import syntax_errors
from quire.plans import convert as C
from quire.sources import build as B
from quire.sources import package as P

TEXTS = ["", "a//b", "x\\y", "@$#*_<>[]", 'say "hi"', " \n ", "a..b/../c", "../x/./y", "Ünï 12", "日本 a", "  lead", "tail \t"]


def one(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_text_expressions_agree_with_the_writer(spark):
    assert one(spark, TEXTS, T.escape_markup) == [markup.plain(t) for t in TEXTS]
    assert one(spark, TEXTS, T.slug) == [markup.slug(t) for t in TEXTS]
    assert one(spark, TEXTS, T.normalize_path) == [office.clean_path(t) for t in TEXTS]
    assert one(spark, TEXTS, T.trim_space) == [t.strip() for t in TEXTS]
    assert one(spark, [None], T.escape_markup) == [None]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=string.printable, max_size=30))
def test_escaping_hides_all_markup(text):
    left = re.sub(r"\\.", "", markup.plain(text), flags=re.S)
    assert not set(left) & set("@$#*_<>[]\\") and "//" not in left


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=8))
def test_clean_paths_stay_clean(parts):
    path = office.clean_path("/".join(parts))
    assert office.clean_path(path) == path and ".." not in path.split("/")


def test_lengths(spark):
    n = list(range(0, 40000, 7))
    assert one(spark, n, U.twips, "int") == [markup.twips(x) for x in n]
    colors = ["#4472C4", "4472c4", "#00FF00", "#123", "AUTO", "nope", "#80808080"]
    assert one(spark, colors, U.render_color) == [markup.color(c) for c in colors]
    shades = one(spark, colors, lambda c: U.theme_shade(c, F.lit(0x66), F.lit(200)))
    assert shades == [office.shaded(c, 0x66, 200) for c in colors]


def test_headings_and_fields(spark):
    assert one(spark, ["Heading 3", "heading7", "heading 256", "x", None], T.heading_level) == [3, 7, None, None, None]
    assert one(spark, [" page ", "PAGES"], T.is_page_field) == [True, False]


def test_runs_keep_nulls_together(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "k int, i int, v string")
    assert [r["run"] for r in sequences.adjacent_runs(rows, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [1, 1, 2, 2, 3]


def test_chains_cut_cycles(spark):
    rows = spark.createDataFrame([("a", "b", 1, None), ("b", "a", None, 2), ("c", "gone", None, None)], "node string, parent string, x int, y int")
    chains = styles.ancestor_chains(rows, [], "node", "parent")
    assert {(r["node"], r["ancestor"], r["depth"]) for r in chains.collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "a", 1)}
    found = {r["node"]: (r["x"], r["y"]) for r in styles.cascade(chains, rows, [], "node", ["x", "y"]).collect()}
    assert found == {"a": (1, 2), "b": (1, 2), "c": (None, None)}


def test_column_widths(spark):
    cells = spark.createDataFrame([(1, 0, 2, 101), (1, 2, 1, 40), (1, 0, 1, 60), (1, 1, 1, None)], "t int, at int, span int, width int")
    found = {r["slot"]: r["width"] for r in tables.column_widths(cells, ["t"], "at", "span", "width").collect()}
    assert found == {0: 60, 1: 51, 2: 40}


def test_dice_and_threshold(spark):
    a = spark.createDataFrame([(1, "a a b"), (2, "")], "l int, text string")
    b = spark.createDataFrame([(7, "A b c"), (8, "zz")], "r int, text string")
    assert [tuple(r) for r in dice(a, "l", b, "r").collect()] == [(1, 7, 67)]
    assert spark.range(1).select(within_threshold(F.lit(90), F.lit(False), 85)).first()[0] is False


def test_validate(spark):
    results = spark.createDataFrame([("a", "#x[ok]", "one two", 2), ("b", "#x[", "", 1), ("c", "", "q", 1)], "doc_id string, markup string, text string, pages int")
    reference = spark.createDataFrame([("a", "one two", 1), ("b", " ", 1)], "doc_id string, text string, pages int")
    found = {r["doc_id"]: r for r in C.validate(results, reference).collect()}
    assert (found["a"]["similarity"], found["a"]["within_threshold"], [(d["code"], d["severity"], d["context"]) for d in found["a"]["diagnostics"]]) == (100, False, [("REFERENCE_PAGE_COUNT_MISMATCH", "warning", {"generated": "2", "reference": "1"})])
    assert (found["b"]["similarity"], found["b"]["structure_ok"], found["b"]["within_threshold"]) == (100, False, True)
    assert found["b"]["diagnostics"][0]["code"] == "TYPST_SYNTAX_ERROR" and found["b"]["diagnostics"][0]["context"] == {"offset": "2"}
    assert found["c"]["similarity"] is None


def test_packages_fail_alone(spark):
    good = B.package({"word/document.xml": B.document(B.paragraph("Hello"))})
    packages = spark.createDataFrame([("good", good), ("bad", b"no zip"), ("null", None)], "doc_id string, content binary")
    found = {r["doc_id"]: r for r in C.convert(packages).collect()}
    assert (found["good"]["status"], found["bad"]["status"], found["null"]["status"]) == ("ok", "failed", "failed")
    assert {r["path"] for r in C.files(C.convert(packages)).collect()} == {"main.typ", "report.json", "runtime.typ"}
    assert P.parts(packages).where("part = 'word/document.xml'").count() == 1
    types = {r["part"]: r["content_type"] for r in P.parts(packages).collect()}
    assert types["_rels/.rels"].endswith("relationships+xml")
    node = P.nodes(packages, ("word/document.xml",)).where("tag = 't'").first()
    assert (node["text"], node["path"]) == ("Hello", "/document[1]/body[1]/p[1]/r[1]/t[1]")
    assert C.inspect(packages).where("error IS NOT NULL").count() == 2


def test_files_and_streams(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.docx").write_bytes(B.package({"word/document.xml": B.document(B.paragraph(name))}))
    packages = P.read_packages(spark, f"{tmp_path}/*.docx")
    assert C.convert(packages).where("status = 'ok'").count() == 2
    schema = spark.read.format("binaryFile").load(str(tmp_path)).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(str(tmp_path)).select(F.col("path").alias("doc_id"), "content")
    query = C.convert_stream(stream).writeStream.format("memory").queryName("converted").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("converted").count() == 2


def test_entry_without_the_optional_part():
    import __spark_entry__

    assert {"package_roundtrip", "dice_similarity"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("markup", "errors"), [
    ("plain (text", 0), ("#f(a: \"(\", [b])[c]", 0), ("\\[ \\]", 0), ("`]` #x.y(1)", 0), ("// ] \n", 0), ("http://a", 0), ("/* ( ", 1),
    ("#f([)]", 1), (")(", 0), ("#f)(", 0), ("#f(()", 1), ("]", 1), ("[", 1), ("#f(\"x)", 1), ("```\n`", 1), ("#{ (] }", 1),
])
def test_syntax(markup, errors):
    assert len(syntax_errors(markup)) >= errors and bool(syntax_errors(markup)) == bool(errors)


def test_hostile_packages_become_failed_rows(spark):
    import random

    r = random.Random(6)
    values = ["", "-1", "0", str(1 << 40), "9" * 40, "x", "\u00e9", "1e9", "100%", "../../x", "#", "true"]
    body = '<w:tbl><w:tblGrid><w:gridCol w:w="{}"/></w:tblGrid><w:tr><w:trPr><w:trHeight w:val="{}"/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="{}"/><w:tcW w:w="{}" w:type="dxa"/><w:vMerge w:val="{}"/></w:tcPr><w:p><w:pPr><w:jc w:val="{}"/></w:pPr><w:r><w:rPr><w:sz w:val="{}"/><w:color w:val="{}"/></w:rPr><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr><w:pgSz w:w="{}" w:h="{}"/></w:sectPr>'
    given = [(str(i), B.package({"word/document.xml": B.document(body.format(*[r.choice(values) for _ in range(10)]))})) for i in range(400)]
    given.append(("wide", B.package({"word/document.xml": B.document(body.format(1, 1, 1 << 40, 1, "", "", "", "", 1, 1))})))
    given.append(("deep", B.package({"word/document.xml": B.document("<w:sdt>" * 5000 + "</w:sdt>" * 5000)})))
    packages = spark.createDataFrame(given, "doc_id string, content binary")
    found = {x["doc_id"]: x for x in C.convert(packages).collect()}
    assert len(found) == len(given) and found["wide"]["status"] == "failed" and "columns" in found["wide"]["error"]
    assert C.inspect(packages).count() == len(given) and P.parts(packages).count() > 0
    assert C.convert(packages.limit(1), {"max_package_bytes": 10}).first()["status"] == "failed"


def test_containment(spark):
    packages = spark.createDataFrame([("a", B.package({"word/document.xml": B.document(B.paragraph("x") + B.paragraph("y"))}))], "doc_id string, content binary")
    nodes = P.nodes(packages, ("word/document.xml",)).cache()
    found = P.within(nodes.where("tag = 'p'"), nodes.where("tag = 't'")).select("outer_id", "text").collect()
    assert sorted(tuple(x) for x in found) == [(2, "x"), (5, "y")]
    ends = {x["node_id"]: x["end_id"] for x in nodes.collect()}
    assert ends == {0: 7, 1: 7, 2: 4, 3: 4, 4: 4, 5: 7, 6: 7, 7: 7}


def test_names_beyond_ascii_keep_their_case(spark):
    fonts = spark.createDataFrame([("\u00dcFont",), ("\u00fcfont",), ("\u00dcFONT",)], "requested string")
    found = {x["requested"]: x["reason"] for x in decide(fonts, {}, ["\u00dcFont"], []).collect()}
    assert found == {"\u00dcFont": "profile font path", "\u00fcfont": "document font retained", "\u00dcFONT": "profile font path"}


def test_long_chains(spark):
    chain = spark.createDataFrame([("d", i, i - 1 if i else None) for i in range(70)], "doc string, node int, parent int")
    assert ancestor_chains(chain, ["doc"], "node", "parent").where("node = 69").count() == 70


def test_command_line(tmp_path, capsys):
    from quire.__main__ import main
    from quire.sources import bundle

    source = tmp_path / "a.docx"
    source.write_bytes(B.package({"word/document.xml": B.document(B.paragraph("Hello"))}))
    assert main(["convert", str(source), "-o", str(tmp_path / "out"), "--validate"]) == 0
    markup, report = bundle.read(tmp_path / "out")
    assert "Hello" in markup and report["paragraphs"] == 1 and (tmp_path / "out" / "validation.json").exists()
    assert main(["convert", str(source), "-o", str(tmp_path / "one.typ"), "--single-file", "--report", str(tmp_path / "r.json")]) == 0
    assert bundle.read(tmp_path / "one.typ") == (markup, json.loads((tmp_path / "r.json").read_bytes()))
    assert main(["validate", str(tmp_path / "out")]) == main(["validate", str(source)]) == main(["inspect", str(source)]) == 0
    assert main(["explain", "FONT_SUBSTITUTION"]) == 0 and main(["explain", "NONE"]) == 1
    (tmp_path / "bad.typ").write_text("#x(")
    assert main(["validate", str(tmp_path / "bad.typ")]) == 1 and main(["inspect", str(tmp_path / "bad.typ")]) == 2
    with pytest.raises(ValueError):
        bundle.write({"../x": b""}, tmp_path / "out")
    capsys.readouterr()


def test_pages_as_nodes_and_markup(spark, tmp_path):
    from quire.plans.package_queries import markup_nodes, page_to_markup

    html = "<html><body><h2>Top *</h2><p>one<br>two</p><p> </p><div><p>three</div></body></html>"
    spark.createDataFrame([(7, "u", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    nodes = {r["path"]: (r["depth"], r["text"]) for r in markup_nodes(spark, str(tmp_path)).collect()}
    assert nodes["/html[1]/body[1]/p[1]"] == (2, "onetwo") and nodes["/html[1]/body[1]/div[1]/p[1]"] == (3, "three")
    assert nodes["/html[1]/body[1]/p[1]/br[1]"] == (3, "") and len(nodes) == 8
    assert page_to_markup(spark, str(tmp_path)).first()["markup"].strip() == "== Top \\*\n\nonetwo\n\nthree"
