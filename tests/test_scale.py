"""What lets queries grow with their input: packages are taken apart once, only what is asked for is made, work is spread."""

import random

from pyspark.sql import functions as F

from quire.operators import grid, tree
from quire.plans import grid_queries, markup_queries, package_queries, queries
from quire.sources import build as B
from quire.sources import package as P

DATA = "/root/testdata/sf0.001"
BODY = "word/document.xml"


def passes(df) -> int:
    """How often a plan hands rows to Python."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def packages(spark, n=5):
    tables = lambda i: "".join(f"<w:tbl><w:tr><w:tc>{B.paragraph(f't{i} {j}')}{B.paragraph(' ')}<w:tbl><w:tr><w:tc>{B.paragraph('in' if j else '')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>" for j in range(i))
    made = [(str(i), bytearray(B.package({BODY: B.document(tables(i)), "word/bad.xml": "<a"}))) for i in range(n)]
    return spark.createDataFrame([*made, ("junk", bytearray(b"x"))], "doc_id string, content binary")


def test_nodes_by_tags_and_columns_are_those_of_all_nodes(spark):
    found = packages(spark)
    every = P.nodes(found)
    some = P.nodes(found, tags=("tc", "t"), columns=("doc_id", "node_id", "end_id", "tag", "path", "error", "above"))
    want = every.where("tag IN ('tc', 't') OR error IS NOT NULL").select(some.columns)
    assert sorted(map(str, some.collect())) == sorted(map(str, want.collect())) and some.where("error IS NOT NULL").count() == 6


def test_one_pass_containment_and_texts(spark):
    nodes = P.nodes(packages(spark), (BODY,)).where("error IS NULL").cache()
    key = ("doc_id", "outer_id", "node_id")
    joined = tree.within(nodes.where("tag IN ('tbl', 'tr')"), nodes.select("doc_id", "part", "node_id", "tag", "above"))
    assert sorted(tree.lies_in(nodes, ("tbl", "tr")).select(*key).collect()) == sorted(joined.select(*key).collect())
    told = tree.visible_text(nodes.where("tag = 'tbl'"), nodes)
    once = tree.visible_in(nodes, ("tbl",), n=F.count("*"))
    assert sorted(map(tuple, once.drop("n").collect()), key=str) == sorted(map(tuple, told.collect()), key=str)
    assert once.where("visible IS NULL").count() > 0


def test_packages_are_taken_apart_once(spark):
    # one step builds packages, one takes them apart
    assert passes(markup_queries.nodes_within(spark, DATA)) == 2
    assert passes(grid_queries.visible_texts(spark, DATA)) == 2
    # two more walk the cells
    assert passes(grid_queries.merged_cells(spark, DATA)) == 4


def test_few_bytes_dont_mean_few_tasks(spark):
    shown = markup_queries.from_orders(spark, DATA).groupBy().count()
    shown.collect()
    assert "REPARTITION_BY_NUM" in shown._jdf.queryExecution().executedPlan().toString()


def test_cells_keep_all_their_columns(spark):
    r = random.Random(5)
    rows = [(t, i, j, r.choice([1, 2, None]), r.choice([None, "restart", "continue"]), {"at": (i, j)}, [t]) for t in range(9) for i in range(6) for j in range(4)]
    cells = spark.createDataFrame(rows, "t int, i int, j int, span int, merge string, more map<string, struct<a: int, b: int>>, list array<int>")
    found = grid.place_cells(cells, ["t"], "i", "j", "span", "merge").collect()
    assert sorted(str((x["t"], x["i"], x["j"], x["span"], x["merge"], {"at": tuple(x["more"]["at"])}, x["list"])) for x in found) == sorted(map(str, rows))
    covered = {}
    for x in found:
        began = (x["t"], *((x["origin_row"], x["origin_place"]) if x["hidden"] else (x["i"], x["j"])))
        covered[began] = covered.get(began, 0) + 1
    assert all(x["row_span"] == (None if x["hidden"] else covered[x["t"], x["i"], x["j"]]) for x in found) and any(x["hidden"] for x in found)


def test_styles_and_sections_read_written_nodes(spark):
    # what is left after packages were written as nodes, once, is the walks of cells
    assert passes(grid_queries.table_style_borders(spark, DATA)) == 2
    assert passes(grid_queries.section_setups(spark, DATA)) == 0


def test_similar_pairs_in_many_cells(spark, monkeypatch):
    from quire.operators import compare

    r = random.Random(8)
    texts = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 9)))) for i in range(40)]
    a, b = spark.createDataFrame(texts[:25], "a int, text string"), spark.createDataFrame(texts[15:], "b int, text string")
    want = {tuple(x) for x in compare.dice(a, "a", b, "b").where("similarity >= 70").collect()}
    monkeypatch.setattr(compare, "CELL", 7)
    found = compare.similar(a, "a", b, "b", 70)
    # candidates don't become rows for each token: one cogroup counts them
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x) for x in found.collect()} == want and len(want) > 10


def steps(df, *kinds) -> list[str]:
    """The lines of a plan that begin with one of the kinds."""
    lines = (line.lstrip(" :+-*()0123456789") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    return [line for line in lines if line.startswith(kinds)]


def test_nested_lists_read_written_nodes(spark):
    # packages are taken apart once, not for each catalog
    assert passes(grid_queries.list_nesting(spark, DATA)) == 0


def test_slots_of_columns_are_no_keys_of_an_aggregate(spark):
    found = steps(queries.column_width_inference(spark, DATA), "HashAggregate", "SortAggregate", "ObjectHashAggregate")
    assert found and all(x.partition("functions=")[0].count("#") == 1 for x in found)


def test_column_widths_of_cells_that_overlap(spark):
    from quire.operators import tables

    r = random.Random(6)
    rows = [(r.randrange(5), r.randrange(6), r.choice([0, 1, 2, 3]), r.choice([None, *range(1, 50)])) for _ in range(200)] + [(9, 0, 1, None)]
    want = {}
    for t, at, span, width in rows:
        n = max(span, 1)
        for o in range(n if width is not None else 0):
            share = width // n + (width % n if o == n - 1 else 0)
            want[t, at + o] = max(share, want.get((t, at + o), 0))
    cells = spark.createDataFrame(rows, "t int, at int, span int, width int").repartition(3)
    assert sorted(map(tuple, tables.column_widths(cells, ["t"], "at", "span", "width").collect())) == sorted((*k, v) for k, v in want.items())


def test_comparing_versions_moves_texts_not_tokens(spark):
    moved = steps(queries.document_comparison(spark, DATA), "Exchange hash")
    assert moved and not any("token" in x for x in moved)


def test_comparing_versions_counts_rows_of_one_key_as_one_text(spark):
    from quire.operators import compare

    rows = spark.createDataFrame([(1, "a b", "a"), (1, "c", "c b"), (2, "x", None), (3, None, ""), (4, "A a a", "a a z")], "k int, l string, r string")
    found = compare.dice_of_rows(rows, "k", F.col("l"), F.col("r"))
    want = compare.dice_by_key(rows.select("k", F.col("l").alias("text")), rows.select("k", F.col("r").alias("text")), "k")
    assert sorted(found.collect()) == sorted(want.collect()) == [(1, 100), (2, 0), (3, 100), (4, 67)]


def test_similarity_moves_texts_not_tokens(spark, monkeypatch):
    from quire.operators import compare

    found = queries.dice_similarity(spark, DATA)
    moved = steps(found, "Exchange hash")
    assert moved and not any("token" in x for x in moved)
    want = sorted(found.collect())
    monkeypatch.setattr(compare, "FEW_TOKENS", 0)
    assert sorted(queries.dice_similarity(spark, DATA).collect()) == want


def test_packages_are_built_where_they_are_read(spark):
    documents = package_queries.from_documents(spark, DATA)
    # no step that only builds, and none at all for the names
    assert passes(P.nodes(documents, (BODY,))) == 1 and passes(P.doc_ids(documents)) == 0
    assert passes(package_queries.inspect_packages(spark, DATA)) == 1
    built = B.build(documents.rows, documents.make)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(P.nodes(documents, (BODY,)), P.nodes(built, (BODY,))) and same(P.doc_ids(documents), P.doc_ids(built))


def test_converted_packages_are_built_where_they_are_read(spark):
    assert passes(markup_queries.label_fallbacks(spark, DATA)) == 1 and passes(markup_queries.page_setups(spark, DATA)) == 1


def test_no_field_windows_without_fields(spark, monkeypatch):
    from quire.plans import typeset as T

    called, field_windows = [], T.without_fields
    monkeypatch.setattr(T, "without_fields", lambda pieces: called.append(1) or field_windows(pieces))
    body = B.paragraph("one") + f'<w:p>{B.run("two")}<w:hyperlink w:anchor="a">{B.run("three")}</w:hyperlink></w:p>'
    page = '<w:p><w:fldSimple w:instr="PAGE"><w:r><w:t>9</w:t></w:r></w:fldSimple></w:p>'
    made = lambda *bodies: spark.createDataFrame([(str(i), bytearray(B.package({BODY: B.document(b)}))) for i, b in enumerate(bodies)], "doc_id string, content binary")
    plain = T.typeset(made(body)).first()["markup"]
    assert not called and plain.endswith('one\n\ntwo#link("#a")[three]\n')
    both = {x["doc_id"]: x["markup"] for x in T.typeset(made(body, page)).collect()}
    assert called and both["0"] == plain and "#context counter(page).display()" in both["1"]


def test_similar_pairs_without_rows_for_candidates(spark, monkeypatch):
    from quire.operators import compare

    r = random.Random(9)
    texts = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.choice([1, 2, 5, 9, 17, 40])))) for i in range(120)]
    a, b = spark.createDataFrame(texts[:80], "a int, text string"), spark.createDataFrame([(i, t + " a" * (i % 3)) for i, t in texts[50:]], "b int, text string")
    every = compare.dice(a, "a", b, "b").collect()
    monkeypatch.setattr(compare, "CELL", 5)
    monkeypatch.setattr(compare, "ENTRIES", 11)
    for threshold in (40, 70, 100):
        found = compare.similar(a, "a", b, "b", threshold)
        assert not any("left_size" in x for x in steps(found, "Exchange hash"))
        want = {tuple(x) for x in every if x["similarity"] >= threshold}
        assert {tuple(x) for x in found.collect()} == want and want


def test_tables_of_orders_are_built_where_they_are_read(spark):
    built = markup_queries.order_packages(spark, DATA)
    assert passes(P.doc_ids(built)) == 0 and passes(P.nodes(built, (BODY,))) == 1


def test_what_documents_dont_hold_is_not_looked_for(spark, monkeypatch):
    from quire.plans import typeset as T

    link = f'<w:p>{B.run("one")}<w:hyperlink w:anchor="a">{B.run("two")}</w:hyperlink></w:p>'
    font = B.paragraph("said", "", '<w:rFonts w:ascii="Some Font"/><w:b/>') + f"<w:p>{B.run('a/')}{B.run('/b')}<w:r><w:br/><w:t>c</w:t></w:r></w:p>"
    cell = lambda props, text: f"<w:tc><w:tcPr>{props}</w:tcPr>{B.paragraph(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('<w:gridSpan w:val=\"2\"/>', 'x')}</w:tr><w:tr>{cell('<w:tcW w:w=\"900\"/>', '')}{cell('<w:tcBorders><w:end w:val=\"single\"/></w:tcBorders>', 'y')}</w:tr></w:tbl>"
    section = B.paragraph("last") + '<w:p/><w:sectPr><w:pgSz w:w="9000" w:h="12000"/></w:sectPr>'
    bodies = ["", B.paragraph("plain *text*"), link, font, table, section, "<w:p><w:r/><w:r><w:tab/></w:r></w:p><w:tbl/>"]
    made = lambda some: spark.createDataFrame([(str(i), bytearray(B.package({BODY: B.document(bodies[i])}))) for i in some], "doc_id string, content binary")
    together = {x["doc_id"]: x for x in T.typeset(made(range(len(bodies)))).collect()}
    looked, layout = [], T.layout_catalog
    monkeypatch.setattr(T, "layout_catalog", lambda nodes: looked.append(1) or layout(nodes))
    alone = {str(i): T.typeset(made([i])).first() for i in range(len(bodies))}
    assert alone == together and len(looked) == 1 and 'font: "Some Font"' in alone["3"]["markup"]


def test_alike_style_sheets_are_worked_out_once(spark, monkeypatch):
    from quire.plans import table_styles as S

    sheet = lambda size: f'<w:styles {B.WORD}><w:style w:type="table" w:styleId="A"><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="{size}"/><w:insideV w:val="single" w:sz="2"/></w:tblBorders></w:tblPr><w:tblStylePr w:type="firstRow"><w:tcPr><w:tcBorders><w:left w:val="nil"/></w:tcBorders></w:tcPr></w:tblStylePr></w:style></w:styles>'
    marks = '<w:trPr><w:cnfStyle w:firstRow="1"/></w:trPr>'
    table = lambda i: f'<w:tbl><w:tblPr><w:tblStyle w:val="{"A" if i % 5 else "gone"}"/></w:tblPr><w:tr><w:tc/><w:tc/></w:tr><w:tr>{marks if i % 3 else ""}<w:tc/><w:tc><w:tcPr><w:tcBorders><w:top w:val="single"/></w:tcBorders></w:tcPr></w:tc></w:tr></w:tbl>'
    sheets = [sheet(4), sheet(8), f"<w:styles {B.WORD}/>", None]
    made = [(str(i), bytearray(B.package({BODY: B.document(table(i))} | ({S.STYLES: sheets[i % 4]} if i % 4 < 3 else {})))) for i in range(30)]
    packages = spark.createDataFrame([*made, ("broken", bytearray(B.package({BODY: B.document(table(1)), S.STYLES: "<a"})))], "doc_id string, content binary").repartition(2)
    each = P.nodes(packages, (BODY, S.STYLES), tags=S.TAGS).cache()
    shared = P.nodes(packages, (BODY, S.STYLES), tags=S.TAGS, once=(S.STYLES,)).cache()
    of_sheets = "part = 'word/styles.xml' AND tag = 'style'"
    assert each.where(of_sheets).count() == 16 and shared.where(of_sheets).count() <= 4 and shared.where("digest IS NOT NULL").select("digest").distinct().count() == 3
    want = sorted(map(str, S.cell_borders(each).collect()))
    assert want and sorted(map(str, S.cell_borders(shared).collect())) == want
    monkeypatch.setattr(S, "FEW_STYLES", 0)
    assert sorted(map(str, S.cell_borders(shared).collect())) == want
    # what the planner may broadcast is a row for each digest, never rows of documents
    assert all("digest#" in x for x in steps(S.cell_borders(shared), "BroadcastHashJoin"))
