"""Cells straight from packages against those of nodes, and against plain walks."""

import random

from pyspark.sql import functions as F

from quire.operators import grid
from quire.plans import grid_queries
from quire.plans.typeset import BODY, table_rows, whole
from quire.sources import build as B
from quire.sources import package as P

DATA = "/root/testdata/sf0.001"


def body(r: random.Random, depth: int = 0) -> str:
    out = ""
    for _ in range(r.randint(0, 3)):
        rows = ""
        for _ in range(r.randint(0, 4)):
            cells = ""
            for _ in range(r.randint(0, 4)):
                props = r.choice(["", "<w:vMerge/>", '<w:vMerge w:val="restart"/>', '<w:gridSpan w:val="2"/>', '<w:gridSpan w:val="x"/><w:gridSpan w:val="3"/><w:vMerge/>', '<w:tcPrChange><w:tcPr><w:gridSpan w:val="4"/></w:tcPr></w:tcPrChange>'][: 6 if depth else 4])
                inner = r.choice(["<w:p/>", B.paragraph("x"), body(r, depth + 1) if 0 < depth < 3 else "<w:p/>", "<w:p><w:tcPr><w:vMerge/></w:tcPr></w:p>" if depth else ""])
                cells += f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if r.random() < 0.8 else ''}{inner}</w:tc>"
            rows += f"<w:tr>{cells}</w:tr>" + ("<w:sdt><w:tr><w:tc/></w:tr></w:sdt>" if depth and r.random() < 0.2 else "")
        out += f"<w:tbl>{rows}</w:tbl><w:p/>"
    return out


def test_cells_of_packages_are_those_of_nodes(spark):
    # flat documents and nested ones take two ways
    made = [(str(i), bytearray(B.package({BODY: B.document(body(random.Random(i), i % 2))}))) for i in range(60)]
    packages = spark.createDataFrame([*made, ("junk", bytearray(b"x")), ("none", bytearray(B.package({"word/other.xml": "<a/>"}))), ("broken", bytearray(B.package({BODY: "<a"})))], "doc_id string, content binary").repartition(3)
    assert sorted(x["doc_id"] for x in P.cells(packages, BODY).where("error IS NOT NULL").collect()) == ["broken", "junk"]
    columns = ["doc_id", "tbl", "row", "place", "column_index", "origin_row", "origin_place", "hidden", "row_span"]
    _, cells = table_rows(P.nodes(packages, (BODY,)).where("error IS NULL"))
    want = grid.place_cells(cells.select("doc_id", "tbl", "row", "place", "span", "merge"), ["doc_id", "tbl"], "row", "place", "span", "merge").select(columns).collect()
    straight = P.cells(packages, BODY).where("error IS NULL").withColumn("span", whole(F.col("span"))).drop("error")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # documents go on over batches
    try:
        placed = grid.place_in_order(straight, "doc_id", "tbl", "row", "place", "span", "merge").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, (tuple(x[c] for c in columns) for x in placed))) == sorted(str(tuple(x)) for x in want) and len(want) > 200
    tables = {}
    for x in placed:
        tables.setdefault(x["doc_id"], {})[x["tbl"]] = x["table_no"]
    assert all([n[t] for t in sorted(n)] == list(range(1, len(n) + 1)) for n in tables.values())


def test_merged_cells_are_not_moved_after_they_are_read(spark):
    plan = grid_queries.merged_cells(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("MapInArrow")]
    assert above.count("MapInArrow") == 3 and not any(x in above for x in ("Repartition", "Aggregate", "Sort", "Window"))
