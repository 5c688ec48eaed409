"""Comparisons, first-use numbers and sections against plain Python."""

import random
from collections import Counter

from quire.operators.compare import dice_by_key, similar, within_threshold
from quire.operators.firsts import first_use_numbers
from quire.plans.sections import in_sections, section_ends
from quire.sources import package as P
from quire.sources.build import WORD, document, package, paragraph, relationships, run


def dice(a, b):
    a, b = Counter((a or "").lower().split()), Counter((b or "").lower().split())
    size = a.total() + b.total()
    return 100 if not size else int(200.0 * (a & b).total() / size + 0.5)


def texts(r, n):
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(8)]
    out = [None, "", "w1", "W1", "w1 w1 w1"]
    for _ in range(n):
        said = r.choice(base).split()
        for _ in range(r.randint(0, 6)):
            said[r.randrange(len(said))] = r.choice(words)
        out.append(" ".join(said))
    return out + out[5:9]


def test_similar_pairs(spark):
    r = random.Random(1)
    left, right = list(enumerate(texts(r, 50))), [(1000 + i, t) for i, t in enumerate(texts(r, 40))]
    a, b = spark.createDataFrame(left, "a long, text string").repartition(3), spark.createDataFrame(right, "b long, text string")
    for threshold in (1, 50, 70, 85, 100):
        found = {tuple(x) for x in similar(a, "a", b, "b", threshold).collect()}
        want = {(i, j, s) for i, t in left for j, u in right if (t or "").split() and (u or "").split() and (s := dice(t, u)) >= threshold}
        assert found == want
    assert similar(a, "a", b.limit(0), "b", 50).collect() == []


def test_comparison_by_key(spark):
    r = random.Random(2)
    left, right = list(enumerate(texts(r, 30))), list(enumerate(texts(r, 20)))
    found = dice_by_key(spark.createDataFrame(left, "k long, text string"), spark.createDataFrame(right, "k long, text string"), "k").collect()
    assert {tuple(x) for x in found} == {(i, dice(t, right[i][1])) for i, t in left[: len(right)]}


def test_unknown_pages_do_not_fit(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(90, True), (90, None), (80, True)], "s int, m boolean")
    assert [x[0] for x in rows.select(within_threshold(F.col("s"), F.col("m"), 85)).collect()] == [True, False, False]


def test_numbers_by_first_use(spark):
    r = random.Random(4)
    rows = [(d, i, r.choice(["a", "b", "c", None])) for d in (1, 2, None) for i in range(20)]
    want = {}
    for d, i, what in rows:
        seen = want.setdefault(d, {})
        seen.setdefault(what if what is not None else (i,), len(seen) + 1)
    found = first_use_numbers(spark.createDataFrame(rows[::-1], "d long, at long, what string"), ["d"], "at", "what").collect()
    assert {(x["d"], x["at"]): x["number"] for x in found} == {(d, i): want[d][what if what is not None else (i,)] for d, i, what in rows}


def test_sections_take_the_next_end(spark):
    end = lambda w, *ids: "<w:sectPr>" + "".join(f'<w:headerReference r:id="{i}"/>' for i in ids) + f'<w:pgSz w:w="{w}"/></w:sectPr>'
    body = paragraph("one") + f"<w:p><w:pPr>{end(100, 'a', 'b', 'gone')}</w:pPr>{run('two')}</w:p>" + f"<w:p><w:pPr>{end(200)}</w:pPr></w:p>" + paragraph("three")
    parts = {"word/document.xml": document(body), "word/_rels/document.xml.rels": relationships({"a": ("h1.xml", None), "b": ("h2.xml", None)}), "word/h1.xml": f"<w:hdr {WORD}>{paragraph('first')}</w:hdr>", "word/h2.xml": f"<w:hdr {WORD}>{paragraph('second')}{paragraph('line')}</w:hdr>"}
    nodes = P.nodes(spark.createDataFrame([("d", bytearray(package(parts))), ("plain", bytearray(package({"word/document.xml": document(paragraph("x"))})))], "doc_id string, content binary")).cache()
    blocks = nodes.where("part = 'word/document.xml' AND tag = 'p'").select("doc_id", nodes["node_id"].alias("at"))
    found = sorted((x["doc_id"], x["at"], x["section"], x["page"]["width"] if x["page"] else None, x["header"]) for x in in_sections(blocks, section_ends(nodes)).collect())
    assert [x[2:] for x in found] == [(1, 100, "second line"), (1, 100, "second line"), (2, 200, None), (3, None, None), (1, None, None)]
