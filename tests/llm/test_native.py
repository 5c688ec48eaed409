"""Exact dedup and mixing: SQL oracles on clean rows, plain Python on awkward ones."""

import hashlib
from collections import defaultdict

import pytest

from quire.llm.exact_dedup import drop_copies, exact_dedup
from quire.llm.mixing import emit_mix, mix
from tests.llm.data import SCHEMA, rows

ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def n_words(text):
    return len((text or "").encode().split())


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in ROWS:
        groups[bare(r[1])].append(r)
    found = exact_dedup(docs).collect()
    assert len(found) == len(ROWS)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): g for k, g in groups.items()}
    kept = defaultdict(int)
    for f in found:
        group = by_hash[f["text_sha256"]]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert (f["group_size"], f["keep_id"]) == (len(group), best[0])
        assert not f["kept"] or f["doc_id"] == best[0]
        kept[f["text_sha256"]] += f["kept"]
    assert set(kept.values()) == {1}


def test_drop_copies_keeps_columns_and_one_of_each(docs):
    found = drop_copies(docs)
    assert found.columns == docs.columns
    assert sorted(bare(r["text"]) for r in found.collect()) == sorted({bare(r[1]) for r in ROWS})


def targets(sizes, share=1.5, most=2):
    """Round by round: what is above its bound stops there and the rest goes to the others."""
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [3, 1, 2] * len(sizes), strict=False))
    out, free, budget = {}, set(sizes), share * sum(sizes.values())
    while free:
        level = (budget - sum(out.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weights[s] * level for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def test_mixing(docs):
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += n_words(r[1])
    want = targets(sizes)
    first, again = mix(docs).collect(), mix(docs.repartition(2)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(first, key=key) == sorted(again, key=key) and len(first) == len(ROWS)
    source_of = {r[0]: r[3] for r in ROWS if r[0] is not None}
    for f in first:
        if f["doc_id"] is not None:
            s = source_of[f["doc_id"]]
            assert f["source_size"] == sizes[s] and f["target"] == pytest.approx(want[s])
        rate = f["target"] / f["source_size"] if f["source_size"] else 0
        assert f["taken"] == f["copies"] * f["size"] and int(rate) <= f["copies"] <= min(2, int(rate) + 1)
    emitted = emit_mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(f["copies"] for f in first)


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 40 as int)) AS text", "concat('s', least(id % 7, 3)) AS source")
    found = mix(docs).groupBy("target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] / r["target"] - 1) < 0.05 for r in found)


@pytest.mark.parametrize("operator", [exact_dedup, mix, drop_copies, emit_mix])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_empty_texts(spark):
    found = mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r["target"], r["taken"]) for r in found} == {(0.0, 0)}
