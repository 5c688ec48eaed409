"""Decontamination against brute force over every window and place."""

import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import decontamination as D
from tests.llm.data import SCHEMA, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(lower))


def expected(docs, items):
    held = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add(name)
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for i in range(len(w)):
            for size in range(1, 11):
                if tuple(w[i : i + size]) in held and i + size <= len(w):
                    hit |= set(range(i, i + size))
                    names |= held[tuple(w[i : i + size])]
        listed = ",".join(sorted(str(n) for n in names if n is not None))
        out.append((doc_id, len(w), len(hit), len(names - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items():
    r = random.Random(3)
    texts = [t for t in (x[1] for x in rows()) if t and 15 < len(t.split()) < 200][:12]
    some = [(i, " ".join(t.split()[2:40]).upper()) for i, t in enumerate(texts)]
    some += [(50, texts[0]), (50, "Again, one; item-of two rows and more than ten words in it all"), (None, texts[1]), (60, None), (61, " ... "), (62, "a b"), (63, "abc"), (64, "日本語"), (65, "line one here"), (66, "line one here"), (67, "x" * 3000)]
    return some + [(70 + i, " ".join(r.choice(["ab", "cd", "e"]) for _ in range(30))) for i in range(4)]


@pytest.mark.parametrize("few", [D.FEW_GROUPS, 0])
def test_against_all_places(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW_GROUPS", few)
    r = random.Random(4)
    more = [(1000 + i, " ".join(r.choice(["ab", "cd", "e"]) for _ in range(200))) for i in range(5)]
    texts = [(x[0], x[1]) for x in rows()] + more
    docs = spark.createDataFrame([(*x, *rows()[0][2:]) if len(x) == 2 else x for x in texts], SCHEMA).repartition(3)
    found = D.contaminated(docs, spark.createDataFrame(items(), "item_id long, text string").withColumn("window", D.F.lit(1)))
    want = expected(texts, items())
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert sum(x[5] for x in want) > 10 and not all(x[5] for x in want)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert sorted(D.contaminated(docs, none).select("doc_id", "n_words", "n_hit", "contaminated").collect()) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_words_are_hashed_alike_across_blocks(monkeypatch):
    data = ("word " * 50 + "y" * 9000 + " " + " ".join(str(i) for i in range(300))).encode()
    whole = D.hashed_words(data)
    monkeypatch.setattr(D, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, D.hashed_words(data), strict=True))


def test_filter_lets_all_keys_through(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 3000)
    table = D.bit_filter(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert len(D.passing(table, keys.view(np.uint64))) == len(keys)
    assert len(D.passing(table, np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) < 1000
