"""The near-copy stage of the pipeline against brute-force Jaccard similarity of word shingles."""

import random

import numpy as np
import pytest

from corpus_pipeline import near
from quire.llm import near_copies
from quire.llm.simhash import drop_near_copies
from tests.llm.data import SCHEMA, rows


def brute_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_kept(texts, ids):
    """Rows (id, text) that stay: the smallest id of each component, null last."""
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i in range(len(sets)):
        key = (ids[i] is None, ids[i] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted(best.values())


def copies(seed=7):
    """Texts with near copies of all grades around 0.8, chains of them, and passages that many texts share."""
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    boilerplate, found = text(60), []
    for _ in range(40):
        words = text(r.randint(30, 300))
        if r.random() < 0.4:
            words = words[: r.randint(5, 40)] + boilerplate + words[:20]
        for _ in range(r.randint(1, 6)):
            found.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) * r.choice([1, 2, 3, 4, 5]) // 200)):
                words[r.randrange(len(words))] = "changed"
    return found


@pytest.mark.parametrize("limits", [{}, {"SAMPLE": 0, "CROWD": 1, "CELL": 3, "PAIRS": 5, "HEADS": 1, "MARKS": 1}])
def test_near_stage_keeps_what_brute_force_keeps(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    texts = copies()
    ids = random.Random(1).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near(spark, docs, "").collect())
    assert found == brute_kept(texts, ids)


def test_a_crowd_that_is_mostly_just_below_the_threshold(spark):
    r = random.Random(11)
    base, texts = [f"w{r.randrange(3000)}" for _ in range(150)], []
    for _ in range(160):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            words[r.randrange(len(words))] = f"c{r.randrange(40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted((False, r["doc_id"]) for r in near(spark, docs, "").collect()) == brute_kept(texts, list(range(len(texts))))


def test_pairs_of_a_crowd_just_below_the_threshold_dont_become_rows(spark, monkeypatch):
    r = random.Random(17)
    base, texts = [f"w{r.randrange(3000)}" for _ in range(300)], []
    for _ in range(150):
        words = list(base)
        for _ in range(r.choice([4, 5, 5, 5])):
            words[r.randrange(len(words))] = f"c{r.randrange(3000)}"
        texts.append(" ".join(words))
    texts.append(f"{texts[0]} more")
    given, verified = {}, near_copies._verified

    def counted(pairs, rows, signs, scratch, name):
        given[name] = pairs.count()
        return verified(pairs, rows, signs, scratch, name)

    monkeypatch.setattr(near_copies, "_verified", counted)
    monkeypatch.setattr(near_copies, "SAMPLE", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted((False, r["doc_id"]) for r in near(spark, docs, "").collect()) == brute_kept(texts, list(range(len(texts))))
    assert given["2"] < 2 * len(texts), given


@pytest.mark.parametrize("parts", [1, 5, 9])
def test_what_parts_can_share_keeps_all_near_copies(monkeypatch, parts):
    monkeypatch.setattr(near_copies, "LEAST_K", parts)
    r = np.random.default_rng(4)
    sizes, counts, alike = [], [], []
    for n in (*r.integers(1, 400, 300), 3000, 70_000):
        both, a, b = (r.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) for k in (n, *r.integers(0, max(40, n // 7), 2)))
        for s in (np.union1d(both, a), np.union1d(both, b)):
            sizes.append(len(s))
            counts.append(near_copies._counts(s))
        alike.append(5 * len(both) >= 4 * (len(both) + len(a) + len(b)))
    at = np.arange(0, len(sizes), 2)
    sizes = np.array(sizes)
    kept = near_copies._left_open(at, at + 1, sizes[at], sizes[at + 1], near_copies._coarse(counts))
    assert kept[alike].all() and 0 < sum(alike) < len(alike)
    assert parts < 9 or not kept.all()


def test_long_chains_of_copies_are_one_group(spark):
    r, texts = random.Random(13), []
    for _ in range(4):
        words = [f"w{r.randrange(3000)}" for _ in range(300)]
        for _ in range(40):
            texts.append(" ".join(words))
            for _ in range(r.choice([1, 4])):
                words[r.randrange(len(words))] = f"c{r.randrange(3000)}"
    ids = r.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    assert sorted((False, r["doc_id"]) for r in near(spark, docs, "").collect()) == brute_kept(texts, ids)


@pytest.mark.parametrize("marks", [1, 8])
def test_the_bound_on_shared_shingles_keeps_all_near_copies(monkeypatch, marks):
    monkeypatch.setattr(near_copies, "MARKS", marks)
    r = np.random.default_rng(3)
    dealt = lambda s: np.sort(s)[: near_copies._dealt_size(len(s))]
    sizes, bitmaps, alike = [], [], []
    for _ in range(600):
        both, a, b = (r.integers(0, 1 << 63, n, np.uint64) for n in (r.integers(1, 400), *r.integers(0, 40, 2)))
        for s in (np.union1d(both, a), np.union1d(both, b)):
            sizes.append(len(s))
            bitmaps.append(near_copies._marks(dealt(s)))
        alike.append(5 * len(both) >= 4 * (len(both) + len(a) + len(b)))
    sizes, bitmaps = np.array(sizes), np.frombuffer(b"".join(bitmaps), np.uint64).reshape(-1, marks)
    kept = near_copies._may_share(bitmaps[::2], bitmaps[1::2], sizes[::2], sizes[1::2])
    assert kept[alike].all() and 0 < sum(alike) < 600
    assert marks == 1 or not kept.all()


def test_near_stage_on_awkward_rows(spark):
    given = rows()
    found = near(spark, spark.createDataFrame(given, SCHEMA).repartition(3), "")
    assert found.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == brute_kept([r[1] for r in given], [r[0] for r in given])
    assert near(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


@pytest.mark.parametrize("stage", [drop_near_copies, near_copies.drop_similar])
def test_rows_without_an_id_or_with_one_id_stay(spark, stage):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(12)]
    ids = [None] * 5 + [7] * 4 + [1, 2, 3]
    given = list(zip(ids, texts, strict=True)) + [(None, texts[0]), (None, texts[9]), (7, texts[10])]
    found = stage(spark.createDataFrame(given, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, (type(found[0])(doc_id=i, text=t) for i, t in zip(ids, texts, strict=True))))
