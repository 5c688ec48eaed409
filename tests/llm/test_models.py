"""The language model's scores and the mined URL rules against plain Python versions of the whole result."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from quire.llm import language_model as L
from quire.llm import url_rules as U
from tests.llm.data import SCHEMA, rows

ROWS = rows()


def test_scores(spark):
    """Outcomes, classes, counts and scores worked out word by word; only the training of the table is the operator's own."""
    outcomes, words, frequent = 64, 30, 80
    held = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2
    tokens = [(r[1] or "").encode().lower().split() for r in ROWS]
    train = [t for r, t in zip(ROWS, tokens, strict=True) if not held(r)]
    counts = Counter(w for t in train for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    own = {w: i + 1 for i, w in enumerate(ranked[:words])}
    n, v = Counter(), Counter()
    for w, c in counts.items():
        if w not in own:
            n[w[-2:]] += c
            v[w[-2:]] += 1
    tails = {t: 1 + words + i for i, t in enumerate(sorted(n, key=lambda t: (-n[t], t))[: outcomes - 2 - words])}
    outside = [t for t in n if t not in tails]
    size = {t: n[t] + v[t] + 1 for t in tails} | {None: sum(n[t] + v[t] for t in outside) + 1}
    outcome = lambda w: own.get(w) or tails.get(w[-2:], outcomes - 1)
    pairs = np.zeros((outcomes, outcomes))
    for t in train:
        path = [0, *map(outcome, t), 0]
        for a, b in itertools.pairwise(path):
            pairs[a, b] += 1
    table = L.train_nce(pairs)
    assert np.allclose((10**table).sum(axis=1), 1)
    want = Counter()
    for r, t in zip(ROWS, tokens, strict=True):
        path = [0, *map(outcome, t), 0]
        told = sum(table[a, b] for a, b in itertools.pairwise(path))
        told += sum(math.log10((counts[w] + 1) / size[w[-2:] if w[-2:] in tails else None]) for w in t if w not in own)
        want[r[0], len(t) + 1, round(told, 1)] += 1
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = L.score(docs, outcomes=outcomes, words=words, frequent=frequent).collect()
    near = {(r[0], r[1]): [] for r in want}
    for (a, b, told), times in want.items():
        near[a, b] += [told] * times
    for r in found:
        match = min(near[r["doc_id"], r["n_tokens"]], key=lambda x: abs(x - r["score"]))
        assert abs(match - r["score"]) < 0.06 + 1e-5 * r["n_tokens"]
        near[r["doc_id"], r["n_tokens"]].remove(match)
    assert not any(near.values())


def test_all_rules_are_found(spark):
    """A page is caught if and only if any combination of its tokens has the support and the confidence."""
    r = random.Random(5)
    for round_, (least, confidence) in enumerate(((5, 0.7), (12, 0.9), (3, 0.55))):
        labelled = []
        for _ in range(200):
            held = sorted({r.choice("abcdefgh") for _ in range(r.randint(0, 5))})
            bad = r.random() < (0.95 if {"a", "c"} <= set(held) or "h" in held and "b" not in held else 0.15)
            labelled.append((held, bad))
        seen, guilty = Counter(), Counter()
        for held, bad in labelled:
            for k in range(1, len(held) + 1):
                for some in itertools.combinations(held, k):
                    seen[some] += 1
                    guilty[some] += bad
        rules = {x for x in seen if guilty[x] >= least and guilty[x] >= confidence * seen[x]}
        mined, classes = U.mine(spark.createDataFrame(labelled, "tokens array<string>, bad boolean").repartition(3), 0.0, least, confidence)
        index = U.inverted_index(mined)
        pages = [set(x) for k in range(9) for x in itertools.combinations("abcdefgh", k)]
        for page in pages:
            held = {classes[t] for t in page if t in classes}
            caught = any(rule <= held for t in held for rule in index.get(t, ()))
            assert caught == any(set(x) <= page for x in rules), (round_, page)
        assert rules and not all(any(set(x) <= p for x in rules) for p in pages)
