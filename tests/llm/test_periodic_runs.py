"""Periodic runs against brute force over all stretches and periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from quire.llm import periodic_runs as P
from tests.llm.data import SCHEMA, rows


def brute(words):
    """Runs as (start, length, period), from their definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)  # periods come in order, so the smallest stays
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def damaged(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_words(monkeypatch):
    r = random.Random(2)
    for at_once in (P.AT_ONCE, 7):
        monkeypatch.setattr(P, "AT_ONCE", at_once)
        for _ in range(250):
            words = np.array([r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(70))], np.int32)
            for _ in range(r.randrange(3)):
                if len(words):
                    a, q = r.randrange(len(words)), r.randint(1, 20)
                    words[a:] = [words[a + (i - a) % q] if a + (i - a) % q < i else words[i] for i in range(a, len(words))]
            assert [(s, e - s, q) for s, e, q in P.find_runs(words).tolist()] == brute(words.tolist())


def test_names_tell_equal_stretches():
    words = np.array([0, 1, 0, 1, 2, 0, 1, 0, 1])
    names = P.Names(words)
    for k in range(4):
        held = [tuple(words[i : i + (1 << k)]) for i in range(len(words) - (1 << k) + 1)]
        assert [[a == b for b in held] for a in held] == [[a == b for b in names[k]] for a in names[k]]


def test_long_repetitive_text():
    n = 200_000
    assert P.find_runs(np.zeros(n, np.int32)).tolist() == [[0, n, 1]]
    words = np.arange(n, dtype=np.int32) % 70_000
    assert P.find_runs(words).tolist() == [[0, n, 70_000]]


def table():
    r = random.Random(8)
    more = [(2000 + i, " ".join(r.choice(["a", "b"]) for _ in range(r.randrange(80)))) for i in range(60)]
    return [(x[0], x[1]) for x in rows()] + more + [(3000, "x y " * 40 + "z " * 15), (3001, "\x0b\t a b \n" * 13), (3002, "q " * 11), (3003, "q " * 12)]


def test_digests_against_brute_force(spark):
    docs = spark.createDataFrame([(a, b, *rows()[0][2:]) for a, b in table()], SCHEMA).repartition(3)
    found = P.run_digests(P.with_repeated_tails(docs))
    want = [expected(i, w, brute(w) if len(w) < 3000 else [(s, e - s, q) for s, e, q in P.find_runs(np.unique(w, return_inverse=True)[1])]) for i, t in table() for w in [damaged(i, t)]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sum(x[1] for x in want) > 40
    plain = P.periodic_runs(docs).where("doc_id = 3000").first()
    assert [tuple(x) for x in plain["runs"]] == [(0, 80, 2), (80, 15, 1)] and plain["collapsed"] == "x y z"


def test_empty_table(spark):
    assert P.run_digests(P.with_repeated_tails(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
