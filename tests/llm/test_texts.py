"""Suffix dedup, SimHash, quality rules and the language model against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import language_model, quality, simhash, suffix_dedup
from tests.llm.data import SCHEMA, rows

ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def data(row):
    return (row[1] or "").encode()


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 8, 1])
def test_repeated_spans(docs, most):
    seen = Counter(t[i : i + 200] for t in map(data, ROWS) for i in range(len(t) - 199))
    want = Counter()
    for r in ROWS:
        text, cover = data(r), np.zeros(len(data(r)), bool)
        for i in range(len(text) - 199):
            if seen[text[i : i + 200]] > 1:
                cover[i : i + 200] = True
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want[r[0], len(text), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~cover])).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.repeated_spans(docs, most=most).drop("spans").collect()) == want


def test_long_texts_are_cut_into_parts(monkeypatch):
    text = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(40))
    whole = [suffix_dedup.anchors(d, e)[1:] for d, e, _, _ in suffix_dedup.chunks([text])]
    parts = [(p + o[0], f + o[0], t + o[0]) for d, e, _, o in suffix_dedup.chunks([text], most=100) for _, p, f, t in [suffix_dedup.anchors(d, e)]]
    covered = lambda runs: {(p, s) for place, first, last in runs for p, f, t in zip(place, first, last, strict=True) for s in range(f, t + 1)}
    assert covered(whole) == covered(parts)


def test_equal_hashes_of_different_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "digits", lambda data, digit: np.zeros(len(data) - digit + 1, np.uint64))
    texts = [bytes(range(200)), bytes(range(200)), bytes(range(1, 201)), bytes(range(2, 202))]
    row, first, last = suffix_dedup.radix(np.zeros(4, np.int64), texts, np.array([1, 1, 1, 3]))
    assert (row.tolist(), first.tolist(), last.tolist()) == ([0, 1, 3], [0, 0, 0], [0, 0, 0])


def test_most_frequent_words_come_in_whole_classes(spark):
    counts = spark.createDataFrame([(b"a", 9), (b"b", 9), (b"c", 5), (b"d", 1), (b"e", 1)], "word binary, c long")
    assert language_model.most_frequent(counts, 4) == [(b"a", 9), (b"b", 9), (b"c", 5)]
    assert len(language_model.most_frequent(counts, 9)) == 5 and language_model.most_frequent(counts, 1) == []


def slow_fingerprint(text):
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, bits=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, n in enumerate(ids):
        if n is not None:
            least[find(i)] = min(n, least.get(find(i), n))
    return [least.get(find(i)) for i in range(len(prints))]


def test_near_duplicates(docs):
    prints = [slow_fingerprint(data(r)) for r in ROWS]
    want = Counter(zip((r[0] for r in ROWS), (f"{p:016x}" for p in prints), components(prints, [r[0] for r in ROWS]), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for c in components(prints, [r[0] for r in ROWS])})


def crowd(n=1500, seed=3):
    """Fingerprints in a few tight crowds, so that buckets fill up, and some far from all."""
    r = np.random.default_rng(seed)
    middles = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = r.integers(0, 64, (n, 3))
    found = middles[r.integers(0, 4, n)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), axis=1)
    return np.unique(np.concatenate([found, r.integers(0, 1 << 63, 300, dtype=np.uint64)]))


def test_index_loses_no_link_in_crowds():
    prints = crowd()
    a, b = simhash.link(prints, np.zeros(len(prints), np.int64))
    assert np.bitwise_count(a ^ b).max() <= 64
    place = {int(p): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(place[x])] = find(place[y])
    want = components([int(p) for p in prints], list(range(len(prints))))
    assert len({find(i) for i in range(len(prints))}) == len(set(want)) and len(a) == len(prints) - len(set(want))


@pytest.mark.parametrize("full", [20, 10_000])
def test_full_buckets_are_dealt_again(spark, full):
    from quire.llm.common import Scratch

    prints = crowd(300)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    scratch = Scratch(spark, "test")
    found = simhash.components(scratch.table(simhash.links(frame, scratch, full=full), "links")).collect()
    groups = {r["node"]: r["component"] for r in found}
    named = [groups.get(int(p), int(p)) for p in prints.view(np.int64)]
    want = components([int(p) for p in prints], list(range(len(prints))))
    assert len(set(zip(named, want, strict=True))) == len(set(named)) == len(set(want))


def slow_repeats(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_quality_measures(docs):
    want = Counter()
    for r in ROWS:
        words = data(r).split()
        lines = [x for x in data(r).split(b"\n") if x.split()]
        n = slow_repeats(words)
        want[r[0], len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), n, len(words) < 20 or 100 * n > 30 * len(words)] += 1
    found = quality.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == want
    assert not any(r["kept"] for r in found if r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)


def slow_measures(text):
    """By measure its value and its chances, in plain Python."""
    words = text.split()
    n, lines = len(words), [x for x in text.split("\n") if x.split()]
    often = Counter(words)
    repeats = slow_repeats(words)
    return {
        "symbol_share": (sum(c in "#*$%&|<>" for c in text) / n, n),
        "word_length": (sum(map(len, words)) / n, n),
        "repeat_share": (repeats / n, n / 8),
        "dup_share": ((len(lines) - len(set(lines))) / len(lines), len(lines)),
        "top_share": (max(often.values()) / n, n),
        "upper_share": (sum("A" <= c <= "Z" for c in text) / sum(map(len, words)), n),
    }


def slow_verdicts(given):
    """Kept or not, by whole sorted lists in place of sketches. given: (text, lang, source), ASCII white space only."""
    found = [slow_measures(t) if t.split() else None for t, _, _ in given]

    def middle_and_spread(values):
        low, middle, high = (sorted(values)[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75))
        return middle, min(high - middle, middle - low)

    out = []
    for (text, lang, source), own in zip(given, found, strict=True):
        words = text.split()
        good = len(words) >= 20 and 100 * slow_repeats(words) <= 30 * len(words)
        for name, (value, n) in (own or {}).items():
            in_lang = [f[name][0] for f, (_, x, _) in zip(found, given, strict=True) if f and x == lang]
            in_source = [f[name][0] for f, (_, x, y) in zip(found, given, strict=True) if f and (x, y) == (lang, source)]
            whole, part, weight = middle_and_spread(in_lang), middle_and_spread(in_source), len(in_source) / (len(in_source) + 50)
            for middle, spread in (whole, tuple(weight * a + (1 - weight) * b for a, b in zip(part, whole, strict=True))):
                good &= value <= middle + spread + max(12 * spread, 6 * math.sqrt((middle + 1 / n) / n))
        out.append(good)
    return out


def junk_and_prose(seed=4):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(1, 9))) for _ in range(500)]
    found = []
    for i in range(240):
        text = [words[k] for k in r.zipf(1.3, r.integers(15, 200)) % 500]
        kind = i % 12
        if kind == 3:
            text = [w + "#*"[: r.integers(0, 3)] for w in text]
        elif kind == 5:
            text = [w.upper() if r.random() < 0.7 else w for w in text]
        elif kind == 7:
            text = text[:15] + [words[9]] * 40
        lines = [" ".join(text[k : k + 9]) for k in range(0, len(text), 9)]
        if kind == 9:
            lines += [lines[0]] * r.integers(1, 30)
        found.append(("\n".join(lines), ["en", "de"][i % 2], ["a", "b", "", "rare" if i > 220 else "c"][i % 4]))
    return found


def test_verdicts_are_those_of_whole_lists(spark):
    given = junk_and_prose() + [("", "en", "a"), (" \n", "de", "b"), ("one", "en", "rare")]
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(given)], "doc_id long, text string, lang string, source string").repartition(3)
    want = slow_verdicts(given)
    assert {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()} == dict(enumerate(want))
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, x in enumerate(want) if x}
    assert 20 < sum(want) < len(want) - 20


def test_long_texts_are_measured_block_by_block(monkeypatch):
    from quire.llm import common, near_copies

    texts = [data(r) for r in ROWS] + [b"\xc3\xa9" * 50 + b" " + b"a b\n" * 40, b" " * 99 + b"x"]
    modules = {"measure": quality, "fingerprint": simhash, "shingles": near_copies}
    whole = [[getattr(m, f)(t) for t in texts] for f, m in modules.items()]
    for m in modules.values():
        monkeypatch.setattr(m, "word_blocks", lambda text: common.word_blocks(text, 7))
    parts = [[getattr(m, f)(t) for t in texts] for f, m in modules.items()]
    assert whole[:2] == parts[:2] and all((a == b).all() for a, b in zip(whole[2], parts[2], strict=True))


def test_quality_tells_junk_from_prose(spark):
    prose = [(i, " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(1, 60)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{k}###" for k in range(60)), "en", "s1") for i in range(20)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] for i, *_ in prose) and not any(found[i] for i, *_ in junk)


def test_source_of_a_third_that_is_bad_throughout_goes(spark):
    prose = [(i, " ".join(f"word{(i * 31 + k * k) % 997}" for k in range(1, 60)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{(i * 17 + k * k) % 991}{'#' * (k % 2)}" for k in range(60)), "en", "junk") for i in range(150)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs).collect()}
    assert all(found[i] == (False, True) for i, *_ in prose) and all(found[i] == (False, False) for i, *_ in junk)
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {i for i, *_ in prose}


def test_language_model(docs):
    counts, n = Counter(), 0
    held = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2
    for r in ROWS:
        if not held(r):
            counts.update([*data(r).lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    found = language_model.score(docs, outcomes=64, words=30, frequent=80).collect()
    want = Counter()
    for r in ROWS:
        words = [*data(r).lower().split(), None]
        want[r[0], held(r), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4)] += 1
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] < 0 for r in found)


def test_model_probabilities_sum_to_one_and_learn():
    pairs = np.zeros((6, 6))
    for a, b, c in ((0, 1, 50), (1, 2, 50), (2, 3, 40), (2, 4, 10), (3, 0, 40), (4, 0, 10)):
        pairs[a, b] = c
    table = language_model.train_nce(pairs, dimensions=8)
    assert np.allclose((10**table).sum(axis=1), 1)
    assert 10 ** table[1, 2] > 0.8 and 0.6 < 10 ** table[2, 3] < 0.95


@pytest.mark.parametrize("operator", [suffix_dedup.repeated_spans, simhash.near_duplicates, simhash.drop_near_copies, quality.quality_rules, quality.keep_good, language_model.score])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
