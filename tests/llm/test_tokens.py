"""Token counts and packing against the library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import tokens
from quire.llm.packing import pack, pack_lengths, placements
from quire.llm.queries import tokenizer_path
from quire.llm.token_counts import frequent_words, token_counts
from tests.llm.data import SCHEMA, rows

ROWS = rows()
PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return tokens.id_encoder(PATH, tokens.frequent(PATH))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab 1.é'\n\t\r!日  ", "\x85", "\x1c", "<|endoftext|>", "the", " of", "'ll"]), max_size=24).map("".join))
def test_same_ids_as_the_library(library, own, text):
    assert b"".join(own.parts(text)) == tokens.packed_ids(library.encode(text, add_special_tokens=False).ids)


def test_pattern_cuts_all_characters_alike(library):
    import regex

    pattern, cut = regex.compile(tokens.PRE_TOKEN), library.pre_tokenizer.pre_tokenize_str
    for c in [*range(1, 0x3000), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}{chr(c)}b"
            assert len(cut(text)) == len(pattern.findall(text)), hex(c)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    monkeypatch.setattr(tokens, "AT_ONCE", 5)
    own = tokens.count_encoder(PATH, tokens.lengths(PATH, ["the", "a", "c"]))
    for text in [r[1] or "" for r in ROWS]:
        assert sum(own.parts(text)) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(docs, library):
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in ROWS)
    assert Counter(tuple(r) for r in token_counts(docs, PATH).collect()) == want


def test_frequent_words_are_measured(docs):
    often = Counter(w for r in ROWS for w in (r[1] or "").replace("\n", " ").split(" ") if 0 < len(w) <= 64)
    found = frequent_words(docs, 50)
    assert len(found) == 50 and min(often[w] for w in found) >= sorted(often.values())[-50]


def test_other_files_are_refused(tmp_path):
    import json

    held = json.loads(open(PATH, encoding="utf-8").read())
    held["added_tokens"].append(held["added_tokens"][0] | {"id": 7, "content": "<x>"})
    (tmp_path / "other.json").write_text(json.dumps(held))
    with pytest.raises(ValueError):
        tokens.lengths(str(tmp_path / "other.json"), ["a"])


def test_packing(docs, library):
    found = pack(docs, PATH, 256).collect()
    sequences, per_doc = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r["length"] for r in found) / (256 * len(sequences)) > 0.9
    for r in ROWS:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        if r[0] is None or r[0] == ROWS[20][0]:
            continue
        pieces = sorted(per_doc[r[0]], key=lambda p: p["start"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 256)) and {p["doc_tokens"] for p in pieces} == {len(ids)}
        assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_patterns_use_every_piece_once(histogram):
    patterns = pack_lengths(histogram, 64)
    used = Counter()
    for pattern, count in patterns:
        assert count > 0 and sum(pattern) <= 64
        for length in pattern:
            used[length] += count
    assert used == Counter(histogram)
    for starts, _, _ in placements(patterns).values():
        assert starts == sorted(starts)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts(empty, PATH).collect() == [] and pack(empty, PATH).collect() == []
