"""Sharding and URL rules against brute force."""

import heapq
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import sharding, url_rules
from tests.llm.data import SCHEMA, rows

ROWS = rows()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 200), st.integers(1, 120), min_size=1, max_size=12), st.integers(1, 7))
def test_schedule_is_as_good_as_one_by_one(histogram, shards):
    classes = [(s, n, s * n) for s, n in sorted(histogram.items(), reverse=True)]
    given_out = sharding.schedule(classes, shards)
    assert [sum(g) for g in given_out] == [n for _, n, _ in classes]
    loads = [sum(s * g[i] for (s, _, _), g in zip(classes, given_out, strict=True)) for i in range(shards)]
    heap = [0] * shards
    for s, n, _ in classes:
        for _ in range(n):
            heapq.heapreplace(heap, heap[0] + s)
    assert max(loads) <= max(heap) + 1e-6


def test_sharding(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    found = sharding.shard(docs, 5).collect()
    assert len(found) == len(ROWS)
    text_of = {r[0]: r[1] or "" for r in ROWS}
    shards, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    for f in found:
        slots[f["shard"]].append(f["slot"])
        loads[f["shard"]] += f["size"]
        assert (f["law"], f["grown_shard"]) == ("bytes", None)
        if f["doc_id"] is not None:
            text = text_of[f["doc_id"]]
            assert (f["size"], f["text_crc32"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
            shards[text].add(f["shard"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(5))
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


URLS = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("https://ORG", "org", "", None, "allow"),
    ("http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://m.Example.org/en/12?x#y", "m.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("x://a.com/fr/?q", "a.com", "/fr/", "com/fr/", "allow"),
    ("x://a.com/de/#f", "a.com", "/de/", "com/de/", "block"),
    ("x://a.com/FR/", "a.com", "/FR/", None, "allow"),
    ("no scheme.org/", "", "", None, "allow"),
    ("a://b://c.org/d", "b:", "//c.org/d", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, (u, *_) in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: tuple(r)[1:5] for r in url_rules.url_filter(pages, labels).collect()}
    assert [found[i] for i in range(len(URLS))] == [tuple(u[1:]) for u in URLS]
    assert url_rules.url_filter(pages.where("false"), labels).collect() == []


def test_mined_rules(spark):
    urls = [f"http://{'spam' if i % 4 == 0 else 'good'}.x{i % 3}.net/{'buy' if i % 2 == 0 else 'read'}/{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r["verdict"] for r in url_rules.url_filter(pages, labels).collect()}
    assert all(found[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


DEEP = {
    "host": "http://{}.b.c.d.e.net/x",
    "path": "http://a.net/1/2/3/4/5/{}",
    "query": "http://a.net/x?k1=1&k2=2&k3=3&{}=4",
    "long": "http://a.net/" + "/".join(f"part{i}" for i in range(40)) + "/{}",
}


@pytest.mark.parametrize("kind", DEEP)
def test_markers_deep_in_a_url_are_mined_and_matched(spark, kind):
    urls = [DEEP[kind].format("spam" if i % 3 == 0 else f"good{i % 7}") for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r["mined"] for r in url_rules.url_filter(pages, labels).collect()}
    assert found == {i: i % 3 == 0 for i in range(300)}


def test_each_token_of_a_class_makes_the_rule(spark):
    urls = [f"http://a.net/{'one/two' if i % 3 == 0 else 'three'}" for i in range(150)] + ["http://a.net/one", "http://a.net/two", "http://a.net/four"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r["mined"] for r in url_rules.url_filter(pages, labels).collect()}
    assert [found[i] for i in (150, 151, 152)] == [True, True, False]


@pytest.mark.parametrize("rules", [[("a", "b"), ("b", "c"), ("d",)], []])
def test_inverted_index_finds_what_a_scan_finds(rules):
    index = url_rules.inverted_index(rules)
    for own in ({"a", "b"}, {"b"}, {"d", "x"}, {"a", "c"}, set()):
        assert any(r <= own for t in own for r in index.get(t, ())) == any(set(r) <= own for r in rules)
