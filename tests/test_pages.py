"""Pages, addresses, dispatch, stages and relations on small cases worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.markup import anchors, readable
from tidemark.operators import graph
from tidemark.operators import knowledge as kn
from tidemark.sources import feeds, pages


def around(html):
    bare = readable(html)
    return [(a["inner"], None if a["around"] is None else bare[a["around"] : a["until"]]) for a in anchors(bare)]


@pytest.mark.parametrize(("html", "expected"), [
    ("<div>A<ul><li>one <a href=q>in</a><li>two <div>t<a href=z></a> u</div></ul> end</div> free <a href=k>f</a>", [("in", "one <a href=q>in</a>"), ("", "t<a href=z></a> u"), ("f", None)]),
    ("<div><div>in</div> out <a href=a>x</a></div>", [("x", "<div>in</div> out <a href=a>x</a>")]),
    ("<li>a<ul><li>b <a href=1>x</a></ul> c <a href=2>y</a>", [("x", "b <a href=1>x</a>"), ("y", "a<ul><li>b <a href=1>x</a></ul> c <a href=2>y</a>")]),
    ("</div><section><a href=1>one<a href=2>two", [("one", "<a href=1>one<a href=2>two"), ("two", "<a href=1>one<a href=2>two")]),
    ("", []),
])
def test_closest_containers(html, expected):
    assert around(html) == expected


def test_dropped_elements():
    assert readable("a<nav><nav>x</nav>y</nav>b<!-- <p> --><script>if (a<b) '<script>'</script>c<aside>open") == "a b  c open"
    assert readable("a<form/>b</footer>c") == "a b c"


def test_page_items_edges(spark):
    rows = [
        (1, "https://e.example.com/a/b", '<ul><li>On 2024-01-02 <a href="c?d=1" aria-label="A label long enough"></a></ul><h2>Heading of a part</h2><p>' + "words " * 20),
        (2, "https://e.example.com/", None), (3, "https://e.example.com/", ""), (4, "https://e.example.com/", "<div><a>without an address</a></div>"),
    ]
    found = pages.page_items(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.place, r.title, r.url) for r in found] == [(1, 1, "A label long enough", "https://e.example.com/a/c?d=1"), (1, 2, "Heading of a part", "https://e.example.com/a/b#heading-of-a-part")]
    assert found[0].excerpt == "On 2024-01-02" and str(found[0].published_at) == "2024-01-02 00:00:00"
    only = pages.page_items(spark.createDataFrame(rows, "page_id long, url string, html string"), ["#heading"]).collect()
    assert [r.title for r in only] == ["Heading of a part"]


@pytest.mark.parametrize(("url", "expected"), [
    ("https://e.example.com/ä b?q=ü&utm_x=1", "https://e.example.com/%C3%A4%20b?q=%C3%BC"), ("https://e.example.com/a/%2E%2e/b/.", "https://e.example.com/b/"), ("https://e.example.com/../..", "https://e.example.com/"),
    ("https://127.1/", None), ("https://0177.0.0.1/", None), ("https://0x8.8/", "https://8.0.0.8/"), ("https://134744072/", "https://8.8.8.8/"), ("https://4294967296/", None), ("https://1.2.3.4.5/", None), ("https://09.1.1.1/", None), ("https://a.1b/", "https://a.1b/"),
])
def test_addresses(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(tx.canonical_url(F.col("u")).alias("u")).first().u == expected


def test_dispatch_caps_each_parser(spark):
    hits = [{"title": f"t{i}", "objectID": str(i)} for i in range(5)]
    notes = [{"id": f"n{i}", "title": f"t{i}"} for i in range(5)]
    rows = [("h", "json", "hacker-news", None, json.dumps({"hits": [{"objectID": "x"}, *hits]})), ("o", "json", "openreview-notes", None, json.dumps({"notes": notes})), ("x", "json", "none", None, "{}")]
    found, unread = feeds.dispatched(spark.createDataFrame(rows, "source_id string, kind string, parser string, content_type string, body string"), 2)
    assert sorted((r.source_id, r.title) for r in found.collect()) == [("h", "t0"), ("h", "t1"), ("o", "t0"), ("o", "t1")]
    assert [(r.source_id, r.route) for r in unread.collect()] == [("x", "unsupported")]


def test_relations_follow_merges_and_unite(spark):
    relations = spark.createDataFrame([("a", "extends", "x", 0.2, ["1", "2"]), ("a", "extends", "z", 0.9, ["2", "3"]), ("y", "extends", "z", 0.5, ["4"]), ("a", "extends", "p", 0.5, ["5"]), ("a", "extends", "gone", 0.5, None)], "slug string, type string, target string, confidence double, urls array<string>")
    merges = spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q"), ("q", "p")], "src string, dst string")
    formal = spark.createDataFrame([("a",), ("z",), ("p",), ("q",)], "slug string")
    assert [tuple(r) for r in graph.canonical_relations(relations, merges, formal).collect()] == [("a", "extends", "z", 0.9, ["1", "2", "3"])]


def test_superseded_and_still_concepts(spark):
    rows = [("a", 3, 1, 1, 0, "emerging", 400, None, True, 0), ("b", 3, 1, 1, 0, "cooling", 10, 10, True, 1), ("c", 3, 1, 1, 0, "cooling", 10, 10, True, 0), ("d", 3, 1, 1, 0, "validated", 200, 10, False, 0), ("e", 3, 1, 1, 0, "validated", 200, None, False, 0)]
    df = spark.createDataFrame(rows, "slug string, groups int, official_groups int, practitioner_groups int, conflicts int, current string, idle int, age int, superseded boolean, stage_age int")
    done = kn.lifecycle(df, F.lit(True), F.col("current"), F.col("idle"), F.lit(True), F.lit(True), F.col("age"), F.col("superseded"), F.col("stage_age"))
    assert {r.slug: (r.stage, r.maturity) for r in done.collect()} == {"a": ("archived", 100), "b": ("archived", 100), "c": ("validated", 100), "d": ("validated", 100), "e": ("cooling", 100)}
