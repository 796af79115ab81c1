"""Ranked search against brute force on small tables, and stated edge cases."""

import collections
import math
import re

import numpy as np
import pytest

from lectio.llm import ranking

LONG = " ".join(f"word{i % 97} x{i % 89}" for i in range(6000))
TEXTS = [None, "", " \n\t ", "one", "One two, TWO three!", "Ünï cödé 漢字 😀 x-y_z", LONG, LONG, "one two", "one two", "\x00odd\x01 bytes", "%%% ###", "É é e"]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for (doc, c), n in zip(counted, sizes, strict=True):
            if n:
                m = 75 + 25 * n * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
                scores += [(-s, doc is not None, doc, s)] if s > 0 else []
        out += [(item, r + 1, doc, s) for r, (_, _, doc, s) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, m int, terms string, item int")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, rank string")
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranking.search(d, q, k).collect()], key=str)


def test_terms():
    for t in TEXTS:
        assert [x.decode() for x in ranking.terms_of(t.encode() if t is not None else None)] == terms(t)


def test_search_of_odd_tables(spark):
    docs = list(enumerate(TEXTS)) + [(None, "one two"), (8, "one two"), (7, LONG)]
    items = [(1, "one one two WORD3"), (2, None), (3, ""), (4, "nowhere"), (5, LONG), (1, "one one two WORD3"), (5, "é x"), (None, "three 漢字")]
    for k in (1, 3, 20):
        assert found(spark, docs, items, k) == brute(docs, items, k)
    assert found(spark, docs[:3], items, 3) == [] and found(spark, docs, [], 3) == []


@pytest.fixture(scope="module")
def given(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return docs, [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]


def test_small_parts_and_several_passes(spark, given, monkeypatch):
    """Parts of strata, thresholds that pass parts over, blocks of items and passes change nothing."""
    docs, items = given
    want = brute(docs, items, 5)
    for name, value in (("PART", 3), ("ITEMS", 7), ("SUMS", 50), ("PASS_TERMS", 400)):
        monkeypatch.setattr(ranking, name, value)
    assert found(spark, docs, items, 5) == want


def test_sums_and_bounds():
    items = [collections.Counter({b"a": 1, b"b": 2}), collections.Counter({b"b": 1}), collections.Counter({b"c": 1})]
    w = ranking.Wanted(items, np.array([10, 20, 30]), {b"a": 0, b"b": 1, b"c": 2})
    got = w.sums(np.array([0, 1, 1]), np.array([5, 7, 9]), np.array([0, 0, 1]), 2)
    assert got.tolist() == [[10 * 5 + 40 * 7, 40 * 9], [20 * 7, 20 * 9], [0, 0]]
    assert w.only(np.array([False, True, True])).sums(np.array([1]), np.array([7]), np.array([1]), 2).tolist() == [[0, 140], [0, 0]]
    # A bound takes each term's last run, its highest tf, and no document's score is above it.
    assert ranking._bounds(w, np.array([0, 1, 1]), np.array([5, 7, 9])).tolist() == [10 * 5 + 40 * 9, 20 * 9, 0]
