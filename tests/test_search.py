"""Search trees against a plain evaluation of the same trees over collected rows."""

import pytest
from pyspark.sql import functions as F

from lectio.operators import build
from lectio.operators import search as S

TEXTS = {(1, 1): "the cat sat on the mat", (1, 2): "a cat and the dog", (2, 1): "dog the the cat", (2, 2): "mat", (3, 1): "cats sit on mats the cat"}


@pytest.fixture(scope="module")
def table(spark):
    v = spark.createDataFrame([(d, s, t, s == 1 and d == 2) for (d, s), t in TEXTS.items()], "division int, slot int, text string, is_formula boolean")
    t = build.with_handles(build.segment(v, lambda p: p != "")).withColumn("form", F.col("word"))
    root = F.when(F.length("word") > 2, F.regexp_replace("word", "[aeiou]", ""))
    return t.withColumns({"root": root, "lemma": F.regexp_replace("word", "s$", ""), "pos": F.when(F.length("word") > 3, "L").otherwise("S"), "segment_id": F.concat_ws(":", "division", "slot")}).cache()


def plain(rows, node):
    """Handles of a tree, by definition."""
    k, v, of = node.kind, node.value, node.of
    pick = lambda test: {h for h, r in rows.items() if test(r)}
    if k in ("exact", "normalised"):
        return pick(lambda r: r["word"] == v)
    if k == "prefix":
        return pick(lambda r: r["word"].startswith(v))
    if k == "root":
        return pick(lambda r: r["root"] == v)
    if k == "pos":
        return pick(lambda r: r["pos"] == v)
    if k == "all":
        return set(rows)
    if k == "not":
        return set(rows) - plain(rows, of[0])
    if k == "and":
        out = set(rows) if of else set()
        for n in of:
            out &= plain(rows, n)
        return out
    if k == "or":
        return set().union(*(plain(rows, n) for n in of))
    if k == "scoped":
        divisions, span = v
        return {h for h in plain(rows, of[0]) if (not divisions or rows[h]["division"] in divisions) and (not span or (rows[h]["division"] == span[0] and span[1] <= rows[h]["slot"] <= span[2] and not rows[h]["is_formula"]))}
    a, b = plain(rows, of[0]), plain(rows, of[1])
    out = set()
    for x in a:
        for y in b:
            same = rows[x]["segment_id"] == rows[y]["segment_id"]
            if k == "near" and x != y and abs(x - y) <= v and (same or node.options["cross"]):
                out |= {x, y}
            if k == "followed_by" and same and rows[y]["position"] == rows[x]["position"] + 1:
                out |= {x, y}
    return out


INNER = [
    S.normalised("the"), S.prefix("ca"), S.root("ct"), S.not_(S.root("ct")), S.or_(S.pos("L"), S.exact("dog")), S.and_(S.prefix("m"), S.not_(S.exact("mat"))), S.and_(), S.and_(S.not_(S.pos("L"))),
    S.near(S.exact("the"), S.prefix("cat"), 2), S.near(S.exact("the"), S.exact("the"), 3), S.near(S.exact("cat"), S.exact("dog"), 4, cross_segment=True), S.followed_by(S.exact("the"), S.exact("cat")),
    S.not_(S.followed_by(S.exact("the"), S.exact("cat"))), S.and_(S.exact("the"), S.near(S.exact("the"), S.exact("on"), 1)), S.or_(S.exact("dog"), S.followed_by(S.exact("on"), S.all_())),
]
SCOPES = [((), None), ((1,), None), ((1, 3), None), ((), (1, 2, 2)), ((2,), (2, 1, 2)), ((9,), None)]


@pytest.mark.parametrize("scope", SCOPES, ids=str)
def test_grid(spark, table, scope):
    rows = {r["handle"]: r for r in table.collect()}
    search = S.Search(table, lambda c: c)
    for inner in INNER:
        node = S.scoped(inner, *scope)
        assert {r["handle"] for r in search.hits(node).select("handle").collect()} == plain(rows, node), node


def test_lemma_fallback_is_for_the_whole_corpus(table):
    search = S.Search(table.withColumn("lemma_key", F.upper("lemma")), F.upper)
    assert search.hits(S.lemma("cat")).count() == 5
    assert search.hits(S.lemma("Cat")).count() == 5
    assert search.hits(S.lemma("nothing")).count() == 0


def test_patterns_and_references(table):
    search = S.Search(table, lambda c: c)
    assert {r["word"] for r in search.hits(S.pattern("?at*")).collect()} == {"cat", "mat", "cats", "mats", "sat"}
    assert search.hits(S.pattern("c.t")).count() == 0
    assert search.hits(S.reference("1:1-2")).count() == 11
    for bad in ("1", "1:3-2", "a:b"):
        with pytest.raises(ValueError):
            S.reference(bad)


def test_pages_and_counts(table):
    search = S.Search(table, lambda c: c)
    assert [r["handle"] for r in search.page(S.all_(), 2, 5).collect()] == [5, 6, 7, 8, 9]
    assert search.page(S.and_(S.exact("nowhere at all")), 1, 5).count() == 0
    assert search.page(S.all_(), 99, 5).count() == 0 and search.page(S.all_(), 0, 0).count() == 1
    got = {r["query_id"]: r["total"] for r in search.count_queries({"a": S.exact("the"), "b": S.followed_by(S.exact("the"), S.exact("cat")), "c": S.and_()}).collect()}
    assert got == {"a": 6, "b": 6, "c": 0}
    assert search.search(S.exact("the"), include_formula=False).count() == 4


def test_params(spark):
    line = "text=a;corpus=1;numbering=n;formula=true;cross_segment=false;strict=false;profile=p"
    rows = spark.createDataFrame([(line,), ("text=a",), (line + ";x=1",), (line.replace("text", "texts"),)], "p string")
    got = [r[0] for r in rows.select(S.parse_params(F.col("p"))).collect()]
    assert got[0]["profile"] == "p" and got[1:] == [None] * 3


def test_batches_place_only_rows_that_a_positional_node_can_hit(table):
    """a row outside all operands is counted without a place; under not_ every row keeps its own."""
    search = S.Search(table, lambda c: c)
    cat, near = S.exact("cat"), S.near(S.exact("cat"), S.exact("dog"), 3)
    few = {"near": near, "not near": S.not_(near), "others": S.not_(cat), "across": S.near(cat, S.exact("mat"), 2, cross_segment=True)}
    every = few | {"over not": S.near(S.not_(near), S.exact("mat"), 2)}
    for trees, placed in ((few, table.filter("form in ('cat', 'dog', 'mat')").count()), (every, table.count())):
        batch, seen = S.Batch(search), []
        apart = batch.apart
        batch.apart = lambda df, nodes, apart=apart, seen=seen: seen.append(apart(df, nodes)) or seen[-1]
        got = {r["query_id"]: r["total"] for r in batch.counts(trees).collect()}
        assert got == {k: search.hits(t).count() for k, t in trees.items()}
        assert seen[0].filter("handle is not null").count() == placed
