"""The written search table (regions, buckets), batches of mixed trees, and stored completions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectio.operators import order
from lectio.operators import search as S
from lectio.plans.views import tokens
from lectio.plans.views import plain as normal
from tests.test_search import INNER, SCOPES, plain, table  # noqa: F401


@pytest.fixture(scope="module")
def written(spark, table):  # noqa: F811
    S.write_search_table(S.search_table(table), "searched", buckets=2, region=5)
    yield S.open_search_table(spark, "searched", lambda c: c)
    for name in ("searched", "searched_regions"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan_of(df)))


@pytest.mark.parametrize("scope", SCOPES, ids=str)
def test_grid_on_a_written_table(table, written, scope):  # noqa: F811
    rows = {r["handle"]: r for r in table.collect()}
    for inner in INNER:
        node = S.scoped(inner, *scope)
        assert {r["handle"] for r in written.hits(node).select("handle").collect()} == plain(rows, node), node


def files_read(df):
    df.collect()
    metrics = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    return metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0  # nothing at all is scanned


def test_a_scope_reads_only_its_regions(spark, table, written):  # noqa: F811
    places = {r["handle"]: (r["division"], r["slot"]) for r in table.collect()}
    files = [int(re.search(r"region=(\d+)", f)[1]) for f in written.table.inputFiles()]
    assert len(written.regions) == len(set(files)) == len({h // 5 for h in places}) > 3
    for scope in [((1,), None), ((3,), None), ((2, 3), None), ((), (1, 2, 2)), ((), (3, 1, 1)), ((9,), None)]:
        own = {h // 5 for h, (d, s) in places.items() if (not scope[0] or d in scope[0]) and (not scope[1] or (d == scope[1][0] and scope[1][1] <= s <= scope[1][2]))}
        assert files_read(written.hits(S.scoped(S.prefix("c"), *scope))) == sum(f in own for f in files) < len(files), scope
    assert files_read(written.hits(S.reference("3:1"))) < len(files) == files_read(written.hits(S.prefix("c")))


def test_plans_on_a_written_table(written):
    assert exchanges(written.hits(S.near(S.exact("the"), S.prefix("cat"), 2)).select("handle")) == 0
    assert exchanges(written.hits(S.followed_by(S.exact("the"), S.exact("cat"))).select("handle")) == 0
    rooted = plan_of(written.hits(S.root("C t")).select("handle"))
    assert "EqualTo(root_key,ct)" in rooted
    assert "StringStartsWith(form,ca)" in plan_of(written.hits(S.pattern("ca*")).select("handle"))


def drawn(draw, deep=3):
    if not deep or draw.random() < 0.25:
        return draw.choice([S.exact("the"), S.prefix("ca"), S.root("ct"), S.pos("L"), S.all_(), S.exact("dog"), S.prefix("m"), S.exact("on"), S.and_(), S.or_()])
    own = lambda: drawn(draw, deep - 1)
    return draw.choice([
        lambda: S.near(own(), own(), draw.randint(0, 4), draw.random() < 0.4),
        lambda: S.followed_by(own(), own()),
        lambda: S.and_(own(), own()),
        lambda: S.or_(own(), own(), own()),
        lambda: S.not_(own()),
        lambda: S.scoped(own(), *draw.choice(SCOPES)),
    ])()


def test_a_batch_is_one_scan(table, written, monkeypatch):  # noqa: F811
    monkeypatch.setattr(S, "BLOCK", 5)
    rows = {r["handle"]: r for r in table.collect()}
    draw = random.Random(5)
    trees = {f"q{i}": drawn(draw, 2 if i % 10 == 0 else 1) for i in range(200)}
    bad = {"kind": S.Node("rhymes", "x"), "deep": S.not_(S.near(S.exact("a"), S.exact("b"), -2)), "text": S.near(S.exact("a"), S.exact("b"), "2"), "one": S.Node("near", 2, (S.all_(),), {"cross": False})}
    out = written.count_queries(trees | bad)
    got = {r["query_id"]: (r["ok"], r["total"]) for r in out.collect()}
    assert got == {k: (True, len(plain(rows, t))) for k, t in trees.items()} | {k: (False, None) for k in bad}
    one = written.count_queries({k: t for k, t in trees.items() if not any(n.options.get("cross") for n in S.Batch(written).walk(t))})
    assert plan_of(one).count("FileScan") == 1 and exchanges(one) == 1  # the last one brings the counts together


def test_page_numbers_are_running_sums(spark):
    draw = random.Random(1)
    keys = [draw.choice([draw.randrange(-(2**62), 2**62), draw.randrange(10_000), 2**40 + draw.randrange(9000)]) for _ in range(3000)]
    df = spark.createDataFrame([(k, i, 1 + i % 3) for i, k in enumerate(keys)], "k long, i int, n int")
    got = [r["before"] for r in order.running_before(df, "k", F.col("n"), "before", ["i"]).orderBy("k", "i").collect()]
    total, want = 0, []
    for _, _, n in sorted((k, i, 1 + i % 3) for i, k in enumerate(keys)):
        want.append(total)
        total += n
    assert got == want
    assert order.running_before(df.limit(0), "k", F.col("n"), "before").count() == 0


def test_tokens_start_one_job(spark, sf):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tokens", "")
    t = tokens(spark, sf)
    jobs = len(tracker.getJobIdsForGroup("tokens"))
    spark.sparkContext.setJobGroup("other", "")
    # One for the files' schema, one for the counts.
    assert jobs <= 2 and plan_of(t.select("token_id", "handle")).count("FileScan") <= 2  # texts, and first lines that recur
    assert t.agg(F.count("*"), F.min("handle"), F.max("handle") + 1, F.count_distinct("handle")).first()[2] == t.count()
    assert normal is not None


def test_completions(spark):
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(300)} | {"x" * 70 + "y", "x" * 70 + "z", "x" * 66})
    counts = {w: draw.randint(1, 50) for w in words}
    kinds = {"form": words, "root": words[::2]}
    rows = [(k, w, counts[w]) for k, ws in kinds.items() for w in ws]
    names = [(i, n) for i, n in enumerate(["Abacus", "cab", "Bab", "aaba", "cabab", ""])]
    frame = lambda r: spark.createDataFrame(r, "kind string, value string, count long")
    vocabulary, named = frame(rows), spark.createDataFrame(names, "number int, value string")
    typed = {w[:n] for w in words for n in range(1, len(w) + 1)} | {"", "nothing", "abac"}
    whole = S.completions(vocabulary, 4)
    # Vocabulary that is added later gives the same table, also where counts of known values grow.
    half = [(k, w, n - 1) for k, w, n in rows if n > 1 and w < "b"]
    rest = [(k, w, 1 if n > 1 and w < "b" else n) for k, w, n in rows]
    later = S.add_completions(S.completions(frame(half), 4), S.completions(frame(rest), 4), 4)
    key = lambda df: {(r["kind"], r["prefix"], r["value"]): (r["count"], r["place"]) for r in df.collect()}
    assert key(whole) == key(later)
    got = {}
    for r in S.suggest(spark.createDataFrame([(t,) for t in typed], "prefix string"), whole, named, vocabulary, first=4).collect():
        got.setdefault(r["prefix"], {})[r["rank"]] = (r["kind"], r["value"], r["count"])
    for prefix in typed - {""}:
        want = [("name", n, None) for _, _, n in sorted((not n.lower().startswith(prefix), i, n) for i, n in names if prefix in n.lower())[:3]]
        for kind, most in (("root", 3), ("form", 99)):
            ranked = sorted([w for w in kinds[kind] if w.startswith(prefix)][:4], key=lambda w: (-counts[w], w))[:most]
            want += [(kind, w, counts[w]) for w in ranked]
        assert [v for _, v in sorted(got.get(prefix, {}).items())] == want[:8], prefix
    assert "" not in got
