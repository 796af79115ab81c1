"""Replaceable citation tables, parts of merged words and nested exports."""

import collections
import json
import random
import tempfile

from pyspark.sql import functions as F

from lectio.operators import annotate, build, exports, research
from lectio.plans import queries


def test_replacing_citations_rewrites_their_buckets_only(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/citations"
    frame = lambda rows: spark.createDataFrame(rows, "investigation_id long, kind string, key string")
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "investigation_id long")
    rows = {(i, k, f"{i % 5}") for i in range(200) for k in ("TOKEN", "ROOT")}
    research.replace_citations(path, ids(range(200)), frame(sorted(rows)))
    stored = lambda: collections.Counter(tuple(r) for r in research.stored_citations(spark, path).collect())
    files = lambda: set(spark.read.parquet(path).inputFiles())
    bucket = {r[0]: r[1] for r in ids(range(200)).select("investigation_id", research._bucket()).collect()}
    assert stored() == collections.Counter(rows)
    before, changed = files(), list(range(10))
    new = [(i, "SEGMENT", "s") for i in changed if i != 3] + [(150, "TOKEN", "not replaced")]
    want = collections.Counter({r for r in rows if r[0] not in changed} | {r for r in new if r[0] != 150})
    for _ in range(2):  # Doing it again changes nothing.
        research.replace_citations(path, ids(changed), frame(new + new[:2]))
        assert stored() == want
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in {bucket[i] for i in changed}}
    assert kept and kept <= files() and not (before - kept) & files()
    research.replace_citations(path, ids(range(200)), frame([]))
    assert not stored()


def test_parts_of_merged_words(spark):
    t = spark.createDataFrame([(1, 1, p, w) for p, w in enumerate(["ab", "cd", "x", "il", "yas", "p", "q", "r"], 1)], "division int, slot int, position int, word string")
    made = [(1, ["a", "b", "cd"]), (2, ["x"]), (3, ["il yas"]), (4, ["pq"]), (5, ["zz"]), (6, ["r"])]
    words = spark.createDataFrame([(1, 1, w, "".join(p), [(x, f"k{i}") for i, x in enumerate(p)]) for w, p in made], "division int, slot int, word int, surface string, parts array<struct<text string, kind string>>")
    aligned = annotate.align(t, words)
    got = {(r["position"], r["word"]): (r["tier"], None if r["parts"] is None else [tuple(p) for p in r["parts"]]) for r in annotate.attach_parts(aligned, t, words).collect()}
    assert got == {
        (1, 1): ("merged", [("a", "k0"), ("b", "k1")]),
        (2, 1): ("merged", [("cd", "k2")]),
        (3, 2): ("exact", [("x", "k0")]),
        (4, 3): ("merged", [("il", "k0")]),
        (5, 3): ("merged", [("yas", "k0")]),
        (6, 4): ("failed", None),
        (7, 4): ("failed", None),
        (8, 5): ("failed", None),
        (None, 6): ("failed", None),
    }


def test_running_sums_of_long_arrays(spark, monkeypatch):
    draw = random.Random(1)
    rows = [[draw.randint(1, 9) for _ in range(n)] for n in (0, 1, 2, 3, 10, 99, 100, 101)]
    for run in (512, 1):
        monkeypatch.setattr(build, "RUN", run)
        got = spark.createDataFrame([(r,) for r in rows], "z array<int>").select("z", build.running_sums(F.col("z")).alias("s")).collect()
        for z, s in got:
            assert s == [sum(z[:i]) for i in range(len(z))]


def test_exports(spark):
    v = spark.createDataFrame([(1, s, f"text {s}") for s in (1, 2, 3)], "division int, slot int, text string")
    t = spark.createDataFrame([(1, 1, 2, "b", "r-b", "b", "b", "1:1:2"), (1, 1, 1, 'a"', None, "a", "a", "1:1:1"), (1, 3, 1, "b", "r-b", "bb", "b", "1:3:1")], "division int, slot int, position int, word string, root string, form string, lemma string, token_id string")
    lines = spark.createDataFrame([("1:1", "y", "two"), ("1:1", "x", "one"), ("9:9", "x", "no verse")], "verse_id string, edition string, text string")
    got = {r["page"]: json.loads(r["document"]) for r in exports.division_documents(v, t, lines, per_page=2).collect()}
    assert [len(got[k]["verses"]) for k in (0, 1)] == [2, 1] and got[0]["verse_count"] == 3
    assert got[0]["verses"][0]["tokens"] == [{"position": 1, "word": 'a"'}, {"position": 2, "word": "b", "root": "r-b"}]
    assert [x["edition"] for x in got[0]["verses"][0]["translations"]] == ["x", "y"] and got[0]["verses"][1]["tokens"] == [] == got[0]["verses"][1]["translations"]
    roots = {(r["part"], r["page"]): json.loads(r["document"]) for r in exports.root_documents(t, per_page=1).collect()}
    assert roots["summary", 0] == {"root": "r-b", "occurrences": 2, "distinct_forms": 2, "verse_count": 2}
    assert roots["forms", 0]["forms"] == [{"form": "b", "count": 1}] and roots["forms", 1]["forms"] == [{"form": "bb", "count": 1}]
    ld = {(r["kind"], r["id"]): json.loads(r["document"]) for r in exports.json_ld(v, t, "https://x.org", "W").collect()}
    assert len(ld) == 3 + 1 + 3 + 1 and "inDefinedTermSet" not in ld["word", "1:1:1"] and ld["division", "1"]["hasPart"]["numberOfItems"] == 3


def test_alignment_stays_in_its_verse(spark, sf):
    for name in ("a5_alignment", "a5_parts"):
        plan = queries.FOUND[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "hashpartitioning" not in plan, name
    none = spark.createDataFrame([(1, 1, [], [(1, "a")]), (1, 2, [(1, "a"), (2, None)], [(1, "a"), (2, None)]), (1, 3, [(1, "x"), (2, "b")], [])], "division int, slot int, tokens array<struct<position int, token string>>, words array<struct<word int, surface string>>")
    got = [tuple(r) for r in annotate.aligned_tokens(annotate.align_verses(none)).collect()]
    assert sorted(got, key=str) == [(1, 1, None, 1, "failed"), (1, 2, 1, 1, "exact"), (1, 2, 2, 2, "exact"), (1, 3, 1, None, "unaligned"), (1, 3, 2, None, "unaligned")]


def test_words_stay_in_their_verse_and_only_cited_documents_are_read(spark, sf):
    plan = lambda name: queries.FOUND[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    documents = plan("n22_documents")
    assert "Aggregate" not in documents and "Join" not in documents
    quotes = plan("u5_quotes")
    assert quotes.count("documents") == 0 and quotes.count("LeftSemi") == 4


def test_searches_take_folded_roots_from_the_table(spark, sf):
    """F8: no pattern runs over each word's root, and the folded form is the same."""
    from lectio.operators import search as S
    from lectio.plans.queries import searcher

    table = searcher(spark, sf).table
    assert table.filter(~F.col("root_key").eqNullSafe(S.fold_root(F.col("root")))).isEmpty()
    plan = table.filter(searcher(spark, sf).column(S.root("T-H n")))._jdf.queryExecution().optimizedPlan().toString()
    assert "[\\s-]" not in plan
