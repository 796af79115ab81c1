import collections
import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lectio.operators import analytics as N
from lectio.operators import annotate, audit, render, research
from lectio.plans import queries
from lectio.plans.views import tokens
from lectio.streaming import events as E


def test_similar_verses(spark):
    sets = {"t": "salah zakah faith", "a": "salah zakah", "b": "salah p q r s u", "c": "zz", "d": "salah zakah"}
    pairs = spark.createDataFrame([(v, r) for v, rs in sets.items() for r in rs.split()], "verse string, root string")
    got = [(r["other"], round(r["score"], 3)) for r in N.similar_verses(pairs).filter("verse = 't'").orderBy("rank").collect()]
    assert got == [("a", 0.667), ("d", 0.667), ("b", 0.125)]
    assert N.similar_verses(pairs, min_df=2).filter("verse = 't'").count() == 0
    shared = N.shared_roots(N.similar_verses(pairs), pairs).filter("verse = 't' and other = 'a'").first()
    assert sorted(shared["shared_roots"]) == ["salah", "zakah"]


def test_similar_verses_by_brute_force(spark, monkeypatch):
    """Classes of equal sets, sets that share one root, two or more, and large sets, against all pairs."""
    draw = random.Random(4)
    sets = {f"v{i:03}": {f"r{int(draw.paretovariate(0.7)) % 40}" for _ in range(draw.choice([1, 1, 2, 3, 8]))} for i in range(160)}
    pairs = spark.createDataFrame([(v, r) for v, rs in sets.items() for r in rs], "verse string, root string")
    df = collections.Counter(r for rs in sets.values() for r in rs)
    for paired, k, stop in ((48, 3, {"min_df": 30}), (2, 3, {"min_df": 30}), (1, 8, {"share": 0.5}), (4, 1, {"min_df": 1000})):
        monkeypatch.setattr(N, "PAIRED", paired)
        limit = stop.get("min_df") or 0.5 * len(sets)
        kept = {v: {r for r in rs if df[r] < limit} for v, rs in sets.items()}
        got = collections.defaultdict(dict)
        for r in N.similar_verses(pairs, k, **stop).collect():
            got[r["verse"]][r["rank"]] = (r["other"], r["shared"], r["union"])
        for v, own in kept.items():
            near = [(o, len(own & x), len(own | x)) for o, x in kept.items() if o != v and own & x]
            assert got.get(v, {}) == dict(enumerate(sorted(near, key=lambda x: (-x[1] / x[2], -x[1], x[0]))[:k], 1)), (v, stop)
        split = {r["verse"]: (set(r["kept"]), set(r["excluded"])) for r in N.split_roots(pairs, **stop).collect()}
        assert split == {v: (kept[v], rs - kept[v]) for v, rs in sets.items()}


def test_registered_verse_queries_keep_roots_of_fewer_than_500_verses(spark, sf):
    sets = collections.defaultdict(set)
    for r in N.verse_roots(tokens(spark, sf, handles=False)).collect():
        sets[r["verse"]].add(r["root"])
    df = collections.Counter(root for own in sets.values() for root in own)
    assert {(r["root"], r["verses"]) for r in queries.n7_stoplist(spark, sf).collect()} == {x for x in df.items() if x[1] >= 500}
    kept = {v: {r for r in own if df[r] < 500} for v, own in sets.items()}
    assert any(40 <= n < 500 for n in df.values())
    got, together = collections.defaultdict(dict), collections.defaultdict(dict)
    for r in queries.n8_similar_verses(spark, sf).collect():
        got[r["verse"]][r["rank"]] = (r["other"], r["shared"], r["union"])
    for r in queries.n9_co_occurrence(spark, sf).collect():
        together[r["root"]][r["rank"]] = (r["other"], r["shared"])
    for v in sorted(kept)[::7]:
        pairs = [(o, len(kept[v] & own), len(kept[v] | own)) for o, own in kept.items() if o != v and kept[v] & own]
        best = sorted(pairs, key=lambda x: (-x[1] / x[2], -x[1], x[0]))[:8]
        assert got.get(v, {}) == dict(enumerate(best, 1))
    for root in sorted(df)[::7]:
        counts = collections.Counter(o for own in sets.values() if root in own for o in own if o != root and df[o] < 500)
        assert together.get(root, {}) == dict(enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12], 1))


def test_co_occurrence(spark):
    pairs = spark.createDataFrame([(v, r) for v, rs in {"1": "s z", "2": "s z p", "3": "s q"}.items() for r in rs.split()], "verse string, root string")
    got = [(r["other"], r["shared"]) for r in N.co_occurrence(pairs).filter("root = 's'").orderBy("rank").collect()]
    assert got == [("z", 2), ("p", 1), ("q", 1)]


def test_gloss_groups(spark):
    rows = [("g", "a", "l1", 0), ("g", "a", "l1", 1), ("g", "a", "l2", 2), ("G.", "b", "l3", 3), ("g", None, None, 4)]
    t = spark.createDataFrame([(*r, f"t{r[3]}") for r in rows], "gloss string, root string, lemma string, handle long, token_id string")
    got = [(r["root"], r["lemma"], r["count"]) for r in N.gloss_groups(t).orderBy("rank").collect()]
    assert got == [("a", "l1", 2), ("a", "l2", 1), ("b", "l3", 1), (None, None, 1)]
    assert sorted((r["root"] or "", r["token_id"]) for r in N.gloss_occurrences(t).collect()) == [("", "t4"), ("a", "t0"), ("a", "t1"), ("a", "t2"), ("b", "t3")]
    index = N.gloss_index(t).first()
    assert (index["total"], index["root_count"], index["display"]) == (5, 3, "g")


def test_divergence_and_lookup(spark):
    lines = spark.createDataFrame([("v1", "x", "But lo! with hardship goeth ease"), ("v1", "y", "Verily relief comes after pain"), ("v2", "x", "the merciful")], "verse_id string, edition string, text string")
    got = {r["verse_id"]: (r["least"], r["divergent"]) for r in N.divergence(lines).collect()}
    assert got["v1"] == (0.0, True) and got["v2"] == (1.0, False)
    assert [r["verse_id"] for r in N.reverse_lookup(lines, "Merciful one").collect()] == ["v2"]
    assert N.reverse_lookup(lines, "ame").count() == 0 and N.reverse_lookup(lines, " ").count() == 0


def test_pages(spark):
    v = spark.createDataFrame([(1, s) for s in range(1, 62)] + [(2, s) for s in range(1, 61)], "division int, slot int")
    got = {(r["division"], r["page"]): r["n"] for r in N.assign_pages(v).groupBy("division", "page").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, 1): 40, (1, 2): 21, (2, 1): 60}


def test_rendering(spark):
    rows = [("v", 1, "a", "la", "k1", "the king", "A"), ("v", 2, "b", "lb", "k2", "king of", "B"), ("v", 3, "c", "lc", "k3", "men", "A"), ("w", 1, "d", "ld", None, None, None)]
    t = spark.createDataFrame(rows, "segment_id string, position int, form string, lemma string, key string, english string, grade string")
    got = {r["segment_id"]: r for r in render.render_edition(t).collect()}
    assert got["v"]["text"] == "the king of men" and got["v"]["spans"] == [[2, 1]]
    assert got["w"]["text"] is None and got["w"]["undecided"] == ["d"]
    other = spark.createDataFrame([("k2", "followed_by", "lc", "ruler of")], "key string, direction string, neighbour string, english string")
    assert render.render_edition(t, other).filter("segment_id = 'v'").first()["text"] == "the king ruler of men"
    rows = [("v", 1, "a", "la", "k1", "greater", "A", None, None, True), ("v", 2, "b", "lb", "k2", "from king", "A", "from kings", "P", False), ("v", 3, "c", "lc", "k3", "from here", "A", "", "P", None)]
    t = spark.createDataFrame(rows, "segment_id string, position int, form string, lemma string, key string, english string, grade string, plural string, number string, elative boolean")
    assert render.render_edition(t).first()["text"] == "greater than kings from here"


def test_review_of_an_edition(spark):
    rows = [("v", 1, "a", "k1", "to come", "A"), ("v", 2, "b", "k2", "come", "B"), ("v", 3, "c", "k3", "near it", "C"), ("w", 1, "d", None, None, None), ("w", 2, "e", "k1", "x", "B"), ("x", 1, "a", "k1", "x", "A")]
    t = spark.createDataFrame(rows, "segment_id string, position int, form string, key string, english string, grade string").withColumn("lemma", F.lit("l"))
    got = render.render_edition(t, parts=True)
    verse = got.filter("segment_id = 'v'").first()
    assert (verse["text"], verse["spans"], verse["words"]) == ("to come near it", [[2, 2]], 4)
    assert [tuple(r) for r in render.review_words(got).collect()] == [("v", 3, "c", "near it", "C")]
    assert tuple(render.coverage(got).first()) == (3, 2, 1, 3)
    assert {tuple(r) for r in render.grade_totals(got).collect()} == {("A", 2), ("C", 1)}
    assert tuple(render.coverage(got.limit(0)).first()) == (0, 0, 0, 0) and render.review_words(got.limit(0)).count() == 0


def test_draft_annotations(spark):
    verses = spark.createDataFrame([(2, 1, "2:1"), (2, 2, "2:2"), (2, 2, "2:2")], "division int, slot int, segment_id string")
    rows = [("p", "flagged", "s", 2, 1, 2), ("p", "flagged", "s", 2, 2, 2), ("p", "flagged", "t", 2, 2, 9), ("p", "verified", "u", 2, 1, 1), ("q", "flagged", "s", 9, 1, 1), ("q", "flagged", "s", None, None, None)]
    got = audit.audit_annotations(spark.createDataFrame(rows, "article string, status string, summary string, division int, first int, last int"), verses)
    assert sorted(tuple(r) for r in got.collect()) == [("p", "2:1", "[p] s"), ("p", "2:2", "[p] s"), ("p", "2:2", "[p] t")]
    pins = spark.createDataFrame([("p", "2:1"), ("r", "2:2")], "article string, segment_id string")
    assert {r["article"]: (r["pins"], r["annotations"]) for r in audit.draft_totals(pins, got).collect()} == {"p": (1, 3), "r": (1, 0)}


def test_claims(spark):
    text = "Intro line.\nQuran Al-Bakarah 2:43\nوَأَقِيمُوا الصَّلَاةَ\nIn 8:82:820 and 6:38-39 we read. The root word for Salat (صلاة) is (تصل) here.\nBaraka (بَرَكَة)"
    rows = audit.extract_claims(spark.createDataFrame([("x", text), ("y", None)], "article string, text string"))
    claims = {(c["kind"], c["division"]): c for c in rows.collect()}
    ref = claims["reference", 2]
    assert (ref["raw"], ref["name"], ref["first"], ref["last"], ref["triple"], ref["line"]) == ("Quran Al-Bakarah 2:43", "Al-Bakarah", 43, 43, False, 2) and ref["quote"].startswith("وَأَقِيمُوا")
    assert claims["reference", 8]["triple"] and claims["reference", 6]["last"] == 39 and claims["reference", 6]["quote"] is None
    assert claims["root", None]["target"] == "صلاة" and claims["root", None]["quote"] == "تصل"
    assert {r["latin"] for r in rows.filter("kind = 'translit'").collect()} >= {"Baraka", "Salat"}
    assert rows.filter("article = 'y'").count() == 0
    once = audit.dedupe_claims(rows.unionByName(rows))
    assert once.count() == rows.count()


def test_pairing_of_quotes(spark):
    """The quote of a reference follows it with fewer than 400 characters and no Latin letter between; the second is loose."""
    run, other = "\u0628\u062a", "\u062b\u062c"
    texts = {"near": f"2:1 - {run} 1 {other}", "prose": f"2:1 so {run}", "far": f"2:1 {'.' * 400}{run}", "between": f"2:1 2:2 {run}", "first": f"{run} 2:1"}
    rows = audit.extract_claims(spark.createDataFrame(list(texts.items()), "article string, text string"))
    got = sorted((r["article"], r["first"], r["quote"]) for r in rows.filter("kind = 'reference' and quote is not null").collect())
    assert got == [("between", 2, run), ("near", 1, run)]
    loose = sorted((r["article"], r["quote"]) for r in rows.filter("kind = 'loose'").collect())
    assert loose == [("far", run), ("first", run), ("near", other), ("prose", run)]
    long = "x" * 60 + " 2:43 " + "y" * 60
    (row,) = audit.extract_claims(spark.createDataFrame([("a", "first\n" + long)], "article string, text string")).collect()
    assert (row["line"], row["at"], row["excerpt"]) == (2, 67, "…" + long[16:106] + "…")


def test_draft_claims(spark):
    texts = {
        "box": "# T\n[box]\nThis is quoted text in a box, skip it.\n[/box]\nIs this a real question here?\nThis line is a plain claim. More.",
        "open": "[box] never closed\nThis line would be a claim if it stood outside.",
        "short": "Too short.\n_All of this is emphasis and no claim._",
        "code": "[gallery id=1] The claim of this article is \u0628\u062a stated without a stop",
    }
    rows = audit.extract_draft_claims(spark.createDataFrame([*texts.items(), ("none", None)], "article string, text string"))
    assert {r["article"]: r["claim"] for r in rows.collect()} == {
        "box": "This line is a plain claim.", "open": None, "short": None, "code": "The claim of this article is stated without a stop", "none": None,
    }


def test_names_and_overlap(spark):
    names = spark.createDataFrame([(27, "An-Naml"), (5, "Al-Maida"), (24, "An-Nur")], "number int, canonical string")
    named = spark.createDataFrame([("Al-Maida", 27), ("An-Noor", 24)], "name string, number int")
    got = {r["name"]: (r["status"], r["best_number"]) for r in audit.verify_names(named, names).collect()}
    assert got == {"Al-Maida": ("flagged", 5), "An-Noor": ("verified", 24)}
    pairs = spark.createDataFrame([("Salat", "صلاة"), ("Rafa", "درجة"), ("Oui", "كتب")], "latin string, quote string")
    assert {r["latin"]: r["status"] for r in audit.verify_translit(pairs).collect()} == {"Salat": "verified", "Rafa": "unchecked"}


def test_root_claims_and_references(spark):
    tokens = spark.createDataFrame([("الصلوه", "ص ل و"), ("الزكوه", "ز ك و")], "form string, root string")
    claims = spark.createDataFrame([(1, "صلاة", "صلو"), (2, "صلاة", "تصل"), (3, "qqq", "x")], "claim_id int, target string, claimed string")
    assert {r["claim_id"]: r["status"] for r in audit.verify_root_claims(claims, tokens).collect()} == {1: "verified", 2: "flagged", 3: "unchecked"}
    refs = spark.createDataFrame([(1, None, 2, 1, 2, False), (2, None, 2, 999, 999, False), (3, None, 8, 82, 82, True), (4, "Bukhari", 2, 1, 1, False)], "ref_id int, name string, division int, first int, last int, triple boolean")
    verses = spark.createDataFrame([(2, 1), (2, 2)], "division int, slot int")
    got = {r["ref_id"]: (r["status"], r["severity"]) for r in audit.verify_references(refs, verses, spark.createDataFrame([], "name string, best_score double")).collect()}
    assert got == {1: ("verified", "low"), 2: ("flagged", "high"), 3: ("unchecked", "low"), 4: ("unchecked", "low")}


def test_admission_forgets_denied_events():
    assert [a for a, _ in E.admit_times([0, 1, 2, 3], [], 2, 10)[0]] == [True, True, False, False]
    assert [a for a, _ in E.admit_times([0, 1, 5, 10, 11, 12], [], 2, 10)[0]] == [True, True, False, True, True, False]


def test_admission_stream_equals_batch(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("k", str(i % 3), i, at + dt.timedelta(seconds=7 * i)) for i in range(60)]
    table = spark.createDataFrame(rows, "kind string, subject string, event_id long, ts timestamp")
    folder, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    table.filter("event_id < 30").coalesce(1).write.mode("append").parquet(folder)
    table.filter("event_id >= 30").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = E.admit_stream(stream, 2, 60, "1 hour").writeStream.format("parquet").option("checkpointLocation", out + "/c").trigger(availableNow=True).start(out + "/d")
    query.awaitTermination()
    got = {(r["event_id"], r["allowed"]) for r in spark.read.parquet(out + "/d").collect()}
    assert got == {(r["event_id"], r["allowed"]) for r in E.admit(table, 2, 60).collect()}


def test_payments_are_idempotent(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    first = spark.createDataFrame([("a", "PENDING", t(1)), ("a", "SUCCEEDED", t(5)), ("b", "PENDING", t(2))], "ref string, status string, ts timestamp")
    again = spark.createDataFrame([("a", "SUCCEEDED", t(3)), ("a", "PENDING", t(9)), ("b", "SUCCEEDED", t(8))], first.schema)
    folder = tempfile.mkdtemp(prefix="spark-")
    sink = E.payments_sink(folder)
    for epoch, batch in ((0, first), (1, again), (1, again)):
        sink(batch, epoch)
    got = {r["ref"]: (r["status"], r["first_success"]) for r in E.payments_table(spark, folder).collect()}
    assert got == {"a": ("SUCCEEDED", t(3)), "b": ("SUCCEEDED", t(8))}


def test_gate_order(spark):
    f = spark.createDataFrame([(None, True), (True, True), (False, False)], "a boolean, b boolean").select(research.first_failure(("x", F.col("a")), ("y", F.col("b"))).alias("f"))
    assert [r["f"] for r in f.collect()] == ["y", "x", None]


def test_best_verse_by_brute_force(spark, sf, monkeypatch):
    draw = random.Random(6)
    base = ["".join(draw.choice("bcdfg") for _ in range(draw.randint(0, 60))) for _ in range(150)] + [None, "", "b", "漢字漢字", "b\U0001f600c" * 5]
    near = [t[: len(t) // 2] + "bd" + t[len(t) // 2 :] for t in base[:20]]
    verses = spark.createDataFrame([(f"v{i}", (i % 7, i), t) for i, t in enumerate(base + near + base[:3])], "verse_id string, seq struct<a: int, b: int>, blob string")
    quotes = spark.createDataFrame([(i, t) for i, t in enumerate(near + base + ["xyz" * 9, "b", near[0]])], "quote_id int, blob string")
    place = {r["verse_id"]: tuple(r["seq"]) for r in verses.collect()}
    cover = audit.coverage(quotes, verses).collect()
    for least, quotes_, cells in ((0.85, 512, 4_000_000), (0.85, 7, 90), (0.4, 50, 4_000_000)):
        monkeypatch.setattr(audit, "QUOTES", quotes_)
        monkeypatch.setattr(audit, "CELLS", cells)
        want = {}
        for r in cover:
            if r["coverage"] >= least:
                want.setdefault(r["quote_id"], []).append((-r["coverage"], place[r["verse_id"]], r["verse_id"]))
        got = {r["quote_id"]: (-r["coverage"], place[r["verse_id"]], r["verse_id"]) for r in audit.best_verse(quotes, verses, least).collect()}
        assert got == {q: min(rows) for q, rows in want.items()}
    assert audit.best_verse(quotes.limit(0), verses).count() == 0


def test_bounds_leave_few_verses_to_count(spark, sf):
    blobs = lambda name: [r[0] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(F.explode(F.split("text", "\n")).alias("t")).select(queries.blob(F.col("t"))).collect()]
    block = audit.Covered([b for b in blobs("benchmark") if len(b) > 40])
    block.by_enough(blobs("documents"), audit.MATCH)
    assert 0 < block.tried < block.pairs / 3


def test_transliteration_sources(spark):
    rows = [(1, "كتّب", None), (2, "كتب", "kataba"), (3, "كتب", ""), (4, "ـ", None), (5, None, None), (6, None, "x")]
    got = annotate.transliterate(spark.createDataFrame(rows, "id int, surface string, given string"), "edition")
    assert {r["id"]: (r["transliteration"], r["transliteration_source"]) for r in got.collect()} == {1: ("kttb", "computed"), 2: ("kataba", "edition"), 3: ("ktb", "computed"), 4: (None, None), 5: (None, None), 6: ("x", "edition")}


def test_root_entries(spark):
    profiles = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "root string, occurrences long")
    matches = spark.createDataFrame([("a", "k", "direct"), ("b", None, "missing")], "root string, key string, match string")
    articles = spark.createDataFrame([("k", 2, "later"), ("k", 1, "first"), ("z", 0, "other")], "key string, seq int, entry string")
    got = {r["root"]: (r["occurrences"], r["entry_key"], r["match"], r["entry"]) for r in N.root_entries(profiles, matches, articles).collect()}
    assert got == {"a": (3, "k", "direct", "first"), "b": (1, None, "missing", None), "c": (2, None, "missing", None)}


def test_decisions_move_no_token(spark, monkeypatch):
    """Tokens meet their decisions where they are; many decisions give the same by a shuffle."""
    rows = [(1, "a-b", "ab", "N", "abx"), (2, "a-b", "abe", "N", "abey"), (3, None, "o", "P", "o"), (4, None, "io", "P", "io"), (5, "c-d", "cd", "N", "cd"), (6, None, None, None, None)]
    t = spark.createDataFrame(rows, "token_id int, root string, lemma string, pos string, form string")
    table = spark.createDataFrame([("a-b", "x", "A"), ("a-b|ab|N", "y", "B"), ("a-b|abe", "", "B"), ("form:o", "z", "C"), ("form:io|io", "w", "D"), ("form:io", "v", None)], "key string, english string, grade string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.resolve_decisions(t, table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        found = sorted(map(tuple, out.select("token_id", "key", "english", "grade").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [(1, "a-b|ab|N", "y", "B"), (2, "a-b", "x", "A"), (3, "form:o", "z", "C"), (4, "form:io|io", "w", "D"), (5, None, None, None), (6, None, None, None)]
    monkeypatch.setattr(N, "FEW", 0)
    assert sorted(map(tuple, N.resolve_decisions(t, table).select("token_id", "key", "english", "grade").collect())) == found


def test_words_of_a_text_at_once(spark, tmp_path):
    """Patterns that run over whole texts give each word what they give it alone."""
    from lectio.plans import views

    texts = ["Ab  c-D 12 ΟΔΟΣ. ΣΑΣ­, İx 𝐀b", " lead\tTab  \nthe THÉing's", "\n\n", "", None, "- -- 7"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    names = ["division", "slot", "position", "word", "form", "root", "lemma", "pos", "token_id"]
    own, alone = (sorted(map(tuple, views.tokens(spark, str(tmp_path), handles=False, places=p).select(*names).fillna("-").collect())) for p in (False, True))
    assert own == alone and len(own) == 9


def test_documents_move_no_word(spark):
    """Words come from the text or from a table, with the same documents; from the text nothing but pages of texts moves."""
    from lectio.operators import exports
    from lectio.plans.views import words_of

    verses = spark.createDataFrame([(1, 1, "The big dog"), (1, 2, "- 3"), (1, 3, "in thE end"), (2, 1, "so")], "division bigint, slot int, text string")
    lines = spark.createDataFrame([("1:3", "b", "two"), ("1:3", "a", "one"), ("01:1", "a", "no verse"), ("9:9", "a", "none"), ("x", "a", "none")], "verse_id string, edition string, text string")
    words = verses.select("division", "slot", F.inline(words_of(F.col("text"))))
    both = [sorted(map(tuple, exports.division_documents(verses, w, lines, 2).collect())) for w in (words_of, words)]
    assert both[0] == both[1] and [r[:2] for r in both[0]] == [(1, 0), (1, 1), (2, 0)]
    assert both[0][1][2] == '{"division":1,"page":1,"verse_count":3,"verses":[{"id":"1:3","slot":3,"text":"in thE end","tokens":[{"position":1,"word":"in"},{"position":2,"word":"thE","root":"t-h"},{"position":3,"word":"end","root":"n-d"}],"translations":[{"edition":"a","text":"one"},{"edition":"b","text":"two"}]}]}'
    assert '"id":"1:1","slot":1' in both[0][0][2] and "no verse" not in both[0][0][2] and '"tokens":[],"translations":[]' in both[0][0][2]
    plan = exports.division_documents(verses, words_of, lines, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_collisions_send_the_first_of_each_task(spark):
    """Only the first k forms of a root leave a task; a form of two roots counts for both."""
    t = spark.createDataFrame([("tan", "t-n"), ("ton", "t-n"), ("tin", "x-y"), ("tin", "t-n"), ("atena", "z-z"), ("tena", "z-z"), ("tarn", "z-z")], "form string, root string")
    out = N.collisions(t, "aeiou", 2)
    assert sorted(map(tuple, out.collect())) == [("t-n", "atena", 1), ("t-n", "tena", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "keys=[root" not in plan
    assert N.collisions(t, "aeiou", 9).filter("root = 't-n' and form = 'tin'").count() == 1


def test_draft_claims_agree_with_their_sql(spark, tmp_path):
    """Script, tabs, other spaces and line ends mean the same to the query and its SQL."""
    import duckdb

    odd = "A word كتب of the other script. More", "\tA line after a tab that goes on\t. And", " A line after another space goes on", "A line of a separator goes on here! Yes", "_an emphasised line of words_\r", "A line that ends in a separator. ", "A line\x0bof a vertical tab goes. On"
    texts = [*odd, "\n".join(odd), "x [box] y\nno claim at all stands in here [/box] z\n[See] a claim that stands outside boxes. It", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = queries.SQL["u13_draft_claims"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    own = sorted(map(tuple, queries.FOUND["u13_draft_claims"](spark, str(tmp_path)).collect()))
    assert own == sorted(duckdb.connect().execute(sql).fetchall()) and own[0] == ("0", "A word of the other script.")


def test_draft_claims_keep_their_digits(spark, tmp_path):
    """Lines lose spaces at their ends, not the digits of their place among the lines."""
    import duckdb

    texts = ["0997 was the first line of all. So", "Too short.\n1219538 words and a line. So", "Too short.\n  # a line of spaces before its mark\n  A line of spaces around it goes on  ", "Too short.\nThe line that ends in a number 1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = queries.SQL["u13_draft_claims"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    own = sorted(map(tuple, queries.FOUND["u13_draft_claims"](spark, str(tmp_path)).collect()))
    assert own == sorted(duckdb.connect().execute(sql).fetchall())
    assert [r[1] for r in own] == ["0997 was the first line of all.", "1219538 words and a line.", "A line of spaces around it goes on", "The line that ends in a number 1"]


def test_a_root_page_reads_tokens_once(spark):
    """Counting, numbering and the page itself read the root's segments, not the tokens."""
    t = spark.createDataFrame([(f"1:{k // 2}", k, f"t{k}", "a-b" if k % 3 else "c-d") for k in range(30)], "segment_id string, handle bigint, token_id string, root string")
    out = N.root_occurrences(t, "a-b", 9, 4)
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert [r["segment_id"] for r in rows] == ["1:12", "1:13", "1:14"] and rows[0]["pages"] == 4 and rows[0]["token_ids"] == ["t25"]


def test_a_lemma_is_looked_up_in_words_alone(spark):
    """Tokens that cost a join aren't made to see whether a lemma is known."""
    from lectio.operators import search as S

    t = spark.createDataFrame([(1, "on")], "handle bigint, lemma string")
    costly = t.withColumn("handle", F.raise_error(F.lit("made")).cast("bigint") + F.col("handle")).filter("handle > 0")
    search = S.Search(costly, lambda c: c, words=t)
    assert search._lemma_known("on") and not search._lemma_known("off")


def test_roots_are_counted_where_their_division_is(spark, sf):
    """tokens dealt by division don't move to be counted by verse and division."""
    from lectio.plans.views import texts, tokens

    t = tokens(spark, sf, handles=False, of=texts(spark, sf).repartition("division"))
    plan = N.root_places(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(division" in plan
    rows = t.filter("root is not null").select("root", "division", "slot", "position", "token_id", "form", "lemma").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r["division"], r["slot"], r["position"])):
        want.setdefault(r["root"], []).append(r)
    got = {r["root"]: r for r in N.root_profiles(t).collect()}
    assert got.keys() == want.keys()
    for root, own in want.items():
        division = [r["division"] for r in own]
        sizes = [len({r[c] for r in own}) for c in ("division", "form", "lemma")] + [len({(r["division"], r["slot"]) for r in own})]
        assert [got[root][c] for c in ("divisions", "forms", "lemmas", "verses")] == sizes
        assert (got[root]["first_id"], got[root]["last_id"], got[root]["occurrences"]) == (own[0]["token_id"], own[-1]["token_id"], len(own))
        assert got[root]["most_in_division"] == max(division.count(d) for d in set(division))


def test_neighbours_and_urls_without_handles(spark, sf):
    """words move once, to their form, and gloss keys are made of different words alone."""
    from lectio.plans.views import texts, tokens

    v = texts(spark, sf)
    t = tokens(spark, sf, handles=False, of=v.repartition("division"))
    profiles = N.word_profiles(t)
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(division" in plan and "ShuffledHashJoin" in plan
    rows = sorted(t.collect(), key=lambda r: (r["division"], r["slot"], r["position"]))
    ids = [None, *[r["token_id"] for r in rows], None]
    forms, own = collections.Counter(r["form"] for r in rows), {}
    for r in rows:
        own.setdefault(r["root"], []).append(r["form"])
    got = {r["token_id"]: r for r in profiles.collect()}
    for k, r in enumerate(rows):
        p = got[r["token_id"]]
        assert (p["previous_id"], p["next_id"], p["form_total"]) == (ids[k], ids[k + 2], forms[r["form"]])
        assert (p["root_total"], p["root_forms"]) == ((None, None) if r["root"] is None else (len(own[r["root"]]), len(set(own[r["root"]]))))
    index = N.gloss_index(t, "word")
    assert "posexplode" not in index._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [0, 40, 250_000])
def test_word_profiles_move_no_token(spark, sf, monkeypatch, most):
    """Totals of rarer forms come by division, those of common ones are broadcast; no token goes to its form."""
    from lectio.plans.views import texts, tokens

    monkeypatch.setattr(N, "COMMON", most)
    v = texts(spark, sf)
    profiles = N.word_profiles(tokens(spark, sf, handles=False, of=v.repartition("division")), counted=tokens(spark, sf, handles=False, of=v))
    plan = profiles._jdf.queryExecution().optimizedPlan().toString().split("posexplode")[0]
    assert "rightHint=(strategy=shuffle_hash)" in plan and plan.count("strategy=broadcast") >= 2
    rows = tokens(spark, sf, handles=False, of=v).select("token_id", "form").collect()
    forms = collections.Counter(r["form"] for r in rows)
    got = profiles.select("token_id", "form_total").collect()
    assert len(got) == len(rows) and dict(map(tuple, got)) == {r["token_id"]: forms[r["form"]] for r in rows}
    assert [N._least_common(spark.createDataFrame([(n,) for n in (1, 1, 2, 3, 4, 9)], "n long"), k) for k in (0, 1, 2, 3, 4, 9)] == [16, 8, 4, 4, 2, 1]


@pytest.mark.parametrize("together", [False, True])
def test_rendering_agrees_with_the_rule_word_by_word(spark, together):
    """Verses of any length, over the edges of batches; a first english word that repeats the last one given is left out if the keys differ."""
    rng = random.Random(5)
    said = ["the king", "king", "King of", "of", " ", "of the", "the", None, ""]
    rows = []
    for v in range(300):
        for p in range(1, rng.choice([1, 2, 5, 40]) + 1):
            rows.append((f"v{v}", p, f"f{p}", rng.choice(["a", "b", "", None]), rng.choice(said[:7] if v % 3 else said), rng.choice(["A", "B", "", None])))
    want = {}
    for v in range(300):
        own = [r for r in rows if r[0] == f"v{v}"]
        undecided, out, spans, given, last = [r[2] for r in own if not r[4]], [], [], [], None
        for _, p, form, key, english, grade in [] if undecided else own:
            words = english.split()
            if last and words and out and out[-1].lower() == words[0].lower() and last != key:
                words = words[1:]
            if words:
                given.append((p, form, " ".join(words), grade))
                spans += [[len(out), len(words)]] if grade and grade != "A" else []
            out += words
            last = key
        want[f"v{v}"] = (None if undecided else " ".join(out), spans, len(out), undecided, given)
    t = spark.createDataFrame(rows, "segment_id string, position int, form string, key string, english string, grade string").withColumn("lemma", F.lit("l")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["segment_id"]: (r["text"], r["spans"], r["words"], r["undecided"], list(map(tuple, r["parts"]))) for r in render.render_edition(t, parts=True, together=together).collect()}
        assert got == want
        louder = render.render_edition(t, inflect=lambda e, w: f"{e.upper()} {w['position']}", together=together).filter("text is not null and words > 0").first()
        assert louder["text"] == louder["text"].upper() and louder["text"].split()[-1].isdigit()
        if together:
            with pytest.raises(Exception, match="stand together"):
                render.render_edition(t.filter("position <> 2"), together=True).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_editions_move_no_token(spark, sf):
    for name in ("n19_review", "n19_grades", "n19_coverage", "n19_render"):
        plan = queries.FOUND[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "RepartitionByExpression" not in plan and "Sort" not in plan and "Window" not in plan, name
