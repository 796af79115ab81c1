import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectio.operators import annotate, build, validate

FORMULA = "بِسْمِ ٱللَّهِ"


def test_words_and_marks(spark):
    v = spark.createDataFrame([(1, 1, "من ۚ هو"), (1, 2, "ۚ من"), (2, 1, "a  b")], "division int, slot int, text string")
    t = build.segment(v)
    rows = {(r["division"], r["slot"], r["position"]): r for r in t.collect()}
    assert rows[1, 1, 1]["word"] == "من" and rows[1, 1, 1]["following_marks"] == ["ۚ"]
    assert rows[1, 1, 2]["word"] == "هو" and (rows[1, 1, 2]["char_start"], rows[1, 1, 2]["char_end"]) == (5, 7)
    assert rows[1, 2, 1]["leading_marks"] == ["ۚ"] and len(rows) == 5
    assert validate.roundtrip_check(t, v).count() == 0
    assert validate.positions_are_contiguous(t).count() == 0


def test_opening_formula(spark):
    rows = [(1, 1, FORMULA), (2, 1, f"{FORMULA} الم"), (2, 2, "ذلك"), (9, 1, "براءة")]
    v = spark.createDataFrame(rows, "division int, slot int, text string")
    got = {(r["division"], r["slot"]): (r["formula"], r["separated"], r["text"]) for r in build.split_opening(v, [FORMULA]).collect()}
    assert got[1, 1] == (FORMULA, False, FORMULA)
    assert got[2, 1] == (FORMULA, True, "الم") and got[2, 2][0] is None and got[9, 1][0] is None
    for bad in ((3, 1, "الم"), (9, 1, f"{FORMULA} x"), (1, 1, f"{FORMULA} x")):
        with pytest.raises(build.BuildError):
            build.split_opening(spark.createDataFrame([bad], v.schema), [FORMULA])


def test_numbering(spark):
    rows = [(1, "formula", 0), (1, "verse", 1), (1, "verse", 2), (2, "verse", 0)]
    s = spark.createDataFrame(rows, "division int, kind string, seq int")
    out = build.ordinals(s, {"plain": {"counted": ["verse"]}, "full": {"counted": ["verse", "formula"]}, "zero": {"counted": ["verse"], "start_at": 0}})
    got = {(r["division"], r["seq"]): r["ordinals"] for r in out.collect()}
    assert got[1, 0] == {"full": 1} and got[1, 2] == {"plain": 2, "full": 3, "zero": 1} and got[2, 0] == {"plain": 1, "full": 1, "zero": 0}


def test_handles(spark):
    v = spark.createDataFrame([(d, s, "a b c") for d in (7, 1, 900) for s in (2, 1)], "division int, slot int, text string")
    t = build.with_handles(build.segment(v)).orderBy("division", "slot", "position")
    assert [r["handle"] for r in t.collect()] == list(range(18))


def test_same_keys(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "division int, slot int")
    build.assert_same_keys(a, a, ["division", "slot"])
    with pytest.raises(build.BuildError):
        build.assert_same_keys(a, a.limit(1), ["division", "slot"])


def test_tags_and_head(spark):
    rows = [(1, 1, 1, 1, "بِ", "P", ["P", "PREF", "LEM:ب"]), (1, 1, 1, 2, "سْمِ", "N", ["ROOT:سمو", "LEM:اسْم", "M", "GEN"]), (1, 1, 2, 1, "قَالَ", "V", ["PERF", "ROOT:قول", "3MS", "MOOD:IND", "XYZ"])]
    p = annotate.parse_tags(spark.createDataFrame(rows, "division int, slot int, word int, part int, form string, coarse string, tags array<string>"))
    got = {(r["word"], r["part"]): r for r in p.collect()}
    assert got[1, 1]["kind"] == "prefix" and got[1, 1]["pos"] == "P"
    assert (got[1, 2]["root"], got[1, 2]["pos"], got[1, 2]["features"]["gender"], got[1, 2]["features"]["case"]) == ("سمو", "N", "M", "GEN")
    f = got[2, 1]["features"]
    assert (f["tense"], f["person"], f["gender"], f["number"], f["mood"], f["other"]) == ("PERF", "3", "M", "singular", "IND", ["XYZ"])
    words = {r["word"]: r for r in annotate.head_block(annotate.words_from_parts(p)).collect()}
    assert words[1]["surface"] == "بِسْمِ" and words[1]["root"] == "سمو" and words[2]["pos"] == "V"


def test_alignment_tiers(spark):
    t = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "بَعْدَ"), (1, 1, 3, "مَا"), (1, 1, 4, "z"), (2, 1, 1, "أحد"), (2, 1, 2, "y"), (3, 1, 1, "b")], "division int, slot int, position int, word string")
    w = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "بَعْدَمَا"), (1, 1, 3, "q"), (2, 1, 1, "احد"), (2, 1, 2, "y"), (3, 1, 1, "b"), (3, 1, 2, "c")], "division int, slot int, word int, surface string")
    got = {tuple("" if x is None else x for x in r) for r in annotate.align(t, w).collect()}
    assert got == set([(1, 1, 1, 1, "exact"), (1, 1, 2, 2, "merged"), (1, 1, 3, 2, "merged"), (1, 1, 4, 3, "failed"), (2, 1, 1, 1, "normalised"), (2, 1, 2, 2, "exact"), (3, 1, 1, 1, "exact"), (3, 1, "", 2, "failed")])


def test_positional_join(spark):
    w = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1)], "division int, slot int, word int")
    lines = spark.createDataFrame([(1, "x"), (2, ""), (3, "z")], "line_no long, text string")
    got = {tuple(r)[:3]: r["gloss"] for r in annotate.attach_positional(w, lines, lines).select("division", "slot", "word", "gloss").collect()}
    assert got == {(1, 1, 1): "x", (1, 1, 2): None, (2, 1, 1): "z"}
    with pytest.raises(ValueError):
        annotate.attach_positional(w, lines.limit(2), lines)


def test_lexicon(spark):
    roots = spark.createDataFrame([("a", "كتب"), ("b", "مدد"), ("c", "قول")], "root string, print string")
    articles = spark.createDataFrame([(2, "second", "كتب"), (1, "first", "كتب"), (3, "short", "مد"), (4, "none", "")], "seq int, key string, print string")
    got = {r["root"]: (r["key"], r["match"]) for r in annotate.match_lexicon(roots, articles).collect()}
    assert got == {"a": ("first", "direct"), "b": ("short", "geminate"), "c": (None, "missing")}


def test_editions(spark):
    v = spark.createDataFrame([(1, 1), (1, 2)], "division int, slot int")
    e = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "division int, slot int, text string")
    assert annotate.align_edition(e, v).count() == 2
    for bad in (e.limit(1), e.unionByName(spark.createDataFrame([(9, 9, "z")], e.schema))):
        with pytest.raises(build.BuildError):
            annotate.align_edition(bad, v)


def test_checksums_of_files_in_pieces(spark, tmp_path, monkeypatch):
    """Files beyond a piece: any bytes, with and without a last line end or a byte order mark; no task reads one whole."""
    monkeypatch.setattr(validate, "PIECE", 4_000)
    data = np.random.default_rng(3).bytes(30_000)
    (tmp_path / "deep er").mkdir()
    files = {"bytes": data, "end": data[:9_999] + b"\n", "ends": b"\n" * 5_000, "mark": b"\xef\xbb\xbf" + data[:8_000], "marked": b"\xef\xbb\xbf\r\n" * 1_000, "deep er/[a] b": data[7:9_000] + b"\r\r\n", "one line": b"x" * 9_000, "least": data[:4_000], "packed.gz": gzip.compress(data)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("1500", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = {r["file"]: (r["sha256"], r["bytes"]) for r in validate.checksum_inventory(spark, str(tmp_path)).collect()}
            assert got == {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in files.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Only the small ones and the packed one are left to whole reads.
    fed = []
    monkeypatch.setattr(validate, "_in_pieces", lambda spark, path, large: fed.extend(name for name, _ in large.values()) or spark.createDataFrame([], "file string, sha256 string, bytes long"))
    assert validate.checksum_inventory(spark, str(tmp_path)).count() == 2 and set(fed) == set(files) - {"least", "packed.gz"}


def test_checks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    found = validate.checksum_inventory(spark, str(tmp_path))
    manifest = found.withColumn("sha256", F.when(F.col("file") == "a.txt", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("c.txt", "1", 3)], "file string, sha256 string, bytes long"))
    assert {tuple(r) for r in validate.verify_checksums(found, manifest).collect()} == {("a.txt", "sha256"), ("c.txt", "missing")}
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    rules = spark.createDataFrame([("a", "split", ["x", "y"]), ("b", "tombstone", [])], "from string, status string, to array<string>")
    assert {tuple(r) for r in validate.resolve_ids(ids, rules, "id").collect()} == {("a", "x"), ("a", "y"), ("b", None), ("c", "c")}
