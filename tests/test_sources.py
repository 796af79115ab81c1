import json

import pytest

from lectio.operators.build import BuildError
from lectio.sources import files as S


def test_lines_and_numbers(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("1|1| a b \n# licence\n\n1|2|c|d\n")
    assert {tuple(r) for r in S.read_verse_lines(spark, str(p)).collect()} == {(1, 1, " a b "), (1, 2, "c|d")}
    n = tmp_path / "n.txt"
    n.write_text("x\n\ny\n\n")
    assert [tuple(r) for r in S.read_numbered_lines(spark, str(n)).orderBy("line_no").collect()] == [(1, "x"), (2, ""), (3, "y")]


def test_metadata_and_morphology(spark, tmp_path):
    x = tmp_path / "m.xml"
    x.write_text('<quran><suras><sura index="2" ayas="286" name="b" tname="B" ename="Cow" type="M" order="87"/><sura index="1" ayas="7" name="a" tname="A" ename="Open" type="M" order="5"/></suras></quran>')
    assert [(r["division"], r["verses"], r["name_en"]) for r in S.read_division_metadata(spark, str(x)).collect()] == [(1, 7, "Open"), (2, 286, "Cow")]
    t = tmp_path / "t.tsv"
    t.write_text('1:1:1:1\tbi"\tP\tP|PREF|\n\n1:1:1:2\tsmi\tN\t\n')
    got = {r["part"]: (r["form"], r["tags"]) for r in S.read_morphology(spark, str(t)).collect()}
    assert got == {1: ('bi"', ["P", "PREF"]), 2: ("smi", [])}


def test_editions(spark, tmp_path):
    rows = [{"chapter": 1, "verse": 1, "text": "x"}, {"chapter": 1, "verse": 2, "text": "y"}]
    for name, body in (("a.json", {"quran": rows}), ("b.json", rows)):
        (tmp_path / name).write_text(json.dumps(body))
        assert S.read_edition(spark, str(tmp_path / name)).count() == 2
    (tmp_path / "c.json").write_text(json.dumps(rows + rows[:1]))
    with pytest.raises(BuildError):
        S.read_edition(spark, str(tmp_path / "c.json"))


def test_lexicon(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<TEI><div2 type="root" n="ktb"><entryFree><itype>1</itype> he <foreign lang="ar">ktb</foreign> *wrote  it</entryFree><entryFree>two</entryFree></div2><div2 type="root" n="x"><entryFree/></div2></TEI>')
    got = [tuple(r) for r in S.read_lexicon_articles(spark, str(tmp_path / "a.xml"), str.upper).orderBy("doc_order").collect()]
    assert got == [("a.xml", 0, "ktb", "he KTB wrote it\n\ntwo"), ("a.xml", 1, "x", "")]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "division int, handle int")
    S.write_artifacts(df, str(tmp_path / "o"), ["handle"], partitions=3)
    parts = [[json.loads(x)["handle"] for x in p.read_text().splitlines()] for p in sorted((tmp_path / "o").glob("part-*"))]
    assert [h for p in parts for h in p] == list(range(50))
    assert S.read_artifacts(spark, str(tmp_path / "o"), df.schema).count() == 50
    (tmp_path / "bad.json").write_text('{"division": 1,\n')
    with pytest.raises(Exception):  # noqa: B017, PT011
        S.read_artifacts(spark, str(tmp_path / "bad.json"), df.schema).collect()
