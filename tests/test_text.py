from pyspark.sql import functions as F

from lectio.functions import text as X


def one(spark, column, *values):
    """A column function's results over strings."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", column(F.col("v"))).orderBy("i").collect()]


def test_forms(spark):
    verse = "بِسْمِ ٱللَّهِ ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ"
    assert one(spark, X.strip_tashkeel, verse) == ["بسم ٱلله ٱلرحمـن ٱلرحيم"]
    assert one(spark, X.normalise, verse, "أحد", "رحمة", "هدى") == ["بسم الله الرحمن الرحيم", "احد", "رحمه", "هدي"]
    once = one(spark, X.normalise, verse)
    assert one(spark, X.normalise, *once) == once
    assert one(spark, X.to_simple, "ٱلۡحَمۡدُ") == ["الحَمدُ"]
    assert one(spark, X.fold, "مُؤْمِن", "شَيْء") == ["مومن", "شي"]
    assert one(spark, X.fold_further, "يَٰصَىٰحِبَىِ", "يَٰصَٰحِبَىِ") == ["يصحب", "يصحب"]


def test_composition_ignores_the_order_of_marks(spark):
    a, b = one(spark, X.nfc, "رَّ", "رَّ")
    assert a == b


def test_roots(spark):
    assert one(spark, X.root_slug, "ز ك و", "زكو", "ز ?") == ["z-k-w", "z-k-w", None]
    assert one(spark, X.root_from_slug, "z-k-w", "sh-m-s", "q-x") == ["ز ك و", "ش م س", None]
    letters = " ".join(X.SLUG_CODES)
    assert one(spark, lambda c: X.root_from_slug(X.root_slug(c)), letters) == [letters]


def test_romanisation(spark):
    words = {"بِسْمِ": "bismi", "كَتَبَ": "kataba", "قُلْ": "qul", "نَصْر": "naṣr", "عِلْم": "ʿilm", "شَمْس": "šams", "رَبَّ": "rabba", "نۖ": "n"}
    assert one(spark, X.romanise, *words) == list(words.values())


def test_lexicon_keys(spark):
    assert one(spark, X.decode_keys, "ktb", "A^mn", "$ms") == ["كتب", "أمن", "شمس"]
    assert one(spark, X.radical_print, "أ م ن", "امن", "هدى") == ["ءمن", "ءمن", "هدي"]


def test_gloss_keys(spark):
    same = ["the zakah", "the zakah,", 'the zakah."', "[the] zakah.", "  The   Zakah "]
    assert set(one(spark, X.gloss_key, *same)) == {"the zakah"}
    assert one(spark, X.gloss_key, "Lord’s", "(the) reward") == ["lord's", "the reward"]
    assert one(spark, X.gloss_slug, "the zakah") == ["the-zakah"]


def test_stems(spark):
    got = one(spark, lambda c: F.array_sort(X.significant_stems(c)), "But lo! with hardship goeth ease")
    assert got == [["ease", "go", "hardship"]]
    both = spark.createDataFrame([(["x", "y", "z"], ["y", "z", "w"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in both.select(X.jaccard(F.col("a"), F.col("b"), 1.0)).collect()] == [0.5, 1.0]


def test_seeded_pick(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    assert one(spark, X.fnv1a, "", "a", "2024-01-01") == [fnv(""), fnv("a"), fnv("2024-01-01")]
    assert one(spark, lambda c: X.seeded_pick(c, F.lit(0)), "a") == [-1]


def test_folds_of_one_text(spark):
    texts = ["", "abc d", "أَحَدٌ", "مُوسَىٰ", "ٱلرَّحْمَـٰنِ", "شَيْءٌ مَّا", "ؤئةآإـ", "\u0670\u06d6x\u0653"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f"), X.fold_further(F.col("t")).alias("g")).collect()
    assert [X.folds_of(r["t"]) for r in rows] == [(r["f"], r["g"]) for r in rows]
