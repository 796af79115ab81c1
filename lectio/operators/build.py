"""Corpus build: opening formulas, words, numbering, order and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators.order import cut, running_before


class BuildError(ValueError):
    """The sources contradict each other; carries the first violations."""


def refuse(rows: DataFrame, what: str) -> None:
    """Raise if there are any rows; at most five are read."""
    if bad := rows.take(5):
        raise BuildError(f"{what}: {[tuple(r) for r in bad]}")


def split_opening(verses: DataFrame, formulas: Sequence[str], none: Sequence[int] = (9,), whole: Sequence[int] = (1,)) -> DataFrame:
    """Split the opening formula off each division's first verse.

    Adds formula (null where there is none) and separated; text loses the formula and the space after
    it. Divisions in ``whole`` are the formula and keep it, those in ``none`` must not begin with it;
    anything else that doesn't begin with a formula and go on fails.
    """
    text, opens = F.col("text"), F.col("slot") == 1
    formula = F.coalesce(*[F.when((text == f) | text.startswith(f + " "), F.lit(f)) for f in formulas])
    is_whole, is_none = F.col("division").isin(*whole), F.col("division").isin(*none)
    out = verses.withColumn("formula", F.when(opens, formula)).withColumn("separated", opens & F.col("formula").isNotNull() & ~is_whole)
    rest = F.substring(text, F.length("formula") + 2, F.length(text))
    bad = opens & ((is_none & F.col("formula").isNotNull()) | (is_whole & (F.coalesce("formula", F.lit("")) != text)) | (~is_none & ~is_whole & (F.col("formula").isNull() | (F.length(rest) == 0))))
    refuse(out.filter(bad).select("division", "text"), "unexpected opening")
    return out.withColumn("text", F.when(F.col("separated"), rest).otherwise(text))


def _is_word(piece: Column) -> Column:
    return (piece != "") & ~X.is_mark_run(piece)


#: Pieces up to which their places are summed in one run.
RUN = 512


def running_sums(sizes: Column) -> Column:
    """For each number of an array the sum of those before it; long arrays chunk by chunk, so n numbers cost n ** 1.5 at most."""

    def run(part: Column) -> Column:
        none = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, none, lambda s, x: F.struct((s["all"] + x).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")))

    chunk = F.floor(F.sqrt(F.size(sizes))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / chunk).cast("int")), lambda k: run(F.slice(sizes, k * chunk + 1, chunk)))
    long = F.flatten(F.zip_with(parts, run(F.transform(parts, lambda p: p["all"]))["before"], lambda p, base: F.transform(p["before"], lambda x: x + base)))
    return F.when(F.size(sizes) <= RUN, run(sizes)["before"]).otherwise(long)


def segment(verses: DataFrame, is_word: Callable[[Column], Column] | None = None, places: bool = True) -> DataFrame:
    """Words of verses (division, slot, text and others): position, word, char_start, char_end, following_marks.

    The text is split at single spaces. Pieces that are no words are marks: they go to the word before
    them; leading_marks has those before the first. Offsets count code points and are summed once for a
    text. No row leaves its task. Without ``places`` there are just position and word, which is much less work.
    """
    is_word = is_word or _is_word
    keep = [c for c in verses.columns if c != "text"]
    if not places:
        rows = verses.select(*keep, F.posexplode(F.filter(F.split("text", " ", -1), is_word)).alias("_at", "word"))
        return rows.select(*keep, (F.col("_at") + 1).alias("position"), "word")
    spread = verses.withColumn("_pieces", F.split("text", " ", -1)).withColumn("_sizes", F.transform("_pieces", lambda p: F.length(p) + 1)).withColumn("_starts", running_sums(F.col("_sizes")))
    words = F.filter(F.transform("_pieces", lambda p, i: F.struct(p.alias("word"), i.alias("at"))), lambda s: is_word(s["word"]))
    spread = spread.withColumn("_words", words)
    after = lambda k: F.coalesce(F.get("_words", k)["at"], F.size("_pieces"))
    whole = F.transform(
        "_words",
        lambda w, k: F.struct(
            (k + 1).alias("position"),
            w["word"].alias("word"),
            F.get("_starts", w["at"]).alias("char_start"),
            F.slice("_pieces", w["at"] + 2, after(k + 1) - w["at"] - 1).alias("following_marks"),
        ),
    )
    rows = spread.select(*keep, F.slice("_pieces", F.lit(1), after(F.lit(0))).alias("leading_marks"), F.explode(whole).alias("_w"))
    return rows.select(*keep, "leading_marks", "_w.position", "_w.word", "_w.char_start", (F.col("_w.char_start") + F.length("_w.word")).alias("char_end"), "_w.following_marks")


def text_forms(df: DataFrame, source: str = "word") -> DataFrame:
    """Add text_simple, text_no_tashkeel and text_normalised from the source form."""
    c = F.col(source)
    return df.withColumns({"text_simple": X.to_simple(c), "text_no_tashkeel": X.strip_tashkeel(c), "text_normalised": X.normalise(c)})


def assign_ordinals(segments: DataFrame, counted: Sequence[str], start_at: int = 1, per: Sequence[str] = ("division",), name: str = "ordinal") -> DataFrame:
    """Number the segments of counted kinds in textual order (seq), anew in each division; others get null."""
    counts = F.col("kind").isin(*counted)
    number = F.row_number().over(W.partitionBy(*per, counts).orderBy("seq")) + F.lit(start_at - 1)
    return segments.withColumn(name, F.when(counts, number))


def ordinals(segments: DataFrame, schemes: dict[str, dict]) -> DataFrame:
    """Add ordinals, a map from scheme to number that leaves out schemes which don't count the segment."""
    out = segments
    for scheme, rule in schemes.items():
        out = assign_ordinals(out, name=f"_n_{scheme}", **rule)
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"_n_{s}").alias("value")) for s in schemes])
    return out.withColumn("ordinals", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))).drop(*[f"_n_{s}" for s in schemes])


def with_offsets(verses: DataFrame, is_word: Callable[[Column], Column] | None = None, keys: Sequence[str] = ("division", "slot"), texts: DataFrame | None = None) -> DataFrame:
    """Add before: the number of words in all verses that come before in corpus order, so a word's handle is before + position - 1.

    Words are counted in each text without taking them apart; the counts, one short row a verse, are
    written once (the one job that runs here) and summed. Words themselves never move for their handles. ``texts``: the
    same verses' keys and texts alone, where they can be had without what else was joined to the verses.
    """
    words = F.size(F.filter(F.split("text", " ", -1), is_word or _is_word)).cast("bigint")
    counts = cut((texts if texts is not None else verses).select(*keys, words.alias("_n")).filter("_n > 0"))
    before = running_before(counts, keys[0], F.col("_n"), "before", list(keys[1:])).drop("_n")
    return verses.join(before, list(keys))


def with_handles(tokens: DataFrame, keys: Sequence[str] = ("division", "slot")) -> DataFrame:
    """Add handle: the 0-based place of a token in corpus order (division, slot, position).

    For tokens that come from elsewhere; with_offsets gives those of verses without a shuffle of tokens. Counts per
    segment are summed on the segment table and joined back.
    """
    counts = cut(tokens.groupBy(*keys).agg(F.count("*").alias("_n")))
    offsets = running_before(counts, keys[0], F.col("_n"), "_before", list(keys[1:])).drop("_n")
    return tokens.join(offsets, list(keys)).withColumn("handle", F.col("_before") + F.col("position") - 1).drop("_before")


def assert_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    """Parallel editions must cover the same verses."""
    refuse(a.join(b, list(keys), "left_anti").select(*keys), "only in the first")
    refuse(b.join(a, list(keys), "left_anti").select(*keys), "only in the second")


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that one edition has and the other lacks, with side."""
    one = a.select(*keys).distinct().withColumn("side", F.lit("a"))
    two = b.select(*keys).distinct().withColumn("side", F.lit("b"))
    return one.join(two, list(keys), "left_anti").unionByName(two.join(one, list(keys), "left_anti"))


def build_divisions(verses: DataFrame, tokens: DataFrame, metadata: DataFrame) -> DataFrame:
    """Division records: metadata with the derived verse_count, which must agree, and the formula's token range."""
    counts = verses.groupBy("division").agg(F.count("*").alias("verse_count"))
    own = tokens.filter("is_formula").groupBy("division").agg(F.min_by("token_id", "position").alias("first_id"), F.max_by("token_id", "position").alias("last_id"), F.count("*").alias("count"))
    out = metadata.join(counts, "division", "left").join(own, "division", "left")
    refuse(out.filter(~F.col("verses").eqNullSafe(F.col("verse_count"))).select("division", "verses", "verse_count"), "verse counts differ")
    formula = F.when(F.col("count").isNotNull(), F.struct("first_id", "last_id", "count"))
    return out.withColumn("formula_range", formula).drop("first_id", "last_id", "count")


def manifest_counts(verses: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row of counts: divisions, verses, tokens, marks that are no tokens, divisions with and without a separated formula."""
    marks = tokens.agg(F.count("*").alias("tokens"), F.sum(F.size("following_marks")).alias("following"))
    leading = tokens.filter("position = 1").agg(F.coalesce(F.sum(F.size("leading_marks")), F.lit(0)).alias("leading"))
    by = verses.groupBy("division").agg(F.count("*").alias("n"), F.max(F.col("is_formula").cast("int")).alias("formula"))
    divisions = by.agg(F.count("*").alias("divisions"), F.sum("n").alias("verses"), F.sum("formula").alias("with_formula"))
    out = divisions.crossJoin(marks).crossJoin(leading)
    return out.select("divisions", "verses", "tokens", (F.col("following") + F.col("leading")).alias("marks"), "with_formula", (F.col("divisions") - F.col("with_formula")).alias("without_formula"))
