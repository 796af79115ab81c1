"""Licence scan by a positional rare-token index, in DataFrame functions only.

Licence notices are indexed as postings word -> (label, position). For each file the words of its
text that occur in any notice are kept with their positions, its rarest ones (highest inverse document
frequency over all files) are looked up in the postings, and postings of one label that agree on the
relative position vote for a placement of the notice. A placement counts when the notice's key phrase
stands at the place it implies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import cut, few, written

#: The phrases whose every place is reported, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices (public licence texts' own words), with the key phrase that must be present.
NOTICES = [
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    ("gnu-gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]
#: Function words of the notices: they are verified in place but never looked up.
FUNCTION_WORDS = set("a all and any are by for in is of on or person possible the this to under with without".split())
#: Words that a file looks up for a notice: the rarest of those that it has.
RAREST = 4
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-case A-Z, then the maximal runs of 0-9, a-z and characters beyond ASCII."""
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), DELIMITERS, " ")
    return F.when(F.trim(plain) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(plain), " "))


def _vocabulary() -> list[str]:
    words = {w for _, notice, _ in NOTICES for w in notice.split()}
    return sorted(words | {w for phrase in BASE_PHRASES for w in phrase.split()})


def _at(hits: Column, word: str, back: int) -> Column:
    """Where a word stands, shifted back to where its phrase would start."""
    return F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["pos"] - back)


def _places(hits: Column, phrase: str) -> Column:
    found = None
    for i, word in enumerate(phrase.split()):
        found = _at(hits, word, i) if found is None else F.array_intersect(found, _at(hits, word, i))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: its base phrases, and the notices found.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and notices (the
    labels that the index found, with the share of each notice's words that stand at their place).

    A null or empty text has no words, no labels and score 0. Frequencies are over all documents; the
    index words are those of the notices, so what is broadcast has a fixed size. Repeated rows get
    equal results; ties between words of equal rarity go by the word. Columns beyond doc_id and text
    are not read. Texts are scanned whole, however long; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", words_of(body).alias("words"))
    placed_words = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    known = F.filter(placed_words, lambda h: h["word"].isin(_vocabulary()))
    # Texts are taken apart once: a row's words that any notice has are written, and all else reads them.
    files = written(split.select("doc_id", F.monotonically_increasing_id().alias("key"), F.size("words").cast("bigint").alias("n_words"), known.alias("hits")))
    hits = files.filter(F.size("hits") > 0).select("key", "hits")

    # Of each notice, the words of the file that are rarest over all files.
    total = docs.agg(F.count("*").alias("files"))
    index = [(w, i, label, p) for i, (label, notice, _) in enumerate(NOTICES) for p, w in enumerate(notice.split()) if w not in FUNCTION_WORDS]
    postings = spark.createDataFrame(index, "word string, notice int, label string, at int")
    seen = hits.select("key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    seen = seen.join(F.broadcast(postings.select("word").distinct()), "word")
    frequency = seen.groupBy("word").agg(F.count("*").alias("df"))
    idf = frequency.crossJoin(F.broadcast(total)).select("word", F.log((1 + F.col("files")) / (1 + F.col("df"))).alias("idf"))
    listed = seen.join(F.broadcast(idf), "word").join(F.broadcast(postings.select("word", "notice").distinct()), "word")
    rare = listed.groupBy("key", "notice").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("idf")).alias("r"), "word"))), 1, RAREST)["word"].alias("rarest"))

    # Placements on which at least two looked-up words agree.
    probe = rare.filter(F.size("rarest") > 1).join(hits, "key").select("key", "notice", F.explode(F.filter("hits", lambda h: F.array_contains("rarest", h["word"]))).alias("h"))
    votes = (
        probe.select("key", "notice", "h.pos", "h.word")
        .join(F.broadcast(postings), ["word", "notice"])
        .groupBy("key", "notice", "label", (F.col("pos") - F.col("at")).alias("start"))
        .agg(F.count("*").alias("votes"))
        .filter("votes > 1")
    )
    # Few placements are left; what made them runs once.
    votes = cut(votes)
    # The notices' words at their places, met one by one in the files that have votes.
    rows = []
    for i, (_, notice, phrase) in enumerate(NOTICES):
        words, keyed = notice.split(), phrase.split()
        shift = next(j for j in range(len(words)) if words[j : j + len(keyed)] == keyed)
        rows += [(i, p, w, shift <= p < shift + len(keyed), len(words), len(keyed)) for p, w in enumerate(words)]
    whole = spark.createDataFrame(rows, "notice int, at int, word string, keyed boolean, size int, n_keyed int")
    asked = votes.select("key", "notice", "label", "start").join(F.broadcast(whole), "notice").withColumn("pos", F.col("start") + F.col("at"))
    there = hits.join(few(votes.select("key").distinct()), "key", "left_semi").select("key", F.explode("hits").alias("h")).select("key", "h.pos", "h.word")
    held = asked.join(there, ["key", "pos", "word"]).groupBy("key", "notice", "label", "start").agg(F.count("*").alias("n"), F.count_if("keyed").alias("k"), F.first("size").alias("size"), F.first("n_keyed").alias("n_keyed"))
    placed = held.filter("k = n_keyed").groupBy("key", "label").agg(F.max(F.col("n") / F.col("size")).alias("share"))
    found = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "share"))).alias("notices"))

    based = hits.select("key", *[_places(F.col("hits"), phrase).alias(f"_{label}") for phrase, label in BASE_PHRASES.items()])
    places = F.flatten(F.array(*[F.col(f"_{label}") for label in BASE_PHRASES.values()]))
    base = based.select("key", places.alias("places"), F.filter(F.array(*[F.when(F.size(F.col(f"_{label}")) > 0, F.lit(label)) for label in BASE_PHRASES.values()]), lambda x: x.isNotNull()).alias("base"))
    marks = base.filter(F.size("places") > 0).join(found, "key", "full_outer")

    out = files.select("doc_id", "key", "n_words").join(marks, "key", "left")
    none = F.array().cast("array<string>")
    base_labels, notices = F.coalesce("base", none), F.coalesce(F.transform("notices", lambda n: n["label"]), none)
    share = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, notices)), ",").alias("labels"),
        F.greatest(share, F.when(F.size(base_labels) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce(F.to_json("notices"), F.lit("[]")).alias("notices"),
    )
