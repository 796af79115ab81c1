"""Claim audit: what articles say is extracted, compared with the corpus and reported as findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators.order import cut, running_before

# Patterns and thresholds.
SCRIPT = "\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
RUN = f"[{SCRIPT}][{SCRIPT}\\s\u200c\u200d]*"
PATTERNS = {
    "reference": r"(?:\b(?:Quran|Qur'an|Surah|Sura|Chapter)[ \t]+)?([A-Z][A-Za-z'’]+(?:-[A-Za-z'’]+)?(?:[ \t]+[A-Z][A-Za-z'’]+)?[ \t]+)?([0-9]{1,3}):([0-9]{1,3})(?:[-–]([0-9]{1,3}))?(?::([0-9]{1,4}))?",
    "run": f"({RUN})",
    "root": r"(?i)root\s+word\s+(?:for|of)\s+([\s\S]{0,60}?)\s+is\s+([\s\S]{0,80})",
    "paren": r"\b([A-Z][A-Za-z'’]{1,20})\s*\(([^)]{1,40})\)",
    "adjacent": f"\\b([A-Z][A-Za-z'’]{{1,20}})\\s+([{SCRIPT}]+)",
}
NO_PAIR = {"the", "and", "is", "a", "of", "to", "in", "for", "word", "quran", "allah", "as", "or", "means", "meaning"}
OTHER_SOURCES = "bukhari muslim tirmidhi dawud dawood majah nasai nasa ahmad malik muwatta mishkat bayhaqi tabari matthew mark luke john revelation genesis exodus isaiah psalms corinthians romans".split()
GAP, MATCH, NAME, UNCHECKED_NAME, OVERLAP = 400, 0.85, 0.55, 0.45, 0.34
WEAK = "اويهء"
COARSE, COARSE_LATIN = "بتثجحخدذرزسشصضطظغفقكلمنهةوي", "bttjhkddrzsssdtzgfkklmnhhwy"
WEIGHTS = {"high": 5, "medium": 2, "low": 1}
SPANS = "article string, what string, at int, end int, clear int, line int, excerpt string, before string, after string, groups array<string>"


def excerpt(line: str, column: int, width: int = 90) -> str:
    """A line, or so much of it around a column."""
    if len(line) <= width:
        return line
    low = max(0, column - width // 2)
    return "…" * (low > 0) + line[low : low + width].strip() + "…"


def spans(articles: DataFrame) -> DataFrame:
    """Every match of each of PATTERNS in articles (article, text), a row each, with its place in code points.

    groups: the whole match, then its groups; clear: characters right before it without a Latin letter; before and after: 90 and 44 characters
    around it. Spark's own functions give no places of matches, so these come from Python.
    """
    found = {what: re.compile(p) for what, p in PATTERNS.items()}
    names = [f.split()[0] for f in SPANS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for article, text in zip(frame["article"], frame["text"].fillna(""), strict=True):
                breaks = np.array([-1, *(m.start() for m in re.finditer("\n", text)), len(text)])
                letters = np.array([-1, *(m.end() - 1 for m in re.finditer("[A-Za-z]+", text))])
                for what, pattern in found.items():
                    for m in pattern.finditer(text):
                        at, end = m.span()
                        line = int(np.searchsorted(breaks, at))
                        low = int(breaks[line - 1]) + 1
                        clear = at - 1 - int(letters[np.searchsorted(letters, at) - 1])
                        said = excerpt(text[low : breaks[line]].strip(), at - low)
                        rows.append((article, what, at, end, clear, line, said, text[max(0, at - 90) : at], text[end : end + 44], [m[0], *m.groups()]))
            yield pd.DataFrame(rows, columns=names)

    return articles.select("article", "text").mapInPandas(run, SPANS)


def _runs(c: Column) -> Column:
    """The runs of script in a text, without white space and joiners at their ends."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({RUN})"), 1), lambda r: F.regexp_replace(r, r"[\u200c\u200d\s]+$", ""))


def extract_claims(articles: DataFrame) -> DataFrame:
    """References, loose quotes, root claims and transliterations of articles (article, text), a row each.

    A run of script is the quote of the reference before it if nothing of both kinds stands between
    them, and fewer than GAP characters, none of them a Latin letter; any other run is a loose quote.
    """
    every = spans(articles)
    group = lambda i: F.get("groups", F.lit(i))
    place = ["article", "at", "line", "excerpt"]
    order = W.partitionBy("article").orderBy("at", "end")
    row = every.filter("what in ('reference', 'run')").withColumn("quote", F.get(_runs(group(1)), F.lit(0)))
    # A run that a reference owns: the next row of a reference, or the row before a run.
    gap = lambda at, end, clear: (at - end < GAP) & (at - end <= clear)
    then = lambda c: F.lead(c).over(order)
    last = lambda c: F.lag(c).over(order)
    row = row.withColumn("own", (then("what") == "run") & gap(then("at"), F.col("end"), then("clear"))).withColumn("next", then("quote"))
    row = row.withColumn("owned", F.coalesce((last("what") == "reference") & gap(F.col("at"), last("end"), F.col("clear")), F.lit(False)))
    number = lambda i: group(i).cast("int")
    references = row.filter("what = 'reference'").select(
        *place,
        F.lit("reference").alias("kind"),
        F.trim(group(0)).alias("raw"),
        F.nullif(F.trim(group(1)), F.lit("")).alias("name"),
        number(2).alias("division"),
        number(3).alias("first"),
        F.coalesce(number(4), number(3)).alias("last"),
        group(5).isNotNull().alias("triple"),
        F.when(F.col("own"), F.col("next")).alias("quote"),
    )
    loose = row.filter("what = 'run' and not owned").select(*place, F.lit("loose").alias("kind"), F.col("quote").alias("raw"), "quote")
    target = F.coalesce(F.get(_runs(group(1)), F.lit(0)), F.try_element_at(_runs(F.col("before")), F.lit(-1)))
    roots = every.filter("what = 'root'").withColumn("quote", F.get(_runs(group(2)), F.lit(0))).filter("quote is not null")
    roots = roots.select(*place, F.lit("root").alias("kind"), F.trim(F.regexp_replace(group(0), r"\s+", " ")).alias("raw"), target.alias("target"), "quote")
    # Three layouts: Word (run), run (word), Word run.
    named = F.regexp_extract("after", r"\(([^)]{1,40})\)", 1)
    pairs = every.filter("what = 'paren'").select(*place, group(1).alias("latin"), F.get(_runs(group(2)), F.lit(0)).alias("quote"), F.lit(0).alias("layout"))
    pairs = pairs.unionByName(row.filter("what = 'run'").select(*place, named.alias("latin"), "quote", F.lit(1).alias("layout")).filter(F.col("latin").rlike("[A-Za-z]") & ~F.col("latin").rlike(f"[{SCRIPT}]")))
    pairs = pairs.unionByName(every.filter("what = 'adjacent'").select(*place, group(1).alias("latin"), group(2).alias("quote"), F.lit(2).alias("layout")).filter(~F.lower("latin").isin(*NO_PAIR)))
    pairs = pairs.withColumn("latin", F.trim("latin")).filter(F.col("quote").isNotNull() & ~F.concat("latin", "quote").rlike(r"\s"))
    first = F.row_number().over(W.partitionBy("article", "at", "quote").orderBy("layout"))
    translit = pairs.withColumn("nth", first).filter("nth = 1").select(*place, F.lit("translit").alias("kind"), F.col("latin").alias("raw"), "latin", "quote")
    out = references
    for other in (loose, roots, translit):
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select("article", "kind", "at", "line", "excerpt", "raw", "name", "division", "first", "last", "triple", "quote", "target", "latin")


#: Lines that claim nothing: blank ones, headings, emphasis, and fixed openings.
NO_CLAIM = r"(?i)^$|^#|^_.*_$|slug:|^in the name of allah|^under construction|^live chat|click here"


def draft_claim(c: Column, most: int = 280) -> Column:
    """The first declarative sentence of 20 to ``most`` characters in a text, of lines of 20 at least that stand outside [box] blocks; null if there is none."""
    # The pattern takes the square of a line's length where it finds nothing, so only texts with a box meet it.
    unboxed = F.when(c.contains("[box]"), F.regexp_replace(c, r"(?s)[^\n]*\[box\].*?(?:\[/box\][^\n]*|\z)", "")).otherwise(c)
    # A lambda, since F.trim by itself would take a line's place in the array for the characters to trim.
    lines = F.filter(F.transform(F.split(unboxed, "\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(NO_CLAIM))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, f"\\[[^\\]]*\\]|[{SCRIPT}]+", " "), r"\s+", " ")))
    said = F.transform(F.filter(bare, lambda x: F.length(x) >= 20), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^(.*?[.!])(?=\s|$)", 1), F.lit("")), x))
    return F.get(F.filter(said, lambda x: F.length(x).between(20, most) & ~x.endswith("?")), F.lit(0))


def extract_draft_claims(articles: DataFrame) -> DataFrame:
    """(article, claim); null where an article has none."""
    return articles.select("article", draft_claim(F.col("text")).alias("claim"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """One claim of each: references prefer a quote, then a name; the earliest wins ties."""
    squeezed = F.trim(F.regexp_replace("quote", r"\s+", " "))
    key = F.when(F.col("kind") == "reference", F.concat_ws(":", "division", "first", "last", "triple")).when(F.col("kind") == "loose", squeezed).when(F.col("kind") == "translit", F.concat_ws("|", F.lower("latin"), "quote")).otherwise(F.col("at").cast("string"))
    worth = F.when(F.col("kind") == "reference", F.col("quote").isNotNull().cast("int") * 2 + F.col("name").isNotNull().cast("int")).otherwise(0)
    order = W.partitionBy("article", "kind", "_key").orderBy(F.desc("_worth"), "at")
    return claims.withColumn("_key", key).withColumn("_worth", worth).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_key", "_worth", "_r")


def skeleton(c: Column, weak: str = WEAK, article: str = "ال") -> Column:
    """A form without a leading article and weak letters."""
    bare = F.when(c.startswith(article), F.substring(c, len(article) + 1, F.length(c))).otherwise(c) if article else c
    return F.translate(bare, weak, "")


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def coverage(quotes: DataFrame, verses: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(quote_id, verse_id, coverage): the share of a quote's bigrams, as a multiset, that a verse has.

    quotes: quote_id, blob; verses: verse_id, blob; ``on`` names columns that must agree too, such as the
    verse that a quote cites. Only pairs that share a bigram come out.
    """
    on = on or []
    q = quotes.select("quote_id", *on, F.explode(bigrams(F.col("blob"))).alias("b")).groupBy("quote_id", *on, "b").agg(F.count("*").alias("nq"))
    v = verses.select("verse_id", *on, F.explode(bigrams(F.col("blob"))).alias("b")).groupBy("verse_id", *on, "b").agg(F.count("*").alias("nv"))
    total = q.groupBy("quote_id").agg(F.sum("nq").alias("total"))
    hits = q.join(v, [*on, "b"]).groupBy("quote_id", "verse_id").agg(F.sum(F.least("nq", "nv")).alias("hits"))
    return hits.join(total, "quote_id").select("quote_id", "verse_id", (F.col("hits") / F.col("total")).alias("coverage"))


#: Quotes that are held against all verses in one pass; tasks hold their bigrams. Cells of a block of verses' counts.
QUOTES, CELLS = 512, 4_000_000


def bigram_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All bigrams of texts as numbers, and the text that each is of."""
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in texts]
    sizes = np.array([max(0, len(c) - 1) for c in codes], np.int64)
    keys = np.concatenate([(c[:-1] << 21) | c[1:] for c in codes]) if codes else np.zeros(0, np.int64)
    return keys, np.repeat(np.arange(len(texts)), sizes)


class Covered:
    """A block of quotes as counts of their bigrams, to be held against blocks of verses."""

    def __init__(self, blobs: list[str]) -> None:
        keys, owner = bigram_keys(blobs)
        self.known = np.unique(keys)
        self.counts = np.bincount(owner * len(self.known) + np.searchsorted(self.known, keys), minlength=len(blobs) * len(self.known)).reshape(len(blobs), -1).astype(np.float32)
        self.total = self.counts.sum(axis=1, dtype=np.float64)  # at least 1
        #: Pairs whose bound was high enough, and all pairs, of this process.
        self.tried, self.pairs = 0, 0

    def by_enough(self, blobs: list[str | None], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(quote, verse, coverage) of the pairs that reach ``least``.

        First by length: a verse of fewer bigrams than ``least`` of a quote's can't. Then by an upper bound, which counts
        a quote's bigrams that the verse has at all. Only what is left is counted as multisets.
        """
        keys, owner = bigram_keys(blobs)
        size, own = len(self.known), np.bincount(owner, minlength=len(blobs))
        kept = np.flatnonzero(own / self.total.min() >= least)
        number = np.full(len(blobs), -1)
        number[kept] = np.arange(len(kept))
        at = np.minimum(np.searchsorted(self.known, keys), size - 1)
        good = (self.known[at] == keys) & (number[owner] >= 0) if size else np.zeros(len(keys), bool)
        at, owner = at[good], number[owner[good]]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // max(1, size))
        for a in range(0, len(kept), step):
            b = min(len(kept), a + step)
            here = (owner >= a) & (owner < b)
            has = np.bincount((owner[here] - a) * size + at[here], minlength=(b - a) * size).reshape(b - a, size).astype(np.float32)
            bound = self.counts @ (has > 0).T.astype(np.float32)
            q, v = np.nonzero((np.minimum(bound, own[kept[a:b]]) / self.total[:, None]) >= least)
            self.tried, self.pairs = self.tried + len(q), self.pairs + bound.size
            for k in range(0, len(q), step):
                some_q, some_v = q[k : k + step], v[k : k + step]
                share = np.minimum(self.counts[some_q], has[some_v]).sum(axis=1, dtype=np.float64) / self.total[some_q]
                reach = share >= least
                found.append((some_q[reach], kept[a + some_v[reach]], share[reach]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_verse(quotes: DataFrame, verses: DataFrame, least: float = MATCH) -> DataFrame:
    """(quote_id, verse_id, coverage): the verse that covers a quote best, the first in order on ties, if by enough.

    verses: verse_id, seq, blob. The quotes are the asked-for set: blocks of about QUOTES of them are sent to the verses,
    which stay where they are. Quotes without a bigram are covered by nothing; repeated rows of a quote count once.
    """
    spark = quotes.sparkSession
    asked = cut(quotes.select("quote_id", "blob").filter(F.length("blob") >= 2).distinct().withColumn("_block", F.xxhash64("quote_id", "blob")))
    n = max(1, -(-asked.count() // QUOTES))
    kinds = {c: verses.schema[c].dataType.simpleString() for c in ("verse_id", "seq")}
    kind = quotes.schema["quote_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"quote_id {kind}, verse_id {kinds['verse_id']}, coverage double")
    for k in range(n):
        rows = asked.filter(F.pmod("_block", F.lit(n)) == k).collect()
        if not rows:
            continue
        block = spark.sparkContext.broadcast(Covered([r["blob"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 2000):
                    part = batch.slice(a, 2000)
                    q, v, share = block.value.by_enough(part.column(2).to_pylist(), least)
                    if len(q):
                        at = pa.array(v)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), part.column(0).take(at), part.column(1).take(at), pa.array(share)], ["q", "verse_id", "seq", "coverage"])

        found = verses.select("verse_id", "seq", "blob").mapInArrow(run, f"q int, verse_id {kinds['verse_id']}, seq {kinds['seq']}, coverage double")
        best = found.groupBy("q").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "seq", "verse_id", "coverage")).alias("b"))
        names = spark.createDataFrame([(i, r["quote_id"]) for i, r in enumerate(rows)], f"q int, quote_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "q").select("quote_id", "b.verse_id", "b.coverage"))
    return out


def verify_quotes(words: DataFrame, verse_words: DataFrame, covered: DataFrame) -> DataFrame:
    """(quote_id, words, matched, ratio, coverage, level, status): a quote's words in its cited verse.

    words: quote_id, verse_id, word, form, skeleton; verse_words the same without quote_id; covered:
    quote_id, coverage. A word matches as it is, by its form or by a skeleton of two letters or more.
    """
    own = words
    for c in ("word", "form", "skeleton"):
        known = verse_words.select("verse_id", c).distinct().withColumn(f"_{c}", F.lit(True))
        own = own.join(known, ["verse_id", c], "left")
    has = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(False))
    level = F.when(has("word"), 1).when(has("form"), 2).when(has("skeleton") & (F.length("skeleton") >= 2), 3).otherwise(4)
    counts = own.withColumn("_l", level).groupBy("quote_id").agg(F.count("*").alias("words"), F.count_if(F.col("_l") < 4).alias("matched"), F.max("_l").alias("_worst"))
    out = counts.join(covered, "quote_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("ratio", F.col("matched") / F.col("words"))
    good = (F.col("ratio") >= MATCH) | (F.col("coverage") >= MATCH)
    name = F.when(~good, "none").when((F.col("_worst") >= 3) | (F.col("ratio") < MATCH), "orthographic").when(F.col("_worst") == 2, "normalised").otherwise("canonical")
    return out.select("quote_id", "words", "matched", "ratio", "coverage", name.alias("level"), F.when(good, "verified").otherwise("flagged").alias("status"))


def verify_loose(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(quote_id, words, absent, status, severity): words of three letters or more that the corpus lacks, also as a skeleton.

    words: quote_id, form, skeleton; vocabulary: form, skeleton.
    """
    forms = vocabulary.select("form").distinct().withColumn("_f", F.lit(True))
    prints = vocabulary.filter(F.length("skeleton") >= 2).select("skeleton").distinct().withColumn("_s", F.lit(True))
    own = words.join(forms, "form", "left").join(prints, "skeleton", "left")
    absent = F.col("_f").isNull() & F.col("_s").isNull() & (F.length("form") >= 3)
    out = own.groupBy("quote_id").agg(F.count("*").alias("words"), F.count_if(absent).alias("absent"))
    severity = F.when(F.col("absent") == 0, "low").when(F.col("absent") == F.col("words"), "high").otherwise("medium")
    return out.select("quote_id", "words", "absent", F.when(F.col("absent") == 0, "verified").otherwise("flagged").alias("status"), severity.alias("severity"))


def normalise_name(c: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.lower(c), "'’`-", "   ").cast("string"), r"\b(al|an|as|ash|ar|at|ath|ad|adh|az|el)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z ]", " "), r"\s+", " "))


def _similar(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of the edit similarities of two names and of their consonants."""
    bare = lambda c: F.translate(normalise_name(c), "aeiouy ", "")
    return F.greatest(_similar(normalise_name(a), normalise_name(b)), _similar(bare(a), bare(b)))


def verify_names(named: DataFrame, names: DataFrame) -> DataFrame:
    """(name, number, score, best_number, best_score, status): claimed names against the canonical ones.

    named: name, number; names: number, canonical, a table of fixed size, one row for each spelling.
    Distinct claimed names meet the broadcast table.
    """
    scored = named.select("name").distinct().crossJoin(F.broadcast(names)).withColumn("score", name_similarity(F.col("name"), F.col("canonical")))
    per = scored.groupBy("name", F.col("number").alias("of")).agg(F.max("score").alias("score"))
    best = per.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "of", "score")).alias("b")).select("name", F.col("b.of").alias("best_number"), F.col("b.score").alias("best_score"))
    out = named.select("name", "number").distinct().join(per.withColumnRenamed("of", "number"), ["name", "number"], "left").join(best, "name")
    status = F.when(F.coalesce("score", F.lit(0.0)) >= NAME, "verified").otherwise("flagged")
    return out.select("name", "number", F.coalesce("score", F.lit(0.0)).alias("score"), "best_number", "best_score", status.alias("status"))


def verify_references(references: DataFrame, verses: DataFrame, scores: DataFrame) -> DataFrame:
    """References (ref_id, name, division, first, last, triple) with status and the number of verses that they reach.

    scores: name, best_score. A triple, another source's name or a name like none is unchecked.
    """
    own = verses.select(F.col("division").alias("_d"), F.col("slot").alias("_s"))
    reach = references.join(own, (F.col("division") == F.col("_d")) & F.col("_s").between(F.col("first"), F.col("last")), "left").groupBy("ref_id").agg(F.count("_s").alias("verses"))
    out = references.join(reach, "ref_id").join(scores.select("name", "best_score").distinct(), "name", "left")
    foreign = F.arrays_overlap(F.split(F.lower(F.coalesce("name", F.lit(""))), "[^a-z]+"), F.array(*[F.lit(s) for s in OTHER_SOURCES]))
    status = F.when(F.col("triple") | foreign | (F.col("best_score") < UNCHECKED_NAME), "unchecked").when(F.col("verses") == 0, "flagged").otherwise("verified")
    return out.withColumn("status", status).withColumn("severity", F.when(status == "flagged", "high").otherwise("low")).drop("best_score")


def verify_root_claims(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """(claim_id, status, roots): whether the claimed root is one of those that the target's last known word has.

    claims: claim_id, target (words), claimed; tokens: form, root. Words are located by skeleton.
    """
    table = tokens.filter("root is not null").select(skeleton(F.col("form")).alias("skeleton"), F.regexp_replace("root", r"[\s-]", "").alias("root")).filter("length(skeleton) >= 2").groupBy("skeleton", "root").agg(F.count("*").alias("n"))
    words = claims.select("claim_id", F.posexplode(F.split(F.coalesce("target", F.lit("")), r"\s+")).alias("at", "word")).withColumn("skeleton", skeleton(X.normalise(F.col("word"))))
    found = words.join(table.select("skeleton").distinct(), "skeleton").groupBy("claim_id").agg(F.max_by("skeleton", "at").alias("skeleton"))
    ranked = found.join(table, "skeleton").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "root")))["root"].alias("roots"))
    claimed = X.normalise(F.regexp_replace("claimed", r"\s", ""))
    out = claims.join(ranked, "claim_id", "left")
    status = F.when(F.col("roots").isNull(), "unchecked").when(F.array_contains("roots", claimed), "verified").otherwise("flagged")
    return out.select("claim_id", status.alias("status"), "roots")


def coarse(c: Column) -> Column:
    """Coarse consonant classes of a word in either script."""
    latin = F.regexp_replace(F.lower(c), "[^a-z]", "")
    for pair in ("sh", "th", "kh", "gh", "dh"):
        latin = F.replace(latin, F.lit(pair), F.lit(pair[0]))
    own = F.translate(F.regexp_replace(c, f"[^{COARSE}]", ""), COARSE, COARSE_LATIN)
    return F.when(own != "", own).otherwise(F.regexp_replace(F.replace(latin, F.lit("q"), F.lit("k")), "[^btjhdrzsfklmnwyg]", ""))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Letters that two strings share, as multisets, by the longer one's length."""
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    count = lambda s, x: F.length(s) - F.length(F.replace(s, x, F.lit("")))
    shared = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(shared / F.greatest(F.length(a), F.length(b)))


def verify_translit(pairs: DataFrame) -> DataFrame:
    """Pairs (latin, quote) with score and status; pairs with under two consonants are left out."""
    out = pairs.withColumn("_a", coarse(F.col("latin"))).withColumn("_b", coarse(F.col("quote"))).filter("length(_a) >= 2 and length(_b) >= 2")
    out = out.withColumn("score", multiset_overlap(F.col("_a"), F.col("_b")))
    return out.withColumn("status", F.when(F.col("score") >= OVERLAP, "verified").otherwise("unchecked")).drop("_a", "_b")


def rank_findings(findings: DataFrame) -> DataFrame:
    """Add rank: flagged first, then unchecked; by severity and line."""
    status = F.when(F.col("status") == "flagged", 0).when(F.col("status") == "unchecked", 1).otherwise(2)
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return findings.withColumn("rank", F.row_number().over(W.partitionBy("article").orderBy(status, severity, "line", "finding_id")))


def audit_report(findings: DataFrame) -> DataFrame:
    """(article, checked, verified, flagged, unchecked, work): counts and the work that flags make."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("severity"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    work = F.sum(F.when(F.col("status") == "flagged", weight).otherwise(0)).alias("work")
    return findings.groupBy("article").agg(F.count("*").alias("checked"), count("verified"), count("flagged"), count("unchecked"), work)


def rank_articles(reports: DataFrame) -> DataFrame:
    """Reports with rank: the most work first, then the most flags, then by name. Ranks are running sums over scores."""
    keyed = reports.withColumns({"_work": -F.col("work"), "_flagged": -F.col("flagged")})
    return running_before(keyed, "_work", F.lit(1), "rank", ["_flagged", "article"]).withColumn("rank", F.col("rank") + 1).drop("_work", "_flagged")


def audit_totals(reports: DataFrame) -> DataFrame:
    """One row: articles and the sums of their counts and work; zeros without any."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("checked", "verified", "flagged", "unchecked", "work")]
    return reports.agg(F.count("*").alias("articles"), *sums)


def verified_evidence(references: DataFrame, tokens: DataFrame) -> DataFrame:
    """(ref_id, segment_id, token_id) of verified references."""
    own = tokens.select(F.col("division").alias("_d"), F.col("slot").alias("_s"), "segment_id", "token_id")
    return references.filter("status = 'verified'").join(own, (F.col("division") == F.col("_d")) & F.col("_s").between(F.col("first"), F.col("last"))).select("ref_id", "segment_id", "token_id")


def draft_plan(evidence: DataFrame, references: DataFrame) -> DataFrame:
    """(article, segment_id, ref_id, token_id): one pin for each verse of an article, the first reference's first token."""
    own = evidence.join(references.select("ref_id", "article", "line"), "ref_id")
    best = own.groupBy("article", "segment_id").agg(F.min(F.struct("line", "ref_id", F.element_at(F.split("token_id", ":"), -1).cast("int").alias("p"), "token_id")).alias("b"))
    return best.select("article", "segment_id", "b.ref_id", "b.token_id")


def audit_annotations(findings: DataFrame, verses: DataFrame) -> DataFrame:
    """(article, segment_id, value) for each verse that a flagged finding's reference reaches, once for each summary.

    findings: article, status, summary, division, first, last; verses: division, slot, segment_id. Findings that
    resolve to no verse, or have no reference, give none.
    """
    own = verses.select(F.col("division").alias("_d"), F.col("slot").alias("_s"), "segment_id").distinct()
    flagged = findings.filter("status = 'flagged'").select("article", "summary", "division", "first", "last").distinct()
    met = flagged.join(own, (F.col("division") == F.col("_d")) & F.col("_s").between(F.col("first"), F.col("last")))
    return met.select("article", "segment_id", F.concat(F.lit("["), "article", F.lit("] "), "summary").alias("value")).distinct()


def draft_totals(pins: DataFrame, annotations: DataFrame) -> DataFrame:
    """(article, pins, annotations) for each article with either; every such draft is flagged for review."""
    rows = pins.select("article", F.lit(1).alias("p"), F.lit(0).alias("a")).unionByName(annotations.select("article", F.lit(0).alias("p"), F.lit(1).alias("a")))
    return rows.groupBy("article").agg(F.sum("p").alias("pins"), F.sum("a").alias("annotations"), F.lit(True).alias("review"))
