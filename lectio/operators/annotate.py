"""Annotation layers: tags, words of segments, alignment, roots, lexicon and editions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators.build import refuse
from lectio.operators.order import few, running_before

# The tag vocabulary.
NOMINAL = ["PN", "PRON", "DEM", "REL", "T", "LOC", "NV", "COND", "INTG"]
TENSES, CASES, DERIVATIONS = ["PERF", "IMPF", "IMPV"], ["NOM", "ACC", "GEN"], ["ACT_PCPL", "PASS_PCPL", "VN"]
PERSON = "^([123])?([MF])?([SDP])?$"
PREFIXED = ["ROOT", "LEM", "VF", "MOOD", "FAM"]


def parse_tags(parts: DataFrame) -> DataFrame:
    """Add kind, root, lemma, pos and features to morphology parts (coarse, tags)."""
    tags = F.col("tags")
    value = lambda name: F.get(F.transform(F.filter(tags, lambda t: t.startswith(name + ":")), lambda t: F.substring(t, len(name) + 2, F.length(t))), F.lit(0))
    bare = F.filter(tags, lambda t: ~t.contains(":") & ~t.isin("PREF", "SUFF"))
    one = lambda known: F.get(F.filter(F.col("_bare"), lambda t: t.isin(known)), F.lit(0))
    out = parts.withColumn("_bare", bare)
    kind = F.when(F.array_contains(tags, "PREF"), "prefix").when(F.array_contains(tags, "SUFF"), "suffix").otherwise("stem")
    first = F.get("_bare", F.lit(0))
    pos = F.when((kind == "stem") & (F.col("coarse") == "V"), "V").when((kind == "stem") & (F.col("coarse") == "N"), F.when(first.isin(NOMINAL), first).otherwise("N")).otherwise(F.coalesce(first, F.col("coarse")))
    person = F.get(F.filter(F.col("_bare"), lambda t: t.rlike(PERSON) & (t != "")), F.lit(0))
    group = lambda i: F.nullif(F.regexp_extract(person, PERSON, i), F.lit(""))
    number = F.element_at(F.create_map(*[F.lit(x) for x in ("S", "singular", "D", "dual", "P", "plural")]), group(3))
    known = [*TENSES, *CASES, *DERIVATIONS, "PASS", "ADJ", "INDEF", *NOMINAL]
    other = F.filter(F.col("_bare"), lambda t: ~t.isin(known) & ~t.rlike(PERSON) & (t != F.coalesce(F.col("pos"), F.lit(""))))
    out = out.withColumn("kind", kind).withColumn("root", value("ROOT")).withColumn("lemma", value("LEM")).withColumn("pos", pos)
    features = F.struct(
        one(TENSES).alias("tense"), value("MOOD").alias("mood"), F.when(F.array_contains("_bare", "PASS"), "passive").alias("voice"), one(CASES).alias("case"), F.when(F.array_contains("_bare", "INDEF"), "indefinite").alias("state"),
        group(1).alias("person"), group(2).alias("gender"), number.alias("number"), one(DERIVATIONS).alias("derivation"), F.array_contains("_bare", "ADJ").alias("adjective"), value("VF").alias("verb_form"), value("FAM").alias("family"), other.alias("other"),
    )
    return out.withColumn("features", features).drop("_bare")


def words_from_parts(parts: DataFrame) -> DataFrame:
    """Words (division, slot, word) with their parts in order and the surface that they make."""
    keys = ["division", "slot", "word"]
    kept = [c for c in parts.columns if c not in (*keys, "part", "tags")]
    grouped = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", *kept))).alias("parts"))
    return grouped.withColumn("surface", F.array_join(F.col("parts")["form"], ""))


def head_block(words: DataFrame) -> DataFrame:
    """Add root, lemma, pos and features of a word: its first stem with a root, else its first stem, else its first part without features."""
    stems = F.filter("parts", lambda p: p["kind"] == "stem")
    head = F.coalesce(F.get(F.filter(stems, lambda p: p["root"].isNotNull()), F.lit(0)), F.get(stems, F.lit(0)))
    out = words.withColumn("_head", head)
    return out.select("*", F.col("_head.root").alias("root"), F.col("_head.lemma").alias("lemma"), F.coalesce(F.col("_head.pos"), F.get("parts", F.lit(0))["pos"]).alias("pos"), F.col("_head.features").alias("features")).drop("_head")


def attach_positional(words: DataFrame, glosses: DataFrame, translit: DataFrame) -> DataFrame:
    """Join the i-th word in corpus order to line i of both files; different counts are refused. Empty lines give null."""
    counts = words.count(), glosses.count(), translit.count()
    if len(set(counts)) != 1:
        raise ValueError(f"words, glosses and transliterations differ: {counts}")
    numbered = running_before(words, "division", F.lit(1), "line_no", ["slot", "word"]).withColumn("line_no", F.col("line_no") + 1)
    line = lambda df, name: df.select("line_no", F.nullif(F.trim("text"), F.lit("")).alias(name))
    return numbered.join(line(glosses, "gloss"), "line_no").join(line(translit, "transliteration"), "line_no").drop("line_no")


#: What a word can be to a token, by its number.
TIERS = ["exact", "normalised", "extended", "merged", "failed", "unaligned"]


def _walk(token: list[str | None], word: list[str | None], folds: dict[str | None, tuple]) -> list[int]:
    """Words on tokens in order; each pair as the places from 1 (0: none) and the tier in one number."""
    out, i = [], 0
    for j, text in enumerate(word, 1):
        if i >= len(token):
            out.append(j << 4 | 4)
            continue
        x, tier = token[i], 0
        if x != text:
            (f, g), (own_f, own_g) = folds[text], folds[x]
            tier = 1 if own_f == f else 2 if own_g == g else 4
            if tier == 4 and i + 1 < len(token) and None not in (own_f, after := folds[token[i + 1]][0]) and own_f + after == f:
                out += [i + 1 << 34 | j << 4 | 3, i + 2 << 34 | j << 4 | 3]
                i += 2
                continue
        i += 1
        out.append(i << 34 | j << 4 | tier)
    return out + [k << 34 | 5 for k in range(i + 1, len(token) + 1)]


class _Folds(dict):
    def __missing__(self, text: str | None) -> tuple:
        got = self[text] = (None, None) if text is None else X.folds_of(text)
        return got


def _walks(tokens: pa.Array, words: pa.Array) -> pa.Array:
    """_walk for each verse that has lists, null for others."""
    token, word, folds = tokens.flatten().to_pylist(), words.flatten().to_pylist(), _Folds()
    out: list[list[int] | None] = []
    i = j = 0
    for n, m in zip(pc.list_value_length(tokens).to_pylist(), pc.list_value_length(words).to_pylist(), strict=True):
        out.append(None if n is None else _walk(token[i : i + n], word[j : j + m], folds))
        i, j = i + (n or 0), j + (m or 0)
    return pa.array(out, pa.list_(pa.int64()))


def align_verses(verses: DataFrame) -> DataFrame:
    """Add aligned to verses: array<struct<at, of, tier>>, for each pair the places of the token and the word, -1 where there is none.

    verses: tokens, an array of structs of position and token in order, and words, one of word and surface (and
    others). Nothing leaves its row. Only a verse whose words aren't its tokens as they are is walked in
    order: a word may fit two tokens together (``merged``, one pair each); a word that fits nothing is ``failed`` and
    moves on by one token, and tokens left over are ``unaligned``.
    """
    token, word = F.col("tokens")["token"], F.col("words")["surface"]
    rows = verses.withColumn("_walked", token != word)
    rows = rows.withColumn("_pairs", F.arrow_udf(_walks, "array<bigint>")(F.when(F.col("_walked"), token), F.when(F.col("_walked"), word)))
    pair = lambda at, of, tier: F.struct(at.cast("int").alias("at"), of.cast("int").alias("of"), tier.alias("tier"))
    names = F.array(*[F.lit(t) for t in TIERS])
    walked = F.transform("_pairs", lambda p: pair(F.shiftright(p, 34) - 1, F.shiftright(p, 4).bitwiseAND(F.lit((1 << 30) - 1)) - 1, F.get(names, p.bitwiseAND(F.lit(15)).cast("int"))))
    fitting = F.transform("tokens", lambda _, i: pair(i, i, F.lit("exact")))
    return rows.withColumn("aligned", F.when(F.col("_walked"), walked).otherwise(fitting)).drop("_walked", "_pairs")


def align(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(division, slot, position, word, tier): source words on tokens of a verse, by align_verses; each side moves once, to its verse's row."""
    keys = ["division", "slot"]
    one = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", F.col("word").alias("token")))).alias("tokens"))
    two = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word", "surface"))).alias("words"))
    none = lambda c, side: F.coalesce(c, F.array().cast(side.schema[c].dataType)).alias(c)
    return aligned_tokens(align_verses(one.join(two, keys, "full_outer").select(*keys, none("tokens", one), none("words", two))))


def aligned_tokens(verses: DataFrame, parts: bool = False) -> DataFrame:
    """(division, slot, position, word, tier) of align_verses' rows, with attach_parts' parts if asked for; words have parts then."""

    def row(p: Column, i: Column) -> Column:
        position, word = F.get("tokens", p["at"])["position"].cast("int").alias("position"), F.get("words", p["of"])["word"].cast("int").alias("word")
        if not parts:
            return F.struct(position, word, p["tier"].alias("tier"))
        before = F.get("aligned", i - 1)
        second = F.coalesce((before["of"] == p["of"]) & (before["tier"] == "merged"), F.lit(False))
        whole = F.get("words", p["of"])["parts"]
        cut = _own_parts(whole, F.get("tokens", p["at"] - second.cast("int"))["token"], second)
        own = F.when(p["tier"] == "merged", cut).when(~p["tier"].isin("failed", "unaligned"), whole)
        return F.struct(position, word, F.when((p["tier"] == "merged") & own.isNull(), "failed").otherwise(p["tier"]).alias("tier"), own.alias("parts"))

    return verses.select("division", "slot", F.explode(F.transform("aligned", row)).alias("_a")).select("division", "slot", "_a.*")


def _own_parts(parts: Column, first: Column, second: Column) -> Column:
    """The parts of one of a merged word's two tokens (``first``: the first one's text), null if they can't be divided; see attach_parts."""
    upto = lambda k: F.array_join(F.transform(F.slice(parts, 1, k), lambda p: p["text"]), "")
    k = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: (k < F.size(parts)) & (X.fold(upto(k)) == X.fold(first))), F.lit(0))
    halves = F.split(F.get(parts, F.lit(0))["text"], " ", -1)
    cut_parts = F.when(second, F.slice(parts, k + 1, F.size(parts))).otherwise(F.slice(parts, F.lit(1), k))
    half = F.array(F.get(parts, F.lit(0)).withField("text", F.get(halves, second.cast("int"))))
    return F.when(k.isNotNull(), cut_parts).when(F.size(halves) == 2, half)


def attach_parts(aligned: DataFrame, tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(division, slot, position, word, tier, parts): what align found, with each token's own parts.

    ``words``: division, slot, word and parts, an array of structs with a text. A word on one token gives it all
    its parts. A merged word's parts are divided where those before reproduce the first token under the fold; if no
    place does and its first part has one space, both halves of that part keep its analysis; else both
    tokens are ``failed`` and get none, and so do failed and unaligned rows.
    """
    keys = ["division", "slot"]
    rows = aligned.join(words.select(*keys, "word", "parts"), [*keys, "word"], "left").select(*keys, "position", "word", "tier", "parts")
    merged = rows.filter("tier = 'merged'").join(tokens.select(*keys, "position", F.col("word").alias("token")), [*keys, "position"])
    order = W.partitionBy(*keys, "word").orderBy("position")
    merged = merged.withColumns({"first": F.first("token").over(order), "second": F.row_number().over(order) == 2})
    own = _own_parts(F.col("parts"), F.col("first"), F.col("second"))
    merged = merged.withColumn("parts", own).withColumn("tier", F.when(F.col("parts").isNull(), "failed").otherwise("merged"))
    others = rows.filter("tier <> 'merged'").withColumn("parts", F.when(~F.col("tier").isin("failed", "unaligned"), F.col("parts")))
    return others.unionByName(merged.select(others.columns))


def alignment_stats(aligned: DataFrame) -> DataFrame:
    """Tokens of each tier and the rate that is aligned, one row."""
    counts = aligned.agg(F.count("*").alias("rows"), *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    return counts.withColumn("rate", F.round(1 - (F.col("failed") + F.col("unaligned")) / F.col("rows"), 6))


def alignment_report(annotated: DataFrame) -> DataFrame:
    """One row from one pass over annotated tokens (tier, gloss, transliteration, roots): tiers, rate, coverage of glosses and transliterations, tokens of several roots."""
    has = lambda c: F.count_if(F.col(c).isNotNull() & (F.col(c) != ""))
    tiers = ["exact", "normalised", "extended", "merged", "copied", "failed", "unaligned"]
    counts = annotated.agg(F.count("*").alias("tokens"), *[F.count_if(F.col("tier") == t).alias(t) for t in tiers], has("gloss").alias("glossed"), has("transliteration").alias("transliterated"), F.count_if(F.size(F.array_distinct("roots")) > 1).alias("several_roots"))
    share = lambda c: F.when(F.col("tokens") > 0, F.round(c / F.col("tokens"), 6))
    return counts.withColumns({"rate": share(F.col("tokens") - F.col("failed") - F.col("unaligned")), "gloss_coverage": share(F.col("glossed")), "transliteration_coverage": share(F.col("transliterated"))})


def top_roots(tokens: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent roots: (root, occurrences), ties by root."""
    return tokens.filter("root is not null").groupBy("root").agg(F.count("*").alias("occurrences")).orderBy(F.desc("occurrences"), "root").limit(k)


def alignment_exceptions(aligned: DataFrame) -> DataFrame:
    return aligned.filter(F.col("tier").isin("failed", "unaligned", "merged", "extended"))


def copy_template(tokens: DataFrame, template: DataFrame) -> DataFrame:
    """Formula tokens with the analysis of the template's token at the same position, where folds agree; else ``failed``."""
    t = template.select("position", F.col("word").alias("_word"), F.col("root").alias("_root"), F.col("lemma").alias("_lemma"), F.col("pos").alias("_pos"))
    own = tokens.filter("is_formula").join(few(t), "position", "left")
    agree = X.fold(F.col("word")) == X.fold(F.col("_word"))
    kept = lambda c: F.when(agree, F.col(c))
    return own.select("token_id", kept("_root").alias("root"), kept("_lemma").alias("lemma"), kept("_pos").alias("pos"), F.when(agree, "copied").otherwise("failed").alias("tier"))


def build_roots(tokens: DataFrame) -> DataFrame:
    """(root, occurrences, lemmas): lemmas by count, then name; the long form (root, token) is tokens itself."""
    counts = tokens.filter("root is not null").groupBy("root", "lemma").agg(F.count("*").alias("n"))
    return counts.groupBy("root").agg(F.sum("n").alias("occurrences"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lemma"))), lambda s: s["lemma"]).alias("lemmas"))


def rank_roots(roots: DataFrame) -> DataFrame:
    """Roots with place: the most frequent first, then by slug (the root's own text here); places are running sums."""
    keyed = roots.withColumn("_n", -F.col("occurrences"))
    return running_before(keyed, "_n", F.lit(1), "place", ["root"]).withColumn("place", F.col("place") + 1).drop("_n")


def root_token_pages(tokens: DataFrame, per_page: int = 1000) -> DataFrame:
    """(root, page, token_ids): each root's tokens in corpus order, in pages, so that a frequent root is no single row.

    Tokens are numbered inside (root, block of handles) and blocks by their sums, so no task sorts a whole root.
    """
    own = tokens.filter("root is not null").select("root", "handle", "token_id").withColumn("_block", F.shiftright("handle", 16))
    sizes = own.groupBy("root", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("root").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("root", "_block").orderBy("handle")) - 1
    numbered = own.join(sizes.select("root", "_block", before.alias("_before")), ["root", "_block"]).withColumn("_k", F.col("_before") + inside)
    paged = numbered.groupBy("root", F.floor(F.col("_k") / per_page).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("_k", "token_id"))).alias("t"))
    return paged.select("root", "page", F.col("t.token_id").alias("token_ids"))


def with_root_occurrences(tokens: DataFrame) -> DataFrame:
    counts = tokens.filter("root is not null").groupBy("root").agg(F.count("*").alias("root_occurrences"))
    return tokens.join(counts, "root", "left")


def pos_sample(tokens: DataFrame, each: int = 15, most: int = 220) -> DataFrame:
    """The first tokens with a gloss of each part of speech, in corpus order, held to ``most``."""
    own = tokens.filter("gloss is not null and gloss != ''")
    salted = W.partitionBy("pos", F.pmod(F.col("division"), F.lit(64))).orderBy("handle")
    first = own.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= each)
    return first.withColumn("_r", F.row_number().over(W.partitionBy("pos").orderBy("handle"))).filter(F.col("_r") <= each).drop("_r").orderBy("handle").limit(most)


def match_lexicon(roots: DataFrame, articles: DataFrame) -> DataFrame:
    """(root, key, match): the first article with a root's radical print, or with its geminate's shortened one, else missing.

    roots: root, print; articles: key, print, seq.
    """
    first = articles.filter("print != ''").groupBy("print").agg(F.min_by("key", "seq").alias("key"))
    doubled = (F.length("print") >= 2) & (F.substring("print", -1, 1) == F.col("print").substr(F.length("print") - 1, F.lit(1)))
    short = roots.withColumn("_short", F.when(doubled, F.left("print", F.length("print") - 1)))
    out = short.join(first, "print", "left").join(first.select(F.col("print").alias("_short"), F.col("key").alias("_key")), "_short", "left")
    match = F.when(F.col("key").isNotNull(), "direct").when(F.col("_key").isNotNull(), "geminate").otherwise("missing")
    return out.select("root", F.coalesce("key", "_key").alias("key"), match.alias("match"))


def print_collisions(roots: DataFrame) -> DataFrame:
    """Prints that more than one root has."""
    return roots.groupBy("print").agg(F.count_distinct("root").alias("roots")).filter("roots > 1")


def align_edition(edition: DataFrame, verses: DataFrame, keys: Sequence[str] = ("division", "slot")) -> DataFrame:
    """An edition's lines on the counted verses; a missing or an extra verse fails."""
    refuse(verses.join(edition, list(keys), "left_anti").select(*keys), "missing verses")
    refuse(edition.join(verses, list(keys), "left_anti").select(*keys), "extra verses")
    return verses.select(*keys).join(edition, list(keys))


def transliterate(words: DataFrame, source: str, computed: str = "computed") -> DataFrame:
    """Add transliteration and transliteration_source to words (surface, given): what the source gives, else the surface's romanisation.

    The source column is ``source`` or ``computed``; a word that neither gives, or whose romanisation is empty, has
    null for both. Distinct surfaces without a given form are romanised once each.
    """
    asked = (F.coalesce("given", F.lit("")) == "") & F.col("surface").isNotNull()
    forms = words.filter(asked).select("surface").distinct().withColumn("_made", X.romanise(F.col("surface")))
    out = words.withColumn("_asked", F.when(asked, F.col("surface"))).join(forms.withColumnRenamed("surface", "_asked"), "_asked", "left")
    told, made = F.nullif("given", F.lit("")), F.nullif("_made", F.lit(""))
    which = F.when(told.isNotNull(), F.lit(source)).when(made.isNotNull(), F.lit(computed))
    return out.withColumns({"transliteration": F.coalesce(told, made), "transliteration_source": which}).drop("_asked", "_made")
