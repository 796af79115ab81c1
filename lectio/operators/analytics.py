"""Corpus analytics over tokens, (verse, root) pairs and translation lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators.order import FEW, cut, few, running_before, written


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


#: Forms whose totals are broadcast: the most common ones, some 97 in 100 tokens of a large corpus.
COMMON = 250_000


def _least_common(totals: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` rows' n reach; a count for each power comes to the driver."""
    bits = {r["bits"]: r["rows"] for r in totals.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("rows")).collect()}
    least = max(bits, default=0) + 1
    while least > 1 and (most := most - bits.get(least - 1, 0)) >= 0:
        least -= 1
    return 1 << (least - 1)


def word_profiles(tokens: DataFrame, others: int = 12, counted: DataFrame | None = None) -> DataFrame:
    """Per token: its neighbours in corpus order, and for its form and its root how many tokens and distinct forms.

    A token's id is ``division:slot:position``. Neighbours come from windows inside a division, where tokens dealt by division
    stay, and where one ends from a table of the divisions' edges. No token moves: totals of common forms are
    broadcast, and those of other forms come to each division that has them, as a map in a row of its own. ``counted``: the
    same tokens as they lie, which are counted without being dealt.
    """
    counted = tokens if counted is None else counted
    name = lambda slot, position: F.concat_ws(":", "division", slot, position)
    low, position = (lambda at: F.shiftright(at, 32)), (lambda at: F.col(at).bitwiseAND(F.lit((1 << 32) - 1)))
    at = F.shiftleft(F.col("slot").cast("bigint"), 32) + F.col("position")
    kinds = written(counted.groupBy("form", "root").agg(F.count("*").alias("n")))
    forms = written(kinds.groupBy("form").agg(F.sum("n").alias("n")))
    least = _least_common(forms, COMMON)
    common = F.broadcast(forms.filter(F.col("n") >= least).withColumnRenamed("n", "_common"))
    # One pass for the edges and the rarer forms of divisions.
    seen = counted.join(common, "form", "left").groupBy("division", F.when(F.col("_common").isNull(), F.col("form")).alias("form")).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    seen = written(seen)
    rare = seen.join(forms.filter(F.col("n") < least), "form").groupBy("division").agg(F.map_from_entries(F.collect_list(F.struct("form", "n"))).alias("_rare"))
    edges = cut(seen.groupBy("division").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")))
    edges = edges.select("division", name(low("_low"), position("_low")).alias("first_id"), name(low("_high"), position("_high")).alias("last_id"))
    placed = cut(running_before(edges, "division", F.lit(1), "_nth"))
    before, after = placed.select((F.col("_nth") + 1).alias("_nth"), F.col("last_id").alias("before_id")), placed.select((F.col("_nth") - 1).alias("_nth"), F.col("first_id").alias("after_id"))
    outside = few(placed.join(before, "_nth", "left").join(after, "_nth", "left").select("division", "before_id", "after_id"))
    roots = few(kinds.filter("root is not null").groupBy("root").agg(F.sum("n").alias("root_total"), F.count("*").alias("root_forms")))
    order = W.partitionBy("division").orderBy("slot", "position")
    # Null beside a token of the next number in its verse, -1 where the division ends.
    beside = lambda fn, by: F.when(fn("_at").over(order).isNull(), F.lit(-1).cast("bigint")).when(fn("_at").over(order) != F.col("_at") + by, fn("_at").over(order))
    near = tokens.select("division", "slot", "position", "form", "root", at.alias("_at")).withColumns({"_previous": beside(F.lag, -1), "_next": beside(F.lead, 1)}).drop("_at").join(outside, "division")
    near = near.withColumn("before_id", F.when(F.col("_previous") == -1, F.col("before_id"))).withColumn("after_id", F.when(F.col("_next") == -1, F.col("after_id")))
    out = near.join(rare.hint("shuffle_hash"), "division", "left").join(roots, "root", "left").drop("root").join(common, "form", "left")
    out = out.withColumn("form_total", F.coalesce("_common", F.try_element_at("_rare", F.col("form"))))
    own = lambda c, by: F.when(F.col(c).isNull(), name("slot", F.col("position") + by)).when(F.col(c) >= 0, name(low(c), position(c)))
    return out.select(
        name("slot", "position").alias("token_id"),
        F.coalesce(own("_previous", -1), "before_id").alias("previous_id"),
        F.coalesce(own("_next", 1), "after_id").alias("next_id"),
        "form_total",
        "root_total",
        "root_forms",
        (F.col("form_total") > others + 1).alias("has_more"),
    )


def same_form_tokens(tokens: DataFrame, k: int = 12) -> DataFrame:
    """For each form its first k + 1 tokens in corpus order: enough for the first k others of any token."""
    return top(tokens.select("form", "token_id", "handle"), ["form"], [F.col("handle")], k + 1)


def same_root_tokens(tokens: DataFrame, k: int = 12) -> DataFrame:
    """For each root its first k + 1 tokens in corpus order: enough for the first k others of any token."""
    return top(tokens.filter("root is not null").select("root", "token_id", "handle"), ["root"], [F.col("handle")], k + 1)


def root_kinds(tokens: DataFrame) -> DataFrame:
    """(root, form, lemma, n): what kinds of tokens roots have."""
    return tokens.filter("root is not null").groupBy("root", "form", "lemma").agg(F.count("*").alias("n"))


def root_places(tokens: DataFrame) -> DataFrame:
    """(root, division, n, verses, first, last): tokens and verses of a root in a division, and the places of its first and last token there.

    A place is slot * 2**32 + position. Of tokens that are dealt by division none moves.
    """
    rooted = tokens.filter("root is not null").withColumn("_at", F.shiftleft(F.col("slot").cast("bigint"), 32) + F.col("position"))
    by_verse = rooted.groupBy("root", "division", "slot").agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    return by_verse.groupBy("root", "division").agg(F.sum("n").alias("n"), F.count("*").alias("verses"), F.min("first").alias("first"), F.max("last").alias("last"))


def root_profiles(tokens: DataFrame) -> DataFrame:
    """Per root: occurrences, distinct forms and lemmas, verses, first and last token, the division with most.

    A token's id is ``division:slot:position``, and their order that of the corpus. Tokens are best dealt by division
    (see root_places): all that moves then is a row for each root and division, and kind of token.
    """
    name = lambda division, at: F.concat_ws(":", division, F.shiftright(at, 32), F.col(at).bitwiseAND(F.lit((1 << 32) - 1)))
    places = root_places(tokens).groupBy("root").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("divisions"), F.sum("verses").alias("verses"), F.max("n").alias("most_in_division"),
        F.min("division").alias("_low"), F.min_by("first", "division").alias("_first"), F.max("division").alias("_high"), F.max_by("last", "division").alias("_last"),
    )
    kinds = root_kinds(tokens).groupBy("root").agg(F.count_distinct("form").alias("forms"), F.count_distinct("lemma").alias("lemmas"))
    out = places.join(kinds, "root")
    return out.select("root", "occurrences", "divisions", "verses", "most_in_division", name("_low", "_first").alias("first_id"), name("_high", "_last").alias("last_id"), "forms", "lemmas")


def root_forms(tokens: DataFrame) -> DataFrame:
    """(root, form, count, first_id), each root's forms by count and then first place."""
    counts = tokens.filter("root is not null").groupBy("root", "form").agg(F.count("*").alias("count"), F.min("handle").alias("first"), F.min_by("token_id", "handle").alias("first_id"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(F.desc("count"), "first"))).drop("first")


def root_divisions(tokens: DataFrame) -> DataFrame:
    return tokens.filter("root is not null").groupBy("root", "division").agg(F.count("*").alias("count"))


def root_lemmas(tokens: DataFrame) -> DataFrame:
    """(root, lemma, count, rank), each root's lemmas by count and then by letters."""
    counts = tokens.filter("root is not null").groupBy("root", "lemma").agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(F.desc("count"), "lemma")))


def root_entries(profiles: DataFrame, matches: DataFrame, articles: DataFrame) -> DataFrame:
    """Root profiles with their lexicon entry: entry_key, entry and match; a root that no article matches has a null entry.

    matches: root, key, match as match_lexicon gives them; articles: key, seq, entry. Of articles of one key the first is taken.
    """
    first = articles.groupBy(F.col("key").alias("entry_key")).agg(F.min_by("entry", "seq").alias("entry"))
    found = matches.select("root", F.col("key").alias("entry_key"), "match").join(first, "entry_key", "left")
    return profiles.join(found, "root", "left").withColumn("match", F.coalesce("match", F.lit("missing")))


def root_occurrences(tokens: DataFrame, root: str, page: int, per_page: int) -> DataFrame:
    """A page of the segments with a root, with their tokens; a page past the end is the last one."""
    own = tokens.filter(F.col("root") == root)
    # Written once: they are counted, summed and read.
    segments = written(own.groupBy("segment_id").agg(F.min("handle").alias("first"), F.array_sort(F.collect_list(F.struct("handle", "token_id")))["token_id"].alias("token_ids")))
    total = segments.count()
    pages = max(1, -(-total // per_page))
    number = min(max(1, page), pages)
    numbered = running_before(segments, "first", F.lit(1), "_nth").filter(F.col("_nth").between((number - 1) * per_page, number * per_page - 1)).drop("_nth")
    return numbered.orderBy("first").withColumn("page", F.lit(number)).withColumn("pages", F.lit(pages))


def gloss_index(tokens: DataFrame, gloss: str = "gloss") -> DataFrame:
    """Per gloss key: total, distinct roots (no root counts as one), the most common verbatim form and the slug."""
    # Written once; keys are made of different glosses, not of each token's.
    counts = written(tokens.groupBy(gloss, "root").agg(F.count("*").alias("n")))
    keyed = counts.withColumn("key", X.gloss_key(F.col(gloss))).filter("key != ''")
    variants = keyed.groupBy("key", F.col(gloss).alias("display")).agg(F.sum("n").alias("n"))
    best = variants.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("variants"), F.min(F.struct((-F.col("n")).alias("n"), "display"))["display"].alias("display"))
    roots = keyed.groupBy("key", F.coalesce("root", F.lit("")).alias("root")).agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("root_count"))
    return best.join(roots, "key").withColumn("slug", X.gloss_slug(F.col("key")))


def gloss_listing(index: DataFrame, part: str, k: int = 50) -> DataFrame:
    """The first k glosses whose key holds ``part``, by distinct roots, total and key, with the numbers of all keys and of those found."""
    found = index.filter(F.col("key").contains(part))
    order = [F.desc("root_count"), F.desc("total"), F.col("key")]
    totals = index.agg(F.count("*").alias("before"), F.count_if(F.col("key").contains(part)).alias("after"))
    few = found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return few.crossJoin(F.broadcast(totals))


def gloss_groups(tokens: DataFrame, gloss: str = "gloss") -> DataFrame:
    """(key, root, lemma, count, root_total, rank): the reverse gloss; gloss_occurrences has the tokens of each group."""
    keyed = tokens.withColumn("key", X.gloss_key(F.col(gloss))).filter("key != ''").select("key", "root", "lemma")
    counts = keyed.groupBy("key", "root", "lemma").agg(F.count("*").alias("count"))
    totals = counts.groupBy("key", "root").agg(F.sum("count").alias("root_total"))
    same = lambda a, b, *cs: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in cs))
    out = counts.alias("c").join(totals.alias("t"), same("c", "t", "key", "root")).select("c.*", "t.root_total")
    order = W.partitionBy("key").orderBy(F.col("root").isNull(), F.desc("root_total"), "root", F.desc("count"), F.col("lemma"))
    return out.withColumn("rank", F.row_number().over(order))


def gloss_occurrences(tokens: DataFrame, gloss: str = "gloss") -> DataFrame:
    """(key, root, lemma, token_id, handle): every token of the reverse gloss's groups, a row each."""
    return tokens.withColumn("key", X.gloss_key(F.col(gloss))).filter("key != ''").select("key", "root", "lemma", "token_id", "handle")


def verse_roots(tokens: DataFrame) -> DataFrame:
    """Distinct (verse, root) pairs; formula tokens and missing roots don't count."""
    return tokens.filter("root is not null and not is_formula").select(F.col("segment_id").alias("verse"), "root").distinct()


def stoplist(pairs: DataFrame, min_df: int = 500, share: float | None = None) -> DataFrame:
    """Roots in at least min_df verses, or in at least a share of the verses that have a root."""
    counts = pairs.groupBy("root").agg(F.count("*").alias("verses"))
    if share is None:
        return counts.filter(F.col("verses") >= min_df)
    all_ = pairs.agg(F.count_distinct("verse").alias("_all"))
    return counts.join(F.broadcast(all_), F.col("verses") >= F.col("_all") * share).drop("_all")


def split_roots(pairs: DataFrame, min_df: int = 500, share: float | None = None) -> DataFrame:
    """Each verse's kept and excluded roots, sorted."""
    marked = pairs.join(few(stoplist(pairs, min_df, share).select("root", F.lit(True).alias("stop"))), "root", "left")
    own = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("root"))))
    return marked.groupBy("verse").agg(own(F.col("stop").isNull()).alias("kept"), own(F.col("stop")).alias("excluded"))


#: Roots of a set up to which its pairs of roots are listed.
PAIRED = 48


def _near_sets(sets: DataFrame, k: int) -> DataFrame:
    """(a, b, shared, union) for at least the k most similar other sets of each set (id, first, size, roots); never all sets that share a root.

    Sets that share two roots or more meet on pairs of roots: s shared roots give s(s-1)/2 shared pairs. Of
    those that share just one with a set, only the k smallest sets of that root can be among its best: a
    smaller one scores no less, and has an equal or better claim on a tie. Sets of over PAIRED roots,
    whose pairs would be many, meet all others on single roots instead.
    """
    small, large = sets.filter(F.size("roots") <= PAIRED), sets.filter(F.size("roots") > PAIRED)
    listed = lambda df: df.select("id", "size", "first", F.explode("roots").alias("root"))
    twos = F.flatten(F.transform("roots", lambda x, i: F.transform(F.slice("roots", i + 2, F.size("roots")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keyed = small.filter("size > 1").select("id", F.explode(twos).alias("two"))
    met = keyed.select(F.col("id").alias("a"), "two").join(keyed.select(F.col("id").alias("b"), "two"), "two").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    met = met.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("bigint").alias("shared"))
    big = listed(large).select(F.col("id").alias("a"), "root").join(listed(sets).select(F.col("id").alias("b"), "root"), "root").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = lambda df: df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    shortest = top(listed(sets), ["root"], [F.col("size"), F.col("first")], k + 1).select(F.col("id").alias("b"), "root")
    one = listed(sets).select(F.col("id").alias("a"), "root").join(shortest, "root").filter("a <> b").select("a", "b", F.lit(1).cast("bigint").alias("shared"))
    shared = both(met).unionByName(both(big)).unionByName(one).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    size = lambda name: sets.select(F.col("id").alias(name), F.col("size").alias(f"size_{name}"))
    out = shared.join(size("a"), "a").join(size("b"), "b")
    return out.select("a", "b", "shared", (F.col("size_a") + F.col("size_b") - F.col("shared")).alias("union"))


def similar_verses(pairs: DataFrame, k: int = 8, min_df: int = 500, share: float | None = None) -> DataFrame:
    """For each verse the k most similar by Jaccard over roots that aren't stoplisted. Ties: larger intersection, then verse.

    Verses of equal root sets are one class: classes are compared once, whatever their size, and of each only
    its first k + 1 verses can be among anyone's best. What a class's verses have in common is ranked once and
    joined to them.
    """
    kept = pairs.join(few(stoplist(pairs, min_df, share).select("root")), "root", "left_anti")
    verses = cut(kept.groupBy("verse").agg(F.array_sort(F.collect_list("root")).alias("roots")))
    classes = cut(verses.groupBy("roots").agg(F.min("verse").alias("first"))).select(F.monotonically_increasing_id().alias("id"), "first", F.size("roots").cast("bigint").alias("size"), "roots")
    members = verses.join(classes.select("roots", "id", "size"), "roots").select("id", "size", "verse")
    leading = top(members, ["id"], [F.col("verse")], k + 1).select("id", "size", F.col("verse").alias("other"))
    score = F.col("shared") / F.col("union")
    near = _near_sets(classes, k).withColumn("score", score).join(classes.select(F.col("id").alias("b"), "first"), "b")
    near = top(near, ["a"], [F.desc("score"), F.desc("shared"), F.col("first")], k).drop("rank")
    others = near.join(leading.select(F.col("id").alias("b"), "other"), "b").select("a", "other", "shared", "union", "score")
    own = leading.select(F.col("id").alias("a"), "other", F.col("size").alias("shared"), F.col("size").alias("union"), F.lit(1.0).alias("score"))
    order = [F.desc("score"), F.desc("shared"), F.col("other")]
    # One place more than asked for, since a verse isn't among its own best.
    best = top(own.unionByName(others), ["a"], order, k + 1, "_place")
    mine = members.select(F.col("id").alias("a"), "verse").join(best, "a").filter("verse <> other")
    return top(mine, ["verse"], [F.col("_place")], k).select("verse", "other", "shared", "union", "score", "rank")


def shared_roots(similar: DataFrame, pairs: DataFrame, min_df: int = 500, share: float | None = None) -> DataFrame:
    """Add shared_roots to the pairs that similar_verses kept."""
    kept = pairs.join(stoplist(pairs, min_df, share).select("root"), "root", "left_anti")
    sets = kept.groupBy("verse").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    out = similar.join(sets, "verse").join(sets.withColumnsRenamed({"verse": "other", "roots": "other_roots"}), "other")
    return out.withColumn("shared_roots", F.array_intersect("roots", "other_roots")).drop("roots", "other_roots")


def co_occurrence(pairs: DataFrame, k: int = 12, min_df: int = 500) -> DataFrame:
    """For each root the k others that share most verses with it; stoplisted roots are no results."""
    stop = few(stoplist(pairs, min_df).select(F.col("root").alias("other")))
    totals = pairs.groupBy("root").agg(F.count("*").alias("verses"))
    a, b = pairs.select("verse", "root"), pairs.select("verse", F.col("root").alias("other"))
    counts = a.join(b.join(stop, "other", "left_anti"), "verse").filter("root != other").groupBy("root", "other").agg(F.count("*").alias("shared"))
    return top(counts, ["root"], [F.desc("shared"), F.col("other")], k).join(totals, "root").select("root", "verses", "other", "shared", "rank")


def _edition_stems(lines: DataFrame) -> DataFrame:
    return lines.groupBy("verse_id", "edition").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text")).withColumn("stems", X.significant_stems(F.col("text")))


def _edition_pairs(stems: DataFrame) -> DataFrame:
    a, b = (stems.select("verse_id", F.col("edition").alias(f"edition_{s}"), F.col("stems").alias(s)) for s in "ab")
    return a.join(b, "verse_id").filter("edition_a < edition_b").select("verse_id", "edition_a", "edition_b", X.jaccard(F.col("a"), F.col("b"), 1.0).alias("score"))


def divergence_pairs(lines: DataFrame) -> DataFrame:
    """(verse_id, edition_a, edition_b, score, rank): each verse's pairs of editions by Jaccard of significant stems, most divergent first."""
    order = W.partitionBy("verse_id").orderBy("score", "edition_a", "edition_b")
    return _edition_pairs(_edition_stems(lines)).withColumn("rank", F.row_number().over(order))


def divergence(lines: DataFrame, below: float = 0.4) -> DataFrame:
    """Per verse: the least Jaccard of significant stems over the pairs of editions, and whether it is divergent."""
    stems = _edition_stems(lines)
    least = _edition_pairs(stems).groupBy("verse_id").agg(F.min("score").alias("least"))
    editions = stems.groupBy("verse_id").agg(F.count("*").alias("editions"))
    out = editions.join(least, "verse_id", "left")
    return out.select("verse_id", "editions", F.coalesce("least", F.lit(1.0)).alias("least"), ((F.col("editions") >= 2) & F.coalesce(F.col("least") < below, F.lit(False))).alias("divergent"))


def reverse_lookup(lines: DataFrame, query: str) -> DataFrame:
    """Verses with the query's first word as a whole word, and the editions that have it; a blank query finds nothing."""
    word = F.get(X.latin_words(F.lit(query)), F.lit(0))
    return lines.filter(F.array_contains(X.latin_words(F.col("text")), word)).groupBy("verse_id").agg(F.array_sort(F.collect_set("edition")).alias("editions"))


def reverse_lookup_page(lines: DataFrame, tokens: DataFrame, query: str, k: int = 50) -> DataFrame:
    """The first k verses of reverse_lookup in corpus order with their words, and the number of all that were found.

    tokens: segment_id, handle, word.
    """
    found = reverse_lookup(lines, query)
    total = found.agg(F.count("*").alias("total"))
    first = tokens.groupBy("segment_id").agg(F.min("handle").alias("first"))
    few = found.join(first, F.col("verse_id") == F.col("segment_id")).orderBy("first").limit(k).drop("segment_id")
    words = tokens.join(few.select(F.col("verse_id").alias("segment_id")), "segment_id", "left_semi").groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("handle", "word")))["word"].alias("words"))
    return few.join(words, F.col("verse_id") == F.col("segment_id")).crossJoin(F.broadcast(total)).select("verse_id", "editions", "first", "words", "total")


def word_index(lines: DataFrame) -> DataFrame:
    """(word, verses, editions): reverse lookup for all words at once."""
    words = lines.select("verse_id", "edition", F.explode(F.array_distinct(X.latin_words(F.col("text")))).alias("word")).distinct()
    by = words.groupBy("word", "verse_id").agg(F.count("*").alias("n"))
    return by.groupBy("word").agg(F.count("*").alias("verses"), F.sum("n").alias("lines"))


def verse_editions(lines: DataFrame, catalogue: Sequence[str | tuple[str, bool]], chosen: Sequence[str] | None = None, redistributable: bool = False) -> DataFrame:
    """The editions of each verse in the catalogue's order, as an array; missing lines are left out.

    The catalogue lists editions, or (edition, whether it may be redistributed). ``chosen`` takes some of them, still in
    that order; with ``redistributable`` only those that may be passed on come out.
    """
    known = [e if isinstance(e, tuple) else (e, True) for e in catalogue]
    own = [e for e, free in known if (chosen is None or e in chosen) and (free or not redistributable)]
    rank = F.create_map(*[F.lit(x) for i, e in enumerate(own) for x in (e, i)]) if own else F.lit(None).cast("map<string,int>")
    rows = lines.filter(F.col("edition").isin(*own)).withColumn("rank", F.element_at(rank, F.col("edition")))
    return rows.groupBy("verse_id").agg(F.array_sort(F.collect_list(F.struct("rank", "edition", "text"))).alias("editions"))


def frames(tokens: DataFrame) -> DataFrame:
    """(root, following, count): the forms that follow a root's tokens, '—' at a verse's end."""
    return frame_refs(tokens).groupBy("root", "following").agg(F.count("*").alias("count"))


def frame_refs(tokens: DataFrame) -> DataFrame:
    """(root, following, segment_id, token_id): each token of a root with the form that follows it, '—' at a verse's end."""
    after = F.coalesce(F.lead("form").over(W.partitionBy("segment_id").orderBy("position")), F.lit("—"))
    return tokens.withColumn("following", after).filter("root is not null").select("root", "following", "segment_id", "token_id")


def lemma_counts(tokens: DataFrame) -> DataFrame:
    """(root, lemma, pos, count) of an evidence pack."""
    return tokens.filter("root is not null").groupBy("root", "lemma", "pos").agg(F.count("*").alias("count"))


def contrast_lines(tokens: DataFrame, words: Sequence[str], k: int = 10) -> DataFrame:
    """Each root's first k tokens beside a contrast word, with both neighbours."""
    order = W.partitionBy("segment_id").orderBy("position")
    shown = tokens.withColumn("following", F.coalesce(F.lead("form").over(order), F.lit("—"))).withColumn("preceding", F.coalesce(F.lag("form").over(order), F.lit("—")))
    own = shown.filter(F.col("root").isNotNull() & (F.col("following").isin(*words) | F.col("preceding").isin(*words)))
    return top(own.select("root", "handle", "segment_id", "preceding", "form", "following"), ["root"], [F.col("handle")], k)


def collisions(tokens: DataFrame, weak: str, k: int = 14) -> DataFrame:
    """(root, form): forms that hold a root's radicals in order, with only weak letters between, but belong to another root.

    Distinct forms meet distinct roots on the form's hard letters: each run of them that is no longer than
    the longest root's is a key, so no root is compared with all forms. Tokens are read once; the pairs of a form and a root
    stay where they are, and only the first k of a root in each task are sent.
    """
    pairs = written(tokens.filter("root is not null").select("form", "root").distinct())
    forms = pairs.groupBy("form").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    strip = lambda c: F.regexp_replace(c, f"[{weak}]", "")
    roots = pairs.select("root").distinct().withColumn("core", F.regexp_replace("root", r"[\s-]", "")).withColumn("hard", strip(F.col("core")))
    roots = few(roots)
    hard = strip(F.col("form"))
    longest = roots.agg(F.max(F.length("hard"))).first()[0] or 1
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(hard), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: hard.substr(i, n))))
    keyed = forms.withColumn("hard", F.explode(F.array_distinct(spans)))
    # A form of several roots belongs to another one than any of them.
    joined = keyed.join(roots.filter("length(core) >= 2"), "hard").filter("root != low or root != high")
    wanted = F.array_join(F.filter(F.split("core", ""), lambda x: x != ""), f"[{weak}]*")
    # A run of hard letters is a root without weak ones already.
    found = joined.filter(F.when(F.col("core") == F.col("hard"), True).otherwise(F.rlike(F.col("form"), wanted))).select("root", "form")
    return top(found, ["root"], [F.col("form")], k)


def worklist(tokens: DataFrame, division: int) -> DataFrame:
    """A division's roots, and forms without a root, in first-seen order."""
    own = tokens.filter(F.col("division") == division)
    item = F.coalesce("root", F.concat(F.lit("form:"), F.col("form")))
    return own.groupBy(item.alias("item")).agg(F.min("handle").alias("first"), F.count("*").alias("count"))


def decision_keys() -> list[Column]:
    """A token's decision keys, most specific first."""
    return [
        F.concat_ws("|", "root", "lemma", "pos"),
        F.concat_ws("|", "root", "lemma"),
        F.col("root"),
        F.concat(F.lit("form:"), F.col("form"), F.lit("|"), F.col("lemma")),
        F.concat(F.lit("form:"), F.col("form")),
    ]


def resolve_decisions(tokens: DataFrame, table: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """Add key, english and grade: the first key of a token whose decision has an english text.

    Up to FEW decisions are broadcast and each token looks its keys up where it is. More are looked up once for each
    different (root, lemma, pos, form), which the tokens are joined with; ``forms``: these, where they are at hand.
    """
    parts = ["root", "lemma", "pos", "form"]
    known = table.filter("english is not null and english != ''").groupBy("key").agg(F.min(F.struct("english", "grade")).alias("d"))
    known = cut(known.select("key", "d.english", "d.grade"))
    keys = decision_keys()
    keys = [F.when(F.col("root").isNotNull(), k) for k in keys[:3]] + [F.when(F.col("root").isNull(), k) for k in keys[3:]]
    if known.count() <= FEW:
        out = tokens
        for i, k in enumerate(keys):
            own = known.select(F.col("key").alias(f"_key_{i}"), F.struct("key", "english", "grade").alias(f"_d_{i}"))
            out = out.join(F.broadcast(own), k == F.col(f"_key_{i}"), "left").drop(f"_key_{i}")
        first = F.coalesce(*[F.col(f"_d_{i}") for i in range(len(keys))])
        return out.select(*tokens.columns, *[first[c].alias(c) for c in ("key", "english", "grade")])
    items = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), k.alias("key")) for i, k in enumerate(keys)]), lambda s: s["key"].isNotNull())
    asked = (forms if forms is not None else tokens).select(*parts).distinct().select(*parts, F.explode(items).alias("s")).select(*parts, "s.i", "s.key")
    found = asked.join(known, "key").groupBy(*parts).agg(F.min(F.struct("i", "key", "english", "grade")).alias("d"))
    found = found.select(*[F.col(p).alias(f"_{p}") for p in parts], "d.key", "d.english", "d.grade")
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts])
    return tokens.join(found, same, "left").drop(*[f"_{p}" for p in parts])


def decision_init(tokens: DataFrame, table: DataFrame, times: Column | None = None) -> DataFrame:
    """The decision table with each key's number of tokens; new keys come with blanks. ``times``: how many tokens a row stands for."""
    keys = F.when(F.col("root").isNotNull(), F.concat_ws("|", "root", "lemma", "pos")).otherwise(F.concat(F.lit("form:"), F.col("form")))
    counts = tokens.groupBy(keys.alias("key")).agg((F.count("*") if times is None else F.sum(times)).alias("tokens"))
    return table.drop("tokens").join(counts, "key", "full_outer").withColumn("english", F.coalesce("english", F.lit(""))).withColumn("grade", F.coalesce("grade", F.lit(""))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))


def decision_coverage(resolved: DataFrame, grades: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """Tokens and verses, and those fully decided with a grade that can be rendered."""
    good = F.coalesce(F.col("english").isNotNull() & F.col("grade").isin(*grades), F.lit(False))
    by = resolved.withColumn("good", good).groupBy("segment_id").agg(F.count("*").alias("tokens"), F.count_if("good").alias("decided"))
    return by.agg(F.sum("tokens").alias("tokens"), F.sum("decided").alias("decided_tokens"), F.count("*").alias("verses"), F.count_if(F.col("tokens") == F.col("decided")).alias("decided_verses"))


def decision_grades(table: DataFrame) -> DataFrame:
    """(grade, keys): how many decisions have each grade."""
    return table.groupBy("grade").agg(F.count("*").alias("keys"))


def blocking_keys(resolved: DataFrame, k: int = 15) -> DataFrame:
    """The undecided keys that block most verses."""
    keys = F.when(F.col("root").isNotNull(), F.concat_ws("|", "root", "lemma", "pos")).otherwise(F.concat(F.lit("form:"), F.col("form")))
    open_ = resolved.filter("english is null").select("segment_id", keys.alias("key")).distinct()
    return open_.groupBy("key").agg(F.count("*").alias("verses")).orderBy(F.desc("verses"), "key").limit(k)


def assign_pages(verses: DataFrame, one_page: int = 60, per_page: int = 40) -> DataFrame:
    """Add page: a division of more than one_page verses has pages of per_page, any other has one."""
    counts = verses.groupBy("division").agg(F.count("*").alias("_n"))
    return verses.join(counts, "division").withColumn("page", F.when(F.col("_n") > one_page, F.ceil(F.col("slot") / per_page)).otherwise(F.lit(1)).cast("int")).drop("_n")


def url_inventory(tokens: DataFrame, pages: DataFrame, glosses: DataFrame, shard: int = 45_000, words: DataFrame | None = None) -> DataFrame:
    """Every addressable unit: (kind, path, priority, shard); words are sharded in corpus order.

    ``words``: the same tokens without handles, to look roots up in.
    """
    row = lambda df, kind, path, priority, at=None: df.select(F.lit(kind).alias("kind"), path.alias("path"), F.lit(priority).alias("priority"), (at if at is not None else F.lit(0)).cast("bigint").alias("shard"))
    divisions = row(pages.select("division").distinct(), "division", F.concat(F.lit("/read/"), F.col("division")), 0.9)
    later = row(pages.filter("page >= 2").select("division", "page").distinct(), "page", F.concat(F.lit("/read/"), F.col("division"), F.lit("?page="), F.col("page")), 0.5)
    verses = row(pages, "verse", F.concat(F.lit("/verse/"), F.col("division"), F.lit(":"), F.col("slot")), 0.7)
    roots = row((tokens if words is None else words).filter("root is not null").select("root").distinct(), "root", F.concat(F.lit("/root/"), F.col("root")), 0.8)
    gloss = row(glosses.filter("root_count > 1"), "gloss", F.concat(F.lit("/gloss/"), F.col("slug")), 0.6)
    every = row(tokens, "word", F.concat(F.lit("/word/"), F.col("token_id")), 0.4, F.floor(F.col("handle") / shard))
    return divisions.unionByName(later).unionByName(verses).unionByName(roots).unionByName(gloss).unionByName(every)


def export_verses(tokens: DataFrame, words: Callable[[Column], Column] | None = None) -> DataFrame:
    """(segment_id, document): a verse with its words as JSON.

    With ``words``, a function from a text to its words (an array of structs of position, word and root), ``tokens`` are
    verses (division, segment_id, text) that have words, and no word leaves its verse.
    """
    if words is not None:
        rows = tokens.select("division", "segment_id", words(F.col("text")).alias("words"))
    else:
        rows = tokens.groupBy("division", "segment_id").agg(F.array_sort(F.collect_list(F.struct("position", "word", "root"))).alias("words"))
    return rows.select("segment_id", F.to_json(F.struct("division", F.col("segment_id").alias("id"), "words")).alias("document"))


def citation_lines(tokens: DataFrame, version: str, sha: str) -> DataFrame:
    """(token_id, citation)."""
    return tokens.select("token_id", F.concat(F.lit("Corpus v"), F.lit(version), F.lit(", "), F.col("division"), F.lit(":"), F.col("slot"), F.lit(" word "), F.col("position"), F.lit(" (sha256 "), F.lit(sha), F.lit(")")).alias("citation"))


def parse_citation(c: Column) -> Column:
    """The version and sha of a citation line as a struct of nullable strings."""
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(part(r"\bv(\d+\.\d+\.\d+)").alias("version"), part(r"sha256 ([0-9a-f]+)").alias("sha"))
