"""Token search: a query is a typed tree of nodes that turns into a DataFrame of hits.

Row nodes become boolean columns, so any nesting of them is one scan; positional nodes (near,
followed_by) work on windows over hit rows alone. Nulls never match, also under not_.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators.order import running_before


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    of: tuple[Node, ...] = ()
    options: dict = field(default_factory=dict, hash=False)

    def __and__(self, other: Node) -> Node:
        return and_(self, other)

    def __or__(self, other: Node) -> Node:
        return or_(self, other)

    def __invert__(self) -> Node:
        return not_(self)


def exact(text: str) -> Node:
    return Node("exact", text)


def normalised(text: str) -> Node:
    return Node("normalised", text)


def prefix(text: str) -> Node:
    return Node("prefix", text)


def suffix(text: str) -> Node:
    return Node("suffix", text)


def pattern(text: str) -> Node:
    """A whole-form pattern: * any run, ? one character, all else itself."""
    return Node("pattern", text)


def root(text: str) -> Node:
    """A root as a slug in any case, or with or without separators."""
    return Node("root", text)


def lemma(text: str) -> Node:
    """A lemma; only if the whole corpus has no token with it, its normalised form."""
    return Node("lemma", text)


def pos(text: str) -> Node:
    return Node("pos", text)


def all_() -> Node:
    return Node("all")


def reference(text: str) -> Node:
    """``division:first-last`` or ``division:slot``."""
    if not (m := re.fullmatch(r"(\d+):(\d+)(?:-(\d+))?", text)):
        raise ValueError(f"not a reference: {text}")
    first, last = int(m[2]), int(m[3] or m[2])
    if last < first:
        raise ValueError(f"the range ends before it starts: {text}")
    return Node("reference", (int(m[1]), first, last))


def scoped(inner: Node, divisions: tuple[int, ...] = (), span: tuple[int, int, int] | None = None) -> Node:
    """Hits of a query inside divisions and a (division, first, last) range; without both, everywhere."""
    return Node("scoped", (tuple(divisions), span), (inner,))


def and_(*nodes: Node) -> Node:
    return Node("and", of=nodes)


def or_(*nodes: Node) -> Node:
    return Node("or", of=nodes)


def not_(node: Node) -> Node:
    return Node("not", of=(node,))


def near(a: Node, b: Node, distance: int, cross_segment: bool = False) -> Node:
    """Hits of either that have a hit of the other, not themselves, within a distance in tokens."""
    return Node("near", distance, (a, b), {"cross": cross_segment})


def followed_by(a: Node, b: Node) -> Node:
    """Hits of a with a hit of b right after them in the segment, and those."""
    return Node("followed_by", of=(a, b))


def fold_root(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s-]", ""))


def search_table(tokens: DataFrame, forms: dict[str, Column] | None = None) -> DataFrame:
    """Tokens with the keys that nodes compare: exact_key, form, root, root_key (folded), lemma, lemma_key, pos.

    ``forms`` gives other columns for some of them. Words without characters from U+0300 on are composed already;
    only others go through the composing function. No token is moved.
    """
    composed = F.col("word").rlike(r"^[\x{0}-\x{2FF}]*$")
    keys = {"exact_key": F.coalesce(X.nfc(F.when(~composed, F.col("word"))), F.col("word")), "root_key": fold_root(F.col("root"))}
    return tokens.withColumns(keys | (forms or {}))


def write_search_table(table: DataFrame, name: str, buckets: int = 16, region: int = 1 << 22) -> None:
    """Write a search table under a catalogue name, from one pass over it.

    A region holds ``region`` tokens that follow each other in corpus order and is a partition of the table, so a
    scope reads only its regions. Inside, tokens are bucketed by segment and sorted by handle, so windows over
    segments need no shuffle. A small table ``<name>_regions`` has each region's least and largest (division, slot),
    and the catalogue gets the table's size.
    """
    spark = table.sparkSession
    places = [F.min(F.struct("division", "slot")).alias("low"), F.max(F.struct("division", "slot")).alias("high"), F.count("*").alias("tokens")]
    keyed = table.withColumn("region", F.floor(F.col("handle") / region).cast("int"))
    dealt = keyed.repartition("region", F.pmod(F.hash("segment_id"), F.lit(buckets)))
    for old in (name, f"{name}_regions"):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
    dealt.write.partitionBy("region").bucketBy(buckets, "segment_id").sortBy("handle").format("parquet").saveAsTable(name)
    # From two columns of what was written; a row for each region.
    spark.table(name).groupBy("region").agg(*places).write.format("parquet").saveAsTable(f"{name}_regions")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")


def open_search_table(spark: SparkSession, name: str, normaliser=X.normalise) -> Search:
    """A search over a written table that reads only the regions a scope touches; there is a row of the index for each region."""
    regions = [(r["region"], tuple(r["low"]), tuple(r["high"])) for r in spark.table(f"{name}_regions").collect()]
    return Search(spark.table(name), normaliser, regions)


class Search:
    """Evaluates trees over a search table (see search_table), with a normaliser for query literals."""

    def __init__(self, table: DataFrame, normaliser=X.normalise, regions: Sequence[tuple] | None = None, words: DataFrame | None = None) -> None:
        """``regions``: (region, least and largest (division, slot)) of the parts of a written table; ``words``: the same tokens
        without what was joined to them, to look a lemma up in."""
        self.table, self.normaliser, self.regions = table, normaliser, regions
        self.words = words if words is not None else table
        self.known_lemmas: dict[str, bool] = {}

    def positional(self, node: Node) -> bool:
        return node.kind in ("near", "followed_by") or any(map(self.positional, node.of))

    def column(self, node: Node) -> Column:
        """The predicate of a tree without positional nodes, as the scan can take it: null where it isn't true, but never under not_."""
        lit = F.lit(node.value) if isinstance(node.value, str) else None
        k = node.kind
        if k == "exact":
            test = F.col("exact_key") == unicodedata.normalize("NFC", node.value) if "exact_key" in self.table.columns else F.col("word") == lit
        elif k == "normalised":
            test = F.col("form") == self.normaliser(lit)
        elif k == "prefix":
            test = F.col("form").startswith(self.normaliser(lit))
        elif k == "suffix":
            test = F.col("form").endswith(self.normaliser(lit))
        elif k == "pattern":
            parts = re.split(r"([*?])", node.value)
            made = [F.lit({"*": ".*", "?": "."}[p]) if p in "*?" else F.concat(F.lit("\\Q"), self.normaliser(F.lit(p)), F.lit("\\E")) for p in parts if p]
            test = F.rlike(F.col("form"), F.concat(F.lit("(?s)^"), *made, F.lit("$")))
            if parts[0]:  # What comes before the first wildcard reaches the scan.
                test = F.col("form").startswith(self.normaliser(F.lit(parts[0]))) & test
        elif k == "root":
            key = F.col("root_key") if "root_key" in self.table.columns else fold_root(F.col("root"))
            test = key == fold_root(lit)
        elif k == "lemma":
            hit = F.col("lemma") == lit
            test = hit if self._lemma_known(node.value) else F.col("lemma_key" if "lemma_key" in self.table.columns else "lemma") == self.normaliser(lit)
        elif k == "pos":
            test = F.col("pos") == lit
        elif k == "all":
            test = F.lit(True)
        elif k == "reference":
            test = self._within((node.value[0],), node.value) & (F.col("division") == node.value[0]) & F.col("slot").between(*node.value[1:])
        elif k == "scoped":
            test = self.column(node.of[0]) & self._scope(node)
        elif k == "and":
            test = reduce(lambda a, b: a & b, map(self.column, node.of)) if node.of else F.lit(False)
        elif k == "or":
            test = reduce(lambda a, b: a | b, map(self.column, node.of), F.lit(False))
        elif k == "not":
            test = ~self.truth(node.of[0])
        else:
            raise ValueError(f"{k} is not a row predicate")
        return test

    def truth(self, node: Node) -> Column:
        """The same, false where it isn't true."""
        return F.coalesce(self.column(node), F.lit(False))

    def _lemma_known(self, value: str) -> bool:
        if value in self.known_lemmas:
            return self.known_lemmas[value]
        return not self.words.filter(F.col("lemma") == value).limit(1).isEmpty()

    def _within(self, divisions: Sequence[int], span: tuple[int, int, int] | None) -> Column:
        """The regions that can hold tokens of a scope, as a test on the partition column; true without an index."""
        if self.regions is None or not (divisions or span):
            return F.lit(True)
        asked = [((d,), (d, float("inf"))) for d in divisions] if divisions else None
        spans = [(span[:2], (span[0], span[2]))] if span else None
        meets = lambda low, high, some: some is None or any(a <= high and low <= b for a, b in some)
        return F.col("region").isin(*[r for r, low, high in self.regions if meets(low, high, asked) and meets(low, high, spans)])

    def _scope(self, node: Node) -> Column:
        divisions, span = node.value
        test = self._within(divisions, span)
        if divisions:
            test = test & F.col("division").isin(*divisions)
        if span:
            formula = F.col("is_formula") if "is_formula" in self.table.columns else F.lit(False)
            test = test & (F.col("division") == span[0]) & F.col("slot").between(*span[1:]) & ~formula
        return test

    def hits(self, node: Node) -> DataFrame:
        """The tokens that match."""
        if not self.positional(node):
            return self.table.filter(self.column(node))
        if node.kind == "near":
            return self._near(node)
        if node.kind == "followed_by":
            return self._followed_by(node)
        if node.kind == "scoped":
            return self.hits(node.of[0]).filter(self._scope(node))
        if node.kind == "or":
            return reduce(DataFrame.unionByName, map(self.hits, node.of)).dropDuplicates(["handle"])
        if node.kind == "not":
            return self.table.join(self.hits(node.of[0]).select("handle"), "handle", "left_anti")
        if node.kind == "and":
            wanted = [n for n in node.of if n.kind != "not"] or [all_()]
            rows = [n for n in wanted if not self.positional(n)]
            out = self.table.filter(self.column(and_(*rows))) if rows else None
            for n in wanted:
                if self.positional(n):
                    found = self.hits(n)
                    out = found if out is None else out.join(found.select("handle"), "handle", "left_semi")
            for n in node.of:
                if n.kind == "not":
                    out = out.filter(self.column(n)) if not self.positional(n) else out.join(self.hits(n.of[0]).select("handle"), "handle", "left_anti")
            return out
        raise ValueError(node.kind)

    def _flagged(self, node: Node) -> DataFrame:
        """Rows in the hits of either operand, with in_a and in_b."""
        a, b = node.of
        if not self.positional(a) and not self.positional(b):
            return self.table.filter(self.column(a) | self.column(b)).withColumn("in_a", self.truth(a)).withColumn("in_b", self.truth(b))
        marks = self.hits(a).select("handle", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(self.hits(b).select("handle", F.lit(0).alias("x"), F.lit(1).alias("y")))
        marks = marks.groupBy("handle").agg((F.max("x") == 1).alias("in_a"), (F.max("y") == 1).alias("in_b"))
        return self.table.join(marks, "handle")

    def _near(self, node: Node) -> DataFrame:
        d, rows = node.value, self._flagged(node)
        if not node.options["cross"]:
            band = W.partitionBy("segment_id").orderBy("handle").rangeBetween(-d, d)
            others = lambda flag: F.sum(F.col(flag).cast("int")).over(band) - F.col(flag).cast("int")
            return rows.withColumns({"_b": others("in_b"), "_a": others("in_a")}).filter((F.col("in_a") & (F.col("_b") > 0)) | (F.col("in_b") & (F.col("_a") > 0))).drop("_a", "_b", "in_a", "in_b")
        blocks, near_by = _blocks(rows, d), lambda flag, band: F.sum(F.col(flag).cast("int")).over(band) - F.col(flag).cast("int")
        band = W.partitionBy("_block").orderBy("handle").rangeBetween(-d, d)
        found = blocks.withColumns({"_b": near_by("in_b", band), "_a": near_by("in_a", band)}).filter("_home")
        return found.filter((F.col("in_a") & (F.col("_b") > 0)) | (F.col("in_b") & (F.col("_a") > 0))).drop("_a", "_b", "in_a", "in_b", "_block", "_home")

    def _followed_by(self, node: Node) -> DataFrame:
        rows = self._flagged(node)
        order = W.partitionBy("segment_id").orderBy("position")
        after = F.lead(F.when(F.col("in_b"), F.col("position"))).over(order) == F.col("position") + 1
        before = F.lag(F.when(F.col("in_a"), F.col("position"))).over(order) == F.col("position") - 1
        test = (F.col("in_a") & F.coalesce(after, F.lit(False))) | (F.col("in_b") & F.coalesce(before, F.lit(False)))
        return rows.withColumn("_hit", test).filter("_hit").drop("_hit", "in_a", "in_b")

    def search(self, node: Node, include_formula: bool = True) -> DataFrame:
        """Hits in corpus order; formula tokens are left out after evaluation if asked for."""
        found = self.hits(node)
        return (found if include_formula else found.filter(~F.col("is_formula"))).orderBy("handle")

    def segments(self, node: Node, include_formula: bool = True) -> DataFrame:
        """Distinct segments of the hits with their first handle and number of hits, in corpus order."""
        found = self.hits(node)
        found = found if include_formula else found.filter(~F.col("is_formula"))
        return found.groupBy("segment_id").agg(F.min("handle").alias("first_handle"), F.count("*").alias("hits")).orderBy("first_handle")

    def page(self, node: Node, page: int = 1, per_page: int = 50) -> DataFrame:
        """One page of hits in corpus order; per_page is held to 1..500, a page past the end is empty.

        Hits are numbered by running sums over ranges, so those before the page don't meet in one place.
        """
        size, number = min(500, max(1, per_page)), max(1, page)
        numbered = running_before(self.hits(node), "handle", F.lit(1), "_nth")
        return numbered.filter(F.col("_nth").between((number - 1) * size, number * size - 1)).drop("_nth").orderBy("handle")

    def count_queries(self, queries: dict[str, Node]) -> DataFrame:
        """(query_id, ok, total) of many saved queries, mixed as they come, from one scan of the table.

        Subtrees that trees share are evaluated once. Each maximal subtree of row predicates is a bit of a few
        long columns; positional nodes become bits of later columns, level by level: those inside segments
        by one window over all of a level's trees, those across segments by one over blocks of handles. A tree that can't be
        evaluated (an unknown kind, a value that isn't one) is not ok and has no total; it doesn't harm the others.
        """
        return Batch(self).counts(queries)


#: Tokens in a block of handles, at least.
BLOCK = 1 << 14
#: Flags in a long column.
BITS = 62


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows dealt to blocks of handles (_block), those within d of an edge also to the block beyond it (_home is false there)."""
    size = max(BLOCK, d)
    home, inside = F.floor(F.col("handle") / size), F.col("handle") % size
    where = F.array(F.struct(home.alias("b"), F.lit(True).alias("h")), F.when(inside < d, F.struct((home - 1).alias("b"), F.lit(False).alias("h"))), F.when(inside >= size - d, F.struct((home + 1).alias("b"), F.lit(False).alias("h"))))
    dealt = rows.withColumn("_at", F.explode(F.filter(where, lambda x: x.isNotNull())))
    return dealt.withColumn("_block", F.col("_at.b")).withColumn("_home", F.col("_at.h")).drop("_at")


class Batch:
    """Evaluates many trees at once; see Search.count_queries."""

    def __init__(self, search: Search) -> None:
        self.search = search
        #: Column of each subtree that has a bit, in the frame at hand.
        self.bits: dict[Node, Column] = {}

    def depth(self, node: Node) -> int:
        below = max(map(self.depth, node.of), default=0)
        return below + 1 if node.kind in ("near", "followed_by") else below

    def walk(self, node: Node):
        for inner in node.of:
            yield from self.walk(inner)
        yield node

    def flag(self, node: Node) -> Column:
        """A subtree's truth from bits."""
        if node in self.bits:
            return self.bits[node]
        own = [self.flag(n) for n in node.of]
        if node.kind == "and":
            return reduce(lambda a, b: a & b, own)
        if node.kind == "or":
            return reduce(lambda a, b: a | b, own)
        if node.kind == "not":
            return ~own[0]
        return own[0] & self.bits[Node("scoped", node.value, (all_(),))]

    def may(self, node: Node) -> Column | None:
        """Whether a row can be a hit of a tree, from row predicates alone; None if any row can."""
        if node.kind == "not" and self.search.positional(node):
            return None
        if node in self.bits or not self.search.positional(node):
            return self.flag(node)
        own = [self.may(n) for n in node.of]
        if node.kind in ("and", "scoped"):
            known = [c for c in own if c is not None]
            return reduce(lambda a, b: a & b, known) if known else None
        return None if any(c is None for c in own) else reduce(lambda a, b: a | b, own)

    def apart(self, df: DataFrame, placed: list[Node]) -> DataFrame:
        """Rows with _times: those that no positional node can hit are counted by their bits, without a place.

        Such a row is in neither operand of any node, so windows over the others come out the same without it. A
        written table keeps its rows: they lie by segments already.
        """
        ways = [self.may(n) for n in placed]
        if not placed or self.search.regions is not None or any(w is None for w in ways):
            return df.withColumn("_times", F.lit(1).cast("bigint"))
        at = reduce(lambda a, b: a | b, ways)
        own = [F.when(at, F.col(c)).alias(c) for c in ("handle", "segment_id")]
        return df.groupBy(*own, *[c for c in df.columns if c not in ("handle", "segment_id")]).agg(F.count("*").alias("_times"))

    def pack(self, df: DataFrame, tests: dict[Node, Column], name: str) -> DataFrame:
        """Add the tests as bits of long columns."""
        nodes, columns = list(tests), {}
        for k in range(0, len(nodes), BITS):
            some = nodes[k : k + BITS]
            columns[f"{name}_{k // BITS}"] = reduce(lambda a, b: a.bitwiseOR(b), [F.when(tests[n], F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, n in enumerate(some)])
            self.bits |= {n: F.col(f"{name}_{k // BITS}").bitwiseAND(F.lit(1 << i)) != 0 for i, n in enumerate(some)}
        return df.withColumns(columns)

    def atoms(self, node: Node):
        """The maximal subtrees without positional nodes, and the scopes around the others."""
        if not self.search.positional(node):
            yield node
            return
        if node.kind == "scoped":
            yield Node("scoped", node.value, (all_(),))
        for inner in node.of:
            yield from self.atoms(inner)

    def counts(self, queries: dict[str, Node]) -> DataFrame:
        table = self.search.table
        lemmas = sorted({n.value for q in queries.values() for n in self.walk(q) if n.kind == "lemma" and isinstance(n.value, str)})
        self.search.known_lemmas = {r[0]: True for r in self.search.words.filter(F.col("lemma").isin(lemmas)).select("lemma").distinct().collect()} if lemmas else {}
        self.search.known_lemmas |= {x: x in self.search.known_lemmas for x in lemmas}
        good: dict[str, Node] = {}
        tests: dict[Node, Column] = {}
        for key, tree in queries.items():
            try:
                made = {n: self.search.truth(n) for n in self.atoms(tree)}
                for n in self.walk(tree):
                    if n.kind == "near" and not (isinstance(n.value, int) and n.value >= 0):
                        raise ValueError(f"not a distance: {n.value}")
                    if self.search.positional(n) and len(n.of) != {"near": 2, "followed_by": 2, "not": 1, "scoped": 1}.get(n.kind, len(n.of)):
                        raise ValueError(f"{n.kind} of {len(n.of)}")
            except (ValueError, TypeError, AttributeError, IndexError, re.error):
                continue
            good[key] = tree
            tests |= made
        df = self.pack(table.select("handle", "segment_id", *[c for c in table.columns if c not in ("handle", "segment_id")]), tests, "_row").select("handle", "segment_id", *[f"_row_{k}" for k in range(-(-len(tests) // BITS))])
        placed: dict[Node, None] = dict.fromkeys(n for q in good.values() for n in self.walk(q) if n.kind in ("near", "followed_by"))
        df = self.apart(df, list(placed))
        for level in range(1, max(map(self.depth, placed), default=0) + 1):
            own = [n for n in placed if self.depth(n) == level]
            across = [n for n in own if n.kind == "near" and n.options["cross"]]
            if across:
                df = self.across(df, across, level)
            if inside := [n for n in own if n not in across]:
                df = self.inside(df, inside, level)
        totals = [F.coalesce(F.sum(F.when(self.flag(q), F.col("_times"))), F.lit(0)) for q in good.values()]
        rows = [F.struct(F.lit(k).alias("query_id"), F.lit(True).alias("ok"), F.col(f"_t{i}").alias("total")) for i, k in enumerate(good)]
        rows += [F.struct(F.lit(k).alias("query_id"), F.lit(False).alias("ok"), F.lit(None).cast("bigint").alias("total")) for k in queries if k not in good]
        one = df.agg(F.count("*").alias("_n"), *[t.alias(f"_t{i}") for i, t in enumerate(totals)])
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    def _banded(self, nodes: list[Node], order) -> dict[Node, Column]:
        tests = {}
        for n in nodes:
            a, b = map(self.flag, n.of)
            if n.kind == "near":
                band = order.rangeBetween(-n.value, n.value)
                more = lambda x, band=band: F.sum(x.cast("int")).over(band) - x.cast("int") > 0
                tests[n] = (a & more(b)) | (b & more(a))
            else:
                here = F.col("handle")
                after, before = F.lead(F.when(b, here)).over(order) == here + 1, F.lag(F.when(a, here)).over(order) == here - 1
                tests[n] = (a & F.coalesce(after, F.lit(False))) | (b & F.coalesce(before, F.lit(False)))
        return tests

    def inside(self, df: DataFrame, nodes: list[Node], level: int) -> DataFrame:
        return self.pack(df, self._banded(nodes, W.partitionBy("segment_id").orderBy("handle")), f"_in{level}")

    def across(self, df: DataFrame, nodes: list[Node], level: int) -> DataFrame:
        blocks = _blocks(df, max(n.value for n in nodes))
        out = self.pack(blocks, self._banded(nodes, W.partitionBy("_block").orderBy("handle")), f"_over{level}")
        return out.filter("_home").drop("_block", "_home")


PARAMS = ["text", "corpus", "numbering", "formula", "cross_segment", "strict", "profile"]


def with_params(hits: DataFrame, **params: str) -> DataFrame:
    """Add params, a stable line of the parameters that made a result."""
    return hits.withColumn("params", F.lit(";".join(f"{k}={params.get(k, '')}" for k in PARAMS)))


def parse_params(c: Column) -> Column:
    """The parameters of a line as a map; null if a name is missing or unknown, or comes twice."""
    pairs = F.split(c, ";")
    names = F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    good = F.array_sort(names) == F.array_sort(F.array(*[F.lit(p) for p in PARAMS]))
    return F.when(good, F.map_from_arrays(names, F.transform(pairs, lambda p: F.regexp_replace(p, "^[^=]*=", ""))))


def _first(keyed: DataFrame, first: int) -> DataFrame:
    """The first candidates of each (kind, prefix) in the order of value, with their place."""
    place = F.row_number().over(W.partitionBy("kind", "prefix").orderBy("value"))
    return keyed.select("kind", "prefix", "value", "count").withColumn("place", place).filter(F.col("place") <= first)


#: Code points of the longest prefix in a table of completions; longer ones are looked up in the vocabulary.
LONGEST = 64


def completions(vocabulary: DataFrame, first: int = 32) -> DataFrame:
    """A trie as a table: (kind, prefix, value, count, place), for each prefix of a value its first candidates.

    ``vocabulary``: kind, value (not null, once a kind), count. Empty values have no prefix. Each task keeps ``first``
    candidates of a node before they are shuffled, so a node that a large part of the vocabulary shares is no hot key.
    """
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("value"), F.lit(LONGEST))), lambda n: F.left("value", n)))
    return _first(vocabulary.filter("value <> ''").select("kind", "value", "count", prefix.alias("prefix")), first)


def add_completions(table: DataFrame, more: DataFrame, first: int = 32) -> DataFrame:
    """A table of completions after vocabulary was added, from the table and the completions of what is new.

    Values only ever push others out, so a node's first candidates are among those of both; counts add up.
    """
    both = table.unionByName(more).groupBy("kind", "prefix", "value").agg(F.sum("count").alias("count"))
    return _first(both, first)


def suggest(typed: DataFrame, table: DataFrame, names: DataFrame, vocabulary: DataFrame, first: int = 32, most: int = 8) -> DataFrame:
    """Completions of typed prefixes: (prefix, kind, value, count, rank).

    ``table`` comes from completions over ``vocabulary`` (of kinds form and root), ``names`` has number and value. Of
    each kind the first candidates in the order of value are ranked by count; names that begin with the prefix come
    before those that contain it. Three names, three roots and the best forms make up ``most``. Prefixes longer than
    the table's meet the vocabulary by its beginning; names are found by parts of up to LONGEST characters.
    """
    q = typed.select("prefix").filter("prefix <> ''").distinct()
    short, long = q.filter(F.length("prefix") <= LONGEST), q.filter(F.length("prefix") > LONGEST)
    begins = vocabulary.filter(F.length("value") > LONGEST).withColumn("_start", F.left("value", F.lit(LONGEST)))
    met = long.withColumn("_start", F.left("prefix", F.lit(LONGEST))).join(begins, "_start").filter(F.col("value").startswith(F.col("prefix")))
    found = table.join(short, "prefix").select("kind", "prefix", "value", "count").unionByName(_first(met, first).drop("place"))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("kind", "prefix").orderBy(F.desc("count"), "value")))
    ranked = ranked.filter((F.col("kind") == "form") | (F.col("r") <= 3)).withColumn("k", F.when(F.col("kind") == "root", 1).otherwise(2))
    length = F.length("value")
    inside = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), F.least(length - i + 1, F.lit(LONGEST))), lambda n: F.lower("value").substr(i, n))))
    parts = names.filter("value <> ''").withColumn("prefix", F.explode(F.array_distinct(inside))).join(q, "prefix")
    order = W.partitionBy("prefix").orderBy(F.when(F.lower("value").startswith(F.col("prefix")), 0).otherwise(1), "number")
    named = parts.withColumn("r", F.row_number().over(order)).filter("r <= 3").select(F.lit("name").alias("kind"), "prefix", "value", F.lit(None).cast("bigint").alias("count"), "r", F.lit(0).alias("k"))
    out = named.unionByName(ranked).withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy("k", "r"))).filter(F.col("rank") <= most)
    return out.select("prefix", "kind", "value", "count", "rank")
