"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only by the whole number m, so documents of equal m form a
stratum, and in a stratum a posting's impact depends on its tf alone. The index keeps, for each stratum,
each term's documents by tf; an impact is computed once for each (stratum, tf). A stratum's bound for an item
is what a document would score that had each of the item's terms as often as any of the stratum does.

Large strata are cut into parts of PART documents, so no task gets more of one than that. Visits go by bounds: an
item first visits the parts with its highest bounds, whose k-th best score is its threshold, and then
all others whose bounds reach that. What is passed over can't be among the k best, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import cut, few, map_arrow

#: Documents in a part of a stratum.
PART = 2048
#: Parts that each item visits to set its threshold.
FIRST = 2
#: (item, term) pairs that are answered in one pass over the documents; the driver and each task hold that many.
PASS_TERMS = 400_000
#: Items scored at once in a task, and scores that are summed at once.
ITEMS, SUMS = 512, 4_000_000
#: A-Z are lower-cased; of ASCII only letters and digits belong to terms, of all else every byte.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or b"").translate(FOLD).split()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers each, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Wanted:
    """The items of one pass: for each term (numbered from 0) its items and their weights, w times repeats."""

    def __init__(self, items: list[Counter], weight: np.ndarray, number: dict[bytes, int]) -> None:
        pairs = np.array([(number[t], q, weight[number[t]] * c) for q, item in enumerate(items) for t, c in item.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.n = len(items)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1))
        self.item, self.weight = pairs[:, 1], pairs[:, 2]

    def only(self, kept: np.ndarray) -> Wanted:
        """The same for some items, which are numbered anew."""
        out = object.__new__(Wanted)
        stays = kept[self.item]
        out.n = int(kept.sum())
        out.starts = np.concatenate(([0], np.cumsum(stays)))[self.starts]
        out.item, out.weight = (np.cumsum(kept) - 1)[self.item[stays]], self.weight[stays]
        return out

    def sums(self, terms: np.ndarray, impacts: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
        """scores[item, doc] over postings (term, impact, doc), SUMS products at a time."""
        scores = np.zeros(self.n * n_docs, np.int64)
        counts = self.starts[terms + 1] - self.starts[terms]
        steps = np.searchsorted(np.cumsum(counts), np.arange(SUMS, int(counts.sum()) + SUMS, SUMS), side="right")
        for a, b in zip([0, *steps[:-1]], steps, strict=True):
            # A single posting of a term that more than SUMS items ask for goes alone.
            for x, y in ([(a, b)] if b > a else []) + ([(b, b + 1)] if b == a and b < len(terms) else []):
                at = ragged(self.starts[terms[x:y]], counts[x:y])
                np.add.at(scores, self.item[at] * n_docs + np.repeat(docs[x:y], counts[x:y]), self.weight[at] * np.repeat(impacts[x:y], counts[x:y]))
        return scores.reshape(self.n, n_docs)


def tokenised(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms, with repeats) and the numbers and tf of the terms asked for, for each document."""
    known = docs.sparkSession.sparkContext.broadcast({t: k + 1 for t, k in number.items()})
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get, size = known.value.get, len(known.value) + 1
        n, flat = [], []
        for text in batch.column(1).to_pylist():
            words = terms_of(text)
            n.append(len(words))
            flat.append(np.fromiter(filter(None, map(get, words)), np.int64))
        owner = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
        keys, tf = np.unique(owner * size + np.concatenate(flat) if flat else np.zeros(0, np.int64), return_counts=True)
        lengths = np.bincount(keys // size, minlength=len(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists(keys % size - 1, lengths, pa.int32()), lists(tf, lengths, pa.int32())], ["doc_id", "n", "terms", "tf"])

    return map_arrow(rows, run, "doc_id bigint, n bigint, terms array<int>, tf array<int>", rows=256)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """In how many documents each numbered term is; tasks send their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def stratified(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: a row for each part of a stratum with m, part, docs and postings.

    A run is a (term, tf) of the part, in that order; its documents are the places in docs that ``at``
    lists up to the run's end. Rows come from a cut table, so that numbering them is repeatable.
    """
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    held = rows.filter(F.size("terms") > 0).withColumn("m", m).withColumn("_row", F.monotonically_increasing_id())
    strata = few(held.groupBy("m").agg(F.ceil(F.count("*") / PART).alias("_parts")))
    placed = held.join(strata, "m").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    dealt = placed.select("m", "part", "doc_id", "terms", "tf").repartition("m", "part").sortWithinPartitions("m", "part")

    def packed(m: int, part: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        terms, tf = (whole.column(k).combine_chunks() for k in (3, 4))
        lengths = np.diff(terms.offsets.to_numpy())
        term, times, doc = terms.flatten().to_numpy(), tf.flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((doc, times, term))
        term, times = term[order], times[order]
        ends = np.concatenate((np.flatnonzero((np.diff(term) != 0) | (np.diff(times) != 0)) + 1, [len(term)]))
        one = lambda values, kind: lists(values, [len(values)], kind)
        ids = whole.column(2).combine_chunks()
        made = [pa.array([m], pa.int64()), pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(term[ends - 1], pa.int32()), one(times[ends - 1], pa.int32()), one(ends, pa.int32()), one(doc[order], pa.int32())]
        return pa.RecordBatch.from_arrays(made, ["m", "part", "docs", "terms", "tf", "ends", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            m, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds = [0, *(np.flatnonzero((np.diff(m) != 0) | (np.diff(part) != 0)) + 1), len(m)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b == a:
                    continue
                if held and key != (m[a], part[a]):
                    yield packed(*key, held)
                    held = []
                key = (m[a], part[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(*key, held)

    return dealt.mapInArrow(run, "m bigint, part int, docs array<bigint>, terms array<int>, tf array<int>, ends array<int>, at array<int>")


def _part(batch: pa.RecordBatch, k: int) -> tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """m, docs, and each run's term, impact, number of documents, and all runs' documents, of a row of the index."""
    docs, terms, tf, ends, at = (batch.column(c)[k].values for c in range(2, 7))
    m = batch.column(0)[k].as_py()
    return m, docs, terms.to_numpy(), impact(tf.to_numpy(), m), np.diff(ends.to_numpy(), prepend=0), at.to_numpy()


def _bounds(wanted: Wanted, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Each item's bound: the impacts of each term's highest tf, which is its last run."""
    last = np.append(np.flatnonzero(np.diff(terms)), len(terms) - 1)
    return wanted.sums(terms[last], impacts[last], np.zeros(len(last), np.int64), 1)[:, 0]


def best_of_parts(index: DataFrame, wanted, least, k: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents of each part, for items whose bound there reaches their least score; both are broadcast."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, floor = wanted.value, least.value
        found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        for row in range(batch.num_rows):
            _, docs, terms, impacts, n, at = _part(batch, row)
            reach = _bounds(w, terms, impacts) >= floor
            items = np.flatnonzero(reach)
            ids = np.where(docs.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, docs.fill_null(0).to_numpy())
            each_term, each_impact = np.repeat(terms, n), np.repeat(impacts, n)
            for first in range(0, len(items), ITEMS):
                some = items[first : first + ITEMS]
                kept = np.zeros(w.n, bool)
                kept[some] = True
                scores = (w if len(some) == w.n else w.only(kept)).sums(each_term, each_impact, at, len(docs))
                good = scores >= floor[some][:, None]
                for q in np.flatnonzero(good.any(axis=1)):
                    doc = np.flatnonzero(good[q])
                    if len(doc) > k:
                        value = scores[q, doc]
                        doc = doc[value >= np.partition(value, len(doc) - k)[len(doc) - k]]
                        doc = doc[np.lexsort((ids[doc], -scores[q, doc]))[:k]]
                    found.append((np.full(len(doc), some[q]), docs.take(pa.array(doc)), scores[q, doc]))
        if not found:
            return None
        item, doc, score = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(item), pa.int32()), pa.concat_arrays(doc), pa.array(np.concatenate(score), pa.int64())], ["item", "doc_id", "score"])

    return map_arrow(index, run, "item int, doc_id bigint, score bigint", rows=16)


def first_parts(index: DataFrame, wanted) -> DataFrame:
    """(m, part) of the FIRST parts with the highest bounds of each item, whatever else is in them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = wanted.value
        rows = [(r, q, b) for r in range(batch.num_rows) for q, b in enumerate(_bounds(w, *_part(batch, r)[2:4]).tolist()) if b > 0]
        r, q, b = (np.array([x[i] for x in rows], np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r)), pa.array(q, pa.int32()), pa.array(b, pa.int64())], ["m", "part", "item", "bound"])

    bounds = map_arrow(index, run, "m bigint, part int, item int, bound bigint", rows=64)
    ranked = bounds.withColumn("_r", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "m", "part")))
    return ranked.filter(F.col("_r") <= FIRST).select("m", "part").distinct()


def ranks(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; Spark keeps k rows of an item in each task before it shuffles."""
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _passes(items: DataFrame) -> Iterator[list[Row]]:
    """Distinct items with their terms, dealt to passes of about PASS_TERMS (item, term) pairs."""
    own = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counted = [Counter(terms_of(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        made = [batch.column(0), pa.array([list(c) for c in counted], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32())), batch.column(2)]
        return pa.RecordBatch.from_arrays(made, ["item_id", "terms", "times", "hash"])

    kind = items.schema["item_id"].dataType.simpleString()
    coded = cut(map_arrow(own.withColumn("hash", F.xxhash64("item_id", "text")), run, f"item_id {kind}, terms array<binary>, times array<int>, hash bigint"))
    n = max(1, math.ceil((coded.agg(F.sum(F.size("terms"))).first()[0] or 0) / PASS_TERMS))
    for k in range(n):
        if got := coded.filter((F.pmod("hash", F.lit(n)) == k) & (F.size("terms") > 0)).collect():
            yield got


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents for each item: item_id, rank (from 1), doc_id, score.

    A null or empty document has no terms and is never found; a null or empty item finds nothing. Equal scores go
    by ascending doc_id, null first. Repeated documents are ranked each; repeated rows of an item are one item, and
    different texts under one item_id are ranked apart. Texts are read whole. Other columns, whatever their
    names, are not read. Without documents or items the result is empty. Items are answered in passes over
    the documents, so that what the driver and the tasks hold of them is bounded.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = items.schema["item_id"].dataType.simpleString()
    answers, totals = [], None
    for rows in _passes(items):
        wants = [Counter(dict(zip(map(bytes, r["terms"]), r["times"], strict=True))) for r in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*wants)))}
        coded = cut(tokenised(docs, number))
        if totals is None:
            totals = coded.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs, n_terms = totals
        df = frequencies(coded, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        wanted = sc.broadcast(Wanted(wants, weight, number))
        index = cut(stratified(coded, n_docs, n_terms))
        start = ranks(best_of_parts(index.join(F.broadcast(first_parts(index, wanted)), ["m", "part"], "left_semi").select(*index.columns), wanted, sc.broadcast(np.ones(len(rows), np.int64)), k), k)
        least = np.ones(len(rows), np.int64)
        for r in start.filter(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
        found = ranks(best_of_parts(index, wanted, sc.broadcast(least), k), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        answers.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not answers:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
