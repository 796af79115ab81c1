"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words. A distributed randomised SVD of the TF-IDF rows of all documents' windows
gives a latent space, in which a document's windows are compared with benchmark passages by cosine. Candidates are verified by
the longest common subsequence of words and by a check of the item's answer, so that reworded copies are
found too. Windows are left out of the comparison only if they can't be accepted: with m words of an
item's n asked for at least, the words around a window must hold NEED of its n - m + NEED rarest ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import map_arrow, with_text, written

WORD = re.compile(r"\w+")
#: Latent dimensions and power iterations over all documents.
RANK, ITERATIONS = 64, 2
#: Words whose windows are multiplied at a time, and vectors that are summed at a time; they bound memory, not what is read.
WORDS, VECTORS = 600_000, 65_536
#: How many of an item's rarest words must be near a window; any number loses nothing.
NEED = 4
#: Benchmark items whose terms are broadcast at a time; more items are taken in blocks.
BLOCK = 20_000
#: Least cosine of a candidate; least share of an item's words in order; the share that is enough with the answer's.
COSINE, SHARE, SHARE_WITH_ANSWER, ANSWER = 0.45, 0.7, 0.55, 0.8


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """The words after ``answer:``, else those of the last sentence."""
    if m := re.search(r"(?i)answer\s*:\s*(.+)", text, re.S):
        return words_of(m[1])
    return words_of(next((s for s in reversed(re.split(r"[.!?]\s+|\n", text.strip())) if words_of(s)), ""))


def common(pattern: Sequence[Hashable], words: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, a bit for each word of the pattern."""
    return common_by(masks_of(pattern), len(pattern), words)


def masks_of(pattern: Sequence[Hashable]) -> dict[Hashable, int]:
    masks: dict[Hashable, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_by(masks: dict[Hashable, int], n: int, words: Sequence[Hashable]) -> int:
    every = (1 << n) - 1
    row = every
    for m in filter(None, map(masks.get, words)):
        hit = row & m
        row = ((row + hit) | (row - hit)) & every
    return n - row.bit_count()


@dataclass
class Index:
    """A block of items: their words, terms with weights, and passages in the latent space."""

    ids: list[int]
    words: list[list[str]]
    answers: list[list[str]]
    terms: dict[str, int]
    window: int
    idf: np.ndarray
    space: np.ndarray
    parts: list[np.ndarray]
    owner: np.ndarray
    passages: np.ndarray
    #: Of each term, where the items that have it among their rarest words begin and how many there are; the items.
    first: np.ndarray
    count: np.ndarray
    listed: np.ndarray
    #: Of each item: words asked for at least, rare words asked for near a window, words, masks by term, terms of the answer, passages.
    least: np.ndarray
    need: np.ndarray
    length: np.ndarray
    masks: list[dict[Hashable, int]]
    asked: list[list[int]]
    owned: list[np.ndarray]

    def term_ids(self, words: list[str]) -> np.ndarray:
        """Term of each word; the last one stands for all others and has no weight."""
        get, none = self.terms.get, len(self.terms)
        return np.fromiter((get(w, none) for w in words), np.int32, len(words))

    def list_terms(self) -> None:
        """Fill the lists of items by their rarest terms."""
        self.length = np.array([len(w) for w in self.words])
        self.least = np.array([next(m for m in range(1, n + 1) if m / n >= SHARE_WITH_ANSWER) for n in self.length])
        self.need = np.minimum(self.least, NEED)
        pairs = []
        for k, words in enumerate(self.words):
            ids = self.term_ids(words)
            rarest = ids[np.lexsort((ids, -self.idf[ids]))][: self.length[k] - self.least[k] + self.need[k]]
            pairs += [(int(t), k) for t in np.unique(rarest)]
        pairs.sort()
        self.count = np.bincount([t for t, _ in pairs], minlength=len(self.terms) + 1)
        self.first = np.cumsum(self.count) - self.count
        self.listed = np.array([k for _, k in pairs], np.int64)
        self.masks = [masks_of(self.term_ids(w).tolist()) for w in self.words]
        self.asked = [self.term_ids(a).tolist() for a in self.answers]
        self.owned = [np.flatnonzero(self.owner == k) for k in range(len(self.words))]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first start, end of starts) of all windows that can be accepted.

        What is compared with an item of n words is the window and n words on both sides. Of the item's
        multiset of words it must hold ``least``, and all but least - need of those can be among the
        words that aren't listed, so that ``need`` of its places have listed terms.
        """
        at = np.flatnonzero(self.count[ids])
        if not len(at):
            return []
        many = self.count[ids[at]]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item = self.listed[np.repeat(self.first[ids[at]], many) + within]
        key = np.sort(item * len(ids) + np.repeat(at, many))
        item, place = np.divmod(key, len(ids))
        last = np.arange(len(key)) + self.need[item] - 1
        inside = np.minimum(last, len(key) - 1)
        good = np.flatnonzero((last < len(key)) & (item[inside] == item) & (place[inside] - place < self.window + 2 * self.length[item]))
        out: list[tuple[int, int, int]] = []
        for k, p, q in zip(item[good].tolist(), place[good].tolist(), place[inside[good]].tolist(), strict=True):
            n = int(self.length[k])
            low, high = max(0, q - self.window - n + 1), min(len(ids), p + n + 1)
            if out and out[-1][0] == k and low <= out[-1][2]:
                out[-1] = (k, out[-1][1], max(high, out[-1][2]))
            else:
                out.append((k, low, high))
        return out


def latent(index: Index, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unit vectors of windows in the latent space."""
    sums = np.concatenate((np.zeros((1, index.space.shape[1])), np.cumsum((index.space * index.idf[:, None])[ids], 0)))
    out = sums[end] - sums[start]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def matches(index: Index, text: str | None) -> list[tuple[int, float, float]]:
    """(item id, cosine, share of the item's words in order) of the items that a text holds."""
    return matches_of(index, index.term_ids(words_of(text)))


def matches_of(index: Index, ids: np.ndarray) -> list[tuple[int, float, float]]:
    """The matches of a text by the terms of its words; words of no item are all alike, since none is asked for."""
    words = ids.tolist()
    best: dict[int, tuple[float, float]] = {}
    # Windows as rows of words, the last ones filled up with words without weight.
    padded = np.append(ids, np.full(index.window, len(index.terms), np.int32))
    for item, low, high in index.spans(ids):
        n, masks, least = int(index.length[item]), index.masks[item], int(index.least[item])
        around = lambda a, b, n=n: words[max(0, a - n) : b + index.window + n]
        # Starts in runs: no window has more in common with the item than the words around its run.
        runs = [(a, min(a + index.window, high)) for a in range(low, high, index.window)]
        bound = {r: common_by(masks, n, around(r[0], r[1] - 1)) for r in runs}
        if not (start := np.array([x for r in runs if bound[r] >= least for x in range(*r)], np.int64)).size:
            continue
        rows = padded[start[:, None] + np.arange(index.window)[None, :]]
        vectors = (index.space[rows] * index.idf[rows][:, :, None]).sum(1)
        near = (vectors @ index.passages[index.owned[item]].T).max(1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        for w in np.argsort(-near, kind="stable"):
            if near[w] < COSINE or (item in best and best[item][1] == 1.0):
                break
            x = int(start[w])
            run = low + (x - low) // index.window * index.window
            if item in best and bound[run, min(run + index.window, high)] / n <= best[item][1]:
                continue
            region = around(x, x)
            share = common_by(masks, n, region) / n
            if share < SHARE:
                answer = index.asked[item]
                if share < SHARE_WITH_ANSWER or not answer or common(answer, region) < ANSWER * len(answer):
                    continue
            if item not in best or share > best[item][1]:
                best[item] = (float(near[w]), share)
    return [(index.ids[i], round(c, 6), round(s, 6)) for i, (c, s) in sorted(best.items())]


def _tokens(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id and the terms of all words, 32-bit numbers in a row, of each row of documents: texts are taken apart once."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [sent.value.term_ids(words_of(text)).tobytes() for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    return written(map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, tokens binary"))


def terms_in(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t, np.int32) for t in column.to_pylist()]


def _sums(tokens: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray, list[np.ndarray]], None]) -> np.ndarray:
    """The sum over all documents of what ``add`` puts into an array with a row for each term.

    A task gives its sums once and Spark adds them up by term; only terms x columns numbers, a bounded
    block, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                add(total, terms_in(batch.column(0).slice(k, 2_000)))
        some = np.flatnonzero(total.any(1))
        for k in range(0, len(some), 10_000):
            at = some[k : k + 10_000]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * shape[1], shape[1]), pa.int32()), pa.array(total[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), rows], ["term", "v"])

    out = np.zeros(shape)
    parts = tokens.select("tokens").mapInArrow(run, "term int, v array<double>")
    for r in parts.groupBy("term").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(shape[1])]).collect():  # one row a term
        out[r["term"]] = r[1:]
    return out


def _frequencies(tokens: DataFrame, n: int) -> np.ndarray:
    """Documents that have each of n terms."""

    def add(total: np.ndarray, docs: list[np.ndarray]) -> None:
        for ids in docs:
            total[np.unique(ids), 0] += 1

    return _sums(tokens, (n + 1, 1), add)[:, 0]


def side_by_side(docs: list[np.ndarray], window: int, none: int) -> np.ndarray:
    """Rows of ``window`` terms, each word in one of them; a document's last row is filled up with ``none``."""
    ends = np.cumsum([-(-len(ids) // window) * window for ids in docs])
    out = np.full(ends[-1], none, np.int32)
    for ids, end in zip(docs, ends.tolist(), strict=True):
        begin = end - -(-len(ids) // window) * window
        out[begin : begin + len(ids)] = ids
    return out.reshape(-1, window)


def add_products(total: np.ndarray, rows: np.ndarray, weighted: np.ndarray) -> None:
    """Add each row's unit vector, that of the sum of its terms' vectors, to all of its terms; the last term has none."""
    none, n = len(weighted) - 1, len(rows)
    # Terms to the left, rows with most terms first: those with more than j are the first ones.
    left = np.sort(rows, 1)
    many = (left != none).sum(1)
    order = np.argsort(-many, kind="stable")
    left, many = np.ascontiguousarray(left[order].T), many[order]
    y = np.zeros((n, weighted.shape[1]))
    for j, terms in enumerate(left):
        if not (m := int(np.searchsorted(-many, -j))):
            break
        y[:m] += weighted[terms[:m]]
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    known = np.flatnonzero(left.ravel() != none)
    terms = left.ravel()[known]
    # Numbers of 16 bits are sorted by their digits.
    order = np.argsort(terms.astype(np.uint16) if none < 1 << 16 else terms, kind="stable")
    terms, row = terms[order], known[order] % n
    for a, b in pairwise(np.flatnonzero(np.diff(terms, prepend=-1, append=-1)).tolist()):
        for k in range(a, b, VECTORS):
            total[terms[a]] += y[row[k : min(b, k + VECTORS)]].sum(0)


def _svd(index: Index, tokens: DataFrame) -> np.ndarray:
    """A basis of the leading right singular vectors of the TF-IDF rows of all documents' windows and all passages.

    Randomised range finding: each task multiplies its rows A by the current basis and back, and Spark
    sums A'(A basis) by term. Passages weigh as much as all documents, so that a space of any number of
    documents tells items apart.
    """
    rank, none = min(RANK, len(index.terms)), len(index.terms)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((none, rank)))[0]
    passages = side_by_side(index.parts, index.window, none)
    for _ in range(ITERATIONS):
        weighted = np.vstack((basis, np.zeros((1, rank)))) * index.idf[:, None]
        sent = tokens.sparkSession.sparkContext.broadcast(weighted)

        def add(total: np.ndarray, docs: list[np.ndarray], sent=sent, window=index.window, none=none) -> None:
            # Windows side by side: each word is in one row of the matrix.
            rows = side_by_side(docs, window, none)
            step = max(1, WORDS // window)
            for a in range(0, len(rows), step):
                add_products(total, rows[a : a + step], sent.value)

        z, own = _sums(tokens, (none + 1, rank), add), np.zeros((none + 1, rank))
        add_products(own, passages, weighted)
        # The lengths of the rows in the present space, of documents and of items, get equal sums.
        z += own * ((weighted * z).sum() / (weighted * own).sum() or 1.0)
        basis = np.linalg.qr((z * index.idf[:, None])[:-1])[0]
    return np.vstack((basis, np.zeros((1, rank))))


def build(docs: DataFrame, items: list[tuple[int, str]]) -> Index | None:
    """The index of a block of items, with frequencies and space over all documents; None if no item has words."""
    return built[0] if (built := _build(docs, items)) is not None else None


def _build(docs: DataFrame, items: list[tuple[int, str]]) -> tuple[Index, DataFrame] | None:
    """The index and the documents by the terms of its items."""
    kept = [(i, words_of(t), answer_of(t)) for i, t in items if words_of(t)]
    if not kept:
        return None
    terms = {w: k for k, w in enumerate(sorted({w for _, words, answer in kept for w in (*words, *answer)}))}
    lengths = sorted(len(w) for _, w, _ in kept)
    window = max(8, lengths[len(lengths) // 2])
    none = np.zeros(0)
    index = Index([i for i, _, _ in kept], [w for _, w, _ in kept], [a for _, _, a in kept], terms, window, none, none, [], none, none, none, none, none, none, none, none, [], [], [])
    tokens = _tokens(docs, index)
    n, df = tokens.count(), _frequencies(tokens, len(terms))
    index.idf = np.log((1 + n) / (1 + df)) + 0.01
    index.idf[-1] = 0
    owner = []
    for k, words in enumerate(index.words):
        for a in range(0, max(1, len(words) - window // 2), window):
            owner.append(k)
            index.parts.append(index.term_ids(words[a : a + window]))
    index.owner = np.array(owner)
    index.list_terms()
    index.space = _svd(index, tokens).astype(np.float32)
    index.passages = np.vstack([latent(index, p, np.array([0]), np.array([len(p)])) for p in index.parts])
    return index, tokens


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Index, DataFrame]]:
    """The indexes of the benchmark's items, of at most about BLOCK of them each, with the documents by their terms."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    blocks = max(1, -(-items.count() // BLOCK))
    for b in range(blocks):
        own = sorted((r[0], r[1]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        if (built := _build(docs, own)) is not None:
            yield built


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (joined), cosine and share (the largest) for each row of documents.

    share is the part of an item's words that stand in the document in order near the candidate
    window. Null and empty texts hold nothing; items without words can't be held; an empty benchmark
    or documents table gives no finding. Ties in cosine go by item. Repeated rows get equal results, and
    each row its own, whatever its doc_id. Columns beyond doc_id and text, item_id and text are not
    read. Texts are read whole, however long.
    """
    kind = pa.list_(pa.struct([("item", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64())]))
    schema = "found array<struct<item: bigint, cosine: double, share: double>>, doc_id bigint"
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.select(F.array().cast("array<struct<item:bigint,cosine:double,share:double>>").alias("found"), "doc_id", "text")
    indexes = _indexes(texts, benchmark)
    first = then = next(indexes, None)
    while then is not None:
        (index, tokens), before, then = then, then, next(indexes, None)
        if before is first and then is None:
            # One block, as a rule: its terms are there already.
            out = tokens.select(F.array().cast("array<struct<item:bigint,cosine:double,share:double>>").alias("found"), "doc_id", "tokens")
        # Texts go on to the next block; the last one leaves them out.
        keep = ["found", "doc_id"] if then is None else ["found", "doc_id", "text"]
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent, keep=keep) -> pa.RecordBatch:
            index, old, own = sent.value, batch.column(0).to_pylist(), batch.column(2)
            docs = terms_in(own) if pa.types.is_binary(own.type) else [index.term_ids(words_of(text)) for text in own.to_pylist()]
            found = [f + [{"item": i, "cosine": c, "share": s} for i, c, s in matches_of(index, ids)] for ids, f in zip(docs, old, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(found, kind), *batch.columns[1 : len(keep)]], keep)

        out = map_arrow(out, run, schema + ", text string" * (len(keep) > 2))
    return out.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_items"),
        F.array_join(F.transform(F.array_sort("found"), lambda f: f["item"].cast("string")), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["cosine"])), F.lit(0.0)).alias("cosine"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("share"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of documents that hold no benchmark item, whatever their doc_id; all columns stay, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    out, at = with_text(docs, docs.columns)
    schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in out.columns)
    for index, _ in _indexes(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            return batch.filter(pa.array([not matches(sent.value, text) for text in batch.column(at).to_pylist()], pa.bool_()))

        out = map_arrow(out, run, schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
