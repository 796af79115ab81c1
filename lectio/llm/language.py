"""Language identification by a linear-chain conditional random field over words.

Each line of a text is a chain of words. A word's emission score for a language is the sum of the
weights of its affixes, character n-grams and lexicon entry; transitions between languages are
learned. Forward-backward gives every word's language probabilities, also in code-switched text, and
their letter-weighted mean over the text gives the document's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.llm.common import few, kept, mix, prefix_hash, range_hash, with_text

#: The training sample's bounds: documents of each language, pieces of lines of each of them, words of a piece.
TRAIN_DOCS, TRAIN_LINES, TRAIN_WORDS = 600, 6, 200
#: Hash buckets of features.
BUCKETS = 1 << 16
#: Tokens whose emissions a worker remembers; words that are tagged at a time, about.
MEMORY, TAGGED = 100_000, 200_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words in lower case, one word's after the other's, and where each begins.

    A word has itself, its prefixes of 1 to 3 letters, its suffixes of 1 to 4 and its 2- and 3-grams with
    both ends marked: a feature for each kind and place, all of them however long the word is.
    """
    size = np.array([len(w) + 2 for w in words], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    prefix = prefix_hash(mix(points.astype(np.uint64) + np.uint64(1)))
    first = np.cumsum(size) - size
    who, start, end, kind = [], [], [], []

    def add(own: np.ndarray, a: np.ndarray, b: np.ndarray, name: int) -> None:
        who.append(own), start.append(a), end.append(b), kind.append(np.full(len(own), name, np.uint64))

    every = np.arange(len(words))
    add(every, first, first + size, 0)
    for k in (1, 2, 3, 4):
        own = np.flatnonzero(size - 2 >= k)
        if k < 4:
            add(own, first[own] + 1, first[own] + 1 + k, 1)
        add(own, first[own] + size[own] - 1 - k, first[own] + size[own] - 1, 2)
    for k in (2, 3):
        many = size - k + 1
        own = np.repeat(every, many)
        at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        add(own, at, at + k, 3)
    owner = np.concatenate(who)
    order = np.argsort(owner, kind="stable")
    hashed = mix(range_hash(prefix, np.concatenate(start), np.concatenate(end)) ^ np.concatenate(kind))[order]
    count = np.bincount(owner, minlength=len(words))
    return (hashed % np.uint64(BUCKETS)).astype(np.int64), np.cumsum(count) - count


def letters_of(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


@dataclass
class Model:
    """Learned weights."""

    langs: list[str]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The emission scores of words, a row each."""
        flat, start = word_features(words)
        return np.add.reduceat(self.emit[flat], start, 0)


def forward_backward(scores: np.ndarray, start: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word for chains that lie one after the other in scores, longest chain first; and expected moves."""
    n_langs = scores.shape[1]
    weight = np.exp(scores - scores.max(1, keepdims=True))
    trans = np.exp(move)
    fore, back = np.empty_like(weight), np.empty_like(weight)
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(length.max() if len(length) else 0)]  # chains longer than t
    here = weight[start] if len(start) else weight[:0]
    fore[start] = here / here.sum(1, keepdims=True)
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        here = (fore[at - 1] @ trans) * weight[at]
        fore[at] = here / here.sum(1, keepdims=True)
    last = start + length - 1
    back[last] = 1.0 / n_langs
    for t in range(len(active) - 2, -1, -1):
        at = start[: active[t + 1]] + t
        here = (back[at + 1] * weight[at + 1]) @ trans.T
        back[at] = here / here.sum(1, keepdims=True)
    both = fore * back
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(scores), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    pair = fore[at, :, None] * trans[None] * (weight[at + 1] * back[at + 1])[:, None, :]
    pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((n_langs, n_langs))
    return both, pair


def learn(lines: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, batch: int = 128, seed: int = 5) -> Model:
    """Fit the field to (line, language) pairs by AdaGrad on the conditional likelihood; a line is a chain."""
    langs = sorted({lang for _, lang in lines})
    index = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    emit, move = np.zeros((BUCKETS, len(langs))), np.zeros((len(langs), len(langs)))
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    ids: dict[str, int] = {}
    chains = []
    for line, lang in lines:
        if words := [w for t in line.lower().split() if (w := letters_of(t))]:
            chains.append((np.array([ids.setdefault(w, len(ids)) for w in words]), index[lang]))
    flat, first = word_features(list(ids)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    count = np.diff(np.append(first, len(flat)))
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), batch):
            own = sorted((chains[i] for i in order[k : k + batch]), key=lambda c: -len(c[0]))
            words, length = np.concatenate([c[0] for c in own]), np.array([len(c[0]) for c in own])
            gold = np.repeat([c[1] for c in own], length)
            unique, inverse = np.unique(words, return_inverse=True)
            many = count[unique]
            begin = np.cumsum(many) - many
            used = flat[np.repeat(first[unique] - begin, many) + np.arange(many.sum())]
            scores = np.add.reduceat(emit[used], begin, 0)[inverse]
            start = np.cumsum(length) - length
            marginal, pair = forward_backward(scores, start, length, move)
            marginal[np.arange(len(gold)), gold] -= 1
            step = 1e-5 * emit
            for i in range(len(langs)):
                per_word = np.bincount(inverse, marginal[:, i], len(unique))
                step[:, i] += np.bincount(used, np.repeat(per_word, many), BUCKETS) / len(own)
            np.add.at(pair, ([c[1] for c in own], [c[1] for c in own]), -(length - 1.0))
            seen_e += step**2
            emit -= rate * step / np.sqrt(seen_e)
            pair /= len(own)
            seen_m += pair**2
            move -= rate * pair / np.sqrt(seen_m)
    return Model(langs, emit.astype(np.float32), move)


def training_fold():
    """Of a row: whether predictions may learn from it."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS, per_doc: int = TRAIN_LINES) -> Model | None:
    """Learn from a bounded sample of labelled documents outside the held-out fold; None if there are none.

    At most ``per_lang`` documents of each language, by the hash of their doc_id, and ``per_doc``
    pieces of TRAIN_WORDS words or less of their lines, by the pieces' hash, come to the driver.
    """
    known = docs.filter(training_fold() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # About three times as many documents as are asked for go on, so that no language's rows meet in one task.
    share = F.shiftrightunsigned("h", 11) / F.lit(2.0**53) * F.col("n")
    near = known.join(few(known.groupBy("lang").agg(F.count("*").alias("n"))), "lang").filter(share < 3 * per_lang + 50)
    picked = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= per_lang)
    texts = docs.select("doc_id", "lang", "text").join(few(picked.select("doc_id").distinct()), "doc_id").filter(F.col("lang").isNotNull())
    words = texts.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 1).select("doc_id", "lang", F.split("line", "[ \t\r]+").alias("words"))
    cuts = F.sequence(F.lit(1), F.size("words"), F.lit(TRAIN_WORDS))
    lines = words.select("doc_id", "lang", F.explode(F.transform(cuts, lambda i: F.array_join(F.slice("words", i, TRAIN_WORDS), " "))).alias("line"))
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("line"), "line"))
    got = lines.withColumn("r", nth).filter(F.col("r") <= per_doc).select("lang", "line").collect()
    pairs = sorted((r["line"], r["lang"]) for r in got)
    return learn(pairs) if pairs else None


class Tagger:
    """A model with the emissions of words that the worker has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0)

    def tag(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; lines are chains, however long."""
        if len(self.ids) > MEMORY:
            self.reset()
        ids, new = self.ids, []
        known = len(self.table)
        words: list[int] = []
        owner, length = [], []
        for k, text in enumerate(texts):
            for line in (text or "").lower().split("\n"):
                before = len(words)
                for t in line.split():
                    i = ids.get(t)
                    if i is None:
                        if word := letters_of(t):
                            i = known + len(new)
                            new.append(word)
                        else:
                            i = -1
                        ids[t] = i
                    if i >= 0:
                        words.append(i)
                if len(words) > before:
                    owner.append(k)
                    length.append(len(words) - before)
        if new:
            self.table = np.concatenate((self.table, self.model.emissions(new)))
            self.letters = np.concatenate((self.letters, [len(w) for w in new]))
        if not words:
            return [("und", 0.0)] * len(texts)
        size = np.array(length)
        order = np.argsort(-size, kind="stable")
        start = np.cumsum(size) - size
        all_words = np.array(words)
        marginal = marginals(self.table[all_words].T, start[order], size[order], self.model.move)
        whose = np.repeat(np.array(owner), size)
        weight = self.letters[all_words]
        langs = self.model.langs
        total = np.stack([np.bincount(whose, m * weight, len(texts)) for m in marginal], 1)
        sums = total.sum(1)
        return [(langs[int(t.argmax())], float(t.max() / s)) if s > 0 else ("und", 0.0) for t, s in zip(total, sums, strict=True)]


def marginals(scores: np.ndarray, start: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The marginals of forward_backward alone, [language, word]; chains come longest first, wherever they start."""
    steps = int(length.max())
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    offset = np.concatenate(([0], np.cumsum(active))).tolist()
    # Rows are laid out by step, so that each step works on a slice.
    place = start[np.arange(offset[-1]) - np.repeat(offset[:-1], active)] + np.repeat(np.arange(steps), active)
    weight = np.exp(scores - scores.max(0))[:, place]
    trans = np.exp(move)
    fore, back = np.empty_like(weight), np.ones_like(weight)
    fore[:, : offset[1]] = weight[:, : offset[1]] / weight[:, : offset[1]].sum(0)
    forth = np.ascontiguousarray(trans.T)
    for t in range(1, steps):
        a, b, c = offset[t - 1], offset[t], offset[t + 1]
        here = forth @ fore[:, a : a + c - b]
        here *= weight[:, b:c]
        here /= here.sum(0)
        fore[:, b:c] = here
    for t in range(steps - 2, -1, -1):
        a, b, c = offset[t], offset[t + 1], offset[t + 2]
        here = trans @ (back[:, b:c] * weight[:, b:c])
        here /= here.sum(0)
        back[:, a : a + c - b] = here
    fore *= back
    fore /= fore.sum(0)
    out = np.empty_like(fore)
    out[:, place] = fore
    return out


def identify(docs: DataFrame, model: Model | None, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add lang_pred and score, under these or given names, to documents; all other columns stay (existing ones of these names are replaced).

    lang_pred is a learned language, or ``und`` with score 0 if the text is null, empty or has no
    letter, or if nothing was learned. Equal texts get equal results, also repeated rows. An empty table
    gives an empty result. Texts are read whole, however long.
    """
    own_columns = [c for c in docs.columns if c not in (pred, score)]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own_columns) + f", `{pred}` string, `{score}` double"
    rows, at = with_text(docs, own_columns)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in own_columns], F.lit("und").alias(pred), F.lit(0.0).alias(score))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = kept(("language", hash((sent.value.emit.tobytes(), sent.value.move.tobytes()))), lambda: Tagger(sent.value))
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)) // (6 * TAGGED)
            for part in np.unique(size):
                first, last = np.searchsorted(size, (part, part + 1))
                own = batch.slice(first, last - first)
                got = tagger.tag(own.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns[: len(own_columns)], pa.array([x for x, _ in got]), pa.array([s for _, s in got], pa.float64())], [*own_columns, pred, score])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, learned from the other fold.

    Null and empty texts, texts without letters and, if nothing is labelled, all texts are ``und`` with
    score 0. A null doc_id counts as an empty one in the fold. Repeated rows come out as often as they
    went in; other columns are not read.
    """
    rows = identify(docs.select("doc_id", "text"), train(docs))
    return rows.select("doc_id", (~training_fold()).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
