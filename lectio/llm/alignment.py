"""Cross-tokenizer alignment: which tokens of two tokenizers stand on the same bytes.

Texts are shuffled whole, so that each distinct text is tokenised and aligned once; its pair counts are
weighted by its copies, and its measures are joined back to all documents that have it.

Inside a task, a text is cut where both tokenizers must end a token (before white space that no piece of B
holds after another character), and what recurs is remembered. Cuts end groups, so a text's
tokens, groups, links and digest are those of its parts, one after another. Parts that aren't known are joined
to one string and encoded together, which gives the same tokens for the same reason.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import checkpoint_folder, cut, map_arrow

FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
A_FILE, B_FILE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Parts, and bytes of them, that a task remembers.
MEMORY, MEMORY_BYTES = 300_000, 48_000_000
#: Id pairs, the most frequent, whose counts every task holds; the others are joined.
COMMON_PAIRS = 1_000_000
#: Unicode white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = "▁"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers with each token's bytes, and the parts of texts that were aligned lately."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        with open(a_file, encoding="utf-8") as f:
            a = json.load(f)
        if a.get("normalizer") or (a.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or a["pre_tokenizer"].get("add_prefix_space") or not a["pre_tokenizer"].get("use_regex", True):
            raise ValueError("A has to be a byte-level vocabulary that splits at white space and adds nothing")
        by_char = byte_characters()
        added = {t["content"]: t["id"] for t in a["added_tokens"]}
        self.a_bytes = [b""] * (max([*a["model"]["vocab"].values(), *added.values()]) + 1)
        for token, i in a["model"]["vocab"].items():
            self.a_bytes[i] = bytes(map(by_char.__getitem__, token)) if token not in added else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = []
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        for i, p in enumerate(pieces):
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.n_a = len(self.a_bytes)
        self.written = [b"%d%s" % (i, end) for i in range(self.n_a) for end in (b",", b"|")] + [b"%d%s" % (i, end) for i in range(len(pieces)) for end in (b",", b";", b"")]
        held = {y for p in pieces for x, y in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:], strict=False) if x not in WHITE and y in WHITE}
        white, open_ = re.escape(WHITE), re.escape("".join(sorted(held)))
        on = f"(?:[{open_}][{white}]*[^{white}]*)*" if held else ""
        self.parts = re.compile(f"[{white}]*[^{white}]+{on}|[{white}]+").findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.digest: list[bytes] = []
        self.bytes = 0
        #: For each part: tokens of A, of B, groups, links, whether its bytes come back; and its pairs from starts on.
        self.counts = np.zeros((0, 5), np.int64)
        self.starts = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.used = 0

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and by B of a text that begins with a space; None if they don't give its bytes back."""
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.b.encode(text[1:], num_threads=1)
        data = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Align parts that aren't known yet."""
        if len(self.number) + len(parts) > MEMORY or self.bytes > MEMORY_BYTES:
            raise MemoryError("forget first")
        whole = [p for p in parts if SPACE not in p and p[-1] not in WHITE]
        if not (whole and self._learn_joined(whole)):
            for p in whole:
                if not self._learn_joined([p]):
                    self._add([p], np.zeros((1, 5), np.int64), np.zeros(0, np.int64), [b""])
        for p in parts:
            if SPACE in p:  # B takes it for a space, so the bytes can't come back.
                self._add([p], np.zeros((1, 5), np.int64), np.zeros(0, np.int64), [b""])
            elif p[-1] in WHITE and not self._learn_joined([p]):
                self._add([p], np.zeros((1, 5), np.int64), np.zeros(0, np.int64), [b""])

    def _learn_joined(self, parts: list[str]) -> bool:
        """Align parts in one string, after a part of its own that begins with a space; False if the bytes don't come back or a part's end is no token's."""
        got = self.encoded(" x" + "".join(parts))
        if got is None:
            return False
        a, b = got
        sizes = np.array([2] + [len(p.encode()) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        is_a, is_b, is_end = (np.zeros(int(ends[-1]) + 1, bool) for _ in range(3))
        is_a[end_a], is_b[end_b], is_end[ends] = True, True, True
        if not (is_a[ends] & is_b[ends]).all():
            return False
        common, union = np.flatnonzero(is_a & is_b), np.flatnonzero(is_a | is_b)
        of_a, of_b = (np.cumsum(x)[union] - x[union] for x in (is_a, is_b))
        pairs = b[of_b] * self.n_a + a[of_a]
        upto = lambda x: np.searchsorted(x, ends, side="right")
        cuts_a, cuts_b, cuts_l = upto(end_a), upto(end_b), upto(union)
        counts = np.column_stack([np.diff(x) for x in (cuts_a, cuts_b, upto(common), cuts_l)] + [np.ones(len(parts), np.int64)])
        # Each group writes its tokens of A, then those of B.
        b_before = np.concatenate(([0], np.searchsorted(end_b, common, side="right")))
        a_through = np.searchsorted(end_a, common, side="right")
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + b_before[group_a]] = 2 * a + is_b[end_a]
        codes[np.arange(len(b)) + a_through[group_b]] = 2 * self.n_a + 3 * b + is_a[end_b] + is_end[end_b]
        text = list(map(self.written.__getitem__, codes.tolist()))
        at = (cuts_a + cuts_b).tolist()
        self._add(parts, counts, pairs[cuts_l[0] :], [b"".join(text[x:y]) for x, y in zip(at, at[1:], strict=False)])
        return True

    def _add(self, parts: list[str], counts: np.ndarray, pairs: np.ndarray, digest: list[bytes]) -> None:
        first = len(self.digest)
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))
        self.digest += digest
        self.bytes += sum(map(len, digest))
        if len(self.counts) < first + len(parts):
            more = first + len(parts)
            self.counts = np.concatenate((self.counts, np.zeros((more, 5), np.int64)))
            self.starts = np.concatenate((self.starts, np.zeros(more, np.int64)))
        if len(self.pairs) < self.used + len(pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros(self.used + len(pairs), np.int64)))
        self.counts[first : first + len(parts)] = counts
        self.starts[first : first + len(parts)] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.pairs[self.used : self.used + len(pairs)] = pairs
        self.used += len(pairs)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links and the digest; all texts' different pairs, how often each comes, and each text's number of them."""
        split = [self.parts(" " + t) if t else [] for t in texts]
        flat = [p for parts in split for p in parts]
        missing = set(flat).difference(self.number)
        if missing and (len(self.number) + len(missing) > MEMORY or self.bytes > MEMORY_BYTES):
            self.forget()
            if len(texts) > 1 and len(set(flat)) > MEMORY:
                half = len(texts) // 2
                x, y = self.align(texts[:half]), self.align(texts[half:])
                return np.concatenate((x[0], y[0])), x[1] + y[1], *(np.concatenate((x[k], y[k])) for k in (2, 3, 4))
            missing = set(flat)
        new = sorted(missing)
        for k in range(0, len(new), MEMORY):
            if k:  # One text of more parts than are remembered.
                return self._long(texts[0])
            self.learn(new[k : k + MEMORY])
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        n = np.array([len(x) for x in split], np.int64)
        owner = np.repeat(np.arange(len(texts)), n)
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, owner, self.counts[at, :4])
        good = (n > 0) & (np.bincount(owner, weights=self.counts[at, 4], minlength=len(texts)) == n)
        sums[~good] = 0
        listed, digests = at.tolist(), []
        ends = np.cumsum(n).tolist()
        for k, end in enumerate(ends):
            digests.append(hashlib.sha256(b";".join(map(self.digest.__getitem__, listed[end - len(split[k]) : end]))).hexdigest() if good[k] else "")
        used = at[good[owner]]
        lengths = self.counts[used, 3]
        before = np.cumsum(lengths) - lengths
        links = self.pairs[np.repeat(self.starts[used] - before, lengths) + np.arange(int(lengths.sum()))]
        width = np.int64(self.n_a * len(self.b_bytes))
        keys, times = np.unique(np.repeat(owner[good[owner]], lengths) * width + links, return_counts=True)
        return sums, digests, keys % width, times, np.bincount(keys // width, minlength=len(texts))

    def _long(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """A text of more different parts than are remembered, a block of parts at a time."""
        parts, sums, said = self.parts(" " + text), np.zeros(4, np.int64), hashlib.sha256()
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(parts), MEMORY):
            self.forget()
            block = parts[k : k + MEMORY]
            self.learn(sorted(set(block)))
            at = np.array([self.number[p] for p in block], np.int64)
            if not self.counts[at, 4].all():
                return np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
            sums += self.counts[at, :4].sum(axis=0)
            said.update((b";" if k else b"") + b";".join(self.digest[i] for i in at.tolist()))
            links = np.concatenate([self.pairs[self.starts[i] : self.starts[i] + self.counts[i, 3]] for i in at.tolist()])
            pairs, times = _summed(np.concatenate((pairs, links)), np.concatenate((times, np.ones(len(links), np.int64))))
        return sums[None], [said.hexdigest()], pairs, times, np.array([len(pairs)])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process and pair of files, which are on every machine."""
    if (a_file, b_file) not in _aligners:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


def _summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sum of each one's amounts."""
    order = np.argsort(keys, kind="stable")
    keys, amounts = keys[order], amounts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(amounts, first) if len(first) else amounts


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))


MEASURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned_texts(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Each distinct text's key (sha-256), copies, measures, and its different id pairs (B's id times the size of A, plus A's) with their links; a table in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    rows = texts.select(F.sha2("text", 256).alias("key"), "copies", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, digests, pairs, times, lengths = aligner(a_file, b_file).align(batch.column(2).to_pylist())
        made = [*batch.columns[:2], *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(4)), pa.array(digests, pa.string()), _lists(pairs, lengths, pa.int64()), _lists(times, lengths, pa.int32())]
        return pa.RecordBatch.from_arrays(made, ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    path = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    map_arrow(rows, run, f"key string, copies bigint, {MEASURES}, pairs array<bigint>, times array<int>", rows=128).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_counts(texts: DataFrame, a_size: int) -> DataFrame:
    """(pair, n, best): how many links corpus-wide hold each id pair, and whether none of its B id's pairs has more. Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, most = 0, 2_000_000
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            lengths = np.diff(pairs.offsets.to_numpy())
            held.append((pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64) * np.repeat(batch.column(0).to_numpy(), lengths)))
            size += len(held[-1][0])
            if size > most:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                most = max(most, 2 * size)
        if held:
            pairs, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
            for k in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["pair", "n"])

    counts = cut(texts.select("copies", "pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.floor(F.col("pair") / a_size)
    # A row for each id of B: as many as its vocabulary, whatever the corpus.
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def measures(texts: DataFrame, counts: DataFrame, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """Each distinct text's measures with n_best and count_sum.

    Tasks hold the counts of the most frequent pairs (``common_pairs`` of them at most); a text's other pairs are
    joined with theirs, so that nothing that grows with the corpus is broadcast.
    """
    sc = texts.sparkSession.sparkContext
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("k")).orderBy(F.desc("e")).collect()
    least, total = None, 0
    for r in by_size:
        total += r["k"]
        if total > common_pairs:
            break
        least = r["e"]
    common = counts.filter(F.lit(least is not None) & (F.log2("n") >= (least or 0))).toPandas().sort_values("pair")
    held = sc.broadcast((common["pair"].to_numpy(np.int64), common["n"].to_numpy(np.int64), common["best"].to_numpy(bool)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, n, best = held.value
        pairs, times = batch.column(6), batch.column(7)
        lengths = np.diff(pairs.offsets.to_numpy())
        pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.searchsorted(known, pairs)
        at[at == len(known)] = 0
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        sums = np.zeros((2, len(lengths)), np.int64)
        at, of, t = at[hit], owner[hit], times[hit]
        np.add.at(sums[0], of, t * best[at])
        np.add.at(sums[1], of, t * n[at])
        rest = np.bincount(owner[~hit], minlength=len(lengths))
        made = [*batch.columns[:6], pa.array(sums[0]), pa.array(sums[1]), _lists(pairs[~hit], rest, pa.int64()), _lists(times[~hit], rest, pa.int64())]
        return pa.RecordBatch.from_arrays(made, ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "times"])

    own = cut(map_arrow(texts.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), run, f"key string, {MEASURES}, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"))
    rare = own.filter(F.size("pairs") > 0).select("key", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("key", F.col("z.pairs").alias("pair"), F.col("z.times").alias("t")).join(counts, "pair")
    rare = rare.groupBy("key").agg(F.sum(F.col("t") * F.col("best").cast("int")).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more_sum"))
    both = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return own.join(rare, "key", "left").select("key", "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more_sum"), "groups_sha256")


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Align two tokenizers on every document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds that space. Texts that are null or empty, or whose
    tokens don't give those bytes back, have no tokens: zeros and an empty digest, and they count in no pair. Equal
    texts, repeated rows included, have equal measures, and each row counts. Texts are encoded whole; one of more
    different parts than a task remembers goes by blocks of parts. Other columns, whatever their names, are not read. An
    empty table gives an empty result.
    """
    texts = aligned_texts(docs, a_file, b_file)
    counts = pair_counts(texts, aligner(a_file, b_file).n_a)
    keyed = docs.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key"))
    return keyed.join(measures(texts, counts), "key").drop("key").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
