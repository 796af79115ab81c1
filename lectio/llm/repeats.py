"""Repeated passages: every 50-byte string that also starts in a document with a smaller doc_id.

Suffixes are sorted by external induction from sampled ones:

1. A text that equals one of a smaller doc_id is settled by its digest and takes no further part.
2. Samples are minimisers: of the K-byte strings in each window of WINDOW bytes the one of least hash,
   the first of equals. It owns that window; equal windows have equal owners at equal offsets. Tasks
   send packed hashes to buckets, where those that more than one document has are counted. A bit set
   of them prunes the samples at their source; if there are too many for it, a join does.
3. The suffixes at the samples that are left are sorted by Spark's external sort, with spilled runs on
   disk: rows carry the sample's hash, its text to the right and to the left, and its document.
4. In blocks of whole sample groups, the order of the suffixes that start l bytes before the samples is
   induced from that of l - 1 by a stable sort on one more byte, for l up to WINDOW - K, and the common
   prefixes of neighbours are carried along as one more than the least on the way. Neighbours with a
   common prefix of WINDOW bytes are equal windows; the least doc_id of such a run decides.

Samples with more than HOT places are dealt out by documents over one group for each HOT of them. Inside
a group all but the least document of each window are settled; the windows of those least ones meet,
byte for byte, in rows of which there is one for each group and different window.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import BROADCAST_ROWS, BYTE_VALUES, POWERS, checkpoint_folder, cut, map_arrow, prefix_hash, range_hash

WINDOW, K = 50, 24
#: Offsets of a window's start before its sample.
BEFORE = WINDOW - K
#: Rows of a sample whose group stays together, about; larger ones are dealt out over several groups.
HOT = 10_000
#: Most bits of the set of shared hashes (16 MB), of which each has 8 at least, and most hot hashes that tasks are sent.
MOST_BITS, MOST_HOT = 1 << 27, 1_000_000
#: Rows that a block aims at.
BLOCK_ROWS = 40_000
#: Bits of a place in a chunk of text; the rest of a key is a sample's rank.
PLACE_BITS = 20
#: Bits of the buckets that hashes are counted in: a bucket's share of 64 GB is some 5 MB, and with each doubling there is one more.
BUCKET_BITS, BUCKET_BYTES = 12, 1 << 36
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _chunk_samples(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, windows) of each sample of a chunk with this prefix hash: its key, and the run of windows that it owns."""
    _, down = POWERS.upto(len(prefix))
    n = len(prefix) - K
    key = (prefix[K:] - prefix[:-K]) * down[:n]
    key *= SPREAD
    key >>= np.uint64(PLACE_BITS)
    key <<= np.uint64(PLACE_BITS)
    key |= np.arange(n, dtype=np.uint64)
    span, width = 1, BEFORE + 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        rest = width - span
        key = np.minimum(key[:-rest], key[rest:])
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], first, np.diff(np.append(first, len(key)))


def samples(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, least offset, largest offset) of each sample: offsets are how far before it the windows start that it owns."""
    out: list[tuple[np.ndarray, ...]] = []
    step = 1 << PLACE_BITS
    for low in range(0, len(data) - WINDOW + 1, step - WINDOW):
        part = np.frombuffer(data, np.uint8)[low : low + step]
        if len(part) < WINDOW:
            break
        prefix = prefix_hash(BYTE_VALUES[part])
        key, first, windows = _chunk_samples(prefix)
        place = (key & np.uint64(step - 1)).astype(np.int64)
        out.append((range_hash(prefix, place, place + K), place + low, place - first - windows + 1, place - first))
        if low + step >= len(data):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) != 1 else out[0]


class Bits:
    """A set of hashes as a bit for each residue: it may hold more, never less."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.int64(len(words) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def bit_set(hashes: DataFrame, n: int) -> Bits | None:
    """The bit set of a column ``hash`` of n rows: 16 bits a hash if they fit into MOST_BITS, 8 at least; None if those don't."""
    if 8 * n > MOST_BITS:
        return None
    size = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    rows = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, int((hash & {size - 1}) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bits(words)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def without_copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that equal none of a smaller doc_id, and (doc_id, start, end) of all the others; at more than BROADCAST_ROWS repeated texts all stay."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    long = texts.filter(F.octet_length("text") >= WINDOW)
    repeated = cut(long.select(digest.alias("digest"), "doc_id").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("digest", "least"))
    if repeated.count() > BROADCAST_ROWS:
        return long, texts.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")).limit(0)
    marked = long.withColumn("digest", digest).join(F.broadcast(repeated), "digest", "left")
    copies = marked.filter("least < doc_id").select("doc_id", F.lit(0).cast("bigint").alias("start"), F.octet_length("text").cast("bigint").alias("end"))
    return marked.filter("least is null or least = doc_id").select("doc_id", "text"), copies


def _binaries(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Slices of data between edges (in items) as binary values."""
    offsets = (edge * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def shared_hashes(texts: DataFrame, bucket_bits: int) -> DataFrame:
    """hash (32 + bucket_bits bits) and places of the samples that more than one document has."""
    buckets = 1 << bucket_bits

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """(bucket, once, more): the low 32 bits of hashes with one place in the batch; of others (hash, documents, places)."""
        found = [np.unique(samples(data)[0], return_counts=True) for t in batch.column(0).to_pylist() if len(data := t.encode("utf-8", "replace")) >= WINDOW]
        if not found:
            return None
        key = np.concatenate([x for x, _ in found])
        key = (key & np.uint64(buckets - 1)) << np.uint64(32) | key >> np.uint64(bucket_bits) & np.uint64(0xFFFFFFFF)
        order = np.argsort(key)
        key, places = key[order], np.concatenate([n for _, n in found])[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        docs, places, key = np.diff(np.append(first, len(key))), np.add.reduceat(places, first), key[first]
        alone = places == 1
        start = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
        once = key[alone]
        more = np.stack((key[~alone] & np.uint64(0xFFFFFFFF), docs[~alone].astype(np.uint64), places[~alone].astype(np.uint64)), 1).astype(np.uint32)
        edges = np.searchsorted(once, start), 3 * np.searchsorted(key[~alone], start)
        full = np.flatnonzero((np.diff(edges[0]) > 0) | (np.diff(edges[1]) > 0))
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), _binaries(once.astype(np.uint32), edges[0]), _binaries(more.ravel(), edges[1])], ["bucket", "once", "more"])
        return rows.take(pa.array(full))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        now = None
        for batch in batches:
            for bucket, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield counted(now, held)
                    held = []
                now = bucket
                held.append((once, more))
        if held:
            yield counted(now, held)

    def counted(bucket: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        once = np.frombuffer(b"".join(x for x, _ in held), np.uint32)
        more = np.frombuffer(b"".join(x for _, x in held), np.uint32).reshape(-1, 3)
        low = np.concatenate((once, more[:, 0]))
        order = np.argsort(low)
        low = low[order]
        docs, places = (np.concatenate((np.ones(len(once), np.int64), more[:, i].astype(np.int64)))[order] for i in (1, 2))
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        good = np.add.reduceat(docs, first) > 1
        hashes = low[first[good]].astype(np.int64) << bucket_bits | bucket
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.add.reduceat(places, first)[good])], ["hash", "places"])

    packed = map_arrow(texts.select("text"), pack, "bucket int, once binary, more binary", rows=10_000)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "hash bigint, places bigint")


def sample_rows(texts: DataFrame, bucket_bits: int, shared: Bits | None, hot: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (hash, salt, doc_id, place, context) of samples; only of shared ones if they are given.

    salt: the group of a hot hash (hot: ascending hashes and their numbers of groups), else -1. place: where it
    stands and the offsets that it owns; context: the BEFORE bytes before it, last one first, after the WINDOW from it on.
    """
    around = np.concatenate((BEFORE + np.arange(WINDOW), BEFORE - 1 - np.arange(BEFORE)))
    ahead = np.concatenate((np.arange(WINDOW), np.zeros(BEFORE, int)))[None, :]
    behind = np.concatenate((np.zeros(WINDOW, int), 1 + np.arange(BEFORE)))[None, :]
    bits = np.uint64((1 << 32 + bucket_bits) - 1)

    names = ["hash", "salt", "doc_id", "place", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                if len(data) < WINDOW:
                    continue
                value, place, low, high = samples(data)
                value = (value & bits).view(np.int64)
                if shared is not None:
                    good = shared.has(value)
                    value, place, low, high = value[good], place[good], low[good], high[good]
                padded = np.zeros(len(data) + BEFORE + WINDOW, np.uint8)
                padded[BEFORE : BEFORE + len(data)] = np.frombuffer(data, np.uint8)
                for k in range(0, len(value), BLOCK_ROWS):
                    own = slice(k, k + BLOCK_ROWS)
                    held.append(rows_of(doc_id, padded, value[own], place[own], low[own], high[own]))
                    size += len(held[-1][0])
                    if size >= BLOCK_ROWS:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    def rows_of(doc_id: int, padded: np.ndarray, value: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        context = padded[place[:, None] + around[None, :]]
        # Bytes that no owned window has stay out, so that rows compress better and more of them are equal.
        context[(ahead >= WINDOW - low[:, None]) | (behind > high[:, None])] = 0
        salt = np.full(len(value), -1, np.int32)
        if hot is not None and len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], value), len(hot[0]) - 1)
            own = hot[0][at] == value
            salt[own] = zlib.crc32(str(doc_id).encode()) % hot[1][at[own]].astype(np.int64)
        return value, salt, np.full(len(value), doc_id), place | low << 40 | high << 46, context

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        *columns, context = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), _binaries(context.ravel(), np.arange(len(context) + 1) * (BEFORE + WINDOW))], names)

    return texts.select("doc_id", "text").mapInArrow(run, "hash bigint, salt int, doc_id bigint, place bigint, context binary")


def induce(context: np.ndarray, doc_id: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For samples whose equal beginnings of contexts stand together: [sample, l], the least document with the window that starts l bytes before the sample.

    Only windows that their sample owns (low <= l <= high) count; elsewhere there is no document (FAR).
    """
    n = len(context)
    out = np.full((n, BEFORE + 1), FAR)
    order = np.arange(n)
    same = context[1:, :WINDOW] == context[:-1, :WINDOW]
    prefix = np.zeros(n, np.int16)
    prefix[1:] = np.where(same.all(1), WINDOW, same.argmin(1))
    for before in range(BEFORE + 1):
        if before:
            # Induction: the suffixes one byte further left, by that byte and the order so far.
            byte = context[order, WINDOW - 1 + before]
            put = np.argsort(byte, kind="stable")
            moved = byte[put]
            # The common prefix of new neighbours: the least between their old places, and one more.
            head = np.flatnonzero(np.concatenate(([True], moved[1:] != moved[:-1])))
            carried = np.empty(n, np.int16)
            for a, b in zip(head, np.append(head[1:], n), strict=True):
                carried[a] = -1
                if b - a > 1:
                    at = put[a:b]
                    carried[a + 1 : b] = np.minimum.reduceat(prefix[: at[-1] + 1], at[:-1] + 1)
            order, prefix = order[put], np.minimum(carried + 1, WINDOW).astype(np.int16)
        start = np.flatnonzero(prefix < WINDOW)  # runs of equal windows
        if not len(start) or start[0]:
            start = np.insert(start, 0, 0)
        docs = np.where((low[order] <= before) & (before <= high[order]), doc_id[order], FAR)
        out[order, before] = np.repeat(np.minimum.reduceat(docs, start), np.diff(np.append(start, n)))
    return out


FAR = np.iinfo(np.int64).max


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (hash, salt, context); blocks hold whole groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < BLOCK_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        edge = np.flatnonzero(_changes(rows["hash"].to_numpy(), rows["salt"].to_numpy()))
        if edge[-1]:
            yield from _resolve(rows.slice(0, edge[-1]))
            rest = rows.slice(edge[-1])
            held, size = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        yield from _resolve(pa.Table.from_batches(held))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Of each row, whether it differs from the one before."""
    return np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def _resolve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans (window null), and of hot samples the windows that are still open."""
    n, width = rows.num_rows, BEFORE + WINDOW
    hashes, salt, doc_id, packed = (rows[c].to_numpy() for c in ("hash", "salt", "doc_id", "place"))
    place, low, high = packed & ((1 << 40) - 1), packed >> 40 & 63, packed >> 46
    context = np.frombuffer(b"".join(rows["context"].to_pylist()), np.uint8).reshape(n, width)
    # Equal rows of a group stand together, and one with the least document stands for them.
    new = _changes(hashes, salt, low, high)
    new[1:] |= (context[1:] != context[:-1]).any(1)
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    least_doc = np.minimum.reduceat(doc_id, first)
    # A group of one text needs no sorting.
    opens = _changes(hashes[first], salt[first])
    alone = opens & np.append(opens[1:], True)
    least = np.where((low[first, None] <= OFFSETS) & (OFFSETS <= high[first, None]), least_doc[:, None], FAR)
    several = np.flatnonzero(~alone)
    if len(several):
        at = first[several]
        # Samples of different text have no equal windows, so one induction serves all groups of the block.
        least[several] = induce(context[at], least_doc[several], low[at], high[at])
    hit = least[of] < doc_id[:, None]
    row, l_first, l_last = _runs(hit)
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(doc_id[row]), pa.array(place[row] - l_last), pa.array(place[row] - l_first + WINDOW), pa.nulls(len(row), pa.binary())], ["doc_id", "start", "end", "window"])
    hot = np.flatnonzero(salt >= 0)
    if len(hot):
        left = (least[of[hot]] == doc_id[hot, None]) & (low[hot, None] <= OFFSETS) & (OFFSETS <= high[hot, None])
        row, l = np.nonzero(left)  # noqa: E741
        row = hot[row]
        straight = np.concatenate((context[:, WINDOW:][:, ::-1], context[:, :WINDOW]), 1)
        for k in range(0, len(row), BLOCK_ROWS):
            r, b = row[k : k + BLOCK_ROWS], l[k : k + BLOCK_ROWS]
            window = straight[r[:, None], (BEFORE - b)[:, None] + np.arange(WINDOW)[None, :]]
            yield pa.RecordBatch.from_arrays([pa.array(doc_id[r]), pa.array(place[r] - b), pa.array(place[r] - b + WINDOW), _binaries(window.ravel(), np.arange(len(r) + 1) * WINDOW)], ["doc_id", "start", "end", "window"])


OFFSETS = np.arange(BEFORE + 1)[None, :]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true columns."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end) in bytes of repeated passages; they may overlap."""
    spark = docs.sparkSession
    texts = _texts(docs).filter("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = min(22, BUCKET_BITS + (size // BUCKET_BYTES).bit_length())
    texts, copies = without_copies(texts)
    counts = cut(shared_hashes(texts, bucket_bits))
    groups = F.ceil(F.col("places") / HOT)
    many = counts.filter(groups > 1).select("hash", groups.cast("int").alias("groups"))
    n_hot = many.count()
    shared = bit_set(counts, counts.count()) if n_hot <= MOST_HOT else None
    if shared is not None:
        found = many.orderBy("hash").toArrow()
        rows = sample_rows(texts, bucket_bits, shared, (found["hash"].to_numpy(), found["groups"].to_numpy()))
    else:
        salt = F.when(groups > 1, F.pmod(F.xxhash64("doc_id"), groups)).otherwise(-1).cast("int")
        rows = sample_rows(texts, bucket_bits, None, None).drop("salt").join(counts, "hash").select("hash", salt.alias("salt"), "doc_id", "place", "context")
    found = rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "context").mapInArrow(_sorted_blocks, "doc_id bigint, start bigint, end bigint, window binary")
    if not n_hot:
        return found.select("doc_id", "start", "end").unionByName(copies)
    folder = f"{checkpoint_folder(spark)}/repeats-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    found = spark.read.parquet(folder)
    settled = found.filter("window is null").select("doc_id", "start", "end")
    left = found.filter("window is not null")
    least = left.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("window", "least")
    return settled.unionByName(left.join(least, "window").filter("least < doc_id").select("doc_id", "start", "end")).unionByName(copies)


def _cut_out(data: bytes, found: list[dict] | None) -> tuple[int, int, str, bytes]:
    """(removed bytes, removed runs, digest of the rest, the rest)."""
    gone = np.zeros(len(data) + 1, np.int32)
    for s in found or ():
        gone[min(s["start"], len(data))] += 1
        gone[min(s["end"], len(data))] -= 1
    removed = np.cumsum(gone)[:-1] > 0
    rest = np.frombuffer(data, np.uint8)[~removed].tobytes()
    runs = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
    return int(removed.sum()), runs, hashlib.sha256(rest).hexdigest(), rest


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of documents; kept (binary) too if asked for.

    Removed is each byte that a 50-byte string covers which also starts in a document with a smaller
    doc_id. Null texts are empty; texts under 50 bytes, and rows with a null doc_id, lose nothing and
    take nothing from others. Rows that share a doc_id are one document: repeated rows take nothing
    from each other, and rows of one doc_id with different texts each lose the places found in any of them. An empty table gives an empty result. Columns beyond doc_id and text are not read.
    """
    merged = spans(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    both = _texts(docs).join(merged, "doc_id", "left").select("doc_id", "text", "found")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        got = [_cut_out(d, f) for d, f in zip(data, batch.column(2).to_pylist(), strict=True)]
        columns = [batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([g[3] for g in got], pa.binary())], [*names, "kept"]) if keep_text else pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(both, run, schema)
