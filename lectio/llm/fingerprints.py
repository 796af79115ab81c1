"""Document fingerprints: threshold-scaled sketches of character shingles.

Every shingle of SHINGLE code points is hashed to 32 bits and its hash is retained if it lies below
2**32 / SCALE. The retained set grows with the document, so sketches of very unequal documents still
estimate containment, and the sketch of a union comes from the sketches alone. So that short texts have
something to compare, the FLOOR least hashes stay too, wherever they lie. A sketch thus tells up to which
hash it is complete, and two sketches are compared up to the smaller of these limits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import mix, prefix_hash, range_hash, shuffle_width

SHINGLE, SCALE, FLOOR = 8, 16, 16
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketch(points: np.ndarray, scale: int = SCALE, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct retained hashes of a text's code points; a text shorter than k is one shingle."""
    if not len(points):
        return np.zeros(0, np.uint32)
    prefix = prefix_hash(mix(points.astype(np.uint64) + np.uint64(1)))
    start = np.arange(max(1, len(points) - k + 1))
    hashes = (range_hash(prefix, start, np.minimum(start + k, len(points))) >> np.uint64(32)).astype(np.uint32)
    kept = np.unique(hashes[hashes < 2**32 // scale])
    return kept if len(kept) >= FLOOR else np.unique(hashes)[:FLOOR]


def as_text(hashes: np.ndarray) -> str:
    """Retained hashes as ascending 8-digit hexadecimal numbers, joined."""
    return hashes.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents together."""
    both = np.union1d(a, b)
    return both[: max(FLOOR, int(np.searchsorted(both, 2**32 // scale)))]


def limit(hashes: np.ndarray, scale: int = SCALE) -> int:
    """The hash below which a sketch has all: no bound if it has fewer than FLOOR, which are all there are."""
    if len(hashes) < FLOOR:
        return 2**32
    return max(2**32 // scale, int(hashes[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Containment of the smaller document in the larger, and the Jaccard similarity, as the sketches tell them.

    Equal sketches give 1. Where a sketch has nothing below the limit of both, nothing is known to be shared, which gives 0.
    """
    if np.array_equal(a, b):
        return 1.0, 1.0
    most = min(limit(a), limit(b))
    a, b = a[: np.searchsorted(a, most)], b[: np.searchsorted(b, most)]
    if not len(a) or not len(b):
        return 0.0, 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / min(len(a), len(b)), both / (len(a) + len(b) - both)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of range and descending doc_id; each is finished when the next one is seen."""
    last = None
    for batch in batches:
        rows = []
        for block, doc_id, text, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            points = code_points(text)
            now = (block, doc_id, text, own, points, sketch(points))
            if last is not None and last[0] == block:
                rows.append(_finish(last, now))
            last = now
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())]))


def _finish(row: tuple, following: tuple) -> dict:
    _, doc_id, text, _, points, own = row
    cut_at = len(text) - len(text) // 3
    edited = text[:cut_at] + following[2][: len(text) // 3]
    changed = sketch(code_points(edited))
    near_edited, near_next = likeness(own, changed), likeness(own, following[5])
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": as_text(own),
        "edited_fingerprint": as_text(changed),
        "near_edited": near_edited[0],
        "near_next": near_next[0],
        "jaccard_edited": near_edited[1],
        "jaccard_next": near_next[1],
    }


def fingerprint(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document, and of a text edited with a part of the next document.

    The next document is the next one in descending doc_id, after the last the first. The edited text
    replaces the last floor(n / 3) code points by the first as many, or all, of the next one.

    Null texts count as empty; an empty text has an empty fingerprint, and is like another only if
    that one is empty too. Rows of equal doc_id, and of a null doc_id, which count as the least, are
    ordered by the hash of their text. A single row is its own next. An empty table gives an empty
    result. Columns beyond doc_id and text are not read. Each row is in memory once with its next.

    The rows go once through a shuffle into ranges of doc_id. The boundaries are percentiles of
    doc_id; the first row of each range is copied to the end of the range before it.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_width(spark)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    # Ranges count from the largest doc_id down; the list of boundaries has a fixed length.
    edges = F.broadcast(spark.createDataFrame([(bounds,)], "edges array<bigint>"))
    placed = rows.crossJoin(edges).withColumn("block", F.lit(len(bounds)) - _rank(F.col("edges"), order, len(bounds))).drop("edges")
    first = placed.groupBy("block").agg(F.max(F.struct(order.alias("o"), F.xxhash64("text").alias("h"))).alias("first"))
    # At most one row for each range.
    firsts = [(r["block"], r["first"]["o"], r["first"]["h"]) for r in first.collect()]
    firsts.sort()
    before = spark.createDataFrame([(firsts[i - 1][0], b, o, h) for i, (b, o, h) in enumerate(firsts)], "before int, block int, o bigint, h bigint")
    copies = placed.join(F.broadcast(before), "block").filter((order == F.col("o")) & (F.xxhash64("text") == F.col("h")))
    copies = copies.dropDuplicates(["block"]).select(F.col("before").alias("block"), "doc_id", "text", F.lit(False).alias("own"))
    both = placed.select("block", "doc_id", "text", F.lit(True).alias("own")).unionByName(copies)
    dealt = both.repartition(max(shuffle_width(spark), 1), "block").sortWithinPartitions(F.asc("block"), F.desc("own"), F.coalesce("doc_id", F.lit(-(2**63))).desc(), F.xxhash64("text").desc())
    return dealt.mapInArrow(_edited, SCHEMA)


def _rank(edges: Column, value: Column, n: int) -> Column:
    """How many of the n ascending edges are at most value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    further = lambda low, step: (low + step <= n) & (F.element_at(edges, F.least(low + step, F.lit(max(n, 1)))) <= value)
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(further(low, step), low + step).otherwise(low))
