"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Each (key, shard) pair gets a pseudo-random cost -ln(u) / weight and a record goes to the shard of
least cost. Adding a shard changes a record's place only if the new shard wins, so just the new
shard's share of the records moves, and shards of weight w get w / sum(w) of the records.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of the key's hash that cut a shard's slot numbering into independent ranges.
SLOT_BITS = 12


def hash52(text: Column) -> Column:
    """The first 52 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def key_of(name: str) -> Column:
    """A record's stable key as text; null has a key of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def cost(key: Column, shard: int, weight: float) -> Column:
    u = (hash52(F.concat(key, F.lit(f"/{shard}"))) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(weight))


def assign(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of least cost for a key; ties go to the smaller shard."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("each shard needs a weight above 0")
    return F.array_min(F.array(*[F.struct(cost(key, s, w).alias("c"), F.lit(s).alias("s")) for s, w in sorted(weights.items())]))["s"]


def with_slots(df: DataFrame, shard: str, hashed: str, order: list[str]) -> DataFrame:
    """Add slot: the 0-based place of a row in its shard by (hashed, order), without a window over a whole shard.

    The key's hash cuts each shard into 2**SLOT_BITS ranges; their counts (at most shards times that
    many rows, whatever the input) become offsets, and rows are numbered inside their small range.
    """
    ranged = df.withColumn("_range", F.shiftright(hashed, 52 - SLOT_BITS))
    counts = ranged.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(shard, "_range").orderBy(hashed, *order))
    return ranged.join(F.broadcast(offsets), [shard, "_range"]).withColumn("slot", F.col("_offset") + inside - 1).drop("_range", "_offset")


def shard_documents(docs: DataFrame, shards: int = 16, weights: Mapping[int, float] | None = None, grown: int = 1) -> DataFrame:
    """Put every document into one shard by its doc_id, under the law ``key``.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32 (unsigned), law, shard, slot (gapless from 0
    in each shard, by the hash of the key) and grown_shard (the place if ``grown`` more shards of the
    first shard's weight were added).

    Null and empty texts have size 1 and checksum 0. A null doc_id is a key of its own. Repeated rows
    share a shard and have slots of their own. An empty table gives an empty result; other columns of
    the input, whatever their names, are not read. Very long texts only cost their checksum.
    """
    weights = dict(weights or {s: 1.0 for s in range(shards)})
    more = weights | {max(weights) + 1 + i: weights[min(weights)] for i in range(grown)}
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    key = key_of("doc_id")
    placed = rows.withColumns({"law": F.lit("key"), "shard": assign(key, weights), "grown_shard": assign(key, more), "_hash": hash52(key)})
    out = with_slots(placed, "shard", "_hash", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
