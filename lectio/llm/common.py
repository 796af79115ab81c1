"""What the operators share: tables, lineage cuts, column coercion and vectorised text hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multiplier of the rolling polynomial, modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset on one machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a compressed table in the shared folder, smaller than a checkpoint where values recur."""
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this worker process keeps between tasks.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """One object that a worker keeps between tasks, that of the work at hand: what it kept for other work goes first."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    return _kept[key]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, kept: list[str]) -> tuple[DataFrame, int]:
    """The columns ``kept`` and the place among them of text as a string; it is added at the end if it isn't there as one."""
    rows = [F.col(f"`{c}`") for c in kept]
    if "text" in kept and docs.schema["text"].dataType == StringType():
        return docs.select(*rows), kept.index("text")
    return docs.select(*rows, F.col("text").cast("string").alias(free_name(docs, "_text"))), len(kept)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows, of two numbers each at most, that may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """Mark rows of one or two numbers for a broadcast if there are at most ``most``, BROADCAST_ROWS if not given; their lineage is cut."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def of_ids(df: DataFrame, key: Column, ids: DataFrame, most: int, inside: bool = True) -> DataFrame:
    """Rows whose key, a whole number, is among the ids (one column doc_id), or those whose key isn't.

    Ids go out as one row for all of 64 numbers, a bit for each, so ids that stand close take a small part of a row each.
    If that makes more than ``most`` rows, they are joined by a shuffle.
    """
    word, bits, at = (free_name(df, name) for name in ("_word", "_bits", "_at"))
    own = F.col("doc_id").cast("bigint")
    words = ids.filter(own.isNotNull()).groupBy(F.shiftright(own, 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(cast(doc_id as bigint) & 63 as int)))").alias(bits))
    rows = df.withColumn(at, key.cast("bigint")).withColumn(word, F.shiftright(at, 6)).join(few(words, most), word, "inner" if inside else "left")
    there = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{at}` & 63 as int)) & 1") == 1, F.lit(False))
    return rows.filter(there == F.lit(inside)).select([F.col(f"`{c}`") for c in df.columns])


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 2_000) -> DataFrame:
    """mapInArrow over record batches, cut to at most ``rows``; a batch may give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(k, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * MIX2
    return h ^ (h >> np.uint64(31))


#: A random-looking 64-bit value for each byte, from a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(BASE, -1, 2**64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (np.uint64(BASE), self.inverse))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of values[j] * BASE**j for j < i, modulo 2**64; values uint64."""
    up, _ = POWERS.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each range [start, end) of what prefix_hash has summed."""
    _, down = POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles.

    A-Z are lower-cased and words are what ASCII white space (0x20, 0x09-0x0D) separates. With fewer
    than n words the whole sequence is the one shingle; null, empty and blank texts give an empty set.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    prefix = prefix_hash(BYTE_VALUES[line])
    spaces = np.flatnonzero(line == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(line)]))
    k = min(n, len(words))
    return np.unique(range_hash(prefix, starts[: len(starts) - k + 1], ends[k - 1 :]))
