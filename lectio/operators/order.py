"""Global order without a global sort: running sums from trees of partial sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A block is a run of 2**STEP values of a key; blocks of blocks are made until at most 2**(64 - TOP) are left.
STEP, TOP = 12, 48


def _shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; unset, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """The same rows from a compressed table in the shared folder, in partitions by columns: smaller than a checkpoint where values recur."""
    path = f"{_shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, of a short value each, that may be broadcast; more are joined by a shuffle.
FEW = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """The rows, cut from their lineage and marked for a broadcast if there are at most FEW."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def _offsets(sums: DataFrame, bits: int) -> DataFrame:
    """(_block, _offset): the sum over all blocks before, from (_block, _sum), whose blocks drop ``bits`` bits of the key.

    A window holds the 2**STEP blocks of one block of blocks; the last one the few that are left at the top.
    """
    before = W.orderBy("_block") if bits >= TOP else W.partitionBy("_above").orderBy("_block")
    inside = F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if bits >= TOP:
        return sums.select("_block", inside.alias("_offset"))
    keyed = sums.withColumn("_above", F.shiftright("_block", STEP))
    above = _offsets(keyed.groupBy(F.col("_above").alias("_block")).agg(F.sum("_sum").alias("_sum")), bits + STEP)
    joined = keyed.join(above.select(F.col("_block").alias("_above"), "_offset"), "_above")
    return joined.select("_block", (F.col("_offset") + inside).alias("_offset"))


def running_before(df: DataFrame, key: str, amount: Column, name: str, then: list[str] | None = None) -> DataFrame:
    """Add the sum of ``amount`` over the rows that come before in (key, then...); key is a whole number and not null.

    Rows of a block of keys are summed by a window, and blocks by a tree of sums whose levels shrink by up to
    2**STEP each, so no task gets all rows, whatever the keys. Nothing runs before the plan is asked for. The
    rows of one key are ordered in one task. ``df`` is read for the rows and for the sums.
    """
    keyed = df.withColumn("_amount", amount).withColumn("_block", F.shiftright(F.col(key).cast("bigint"), STEP))
    offsets = _offsets(keyed.groupBy("_block").agg(F.sum("_amount").alias("_sum")), STEP)
    inside = W.partitionBy("_block").orderBy(key, *(then or [])).rowsBetween(W.unboundedPreceding, -1)
    out = keyed.join(offsets, "_block").withColumn(name, F.col("_offset") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return out.drop("_block", "_amount", "_offset")
