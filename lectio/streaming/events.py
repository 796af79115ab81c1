"""Streams of application events: sliding-window admission and idempotent payments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "kind string, subject string, event_id bigint, ts timestamp, allowed boolean, remaining int"


def admit_times(times: list[int], held: list[int], most: int, window: int) -> tuple[list[tuple[bool, int]], list[int]]:
    """For ascending times in microseconds: (allowed, remaining) each, and the admitted times to hold.

    Only admitted events count against later ones; those at or before time minus window are forgotten.
    """
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        if allowed := len(held) < most:
            held.append(t)
        out.append((allowed, most - len(held)))
    return out, held


def _admitted(key: tuple, frame: pd.DataFrame, held: list[int], most: int, window: int) -> tuple[pd.DataFrame, list[int]]:
    frame = frame.sort_values(["ts", "event_id"])
    got, held = admit_times([int(t.value // 1000) for t in frame["ts"]], held, most, window)
    out = pd.DataFrame({"kind": key[0], "subject": key[1], "event_id": frame["event_id"].to_numpy(), "ts": frame["ts"].to_numpy(), "allowed": [a for a, _ in got], "remaining": [r for _, r in got]})
    return out, held


def admit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """Admission of a finite table of events (kind, subject, event_id, ts), in time order for each kind and subject.

    Where a subject pauses for the window or longer nothing is held, so its events are cut there and the
    pieces dealt out; a task streams through its pieces and holds at most ``most`` times.
    """
    window = seconds * 1_000_000
    rows = events.select("kind", F.col("subject").cast("string").alias("subject"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    order = W.partitionBy("kind", "subject").orderBy("ts", "event_id")
    pause = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) >= window
    pieces = rows.withColumn("_pause", F.coalesce(pause, F.lit(False)).cast("int")).withColumn("_piece", F.sum("_pause").over(order.rowsBetween(W.unboundedPreceding, 0)))
    key = ["kind", "subject", "_piece"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for frame in frames:
            allowed, remaining = [], []
            for kind, subject, piece, ts in zip(frame["kind"], frame["subject"], frame["_piece"], frame["ts"], strict=True):
                if (kind, subject, piece) != now:
                    now, held = (kind, subject, piece), []
                ((ok, left),), held = admit_times([int(ts.value // 1000)], held, most, window)
                allowed.append(ok)
                remaining.append(left)
            yield frame[["kind", "subject", "event_id", "ts"]].assign(allowed=allowed, remaining=remaining)

    return pieces.select(*key, "event_id", "ts").repartition(*key).sortWithinPartitions(*key, "ts", "event_id").mapInPandas(run, ADMITTED)


def admit_stream(events: DataFrame, most: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Admission of a stream: the state of a key is its admitted times, at most ``most``, dropped when the window has passed.

    Events later than the watermark are dropped by Spark before they get here.
    """
    window = seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames))
        out, held = _admitted(key, frame, held, most, window)
        state.update((held,))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1) if held else state.getCurrentWatermarkMs() + 1)
        yield out

    rows = events.select("kind", F.col("subject").cast("string").alias("subject"), "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("kind", "subject").applyInPandasWithState(step, ADMITTED, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def first_payments(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of payment events (ref, status, ts) without replays of one reference and status inside the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ref", "status"])


def settled(payments: DataFrame) -> DataFrame:
    """The payments table (ref, status, first_success) of rows (ref, status, first_success): a success stays, and its first time is the least."""
    good = F.bool_or(F.col("status") == "SUCCEEDED")
    return payments.groupBy("ref").agg(F.when(good, "SUCCEEDED").otherwise("PENDING").alias("status"), F.min("first_success").alias("first_success"))


def payments_sink(path: str):
    """A foreachBatch function that adds each epoch's payments (ref, status, ts) to a table below a folder, a partition for each epoch.

    An epoch that runs again writes the same partition, so replays change nothing; others aren't touched.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("ref", "status", F.when(F.col("status") == "SUCCEEDED", F.col("ts")).alias("first_success"))
        settled(rows).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return add


def payments_table(spark: SparkSession, path: str) -> DataFrame:
    """The payments table over all epochs of a sink."""
    return settled(spark.read.parquet(path).drop("epoch"))
