"""Checks of artifacts, versions and inventories; violations come out as rows."""

from __future__ import annotations

from codecs import BOM_UTF8 as BOM
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import digest
from lectio.operators.build import BuildError
from lectio.operators.order import written


def missing_keys(df: DataFrame, required: Sequence[str], key: str, table: str) -> DataFrame:
    """(check, key): rows where a required column is null."""
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{table}.{c} missing")) for c in required]), lambda x: x.isNotNull())
    return df.select(F.explode(gaps).alias("check"), F.col(key).cast("string").alias("key"))


def repeated_ids(df: DataFrame, key: str, table: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"{table}.{key} repeated").alias("check"), F.col(key).cast("string").alias("key"))


def orphans(df: DataFrame, column: str, of: DataFrame, key: str, table: str) -> DataFrame:
    """Rows whose reference has no target; null references are no violation."""
    known = of.select(F.col(key).alias("_k")).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_k"), "left_anti").select(F.lit(f"{table}.{column} unknown").alias("check"), F.col(column).cast("string").alias("key"))


def count_differs(df: DataFrame, expected: int, table: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).filter(F.col("n") != expected).select(F.lit(f"{table} count").alias("check"), F.col("n").cast("string").alias("key"))


def violations(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


#: Bytes of a file that a task reads at most; larger files are hashed piece after piece.
PIECE = 128 << 20
#: Names whose bytes Spark's text source would decompress.
CODED = r"\.(deflate|gz|bz2|lz4|snappy|zst)$"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, n, content) of runs of lines of a file's split, with their line ends; ``at`` orders a file's runs."""
    before, at = None, 0
    for batch in batches:
        names, starts, lines = batch.columns
        other = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(starts[1:], starts[:-1])).to_numpy(zero_copy_only=False)
        rows = []
        for a, b in pairwise([0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]):
            if b > a:
                here = names[a].as_py(), starts[a].as_py()
                before, at = here, at if here == before else here[1]
                rows.append({"file": here[0], "at": at, "n": 0, "content": b"\n".join([*lines[a:b].to_pylist(), b""])})
                rows[-1]["n"] = len(rows[-1]["content"])
                at += rows[-1]["n"]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("content", pa.binary())]))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, state, fed) after a file's runs, which follow a row with its state, bytes hashed and length."""
    done, now = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r["length"] is not None:
                now = {"id": r["id"], "state": r["content"], "fed": r["fed"]}
                length = r["length"]
                done.append(now)
            else:
                # A last line without an end got one.
                content = r["content"][: length - now["fed"]]
                now |= {"state": digest.fed(now["state"], content), "fed": now["fed"] + len(content)}
    yield pa.RecordBatch.from_pylist(done, pa.schema([("id", pa.int32()), ("state", pa.binary()), ("fed", pa.int64())]))


def _in_pieces(spark: SparkSession, path: str, large: dict[str, tuple[str, int]]) -> DataFrame:
    """The inventory of large files. Lines are read by splits and written as runs; then a round for each piece of
    PIECE bytes hands every file's state on, so that a task reads one piece of one file. One row a large file
    comes to the driver each round."""
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    text = text.filter((F.col("_metadata.file_size") > PIECE) & ~F.col("_metadata.file_path").rlike(CODED))
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    runs = lines.mapInArrow(_joined, "file string, at bigint, n bigint, content binary").withColumn("piece", F.expr(f"cast(at div {PIECE} as int)"))
    runs = written(runs, "piece")
    sizes = {r["file"]: r["n"] for r in runs.groupBy("file").agg(F.sum("n").alias("n")).collect()}
    order = sorted(large, key=lambda f: -sizes.get(f, 0))
    states = []
    for f in order:
        # The text source leaves out a byte order mark and ends each line.
        more = sizes.get(f, 0) - large[f][1]
        if more not in (1, 0, -2, -3):
            raise BuildError(f"{f}: {more} bytes too many were read; it changed meanwhile or is compressed")
        states.append((digest.fed(digest.started(), BOM), len(BOM)) if more < 0 else (digest.started(), 0))
    ids = F.broadcast(spark.createDataFrame([(f, i) for i, f in enumerate(order)], "file string, id int"))
    for piece in range(-(-max(sizes.values()) // PIECE)):
        n = sum(sizes[f] > piece * PIECE for f in order)
        own = spark.createDataFrame([(i, -1, *states[i], large[order[i]][1]) for i in range(n)], "id int, at bigint, content binary, fed bigint, length bigint")
        rows = own.unionByName(runs.filter(F.col("piece") == piece).join(ids, "file").select("id", "at", "content"), allowMissingColumns=True)
        for r in rows.repartitionById(n, F.col("id")).sortWithinPartitions("id", "at").mapInArrow(_chained, "id int, state binary, fed bigint").collect():
            states[r["id"]] = (bytes(r["state"]), r["fed"])
    return spark.createDataFrame([(large[f][0], digest.finished(state), fed) for f, (state, fed) in zip(order, states, strict=True)], "file string, sha256 string, bytes bigint")


def checksum_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of every file below a folder, by its path from there.

    A file of at most PIECE bytes is read whole by one task. Larger ones are read in pieces, one after the
    other, since a digest needs the bytes in order; a task reads one piece. Only names that Spark's
    readers would decompress are read whole whatever their size, and fail above 2 GB. Spark lists neither
    empty files nor names that begin with _ or a dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = "/" + path.rstrip("/").rpartition("/")[2] + "/"
    # Spark prunes files by these two columns before it opens any.
    whole = (F.col("_metadata.file_size") <= PIECE) | F.col("_metadata.file_path").rlike(CODED)
    file = F.substring_index("path", below, -1).alias("file")
    out = files.filter(whole).select(file, F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    large = {r["key"]: (r["file"], r["length"]) for r in files.filter(~whole).select(F.col("_metadata.file_path").alias("key"), file, "length").collect()}
    return out.unionByName(_in_pieces(spark, path, large)) if large else out


def verify_checksums(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem): missing, unlisted, sha256 or size."""
    both = found.select("file", F.col("sha256").alias("a"), F.col("bytes").alias("m")).join(manifest.select("file", F.col("sha256").alias("b"), F.col("bytes").alias("n")), "file", "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unlisted").when(F.col("a") != F.col("b"), "sha256").when(F.col("m") != F.col("n"), "size")
    return both.withColumn("problem", problem).filter("problem is not null").select("file", "problem")


def diff_versions(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status): added, removed or changed."""
    a, b = old.select(F.col(key).alias("key"), F.col(text).alias("a"), F.lit(1).alias("in_a")), new.select(F.col(key).alias("key"), F.col(text).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "key", "full_outer").withColumn("status", status).filter("status is not null").select("key", "status")


def resolve_ids(ids: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(from, to): successors of ids; split ones explode, tombstones give null, unmapped ones stay."""
    rules = mapping.select(F.col("from").alias("_from"), "status", F.col("to").alias("_to"))
    joined = ids.select(F.col(key).alias("from")).join(rules, F.col("from") == F.col("_from"), "left")
    to = F.when(F.col("status") == "tombstone", F.array(F.lit(None).cast("string"))).otherwise(F.coalesce("_to", F.array("from")))
    return joined.select("from", F.explode_outer(to).alias("to"))


def roundtrip_check(tokens: DataFrame, verses: DataFrame) -> DataFrame:
    """(division, slot, problem): verses whose words and marks don't give the text back, or whose positions have gaps; a verse without words has to be blank or marks alone."""
    parts = F.array_join(F.concat(F.array("word"), F.col("following_marks")), " ")
    own = tokens.withColumn("part", parts).groupBy("division", "slot").agg(
        F.array_sort(F.collect_list(F.struct("position", "part"))).alias("parts"), F.max(F.when(F.col("position") == 1, F.col("leading_marks"))).alias("leading"), F.max("position").alias("last"), F.count("*").alias("n")
    )
    text = F.array_join(F.concat("leading", F.col("parts")["part"]), " ")
    lost = F.col("n").isNull() & F.col("text").rlike(r"\p{L}")
    problem = F.when(lost, "words").when(F.col("n") != F.col("last"), "positions").when(text != F.col("text"), "text")
    return verses.select("division", "slot", "text").join(own, ["division", "slot"], "left").withColumn("problem", problem).filter("problem is not null").select("division", "slot", "problem")


def licence_groups(files: DataFrame, rules: Sequence[tuple[str, str]], display_only: DataFrame | None = None) -> DataFrame:
    """(group, files, bytes): files grouped by the first path pattern that fits, in rule order; empty groups are left out."""
    group = F.coalesce(*[F.when(F.col("file").rlike(p), F.lit(i)) for i, (_, p) in enumerate(rules)])
    kept = files if display_only is None else files.join(display_only, "file", "left_anti")
    names = F.array(*[F.lit(n) for n, _ in rules])
    out = kept.withColumn("i", group).filter("i is not null").groupBy("i").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return out.select(F.get(names, F.col("i")).alias("group"), F.col("i").alias("rank"), "files", "bytes")


def compare_counts(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """(table, a, b, status): tables of two stores whose row counts differ or that one lacks."""
    counts = lambda store, name: reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table"), name) for t, df in store.items()])
    both = counts(a, "a").join(counts(b, "b"), "table", "full_outer")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "mismatch")
    return both.withColumn("status", status).filter("status is not null")


def positions_are_contiguous(tokens: DataFrame) -> DataFrame:
    """Tokens that don't follow the one before them."""
    before = F.lag("position", 1, 0).over(W.partitionBy("division", "slot").orderBy("position"))
    return tokens.withColumn("_before", before).filter("position != _before + 1").drop("_before")
