"""Readers of editions, annotations and lexica, and the artifact reader and writer."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectio.operators.build import refuse


def read_verse_lines(spark: SparkSession, path: str) -> DataFrame:
    """(division, slot, text) of lines ``division|slot|text``; other lines are left out and text is never trimmed."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\d+\|\d+\|"))
    part = lambda i: F.regexp_extract("value", r"^(\d+)\|(\d+)\|(?s)(.*)$", i)
    return lines.select(part(1).cast("int").alias("division"), part(2).cast("int").alias("slot"), part(3).alias("text"))


def read_division_metadata(spark: SparkSession, path: str, tag: str = "sura") -> DataFrame:
    """One row for each division element's attributes, by number."""
    attributes = {"index": "int", "ayas": "int", "name": "string", "tname": "string", "ename": "string", "type": "string", "order": "int"}
    schema = ", ".join(f"_{a} {k}" for a, k in attributes.items())
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(F.col("_index").alias("division"), F.col("_ayas").alias("verses"), F.col("_name").alias("name"), F.col("_tname").alias("name_translit"), F.col("_ename").alias("name_en"), F.col("_type").alias("place"), F.col("_order").alias("revealed")).orderBy("division")


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    """(division, slot, word, part, form, coarse, tags) of lines ``d:s:w:p<TAB>form<TAB>class<TAB>tag|tag``."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("location string, form string, coarse string, tags string").csv(path)
    at = F.split("location", ":")
    return rows.filter("location is not null and trim(location) != ''").select(
        *[F.get(at, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("division", "slot", "word", "part"))],
        "form",
        "coarse",
        F.filter(F.split(F.coalesce("tags", F.lit("")), r"\|"), lambda t: t != "").alias("tags"),
    )


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text), from 1, of one file whose line number is the key; one trailing empty line is no line.

    Offsets of partitions come from their counts, so numbering needs no sort.
    """
    lines = spark.read.text(path).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_offset"), F.sum("_n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_total"))
    numbered = lines.join(F.broadcast(offsets), "_part").withColumn("line_no", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
    return numbered.filter(~((F.col("line_no") == F.col("_total")) & (F.col("value") == ""))).select("line_no", F.col("value").alias("text"))


def read_edition(spark: SparkSession, path: str, field: str = "quran") -> DataFrame:
    """(division, slot, text) of a JSON edition, an object with a list or the bare list; a repeated verse fails."""
    verse = "struct<chapter:int,verse:int,text:string>"
    whole = spark.read.option("wholetext", "true").text(path)
    listed = F.coalesce(F.from_json("value", f"{field} array<{verse}>")[field], F.from_json("value", f"array<{verse}>"))
    rows = whole.select(F.explode(listed).alias("v")).select(F.col("v.chapter").alias("division"), F.col("v.verse").alias("slot"), F.col("v.text").alias("text"))
    refuse(rows.groupBy("division", "slot").agg(F.count("*").alias("n")).filter("n > 1"), "repeated verses")
    return rows


def _text_of(element: ET.Element, decode: Callable[[str], str], skip: tuple[str, ...]) -> str:
    out = [element.text or ""]
    if element.tag == "foreign" and element.get("lang") == "ar":
        out = [decode(element.text or "")]
    for child in element:
        if child.tag not in skip:
            out.append(_text_of(child, decode, skip))
        out.append(child.tail or "")
    return "".join(out)


def read_lexicon_articles(spark: SparkSession, path: str, decode: Callable[[str], str] = lambda s: s, skip: tuple[str, ...] = ("itype", "head")) -> DataFrame:
    """(file, doc_order, key, text) of every root article of TEI files, in document order.

    Inline Arabic is decoded, the elements of ``skip`` are dropped, entries are parted by blank lines
    and runs of white space are squeezed. Files are read one a row.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for i, article in enumerate(x for x in ET.fromstring(content).iter("div2") if x.get("type") == "root"):
                    entries = [" ".join(_text_of(e, decode, skip).replace("*", " ").split()) for e in article.iter("entryFree")]
                    rows.append((name.rsplit("/", 1)[-1], i, article.get("n"), "\n\n".join(e for e in entries if e)))
            yield pd.DataFrame(rows, columns=["file", "doc_order", "key", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(walk, "file string, doc_order int, key string, text string")


def read_artifacts(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """A released JSON table with a fixed schema; bad JSON fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(multiline).lower()).json(path)


def write_artifacts(df: DataFrame, path: str, order: list[str], fmt: str = "json", partitions: int | None = None) -> None:
    """Write rows in corpus order: a range for each file, sorted inside; no task gets them all."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").format(fmt).save(path)
