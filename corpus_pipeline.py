"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, PII, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as
Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm import decontamination, language, near_duplicates, pieces, pseudonyms
from lectio.llm.common import checkpoint_folder, free_name, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a text that is null, empty or has no letter is rejected, and no other.

    lang becomes the predicted language where it is null; it stays null if no text is labelled. Long
    texts are read whole; repeated rows are kept alike; all columns stay, whatever their names; an empty
    table gives an empty one.
    """
    model = language.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred = free_name(docs, "_lang_pred")
    told = language.identify(docs, model, pred, free_name(docs, "_lang_score")).filter(F.col(pred) != "und")
    return told.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id (five-word shingles, similarity 0.8 or more).

    Null, empty and blank texts have no duplicates and stay, and so do rows without a doc_id. Rows that
    share a kept doc_id all stay. Texts are compared whole; all columns stay; an empty table gives an empty one.
    """
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their doc_id.

    Null and empty texts hold nothing and stay; long texts are searched whole; repeated rows are treated
    alike; all columns stay, whatever their names; an empty table or benchmark takes nothing away.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal numbers and dates replaced by their pseudonyms; n_chars, where there is one, follows.

    Null texts stay null and empty ones empty; all rows and columns stay, whatever their names; equal
    values get equal pseudonyms in all rows; an empty table gives an empty one.
    """
    out = pseudonyms.pseudonymise(docs, counts=free_name(docs, "_pii"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens, and round_trip: whether the tokens give the text back.

    A null text counts as empty. A name that documents have already gets underscores. Long texts are
    encoded whole; all rows and columns stay; repeated rows get equal tokens; an empty table gives an empty one.
    """
    tokens, decoded, told = (free_name(docs, name) for name in ("tokens", "decoded", "round_trip"))
    out = pieces.encode(docs, ids=tokens, decoded=decoded)
    return out.withColumn(told, F.col(decoded) == F.coalesce(F.col("text").cast("string"), F.lit(""))).drop(decoded)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", pii), ("pieces", encode)]

#: The stages on learned models and minhash trees can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
