"""Research-layer tables: pins, citations, revisions, gates, queues and trailing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.operators.order import cut, few
from lectio.operators.validate import resolve_ids

PUBLISHED = ("PUBLISHED", "REVISED")


def resolve_pins(pins: DataFrame, tokens: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Pins with resolved; none is dropped.

    With an id mapping between versions (see validate.resolve_ids) a pin is resolved if one of its token's successors is known.
    """
    known = tokens.select(F.col("token_id").alias("_k")).distinct()
    if mapping is not None:
        after = resolve_ids(pins.select("token_id").distinct(), mapping, "token_id")
        known = after.join(known, F.col("to") == F.col("_k"), "left_semi").select(F.col("from").alias("_k")).distinct()
    return pins.join(known, F.col("token_id") == F.col("_k"), "left").withColumn("resolved", F.col("_k").isNotNull()).drop("_k")


def flag_investigations(resolved: DataFrame) -> DataFrame:
    """(investigation_id, pins, unresolved, flagged)."""
    out = resolved.groupBy("investigation_id").agg(F.count("*").alias("pins"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return out.withColumn("flagged", F.col("unresolved") > 0)


def project_citations(pins: DataFrame, tokens: DataFrame) -> DataFrame:
    """(investigation_id, kind, key): what each pin cites; an unknown token cites itself alone."""
    known = tokens.select("token_id", "segment_id", "division", "root")
    joined = pins.select("investigation_id", "token_id").join(known, "token_id", "left")
    kinds = [("TOKEN", F.col("token_id")), ("SEGMENT", F.col("segment_id")), ("DIVISION", F.col("division").cast("string")), ("ROOT", F.col("root"))]
    cited = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds]), lambda s: s["key"].isNotNull())
    return joined.select("investigation_id", F.explode(cited).alias("c")).select("investigation_id", "c.kind", "c.key").distinct()


#: Buckets of a stored citation table.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("investigation_id"), F.lit(BUCKETS)).cast("int")


def replace_citations(path: str, replaced: DataFrame, citations: DataFrame) -> None:
    """Replace all citations of the investigations in ``replaced`` in a stored table by those in ``citations``.

    Investigations are dealt to buckets, which are the table's partitions; only buckets of replaced
    investigations are written, by dynamic partition overwrite, from what they hold of others and what is new. Doing it
    again changes nothing. A bucket that loses its last row keeps a row without a kind, which stored_citations leaves out.
    """
    spark = citations.sparkSession
    ids = replaced.select("investigation_id").distinct()
    touched = few(ids.select(_bucket().alias("bucket")).distinct())
    new = citations.join(ids, "investigation_id", "left_semi").select("investigation_id", "kind", "key").distinct().withColumn("bucket", _bucket())
    empty = touched.select(F.lit(None).cast(citations.schema["investigation_id"].dataType).alias("investigation_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"), "bucket")
    out = new.unionByName(empty)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        held = spark.read.parquet(path).join(touched, "bucket", "left_semi").filter("kind is not null")
        out = out.unionByName(held.join(ids, "investigation_id", "left_anti").select(out.columns))
    # What is read is cut from the files before they are overwritten.
    cut(out).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_citations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("kind is not null").select("investigation_id", "kind", "key")


def citing(citations: DataFrame, investigations: DataFrame, authors: DataFrame) -> DataFrame:
    """Citations of published investigations, with their author; newest first within (kind, key) by rank."""
    shown = investigations.filter(F.col("status").isin(*PUBLISHED)).join(authors, "author_id", "left")
    order = F.row_number().over(W.partitionBy("kind", "key").orderBy(F.desc("updated"), "investigation_id"))
    return citations.join(shown, "investigation_id").withColumn("rank", order)


def append_revisions(log: DataFrame, edits: DataFrame) -> DataFrame:
    """The log with edits numbered on from each investigation's last revision, in time order."""
    last = log.groupBy("investigation_id").agg(F.max("revision").alias("_last"))
    number = F.row_number().over(W.partitionBy("investigation_id").orderBy("ts", "edit_id"))
    new = edits.join(last, "investigation_id", "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + number).drop("_last")
    return log.unionByName(new, allowMissingColumns=True)


def heads(log: DataFrame) -> DataFrame:
    """Each investigation's last revision."""
    return log.groupBy("investigation_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "investigation_id"]), "revision").alias("h")).select("investigation_id", "h.*")


def status_after_edit(status: Column) -> Column:
    return F.when(status == "DRAFT", status).otherwise(F.lit("REVISED"))


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that holds, in order; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules])


def publish_gate(asked: DataFrame, investigations: DataFrame, users: DataFrame, query_counts: DataFrame, recent: DataFrame, most: int) -> DataFrame:
    """(investigation_id, failure): the first reason against publishing, or null.

    investigations: investigation_id, author_id, claim, counter_evidence; users: author_id, terms,
    verified; query_counts: investigation_id, ok, total; recent: author_id, actions.
    """
    rows = asked.select("investigation_id").join(investigations.withColumn("_found", F.lit(True)), "investigation_id", "left").join(users, "author_id", "left").join(query_counts, "investigation_id", "left").join(recent, "author_id", "left")
    claim = F.trim(F.coalesce("claim", F.lit("")))
    failure = first_failure(
        ("not_found", F.col("_found").isNull()),
        ("terms", ~F.coalesce("terms", F.lit(False))),
        ("unverified", ~F.coalesce("verified", F.lit(False))),
        ("claim_empty", claim == ""),
        ("claim_long", F.length(claim) > 280),
        ("counter_evidence", F.trim(F.coalesce("counter_evidence", F.lit(""))) == ""),
        ("query_invalid", ~F.coalesce("ok", F.lit(False))),
        ("no_hits", F.coalesce("total", F.lit(0)) == 0),
        ("rate_limited", F.coalesce("actions", F.lit(0)) >= most),
    )
    return rows.select("investigation_id", failure.alias("failure"))


def response_gate(responses: DataFrame, pins: DataFrame, investigations: DataFrame, recent: DataFrame, most: int, types: Sequence[str]) -> DataFrame:
    """(response_id, failure): the first reason against a response, or null."""
    counts = pins.groupBy("response_id").agg(F.count("*").alias("pins"))
    known = investigations.select("investigation_id", F.lit(True).alias("_found")).distinct()
    rows = responses.join(counts, "response_id", "left").join(known, "investigation_id", "left").join(recent, "author_id", "left")
    failure = first_failure(
        ("type", ~F.coalesce(F.col("type").isin(*types), F.lit(False))),
        ("evidence", F.coalesce("pins", F.lit(0)) < 1),
        ("body", F.trim(F.coalesce("body", F.lit(""))) == ""),
        ("not_found", F.col("_found").isNull()),
        ("rate_limited", F.coalesce("actions", F.lit(0)) >= most),
    )
    return rows.select("response_id", failure.alias("failure"))


def visible_to(investigations: DataFrame, viewer) -> DataFrame:
    return investigations.filter(F.col("status").isin(*PUBLISHED) | (F.col("author_id") == F.lit(viewer)))


def moderation_queue(reports: DataFrame, k: int = 100) -> DataFrame:
    return reports.filter(F.col("status").isin("OPEN", "REVIEWING")).orderBy("created", "report_id").limit(k)


def trailing_counts(events: DataFrame, seconds: int) -> DataFrame:
    """Add recent: the events of the same kind and subject from ``seconds`` before an event to it, both ends included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    over = W.partitionBy("kind", "subject").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(over))


def supporters(payments: DataFrame) -> DataFrame:
    """(ref, status, first_success, successes) from replayed payment events: a reference succeeds once and never goes back."""
    good = F.col("status") == "SUCCEEDED"
    return payments.groupBy("ref").agg(F.when(F.bool_or(good), "SUCCEEDED").otherwise("PENDING").alias("status"), F.min(F.when(good, F.col("ts"))).alias("first_success"), F.count_if(good).alias("replays"))
