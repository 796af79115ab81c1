"""The given tables as the library's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectio.functions import text as X
from lectio.operators import build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = (docs if only is None else docs.join(only, "doc_id", "left_semi")).select(F.col("doc_id").alias("division"), "lang", F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("lines"))
    return docs.filter(F.size("lines") > 0)


def _by_line(lines: DataFrame, *others: str) -> DataFrame:
    return lines.select("division", *others, F.posexplode("lines").alias("at", "text")).withColumn("slot", F.col("at") + 1).drop("at")


def verses(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """division = doc_id; slot = 1-based place among the non-empty lines; is_formula: a first line that others have too."""
    lines = (lines if lines is not None else _lines(spark, sf_dir)).withColumn("first", F.col("lines")[0])
    recurring = lines.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select("first", F.lit(True).alias("recurs"))
    rows = _by_line(lines.join(recurring, "first", "left"), "lang", "recurs")
    return rows.select("division", "lang", "slot", (F.coalesce("recurs", F.lit(False)) & (F.col("slot") == 1)).alias("is_formula"), "text")


def texts(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """division, slot and text of verses; no text is joined with anything. ``only``: the documents (doc_id) that are asked for."""
    return _by_line(_lines(spark, sf_dir, only))


def plain(c):
    """Lower case, letters only."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}]+", ""))


def has_letter(piece):
    return piece.rlike(r"\p{L}")


def _bare(c):
    """A text with the letters of its words alone, in lower case; spaces stay, so its pieces are those of the text."""
    return F.lower(F.regexp_replace(c, r"[^\p{L} ]+", ""))


def _words(source: DataFrame) -> DataFrame:
    """(position, word, form, _hard) of verses: each pattern runs once over a text, not once over each of its words."""
    pieces = lambda c: F.split(c, " ", -1)
    rows = source.withColumn("_bare", _bare(F.col("text")))
    whole = F.arrays_zip(pieces("text").alias("word"), pieces("_bare").alias("form"), pieces(F.regexp_replace("_bare", "[^bcdfghjklmnpqrstvwxyz ]+", "")).alias("hard"))
    keep = [c for c in source.columns if c != "text"]
    rows = rows.select(*keep, F.posexplode(F.filter(whole, lambda s: s["form"] != "")).alias("_at", "_w"))
    return rows.select(*keep, (F.col("_at") + 1).alias("position"), "_w.word", "_w.form", F.substring("_w.hard", 1, 3).alias("_hard"))


def tokens(spark: SparkSession, sf_dir: str, handles: bool = True, of: DataFrame | None = None, places: bool = False) -> DataFrame:
    """Words of verses with form, root, lemma and pos by simple rules, their handle, and their places in the text if asked for."""
    lines = _lines(spark, sf_dir) if of is None else None
    source = of if of is not None else verses(spark, sf_dir, lines)
    if handles:
        texts = (_by_line(lines) if of is None else of).select("division", "slot", _bare(F.col("text")).alias("text"))
        source = build.with_offsets(source, lambda piece: piece != "", texts=texts)
    form = F.col("form")
    if places:
        out = build.segment(source, has_letter, places).withColumn("form", plain(F.col("word"))).withColumn("_hard", F.substring(F.regexp_replace(form, "[^bcdfghjklmnpqrstvwxyz]+", ""), 1, 3))
    else:
        out = _words(source)
    letters = [F.nullif(F.substring("_hard", k, 1), F.lit("")) for k in (1, 2, 3)]
    out = out.withColumn("root", F.when(F.length("_hard") >= 2, F.concat_ws("-", *letters))).drop("_hard").withColumn("lemma", X.stem(form))
    pos = F.when(F.length(form) <= 3, "P").when(form.endswith("ing") | form.endswith("ed"), "V").otherwise("N")
    out = out.withColumn("pos", pos).withColumn("segment_id", F.concat_ws(":", "division", "slot")).withColumn("token_id", F.concat_ws(":", "division", "slot", "position"))
    return out.withColumn("handle", F.col("before") + F.col("position") - 1).drop("before") if handles else out


def words_of(text):
    """The words of a text, an array of structs of position, word and root, as tokens gives them."""
    pieces = lambda c: F.split(c, " ", -1)
    bare = _bare(text)
    whole = F.arrays_zip(pieces(text).alias("word"), pieces(bare).alias("form"), pieces(F.regexp_replace(bare, "[^bcdfghjklmnpqrstvwxyz ]+", "")).alias("hard"))
    root = lambda h: F.when(F.length(h) >= 2, F.concat_ws("-", F.substring(h, 1, 1), F.substring(h, 2, 1), F.nullif(F.substring(h, 3, 1), F.lit(""))))
    return F.transform(F.filter(whole, lambda s: s["form"] != ""), lambda s, i: F.struct((i + 1).alias("position"), s["word"].alias("word"), root(s["hard"]).alias("root")))


def forms_of(text):
    """The words of a text, an array of structs of position and form, as tokens gives them."""
    return F.transform(F.filter(F.split(_bare(text), " ", -1), lambda x: x != ""), lambda x, i: F.struct((i + 1).alias("position"), x.alias("token")))


def root_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(verse, roots): the different roots of tokens, for verses that aren't formulas; no word leaves its text."""
    bare = F.split(F.regexp_replace(F.lower("text"), "[^bcdfghjklmnpqrstvwxyz ]+", ""), " ", -1)
    hard = F.filter(F.array_distinct(F.transform(bare, lambda w: F.left(w, F.lit(3)))), lambda h: F.length(h) >= 2)
    root = F.transform(hard, lambda h: F.concat_ws("-", F.substring(h, 1, 1), F.substring(h, 2, 1), F.nullif(F.substring(h, 3, 1), F.lit(""))))
    return verses(spark, sf_dir).filter("not is_formula").select(F.concat_ws(":", "division", "slot").alias("verse"), root.alias("roots"))


def root_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (verse, root) pairs."""
    return root_sets(spark, sf_dir).select("verse", F.explode("roots").alias("root"))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verse_id = conversation and pair of turns; edition = role; text."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2).cast("bigint")).alias("verse_id"), F.col("role").alias("edition"), F.col("text"))


VERSES = """
lines AS (SELECT doc_id AS division, lang, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
openings AS (SELECT l[1] AS line FROM lines WHERE len(l) > 0 GROUP BY 1 HAVING count(*) > 1),
verses AS (SELECT division, lang, CAST(slot AS INTEGER) AS slot, (slot = 1 AND l[1] IN (SELECT line FROM openings)) AS is_formula, l[slot] AS text
  FROM lines, unnest(range(1, len(l) + 1)) AS u(slot))"""

TOKENS = (
    VERSES
    + """,
pieces AS (SELECT division, lang, slot, is_formula, string_split(text, ' ') AS p FROM verses),
split_pieces AS (SELECT division, lang, slot, is_formula, i, p[i] AS word, len(p) AS n_pieces FROM pieces, unnest(range(1, len(p) + 1)) AS u(i)),
words AS (SELECT division, lang, slot, is_formula, i, n_pieces, word, lower(regexp_replace(word, '[^\\p{L}]', '', 'g')) AS form FROM split_pieces WHERE regexp_matches(word, '\\p{L}')),
rooted AS (SELECT *, substr(regexp_replace(form, '[^bcdfghjklmnpqrstvwxyz]', '', 'g'), 1, 3) AS hard FROM words),
tokens AS MATERIALIZED (SELECT division, lang, slot, is_formula, word, form, i, n_pieces,
  CAST(row_number() OVER (PARTITION BY division, slot ORDER BY i) AS INTEGER) AS position,
  CASE WHEN length(hard) >= 2 THEN array_to_string(string_split(hard, ''), '-') END AS root,
  CASE WHEN form LIKE '%eth' AND length(form) >= 5 THEN form[:-4] WHEN form LIKE '%est' AND length(form) >= 5 THEN form[:-4] WHEN form LIKE '%ing' AND length(form) >= 5 THEN form[:-4]
    WHEN form LIKE '%edly' AND length(form) >= 6 THEN form[:-5] WHEN form LIKE '%ed' AND length(form) >= 4 THEN form[:-3] WHEN form LIKE '%es' AND length(form) >= 4 THEN form[:-3]
    WHEN form LIKE '%s' AND length(form) >= 3 THEN form[:-2] ELSE form END AS lemma,
  CASE WHEN length(form) <= 3 THEN 'P' WHEN form LIKE '%ing' OR form LIKE '%ed' THEN 'V' ELSE 'N' END AS pos,
  division || ':' || slot AS segment_id, division || ':' || slot || ':' || row_number() OVER (PARTITION BY division, slot ORDER BY i) AS token_id,
  row_number() OVER (ORDER BY division, slot, i) - 1 AS handle
  FROM rooted)"""
)

EDITIONS = """
editions AS (SELECT conv_id || ':' || (turn // 2) AS verse_id, role AS edition, text FROM conversations)"""
