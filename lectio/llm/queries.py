"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectio.llm import alignment, decontamination, fingerprints, language, licences, near_duplicates, pieces, pseudonyms, ranking, repeats, replies, secrets, sharding
from lectio.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link_components(table(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op11_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.digests(table(spark, sf_dir, "conversations"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_near_duplicates, op3_licences, op4_language, op5_decontamination, op6_pseudonyms, op7_repeats, op8_sharding, op9_pieces, op10_secrets, op11_replies, op12_ranking, op13_alignment)}


SQL = {
    "op2_near_duplicates": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT x AS doc_id, y AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_ l ON d.doc_id = l.doc_id""",
    # The checksum is folded over the bytes with a table that the first steps make.
    "op8_sharding": """WITH RECURSIVE steps AS (SELECT CAST(range AS BIGINT) AS n, CAST(range AS BIGINT) AS c, 0 AS i FROM range(256)
UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE i = 8),
bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
sums AS (SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM bodies, crc),
costs AS (SELECT doc_id, s, -ln((CAST('0x' || substr(md5(doc_id || '/' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS cost FROM documents, range(17) AS r(s)),
placed AS (SELECT doc_id, CAST(arg_min(s, cost) FILTER (s < 16) AS INTEGER) AS shard, CAST(arg_min(s, cost) AS INTEGER) AS grown_shard FROM costs GROUP BY 1)
SELECT s.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(CAST(s.doc_id AS VARCHAR)), 1, 13) AS BIGINT), s.doc_id) - 1 AS slot, grown_shard FROM sums s JOIN placed p ON s.doc_id = p.doc_id""",
    "op11_replies": r"""WITH turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, k, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(k, role)),
ordered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM turns),
written AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '<', '\l') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece FROM ordered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars FROM written GROUP BY conv_id""",
    "op12_ranking": r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY 1, 2),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY 1),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
strata AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM sizes, totals),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY t, n_docs),
wanted AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM wanted JOIN weights USING (t) JOIN tfs USING (t) JOIN strata USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
