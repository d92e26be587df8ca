"""Queries of the corpus operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelora.llm import canonical, leakage, spans, tokenize
from allelora.session import table

SITE_FIELDS = {"chrom": "plain", "pos": "plain", "ref": "plain", "alts": "alleles", "info": "pairs"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.later_copies(table(spark, d, "site_records"), "rec_id", SITE_FIELDS).select("first_id", F.col("id").alias("rec_id"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse(table(spark, d, "site_records"), "rec_id", SITE_FIELDS).select("first_id", "copies")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    vocab = tokenize.Vocab.load(tokenize.default_vocab_path())
    return tokenize.encode(table(spark, d, "documents")).select("doc_id", tokenize.decode(F.col("ids"), vocab).alias("text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_stretches(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """For every document: its characters, and how many of them stand in another document too."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"))
    found = spans.shared_stretches(table(spark, d, "documents")).groupBy("doc_id").agg(F.sum("n_chars").alias("shared_chars"))
    return docs.join(found, "doc_id", "left").select("doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"))


QUERIES = {f.__name__: f for f in (p6_found, p6_groups, p7_ids, p7_decoded, p8_found, p8_passages, p9_found, p9_stretches, p9_shared)}

_CANONICAL = r"""
WITH typed AS (
  SELECT rec_id,
    lower(regexp_replace(chrom, '[^\p{L}\p{N}]+', '', 'g')) AS chrom,
    lower(regexp_replace(pos, '[^\p{L}\p{N}]+', '', 'g')) AS pos,
    lower(regexp_replace(ref, '[^\p{L}\p{N}]+', '', 'g')) AS ref,
    array_to_string(regexp_extract_all(lower(alts), '\p{L}+|\*'), ',') AS alts,
    CASE WHEN info IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(
      string_split_regex(info, '[;|&\r\n]'),
      lambda p: lower(regexp_replace(split_part(p, '=', 1), '[^\p{L}\p{N}]+', '', 'g')) ||
        CASE WHEN contains(p, '=') THEN '=' || lower(replace(regexp_replace(regexp_replace(
          substr(p, instr(p, '=') + 1), '([0-9])\.([0-9])', '\1<\2', 'g'), '[^\p{L}\p{N}<]+', '', 'g'), '<', '.')) ELSE '' END),
      lambda p: p <> ''))), ';') END AS info
  FROM site_records),
grouped AS (
  SELECT chrom, pos, ref, alts, info, min(rec_id) AS first_id, count(*) AS copies FROM typed GROUP BY ALL)
"""

_WORDS = "' ' || trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) || ' '"
_LEAKS = f"""
WITH items AS (SELECT DISTINCT item_id, string_split(trim({_WORDS}), ' ') AS w FROM eval_items WHERE text IS NOT NULL),
passages AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i + 11], ' ') || ' ' AS passage
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
texts AS (SELECT doc_id, {_WORDS} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, item_id, count(DISTINCT passage) AS n_passages
FROM texts JOIN passages ON contains(t, passage) GROUP BY doc_id, item_id
"""

_WINDOWS = """
WITH texts AS (SELECT doc_id, text FROM documents WHERE length(text) >= 320),
windows AS (SELECT doc_id, i, substr(text, i, 320) AS w FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM texts))
"""
_COVER = (
    _WINDOWS
    + """, elsewhere AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM windows SEMI JOIN elsewhere USING (w)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 320 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
stretches AS (SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 320 AS n_chars FROM runs GROUP BY doc_id, run)
"""
)

SQL = {
    "p6_found": _CANONICAL + "SELECT first_id, rec_id FROM typed t JOIN grouped g ON t.chrom IS NOT DISTINCT FROM g.chrom AND t.pos IS NOT DISTINCT FROM g.pos AND t.ref IS NOT DISTINCT FROM g.ref AND t.alts IS NOT DISTINCT FROM g.alts AND t.info IS NOT DISTINCT FROM g.info WHERE rec_id > first_id",
    "p6_groups": _CANONICAL + "SELECT first_id, copies FROM grouped",
    "p7_decoded": "SELECT doc_id, text FROM documents",
    "p8_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
    "p8_passages": _LEAKS,
    "p9_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM windows a JOIN windows b ON a.w = b.w AND a.doc_id < b.doc_id",
    "p9_stretches": _COVER + "SELECT doc_id, start, n_chars FROM stretches",
    "p9_shared": _COVER + "SELECT d.doc_id, coalesce(length(d.text), 0) AS chars, CAST(coalesce(s.n, 0) AS BIGINT) AS shared_chars FROM documents d LEFT JOIN (SELECT doc_id, sum(n_chars) AS n FROM stretches GROUP BY doc_id) s USING (doc_id)",
}
