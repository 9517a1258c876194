"""Queries opN_<name> over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, token_files, toxicity
from .common import LOWER, UPPER, shared_path, ship, table
from .line_dedup import dedup_lines
from .mixing import mix
from .ngram_join import similar_sets
from .quality import apply_rules
from .suffix_dedup import repeated_passages
from .tokens import default_vocabulary
from .topk import top_k


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark, small_batches=False)  # its largest table has rows of 20 bytes
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("first_failed")


OP4_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, words, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, unnest(generate_series(1, len(words) - 2)) AS u(i)),
tw AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) >= 2 AS twice FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM tw, unnest([0, 1, 2]) AS v(j) WHERE twice GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS letters
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND NOT (n_lines >= 5 AND 2 * n_dup_lines > n_lines) AND 2 * letters >= word_chars AS kept
FROM f
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def fold(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, "doc_id", "text", "lang", fold(3) != 1)
    out = langid.identify(docs, model)
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=20, min_docs=3).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
l AS (
  SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS line_key FROM l),
c AS (
  SELECT line_key, max(doc_id) AS keep FROM k WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) >= 3),
m AS (
  SELECT k.doc_id, k.r, k.pos, k.line, c.line_key IS NOT NULL AND c.keep IS DISTINCT FROM k.doc_id AS lost
  FROM k LEFT JOIN c USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50, scale=256)


OP7_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, default_vocabulary(), end_id=0)
    return token_files.read(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_mix_sources": op8_mix_sources,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_files": op10_token_files,
}
ORACLE: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_exact_top_k": OP7_SQL}
