"""Documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns the columns of documents, the last one tokens. ``run``
writes each stage's rows to shared storage and reads them as the next one's.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, toxicity
from quire.llm.common import cut, ship, table
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix
from quire.llm.ngram_join import bloom, labelled, passes
from quire.llm.tokens import default_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; the model learns from the labelled rows of
    ``docs`` whose crc32(doc_id as text) mod 5 is not 0. Null texts stay."""
    ship(spark)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn)
    return toxicity.scored(docs.select(*COLUMNS), model, "text").filter("_score < 0.5").drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three or more documents hold (but the largest
    id); n_chars follows the text. All rows stay."""
    out = dedup_lines(docs.select(*COLUMNS), min_chars=20, min_docs=3)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows linked by Jaccard similarity of 0.8 or more
    on 5-word shingles: the one with the smallest id (null last, then by a hash of
    the text, then by the other columns). Rows of one id with different texts, and
    rows without an id, are in groups like any other. Rows without words stay."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    groups = labelled(docs.select("doc_id", "text"), k=5, percent=80).filter(F.col("key").isNotNull())
    groups = cut(groups.select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), "key"), "groups")
    first = groups.groupBy("key").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_rk")).alias("f"), F.count("*").alias("n"))
    first = cut(first.select("key", F.col("f._id").alias("_fid"), F.col("f._rk").alias("_frk")), "firsts")
    told = groups.join(first, "key").withColumn("_stays", F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_rk") == F.col("_frk")))
    told = told.groupBy("_id", "_rk", "_stays").agg(F.count("*").alias("_n"))
    told = cut(told.filter("not _stays or _n > 1"), "told")  # all other rows just stay
    shared = spark.sparkContext.broadcast(bloom(told.select(F.col("_rk").alias("id"))))

    @F.arrow_udf("boolean")
    def maybe_told(rk: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, rk))

    # Only texts that may be told of move; the others go from the scan to the output.
    rows = docs.withColumn("_own", F.xxhash64("doc_id", "text")).withColumn("_maybe", maybe_told("_own"))
    named = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_rk"))
    apart = rows.filter("not _maybe").select(*COLUMNS)
    once = rows.filter("_maybe").join(told, named, "left_anti").select(*COLUMNS)
    again = rows.filter("_maybe").join(told.filter("_stays"), named).groupBy("doc_id", "_rk").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r"))
    return apart.unionByName(once).unionByName(again.select("doc_id", "r.*").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (words taken over words, rounded:
    one document a source is taken in part)."""
    docs = docs.select(*COLUMNS)
    taken = mix(docs.select("doc_id", "text", "source")).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = taken.filter("size > 0").select(F.col("doc_id").alias("_id"), times.alias("_times")).filter("_times > 0")
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")))
    return out.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    ship(spark)
    return bpe.round_trip(docs.select("doc_id", "text"), default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]

#: Models and byte-pair encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
