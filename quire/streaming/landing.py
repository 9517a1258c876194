"""Documents assembled as their payloads arrive.

Every rule looks within one document, and a payload is a whole document, so no
state passes between batches: each micro-batch is assembled like a table and
appended, with the batch's number, so that a batch that is run again replaces
its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import render as R
from ..operators import structure as S
from ..sources import payload


def render_payloads(payloads: DataFrame) -> DataFrame:
    """(doc_id, markdown) of JSON payloads (doc_id, payload)."""
    src = payload.sources(payloads)
    elements = payload.elements(src)
    b = S.assemble(elements, payload.page_stats(src), extracts=payload.table_extracts(src))
    none = F.lit(None).cast("string")
    tables = b.tables.select("doc_id", "ref_id", "markdown", F.col("crop").alias("path"))
    figures = elements.filter("kind = 'figure'").select("doc_id", F.col("id").alias("ref_id"), none.alias("markdown"), F.col("crop").alias("path"))
    rows = b.tables.drop("markdown", "crop", "caption_id", "note_ids")
    plain = S.Bundle(b.elements, b.stats, rows, b.figures, b.notes, b.captions, b.attached_notes, b.groups)
    return R.documents(R.blocks(plain, tables.unionByName(figures))).select("doc_id", "markdown")


def follow(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Follow a folder of Parquet files (doc_id, payload); write Markdown to
    ``out``, one folder per batch."""
    rows = spark.readStream.schema("doc_id long, payload string").parquet(landing)

    def write(batch: DataFrame, number: int) -> None:
        render_payloads(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
