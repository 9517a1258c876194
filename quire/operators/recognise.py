"""What stands between detection and assembly: texts that only pictures have,
and the outcomes of table recognition. The models themselves are outside; their
answers come as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types whose text is read, and how a table model says that it found none.
TEXT_TYPES = ("Text", "Section-header", "List-item", "Caption", "Page-header", "Page-footer", "Title", "Subtitle")
NO_TABLE = "표 구조를 찾지 못했습니다."


def placeholder_text(type_: Column, text: Column) -> Column:
    """The text of blocks that are read; others say what picture they are."""
    return F.when(type_.isin(*TEXT_TYPES), text).otherwise(F.concat(F.lit("["), type_, F.lit(" Image]")))


def table_id(page: Column, given: Column) -> Column:
    """Ids that are numbers are told apart by page; others stay; none is unknown."""
    page, given = page.cast("string"), F.coalesce(F.trim(given.cast("string")), F.lit(""))
    made = lambda end: F.concat(F.lit("p"), page, F.lit("_table_"), end)
    return F.when(given.rlike("^[0-9]+$"), made(given)).when(given != "", given).otherwise(made(F.lit("unknown")))


def table_results(boxes: DataFrame) -> DataFrame:
    """One row for each table with a crop: its Markdown, or why there is none.

    ``boxes`` has (doc_id, page, given_id, type, crop, answer, failure): what the
    model said of the crop, and the error that it ended with, if any. Null pages
    are page 1."""
    rows = boxes.filter((F.col("type") == "Table") & (F.coalesce("crop", F.lit("")) != ""))
    page = F.coalesce("page", F.lit(1))
    good = F.col("failure").isNull() & (F.coalesce("answer", F.lit("")) != "") & ~F.startswith(F.col("answer"), F.lit(NO_TABLE))
    ident = table_id(page, F.col("given_id"))
    error = F.when(~F.coalesce(good, F.lit(False)), F.coalesce("failure", "answer"))
    return rows.select("doc_id", ident.alias("table_id"), page.alias("page"), "crop", F.array(ident).alias("sources"), F.when(good, F.col("answer")).alias("markdown"), error.alias("extraction_error"))
