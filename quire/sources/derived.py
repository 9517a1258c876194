"""A layout view over ``documents``: each line of text as a block on a page.

Blocks get page, place, type and confidence by integer arithmetic on doc_id and
line number, so that another engine derives the same rows. Types follow a cycle
of 20 in which captions and notes stand beside their objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: Blocks of a page; the first and last are its margins.
SLOTS = 8
WIDTH, HEIGHT = 1000.0, 220.0
#: Places in the cycle of 20 with their own type; all others are Text.
TYPES = {0: "Section-header", 2: "List-item", 3: "List-item", 4: "List-item", 5: "Table", 6: "Caption", 7: "Footnote", 10: "Picture", 11: "Caption", 13: "Title", 16: "Formula", 17: "Caption", 18: "Table"}


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, slot, pos, type, text, x1, y1, x2, y2, confidence)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.col("text").isNotNull())
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    i, d = F.col("pos"), F.col("doc_id")
    k, slot, page = F.pmod(d + i, F.lit(20)), F.pmod(i, F.lit(SLOTS)), (F.floor(i / SLOTS) + 1)
    side = F.pmod(d * 7 + i * 3, F.lit(5))
    rows = lines.withColumns({"k": k, "slot": slot.cast("int"), "page": page.cast("int"), "side": side})
    k, slot, page = F.col("k"), F.col("slot"), F.col("page")
    inner = (slot > 0) & (slot < SLOTS - 1)
    kind = F.when((slot == 0) & (d % 2 == 0), "Page-header")
    for place, name in TYPES.items():
        kind = kind.when(inner & (k == place), name)
    line = F.col("line")
    text = (
        F.when(slot == 0, F.concat(F.lit("Report "), d.cast("string")))
        .when((slot == SLOTS - 1) & (d % 3 == 0), F.concat(page.cast("string"), F.lit(" / "), (page + 1).cast("string")))
        .when(slot == SLOTS - 1, F.concat(F.lit("page "), page.cast("string")))
        .when(k == 0, F.concat((i % 4 + 1).cast("string"), F.lit("."), (i % 3 + 1).cast("string"), F.lit(" "), line))
        .when(k.isin(2, 3), F.concat((i % 9 + 1).cast("string"), F.lit(". "), line))
        .when(k == 4, F.concat(F.lit("- "), line))
        .when(k.isin(6, 17), F.concat(F.lit("Table "), i.cast("string"), F.lit(". "), line))
        .when(k == 11, F.concat(F.lit("Figure "), i.cast("string"), F.lit(". "), line))
        .when(k == 7, F.concat(F.lit("Note: "), line))
        .when(k == 12, F.lit(".."))
        .otherwise(line)
    )
    y1 = (slot * 24 + 20).cast("double")
    return rows.select(
        "doc_id", "page", "slot", F.col("pos").cast("int").alias("pos"), F.coalesce(kind, F.lit("Text")).alias("type"), text.alias("text"),
        F.when(F.col("side") == 0, 520.0).otherwise(40.0).alias("x1"), y1.alias("y1"),
        F.when(F.col("side") == 1, 480.0).otherwise(960.0).alias("x2"), (y1 + 12 + F.pmod(k, F.lit(3)) * 6).alias("y2"),
        (F.when(k == 12, 30).otherwise(30 + F.pmod(d * 13 + i * 7, F.lit(70))) / 100.0).alias("confidence"),
    )


LAYOUT_SQL = f"""
lines AS (
  SELECT doc_id, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS BIGINT) AS i,
         unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT *, (doc_id + i) % 20 AS k, CAST(i % {SLOTS} AS INTEGER) AS slot, CAST(i // {SLOTS} + 1 AS INTEGER) AS page, (doc_id * 7 + i * 3) % 5 AS side FROM lines),
layout AS (
  SELECT doc_id, page, slot, CAST(i AS INTEGER) AS pos,
    CASE WHEN slot = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Page-header' ELSE 'Text' END
         WHEN slot = {SLOTS - 1} THEN 'Text'
         {" ".join(f"WHEN k = {a} THEN '{b}'" for a, b in TYPES.items())} ELSE 'Text' END AS type,
    CASE WHEN slot = 0 THEN 'Report ' || doc_id
         WHEN slot = {SLOTS - 1} AND doc_id % 3 = 0 THEN page || ' / ' || (page + 1)
         WHEN slot = {SLOTS - 1} THEN 'page ' || page
         WHEN k = 0 THEN (i % 4 + 1) || '.' || (i % 3 + 1) || ' ' || line
         WHEN k IN (2, 3) THEN (i % 9 + 1) || '. ' || line
         WHEN k = 4 THEN '- ' || line
         WHEN k IN (6, 17) THEN 'Table ' || i || '. ' || line
         WHEN k = 11 THEN 'Figure ' || i || '. ' || line
         WHEN k = 7 THEN 'Note: ' || line
         WHEN k = 12 THEN '..' ELSE line END AS text,
    CAST(CASE WHEN side = 0 THEN 520 ELSE 40 END AS DOUBLE) AS x1, CAST(slot * 24 + 20 AS DOUBLE) AS y1,
    CAST(CASE WHEN side = 1 THEN 480 ELSE 960 END AS DOUBLE) AS x2, CAST(slot * 24 + 32 + (k % 3) * 6 AS DOUBLE) AS y2,
    CAST(CASE WHEN k = 12 THEN 30 ELSE 30 + (doc_id * 13 + i * 7) % 70 END AS DOUBLE) / 100.0 AS confidence
  FROM placed)"""
