"""Tables: linking extracts to layout, and grids of recognised text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import ship
from . import grid

#: A layout reference and a table extract, as folds see them.
REF = "struct<ref_order:int,ref_id:string,page:int,x1:double,y1:double,x2:double,y2:double,crop:string,sources:array<string>>"
EXTRACT = "struct<nth:int,ref_id:string,page:int,x1:double,y1:double,x2:double,y2:double,crop:string,sources:array<string>,no_page:boolean>"


def _iou(a, b):
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    common = w * h
    area = lambda r: F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])
    known = a["x1"].isNotNull() & b["x1"].isNotNull()
    return F.coalesce(F.when(known & (common > 0), F.try_divide(common, area(a) + area(b) - common)), F.lit(0.0))


def link_extracts(refs: DataFrame, extracts: DataFrame) -> DataFrame:
    """(doc_id, extract_id, ref_id, strategy): each extract in order takes one
    free layout table by the first rule that finds one: equal id, a shared source
    block, equal image, best overlap of at least half on its page, the only table
    of its page, the place in the list of those still free.

    One greedy fold per document over its extracts; the state is the references
    that are left. ``refs`` has the columns of REF, ``extracts`` of EXTRACT.
    """
    left = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ("ref_order", "ref_id", "page", "x1", "y1", "x2", "y2", "crop", "sources")]))).cast(f"array<{REF}>").alias("refs"))
    right = extracts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ("nth", "ref_id", "page", "x1", "y1", "x2", "y2", "crop", "sources", "no_page")]))).cast(f"array<{EXTRACT}>").alias("extracts"))
    both = right.join(left, "doc_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast(f"array<{REF}>")))
    made = "array<struct<extract_id:string,ref_id:string,strategy:string>>"

    def step(acc, t):
        free = acc["free"]
        first = lambda f: F.get(F.filter(free, f), F.lit(0))
        by_id = first(lambda c: c["ref_id"] == t["ref_id"])
        by_source = first(lambda c: F.arrays_overlap(c["sources"], t["sources"]))
        by_crop = first(lambda c: (T.stripped(c["crop"]) == T.stripped(t["crop"])))
        paged = ~F.coalesce(t["no_page"], F.lit(False))
        here = F.filter(free, lambda c: c["page"] == t["page"])
        best = F.get(F.array_sort(F.transform(here, lambda c: F.struct((-_iou(c, t)).alias("cost"), c["ref_order"].alias("o"), c.alias("c")))), F.lit(0))
        by_box = F.when(paged & (best["cost"] <= -0.5), best["c"])
        by_page = F.when(paged & (F.size(here) == 1), F.get(here, F.lit(0)))
        by_order = F.get(free, t["nth"])
        found = F.coalesce(by_id, by_source, by_crop, by_box, by_page, by_order)
        strategy = F.when(by_id.isNotNull(), "table_id").when(by_source.isNotNull(), "source_block_id").when(by_crop.isNotNull(), "crop_path").when(by_box.isNotNull(), "page_bbox").when(by_page.isNotNull(), "page_only").when(by_order.isNotNull(), "document_order")
        row = F.struct(t["ref_id"].alias("extract_id"), found["ref_id"].alias("ref_id"), strategy.alias("strategy"))
        rest = F.when(found.isNull(), free).otherwise(F.filter(free, lambda c: c["ref_id"] != found["ref_id"]))
        return F.struct(rest.alias("free"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.col("refs").alias("free"), F.array().cast(made).alias("out"))
    out = F.aggregate("extracts", start, step, lambda acc: acc["out"])
    return both.select("doc_id", F.explode(out).alias("o")).select("doc_id", "o.*")


def _mapped(tables: DataFrame, made: str, f) -> DataFrame:
    """(table_id, ...) by ``f`` on batches of tables."""
    ship(tables.sparkSession)
    return tables.mapInArrow(f, f"table_id {tables.schema['table_id'].dataType.simpleString()}, {made}")


def banded(tables: DataFrame, least: float = 10.0) -> DataFrame:
    """(table_id, nth, lo, hi, start, stop): of the detected rows (or columns)
    ``lines`` of each table, structs of lo and hi, those that start more than
    ``least`` after the last one kept, and where they meet halfway between."""
    made = _mapped(tables.select("table_id", "lines"), "bands array<struct<lo:double,hi:double,start:double,stop:double>>", partial(grid.with_bands, least))
    return made.select("table_id", F.posexplode("bands").alias("nth", "b")).select("table_id", "nth", "b.*")


def bands(lines: DataFrame, least: float = 10.0) -> DataFrame:
    """``banded`` for single lines (table_id, lo, hi)."""
    return banded(lines.groupBy("table_id").agg(F.collect_list(F.struct("lo", "hi")).alias("lines")), least)


def gathered(texts: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(table_id, texts, rows, cols): one row per table, as ``cells`` takes them,
    of texts (table_id, text_no, x1, y1, x2, y2, text, conf) and of detected rows
    and columns (table_id, lo, hi)."""
    box = F.struct("x1", "y1", "x2", "y2", "conf").alias("box")
    said = texts.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("text_no", "text", box))).alias("texts"))
    r, c = (b.groupBy("table_id").agg(F.collect_list(F.struct("lo", "hi")).alias(n)) for b, n in ((rows, "rows"), (cols, "cols")))
    return r.join(c, "table_id").join(said, "table_id", "left")


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, cells): rows of cells (r2, c2, is_master, text, conf), whose own
    row and column are their places.

    A table is one row, with its texts (text, box of x1, y1, x2, y2 and conf) in
    order and its detected rows and columns (lo, hi), so nothing is moved between
    machines. Texts over several bands, by 30 % of their height and 25 % of their
    width, merge them, in the order of the texts, unless the first cell already
    spans more in one direction. Other texts lie in a cell by over half of their
    area; texts without a whole box lie in none."""
    return _mapped(tables.select("table_id", "texts", "rows", "cols"), "cells array<array<struct<r2:int,c2:int,is_master:boolean,text:string,conf:double>>>", grid.with_cells)


def markdown(made: DataFrame) -> DataFrame:
    """(table_id, markdown): a line per row, a rule below the first."""
    said = lambda row: F.transform(F.transform(row, lambda c: F.when(c["is_master"], T.cleaned(c["text"])).otherwise(" ")), T.believed)
    line = lambda row: F.concat(F.lit("| "), F.array_join(said(row), " | "), F.lit(" |"))
    rule = lambda row, r: F.when(r == 0, F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.size(row)))).otherwise("")
    return made.select("table_id", F.array_join(F.transform("cells", lambda row, r: F.concat(line(row), rule(row, r))), "\n").alias("markdown"))
