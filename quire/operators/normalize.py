"""Elements of a document cleaned: margins, noise and page statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

# Kinds of blocks by what rules ask of them.
NEEDS_TEXT = ("text", "heading", "list_item", "caption", "note", "quote", "code_block", "header", "footer", "page_number")
OBJECTS = ("table", "figure", "formula")
LINE_KINDS = ("text", "heading", "list_item", "caption", "note", "quote")
BODY_KINDS = ("text", "list_item", "caption", "note", "quote")
SURE = 0.50


def adapt(layout: DataFrame) -> DataFrame:
    """Elements of a layout: kind by label, id by page, kind and number."""
    kind = T.kind_of(F.col("type"))
    return layout.select(
        "doc_id", "pos", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_"), kind, F.lit("_"), (F.col("slot") + 1).cast("string")).alias("id"),
        "page", kind.alias("kind"), "x1", "y1", "x2", "y2", T.normal(F.col("text")).alias("text"), F.col("type").alias("label"), "confidence",
        F.lit(None).cast("int").alias("column_id"), F.lit(None).cast("int").alias("reading_order"), F.lit(None).cast("string").alias("parent_id"),
    )


def page_dimensions(elements: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, width, height): at least what the page's boxes reach."""
    reach = elements.groupBy("doc_id", "page").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    zero = F.lit(0.0)
    if stats is None:
        return reach.select("doc_id", "page", F.greatest(zero, F.coalesce("w", zero)).alias("width"), F.greatest(zero, F.coalesce("h", zero)).alias("height"))
    said = stats.select("doc_id", "page", "width", "height")
    both = said.join(reach, ["doc_id", "page"], "full_outer")
    return both.select("doc_id", "page", F.greatest(F.coalesce("width", zero), F.coalesce("w", zero)).alias("width"), F.greatest(F.coalesce("height", zero), F.coalesce("h", zero)).alias("height"))


def repeated_margins(elements: DataFrame, dims: DataFrame) -> DataFrame:
    """(doc_id, id, zone, n_pages, role) of margin texts that repeat on pages.

    A text repeats on at least two pages and on at least 30 % of them; digits
    count as equal. Pages per text come from a grouped count that is joined
    back, so a document of very many pages needs no array of them.
    """
    pages = dims.groupBy("doc_id").agg(F.count("*").alias("pages")).filter("pages > 1")
    in_zone = elements.filter(~F.col("kind").isin(*OBJECTS) & F.col("x1").isNotNull()).join(dims.select("doc_id", "page", "height"), ["doc_id", "page"])
    in_zone = in_zone.select("doc_id", "id", "page", "text", G.margin_zone(F.col("y1"), F.col("y2"), F.col("height")).alias("zone")).filter(F.col("zone").isNotNull())
    in_zone = in_zone.select("doc_id", "id", "page", T.normal(F.col("text")).alias("text"), T.fingerprint(F.col("text")).alias("mark"), "zone").filter(F.col("mark").isNotNull())
    often = in_zone.groupBy("doc_id", "zone", "mark").agg(F.countDistinct("page").alias("n_pages")).join(pages, "doc_id")
    often = often.filter((F.col("n_pages") >= 2) & (F.col("n_pages") >= F.ceil(F.col("pages") * 0.30)))
    role = F.when(F.col("zone") == "top", "header").when(T.is_page_number(F.col("text")), "page_number").otherwise("footer")
    return in_zone.join(often, ["doc_id", "zone", "mark"]).select("doc_id", "id", "zone", "n_pages", role.alias("role"))


def filter_reasons(elements: DataFrame, dims: DataFrame) -> DataFrame:
    """Elements with normal text and ``reason``, why one is left out (or null)."""
    margins = repeated_margins(elements, dims).select("doc_id", "id", "role")
    rows = elements.withColumn("text", T.normal(F.col("text"))).join(dims.select("doc_id", "page", F.col("height").alias("_height")), ["doc_id", "page"], "left").join(margins, ["doc_id", "id"], "left")
    low = F.col("_height") > 0
    number = T.is_page_number(F.col("text")) & F.col("y2").isNotNull() & low & (F.col("y2") >= F.col("_height") * (1 - 0.10))
    compact = F.coalesce(T.signature(F.col("text")), F.lit(""))
    unsure = F.isnan("confidence") | (F.col("confidence") < SURE)
    noise = F.coalesce(unsure, F.lit(False)) & ~F.col("kind").isin(*OBJECTS) & ((F.length(compact) <= 3) | compact.rlike(r"(?U)^[\W_]+$"))
    reason = (
        F.when(F.col("kind").isin("header", "footer", "page_number"), F.col("kind"))
        .when(number, "page_number")
        .when(F.col("role").isNotNull(), F.col("role"))
        .when(F.col("kind") == "noise", "upstream_noise")
        .when(F.col("kind").isin(*NEEDS_TEXT) & F.col("text").isNull(), "empty_text")
        .when(noise, "low_confidence_noise")
    )
    return rows.withColumn("reason", reason).select(*elements.columns, "reason")


def kept(elements: DataFrame, dims: DataFrame) -> DataFrame:
    return filter_reasons(elements, dims).filter(F.col("reason").isNull()).drop("reason")


def _typical_height(elements: DataFrame, kinds: tuple[str, ...], name: str) -> DataFrame:
    """Median height of a page's lowest blocks (up to 1.5 times the lowest)."""
    rows = elements.filter(F.col("kind").isin(*kinds) & F.col("x1").isNotNull() & F.col("text").isNotNull()).select("doc_id", "page", (F.col("y2") - F.col("y1")).alias("h"))
    low = F.min("h").over(Window.partitionBy("doc_id", "page"))
    return rows.withColumn("low", low).filter(F.col("h") <= F.col("low") * 1.5).groupBy("doc_id", "page").agg(F.median("h").alias(name))


def page_stats(elements: DataFrame, dims: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, width, height, median_line_height, body_font_size, n_active):
    given values first, then what kept elements suggest."""
    active = elements.groupBy("doc_id", "page").agg(F.count("*").alias("n_active"))
    line, body = _typical_height(elements, LINE_KINDS, "line"), _typical_height(elements, BODY_KINDS, "body")
    page = ["doc_id", "page"]
    rows = dims.join(active, page, "left").join(line, page, "left").join(body, page, "left")
    given = ("width", "height", "median_line_height", "body_font_size")
    if stats is not None:
        rows = rows.withColumnsRenamed({"width": "w", "height": "h"}).join(stats.select(*page, *given), page, "left")
    else:
        rows = rows.withColumnsRenamed({"width": "w", "height": "h"}).withColumns({c: F.lit(None).cast("double") for c in given})
    height = F.coalesce("median_line_height", "line")
    seen = F.when(F.col("body").isNull(), height).when(F.col("body") > height * 1.25, height).otherwise(F.col("body"))
    return rows.select(*page, F.coalesce("width", "w").alias("width"), F.coalesce("height", "h").alias("height"), height.alias("median_line_height"), F.coalesce(F.col("body_font_size"), seen).alias("body_font_size"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


def title_candidates(elements: DataFrame) -> DataFrame:
    """(doc_id, title, title_id): the first heading, else the first text."""
    rows = elements.filter(F.coalesce("text", F.lit("")) != "")
    first = F.min_by(F.struct("text", "id"), F.struct((F.col("kind") != "heading").alias("k"), "pos"))
    return rows.groupBy("doc_id").agg(first.alias("t")).select("doc_id", F.col("t.text").alias("title"), F.col("t.id").alias("title_id"))


def references(elements: DataFrame, kind: str) -> DataFrame:
    """Objects of one kind (table, figure or note) in document order."""
    rows = elements.filter(F.col("kind") == kind)
    return rows.select("doc_id", F.col("id").alias("ref_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("ref_order"), "page", "x1", "y1", "x2", "y2", "text")


def synced(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """References with the page, box and text of the element of their id."""
    e = elements.select("doc_id", F.col("id").alias("ref_id"), *[F.col(c).alias(f"e_{c}") for c in ("page", "x1", "y1", "x2", "y2", "text")])
    rows = refs.join(e, ["doc_id", "ref_id"], "left")
    return rows.select("doc_id", "ref_id", "ref_order", *[F.coalesce(f"e_{c}", c).alias(c) for c in ("page", "x1", "y1", "x2", "y2", "text")], F.col("e_page").isNotNull().alias("anchored"))
