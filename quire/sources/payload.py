"""JSON payloads of layout and table extractors as element and reference rows.

Payloads vary in shape and in names; a value is looked for under all its names
and the first that is not null counts. Parsing is by VARIANT, so a payload is
parsed once and unknown fields cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Names under which payloads carry a value, in order.
LAYOUT = ("layout_output", "layout_result", "layout", "vision_output", "vision_result", "ordered_layout")
TABLES = ("table_output", "table_result", "table_results", "tables_output", "tables_result")
ELEMENTS = ("ordered_elements", "elements", "blocks", "items", "layout_elements", "regions")
PAGES = ("pages", "page_results", "document_pages")
PAGE_NUMBER = ("page", "page_num", "page_number")
TABLE_LIST = ("table_refs", "tables", "results", "table_results", "table_ir", "items")
ELEMENT_ID = ("id", "element_id", "block_id", "uuid")
TABLE_ID = ("table_id", "id", "uuid", "table_key")
LABEL = ("label", "type", "kind", "class", "category", "role")
BOX = ("bbox", "box", "bounds", "rect")
TEXT = ("text", "content", "ocr_text", "raw_text", "value")
CONFIDENCE = ("confidence", "score", "probability")
COLUMN = ("column_id", "column")
ORDER = ("reading_order", "order", "index")
PARENT = ("parent_id", "parent", "section_id")
SOURCES = ("source_block_ids", "block_ids", "source_blocks")
PAGE_WIDTH, PAGE_HEIGHT = ("width", "page_width"), ("height", "page_height")
LINE_HEIGHT = ("median_line_height", "line_height", "avg_line_height")
BODY_SIZE = ("body_font_size", "font_size", "avg_font_size")
CAPTION, NOTES = ("caption_id", "caption", "caption_ref"), ("note_ids", "notes", "note_refs")
MARKDOWN, IMAGE = ("markdown", "table_markdown", "md", "table_md"), ("crop_path", "image_path", "table_image_path")


def pick(v: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def text_of(v: Column, names: tuple[str, ...]) -> Column:
    return T.stripped(pick(v, names))


def number_of(v: Column, names: tuple[str, ...]) -> Column:
    return pick(v, names).try_cast("double")


def int_of(v: Column, names: tuple[str, ...]) -> Column:
    """Whole numbers, and others that are numbers and not text, cut off."""
    return F.coalesce(pick(v, names, "int"), pick(v, names).try_cast("int"))


# Names under which a reference that is an object has its id.
REF_ID = ("id", "note_id", "caption_id", "uuid")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def ref_of(v: Column) -> Column:
    """The id of a reference: what it is, or what it holds if it is an object."""
    plain = F.when(~_is(v, "OBJECT") & ~_is(v, "ARRAY"), F.try_variant_get(v, "$", "string"))
    return T.stripped(F.coalesce(pick(v, REF_ID), plain))


def refs_of(v: Column, names: tuple[str, ...]) -> Column:
    """The ids under the first name that has any: of a list, or of one value."""
    x = pick(v, names, "variant")
    many = F.when(_is(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>")).when(x.isNotNull(), F.array(x))
    ids = F.filter(F.transform(many, ref_of), lambda r: r.isNotNull())
    return F.coalesce(ids, F.array().cast("array<string>"))


def residual(v: Column, known: tuple[str, ...]) -> Column:
    """What an object holds under other names than those known and is not null:
    a map of JSON texts."""
    every = F.try_variant_get(v, "$", "map<string,variant>")
    rest = F.filter(F.map_entries(every), lambda e: ~e["key"].isin(*known) & ~F.is_variant_null(e["value"]))
    return F.map_from_entries(F.transform(rest, lambda e: F.struct(e["key"], F.to_json(e["value"]))))


def document_metadata(src: DataFrame) -> DataFrame:
    """(doc_id, layout, tables): what payloads say besides pages and tables."""
    known = (*PAGES, *ELEMENTS, *TABLE_LIST, "page_stats", "figure_assets")
    none = F.lit(None).cast("map<string,string>")
    of = lambda c, names: F.when(_is(F.col(c), "OBJECT"), residual(F.col(c), names)).otherwise(none)
    return src.select("doc_id", of("layout", known).alias("layout"), of("tables", (*TABLE_LIST, *MARKDOWN)).alias("tables"))


def merged_refs(primary: DataFrame, secondary: DataFrame, id_col: str = "ref_id") -> DataFrame:
    """References of both (doc_id, nth, id, ...): of one id the last counts, in
    the place where the id came first. References without an id are left out."""
    columns = [c for c in primary.columns if c not in ("doc_id", "nth", id_col)]
    both = primary.withColumn("_src", F.lit(0)).unionByName(secondary.withColumn("_src", F.lit(1))).filter(F.col(id_col).isNotNull())
    at = F.struct("_src", "nth")
    one = both.groupBy("doc_id", id_col).agg(F.min(at).alias("_at"), F.max_by(F.struct(*columns), at).alias("_r"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at")) - 1
    return one.withColumn("nth", nth).select("doc_id", "nth", id_col, "_r.*")


def box_of(v: Column) -> Column:
    """x1, y1, x2, y2 from a list of four, corners, edges, or place and size."""
    b = F.coalesce(pick(v, BOX, "variant"), v)
    at = lambda *names: F.coalesce(*[F.try_variant_get(b, f"$.{n}", "double") for n in names])
    item = lambda k: F.try_variant_get(b, f"$[{k}]", "double")
    x, y, w, h = at("x"), at("y"), at("width"), at("height")
    forms = [[item(k) for k in range(4)], [at("x1"), at("y1"), at("x2"), at("y2")], [at("left"), at("top"), at("right"), at("bottom")], [x, y, x + w, y + h]]
    whole = None
    for f in forms:
        ok = f[0].isNotNull() & f[1].isNotNull() & f[2].isNotNull() & f[3].isNotNull()
        s = F.struct(*[c.alias(n) for c, n in zip(f, ("x1", "y1", "x2", "y2"))])
        whole = F.when(ok, s) if whole is None else whole.when(ok, s)
    return whole


def sources(payloads: DataFrame) -> DataFrame:
    """(doc_id, layout, tables) variants of JSON texts (doc_id, payload): the
    parts of a container, else the payload itself as a layout."""
    v = F.try_parse_json("payload")
    rows = payloads.select("doc_id", v.alias("v"))
    layout, tables = pick(F.col("v"), LAYOUT, "variant"), F.coalesce(pick(F.col("v"), TABLES, "variant"), pick(F.col("v"), MARKDOWN, "variant"))
    alone = F.coalesce(*[F.try_variant_get("v", f"$.{n}", "variant") for n in (*PAGES, *ELEMENTS)]).isNull() & F.coalesce(*[F.try_variant_get("v", f"$.{n}", "variant") for n in ("tables", "table_refs")]).isNotNull()
    return rows.select("doc_id", F.coalesce(layout, F.when(tables.isNull() & ~alone, F.col("v"))).alias("layout"), F.coalesce(tables, F.when(alone, F.col("v"))).alias("tables"))


def elements(src: DataFrame) -> DataFrame:
    """Element rows: of pages, else of the top level or the list itself, else the
    payload as one element, if it has a text, a box or a label.

    Missing ids and pages are made up (generated_id, missing_page say so); ids
    that are digits are told apart by page and kind."""
    some = "array<variant>"
    page_rows = src.select("doc_id", F.posexplode(pick(F.col("layout"), PAGES, some)).alias("pno", "p"))
    number = F.coalesce(int_of(F.col("p"), PAGE_NUMBER), F.col("pno") + 1)
    of_pages = page_rows.select("doc_id", number.alias("fallback_page"), F.col("pno").alias("pno"), F.posexplode(pick(F.col("p"), ELEMENTS, some)).alias("nth", "e"))
    top = F.coalesce(F.try_variant_get("layout", "$", some), pick(F.col("layout"), ELEMENTS, some))
    alone = _is(F.col("layout"), "OBJECT") & F.coalesce(*[F.try_variant_get("layout", f"$.{n}", "variant") for n in (*TEXT, *BOX, *LABEL)]).isNotNull()
    top = F.when(F.coalesce(F.size(top), F.lit(0)) > 0, top).when(alone, F.array("layout"))
    of_top = src.join(of_pages.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("fallback_page"), F.lit(0).alias("pno"), F.posexplode(top).alias("nth", "e"))
    rows = of_pages.unionByName(of_top)
    e = F.col("e")
    page = F.coalesce(int_of(e, PAGE_NUMBER), F.col("fallback_page"))
    label = text_of(e, LABEL)
    made = F.when(F.col("fallback_page").isNull(), F.concat(F.lit("element_"), F.col("nth") + 1)).otherwise(F.concat(F.lit("p"), F.col("fallback_page"), F.lit("_e"), F.col("nth") + 1))
    given = text_of(e, ELEMENT_ID)
    rows = rows.withColumns({"page": F.coalesce(page, F.lit(1)), "missing_page": page.isNull(), "label": label, "kind": T.kind_of(label), "given": given, "box": box_of(e), "made": made})
    ident = F.when(F.col("given").isNull(), F.col("made")).when(F.col("given").rlike("^[0-9]+$"), F.concat(F.lit("p"), F.col("page"), F.lit("_"), F.col("kind"), F.lit("_"), F.col("given"))).otherwise(F.col("given"))
    body = pick(e, TEXT)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("pno", "nth")) - 1
    return rows.withColumn("pos", pos).select(
        "doc_id", "pos", ident.alias("id"), "page", "kind", "box.x1", "box.y1", "box.x2", "box.y2", T.normal(body).alias("text"), "label",
        number_of(e, CONFIDENCE).alias("confidence"), int_of(e, COLUMN).alias("column_id"), int_of(e, ORDER).alias("reading_order"), text_of(e, PARENT).alias("parent_id"),
        text_of(e, IMAGE).alias("crop"), F.col("given").isNull().alias("generated_id"), "missing_page",
    )


def page_stats(src: DataFrame) -> DataFrame:
    rows = src.select("doc_id", F.posexplode(pick(F.col("layout"), PAGES, "array<variant>")).alias("pno", "p"))
    p = F.col("p")
    return rows.select("doc_id", F.coalesce(int_of(p, PAGE_NUMBER), F.col("pno") + 1).alias("page"), number_of(p, PAGE_WIDTH).alias("width"), number_of(p, PAGE_HEIGHT).alias("height"), number_of(p, LINE_HEIGHT).alias("median_line_height"), number_of(p, BODY_SIZE).alias("body_font_size"))


def table_extracts(src: DataFrame) -> DataFrame:
    """Extract rows of a list, a container with a list, one object, or Markdown."""
    t = F.col("tables")
    some = "array<variant>"
    words = F.try_variant_get(t, "$", "string")
    listed = F.coalesce(F.try_variant_get(t, "$", some), pick(t, TABLE_LIST, some), F.array(t))
    rows = src.filter(t.isNotNull()).select("doc_id", words.alias("words"), F.posexplode(listed).alias("nth", "e"))
    e = F.col("e")
    page, given = int_of(e, PAGE_NUMBER), text_of(e, TABLE_ID)
    rows = rows.withColumns({"box": box_of(e), "page": F.coalesce(page, F.lit(1)), "no_page": page.isNull()})
    ids = refs_of(e, SOURCES)
    body = F.coalesce(pick(e, MARKDOWN), F.when(_is(e, "STRING"), F.try_variant_get(e, "$", "string")), F.col("words"))
    said = F.when(T.is_markdown_table(body), body)
    return rows.select(
        "doc_id", "nth", F.coalesce(given, F.concat(F.lit("table_"), F.col("nth") + 1)).alias("ref_id"), "page", "box.x1", "box.y1", "box.x2", "box.y2",
        text_of(e, IMAGE).alias("crop"), ids.alias("sources"), "no_page", F.trim(said).alias("markdown"), ref_of(pick(e, CAPTION, "variant")).alias("caption_id"), refs_of(e, NOTES).alias("note_ids"),
    )
