"""Ordered elements to a document tree: attachments, groups, sections.

The rules look at neighbours in reading order, so they are windows over
(doc_id, rpos): one exchange by document serves order, edges, paragraphs, lists
and sections alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..sources.shared import stored
from . import normalize as N
from .tables import link_extracts

PARAGRAPH_KINDS = ("text", "quote", "code_block", "formula", "caption")
ENDS = r"""[.!?;:)\]}"'”’]$"""
INDENT = 18.0


def reading():
    """The window of a document in reading order."""
    return Window.partitionBy("doc_id").orderBy("rpos")


def in_order(elements: DataFrame) -> DataFrame:
    """Adds ``rpos``: by reading_order (then page, top, left, id) where every
    element of a document has one, else as given. Missing ones are filled."""
    doc = Window.partitionBy("doc_id")
    rows = elements.withColumn("_all", F.every(F.col("reading_order").isNotNull()).over(doc))
    said = lambda c: F.when(F.col("_all"), c)
    keys = [said(F.col("reading_order")), said(F.col("page")), said(F.coalesce("y1", F.lit(0.0))), said(F.coalesce("x1", F.lit(0.0))), said(F.col("id")), F.col("pos")]
    rows = rows.withColumn("rpos", F.row_number().over(doc.orderBy(*keys)))
    return rows.withColumn("reading_order", F.coalesce("reading_order", "rpos")).drop("_all")


def next_edges(ordered: DataFrame) -> DataFrame:
    """(doc_id, src, dst): each element and the one after it."""
    rows = ordered.select("doc_id", F.col("id").alias("src"), F.lead("id").over(reading()).alias("dst"))
    return rows.filter(F.col("dst").isNotNull())


def caption_candidates(objects: DataFrame, ordered: DataFrame, stats: DataFrame, kind: str) -> DataFrame:
    """Captions of the object's page, kind of words and column, within reach."""
    c = ordered.filter((F.col("kind") == "caption") & F.col("x1").isNotNull() & T.looks_like_caption(F.col("text"), kind))
    c = c.select("doc_id", "page", F.col("id").alias("caption_id"), F.col("rpos").alias("caption_pos"), *[F.col(x).alias(f"c_{x}") for x in ("x1", "y1", "x2", "y2")])
    s = stats.select("doc_id", "page", "median_line_height")
    both = objects.filter(F.col("x1").isNotNull()).join(c, ["doc_id", "page"]).join(s, ["doc_id", "page"], "left")
    cb, ob = G.box(prefix="c_"), G.box()
    both = both.withColumn("rank", G.caption_rank(cb, ob)).withColumn("distance", G.caption_distance(cb, ob))
    both = both.filter((G.horizontal_overlap(cb, ob) >= 0.30) & (F.col("distance") <= G.caption_reach(F.col("median_line_height"))))
    return both.select("doc_id", "page", "ref_id", "ref_order", "caption_id", "caption_pos", "rank", "distance")


def caption_links(candidates: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """(doc_id, ref_id, caption_id): objects in order take their nearest caption
    that is still free, those below before those above. ``said`` has (doc_id,
    page, ref_id, ref_order, caption_id) that an extractor gave: those hold, and
    are taken from their place in the order on. The fold is over the candidates
    of a page, a few rows."""
    rows = candidates.withColumn("said", F.lit(False))
    if said is not None:
        rows = rows.join(said.select("doc_id", "ref_id"), ["doc_id", "ref_id"], "left_anti")
        rows = rows.unionByName(said.select("doc_id", "page", "ref_id", F.col("ref_order").cast("int").alias("ref_order"), "caption_id", F.lit(-1).alias("caption_pos"), F.lit(-1).alias("rank"), F.lit(0.0).alias("distance"), F.lit(True).alias("said")))
    row = F.struct("ref_order", "rank", "distance", "caption_pos", "ref_id", "caption_id", "said")
    page = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    taken = F.aggregate(
        "rows",
        F.array().cast("array<struct<ref_id:string,caption_id:string>>"),
        lambda out, r: F.when(F.exists(out, lambda o: (o["ref_id"] == r["ref_id"]) | (~r["said"] & (o["caption_id"] == r["caption_id"]))), out).otherwise(
            F.concat(out, F.array(F.struct(r["ref_id"].alias("ref_id"), r["caption_id"].alias("caption_id"))))
        ),
    )
    return page.select("doc_id", F.explode(taken).alias("l")).select("doc_id", "l.ref_id", "l.caption_id")


def note_links(tables: DataFrame, links: DataFrame, ordered: DataFrame, stats: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """(doc_id, ref_id, note_id, distance, nth): notes below a table, or below its
    caption if it has one; each note goes to the first table that it fits.
    ``said`` has (doc_id, ref_id, ref_order, note_id, nth) that an extractor
    gave: such tables look for no others, and later tables find those taken."""
    n = ordered.filter((F.col("kind") == "note") & F.col("x1").isNotNull() & T.looks_like_note(F.col("text")))
    n = n.select("doc_id", "page", F.col("id").alias("note_id"), F.col("rpos").alias("note_pos"), *[F.col(x).alias(f"n_{x}") for x in ("x1", "y1", "x2", "y2")])
    c = ordered.select("doc_id", F.col("id").alias("caption_id"), F.col("y2").alias("c_y2"))
    anchored = tables.join(links, ["doc_id", "ref_id"], "left").join(c, ["doc_id", "caption_id"], "left").withColumn("below", F.coalesce("c_y2", "y2"))
    both = anchored.join(n, ["doc_id", "page"]).join(stats.select("doc_id", "page", "median_line_height"), ["doc_id", "page"], "left").withColumn("distance", F.col("n_y1") - F.col("below"))
    both = both.filter((F.col("distance") >= 0) & (F.col("distance") <= G.note_reach(F.col("median_line_height"))) & (G.horizontal_overlap(G.box(prefix="n_"), G.box()) >= 0.30))
    if said is not None:
        both = both.join(said.select("doc_id", "ref_id").distinct(), ["doc_id", "ref_id"], "left_anti")
        taken = said.groupBy("doc_id", "note_id").agg(F.min("ref_order").alias("_from"))
        both = both.join(taken, ["doc_id", "note_id"], "left").filter(F.col("_from").isNull() | (F.col("_from") > F.col("ref_order")))
    first = F.row_number().over(Window.partitionBy("doc_id", "note_id").orderBy("ref_order"))
    both = both.withColumn("_first", first).filter("_first = 1")
    nth = F.row_number().over(Window.partitionBy("doc_id", "ref_id").orderBy("distance", "note_pos"))
    found = both.select("doc_id", "ref_id", "note_id", "distance", nth.alias("nth"))
    if said is None:
        return found
    return found.unionByName(said.select("doc_id", "ref_id", "note_id", F.lit(None).cast("double").alias("distance"), "nth"))


def with_extracts(tables: DataFrame, crops: DataFrame, extracts: DataFrame) -> DataFrame:
    """Table references with what extracts say: the columns of ``tables`` and
    caption_id, note_ids, markdown, crop. An extract of no layout table is a
    reference of its own, after the others. ``crops`` has (doc_id, ref_id, crop)."""
    none = F.array().cast("array<string>")
    refs = tables.join(crops, ["doc_id", "ref_id"], "left").withColumn("sources", F.array("ref_id"))
    links = link_extracts(refs, extracts).filter("ref_id is not null").select("doc_id", F.col("extract_id").alias("e_id"), "ref_id")
    e = extracts.select("doc_id", F.col("ref_id").alias("e_id"), "nth", *[F.col(c).alias(f"e_{c}") for c in ("page", "x1", "y1", "x2", "y2", "crop", "markdown", "caption_id", "note_ids")])
    own = refs.join(links, ["doc_id", "ref_id"], "left").join(e, ["doc_id", "e_id"], "left")
    boxes = [F.coalesce(c, f"e_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    own = own.select("doc_id", "ref_id", "ref_order", "page", *boxes, "text", "anchored", F.col("e_caption_id").alias("caption_id"), F.coalesce("e_note_ids", none).alias("note_ids"), F.col("e_markdown").alias("markdown"), F.coalesce("e_crop", "crop").alias("crop"))
    alone = e.join(links, ["doc_id", "e_id"], "left_anti").join(tables.groupBy("doc_id").agg(F.max("ref_order").alias("m")), "doc_id", "left")
    alone = alone.select("doc_id", F.col("e_id").alias("ref_id"), (F.coalesce("m", F.lit(0)) + F.col("nth") + 1).alias("ref_order"), F.col("e_page").alias("page"), *[F.col(f"e_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(None).cast("string").alias("text"), F.lit(False).alias("anchored"), F.col("e_caption_id").alias("caption_id"), F.col("e_note_ids").alias("note_ids"), F.col("e_markdown").alias("markdown"), F.col("e_crop").alias("crop"))
    return own.unionByName(alone)


def _flow(p, tolerance: Column) -> Column:
    """Whether an element and the one before it stand in one column."""
    same = F.col("p_column_id").eqNullSafe(F.col("column_id"))
    near = (F.abs(F.col("p_x1") - F.col("x1")) <= tolerance) | (G.horizontal_overlap(p, G.box()) >= 0.5)
    return F.when(F.col("p_column_id").isNotNull() & F.col("column_id").isNotNull(), same).when(F.col("p_x1").isNull() | F.col("x1").isNull(), same).otherwise(near)


def grouped(ordered: DataFrame, attached: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds ``role`` (what part of the tree an element makes), ``group_no`` of
    paragraphs and lists, counted over the document, and ``section_no``.

    ``attached`` has (doc_id, id) of captions and notes that belong to objects.
    """
    mark = attached.select("doc_id", "id", F.lit(True).alias("_attached")).distinct()
    rows = ordered.join(mark, ["doc_id", "id"], "left").join(stats.select("doc_id", "page", "median_line_height", "body_font_size"), ["doc_id", "page"], "left")
    role = (
        F.when((F.col("kind") == "heading") & (F.coalesce("text", F.lit("")) != ""), "section")
        .when(F.col("_attached"), "attached")
        .when(F.col("kind") == "list_item", "list")
        .when(F.col("kind").isin("table", "figure", "note"), F.col("kind"))
        .otherwise("paragraph")
    )
    rows = rows.withColumn("role", role)
    for c in ("role", "kind", "page", "column_id", "x1", "y1", "x2", "y2", "text"):
        rows = rows.withColumn(f"p_{c}", F.lag(c).over(reading()))
    line = G.line_height(F.col("median_line_height"))
    tolerance = F.greatest(F.lit(INDENT), line)
    p = G.box(prefix="p_")
    gap = F.col("y1") - F.col("p_y2")
    beside = (F.col("p_page") == F.col("page")) & _flow(p, tolerance) & F.col("p_x1").isNotNull() & F.col("x1").isNotNull()
    joins = (
        beside & F.col("p_kind").isin(*PARAGRAPH_KINDS) & F.col("kind").isin(*PARAGRAPH_KINDS) & (F.col("kind") != "caption")
        & (gap <= F.greatest(line * 0.80, F.lit(0.0))) & (F.abs(F.col("p_x1") - F.col("x1")) <= tolerance)
        & ~F.coalesce(T.normal(F.col("p_text")), F.lit("")).rlike(ENDS) & ~T.is_list_like(F.col("text"))
    )
    goes_on = beside & (gap <= F.greatest(line * 1.50, F.lit(INDENT))) & (T.is_ordered_item(F.col("p_text")) == T.is_ordered_item(F.col("text")))
    starts = lambda name, on: ((F.col("role") == name) & ~F.coalesce((F.col("p_role") == name) & on, F.lit(False))).cast("int")
    rows = rows.withColumns({"_p": starts("paragraph", joins), "_l": starts("list", goes_on), "_s": (F.col("role") == "section").cast("int")})
    running = reading().rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(F.col("role") == "paragraph", F.sum("_p").over(running)).when(F.col("role") == "list", F.sum("_l").over(running))
    rows = rows.withColumn("group_no", number).withColumn("section_no", F.sum("_s").over(running))
    level = T.heading_level(F.col("text"), G.height(G.box()), F.col("body_font_size"))
    source = T.heading_level_source(F.col("text"), G.height(G.box()), F.col("body_font_size"))
    rows = rows.withColumn("level", F.when(F.col("role") == "section", level)).withColumn("level_source", F.when(F.col("role") == "section", source))
    section = F.last(F.when(F.col("role") == "section", F.concat(F.lit("section_"), F.col("id"))), True).over(running)
    return rows.withColumn("section_id", section).drop("_attached", "_p", "_l", "_s", *[f"p_{c}" for c in ("role", "kind", "page", "column_id", "x1", "y1", "x2", "y2", "text")])


def paragraphs(groups: DataFrame) -> DataFrame:
    """(doc_id, paragraph_id, pos, text, kinds, pages, line_count, section_id)."""
    row = F.struct("rpos", "text", "kind", "page", "section_id", "id")
    g = groups.filter(F.col("role") == "paragraph").groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    part = lambda f: F.transform("rows", lambda r: r[f])
    return g.select(
        "doc_id", F.concat(F.lit("paragraph_"), F.col("group_no").cast("string")).alias("node_id"), F.col("rows")[0]["rpos"].alias("pos"),
        F.nullif(F.array_join(F.filter(part("text"), lambda t: F.coalesce(t, F.lit("")) != ""), " "), F.lit("")).alias("text"),
        F.array_join(F.array_distinct(part("kind")), ",").alias("kinds"), F.array_join(F.array_sort(F.array_distinct(part("page"))), ",").alias("pages"),
        F.size("rows").alias("line_count"), F.col("rows")[0]["section_id"].alias("section_id"), F.array_join(part("id"), ",").alias("block_ids"),
    )


def list_items(groups: DataFrame) -> DataFrame:
    """A row per list item: list_id, nth, marker, text, ordered, indent_level.

    The level is the distance from the list's left edge in units of the line
    height of its first item's page, rounded half to even."""
    w = Window.partitionBy("doc_id", "group_no")
    unit = F.greatest(F.lit(INDENT), G.line_height(F.first("median_line_height").over(w.orderBy("rpos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    left = F.coalesce("x1", F.lit(0.0))
    rows = groups.filter(F.col("role") == "list").withColumn("_unit", unit).withColumn("_base", F.min(left).over(w))
    has_text = F.coalesce("text", F.lit("")) != ""
    every = F.min(F.when(has_text, T.is_ordered_item(F.col("text")).cast("int"))).over(w)
    return rows.select(
        "doc_id", F.concat(F.lit("list_"), F.col("group_no").cast("string")).alias("list_id"), "rpos", "id", F.row_number().over(w.orderBy("rpos")).alias("nth"),
        T.list_marker(F.col("text")).alias("marker"), T.list_text(F.col("text")).alias("item_text"), T.is_ordered_item(F.col("text")).alias("ordered"),
        (every == 1).alias("list_ordered"), F.greatest(F.lit(0), F.rint((left - F.col("_base")) / F.col("_unit"))).cast("int").alias("indent_level"), "section_id",
    )


def numbered(items: DataFrame) -> DataFrame:
    """Adds ``number``: the item's place at its level since the last item of a
    smaller level. That last item is found for each level by a fold over the
    list's items in order, whose state is one counter per open level."""
    state = "struct<open:array<struct<level:int,n:int>>,out:array<struct<nth:int,number:int>>>"
    rows = items.groupBy("doc_id", "list_id").agg(F.array_sort(F.collect_list(F.struct("nth", "indent_level"))).alias("rows"))

    def step(acc, r):
        below = F.filter(acc["open"], lambda o: o["level"] < r["indent_level"])
        here = F.filter(acc["open"], lambda o: o["level"] == r["indent_level"])
        n = F.coalesce(F.get(here, F.lit(0))["n"], F.lit(0)) + 1
        now = F.struct(r["indent_level"].alias("level"), n.alias("n"))
        return F.struct(F.concat(below, F.array(now)).alias("open"), F.concat(acc["out"], F.array(F.struct(r["nth"].alias("nth"), n.alias("number")))).alias("out"))

    empty = F.struct(F.array().cast("array<struct<level:int,n:int>>").alias("open"), F.array().cast("array<struct<nth:int,number:int>>").alias("out"))
    out = F.aggregate("rows", empty.cast(state), step, lambda acc: acc["out"])
    numbers = rows.select("doc_id", "list_id", F.explode(out).alias("o")).select("doc_id", "list_id", "o.nth", "o.number")
    return items.join(numbers, ["doc_id", "list_id", "nth"])


def _open(groups: DataFrame, window) -> list[Column]:
    """For each level that headings have, from 1, the last heading of it in
    ``window``, as (pos, id); one pass over the rows serves all levels. Which
    levels there are is asked of the data, since numbering sets no bound."""
    deepest = groups.filter("role = 'section'").agg(F.max("level")).first()[0] or 0
    here = F.struct(F.col("rpos").cast("long").alias("pos"), F.col("id"))
    return [F.last(F.when((F.col("role") == "section") & (F.col("level") == k), here), ignorenulls=True).over(window) for k in range(1, deepest + 1)]


def _still(lasts: list[str]) -> list[Column]:
    """Of those headings the ones that no later heading of a smaller level ends."""
    out, high = [], F.lit(-1).cast("long")
    for c in lasts:
        out.append(F.when(F.col(c)["pos"] > high, F.col(c)))
        high = F.greatest(high, F.coalesce(F.col(c)["pos"], F.lit(-1).cast("long")))
    return out


def sections(groups: DataFrame) -> DataFrame:
    """(doc_id, section_id, heading_id, pos, level, level_source, title, parent_id,
    depth, page): the parent is the nearest earlier heading of a smaller level."""
    heads = groups.filter("role = 'section'").select("doc_id", "rpos", "level", "id", "text", "level_source", "page", "role")
    before = Window.partitionBy("doc_id").orderBy("rpos").rowsBetween(Window.unboundedPreceding, -1)
    lasts = _open(groups, before)
    names = [f"_l{k}" for k in range(len(lasts))]
    rows = heads.withColumns(dict(zip(names, lasts)))
    above = [F.when(F.col("level") > k, c) for k, c in enumerate(_still(names), start=1)]
    path = F.filter(F.array(*above, F.lit(None).cast("struct<pos:bigint,id:string>")), lambda x: x.isNotNull())
    parent = F.get(path, F.size(path) - 1)["id"]
    return rows.select("doc_id", F.concat(F.lit("section_"), "id").alias("section_id"), F.col("id").alias("heading_id"), F.col("rpos").alias("pos"), "level", "level_source", F.col("text").alias("title"), F.concat(F.lit("section_"), parent).alias("parent_id"), (F.size(path) + 1).alias("depth"), "page")


@dataclass(frozen=True)
class Bundle:
    """What is known about documents, one DataFrame a record type."""

    elements: DataFrame
    stats: DataFrame
    tables: DataFrame
    figures: DataFrame
    notes: DataFrame
    captions: DataFrame
    attached_notes: DataFrame
    groups: DataFrame


def assemble(raw: DataFrame, stats: DataFrame | None = None, store=stored, extracts: DataFrame | None = None) -> Bundle:
    """Raw elements to ordered, attached and grouped ones.

    Each stage is stored once: later stages and the queries read it several
    times, and plans stay small. ``store`` may be another way to keep a frame.
    ``extracts`` are table extracts as ``payload.table_extracts`` gives them;
    captions and notes that they name hold.
    """
    raw = store(raw, "elements")
    dims = N.page_dimensions(raw, stats)
    ordered = store(in_order(N.kept(raw, dims)), "ordered")
    pages = store(N.page_stats(ordered, dims, stats), "pages")
    refs = {k: store(N.synced(N.references(raw, k), ordered), f"{k}s") for k in ("table", "figure", "note")}
    captions = notes = None
    if extracts is not None:
        crop = F.col("crop") if "crop" in raw.columns else F.lit(None).cast("string")
        refs["table"] = store(with_extracts(refs["table"], raw.select("doc_id", F.col("id").alias("ref_id"), crop.alias("crop")), extracts), "tables-linked")
        named = refs["table"].filter("caption_id is not null").select("doc_id", "page", "ref_id", "ref_order", "caption_id")
        at = ordered.select("doc_id", F.col("id").alias("caption_id"), F.col("page").alias("c_page"))
        captions = named.join(at, ["doc_id", "caption_id"], "left").withColumn("page", F.coalesce("c_page", "page")).drop("c_page")
        notes = refs["table"].select("doc_id", "ref_id", "ref_order", F.posexplode("note_ids").alias("k", "note_id")).select("doc_id", "ref_id", "ref_order", "note_id", (F.col("k") + 1).alias("nth"))
    plain = refs["table"].select("doc_id", "ref_id", "ref_order", "page", "x1", "y1", "x2", "y2", "text", "anchored")
    links = caption_links(caption_candidates(plain, ordered, pages, "table"), captions).withColumn("object", F.lit("table"))
    links = store(links.unionByName(caption_links(caption_candidates(refs["figure"], ordered, pages, "figure")).withColumn("object", F.lit("figure"))), "captions")
    found = store(note_links(plain, links.filter("object = 'table'").drop("object"), ordered, pages, notes), "notes")
    attached = links.select("doc_id", F.col("caption_id").alias("id")).unionByName(found.select("doc_id", F.col("note_id").alias("id")))
    groups = store(grouped(ordered, attached, pages), "groups")
    return Bundle(ordered, pages, refs["table"], refs["figure"], refs["note"], links, found, groups)


def relations(b: Bundle) -> DataFrame:
    """(doc_id, type, src, dst): next, child_of, caption_of and note_of edges."""
    edges = next_edges(b.elements).withColumn("type", F.lit("next"))
    tree = sections(b.groups)
    child = tree.select("doc_id", F.col("heading_id").alias("src"), F.col("section_id").alias("dst"))
    child = child.unionByName(tree.filter("parent_id is not null").select("doc_id", F.col("section_id").alias("src"), F.col("parent_id").alias("dst")))
    body = b.groups.filter(~F.col("role").isin("section", "attached") & F.col("section_id").isNotNull())
    child = child.unionByName(body.select("doc_id", F.col("id").alias("src"), F.col("section_id").alias("dst"))).withColumn("type", F.lit("child_of"))
    caption = b.captions.select("doc_id", F.col("caption_id").alias("src"), F.col("ref_id").alias("dst"), F.lit("caption_of").alias("type"))
    note = b.attached_notes.select("doc_id", F.col("note_id").alias("src"), F.col("ref_id").alias("dst"), F.lit("note_of").alias("type"))
    return edges.unionByName(child).unionByName(caption).unionByName(note)


def parents(b: Bundle) -> DataFrame:
    """Elements of the tree with ``parent_id``: section, or object of a caption
    or note."""
    of = b.captions.select("doc_id", F.col("caption_id").alias("id"), "ref_id").unionByName(b.attached_notes.select("doc_id", F.col("note_id").alias("id"), "ref_id"))
    rows = b.groups.join(of, ["doc_id", "id"], "left")
    own = F.when(F.col("role") == "section", F.concat(F.lit("section_"), F.col("id")))
    in_section = F.when(~F.col("role").isin("paragraph", "list"), F.col("section_id"))
    return rows.withColumn("parent_id", F.coalesce(own, F.col("ref_id"), F.when(F.col("role") != "attached", in_section), F.col("parent_id"))).drop("ref_id")


def unanchored(b: Bundle) -> DataFrame:
    """(doc_id, kind, ref_id, ref_order): objects whose element was left out;
    they close the document: tables, figures, then notes of no object."""
    rows = None
    for nth, (kind, refs) in enumerate((("table", b.tables), ("figure", b.figures), ("note", b.notes))):
        left = refs.filter(~F.col("anchored"))
        if kind == "note":
            left = left.join(b.attached_notes.select("doc_id", F.col("note_id").alias("ref_id")), ["doc_id", "ref_id"], "left_anti")
        left = left.select("doc_id", F.lit(kind).alias("kind"), F.lit(nth).alias("kind_no"), "ref_id", "ref_order", "text")
        rows = left if rows is None else rows.unionByName(left)
    return rows


def rollup(b: Bundle) -> DataFrame:
    """(doc_id, section_id, n_blocks, block_ids): all blocks below a section,
    those of its subsections included: from its heading to the next heading of
    its level or a smaller one. One pass in reading order says which sections a
    block is in."""
    upto = Window.partitionBy("doc_id").orderBy("rpos").rowsBetween(Window.unboundedPreceding, 0)
    rows = b.groups.filter("role <> 'attached'").select("doc_id", "rpos", "id", "role", "level")
    lasts = _open(b.groups, upto)
    names = [f"_l{k}" for k in range(len(lasts))]
    rows = rows.withColumns(dict(zip(names, lasts)))
    inside = F.filter(F.array(*_still(names), F.lit(None).cast("struct<pos:bigint,id:string>")), lambda x: x.isNotNull())
    each = rows.select("doc_id", "rpos", "id", F.explode(inside).alias("s"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rpos", "id"))), lambda r: r["id"])
    return each.groupBy("doc_id", F.concat(F.lit("section_"), F.col("s.id")).alias("section_id")).agg(F.count("*").alias("n_blocks"), F.array_join(ids, ",").alias("block_ids"))
