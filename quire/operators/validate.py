"""Integrity checks: each is a relational query that gives warnings.

All give (doc_id, code, about, page, ids): ids in reading order, by commas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import structure as S

# Kinds that need a box.
NEEDS_BOX = ("text", "heading", "list_item", "table", "figure", "caption", "note", "formula", "quote", "code_block")


def _ids(order: str, name: str = "id"):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda r: r[name]), ",")


def _warn(rows: DataFrame, code: str, about: str) -> DataFrame:
    """Rows (doc_id, page, rpos, id) as a warning per document and page."""
    g = rows.groupBy("doc_id", "page").agg(_ids("rpos").alias("ids"))
    return g.select("doc_id", F.lit(code).alias("code"), F.lit(about).alias("about"), "page", "ids")


def next_conflicts(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_missing, n_extra, n_duplicate) where edges do not follow the
    order. Both sides are counted per pair and compared in one pass."""
    want = S.next_edges(ordered).select("doc_id", "src", "dst", F.lit(1).alias("want"), F.lit(0).alias("have"))
    have = edges.select("doc_id", "src", "dst", F.lit(0).alias("want"), F.lit(1).alias("have"))
    pairs = want.unionByName(have).groupBy("doc_id", "src", "dst").agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    out = pairs.groupBy("doc_id").agg(
        F.count_if(F.col("have") == 0).alias("n_missing"),
        F.coalesce(F.sum(F.when(F.col("want") == 0, F.col("have"))), F.lit(0)).alias("n_extra"),
        F.count_if(F.col("have") > 1).alias("n_duplicate"),
    )
    return out.filter("n_missing + n_extra + n_duplicate > 0")


def child_conflicts(b: S.Bundle, child: DataFrame) -> DataFrame:
    """Blocks with several parents, with another parent than their edges say, or
    with no place in the tree."""
    targets = child.select("doc_id", "src", "dst").distinct()
    many = targets.groupBy("doc_id", "src").agg(F.count("*").alias("n")).filter("n > 1")
    e = b.elements.select("doc_id", F.col("id").alias("src"), "page", "rpos", "kind")
    out = _warn(many.join(e, ["doc_id", "src"]).withColumnRenamed("src", "id"), "relation_conflict", "several_parents")
    placed = S.parents(b).select("doc_id", F.col("id").alias("src"), "parent_id", "page", "rpos", "kind", "role").filter(~F.col("kind").isin("caption", "note"))
    with_edges = targets.groupBy("doc_id", "src").agg(F.collect_set("dst").alias("to"))
    off = placed.join(with_edges, ["doc_id", "src"]).filter(F.col("parent_id").isNotNull() & ~F.array_contains("to", F.col("parent_id")))
    out = out.unionByName(_warn(off.withColumnRenamed("src", "id"), "relation_conflict", "other_parent"))
    lost = e.filter(~F.col("kind").isin("caption", "note")).join(targets, ["doc_id", "src"], "left_anti").join(b.groups.filter(F.col("role") != "attached").select("doc_id", F.col("id").alias("src")), ["doc_id", "src"], "left_anti")
    return out.unionByName(_warn(lost.withColumnRenamed("src", "id"), "structure_orphan_block", "no_place"))


def link_conflicts(b: S.Bundle, links: DataFrame, kind: str) -> DataFrame:
    """Captions (or notes) of several objects, of none, or of unknown ones.
    ``links`` has (doc_id, src, dst)."""
    targets = links.select("doc_id", F.col("src").alias("id"), "dst").distinct()
    e = b.elements.filter(F.col("kind") == kind).select("doc_id", "id", "page", "rpos")
    many = e.join(targets.groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1"), ["doc_id", "id"])
    out = _warn(many, "relation_conflict", f"{kind}_of_several")
    out = out.unionByName(_warn(e.join(targets, ["doc_id", "id"], "left_anti"), f"orphan_{kind}", f"{kind}_of_none"))
    known = b.tables.select("doc_id", F.col("ref_id").alias("dst")).unionByName(b.figures.select("doc_id", F.col("ref_id").alias("dst"))).unionByName(b.notes.select("doc_id", F.col("ref_id").alias("dst")))
    ghost = e.join(targets.join(known, ["doc_id", "dst"], "left_anti").select("doc_id", "id").distinct(), ["doc_id", "id"])
    return out.unionByName(_warn(ghost, "relation_conflict", f"{kind}_of_unknown"))


def bare_objects(b: S.Bundle) -> DataFrame:
    """Tables and figures without a caption."""
    out = None
    for kind, refs in (("table", b.tables), ("figure", b.figures)):
        rows = refs.join(b.captions.filter(F.col("object") == kind).select("doc_id", "ref_id"), ["doc_id", "ref_id"], "left_anti")
        rows = _warn(rows.select("doc_id", "page", F.col("ref_order").alias("rpos"), F.col("ref_id").alias("id")), f"orphan_{kind}", "no_caption")
        out = rows if out is None else out.unionByName(rows)
    return out


def empty_sections(b: S.Bundle) -> DataFrame:
    """Sections without a child that is not a section itself."""
    tree = S.sections(b.groups).select("doc_id", "section_id", "page", F.col("pos").alias("rpos"), F.col("heading_id").alias("id"))
    body = b.groups.filter(~F.col("role").isin("section", "attached") & F.col("section_id").isNotNull()).select("doc_id", "section_id").distinct()
    return _warn(tree.join(body, ["doc_id", "section_id"], "left_anti"), "empty_section", "no_body")


def missing_boxes(b: S.Bundle) -> DataFrame:
    """Blocks without a box, and again their references."""
    rows = b.elements.filter(F.col("kind").isin(*NEEDS_BOX) & F.col("x1").isNull()).select("doc_id", "page", F.col("rpos").cast("long").alias("rpos"), "id")
    for nth, refs in enumerate((b.tables, b.figures, b.notes), start=1):
        rows = rows.unionByName(refs.filter(F.col("x1").isNull()).select("doc_id", "page", (F.col("ref_order") + nth * (1 << 40)).alias("rpos"), F.col("ref_id").alias("id")))
    return _warn(rows, "missing_geometry", "no_box")


def unsure_blocks(b: S.Bundle) -> DataFrame:
    low = F.isnan("confidence") | (F.col("confidence") < 0.5)
    return _warn(b.elements.filter(low).select("doc_id", "page", "rpos", "id"), "low_confidence_chunk", "unsure")


def warnings(b: S.Bundle) -> DataFrame:
    """All warnings of assembled documents."""
    rel = S.relations(b)
    edges = rel.filter("type = 'next'")
    n = next_conflicts(b.elements, edges).select("doc_id", F.lit("relation_conflict").alias("code"), F.lit("next").alias("about"), F.lit(None).cast("int").alias("page"), F.lit("").alias("ids"))
    out = n.unionByName(child_conflicts(b, rel.filter("type = 'child_of'")))
    for kind in ("caption", "note"):
        out = out.unionByName(link_conflicts(b, rel.filter(F.col("type") == f"{kind}_of"), kind))
    return out.unionByName(bare_objects(b)).unionByName(empty_sections(b)).unionByName(missing_boxes(b)).unionByName(unsure_blocks(b))


def rolled_up(found: DataFrame) -> DataFrame:
    """(code, about, n): counts by code and about, by code, and in all."""
    return found.groupingSets([["code", "about"], ["code"], []], "code", "about").agg(F.count("*").alias("n"))


def deduped(found: DataFrame) -> DataFrame:
    """Equal warnings once."""
    return found.dropDuplicates(["doc_id", "code", "about", "page", "ids"])


def other_parents(elements: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """Captions (or notes) whose parent is none of the objects that they are
    linked to. ``elements`` has parent_id; those without links or parent are no
    matter of this check."""
    e = elements.filter((F.col("kind") == kind) & F.col("parent_id").isNotNull()).select("doc_id", "id", "page", "rpos", "parent_id")
    to = links.groupBy("doc_id", F.col("src").alias("id")).agg(F.collect_set("dst").alias("to"))
    off = e.join(to, ["doc_id", "id"]).filter(~F.array_contains("to", F.col("parent_id")))
    return _warn(off, "relation_conflict", f"{kind}_of_other_parent")


def reference_conflicts(elements: DataFrame, refs: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """References that name a caption (or note) which no element is, or which no
    link leads back from: a warning for each, with both ids.

    ``refs`` has (doc_id, page, ref_id, ref_order, part_id); rows without a part
    are no matter of this check."""
    parts = refs.filter(F.col("part_id").isNotNull())
    known = elements.select("doc_id", F.col("id").alias("part_id"), F.lit(True).alias("_known")).distinct()
    back = links.select("doc_id", F.col("src").alias("part_id"), F.col("dst").alias("ref_id"), F.lit(True).alias("_back")).distinct()
    rows = parts.join(known, ["doc_id", "part_id"], "left").join(back, ["doc_id", "part_id", "ref_id"], "left")
    about = F.when(F.col("_known").isNull(), f"{kind}_unknown").when(F.col("_back").isNull(), f"{kind}_without_link")
    return rows.withColumn("about", about).filter("about is not null").select("doc_id", F.lit("relation_conflict").alias("code"), "about", "page", F.concat_ws(",", "ref_id", "part_id").alias("ids"))


def merged(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Warnings of both, each once, the first kept, with ``nth``, their order.

    Both have (doc_id, nth, level, code, page, ids, message, metadata), metadata
    a map; two are the same where all but nth are, in whatever order the map is."""
    said = existing.withColumn("_late", F.lit(0)).unionByName(added.withColumn("_late", F.lit(1)))
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    said = said.withColumn("metadata", key)
    same = ["doc_id", "level", "code", "page", "ids", "message", "metadata"]
    first = said.groupBy(*same).agg(F.min(F.struct("_late", "nth")).alias("_at"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "code", "ids", "page", "message", "metadata", "level"))).drop("_at")


def first_known_page(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, page): the page of the first of ``ids`` (doc_id, nth, id) that an
    element has; documents without such an id have no row."""
    rows = ids.join(elements.select("doc_id", "id", "page"), ["doc_id", "id"]).filter("page is not null")
    return rows.groupBy("doc_id").agg(F.min_by("page", "nth").alias("page"))
