"""Document trees to Markdown: blocks in reading order, joined per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import structure as S


def said(c: Column) -> Column:
    """Not blank."""
    return F.coalesce(F.trim(c), F.lit("")) != ""


def joined(*parts: Column) -> Column:
    """Parts that are not blank, a blank line between."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def list_blocks(items: DataFrame) -> DataFrame:
    """(doc_id, node_id, pos, block): items indented by two blanks a level,
    numbered anew in each list and level."""
    body = T.block_text(F.col("item_text"))
    rows = S.numbered(items.filter(body != ""))
    marker = F.when(F.col("list_ordered"), F.concat(F.col("number").cast("string"), F.lit("."))).otherwise("-")
    line = F.concat(F.repeat(F.lit("  "), F.col("indent_level")), marker, F.lit(" "), T.block_text(F.col("item_text")))
    lines = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))
    g = rows.groupBy("doc_id", "list_id").agg(F.min("rpos").alias("pos"), lines.alias("rows"))
    return g.select("doc_id", F.col("list_id").alias("node_id"), "pos", F.trim(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("block"))


def captions_and_notes(b: S.Bundle) -> DataFrame:
    """(doc_id, ref_id, caption, notes): the text blocks of each object."""
    words = b.elements.select("doc_id", "id", "text")
    caption = b.captions.join(words.withColumnRenamed("id", "caption_id"), ["doc_id", "caption_id"], "left").select("doc_id", "ref_id", T.one_line(F.col("text")).alias("caption"))
    notes = b.attached_notes.join(words.withColumnRenamed("id", "note_id"), ["doc_id", "note_id"], "left")
    rows = F.array_sort(F.collect_list(F.struct("nth", T.block_text(F.col("text")).alias("t"))))
    notes = notes.groupBy("doc_id", "ref_id").agg(F.transform(F.filter(rows, lambda r: r["t"] != ""), lambda r: r["t"]).alias("notes"))
    return caption.join(notes, ["doc_id", "ref_id"], "full_outer")


def object_blocks(refs: DataFrame, extras: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ref_id, block, way): Markdown, an image, or a placeholder, then
    the caption in italics and the notes. ``refs`` has markdown and path."""
    name = F.lit(kind.capitalize())
    image = F.concat(F.lit("!["), name, F.lit(" "), F.col("ref_id"), F.lit("]("), F.trim(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))), F.lit(")"))
    way = F.when(said(F.col("markdown")), "markdown").when(said(F.col("path")), "image").otherwise("placeholder")
    main = F.when(said(F.col("markdown")), F.trim("markdown")).when(said(F.col("path")), image).otherwise(F.concat(F.lit(f"[{kind.upper()} PLACEHOLDER: "), F.col("ref_id"), F.lit("]")))
    caption = F.when(said(F.col("caption")), F.concat(F.lit("*"), F.col("caption"), F.lit("*")))
    rows = refs.join(extras, ["doc_id", "ref_id"], "left")
    return rows.select("doc_id", "ref_id", joined(main, caption, F.array_join("notes", "\n\n")).alias("block"), way.alias("way"))


def blocks(b: S.Bundle, assets: DataFrame) -> DataFrame:
    """(doc_id, node_type, node_id, tail, pos, block, way): what each node of
    the tree gives, in the order of the tree. ``assets`` has (doc_id, ref_id,
    markdown, path)."""
    none = F.lit(None).cast("string")
    extras = captions_and_notes(b)
    tree = S.sections(b.groups)
    head = F.concat(F.repeat(F.lit("#"), F.least(F.lit(4), F.greatest(F.lit(1), F.col("level")))), F.lit(" "), T.one_line(F.col("title")))
    out = tree.select("doc_id", F.lit("section").alias("node_type"), F.col("section_id").alias("node_id"), F.lit(0).alias("tail"), F.col("pos").cast("long").alias("pos"), head.alias("block"), none.alias("way"))
    p = S.paragraphs(b.groups)
    out = out.unionByName(p.select("doc_id", F.lit("paragraph_group").alias("node_type"), "node_id", F.lit(0).alias("tail"), F.col("pos").cast("long").alias("pos"), T.block_text(F.col("text")).alias("block"), none.alias("way")))
    lists = list_blocks(S.list_items(b.groups))
    out = out.unionByName(lists.select("doc_id", F.lit("list_group").alias("node_type"), "node_id", F.lit(0).alias("tail"), F.col("pos").cast("long").alias("pos"), "block", none.alias("way")))
    anchored = b.groups.select("doc_id", F.col("id").alias("ref_id"), F.col("rpos").cast("long").alias("rpos"), "role")
    for tail, (kind, refs) in enumerate((("table", b.tables), ("figure", b.figures)), start=1):
        made = object_blocks(refs.join(assets, ["doc_id", "ref_id"], "left"), extras, kind)
        placed = refs.select("doc_id", "ref_id", "ref_order").join(anchored.filter(F.col("role") == kind).drop("role"), ["doc_id", "ref_id"], "left")
        rows = made.join(placed, ["doc_id", "ref_id"])
        out = out.unionByName(rows.select("doc_id", F.lit(f"{kind}_ref").alias("node_type"), F.col("ref_id").alias("node_id"), F.when(F.col("rpos").isNull(), tail).otherwise(0).alias("tail"), F.coalesce("rpos", F.col("ref_order").cast("long")).alias("pos"), "block", "way"))
    alone = b.notes.join(b.attached_notes.select("doc_id", F.col("note_id").alias("ref_id")), ["doc_id", "ref_id"], "left_anti")
    alone = alone.join(anchored.filter("role = 'note'").drop("role"), ["doc_id", "ref_id"], "left")
    body = T.block_text(F.col("text"))
    out = out.unionByName(alone.select("doc_id", F.lit("note_ref").alias("node_type"), F.col("ref_id").alias("node_id"), F.when(F.col("rpos").isNull(), 3).otherwise(0).alias("tail"), F.coalesce("rpos", F.col("ref_order").cast("long")).alias("pos"), F.when(body != "", F.concat(F.lit("> "), body)).otherwise("").alias("block"), none.alias("way")))
    return out


def tidy(c: Column) -> Column:
    """No blanks at line ends, no double blank lines, no blank edges."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), r"(?m)[ \t\x0B\f]+$", "")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def documents(made: DataFrame) -> DataFrame:
    """(doc_id, markdown, n_blocks, n_placeholders, n_fallbacks)."""
    rows = F.array_sort(F.collect_list(F.struct("tail", "pos", "node_type", "block")))
    whole = F.array_join(F.transform(F.filter(rows, lambda r: r["block"] != ""), lambda r: r["block"]), "\n\n")
    return made.groupBy("doc_id").agg(
        tidy(whole).alias("markdown"),
        F.count_if(F.col("block") != "").alias("n_blocks"),
        F.count_if(F.col("way") == "placeholder").alias("n_placeholders"),
        F.count_if((F.col("way") == "image") & (F.col("node_type") == "table_ref")).alias("n_fallbacks"),
    )


#: White space at the end of a line; a run of it is tried from its start only.
_BLANK = r"(?<![ \t\x0B\f])[ \t\x0B\f]++(?![^\n])"


def cleanup(markdown: Column) -> Column:
    """What ``tidy`` does to a text, counted: lines that lose blanks at their end,
    blank lines after blank ones, blank lines at the edges, lines before and after.

    Counts are differences of lengths, so time is linear in the text; a lambda
    that reads an array of lines would make that array anew for each line."""
    text = F.regexp_replace(F.coalesce(markdown, F.lit("")), "\r\n|\r", "\n")
    marked = F.regexp_replace(text, _BLANK, "\r")  # text has no \r any more
    bare = F.replace(marked, F.lit("\r"), F.lit(""))
    edged = F.concat(F.lit("\n"), bare, F.lit("\n"))  # a blank line lies between two \n
    again = F.length(edged) - F.length(F.regexp_replace(edged, "\n{3,}", "\n\n"))
    said = (F.length(text) > 0).cast("int")
    before = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + said
    left = before - again
    first, last = edged.startswith("\n\n").cast("int"), edged.endswith("\n\n").cast("int")
    edges = said * (first + last * (left > 1).cast("int"))
    counts = {"trimmed_lines": F.length(marked) - F.length(bare), "collapsed_lines": again, "edge_lines": edges, "lines_before": before, "lines_after": left - edges}
    return F.struct(*[c.cast("int").alias(n) for n, c in counts.items()])


#: Node types that are rendered.
NODE_TYPES = ("section", "paragraph_group", "list_group", "table_ref", "figure_ref", "note_ref")


def render_warnings(made: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, node_id): titles and paragraphs that are blank, nodes that
    only have a placeholder, tables that are pictures, and nodes of ``extra``
    (doc_id, node_type, node_id) of types that are not rendered. ``made`` is what
    ``blocks`` gives."""
    blank = F.coalesce(F.trim("block"), F.lit("")) == ""
    title = F.trim(F.regexp_replace(F.coalesce("block", F.lit("")), "^#+", "")) == ""
    code = (
        F.when((F.col("node_type") == "section") & title, "empty_heading")
        .when((F.col("node_type") == "paragraph_group") & blank, "empty_paragraph")
        .when(F.col("way") == "placeholder", F.concat(F.regexp_replace("node_type", "_ref$", ""), F.lit("_placeholder")))
        .when((F.col("way") == "image") & (F.col("node_type") == "table_ref"), "table_crop_fallback")
    )
    out = made.withColumn("code", code).filter("code is not null").select("doc_id", "code", "node_id")
    if extra is None:
        return out
    odd = extra.filter(~F.coalesce(F.col("node_type").isin(*NODE_TYPES), F.lit(False)))
    return out.unionByName(odd.select("doc_id", F.lit("unsupported_node_type").alias("code"), "node_id"))


def guarded(stage: str | None) -> None:
    """Only validated documents are rendered."""
    if stage != "validated":
        raise ValueError(f"documents of stage {stage!r} cannot be rendered; they have to be validated")


def report(made: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, n_sections, n_tables, n_figures, n_notes, n_blocks, n_warnings,
    n_placeholders, n_fallbacks, codes): a document's statistics; codes counts
    warnings by code, as JSON."""
    n = lambda t: F.count_if(F.col("node_type") == t)
    per = made.groupBy("doc_id").agg(n("section").alias("n_sections"), n("table_ref").alias("n_tables"), n("figure_ref").alias("n_figures"), n("note_ref").alias("n_notes"), F.count_if(F.coalesce(F.trim("block"), F.lit("")) != "").alias("n_blocks"))
    by = warnings.groupBy("doc_id", "code").agg(F.count("*").alias("n"))
    codes = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))))
    found = by.groupBy("doc_id").agg(codes.alias("codes"), F.sum("n").alias("n_warnings"), F.sum(F.when(F.col("code").isin("table_placeholder", "figure_placeholder"), F.col("n")).otherwise(0)).alias("n_placeholders"), F.sum(F.when(F.col("code") == "table_crop_fallback", F.col("n")).otherwise(0)).alias("n_fallbacks"))
    out = per.join(found, "doc_id", "left")
    return out.na.fill(0).withColumn("codes", F.coalesce("codes", F.lit("{}")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def images(assets: DataFrame) -> DataFrame:
    """(doc_id, filename, path): one row per file name of a document, the first
    object's path; what the service sends beside the Markdown."""
    rows = assets.filter(said(F.col("path"))).withColumn("filename", file_name(F.col("path")))
    return rows.groupBy("doc_id", "filename").agg(F.min_by("path", "ref_id").alias("path"))
