"""Queries beside assembly: recognition, payload shapes, references, answers of
models, integrity of references, rendering reports, paths and results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets as A
from ..operators import enrich as E
from ..operators import recognise as K
from ..operators import render as R
from ..operators import structure as S
from ..operators import validate as V
from ..sinks import files as O
from ..sources import derived, payload
from ..sources import files as I
from . import catalogue as C
from .oracle import select

query, bundle, chained = C.query, C.bundle, C.chained

# --- recognition ------------------------------------------------------------------

_READ = "('Text', 'Section-header', 'List-item', 'Caption', 'Page-header', 'Page-footer', 'Title', 'Subtitle')"


@query(select(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN type IN {_READ} THEN text ELSE '[' || type || ' Image]' END AS text FROM layout"))
def q_text_placeholders(spark, sf):
    return derived.layout(spark, sf).select("doc_id", F.col("pos").cast("int").alias("pos"), K.placeholder_text(F.col("type"), F.col("text")).alias("text"))


@query(select(f"""SELECT doc_id, CASE WHEN pos % 4 = 0 THEN 'p' || page || '_table_' || pos WHEN pos % 4 = 1 THEN 'p' || page || '_table_7' WHEN pos % 4 = 2 THEN 'T' || pos ELSE 'p' || page || '_table_unknown' END AS table_id,
  page, CASE WHEN pos % 5 > 1 THEN '| ' || pos || ' |' END AS markdown, CASE pos % 5 WHEN 0 THEN '{K.NO_TABLE} x' WHEN 1 THEN 'out of memory' END AS extraction_error
  FROM layout WHERE type = 'Table' AND doc_id % 3 <> 0"""))
def q_table_results(spark, sf):
    """Tables with a crop, some without an id, some that a model finds nothing in
    or fails on."""
    i = F.col("pos")
    rows = derived.layout(spark, sf)
    given = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, " 7 ").when(i % 4 == 2, F.concat(F.lit(" T"), i.cast("string")))
    answer = F.when(i % 5 == 0, K.NO_TABLE + " x").when(i % 5 > 1, F.concat(F.lit("| "), i.cast("string"), F.lit(" |")))
    rows = rows.select("doc_id", "page", given.alias("given_id"), "type", F.when(F.col("doc_id") % 3 != 0, F.lit("c.png")).alias("crop"), answer.alias("answer"), F.when(i % 5 == 1, "out of memory").alias("failure"))
    return K.table_results(rows).select("doc_id", "table_id", "page", "markdown", "extraction_error")


# --- payloads ---------------------------------------------------------------------


@query(select("SELECT doc_id || '-' || pos AS doc_id, 'element_1' AS id, 1 AS page, kind, text, label, x1, y1, x2, y2, confidence FROM elements"))
def q_payload_shapes(spark, sf):
    """Every block as a payload of its own: a bare element, a list, a list under a
    name; boxes as four numbers, corners, edges, or place and size."""
    rows = derived.layout(spark, sf)
    i = F.col("pos")
    n = {c: F.to_json(F.struct(F.col(c).alias("v")))for c in ("x1", "y1", "x2", "y2")}
    number = lambda c: F.regexp_extract(c, r":(.*)\}$", 1)
    x1, y1, x2, y2 = (number(n[c]) for c in ("x1", "y1", "x2", "y2"))
    size = lambda a, b: (F.col(b) - F.col(a)).cast("string")
    obj = lambda **kw: F.concat(F.lit("{"), *[x for k, (name, v) in enumerate(kw.items()) for x in (F.lit(("," if k else "") + f'"{name}":'), v)], F.lit("}"))
    box = F.when(i % 4 == 0, F.concat(F.lit('{"bbox":['), x1, F.lit(","), y1, F.lit(","), x2, F.lit(","), y2, F.lit("]}")))
    box = box.when(i % 4 == 1, F.concat(F.lit('{"box":'), obj(x1=x1, y1=y1, x2=x2, y2=y2), F.lit("}"))).when(i % 4 == 2, F.concat(F.lit('{"bounds":'), obj(left=x1, top=y1, right=x2, bottom=y2), F.lit("}")))
    box = box.otherwise(F.concat(F.lit('{"rect":'), obj(x=x1, y=y1, width=size("x1", "x2"), height=size("y1", "y2")), F.lit("}")))
    rest = F.to_json(F.struct(F.col("type").alias("class"), F.col("text").alias("content"), F.col("confidence").alias("score")))
    one = F.concat(F.regexp_replace(box, r"\}$", ","), F.substring(rest, 2, 1 << 30))
    text = F.when(i % 3 == 0, one).when(i % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"regions":['), one, F.lit("]}")))
    src = payload.sources(rows.select(F.concat_ws("-", "doc_id", i.cast("string")).alias("doc_id"), text.alias("payload")))
    return payload.elements(src).select("doc_id", "id", "page", "kind", "text", "label", "x1", "y1", "x2", "y2", "confidence")


_TABLE = "'| ' || pos || ' |' || chr(10) || '|---|'"


@query(select(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS nth, CASE WHEN pos % 3 = 1 THEN 'k' || pos ELSE 'table_' || row_number() OVER (PARTITION BY doc_id ORDER BY pos) END AS ref_id,
  CASE WHEN pos % 3 <> 2 THEN {_TABLE} END AS markdown, CASE WHEN pos % 3 = 1 THEN 'c' || pos WHEN pos % 3 = 2 THEN 'c' END AS caption_id, CASE WHEN pos % 3 = 1 THEN 'n1,n2' WHEN pos % 3 = 2 THEN 'n' ELSE '' END AS note_ids FROM layout WHERE type IN ('Table', 'Picture')"""))
def q_payload_tables(spark, sf):
    """Table payloads whose entries are Markdown or objects, with references that
    are ids or objects, one or several."""
    i = F.col("pos")
    md = F.concat(F.lit("| "), i.cast("string"), F.lit(" |\n|---|"))
    said = F.to_json(F.array(md))
    said = F.regexp_extract(said, r"^\[(.*)\]$", 1)
    full = F.to_json(F.struct(F.concat(F.lit("k"), i.cast("string")).alias("table_key"), md.alias("md"), F.struct(F.concat(F.lit("c"), i.cast("string")).alias("caption_id")).alias("caption")))
    full = F.concat(F.regexp_replace(full, r"\}$", ""), F.lit(',"notes":[{"uuid":"n1"},"n2",null]}'))
    some = F.lit('{"markdown":"no table","caption_ref":"c","note_refs":"n"}')
    rows = derived.layout(spark, sf).filter(F.col("type").isin("Table", "Picture")).select("doc_id", "pos", F.when(i % 3 == 0, said).when(i % 3 == 1, full).otherwise(some).alias("e"))
    docs = rows.groupBy("doc_id").agg(F.concat(F.lit('{"table_results":{"results":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda r: r["e"]), ","), F.lit("]}}")).alias("payload"))
    out = payload.table_extracts(payload.sources(docs))
    return out.select("doc_id", F.col("nth").cast("int").alias("nth"), "ref_id", "markdown", "caption_id", F.array_join("note_ids", ",").alias("note_ids"))


@query("SELECT doc_id, '{\"author\":\"\\\"' || source || '\\\"\"' || CASE WHEN doc_id % 2 = 0 THEN ',\"size\":\"' || doc_id || '\"' ELSE '' END || '}' AS layout, '{\"engine\":\"' || doc_id || '\"}' AS tables FROM documents WHERE source IS NOT NULL")
def q_payload_metadata(spark, sf):
    """What documents say besides pages and tables; nulls are left out."""
    docs = C.table(spark, sf, "documents").filter("source is not null")
    name, size = F.to_json(F.struct(F.col("source").alias("author"))), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("null")
    text = F.concat(F.lit('{"layout":'), F.regexp_replace(name, r"\}$", ""), F.lit(',"size":'), size, F.lit(',"gone":null,"pages":[]},"table_results":{"engine":'), F.col("doc_id").cast("string"), F.lit(',"tables":[]}}'))
    found = payload.document_metadata(payload.sources(docs.select("doc_id", text.alias("payload"))))
    flat = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return found.select("doc_id", flat("layout").alias("layout"), flat("tables").alias("tables"))


@query(select("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY src, place) - 1 AS INTEGER) AS nth, ref_id, said FROM (
  SELECT doc_id, id AS ref_id, 0 AS src, ref_order AS place, CASE WHEN ref_order % 2 = 0 THEN 'second' ELSE 'first' END AS said FROM synced WHERE kind = 'table'
  UNION ALL SELECT doc_id, 'new_' || ref_order, 1, ref_order, 'second' FROM synced WHERE kind = 'table' AND ref_order % 3 = 0)"""))
def q_refs_merge(spark, sf):
    """References of two sources; the second one's count, in the first's places."""
    t = bundle(spark, sf).tables.select("doc_id", F.col("ref_order").alias("nth"), "ref_id")
    again = t.filter("nth % 2 = 0").withColumn("said", F.lit("second"))
    new = t.filter("nth % 3 = 0").select("doc_id", "nth", F.concat(F.lit("new_"), F.col("nth").cast("string")).alias("ref_id"), F.lit("second").alias("said"))
    lost = t.select("doc_id", "nth", F.lit(None).cast("string").alias("ref_id"), F.lit("x").alias("said"))
    return payload.merged_refs(t.withColumn("said", F.lit("first")), again.unionByName(new).unionByName(lost)).withColumn("nth", F.col("nth").cast("int"))


# --- answers of models --------------------------------------------------------------


@query(select("SELECT doc_id, id, 'heading' AS kind, CAST(least(6, greatest(1, rpos % 9)) AS INTEGER) AS heading_level FROM ordered WHERE rpos % 4 = 0"))
def q_llm_wrapped_answers(spark, sf):
    """Answers in code fences, or with words and broken JSON around them."""
    e = bundle(spark, sf).elements.filter("rpos % 4 = 0")
    one = F.struct("id", F.lit("heading").alias("kind"), (F.col("rpos") % 9).alias("heading_level"), F.lit(0.9).alias("confidence"))
    answers = e.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(one).alias("decisions"))).alias("a"))
    way = F.col("doc_id") % 4
    said = F.when(way == 0, F.col("a")).when(way == 1, F.concat(F.lit(" ```JSON\n"), F.col("a"), F.lit("\n``` "))).when(way == 2, F.concat(F.lit("Sure {not json]: "), F.col("a"), F.lit(" Done {}"))).otherwise(F.concat(F.lit("[1, "), F.col("a")))
    return E.parse_decisions(answers.select("doc_id", said.alias("answer"))).select("doc_id", "id", "kind", "heading_level")


@query(select("""SELECT s.doc_id, s.id AS ref_id, CASE WHEN ref_order % 3 = 0 THEN o.id ELSE c.caption_id END AS caption_id, CASE WHEN ref_order % 3 = 0 THEN c.caption_id IS DISTINCT FROM o.id ELSE false END AS relinked
  FROM synced s JOIN (SELECT doc_id, arg_max(id, rpos) AS id FROM ordered GROUP BY doc_id) o USING (doc_id) LEFT JOIN captions c ON c.doc_id = s.doc_id AND c.ref_id = s.id WHERE s.kind IN ('table', 'figure')"""))
def q_caption_link_apply(spark, sf):
    """Objects after links to their document's last block, of which the second of
    each counts, and links to captions that do not exist."""
    b = bundle(spark, sf)
    refs = _objects(b)
    block = F.max_by("id", "rpos").alias("last"), F.min_by("id", "rpos").alias("first")
    asked = refs.filter("ref_order % 3 < 2").join(b.elements.groupBy("doc_id").agg(*block), "doc_id")
    row = lambda c: F.struct(c.alias("caption_id"), F.col("ref_id").alias("target_id"), F.lit(0.9).alias("confidence"))
    links = F.when(F.col("ref_order") % 3 == 0, F.array(row(F.col("first")), row(F.col("last")), row(F.lit("ghost")))).otherwise(F.array(row(F.lit("ghost"))))
    answers = asked.groupBy("doc_id").agg(F.to_json(F.struct(F.flatten(F.collect_list(links)).alias("links"))).alias("answer"))
    found, _ = E.apply_links(refs.drop("ref_order", "page"), b.elements, E.all_links(answers))
    return found


def _objects(b: S.Bundle) -> DataFrame:
    """(doc_id, ref_id, ref_order, page, caption_id) of tables and figures."""
    refs = b.tables.select("doc_id", "ref_id", "ref_order", "page").unionByName(b.figures.select("doc_id", "ref_id", "ref_order", "page"))
    return refs.join(b.captions.select("doc_id", "ref_id", "caption_id"), ["doc_id", "ref_id"], "left")


class Suggests:
    """A model that follows the hints of even requests' candidates whose id ends
    in an even digit, links one unknown caption a request, and fails on requests
    of one candidate."""

    def generate_json(self, task: str, payload: list[dict]) -> str:
        if task == E.CONTENT:
            return json.dumps({"repairs": [{"node_id": c["node_id"], "text": (" " if c["pos"] % 3 == 0 else "x" if c["pos"] % 3 == 1 else "") + c["text"], "confidence": 0.9} for c in payload]})
        if len(payload) == 1:
            raise ValueError("too short")
        decisions = [{"id": c["id"], "kind": c["hint"], "confidence": 0.8} for c in payload if c["rpos"] % 2 == 0]
        return json.dumps({"decisions": decisions, "links": [{"caption_id": "ghost", "target_id": payload[0]["id"], "confidence": 1}]})


_ASKED = """, asked AS (SELECT *, CASE WHEN reason = 'existing_kind' THEN kind WHEN reason IN ('label_caption', 'caption_pattern') THEN 'caption' WHEN reason = 'note_pattern' THEN 'note' ELSE 'heading' END AS hint,
  (row_number() OVER (PARTITION BY doc_id ORDER BY rpos) - 1) // 8 AS request FROM cand WHERE reason IS NOT NULL),
said AS (SELECT *, count(*) OVER (PARTITION BY doc_id, request) AS n FROM asked)"""


@query(chained(C._CAND + _ASKED, "SELECT doc_id, count(*) AS candidates, count(DISTINCT request) AS requests, count(DISTINCT request) FILTER (WHERE n = 1) AS failed, count(*) FILTER (WHERE n > 1 AND rpos % 2 = 0) AS decided, CAST(0 AS BIGINT) AS unknown, count(*) FILTER (WHERE n > 1 AND rpos % 2 = 0 AND hint <> kind) AS changed, CAST(0 AS BIGINT) AS relinked FROM said GROUP BY doc_id"))
def q_semantic_counts(spark, sf):
    """Counts of the whole chain: select, ask, parse, apply, warn."""
    b = bundle(spark, sf)
    return E.enrich_semantics(b.elements, b.stats, _objects(b).drop("ref_order", "page"), Suggests, E.Config("semantic"))["counts"]


@query(chained(C._CAND + _ASKED, "SELECT doc_id, 'llm_semantic_failed' AS code, '' AS ids FROM said WHERE n = 1 UNION ALL SELECT DISTINCT ON (doc_id, request) doc_id, 'llm_caption_link_unknown_caption', 'ghost' FROM said WHERE n > 1"))
def q_semantic_warnings(spark, sf):
    b = bundle(spark, sf)
    return E.enrich_semantics(b.elements, b.stats, _objects(b).drop("ref_order", "page"), Suggests, E.Config("all"))["warnings"].select("doc_id", "code", "ids")


@query(C.LINES.rstrip() + f", {C._NODES}, per AS (SELECT doc_id, count(*) AS candidates, count(DISTINCT request) AS requests, count(*) FILTER (WHERE pos % 3 = 0) AS applied, count(*) FILTER (WHERE pos % 3 = 1) AS discarded, count(*) FILTER (WHERE pos % 3 = 2) AS unchanged FROM cands GROUP BY doc_id) SELECT l.doc_id, coalesce(candidates, 0) AS candidates, coalesce(requests, 0) AS requests, coalesce(candidates, 0) AS matched, CAST(0 AS BIGINT) AS missing, coalesce(applied, 0) AS applied, coalesce(discarded, 0) AS discarded, coalesce(unchanged, 0) AS unchanged FROM (SELECT DISTINCT doc_id FROM lines) l LEFT JOIN per USING (doc_id)")
def q_repair_counts(spark, sf):
    """Counts of the whole chain of content repairs."""
    counts = E.repair_contents(C._repair_nodes(spark, sf), Suggests, E.Config("content"))["counts"]
    return counts.select("doc_id", "candidates", "requests", "matched", "missing", (F.col("applied") - F.col("rule")).alias("applied"), "discarded", "unchanged")


@query(C.LINES.rstrip() + f", {C._NODES}, one AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM cands) SELECT doc_id, node_id, 'mended ' || r AS repair FROM one WHERE r % 3 <> 2")
def q_single_repairs(spark, sf):
    """Requests of one node: the only repair of an answer counts under any name,
    two repairs only under the right one."""
    asked = E.repair_candidates(C._repair_nodes(spark, sf), batch=1)
    row = lambda c: F.struct(c.alias("node_id"), F.concat(F.lit("mended "), F.col("request").cast("string")).alias("text"), F.lit(0.9).alias("confidence"))
    odd, own, r = row(F.lit("other")), row(F.col("node_id")), F.col("request") % 3
    said = F.when(r == 0, F.array(odd)).when(r == 1, F.array(own, odd)).otherwise(F.array(odd, row(F.lit("another"))))
    return E.matched_repairs(asked, asked.select("doc_id", "request", F.to_json(F.struct(said.alias("repairs"))).alias("answer"))).select("doc_id", "node_id", "repair")


# --- integrity of references ----------------------------------------------------------


def _of(b: S.Bundle, kind: str) -> DataFrame:
    return S.relations(b).filter(F.col("type") == f"{kind}_of").drop("type")


@query(select("SELECT o.doc_id, 'relation_conflict' AS code, o.kind || '_of_other_parent' AS about, page, string_agg(o.id, ',' ORDER BY rpos) AS ids FROM ordered o WHERE o.kind IN ('caption', 'note') AND rpos % 3 = 0 AND EXISTS (SELECT 1 FROM attached a WHERE a.doc_id = o.doc_id AND a.id = o.id) GROUP BY ALL"))
def q_validate_parents(spark, sf):
    """Captions and notes of which every third says that it is in a section."""
    b = bundle(spark, sf)
    said = S.parents(b).withColumn("parent_id", F.when(F.col("rpos") % 3 == 0, "section_x").otherwise(F.col("parent_id")))
    return V.other_parents(said, _of(b, "caption"), "caption").unionByName(V.other_parents(said, _of(b, "note"), "note"))


@query(select("""SELECT s.doc_id, 'relation_conflict' AS code, CASE WHEN ref_order % 3 = 0 THEN 'caption_unknown' ELSE 'caption_without_link' END AS about, s.page, s.id || ',' || CASE WHEN ref_order % 3 = 0 THEN 'ghost' ELSE c.caption_id END AS ids FROM synced s JOIN captions c ON c.doc_id = s.doc_id AND c.ref_id = s.id WHERE ref_order % 3 < 2
  UNION ALL SELECT n.doc_id, 'relation_conflict', 'note_without_link', s.page, n.ref_id || ',' || n.note_id FROM notes n JOIN synced s ON s.doc_id = n.doc_id AND s.id = n.ref_id WHERE ref_order % 3 = 1"""))
def q_validate_references(spark, sf):
    """Objects of which some name a caption that does not exist, and links of
    which some are lost."""
    b = bundle(spark, sf)
    caps = _objects(b).filter("caption_id is not null").withColumn("part_id", F.when(F.col("ref_order") % 3 == 0, "ghost").otherwise(F.col("caption_id")))
    notes = b.tables.select("doc_id", "ref_id", "ref_order", "page").join(b.attached_notes.select("doc_id", "ref_id", F.col("note_id").alias("part_id")), ["doc_id", "ref_id"])
    order = _objects(b).select("doc_id", F.col("ref_id").alias("dst"), "ref_order")
    left = lambda kind: _of(b, kind).join(order, ["doc_id", "dst"]).filter("ref_order % 3 <> 1").drop("ref_order")
    return V.reference_conflicts(b.elements, caps, left("caption"), "caption").unionByName(V.reference_conflicts(b.elements, notes, left("note"), "note"))


@query(select("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS nth, 'warning' AS level, 'low_confidence_chunk' AS code, page, ids FROM (" + C._LOW + ")"))
def q_warning_merge(spark, sf):
    """Warnings of a stage merged with the same ones of a later stage."""
    low = V.unsure_blocks(bundle(spark, sf)).withColumn("nth", F.col("page")).withColumn("level", F.lit("warning")).withColumn("message", F.lit("unsure"))
    a = low.withColumn("metadata", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).drop("about")
    b = low.withColumn("metadata", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).drop("about")
    return V.merged(a, b).select("doc_id", F.col("nth").cast("int").alias("nth"), "level", "code", "page", "ids")


@query(select("SELECT doc_id, min_by(page, rpos) AS page FROM ordered WHERE kind IN ('table', 'figure', 'caption') GROUP BY doc_id"))
def q_first_known_page(spark, sf):
    e = bundle(spark, sf).elements
    ids = e.filter(F.col("kind").isin("table", "figure", "caption")).select("doc_id", F.col("rpos").alias("nth"), "id")
    ghosts = e.select("doc_id", F.lit(0).alias("nth"), F.lit("ghost").alias("id")).distinct()
    return V.first_known_page(e, ids.unionByName(ghosts))


# --- rendering and results --------------------------------------------------------------


@query(select("SELECT doc_id, regexp_replace(node_type, '_ref$', '') || '_placeholder' AS code, node_id FROM blocks WHERE way = 'placeholder' UNION ALL SELECT doc_id, 'table_crop_fallback', node_id FROM blocks WHERE way = 'image' AND node_type = 'table_ref' UNION ALL SELECT doc_id, 'empty_paragraph', node_id FROM blocks WHERE node_type = 'paragraph_group' AND pos % 5 = 0 UNION ALL SELECT doc_id, 'empty_heading', node_id FROM blocks WHERE node_type = 'section' AND pos % 5 = 0 UNION ALL SELECT doc_id, 'unsupported_node_type', id FROM ordered WHERE kind = 'formula'"))
def q_render_warnings(spark, sf):
    """Blocks of which every fifth title and paragraph is blank, and nodes of a
    type that is not rendered."""
    b = bundle(spark, sf)
    blank = F.when((F.col("pos") % 5 == 0) & (F.col("node_type") == "section"), "## ").when((F.col("pos") % 5 == 0) & (F.col("node_type") == "paragraph_group"), " ").otherwise(F.col("block"))
    odd = b.elements.filter("kind = 'formula'").select("doc_id", F.lit("formula_ref").alias("node_type"), F.col("id").alias("node_id"))
    return R.render_warnings(R.blocks(b, C.assets(b)).withColumn("block", blank), odd)


@query(select("SELECT doc_id, count(*) FILTER (WHERE node_type = 'section') AS n_sections, count(*) FILTER (WHERE node_type = 'table_ref') AS n_tables, count(*) FILTER (WHERE node_type = 'figure_ref') AS n_figures, count(*) FILTER (WHERE node_type = 'note_ref') AS n_notes, count(*) FILTER (WHERE trim(block) <> '') AS n_blocks, count(*) FILTER (WHERE way = 'placeholder') AS n_placeholders, count(*) FILTER (WHERE way = 'image' AND node_type = 'table_ref') AS n_fallbacks, count(*) FILTER (WHERE way = 'placeholder' OR (way = 'image' AND node_type = 'table_ref')) AS n_warnings FROM blocks GROUP BY doc_id"))
def q_render_report(spark, sf):
    b = bundle(spark, sf)
    made = R.blocks(b, C.assets(b))
    return R.report(made, R.render_warnings(made)).drop("codes")


_RAW = r"""WITH raw AS (SELECT doc_id, regexp_replace(chr(10) || chr(10) || text, '[.] ', '. ' || chr(10) || chr(10) || '  ' || chr(13), 'g') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM raw)),
b AS (SELECT *, regexp_replace(line, '[ \t\x0B\f]+$', '') AS bare FROM l),
c AS (SELECT *, bare = '' AND coalesce(lag(bare) OVER (PARTITION BY doc_id ORDER BY k) = '', false) AS again FROM b),
e AS (SELECT doc_id, count(*) AS before, count(*) FILTER (WHERE line <> bare) AS trimmed, count(*) FILTER (WHERE again) AS collapsed, arg_min(bare, k) = '' AS f, arg_max(bare, k) = '' AS z FROM c GROUP BY doc_id),
g AS (SELECT *, CASE WHEN before - collapsed = 1 THEN f::INTEGER ELSE f::INTEGER + z::INTEGER END AS edges FROM e)
SELECT doc_id, trimmed::INTEGER AS trimmed_lines, collapsed::INTEGER AS collapsed_lines, edges AS edge_lines, before::INTEGER AS lines_before, (before - collapsed - edges)::INTEGER AS lines_after FROM g"""


@query(_RAW)
def q_render_cleanup(spark, sf):
    """Untidy texts: blank lines at the start and after each sentence."""
    docs = C.table(spark, sf, "documents").filter("text is not null")
    untidy = F.regexp_replace(F.concat(F.lit("\n\n"), F.col("text")), r"[.] ", ". \n\n  \r")
    return docs.select("doc_id", R.cleanup(untidy).alias("c")).select("doc_id", "c.*")


_PATHS = "CASE doc_id % 6 WHEN 0 THEN 'crops\\t' || doc_id || '.png' WHEN 1 THEN '/work/out/' || doc_id || '/a.png' WHEN 2 THEN 'https://h/a.png' WHEN 3 THEN '/other/b.png' WHEN 4 THEN './x/../y/c.png' ELSE 'out/' || doc_id END"
_SEEN = "CASE doc_id % 6 WHEN 0 THEN '../../crops/t' || doc_id || '.png' WHEN 1 THEN 'a.png' WHEN 2 THEN 'https://h/a.png' WHEN 3 THEN '../../../other/b.png' WHEN 4 THEN '../../y/c.png' ELSE '.' END"


@query(f"SELECT doc_id, {_SEEN} AS path, regexp_replace(replace(text, '](', '] ('), '[.] ', '.![a b](' || {_SEEN} || ') ', 'g') AS markdown FROM documents WHERE text IS NOT NULL")
def q_asset_paths(spark, sf):
    """Images after each sentence, named relative to the folder of the Markdown."""
    d = F.col("doc_id").cast("string")
    way = F.col("doc_id") % 6
    path = F.when(way == 0, F.concat(F.lit("crops\\t"), d, F.lit(".png"))).when(way == 1, F.concat(F.lit("/work/out/"), d, F.lit("/a.png"))).when(way == 2, "https://h/a.png").when(way == 3, "/other/b.png").when(way == 4, "./x/../y/c.png").otherwise(F.concat(F.lit("out/"), d))
    docs = C.table(spark, sf, "documents").filter("text is not null").withColumn("path", path)
    folder, base = F.concat(F.lit("/work/out/"), d), F.lit("/work")
    image = F.concat(F.lit(".![a b]("), F.col("path"), F.lit(") "))
    text = F.replace(F.replace(F.col("text"), F.lit("]("), F.lit("] (")), F.lit(". "), image)
    return docs.select("doc_id", A.relative_path(F.col("path"), folder, base).alias("path"), A.rewritten(text, folder, base).alias("markdown"))


@query(r"SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.v1' ELSE '' END AS stem, CASE WHEN doc_id % 4 < 3 THEN CASE doc_id % 4 WHEN 0 THEN 'pdf' ELSE 'image' END END AS file_type, '/r/data/output/doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.v1' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '/llm_enrichment/content' ELSE '' END AS folder FROM documents")
def q_output_dirs(spark, sf):
    """Types of files by their names, and where their results go."""
    d = F.col("doc_id")
    end = F.when(d % 4 == 0, ".PDF").when(d % 4 == 1, ".png").when(d % 4 == 2, ".Jpeg").otherwise(".docx")
    name = F.concat(F.lit("/in/x.y/doc"), d.cast("string"), F.when(d % 2 == 0, ".v1").otherwise(""), end)
    rows = I.typed(C.table(spark, sf, "documents").select("doc_id", name.alias("path")))
    mode = F.when(d % 3 == 0, "content").otherwise("baseline")
    return rows.select("doc_id", I.stem(F.col("path")).alias("stem"), "file_type", O.output_dir(F.lit("/r"), F.col("path"), mode).alias("folder"))


@query(select(r"SELECT doc_id, regexp_extract(p, '([^/]*)$', 1) AS filename, to_base64(encode(min(p))) AS data FROM (SELECT doc_id, replace(path, '\', '/') AS p FROM assets WHERE path IS NOT NULL) GROUP BY ALL"))
def q_service_images(spark, sf):
    """Images beside the Markdown in base64; the files hold their own paths."""
    made = C.assets(bundle(spark, sf))
    files = made.filter("path is not null").select(F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path")).distinct().withColumn("content", F.encode("path", "UTF-8"))
    return O.service_images(made, files)
