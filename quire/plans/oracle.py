"""SQL for another engine that gives what the queries give.

One chain of common table expressions follows documents from lines of text to
assembled structure; each query selects from it.
"""

from __future__ import annotations

from ..sources.derived import LAYOUT_SQL

_NUM = r"'^(page\s*\d+(\s*/\s*\d+)?|\d+\s*/\s*\d+)$'"
_ORD = r"'^\s*(\d+[.)]|[A-Za-z][.)]|\(\d+\)|\([A-Za-z]\))\s+'"
_UNORD = r"'^\s*[-*•◦▪‣·]\s+'"
_TABLE, _FIGURE = r"'^\s*(table|tbl\.?)\s*\d*'", r"'^\s*(figure|fig\.?)\s*\d*'"
_NOTE = r"'^\s*(note\b|note:|source:)'"
_KINDS = "CASE type WHEN 'Section-header' THEN 'heading' WHEN 'Title' THEN 'heading' WHEN 'List-item' THEN 'list_item' WHEN 'Table' THEN 'table' WHEN 'Caption' THEN 'caption' WHEN 'Footnote' THEN 'note' WHEN 'Picture' THEN 'figure' WHEN 'Formula' THEN 'formula' WHEN 'Page-header' THEN 'header' ELSE 'text' END"


def normal(c: str) -> str:
    return rf"nullif(trim(regexp_replace({c}, '\s+', ' ', 'g')), '')"


def signature(c: str) -> str:
    return rf"regexp_replace({c}, '\s+', '', 'g')"


def overlap(a: str, b: str) -> str:
    """Horizontal overlap of boxes with column prefixes a and b."""
    w = f"least({a}x2 - {a}x1, {b}x2 - {b}x1)"
    return f"(CASE WHEN {w} <= 0 THEN 0.0 ELSE greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) / {w} END)"


def common(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


def area(a: str) -> str:
    return f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1))"


def line(c: str = "median_line_height") -> str:
    return f"coalesce(greatest(1.0, {c}), 12.0)"


def level(text: str, height: str, body: str) -> str:
    number = rf"regexp_extract({text}, '^\s*(\d+(\.\d+)*)[.)]?\s+', 1)"
    base = f"coalesce(CASE WHEN {body} > 0 THEN {body} END, 12.0)"
    letters = rf"(regexp_matches({text}, '^\s*\((\d+|[A-Za-z])\)\s+') OR regexp_matches({text}, '^\s*[A-Za-z][.)]\s+'))"
    return f"CASE WHEN {number} <> '' THEN length(regexp_replace({number}, '[^.]', '', 'g')) + 1 WHEN {letters} THEN 2 WHEN {height} >= {base} * 1.8 THEN 1 WHEN {height} >= {base} * 1.2 THEN 2 ELSE 3 END"


def level_source(text: str, height: str, body: str) -> str:
    letters = rf"regexp_matches({text}, '^\s*[A-Za-z][.)]\s+')"
    return rf"CASE WHEN regexp_matches({text}, '^\s*\d+(\.\d+)*[.)]?\s+') THEN 'numeric_pattern' WHEN regexp_matches({text}, '^\s*\((\d+|[A-Za-z])\)\s+') THEN 'paren_pattern' WHEN {letters} THEN 'korean_pattern' WHEN {body} IS NOT NULL THEN 'height_ratio' ELSE 'default' END"


def links(kind: str, pattern: str) -> str:
    """Captions per object: nearest first on both sides (no contention here)."""
    return f"""
cand_{kind} AS (
  SELECT o.doc_id, o.page, o.id AS ref_id, c.id AS caption_id, CAST(c.rpos AS INTEGER) AS caption_pos,
         CASE WHEN c.y1 >= o.y2 THEN 0 ELSE 1 END AS rank,
         CASE WHEN c.y1 >= o.y2 THEN c.y1 - o.y2 ELSE greatest(0.0, o.y1 - c.y2) END AS distance, o.rpos AS o_rpos
  FROM synced o JOIN ordered c ON c.doc_id = o.doc_id AND c.page = o.page LEFT JOIN stats s ON s.doc_id = o.doc_id AND s.page = o.page
  WHERE o.kind = '{kind}' AND c.kind = 'caption' AND regexp_matches(lower(c.text), {pattern}) AND {overlap("o.", "c.")} >= 0.30),
near_{kind} AS (
  SELECT d.* FROM cand_{kind} d LEFT JOIN stats s USING (doc_id, page) WHERE distance <= greatest(24.0, {line()} * 1.5)),
link_{kind} AS (
  SELECT doc_id, ref_id, caption_id FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, ref_id ORDER BY rank, distance, caption_pos) AS a FROM near_{kind})
  WHERE a = 1)"""


CHAIN = rf"""WITH RECURSIVE {LAYOUT_SQL},
elements AS (
  SELECT doc_id, pos, 'p' || page || '_' || {_KINDS} || '_' || (slot + 1) AS id, page, {_KINDS} AS kind, x1, y1, x2, y2, {normal("text")} AS text, type AS label, confidence FROM layout),
dims AS (SELECT doc_id, page, greatest(1000.0, max(x2)) AS width, greatest(220.0, max(y2)) AS height FROM elements GROUP BY ALL),
npages AS (SELECT doc_id, count(*) AS pages FROM dims GROUP BY ALL),
zoned AS (
  SELECT e.doc_id, e.id, e.page, e.text, CASE WHEN y1 <= height * 0.10 THEN 'top' WHEN y2 >= height * 0.90 THEN 'bottom' END AS zone,
         nullif(trim(regexp_replace(regexp_replace(lower(e.text), '\d+', '#', 'g'), '\s+', ' ', 'g')), '') AS mark
  FROM elements e JOIN dims USING (doc_id, page) WHERE kind NOT IN ('table', 'figure', 'formula') AND e.text IS NOT NULL),
often AS (SELECT doc_id, zone, mark, count(DISTINCT page) AS n_pages FROM zoned WHERE zone IS NOT NULL GROUP BY ALL),
margins AS (
  SELECT z.doc_id, z.id, z.zone, o.n_pages, CASE WHEN z.zone = 'top' THEN 'header' WHEN regexp_matches(lower(z.text), {_NUM}) THEN 'page_number' ELSE 'footer' END AS role
  FROM zoned z JOIN often o USING (doc_id, zone, mark) JOIN npages USING (doc_id)
  WHERE pages > 1 AND n_pages >= 2 AND n_pages >= ceil(pages * CAST(0.30 AS DOUBLE))),
reasons AS (
  SELECT e.*, CASE WHEN kind IN ('header', 'footer', 'page_number') THEN kind
    WHEN regexp_matches(lower(text), {_NUM}) AND y2 >= height * 0.90 THEN 'page_number'
    WHEN role IS NOT NULL THEN role
    WHEN kind IN ('text', 'heading', 'list_item', 'caption', 'note', 'quote', 'code_block') AND text IS NULL THEN 'empty_text'
    WHEN confidence < 0.5 AND kind NOT IN ('table', 'figure', 'formula') AND (length({signature("coalesce(text, '')")}) <= 3 OR regexp_matches({signature("text")}, '^[^\p{{L}}\p{{N}}]+$')) THEN 'low_confidence_noise' END AS reason
  FROM elements e JOIN dims USING (doc_id, page) LEFT JOIN (SELECT doc_id, id, role FROM margins) m USING (doc_id, id)),
kept AS (SELECT * EXCLUDE (reason) FROM reasons WHERE reason IS NULL),
heights AS (SELECT doc_id, page, kind, y2 - y1 AS h FROM kept WHERE text IS NOT NULL AND kind IN ('text', 'heading', 'list_item', 'caption', 'note', 'quote')),
lineh AS (SELECT doc_id, page, median(h) AS m FROM (SELECT *, min(h) OVER (PARTITION BY doc_id, page) AS lo FROM heights) WHERE h <= lo * 1.5 GROUP BY ALL),
bodyh AS (SELECT doc_id, page, median(h) AS m FROM (SELECT *, min(h) OVER (PARTITION BY doc_id, page) AS lo FROM heights WHERE kind <> 'heading') WHERE h <= lo * 1.5 GROUP BY ALL),
active AS (SELECT doc_id, page, count(*) AS n FROM kept GROUP BY ALL),
stats AS (
  SELECT d.doc_id, d.page, 1000.0::DOUBLE AS width, 220.0::DOUBLE AS height, l.m AS median_line_height,
         CASE WHEN b.m IS NULL THEN l.m WHEN b.m > l.m * 1.25 THEN l.m ELSE b.m END AS body_font_size, coalesce(a.n, 0) AS n_active
  FROM dims d LEFT JOIN lineh l USING (doc_id, page) LEFT JOIN bodyh b USING (doc_id, page) LEFT JOIN active a USING (doc_id, page)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rpos FROM kept),
synced AS (
  SELECT e.doc_id, e.id, e.kind, e.page, e.x1, e.y1, e.x2, e.y2, e.text, o.rpos, o.id IS NOT NULL AS anchored,
         row_number() OVER (PARTITION BY e.doc_id, e.kind ORDER BY e.pos) AS ref_order
  FROM elements e LEFT JOIN ordered o ON o.doc_id = e.doc_id AND o.id = e.id WHERE e.kind IN ('table', 'figure', 'note')),
{links("table", _TABLE)},
{links("figure", _FIGURE)},
captions AS (SELECT *, 'table' AS object FROM link_table UNION ALL SELECT *, 'figure' FROM link_figure),
note_cand AS (
  SELECT t.doc_id, t.id AS ref_id, t.ref_order, n.id AS note_id, n.rpos AS note_pos, n.y1 - coalesce(c.y2, t.y2) AS distance
  FROM synced t JOIN ordered n ON n.doc_id = t.doc_id AND n.page = t.page LEFT JOIN link_table l ON l.doc_id = t.doc_id AND l.ref_id = t.id
  LEFT JOIN ordered c ON c.doc_id = l.doc_id AND c.id = l.caption_id LEFT JOIN stats s ON s.doc_id = t.doc_id AND s.page = t.page
  WHERE t.kind = 'table' AND n.kind = 'note' AND regexp_matches(lower(n.text), {_NOTE}) AND {overlap("t.", "n.")} >= 0.30
    AND n.y1 - coalesce(c.y2, t.y2) BETWEEN 0 AND greatest(32.0, {line()} * 2.5)),
notes AS (
  SELECT doc_id, ref_id, note_id, distance, CAST(row_number() OVER (PARTITION BY doc_id, ref_id ORDER BY distance, note_pos) AS INTEGER) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, note_id ORDER BY ref_order) AS a FROM note_cand) WHERE a = 1),
attached AS (SELECT doc_id, caption_id AS id, ref_id FROM captions UNION ALL SELECT doc_id, note_id, ref_id FROM notes),
roles AS (
  SELECT o.*, s.median_line_height, s.body_font_size, {line()} AS lh,
    CASE WHEN o.kind = 'heading' THEN 'section' WHEN a.id IS NOT NULL THEN 'attached' WHEN o.kind = 'list_item' THEN 'list'
         WHEN o.kind IN ('table', 'figure', 'note') THEN o.kind ELSE 'paragraph' END AS role
  FROM ordered o LEFT JOIN stats s USING (doc_id, page) LEFT JOIN attached a ON a.doc_id = o.doc_id AND a.id = o.id),
lagged AS (
  SELECT *, lag(role) OVER w AS p_role, lag(kind) OVER w AS p_kind, lag(page) OVER w AS p_page, lag(text) OVER w AS p_text,
         lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1, lag(x2) OVER w AS p_x2, lag(y2) OVER w AS p_y2
  FROM roles WINDOW w AS (PARTITION BY doc_id ORDER BY rpos)),
beside AS (
  SELECT *, coalesce(p_page = page AND (abs(p_x1 - x1) <= greatest(18.0, lh) OR {overlap("p_", "")} >= 0.5), false) AS flows FROM lagged),
breaks AS (
  SELECT *,
    CASE WHEN role = 'paragraph' AND NOT coalesce(p_role = 'paragraph' AND flows AND kind <> 'caption' AND y1 - p_y2 <= greatest(lh * 0.80, 0.0)
      AND abs(p_x1 - x1) <= greatest(18.0, lh) AND NOT regexp_matches(coalesce(p_text, ''), '[.!?;:)\]}}"''”’]$')
      AND NOT regexp_matches(text, {_ORD}) AND NOT regexp_matches(text, {_UNORD}), false) THEN 1 ELSE 0 END AS new_p,
    CASE WHEN role = 'list' AND NOT coalesce(p_role = 'list' AND flows AND y1 - p_y2 <= greatest(lh * 1.50, 18.0)
      AND regexp_matches(p_text, {_ORD}) = regexp_matches(text, {_ORD}), false) THEN 1 ELSE 0 END AS new_l
  FROM beside),
groups AS (
  SELECT *, CASE role WHEN 'paragraph' THEN sum(new_p) OVER w WHEN 'list' THEN sum(new_l) OVER w END AS group_no,
    CASE WHEN role = 'section' THEN {level("text", "y2 - y1", "body_font_size")} END AS level,
    CASE WHEN role = 'section' THEN {level_source("text", "y2 - y1", "body_font_size")} END AS level_source,
    'section_' || last_value(CASE WHEN role = 'section' THEN id END IGNORE NULLS) OVER w AS section_id
  FROM breaks WINDOW w AS (PARTITION BY doc_id ORDER BY rpos ROWS UNBOUNDED PRECEDING)),
heads AS (SELECT doc_id, rpos, page, id, text, CAST(level AS INTEGER) AS level, level_source FROM groups WHERE role = 'section'),
above AS (
  SELECT a.doc_id, a.id, max(b.rpos) AS parent_pos FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.rpos < a.rpos AND b.level < a.level GROUP BY ALL),
tree AS (
  SELECT h.doc_id, 'section_' || h.id AS section_id, h.id AS heading_id, CAST(h.rpos AS INTEGER) AS pos, h.level, h.level_source, h.text AS title, 'section_' || p.id AS parent_id, h.page
  FROM heads h LEFT JOIN above u ON u.doc_id = h.doc_id AND u.id = h.id LEFT JOIN heads p ON p.doc_id = u.doc_id AND p.rpos = u.parent_pos),
depths AS (
  SELECT doc_id, section_id, 1 AS depth FROM tree WHERE parent_id IS NULL
  UNION ALL SELECT t.doc_id, t.section_id, d.depth + 1 FROM tree t JOIN depths d ON t.doc_id = d.doc_id AND t.parent_id = d.section_id),
paragraphs AS (
  SELECT doc_id, 'paragraph_' || group_no AS node_id, CAST(min(rpos) AS INTEGER) AS pos, string_agg(text, ' ' ORDER BY rpos) AS text,
         CAST(count(*) AS INTEGER) AS line_count, min_by(section_id, rpos) AS section_id, string_agg(id, ',' ORDER BY rpos) AS block_ids,
         array_to_string(list_sort(list_distinct(list(page))), ',') AS pages
  FROM groups WHERE role = 'paragraph' GROUP BY doc_id, group_no),
items AS (
  SELECT doc_id, 'list_' || group_no AS list_id, rpos, id, CAST(row_number() OVER (w ORDER BY rpos) AS INTEGER) AS nth,
    nullif(trim(coalesce(nullif(regexp_extract(text, {_ORD}), ''), regexp_extract(text, {_UNORD}))), '') AS marker,
    coalesce(nullif(trim(CASE WHEN regexp_matches(text, {_ORD}) THEN regexp_replace(text, {_ORD}, '') ELSE regexp_replace(text, {_UNORD}, '') END), ''), text) AS item_text,
    regexp_matches(text, {_ORD}) AS ordered, bool_and(regexp_matches(text, {_ORD})) OVER w AS list_ordered,
    CAST(greatest(0, round_even((x1 - min(x1) OVER w) / greatest(18.0, first_value(lh) OVER (w ORDER BY rpos)), 0)) AS INTEGER) AS indent_level, section_id
  FROM groups WHERE role = 'list' WINDOW w AS (PARTITION BY doc_id, group_no)),
shallower AS (
  SELECT a.doc_id, a.list_id, a.nth, coalesce(max(b.nth), 0) AS since FROM items a LEFT JOIN items b
    ON a.doc_id = b.doc_id AND a.list_id = b.list_id AND b.nth < a.nth AND b.indent_level < a.indent_level GROUP BY ALL),
numbered AS (
  SELECT a.*, (SELECT CAST(count(*) AS INTEGER) FROM items b WHERE b.doc_id = a.doc_id AND b.list_id = a.list_id AND b.nth > s.since AND b.nth <= a.nth AND b.indent_level = a.indent_level) AS number
  FROM items a JOIN shallower s USING (doc_id, list_id, nth)),
edges AS (SELECT doc_id, id AS src, lead(id) OVER (PARTITION BY doc_id ORDER BY rpos) AS dst FROM ordered),
relations AS (
  SELECT doc_id, src, dst, 'next' AS type FROM edges WHERE dst IS NOT NULL
  UNION ALL SELECT doc_id, heading_id, section_id, 'child_of' FROM tree
  UNION ALL SELECT doc_id, section_id, parent_id, 'child_of' FROM tree WHERE parent_id IS NOT NULL
  UNION ALL SELECT doc_id, id, section_id, 'child_of' FROM groups WHERE role NOT IN ('section', 'attached') AND section_id IS NOT NULL
  UNION ALL SELECT doc_id, caption_id, ref_id, 'caption_of' FROM captions
  UNION ALL SELECT doc_id, note_id, ref_id, 'note_of' FROM notes),
assets AS (
  SELECT doc_id, id AS ref_id, CASE WHEN kind = 'table' AND doc_id % 2 = 0 THEN '| ' || id || ' |' || chr(10) || '|---|' END AS markdown,
         CASE WHEN kind = 'table' AND doc_id % 4 = 1 THEN 'crops\' || id || '.png' WHEN kind = 'figure' AND doc_id % 3 = 0 THEN 'assets/' || id || '.png' END AS path
  FROM synced WHERE kind <> 'note'),
esc AS (
  SELECT doc_id, node_id, pos, CASE WHEN text LIKE '#%' OR text LIKE '>%' OR regexp_matches(text, '^((-\s*){{3,}}|(\*\s*){{3,}}|(_\s*){{3,}})$') THEN '\' || text ELSE text END AS block FROM paragraphs),
objects AS (
  SELECT s.doc_id, s.kind, s.id, s.rpos, s.ref_order,
    CASE WHEN a.markdown IS NOT NULL THEN 'markdown' WHEN a.path IS NOT NULL THEN 'image' ELSE 'placeholder' END AS way,
    CASE WHEN a.markdown IS NOT NULL THEN a.markdown WHEN a.path IS NOT NULL THEN '![' || upper(s.kind[1]) || s.kind[2:] || ' ' || s.id || '](' || replace(a.path, '\', '/') || ')'
         ELSE '[' || upper(s.kind) || ' PLACEHOLDER: ' || s.id || ']' END AS main,
    (SELECT '*' || c.text || '*' FROM captions l JOIN ordered c ON c.doc_id = l.doc_id AND c.id = l.caption_id WHERE l.doc_id = s.doc_id AND l.ref_id = s.id) AS caption,
    (SELECT string_agg(n.text, chr(10) || chr(10) ORDER BY l.nth) FROM notes l JOIN ordered n ON n.doc_id = l.doc_id AND n.id = l.note_id WHERE l.doc_id = s.doc_id AND l.ref_id = s.id) AS note_text
  FROM synced s JOIN assets a ON a.doc_id = s.doc_id AND a.ref_id = s.id WHERE s.kind <> 'note'),
blocks AS (
  SELECT doc_id, 'section' AS node_type, section_id AS node_id, 0 AS tail, pos::BIGINT AS pos, repeat('#', least(4, greatest(1, level))) || ' ' || title AS block, NULL AS way FROM tree
  UNION ALL SELECT doc_id, 'paragraph_group', node_id, 0, pos, block, NULL FROM esc
  UNION ALL SELECT doc_id, 'list_group', list_id, 0, min(rpos), trim(string_agg(repeat('  ', indent_level) || CASE WHEN list_ordered THEN number || '.' ELSE '-' END || ' ' || item_text, chr(10) ORDER BY nth)), NULL FROM numbered GROUP BY doc_id, list_id
  UNION ALL SELECT doc_id, kind || '_ref', id, CASE WHEN rpos IS NOT NULL THEN 0 WHEN kind = 'table' THEN 1 ELSE 2 END, coalesce(rpos, ref_order), concat_ws(chr(10) || chr(10), main, caption, note_text), way FROM objects
  UNION ALL SELECT s.doc_id, 'note_ref', s.id, CASE WHEN rpos IS NULL THEN 3 ELSE 0 END, coalesce(rpos, ref_order), coalesce('> ' || text, ''), NULL
    FROM synced s WHERE kind = 'note' AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.doc_id = s.doc_id AND n.note_id = s.id)),
markdowns AS (
  SELECT doc_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY tail, pos, node_type, block) FILTER (WHERE block <> ''), '') AS markdown,
         count(*) FILTER (WHERE block <> '') AS n_blocks, count(*) FILTER (WHERE way = 'placeholder') AS n_placeholders,
         count(*) FILTER (WHERE way = 'image' AND node_type = 'table_ref') AS n_fallbacks
  FROM blocks GROUP BY doc_id),
detections AS (
  SELECT doc_id, page, slot AS pos, type, x1, y1, x2, y2, confidence FROM layout
  UNION ALL SELECT doc_id, page, slot + 100, CASE WHEN pos % 2 = 0 THEN 'Text' ELSE type END, x1 + 4, y1 + 2, x2 + 4, y2 + 2, confidence FROM layout WHERE (doc_id + pos) % 3 = 0
  UNION ALL SELECT DISTINCT doc_id, page, 200, 'Picture', 0.0, 0.0, 1000.0, 220.0, 0.9 FROM layout WHERE doc_id % 4 = 0)
"""


def select(body: str) -> str:
    return CHAIN + body
