"""Column functions over text: normal forms, markers, levels, languages.

All are built-in expressions, so they stay in generated code and Catalyst can
push, prune and fold them. Patterns use (?U): white space, digits and word
characters are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label to kind of block.
KINDS = {
    "text": "text", "paragraph": "text", "body": "text",
    "heading": "heading", "title": "heading", "section_header": "heading",
    "list_item": "list_item", "list": "list_item", "bullet": "list_item",
    "table": "table", "figure": "figure", "picture": "figure", "image": "figure",
    "caption": "caption", "note": "note", "footnote": "note",
    "formula": "formula", "equation": "formula",
    "quote": "quote", "blockquote": "quote", "code": "code_block", "code_block": "code_block",
    "header": "header", "page_header": "header", "footer": "footer", "page_footer": "footer",
    "page_number": "page_number", "noise": "noise", "artifact": "noise",
}

# Patterns of markers, captions, notes and page numbers.
ORDERED_ITEM = r"(?U)^\s*(?:\d+[.)]|[A-Za-z][.)]|[가-힣][.)]|\(\d+\)|\([A-Za-z]\)|\([가-힣]\))\s+"
UNORDERED_ITEM = r"(?U)^\s*(?:[-*•◦▪‣·])\s+"
NUMERIC_HEADING = r"(?U)^\s*(\d+(?:\.\d+)*)[.)]?\s+"
PAREN_HEADING = r"(?U)^\s*\((\d+|[A-Za-z]|[가-힣])\)\s+"
LETTER_HEADING = r"(?U)^\s*([가-힣]|[A-Za-z])[.)]\s+"
TABLE_CAPTION = r"(?iU)^\s*(?:table|tbl\.?|표)\s*\d*"
FIGURE_CAPTION = r"(?iU)^\s*(?:figure|fig\.?|그림)\s*\d*"
NOTE = r"(?iU)^\s*(?:note\b|note:|주\)|주:|※|단위:|source:)"
PAGE_NUMBER = r"(?iU)^(?:(?:페이지|page)\s*\d+(?:\s*/\s*\d+)?|\d+\s*/\s*\d+)$"
LINK = r"(?iU)(?:https?://|www\.|[\w.-]+@[\w.-]+)"
TABLE_LINE = r"(?mU)^\s*\|.*\|\s*$"
HINT_CAPTION = r"(?iU)^\s*(?:table|tbl\.?|figure|fig\.?|표|그림)\s*\d+"
HINT_NOTE = r"(?iU)^\s*(?:note\b|note:|source:|비고|주의|주\s*:)"
HINT_HEADING = r"(?U)^\s*\d+(?:\.\d+)*[.)]?\s+\S+"
NOT_SAID = ("VARCO VISION", "VARCOVISION", "xxx", "I", ".", "-", "_")


def squeezed(c: Column) -> Column:
    """White space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normal(c: Column) -> Column:
    """Squeezed; blank is null."""
    return F.nullif(squeezed(c), F.lit(""))


def cleaned(c: Column) -> Column:
    """Squeezed; null is empty."""
    return F.coalesce(squeezed(c), F.lit(""))


def signature(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def stripped(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def kind_of(label: Column) -> Column:
    """The kind that a label names; text for unknown or missing labels."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    key = F.translate(F.lower(F.trim(label)), "- ", "__")
    return F.coalesce(F.try_element_at(known, key), F.lit("text"))


def looks_like_caption(c: Column, of: str) -> Column:
    return F.coalesce(normal(c).rlike(TABLE_CAPTION if of == "table" else FIGURE_CAPTION), F.lit(False))


def looks_like_note(c: Column) -> Column:
    return F.coalesce(normal(c).rlike(NOTE), F.lit(False))


def is_ordered_item(c: Column) -> Column:
    return F.coalesce(normal(c).rlike(ORDERED_ITEM), F.lit(False))


def is_list_like(c: Column) -> Column:
    return F.coalesce(c.rlike(ORDERED_ITEM) | c.rlike(UNORDERED_ITEM), F.lit(False))


def list_marker(c: Column) -> Column:
    """The marker of a list item, null without one."""
    t = normal(c)
    first = F.coalesce(F.nullif(F.regexp_extract(t, f"({ORDERED_ITEM})", 1), F.lit("")), F.nullif(F.regexp_extract(t, f"({UNORDERED_ITEM})", 1), F.lit("")))
    return F.trim(first)


def list_text(c: Column) -> Column:
    """A list item without its marker; all of it if nothing else is left."""
    t = normal(c)
    rest = F.when(t.rlike(ORDERED_ITEM), F.regexp_replace(t, ORDERED_ITEM, "")).otherwise(F.regexp_replace(t, UNORDERED_ITEM, ""))
    return F.coalesce(F.nullif(F.trim(rest), F.lit("")), t)


def heading_level(text: Column, height: Column, body: Column, hint: Column | None = None) -> Column:
    """A hint (1 to 6), else the depth of numbering, else 2 for lettered
    headings, else by height over the body's font size (12 if unknown)."""
    t = F.coalesce(normal(text), F.lit(""))
    number = F.regexp_extract(t, NUMERIC_HEADING, 1)
    depth = F.length(F.regexp_replace(number, "[^.]", "")) + 1
    base = F.coalesce(F.when(body > 0, body), F.lit(12.0))
    level = F.when(number != "", depth).when(t.rlike(PAREN_HEADING) | t.rlike(LETTER_HEADING), 2).when(height >= base * 1.8, 1).when(height >= base * 1.2, 2).otherwise(3)
    return level if hint is None else F.coalesce(F.greatest(F.lit(1), F.least(F.lit(6), hint)), level)


def heading_level_source(text: Column, height: Column, body: Column, hint: Column | None = None) -> Column:
    t = F.coalesce(normal(text), F.lit(""))
    found = F.when(t.rlike(NUMERIC_HEADING), "numeric_pattern").when(t.rlike(PAREN_HEADING), "paren_pattern").when(t.rlike(LETTER_HEADING), "korean_pattern").when(height.isNotNull() & body.isNotNull(), "height_ratio").otherwise("default")
    return found if hint is None else F.when(hint.isNotNull(), "llm_hint").otherwise(found)


def is_page_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(PAGE_NUMBER), F.lit(False))


def fingerprint(c: Column) -> Column:
    """What repeated margins share: lower case, digits as one sign."""
    return F.nullif(squeezed(F.regexp_replace(F.lower(normal(c)), r"(?U)\d+", "#")), F.lit(""))


def scrubbed(c: Column) -> Column:
    """Recognised text without box and end marks, common signs as characters."""
    t = F.regexp_replace(c, r"(?s)<bbox>.*?</bbox>", "")
    for mark in ("<char>", "</char>", "<|im_end|>", "</s>"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    for name, sign in ((r"\times", "×"), (r"\div", "÷"), (r"\pm", "±"), (r"\cdot", "·")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def believed(c: Column) -> Column:
    """Answers that recognisers give for nothing become empty."""
    return F.when(c.isin(*NOT_SAID), "").otherwise(c)


def is_markdown_table(c: Column) -> Column:
    """Two lines or more that are not blank, the second of bars and dashes."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    first, second = F.trim(F.get(lines, F.lit(0))), F.trim(F.get(lines, F.lit(1)))
    return F.coalesce((F.size(lines) >= 2) & first.contains("|") & second.contains("|") & second.rlike(r"^[|:\- ]*$") & second.contains("-"), F.lit(False))


def is_short_title(c: Column) -> Column:
    """At most 90 characters and 12 words, no end of sentence, link or code."""
    t = squeezed(c)
    return (t != "") & (F.length(t) <= 90) & ~t.rlike("[.!?;:。！？]$") & (F.size(F.split(t, " ")) <= 12) & ~t.rlike(LINK) & ~t.contains("`")


def hint_reason(kind: Column, label: Column, text: Column, ratio: Column) -> Column:
    """Why a block may need another look, null if it does not; first match wins."""
    low = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(kind.isin("heading", "caption", "note"), "existing_kind")
        .when(low.contains("caption"), "label_caption")
        .when(low.contains("title") | low.contains("header") | low.contains("heading"), "label_heading")
        .when(text.rlike(HINT_CAPTION), "caption_pattern")
        .when(text.rlike(HINT_NOTE), "note_pattern")
        .when(text.rlike(HINT_HEADING), "numeric_heading_pattern")
        .when((ratio >= 1.15) & is_short_title(text), "height_title_like")
        .when(is_short_title(text), "short_title_like")
    )


def hint_kind(reason: Column, kind: Column) -> Column:
    return F.when(reason == "existing_kind", kind).when(reason.isin("label_caption", "caption_pattern"), "caption").when(reason == "note_pattern", "note").when(reason.isNotNull(), "heading")


def language(c: Column) -> Column:
    """korean from a quarter of Hangul, english from 60 % of Latin, else mixed."""
    s = signature(c)
    n = F.length(s)
    count = lambda p: F.regexp_count(s, F.lit(p))
    return F.when(n == 0, "unknown").when(4 * count("[가-힣]") >= n, "korean").when(10 * count("[A-Za-z]") >= 6 * n, "english").otherwise("mixed")


def without_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<=[A-Za-z])-\s+(?=[a-z])", "")


def skips_repair(c: Column) -> Column:
    """Links, code and table lines are not repaired."""
    return c.rlike(LINK) | c.contains("`") | c.rlike(TABLE_LINE)


def one_line(c: Column) -> Column:
    """Lines stripped and joined by blanks; null is empty."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def escaped(c: Column) -> Column:
    """Text that Markdown would read as a heading, quote or rule gets a backslash."""
    rule = c.rlike(r"(?U)^(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
    return F.when(c.startswith("#") | c.startswith(">") | rule, F.concat(F.lit("\\"), c)).otherwise(c)


def block_text(c: Column) -> Column:
    return escaped(one_line(c))
