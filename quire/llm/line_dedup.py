"""Line dedup: drop lines that many documents share.

Lines are exploded with their positions, normalised and hashed (two 64-bit
hashes, so that 10^12 lines still have no collision); distinct documents are
counted per hash; a line over the threshold stays only in the largest doc_id
that holds it; each document is put together again by position. Text moves once,
to meet the positions that its document loses; everything else moves as hashes.

The lines of a very common key meet its count in a plain join of two stored
tables, whose large partitions Spark splits between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, cut, discard


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _rk, _pos, _h1, _h2): lines of (_id, _text) that are long enough;
    _rk, the hash of the whole text, tells rows of one id apart."""
    lines = F.transform(F.split(F.col("_text"), "\n", -1), line_key)
    each = docs.select("_id", F.xxhash64("_text").alias("_rk"), F.posexplode(lines).alias("_pos", "_key"))
    h1, h2 = _hashes(F.col("_key"))
    return each.filter(F.char_length("_key") >= min_chars).select("_id", "_rk", "_pos", h1.alias("_h1"), h2.alias("_h2"))


def lost_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_id, _rk, _lost): positions that each text loses, in no order."""
    lines = cut(hashed_lines(docs, min_chars), "lines")
    held = lines.select("_id", "_h1", "_h2").distinct()
    common = held.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_keep")).filter(F.col("_n") >= min_docs)
    common = cut(common.select("_h1", "_h2", "_keep"), "common-lines")
    lost = lines.join(common, ["_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    lost = cut(lost.groupBy("_id", "_rk").agg(F.collect_set("_pos").alias("_lost")), "lost-lines")
    discard(lines, common)
    return lost


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of ``docs``, with the text rewritten, and n_lines, n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines except in the largest id.
    Null or empty texts are one empty line (the text becomes ""). Rows that
    repeat an id are one document, whatever their texts: it counts once for a
    line and all its rows keep or lose it. Rows without an id are one document
    too, smaller than any other. A text of any length is one array of lines, and
    the time for it is linear in them. Other columns of ``docs`` pass through
    whatever their names, except n_lines and n_dropped, which are replaced. An
    empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.col("_row")
    whole = F.coalesce(own[text_col], F.lit(""))
    lost = lost_lines(rows.select(own[id_col].alias("_id"), whole.alias("_text")), min_chars, min_docs)
    both = rows.join(lost, own[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_rk")), "left")
    both = both.select("_row", whole.alias("_text"), F.split(whole, "\n", -1).alias("_lines"), "_lost")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    text = F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(places, lambda p: F.get("_lines", p)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n = F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost"))
    return both.select(*[(text if c == text_col else own[c]).alias(c) for c in names], F.size("_lines").cast("long").alias("n_lines"), n.cast("long").alias("n_dropped"))
