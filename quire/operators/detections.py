"""Operators over detected boxes of pages: order, overlap filters, suppression.

Pages are equi-keys of every self-join, so overlap conditions are residuals of a
hash or sort-merge join and never a nested loop over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

# Which type wins where two boxes are one thing.
PRIORITY = {"Table": 3, "Picture": 2, "Figure": 2, "Formula": 2, "Text": 2, "Section-header": 1, "List-item": 1, "Caption": 1, "Page-header": 1, "Page-footer": 1}
INSIDE, SAME, CROWD = 0.80, 0.70, 4
PAGE = ("doc_id", "page")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds ``side`` (full, left, right of the page's middle) and ``rank``, from 1.

    Boxes across the middle cut the page into bands; a band is read left column
    first. The band is a running count of crossing boxes, so one sort per page
    serves it all.
    """
    page = Window.partitionBy(*PAGE)
    mid = (F.min(F.least("x1", "x2")).over(page) + F.max(F.greatest("x1", "x2")).over(page)) / 2
    side = F.when((F.col("x1") < F.col("_mid")) & (F.col("x2") > F.col("_mid")), "full").when(F.col("x2") <= F.col("_mid"), "left").otherwise("right")
    down = page.orderBy("y1", "pos").rowsBetween(Window.unboundedPreceding, 0)
    out = boxes.withColumn("_mid", mid).withColumn("side", side).withColumn("_band", F.sum((F.col("side") == "full").cast("int")).over(down))
    place = F.when(F.col("side") == "full", 0).when(F.col("side") == "left", 1).otherwise(2)
    return out.withColumn("rank", F.row_number().over(page.orderBy("_band", place, "y1", "pos"))).drop("_mid", "_band")


def missed_texts(blocks: DataFrame, boxes: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Text blocks that overlap no box of their page (boxes scaled to blocks)."""
    b = boxes.select(*PAGE, (F.col("x1") * scale_x).alias("bx1"), (F.col("y1") * scale_y).alias("by1"), (F.col("x2") * scale_x).alias("bx2"), (F.col("y2") * scale_y).alias("by2")).alias("b")
    t = blocks.filter(F.trim("text") != "").alias("t")
    met = (F.col("t.doc_id") == F.col("b.doc_id")) & (F.col("t.page") == F.col("b.page"))
    other = tuple(F.col(f"b.b{c}") for c in ("x1", "y1", "x2", "y2"))
    return t.join(b, met & G.overlaps(G.box("t"), other), "left_anti")


def fake_pictures(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, pos, n_inside): pictures that hold four or more boxes."""
    a, b = boxes.filter(F.col("type").isin("Picture", "Figure")).alias("a"), boxes.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") != F.col("b.pos"))
    inside = F.try_divide(G.intersection(G.box("a"), G.box("b")), G.area(G.box("b"))) > INSIDE
    return a.join(b, same & inside).groupBy("a.doc_id", "a.page", "a.pos").agg(F.count("*").alias("n_inside")).filter(F.col("n_inside") >= CROWD)


def without_fakes(boxes: DataFrame) -> DataFrame:
    return boxes.join(fake_pictures(boxes).drop("n_inside"), [*PAGE, "pos"], "left_anti")


def _priority(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), F.lit(0))


def rival_pairs(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, a, b, loser): boxes of one page that cover each other's
    smaller area by over 70 %, and which of the two would go."""
    a, b = boxes.alias("a"), boxes.alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.pos") < F.col("b.pos"))
    common, least = G.intersection(G.box("a"), G.box("b")), F.least(G.area(G.box("a")), G.area(G.box("b")))
    pa, pb = _priority(F.col("a.type")), _priority(F.col("b.type"))
    wins = (pa > pb) | ((pa == pb) & (F.col("a.confidence") >= F.col("b.confidence")))
    out = a.join(b, same & (common > 0) & (F.try_divide(common, least) > SAME))
    return out.select("a.doc_id", "a.page", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), F.when(wins, F.col("b.pos")).otherwise(F.col("a.pos")).alias("loser"))


def survivors(boxes: DataFrame) -> DataFrame:
    """Boxes left by greedy suppression within each page.

    A box meets the later ones in order; the loser of each meeting goes, and a
    box that loses meets no more. That depends on the order, so it is a fold over
    the page's rivalries, sorted by place: pages are small, and the fold stays in
    the JVM.
    """
    pairs = rival_pairs(boxes).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("a", "b", "loser"))).alias("rivals"))
    gone = F.aggregate(
        "rivals",
        F.array().cast("array<int>"),
        lambda out, r: F.when(F.array_contains(out, r["a"]) | F.array_contains(out, r["b"]), out).otherwise(F.concat(out, F.array(r["loser"].cast("int")))),
    )
    lost = pairs.select(*PAGE, F.explode(gone).alias("pos"))
    return boxes.join(lost, [*PAGE, "pos"], "left_anti")
