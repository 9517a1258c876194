"""Scalar rules on hand-made values."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [(None, None), ("  a \n b c ", "a b c"), (" \t", None)])
def test_normal(spark, value, want):
    assert one(spark, value, T.normal) == want


@pytest.mark.parametrize("value,want", [("Section-Header", "heading"), ("list item", "list_item"), ("PICTURE", "figure"), (None, "text"), ("poem", "text")])
def test_kinds(spark, value, want):
    assert one(spark, value, T.kind_of) == want


@pytest.mark.parametrize("value,marker,rest", [("1. one", "1.", "one"), ("(가) two", "(가)", "two"), ("- three", "-", "three"), ("plain", None, "plain"), (None, None, None), ("2024 report", None, "2024 report")])
def test_list_markers(spark, value, marker, rest):
    assert one(spark, value, T.list_marker) == marker
    assert one(spark, value, T.list_text) == rest


@pytest.mark.parametrize("value,height,body,want", [("1.2.3 x", 10.0, 10.0, 3), ("(a) x", 10.0, 10.0, 2), ("A. x", 10.0, 10.0, 2), ("Big", 18.0, 10.0, 1), ("Mid", 12.0, 10.0, 2), ("Low", 10.0, 10.0, 3), ("Low", 14.5, None, 2), ("2024 report", 9.0, 9.0, 1)])
def test_heading_levels(spark, value, height, body, want):
    row = spark.createDataFrame([(value, height, body)], "t string, h double, b double")
    assert row.select(T.heading_level(F.col("t"), F.col("h"), F.col("b")).alias("r")).first()["r"] == want


def test_heading_hint_is_clamped(spark):
    row = spark.createDataFrame([("1.1 x", 9)], "t string, hint int")
    none = F.lit(None).cast("double")
    assert row.select(T.heading_level(F.col("t"), none, none, F.col("hint")).alias("r")).first()["r"] == 6


@pytest.mark.parametrize("value,want", [("page 3", True), ("Page 3 / 9", True), ("3 / 9", True), ("페이지 2", True), ("3", False), ("page", False), (None, False)])
def test_page_numbers(spark, value, want):
    assert one(spark, value, T.is_page_number) is want


@pytest.mark.parametrize("value,want", [("가나다라 abc", "korean"), ("plain words", "english"), ("12 34 5x", "mixed"), ("  ", "unknown")])
def test_languages(spark, value, want):
    assert one(spark, value, T.language) == want


def test_hyphenation_of_shared_letters(spark):
    assert one(spark, "infor- mation a- b- c", T.without_hyphenation) == "information abc"


@pytest.mark.parametrize("value,want", [("# x", "\\# x"), ("> x", "\\> x"), ("- - -", "\\- - -"), ("***", "\\***"), ("\\# x", "\\# x"), ("a\n b\r\nc", "a b c"), (None, "")])
def test_block_text(spark, value, want):
    assert one(spark, value, T.block_text) == want


@pytest.mark.parametrize("value,want", [("| a | b |\n|---|---|", True), ("| a |\ntext", False), ("a", False), (None, False)])
def test_markdown_tables(spark, value, want):
    assert one(spark, value, T.is_markdown_table) is want


def test_boxes(spark):
    row = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 15.0, 10.0)], "ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    a, b = G.box(prefix="a"), G.box(prefix="b")
    r = row.select(G.iou(a, b).alias("iou"), G.horizontal_overlap(a, b).alias("h"), G.intersection(a, b).alias("i"), G.overlaps(a, b).alias("o")).first()
    assert (round(r["iou"], 4), r["h"], r["i"], r["o"]) == (0.3333, 0.5, 50.0, True)
    touch = row.withColumn("bx1", F.lit(10.0))
    assert touch.select(G.iou(a, b).alias("iou")).first()["iou"] == 0.0
    assert touch.withColumn("bx1", F.lit(None).cast("double")).select(G.iou(a, b).alias("iou")).first()["iou"] is None
