"""Results as files in shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.render import file_name, said

# Stages in the order of their files.
STAGES = ("layout", "adapted", "normalized", "structured", "validated", "rendered")


def output_dir(root: Column, path: Column, mode: Column) -> Column:
    """Where the results of a file go: a folder for its stem, and below it one
    for the mode of enrichment, if any."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]+$", "")
    inner = F.when(F.coalesce(mode, F.lit("baseline")) == "baseline", "").otherwise(F.concat(F.lit("/llm_enrichment/"), mode))
    return F.concat(root, F.lit("/data/output/"), stem, inner)


def write_markdown(rendered: DataFrame, folder: str, name: str = "doc_id") -> None:
    """One text file for each document, in a folder of its own: rows (name,
    markdown). Rows of a document are one row, so no file is written by halves."""
    rows = rendered.select(F.col(name).cast("string").alias("doc"), F.coalesce("markdown", F.lit("")).alias("value"))
    rows.write.partitionBy("doc").option("lineSep", "\n").mode("overwrite").text(f"{folder}/markdown")


def write_report(stats: DataFrame, folder: str) -> None:
    """One line of JSON for each document."""
    without_raw(stats).write.mode("overwrite").json(f"{folder}/render_report")


def without_raw(rows: DataFrame) -> DataFrame:
    """Raw fields stay out of what is saved."""
    return rows.drop("raw")


def write_stage(rows: DataFrame, folder: str, stage: str) -> str:
    """A stage as a numbered Parquet table, which later runs can read; its path."""
    path = f"{folder}/{STAGES.index(stage) + 1:02d}_{stage}"
    without_raw(rows).write.mode("overwrite").parquet(path)
    return path


def service_images(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, filename, data): images beside the Markdown in base64, one for
    each file name of a document, that of the first object; images without a
    file are left out. ``files`` has (path, content)."""
    rows = assets.filter(said(F.col("path"))).withColumn("path", F.replace(F.trim("path"), F.lit("\\"), F.lit("/")))
    first = rows.withColumn("filename", file_name(F.col("path"))).groupBy("doc_id", "filename").agg(F.min_by("path", "ref_id").alias("path"))
    return first.join(files.select("path", "content"), "path").select("doc_id", "filename", F.base64("content").alias("data"))


def by_file_name(markdown: Column) -> Column:
    """Markdown whose images are named by their file name alone."""
    return F.regexp_replace(F.coalesce(markdown, F.lit("")), r"!\[([^\]]*)\]\((?:[^)]*[/\\])?([^)/\\]+)\)", "![$1]($2)")
