"""Files as rows: pages to be recognised, and JSON that extractors left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that are taken.
TYPES = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image"}


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; "" where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"(?<=.)\.[^.]+$", "")


def typed(files: DataFrame) -> DataFrame:
    """``files`` with path, with file_name, file_type and reject: why a file is
    not taken (null if it is)."""
    kind = F.lit(None).cast("string")
    for end, name in TYPES.items():
        kind = F.when(suffix(F.col("path")) == end, name).otherwise(kind)
    rows = files.withColumn("file_name", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("file_type", kind)
    return rows.withColumn("reject", F.when(F.col("file_type").isNull(), F.concat(F.lit("unsupported type "), suffix(F.col("path")))))


def scan(spark: SparkSession, folder: str, content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(taken, rejected) files under a folder, with content unless not wanted,
    which a scan then does not read. An empty or missing folder is an error of
    the reader."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = typed(rows if content else rows.drop("content"))
    return rows.filter("reject is null").drop("reject"), rows.filter("reject is not null").select("path", "reject")


def pages(taken: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(file_name, file_type, path, total_pages, page): a row for each page.
    Images have one; ``counts`` (path, total_pages) says how many PDFs have, as
    their reader does, which is outside."""
    rows = taken if counts is None else taken.join(counts, "path", "left")
    total = F.when(F.col("file_type") == "image", 1).otherwise(F.col("total_pages") if counts is not None else F.lit(None).cast("int"))
    rows = rows.select("file_name", "file_type", "path", total.alias("total_pages"))
    return rows.withColumn("page", F.explode(F.sequence(F.lit(1), F.coalesce("total_pages", F.lit(1)))))


def payload_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, payload): JSON files under a folder, named by their stem."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return rows.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("payload"))
