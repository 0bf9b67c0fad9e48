"""Reference documents: plain-text notes of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldscope.functions.columns import file_name

# File types read, and the folder's own documentation.
EXTENSIONS = (".md", ".txt", ".markdown", ".rst")
SKIPPED = ("readme.md", "readme.txt", "readme.rst", "readme.markdown")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the text notes, without hidden files and READMEs.  File
    names are checked by the scan, so other files are never opened."""
    stored = F.col("_metadata.file_name")
    low = F.lower(stored)
    wanted = low.endswith(EXTENSIONS[0])
    for extension in EXTENSIONS[1:]:
        wanted = wanted | low.endswith(extension)
    kept = spark.read.text(path, wholetext=True).filter(
        wanted & ~low.isin(*SKIPPED) & ~stored.startswith("."))
    return kept.select(file_name().alias("name"), F.col("value").alias("body"))
