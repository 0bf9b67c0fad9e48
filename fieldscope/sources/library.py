"""The reader's library: DOIs from BibTeX or reference-manager exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldscope.functions.identity import BIB_DOI, clean_doi, doi_of_record
from fieldscope.schemas import LIBRARY_RECORD


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) per file; a field may span lines, so files are not split."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("seq"), "value")


def read_bib_entries(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) per entry, for exports of any size: a file is split by bytes, and a row ends where a line starts with
    the next entry's ``@``, wherever the split lies.  ``seq`` follows files and places in them."""
    rows = spark.read.option("lineSep", "\n@").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return rows.select(place.alias("seq"), "value")


def read_library_json(spark: SparkSession, path: str) -> DataFrame:
    """(seq, at, data) per record of landed JSON pages."""
    pages = spark.read.schema(LIBRARY_RECORD).option("multiLine", True).json(path)
    return pages.select(F.col("_metadata.file_path").alias("seq"),
                        F.monotonically_increasing_id().alias("at"), "data")


def _first_seen(found: DataFrame) -> DataFrame:
    return found.filter(F.col("doi") != "").groupBy("doi").agg(F.min("seq").alias("seq"))


def dois_from_bib(texts: DataFrame) -> DataFrame:
    """Unique cleaned DOIs of (seq, value) texts, with the place of the first
    mention as struct<seq, at>."""
    braced, quoted = (F.regexp_extract_all("value", F.lit(BIB_DOI), i) for i in (1, 2))
    values = F.zip_with(braced, quoted, lambda a, b: F.when(a != "", a).otherwise(b))
    found = texts.select("seq", F.posexplode(values).alias("at", "raw"))
    # Braces within a value only protect it from changes of case.
    bare = F.regexp_replace("raw", "[{}]", "")
    return _first_seen(found.select(_place(), clean_doi(bare).alias("doi")))


def _place():
    return F.struct("seq", F.col("at").cast("long").alias("at")).alias("seq")


def dois_from_records(records: DataFrame) -> DataFrame:
    """Unique cleaned DOIs of (seq, at, data) export records; attachments are
    no records."""
    kept = records.filter(~F.col("data.itemType").eqNullSafe("attachment"))
    return _first_seen(kept.select(_place(), doi_of_record(F.col("data.DOI"), F.col("data.extra")).alias("doi")))


def library_dois(*parts: DataFrame) -> DataFrame:
    """Union of (doi, seq) lists, each DOI once, earlier lists first."""
    tagged = [p.select("doi", F.struct(F.lit(at).alias("part"), "seq.seq", "seq.at").alias("seq"))
              for at, p in enumerate(parts)]
    merged = tagged[0]
    for part in tagged[1:]:
        merged = merged.unionByName(part)
    return _first_seen(merged)
