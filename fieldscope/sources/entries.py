"""Feed entries: preprints, news searches, organisation feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fieldscope.functions.columns import ago, file_name, let, string_list, strip
from fieldscope.functions.text import flatten_cut, strip_html
from fieldscope.schemas import ENTRY
from fieldscope.settings import (
    DEFAULT_PREPRINT_CATEGORY, FEED_LABEL, NEWS_LABEL, PREPRINT_SOURCE, PREPRINT_VENUE, WINDOW_DAYS)

CORRUPT = "_corrupt_record"


def entry_time(c: Column) -> Column:
    """Timestamp of an entry; NULL when absent or unreadable."""
    return c.try_cast("timestamp")


def in_window(at: Column, as_of, window_days: int) -> Column:
    """Only a readable date before the window drops a row."""
    return at.isNull() | (at >= ago(as_of, days=window_days))


def preprint_match(categories: Column, text: Column, watched, terms) -> Column:
    """Watched category or listed phrase; with neither list, one default category."""
    watched, terms = list(watched or ()), [t.lower() for t in terms or ()]
    if not watched and not terms:
        watched = [DEFAULT_PREPRINT_CATEGORY]
    match = F.arrays_overlap(categories, string_list(watched))
    if terms:
        match = match | let(F.lower(text), lambda x: F.exists(
            string_list(terms), lambda t: F.contains(x, t)))
    return F.coalesce(match, F.lit(False))


def scan_preprints(entries: DataFrame, watched, terms, as_of, window_days: int = WINDOW_DAYS,
                   max_results: int | None = None, tiebreak: str = "link") -> DataFrame:
    """The matching entries of the window; ``max_results`` takes the newest ones only."""
    at = entry_time(F.col("published"))
    text = F.concat_ws(" ", "title", "summary")
    found = entries.filter(preprint_match(F.col("categories"), text, watched, terms) & in_window(at, as_of, window_days))
    if max_results is not None:
        found = found.orderBy(at.desc_nulls_last(), F.col(tiebreak).asc()).limit(max_results)
    return found.select(
        F.lit(PREPRINT_SOURCE).alias("source"), F.lit("paper").alias("source_type"), F.lit(PREPRINT_VENUE).alias("venue"),
        F.lit(1).alias("is_preprint"), strip(F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" "))).alias("title"),
        F.coalesce("link", F.lit("")).alias("url"), F.when(F.col("doi") != "", F.col("doi")).alias("doi"),
        F.to_date(at).alias("published_at"), flatten_cut(F.col("summary")).alias("summary"))


def scan_news(entries: DataFrame, as_of, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Entries of per-query news searches; ``query`` names the search."""
    at = entry_time(F.col("published"))
    return entries.filter(in_window(at, as_of, window_days)).select(
        F.concat(F.lit(NEWS_LABEL), F.col("query")).alias("source"), F.lit("news").alias("source_type"),
        strip(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("link", F.lit("")).alias("url"),
        F.lit(None).cast("string").alias("doi"), F.to_date(at).alias("published_at"),
        strip_html(F.col("summary")).alias("summary"))


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed lines as (feed, raw): one JSON entry per line, one file per feed."""
    name = F.regexp_extract(file_name(), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(path).select(name.alias("feed"), F.col("value").alias("raw"))


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """Add the parsed ``entry`` to (feed, raw, ...).  A line that is no valid
    entry keeps its text in ``entry._corrupt_record``."""
    schema = T.StructType([*ENTRY.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.withColumn("entry", F.from_json("raw", schema, options))


def scan_feeds(parsed: DataFrame, as_of, window_days: int = WINDOW_DAYS, source_types: dict | None = None,
               extra=()) -> DataFrame:
    """Good entries as items.  The date is the published one, else the updated
    one; the summary falls back to the description."""
    entry = F.col("entry")
    at = F.coalesce(entry_time(entry["published"]), entry_time(entry["updated"]))
    text = F.coalesce(F.when(entry["summary"] != "", entry["summary"]), entry["description"])
    good = parsed.filter(entry[CORRUPT].isNull() & in_window(at, as_of, window_days))
    return good.select(
        F.col("feed").alias("source"), _source_type(source_types).alias("source_type"),
        strip(F.coalesce(entry["title"], F.lit(""))).alias("title"),
        F.coalesce(entry["link"], F.lit("")).alias("url"), F.lit(None).cast("string").alias("doi"),
        F.to_date(at).alias("published_at"), strip_html(text).alias("summary"), *extra)


def _source_type(source_types: dict | None) -> Column:
    if not source_types:
        return F.lit("org")
    pairs = [F.lit(x) for item in source_types.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.col("feed")], F.lit("org"))


def feed_records(parsed: DataFrame, as_of, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Run record per feed: items kept, lines that failed, and whether it is ok."""
    entry = F.col("entry")
    at = F.coalesce(entry_time(entry["published"]), entry_time(entry["updated"]))
    bad = entry[CORRUPT].isNotNull()
    return parsed.groupBy("feed").agg(
        F.count_if(~bad & in_window(at, as_of, window_days)).alias("fetched"),
        F.count_if(bad).alias("failed")).select(
        F.concat(F.lit(FEED_LABEL), F.col("feed")).alias("source"), "fetched", "failed",
        (F.col("failed") == 0).cast("int").alias("ok"))
