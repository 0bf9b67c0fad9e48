"""Scholarly works: landed JSON to items, and the three watch selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldscope.functions.columns import ago, let, string_list
from fieldscope.functions.identity import drop_doi_prefix
from fieldscope.functions.text import last_segment, place_tokens, strip_html
from fieldscope.operators.groups import first_per_group
from fieldscope.schemas import WORK
from fieldscope.settings import ISSN_LABEL, QUERY_LABEL, UNTITLED, WATCHED_AUTHOR_LABEL


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORK).json(path)


def _or(c: Column, other: Column) -> Column:
    """``c`` unless it is NULL or empty."""
    return F.coalesce(F.when(c != "", c), other)


def is_preprint(work_type: Column, host_type: Column) -> Column:
    return F.when((work_type == "preprint") | (F.lower(host_type) == "repository"), 1).otherwise(0)


def works_to_items(works: DataFrame, source: Column, extra=()) -> DataFrame:
    """Nested works to item rows under the given source label."""
    location = F.col("primary_location")
    host = location["source"]
    return works.withColumn("_abstract", place_tokens(F.col("abstract_inverted_index"))).select(
        source.alias("source"), F.lit("paper").alias("source_type"),
        _or(F.col("title"), F.lit(UNTITLED)).alias("title"),
        _or(location["landing_page_url"], F.coalesce("id", F.lit(""))).alias("url"),
        F.when(drop_doi_prefix(F.col("doi")) != "", drop_doi_prefix(F.col("doi"))).alias("doi"),
        F.expr("try_cast(publication_date AS DATE)").alias("published_at"),
        strip_html(F.col("_abstract")).alias("summary"),
        F.coalesce(host["display_name"], F.lit("")).alias("venue"),
        is_preprint(F.col("type"), host["type"]).alias("is_preprint"), *extra)


def published_since(works: DataFrame, as_of, window_days: int) -> DataFrame:
    """Works published on or after the window's first day; unknown dates fail."""
    return works.filter(F.expr("try_cast(publication_date AS DATE)")
                        >= F.to_date(ago(as_of, days=window_days)))


def matching_queries(text: Column, queries) -> Column:
    """The queries whose words all occur in a lower-cased text.

    Stemming and ranking of the remote search cannot be reproduced from outside;
    containing every word of the query is this library's definition of a match.
    """
    listed = F.array(*[F.struct(F.lit(q).alias("query"), string_list(q.lower().split()).alias("words"))
                       for q in queries])
    return let(text, lambda x: F.transform(
        F.filter(listed, lambda q: F.forall(q["words"], lambda w: F.contains(x, w))),
        lambda q: q["query"]))


def topic_labels(text: Column, queries) -> Column:
    return F.transform(matching_queries(text, queries), lambda q: F.concat(F.lit(QUERY_LABEL), q))


def issn_labels(issns: Column, watched) -> Column:
    found = F.array_intersect(issns, string_list(dict.fromkeys(watched)))
    return F.transform(found, lambda i: F.concat(F.lit(ISSN_LABEL), i))


def author_labels(authors: Column, watched) -> Column:
    found = F.array_intersect(authors, string_list(dict.fromkeys(watched)))
    return F.transform(found, lambda x: F.concat(F.lit(WATCHED_AUTHOR_LABEL), x))


def selected(works: DataFrame, labels: Column) -> DataFrame:
    """One row per (work, label), labelled as its ``source``."""
    return works.withColumn("source", F.explode(labels))


def collect_works(works: DataFrame, queries, issns, authors, as_of, window_days: int,
                  per_label: int | None = None) -> DataFrame:
    """Items of all three selections in one pass; a work selected twice is
    listed twice.  ``per_label`` keeps the newest works of each query, ISSN and
    author only, as a paged search would."""
    recent = published_since(works, as_of, window_days)
    text = F.lower(F.concat_ws(" ", "title", place_tokens(F.col("abstract_inverted_index"))))
    ids = F.transform("authorships", lambda a: last_segment(a["author"]["id"]))
    none = string_list([])
    parts = [topic_labels(text, queries) if queries else none,
             F.coalesce(issn_labels(F.col("primary_location.source.issn"), issns), none) if issns else none,
             F.coalesce(author_labels(ids, authors), none) if authors else none]
    found = selected(recent, F.concat(*parts))
    if per_label:
        newest = [F.expr("try_cast(publication_date AS DATE)").desc_nulls_last(), F.col("id")]
        found = first_per_group(found, ["source"], newest, per_label, spread=["id"])
    return works_to_items(found, F.col("source"))
