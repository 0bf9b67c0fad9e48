"""Library-seeded discovery over the citation and authorship edges.

Works are a table with ``work_id``, ``published`` (date) and ``type``; edges are
``citations(citing_id, cited_id)`` and ``authorships(work_id, author_id, pos)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldscope.functions.identity import clean_doi
from fieldscope.functions.text import last_segment
from fieldscope.operators.groups import materialize
from fieldscope.settings import AUTHOR_LABEL, CITES_LABEL, DiscoverySettings


def work_table(works: DataFrame) -> DataFrame:
    """Flat works from nested work records, under short ids."""
    return works.select(
        last_segment(F.col("id")).alias("work_id"), "doi", "title", "type",
        F.expr("try_cast(publication_date AS DATE)").alias("published"))


def citation_edges(works: DataFrame) -> DataFrame:
    return works.select(
        last_segment(F.col("id")).alias("citing_id"),
        F.explode("referenced_works").alias("cited")).select(
        "citing_id", last_segment(F.col("cited")).alias("cited_id"))


def authorship_edges(works: DataFrame) -> DataFrame:
    return works.select(
        last_segment(F.col("id")).alias("work_id"),
        F.posexplode("authorships").alias("pos", "a")).select(
        "work_id", "pos", last_segment(F.col("a.author.id")).alias("author_id")).filter(
        F.col("author_id") != "")


def resolve_library(dois: DataFrame, works: DataFrame) -> DataFrame:
    """(work_id, seq) of the works behind a list of DOIs ``(doi, seq)``."""
    listed = dois.select(clean_doi(F.col("doi")).alias("doi"), "seq").filter(F.col("doi") != "")
    keyed = works.select("work_id", clean_doi(F.col("doi")).alias("doi")).filter(F.col("doi") != "")
    return (keyed.join(listed, "doi")
            .groupBy("work_id").agg(F.min("seq").alias("seq")))


def top_authors(library: DataFrame, authorships: DataFrame, n: int) -> DataFrame:
    """Authors met most often in the library; ties keep first-encounter order.
    An author listed twice on one work counts twice."""
    met = authorships.join(library, "work_id")
    return (met.groupBy("author_id")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "work_id", "pos")).alias("first"))
            .orderBy(F.col("n").desc(), F.col("first").asc(), F.col("author_id").asc()).limit(n)
            .select("author_id", "n"))


def citing_ids(library: DataFrame, citations: DataFrame, max_seeds: int | None = None) -> DataFrame:
    """Works that reference a library work, or one of the first ``max_seeds``.
    How the seeds are joined is left to their size."""
    first = library.orderBy("seq", "work_id").limit(max_seeds) if max_seeds is not None else library
    seeds = first.select(F.col("work_id").alias("cited_id"))
    return (citations.join(seeds, "cited_id", "left_semi")
            .select(F.col("citing_id").alias("work_id")).distinct())


def authored_ids(authors: DataFrame, authorships: DataFrame) -> DataFrame:
    """Works by any of ``authors``; a top-n list is small enough for Spark to
    broadcast on its own."""
    return (authorships.join(authors.select("author_id"), "author_id", "left_semi")
            .select("work_id").distinct())


def recent_citing(works, library, citations, cutoff, max_seeds: int | None = None) -> DataFrame:
    return (works.filter(F.col("published") >= F.to_date(cutoff))
            .join(citing_ids(library, citations, max_seeds), "work_id", "left_semi"))


def recent_by_authors(works, authors, authorships, cutoff) -> DataFrame:
    return (works.filter((F.col("published") >= F.to_date(cutoff)) & (F.col("type") == "article"))
            .join(authored_ids(authors, authorships), "work_id", "left_semi"))


def discover(works: DataFrame, library: DataFrame, citations: DataFrame, authorships: DataFrame,
             cutoff, settings: DiscoverySettings = DiscoverySettings()) -> DataFrame:
    """New works that cite the library or come from its main authors, without
    the library itself.  The citing label wins where both apply.

    The library is needed three times and small against the works table it was
    resolved from, so it is written once.  Candidate ids are labelled,
    deduplicated and stripped of library works before the one join to all works.
    """
    library = materialize(library)
    cites = citing_ids(library, citations, settings.max_seed_works).withColumn("via", F.lit(0))
    wrote = authored_ids(top_authors(library, authorships, settings.max_authors),
                         authorships).withColumn("via", F.lit(1))
    candidates = (cites.unionByName(wrote).groupBy("work_id").agg(F.min("via").alias("via"))
                  .join(library.select("work_id"), "work_id", "left_anti"))
    return (works.filter(F.col("published") >= F.to_date(cutoff))
            .join(candidates, "work_id")
            .filter((F.col("via") == 0) | (F.col("type") == "article"))
            .withColumn("source", F.when(F.col("via") == 0, CITES_LABEL).otherwise(AUTHOR_LABEL))
            .drop("via"))


def distinct_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct values of ``key`` with the position they were first seen at."""
    return df.groupBy(key).agg(F.min(seq).alias("seq"))
