"""Filling blank summaries from a DOI-keyed abstract table.

The budgeted form follows a sequential lookup: walk the items in order, stop
after ``limit`` fills, and give up once ``give_up_after`` lookups all missed.
Where such a walk stops depends only on two positions, the ``limit``-th hit
and the ``give_up_after``-th lookup, so both are found as small top-n
selections and no row is visited in sequence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import is_blank, strip
from fieldscope.functions.text import strip_titled_html
from fieldscope.operators.groups import first_per_group
from fieldscope.operators.ingest import COLLECTION_ORDER


def needs_abstract() -> Column:
    """A paper with a DOI and a blank summary."""
    return ((F.col("source_type") == "paper") & (F.coalesce("doi", F.lit("")) != "")
            & is_blank(F.col("summary")))


def _doi_key(c: Column) -> Column:
    return F.lower(strip(c))


def look_up(eligible: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Add ``abstract`` (clean text, '' on a miss) to eligible items.  Abstracts
    are cleaned after the join, so only those of eligible items are."""
    by_doi = (abstracts.select(_doi_key(F.col("doi")).alias("_doi"), F.col("abstract").alias("_raw"))
              .groupBy("_doi").agg(F.max("_raw").alias("_raw")))
    return (eligible.withColumn("_doi", _doi_key(F.col("doi"))).join(by_doi, "_doi", "left")
            .withColumn("abstract", strip_titled_html(F.col("_raw")))
            .drop("_doi", "_raw"))


def backfill(items: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Fill every blank summary that has an abstract; nothing is overwritten.
    Rows that need none stay out of the join, so they do not pile up on a
    NULL key."""
    filled = look_up(items.filter(needs_abstract()), abstracts)
    filled = filled.withColumn("summary", F.when(F.col("abstract") != "", F.col("abstract"))
                               .otherwise(F.col("summary"))).drop("abstract")
    return items.filter(~F.coalesce(needs_abstract(), F.lit(False))).unionByName(filled)


def budgeted_lookup(items: DataFrame, abstracts: DataFrame, order=COLLECTION_ORDER, *,
                    limit: int, give_up_after: int, partition_by=()) -> DataFrame:
    """Every eligible item's place with ``tried``, ``filled`` and ``abstract``.

    ``order`` names columns that order the items totally.  With ``partition_by``
    each group has a budget of its own.  Only the place and the DOI of an item
    take part, so the shuffles stay narrow and are the same in every branch.
    """
    order = list(order)
    keys = list(partition_by) or ["_all"]
    place = F.struct(*order)
    slim = (items.filter(needs_abstract()).withColumn("_all", F.lit(0))
            .select(*keys, *[c for c in order if c not in keys], "doi"))
    found = look_up(slim, abstracts)
    bounds = _stops(slim, found, keys, order, place, limit, give_up_after)
    if partition_by:
        bounded = _join_groups(found, bounds.withColumnRenamed("stop", "_stop"), keys)
    else:
        bounded = found.withColumn("_stop", bounds.select("stop").scalar())
    stop = F.col("_stop")
    return (bounded
            .withColumn("tried", F.lit(limit > 0)
                        & (stop["last_fill"].isNull() | (place <= stop["last_fill"]))
                        & (~stop["gave_up"] | (place <= stop["last_try"])))
            .withColumn("filled", F.col("tried") & (F.col("abstract") != ""))
            .drop("_all", "_stop"))


def _stops(slim, found, keys, order, place, limit, give_up_after) -> DataFrame:
    """Per group: where the fill budget ends, where giving up would end it, and
    whether the first ``give_up_after`` lookups all missed."""
    hits = first_per_group(found.filter(F.col("abstract") != "").drop("abstract"), keys, order, max(limit, 1))
    tries = first_per_group(slim, keys, order, give_up_after)
    fill, attempt = F.when(F.col("hit"), F.col("place")), F.when(~F.col("hit"), F.col("place"))
    place = place.alias("place")
    ends = (hits.select(*keys, place, F.lit(True).alias("hit"))
            .unionByName(tries.select(*keys, place, F.lit(False).alias("hit"))).groupBy(*keys)
            .agg(F.count(fill).alias("_fills"), F.min(fill).alias("_first_fill"), F.max(fill).alias("_last_fill"),
                 F.count(attempt).alias("_tries"), F.max(attempt).alias("_last_try")))
    missed = (F.col("_tries") >= give_up_after) & (
        F.col("_first_fill").isNull() | (F.col("_first_fill") > F.col("_last_try")))
    return ends.select(*keys, F.struct(
        F.when(F.col("_fills") >= limit, F.col("_last_fill")).alias("last_fill"),
        F.col("_last_try").alias("last_try"), missed.alias("gave_up")).alias("stop"))


def _join_groups(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Join on group keys, where a NULL key is a group like any other."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same).drop(*[f"_right_{k}" for k in keys])


def backfill_counters(items: DataFrame, attempts: DataFrame, order=COLLECTION_ORDER, *,
                      give_up_after: int) -> DataFrame:
    """One row: filled, tried, gave_up.  Giving up is noticed only when another
    item follows the last miss."""
    place = F.struct(*order).alias("place")
    walked = attempts.select(place, "tried", "filled").unionByName(
        items.select(place, F.lit(False).alias("tried"), F.lit(False).alias("filled")))
    return walked.agg(
        F.count_if("filled").alias("filled"), F.count_if("tried").alias("tried"),
        F.max(F.when(F.col("tried"), F.col("place"))).alias("_last"), F.max("place").alias("_end")).select(
        "filled", "tried",
        F.coalesce((F.col("tried") >= give_up_after) & (F.col("filled") == 0)
                   & (F.col("_end") > F.col("_last")), F.lit(False)).alias("gave_up"))


def apply_attempts(items: DataFrame, attempts: DataFrame, order=COLLECTION_ORDER,
                   partitioned: bool = False) -> DataFrame:
    """Items with the fills of a budgeted lookup put in.  Without ``partition_by``
    the budget bounds the number of fills, and they are broadcast."""
    order = list(order)
    fills = attempts.filter("filled").select(*order, F.col("abstract").alias("_fill"))
    return (items.join(fills if partitioned else F.broadcast(fills), order, "left")
            .withColumn("summary", F.coalesce("_fill", "summary")).drop("_fill"))
