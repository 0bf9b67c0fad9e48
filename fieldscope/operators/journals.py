"""Journal watchlist audit and lookup by name.

Watchlists and looked-up names are short configuration lists; they enter as
literals.  The registry side is a table of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldscope.functions.columns import let, nonblank
from fieldscope.functions.text import title_key
from fieldscope.operators import similar
from fieldscope.operators.groups import first_per_group, materialize


def watchlist_audit(journals: DataFrame, issns) -> DataFrame:
    """Every watched ISSN with its journal, or DEAD where none has it."""
    watch = journals.sparkSession.createDataFrame([(i,) for i in issns], "issn string")
    known = (journals.filter(F.col("issn_l").isin(*issns))
             .groupBy(F.col("issn_l").alias("issn"))
             .agg(F.min(F.struct(F.col("display_name").alias("name"),
                                 F.col("works_count").alias("works"))).alias("j")))
    return watch.join(known, "issn", "left").select(
        "issn", F.when(F.col("j").isNull(), F.lit("DEAD")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce("j.name", F.lit("?")).alias("name"),
        F.coalesce("j.works", F.lit(0)).cast("long").alias("works"))


def dead_count(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if(F.col("status") == "DEAD").alias("dead"))


def _tokens(c: Column) -> Column:
    return F.split(title_key(c), " ")


def _rarest(named: DataFrame, names, words: list[str]) -> DataFrame:
    """(query, key, word): for each name that of its words which the fewest journals have, of equal ones the first.

    One pass over the registry gives one row of counts, one for each word of the
    configured names.
    """
    have = _tokens(F.col("name"))
    counts = named.agg(*[F.count_if(F.array_contains(have, w)).alias(f"n{i}") for i, w in enumerate(words)])
    at = {w: f"n{i}" for i, w in enumerate(words)}

    def rarest(name: str) -> Column:
        met = [F.when(F.col(at[w]) > 0, F.struct(F.col(at[w]).alias("n"), F.lit(w).alias("w")))
               for w in dict.fromkeys(title_key_of(name).split())]
        return F.struct(F.lit(name).alias("query"), F.lit(title_key_of(name)).alias("key"), F.array_min(F.array(*met))["w"].alias("word"))

    return counts.select(F.explode(F.array(*[rarest(n) for n in names if n.split()])).alias("r")).select("r.*").filter("word IS NOT NULL")


def title_key_of(name: str) -> str:
    """``title_key`` of a configured name."""
    return " ".join(name.lower().split())


def _named(journals: DataFrame) -> DataFrame:
    publisher = F.col("host_organization_name") if "host_organization_name" in journals.columns else F.lit(None)
    return journals.select(
        F.coalesce("display_name", F.lit("?")).alias("name"), F.coalesce("issn_l", F.lit("")).alias("issn"),
        F.coalesce("works_count", F.lit(0)).cast("long").alias("works"),
        F.coalesce(publisher.cast("string"), F.lit("")).alias("publisher"))


def journal_lookup(journals: DataFrame, names, limit: int | None = None) -> DataFrame:
    """Near matches per looked-up name, best first.

    A journal is a candidate when it has the rarest word of the name, counted
    over the registry, so common words ("journal", "of") make no candidates.
    Candidates are ranked by edit distance, then by number of works, name and
    ISSN.  Of the first ``limit``, those without an ISSN cannot be watched and
    are dropped.  A name left with none is reported as unmatched.
    """
    names = list(dict.fromkeys(names))
    named = _named(journals)
    words = sorted({w for n in names for w in title_key_of(n).split()})
    shared = F.array_distinct(F.filter(_tokens(F.col("name")), lambda w: w.isin(*words)))
    candidates = (named.select("*", F.explode(shared).alias("word")).join(_rarest(named, names, words), "word")
                  .select("name", "issn", "works", "publisher", "query",
                          F.levenshtein(title_key(F.col("name")), F.col("key")).alias("distance")))
    order = [F.col("distance").asc(), F.col("works").desc(), F.col("name").asc(), F.col("issn").asc(), F.col("publisher").asc()]
    if limit is None:
        place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
        best = candidates.withColumn("position", place)
    else:
        best = first_per_group(candidates, ["query"], order, limit, rank="position", spread=["name", "issn", "works"])
    best = best.filter(nonblank(F.col("issn")).isNotNull())
    listed = journals.sparkSession.createDataFrame([(n,) for n in names], "query string")
    return listed.join(best, "query", "left").select(
        "query", F.when(F.col("issn").isNull(), F.lit("no match"))
        .otherwise(F.lit("match")).alias("status"),
        F.col("position").cast("long").alias("position"), "issn", "name", "works", "publisher",
        F.col("distance").cast("long").alias("distance"))


def journal_index(journals: DataFrame, edits: int = 2) -> DataFrame:
    """The gram index of a registry's names, for any number of lookups (``similar.name_index``)."""
    return similar.name_index(_named(journals).select(title_key(F.col("name")).alias("key")), edits)


def misspelt_lookup(journals: DataFrame, wanted: DataFrame, edits: int = 2, index: DataFrame | None = None) -> DataFrame:
    """Every journal whose name is at most ``edits`` edits from a looked-up one, in all words of it.

    ``wanted`` is a table of any size with the names in ``query``.  Only names move until the matches are known; journals
    without an ISSN cannot be watched and are left out.  A name without any is reported as unmatched.
    """
    named = _named(journals).withColumn("_key", title_key(F.col("name")))
    asked = wanted.select("query", title_key(F.col("query")).alias("_asked")).distinct()
    keys = named.select(F.col("_key").alias("key"))
    if index is None:
        index = similar.name_index(keys, edits)
    found = materialize(similar.near_names(index, keys, asked.select(F.col("_asked").alias("key")), edits))
    hits = named.filter(nonblank(F.col("issn")).isNotNull()).join(found, F.col("_key") == F.col("key")).select(
        "wanted_key", "issn", "name", "works", "publisher", F.col("distance").cast("long").alias("distance"))
    return asked.join(hits, F.col("_asked") == F.col("wanted_key"), "left").select(
        "query", F.when(F.col("wanted_key").isNull(), F.lit("no match")).otherwise(F.lit("match")).alias("status"),
        "issn", "name", "works", "publisher", "distance")
