"""Identity, in-batch dedupe and insert-only upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import nonblank
from fieldscope.functions.identity import item_id
from fieldscope.functions.text import title_key
from fieldscope.operators.groups import keep_first
from fieldscope.schemas import ITEM

COLLECTION_ORDER = ("source_ord", "seq")


def conform(df: DataFrame, schema=ITEM, extra=()) -> DataFrame:
    """Project to ``schema``: absent columns become NULL, unknown ones go."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields], *extra)


def has_identity() -> Column:
    """A row with neither DOI nor URL could only share its id with all others like it."""
    return nonblank(F.col("doi")).isNotNull() | nonblank(F.col("url")).isNotNull()


def with_identity(items: DataFrame) -> DataFrame:
    """Items with their id.  Rows that cannot have one are left out; ``without_identity`` has them."""
    return items.filter(has_identity()).withColumn("id", item_id(F.col("doi"), F.col("url")))


def without_identity(items: DataFrame) -> DataFrame:
    """The rows that ``with_identity`` leaves out, for a table of failures."""
    return items.filter(~has_identity())


def dedupe_first(items: DataFrame, order=COLLECTION_ORDER) -> DataFrame:
    """First delivery of each id in collection order wins."""
    return keep_first(items, ["id"], list(order))


def upsert_new(batch: DataFrame, existing: DataFrame, order=COLLECTION_ORDER) -> DataFrame:
    """Rows of ``batch`` to append: first per id, and not stored yet."""
    return dedupe_first(batch, order).join(existing.select("id"), "id", "left_anti")


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under one schema; late columns are NULL on old rows."""
    return old.unionByName(new, allowMissingColumns=True)


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union in the given order, remembering each row's source position."""
    parts = [df.withColumn("collector", F.lit(name)).withColumn("source_ord", F.lit(at))
             for at, (name, df) in enumerate(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_counts(collected: DataFrame, names) -> DataFrame:
    """Fetched rows per collector; collectors that brought nothing appear with 0."""
    spark = collected.sparkSession
    listed = spark.createDataFrame([(n,) for n in names], "collector string")
    counts = collected.groupBy("collector").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "collector", "left").select(
        "collector", F.coalesce("n", F.lit(0)).alias("fetched"), F.lit(1).alias("ok"),
        F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" items")).alias("note"))


def near_duplicate_titles(items: DataFrame, title: str = "title", id_col: str = "id") -> DataFrame:
    """Title keys shared by more than one item."""
    return (items.select(title_key(F.col(title)).alias("title_key"), F.col(id_col).alias("_id"))
            .filter(F.col("title_key") != "")
            .groupBy("title_key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"))
            .filter(F.col("n") > 1))


def latest_value(meta: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """Last write per key of an append-only key/value table."""
    at = F.struct("ts", tiebreak) if tiebreak else F.col("ts")
    return meta.groupBy("key").agg(F.max_by("value", at).alias("value"))
