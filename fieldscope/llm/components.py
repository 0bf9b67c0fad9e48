"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldscope.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with, for each node of links ``a``, ``b``.

    Each round sends every node's larger neighbours, then its smaller ones, to
    its smallest: stars grow together, and their number of rounds grows with the
    logarithm of the longest path.  Links are stars once no node has two smaller
    neighbours, or both smaller and larger ones; the smaller ones are counted while
    a round finds the smallest, so only its written table is asked.  A round's links are
    written, never collected, and so is the result: Spark deals out large keys of joins
    with written tables.
    """
    now = kept(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours join the smallest one among a node and its neighbours.
        smaller, larger = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), (
            (smaller > 1) | (smaller > 0) & (larger > 0)).alias("open")), "least")
        if least.filter("open").isEmpty():
            break
        large = kept(both.filter("b > a").join(least.drop("open"), "a").select(F.col("m").alias("a"), "b").filter(
            "a < b").distinct(), "links")
        # Smaller neighbours, and the node itself, join the smallest one.
        small = kept(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        next_ = large.join(small, "b").select("b", "a", "m").selectExpr(
            "explode(array(struct(m AS a, a AS b), struct(m AS a, b AS b))) AS e").select("e.a", "e.b").filter("a < b").distinct()
        now = kept(next_, "links")
    return kept(now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), "components")
