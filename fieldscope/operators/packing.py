"""Packing ordered documents into a text block of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldscope.functions.columns import nonblank, strip
from fieldscope.operators.groups import first_per_group

# The frame around each document and the mark of a cut one.
CHUNK_FORMAT = "\n--- %s ---\n%s\n"
CHUNK_MARK = "\n--- "
CUT_MARK = "\n[truncated]\n"
# The frame plus a body of one character.
_SHORTEST_CHUNK = len(CHUNK_FORMAT % ("", "x"))


def pack_budget(docs: DataFrame, keys, order: str, max_chars: int,
                header: str = "") -> DataFrame:
    """One ``block`` per group: documents in ``order`` until ``max_chars`` is
    reached, the overflowing one cut and marked.

    ``docs`` holds the keys, ``order``, ``name`` and ``body``; blank bodies are
    skipped.  Every chunk has a minimum length, so only the first few documents
    of a group can matter, and all others are dropped before anything is
    gathered.  A group's block is bounded by the budget.
    """
    at_most = max_chars // _SHORTEST_CHUNK + 1
    chunk = F.format_string(CHUNK_FORMAT, "name", "_body")
    # One character over the budget already overflows: no row need be longer.
    chunks = (docs.withColumn("_body", strip(F.col("body"))).filter(F.col("_body") != "")
              .select(*keys, order, F.substring(chunk, 1, max_chars + 1).alias("_chunk")))
    head = first_per_group(chunks, keys, [order], at_most)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    measured = head.withColumn("_used", F.coalesce(F.sum(F.length("_chunk")).over(before), F.lit(0)))
    room = F.lit(max_chars) - F.col("_used")
    rest = F.substring("_chunk", F.lit(1), room.cast("int"))
    part = (F.when(F.length("_chunk") <= room, F.col("_chunk"))
            .otherwise(F.concat(nonblank(rest), F.lit(CUT_MARK))))
    kept = measured.filter(room >= 0).select(*keys, order, part.alias("_part"))
    parts = F.sort_array(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct(order, "_part"))))
    blocks = kept.groupBy(*keys).agg(F.array_join(parts["_part"], "").alias("_text"))
    return blocks.select(*keys, F.when(F.col("_text") == "", F.lit(""))
                         .otherwise(F.concat(F.lit(header), F.col("_text"))).alias("block"))


def describe_blocks(blocks: DataFrame) -> DataFrame:
    """Document count and length of each block, with the one-line summary."""
    marks = F.size(F.split("block", CHUNK_MARK)) - 1
    counted = blocks.withColumn("n_docs", marks.cast("long")).withColumn("n_chars", F.length("block").cast("long"))
    plural = F.when(F.col("n_docs") == 1, F.lit("")).otherwise(F.lit("s"))
    return counted.withColumn("note", F.when(F.col("n_chars") == 0, F.lit("no reference documents"))
                              .otherwise(F.concat(F.col("n_docs").cast("string"), F.lit(" reference document"),
                                                  plural, F.lit(", "), F.col("n_chars").cast("string"),
                                                  F.lit(" chars"))))
