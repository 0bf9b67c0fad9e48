"""Packing into length buckets of least padding, and batches of a word budget inside each bucket.

Lengths and the budget are white-space words, not token ids.

One global histogram of lengths decides the bucket bounds: dynamic programming
over it finds the bounds with the least padding for a given number of buckets.
Lengths up to ``EXACT`` are bins of their own; longer ones fall into bins that
are less than 1/256 wide relative to their length, so the histogram has at most
a few thousand bins at any input size.  A bin keeps its largest length and its
sum, which makes the padding of every choice of bin ends exact.

* A NULL text has length 0 and is packed as an empty one.
* Repeated rows are packed each; without rows there are no batches.
* A document longer than the budget is a batch of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.llm.common import kept, n_words, running_sum, slice_bits, whole_text

EXACT = 4096


def _bin(length: Column) -> Column:
    """A number for each length up to EXACT, then 256 for each doubling."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    step = F.pow(F.lit(2.0), power - 8)
    coarse = EXACT + 1 + (power - 12) * 256 + F.floor(length / step).cast("int") - 256
    return F.when(length <= EXACT, length).otherwise(coarse).cast("int")


def best_bounds(largest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds, in rising order, of least padding: each bucket pads its documents to its largest length.

    The costs satisfy the quadrangle inequality, so the best cut for a bin
    never moves left as the bin moves right, and each layer of the dynamic
    program is solved by halving: O(bins x log bins) for one bucket more.
    """
    n = len(largest)
    if n == 0:
        return []
    counts = np.concatenate([[0], np.cumsum(count, dtype=np.float64)])
    totals = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
    ends = np.asarray(largest, dtype=np.float64)

    def padding(cuts, i):  # of a bucket of the bins cuts..i-1
        return ends[i - 1] * (counts[i] - counts[cuts]) - (totals[i] - totals[cuts])

    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choice = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            i = (low + high) // 2
            cuts = np.arange(first, min(last, i - 1) + 1)
            costs = cost[cuts] + padding(cuts, i)
            at = int(np.argmin(costs))
            new[i], cut[i] = costs[at], cuts[at]
            todo += [(low, i - 1, first, int(cuts[at])), (i + 1, high, int(cuts[at]), last)]
        cost = new
        choice.append(cut)
    bounds, i = [], n
    for cut in reversed(choice):
        if i == 0:
            break
        bounds.append(int(largest[i - 1]))
        i = int(cut[i])
    return bounds[::-1]


def pack(df: DataFrame, length: str, order: list[str], buckets: int, budget: int) -> DataFrame:
    """Add ``bucket``, ``bucket_length``, ``batch``, ``place`` and ``padding`` to narrow rows.

    A batch holds as many rows of a bucket as fit into ``budget`` when each is
    padded to ``bucket_length``.  Rows of a bucket are numbered in the order of
    a hash of ``order``, slice by slice, so a bucket with most of the rows is
    numbered by many tasks.
    """
    df = kept(df.withColumn("_bin", _bin(F.col(length))).withColumn("_hash", F.xxhash64(*order)), "packing")
    histogram = df.groupBy("_bin").agg(F.max(length).alias("m"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("s"))
    bins = sorted((r.m, r.n, r.s) for r in histogram.collect())  # at most EXACT + 256 for each doubling
    bounds = best_bounds(*(np.array(x) for x in zip(*bins)), buckets) if bins else [0]
    sizes = [sum(n for m, n, _ in bins if low < m <= high) for low, high in zip([-1, *bounds], bounds)]
    bits = slice_bits(max(sizes))
    literal = F.array(*[F.lit(b).cast("long") for b in bounds])
    df = df.withColumn("bucket", F.size(F.filter(literal, lambda b: b < F.col(length)))).withColumn(
        "bucket_length", F.element_at(literal, F.col("bucket") + 1)).withColumn(
        "_slice", F.shiftright("_hash", 64 - bits) if bits else F.lit(0)).withColumn("_one", F.lit(1))
    numbered = running_sum(df, ["bucket"], "_slice", ["_hash", *order], "_one", "_rank")
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return numbered.select(
        *[c for c in df.columns if not c.startswith("_") and c not in ("bucket", "bucket_length")], "bucket", "bucket_length",
        F.floor(F.col("_rank") / rows).cast("long").alias("batch"), (F.col("_rank") % rows).alias("place"),
        (F.col("bucket_length") - F.col(length)).alias("padding"))


BUCKETS = 16
BUDGET = 1 << 16


def pack_documents(documents: DataFrame, carry: tuple[str, ...] = (), buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Documents by their number of words; ``carry`` names further columns to keep."""
    narrow = documents.select("doc_id", *carry, n_words(whole_text()).alias("n_words"), F.xxhash64(whole_text()).alias("_text"))
    # Rows without a doc_id, or of the same one, are told apart by their texts, so they fill slices of their own.
    return pack(narrow, "n_words", ["doc_id", "_text"], buckets, budget)


def op3_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
