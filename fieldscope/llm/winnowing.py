"""Document fingerprints by winnowing, in built-in functions alone.

A window of ``K`` words rolls along the text and gives a hash at each place.  In
each window of ``W`` neighbouring hashes the smallest is chosen, the rightmost one
among equals, and kept with its position.  Two texts that share ``K + W - 1`` words
in a row therefore share a fingerprint at known places, and common runs of fewer
than ``K`` words never make them alike.  Windows also reach over both ends of a text,
where they see what there is of them: the first and the last run are always
chosen, so a change at an end shows, in texts of any length.

A word stands for all its runs of ``PIECE`` code points, one after the other, and for
itself where it has no more than these: one more code point is one more run.  Hardly
any word of prose is as long; scripts without white space and encoded data have
windows this way.  Positions count these runs as words.

Hashes have 64 bits; they are compared by the upper 32, so that hash and position
fit into one number and the smallest number is the rightmost smallest hash.

* A NULL text is an empty one; without words the fingerprint is empty.
* Fewer than ``K`` words, or runs of a long word, are hashed as one.
* Likeness is the Jaccard similarity of the sets of chosen hashes; two empty
  fingerprints have likeness 1.
* Equal doc_ids follow the order of a hash of their texts; NULL ones come last.
* Repeated rows have fingerprints each; a table of one row is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fieldscope.llm.common import SPACE, kept, whole_text

K = 5
W = 8
PIECE = 24
ROWS = 512  # documents for each range of doc_id, as long as there are no more than RANGES * PARTS of these
RANGES, PARTS = 512, 256
_MASK = (1 << 31) - 1  # of a position; a text has fewer words than that


def fingerprint(df: DataFrame, text: str, prints: str, hashes: str) -> DataFrame:
    """Add the fingerprint of a text column without NULLs, as a string of ``hash:position``, and its set of hashes.

    Each step is a column of its own, so none is computed twice.
    """
    after = [f"get(_w, i + {j})" for j in range(1, K)]
    window = [f"get(_v, i + {j})" for j in range(W)]
    bare = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    df = df.withColumn("_w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+")))
    # The code points of a long word are an array once, bound as a lambda variable; other texts aren't looked at again.
    pieces = f"transform(slice(c, 1, size(c) - {PIECE - 1}), (x, i) -> xxhash64(array_join(slice(c, i + 1, {PIECE}), '')))"
    long_ = f"flatten(transform(array(regexp_extract_all(w, '(?s).', 0)), c -> {pieces}))"
    each = f"flatten(transform(_w, w -> if(char_length(w) > {PIECE}, {long_}, array(xxhash64(w)))))"
    df = df.withColumn("_w", F.expr(
        f"if(exists(_w, w -> char_length(w) > {PIECE}), {each}, transform(_w, w -> xxhash64(w)))"))
    df = df.withColumn("_g", F.expr(
        f"transform(slice(_w, 1, greatest(size(_w) - {K - 1}, 1)), (w, i) -> xxhash64(w, {', '.join(after)}))"))
    df = df.withColumn("_v", F.expr(
        f"transform(_g, (g, i) -> shiftleft(shiftrightunsigned(g, 32), 31) | ({_MASK}L - i))"))
    # What a window has beyond an end is NULL, and no least value.
    df = df.withColumn("_v", F.expr(
        f"if(size(_v) = 0, _v, array_distinct(transform(sequence({1 - W}, size(_v) - 1), i -> least({', '.join(window)}))))"))
    at = f"cast({_MASK}L - (v & {_MASK}L) AS int)"
    df = df.withColumn(prints, F.expr(f"array_join(transform(_v, v -> concat(lower(hex(get(_g, {at}))), ':', {at})), ' ')"))
    df = df.withColumn(hashes, F.expr(f"array_distinct(transform(_v, v -> get(_g, {at})))"))
    return df.drop("_w", "_g", "_v")


def likeness(a: str, b: str):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _bounds(documents: DataFrame) -> tuple[list[int], int]:
    """Quantiles of doc_id, and into how many parts of equal width each range between two of them is cut.

    They are approximate, and which numbers come out depends on the order in which tasks end: ranges that are to agree need
    the bounds of one call.
    """
    found = documents.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES + 1)], 8 * RANGES).alias("q"),
                          F.count(F.lit(1)).alias("n")).first()
    edges = sorted(set(found.q or []))
    parts = min(PARTS, max(1, found.n // ROWS // max(1, len(edges) - 1)))
    step = max(1, found.n // ROWS) if parts == 1 else RANGES
    return edges[::max(1, len(edges) // step)], parts


def _ranged(documents: DataFrame, edges: list[int], parts: int) -> DataFrame:
    """Add ``_range``, a number that rises as doc_id falls."""
    bounds = F.array(*[F.lit(e) for e in edges]).cast("array<long>") if edges else F.array().cast("array<long>")
    coarse = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    # As doubles, since the difference of two ids may be no long.
    at, low, high = (c.cast("double") for c in (F.col("doc_id"), F.get(bounds, coarse - 1), F.get(bounds, coarse)))
    fine = F.least(F.lit(parts - 1), F.floor((at - low) / F.nullif(high - low, F.lit(0.0)) * parts))
    number = coarse.cast("long") * parts + F.coalesce(fine, F.lit(0))
    return documents.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-number).cast("long"))


def with_next(documents: DataFrame) -> DataFrame:
    """Documents of ``doc_id`` and ``text``, without NULL texts, with ``_next``: the text after theirs in descending
    doc_id, the first one's for the last.  Further lookups may use the same order, so ``_extra`` rows, each the first
    document of the range that follows, stay in.

    Each range of doc_ids is a group of its own, so the texts are shuffled once and no task sees all of them.
    """
    bounds = _bounds(documents)
    rows = _ranged(documents.select("doc_id", whole_text().alias("text")), *bounds).withColumn("_tie", F.xxhash64("text"))
    # At most RANGES * PARTS rows, whatever the input: a single task orders them, and they may be broadcast.
    firsts = _ranged(documents.select("doc_id"), *bounds).groupBy("_range").agg(F.max("doc_id").alias("_first"))
    order = Window.orderBy("_range")
    start = F.first("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.lead("_range").over(order).isNull()
    nexts = kept(firsts.select(F.col("_range").alias("_home"), F.when(last, start).otherwise(
        F.lead("_first").over(order)).alias("_first")), "ranges")
    extra = rows.join(F.broadcast(nexts), F.col("doc_id").eqNullSafe(F.col("_first"))).select(
        "doc_id", "text", F.col("_home").alias("_range"), "_tie", F.lit(1).alias("_extra"))
    all_ = rows.withColumn("_extra", F.lit(0)).unionByName(extra)
    return all_.withColumn("_next", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "_tie")


def op2_winnowing(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.expr("cast(floor(n_chars / 2) AS int)")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", half)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars AS int) - _half)"),
                      F.expr("substring(coalesce(_next, ''), 1, _half)"))
    rows = rows.withColumn("_edited", edited).drop("_next", "_half")
    rows = fingerprint(rows, "text", "fingerprint", "_own").drop("text")
    rows = rows.withColumn("_next_own", F.lead("_own").over(in_order())).filter("_extra = 0")
    rows = rows.withColumn("near_next", likeness("_own", "_next_own")).drop("_next_own")
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    rows = fingerprint(rows, "_edited", "edited_fingerprint", "_changed")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness("_own", "_changed").alias("near_edited"), "near_next")
