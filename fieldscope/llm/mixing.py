"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in a shuffled order and twice over, form a
stream that is cut into blocks of equally many words.  Slot ``t`` of the mix
belongs to the source in whose share of [0, 1) the point ``frac((t + 1) / phi)``
lies; the n-th slot of a source takes its n-th block.  Golden-ratio points are so
even that a source's count of slots misses its share by a few slots at most:
surplus slots are dropped, missing ones follow at the end, and the last block of a
source is cut, so that a source gives its target to the word.

* Targets: weights 5, 2, 1 over the sources by code point (NULL last), repeating,
  share 150 % of all words; no target exceeds twice its source, and the excess is
  shared anew by weight.
* A NULL text has no words; documents without words are never taken.
* Rows that repeat are documents of their own.  Without words there are no slots.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from fieldscope.llm.common import SPACE, kept, n_words, running_sum, slice_bits, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 512
SEED = 20240601
# Slots are ranked in slices of consecutive slots, at most this many.
SLICES = 4096
GOLDEN = (math.sqrt(5) - 1) / 2


def fill(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * each >= most * sizes[i]}
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else weights[i] * each
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def _located(documents: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Each document's first word in its source's stream; the sources; their rows."""
    spark = documents.sparkSession
    narrow = kept(documents.select(
        "doc_id", "source", n_words(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("_text"),
        F.xxhash64("doc_id", F.xxhash64(whole_text()), F.lit(SEED)).alias("_hash"), F.monotonically_increasing_id().alias("_row")), "mixing")
    # One row for each source: the table of weights of the mixture, which its user writes.
    found = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fill([r.size for r in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))],
                   SHARE * sum(r.size for r in found)) if found else []
    rows = [(r.source, i, r.size, t, round(t), -(-round(t) // BLOCK)) for i, (r, t) in enumerate(zip(found, targets))]
    sources = kept(spark.createDataFrame(
        rows, "_name string, _source int, source_size long, target double, _words long, _slots long").coalesce(1), "sources")
    bits = slice_bits(max((r.n for r in found), default=0))
    part = F.shiftright("_hash", 64 - bits) if bits else F.lit(0)
    located = narrow.join(sources, F.col("source").eqNullSafe(F.col("_name"))).drop("_name").withColumn("_slice", part)
    return running_sum(located, ["_source"], "_slice", ["_hash", "doc_id", "_text", "_row"], "size", "_first"), sources, rows


def schedule(spark, rows: list) -> DataFrame:
    """One row for each slot of the mix: ``slot``, ``_source`` and ``block``, its rank within the source."""
    total, bounds, sum_ = sum(r[5] for r in rows), [], 0
    for r in rows:
        sum_ += r[5]
        bounds.append(sum_ / max(total, 1))
    need = F.array(*[F.lit(r[5]) for r in rows]) if rows else F.array(F.lit(0))
    point = (F.col("id") + 1) * F.lit(GOLDEN) % 1.0
    shares = F.array(*[F.lit(b) for b in bounds[:-1]]) if len(bounds) > 1 else F.array().cast("array<double>")
    slots = spark.range(total).withColumn("_source", F.size(F.filter(shares, lambda b: b <= point))).withColumn(
        "_chunk", F.floor(F.col("id") / max(1, -(-total // SLICES)))).withColumn("_one", F.lit(1))
    ranked = running_sum(slots, ["_source"], "_chunk", ["id"], "_one", "block")
    needed = F.element_at(need, F.col("_source") + 1)
    met = slots.groupBy("_source").agg(F.count(F.lit(1)).alias("_met"))
    everyone = spark.range(len(rows)).select(F.col("id").cast("int").alias("_source"))
    short = everyone.join(met, "_source", "left").withColumn("_met", F.coalesce("_met", F.lit(0))).filter(
        F.col("_met") < needed).select("_source", F.explode(F.sequence(F.col("_met"), needed - 1)).alias("block"))
    return ranked.filter(F.col("block") < needed).select(F.col("id").alias("slot"), "_source", "block").unionByName(
        short.select((F.lit(total) + F.col("block")).alias("slot"), "_source", "block"))


def mix(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix, and all documents with the words taken of them.

    A row of the mix is a run of words of one document in one slot: ``slot``,
    ``source``, ``doc_id``, ``epoch`` (0 or 1), ``from_word`` and ``words``.
    """
    located, _, rows = _located(documents)
    located = kept(located, "located")
    passes = located.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_start", F.col("epoch") * F.col("source_size") + F.col("_first")).withColumn(
        "_end", F.least(F.col("_start") + F.col("size"), F.col("_words"))).filter(F.col("_end") > F.col("_start"))
    blocks = F.sequence(F.floor(F.col("_start") / BLOCK), F.floor((F.col("_end") - 1) / BLOCK))
    pieces = passes.withColumn("block", F.explode(blocks)).withColumn(
        "_from", F.greatest("_start", F.col("block") * BLOCK)).withColumn(
        "words", F.least("_end", (F.col("block") + 1) * BLOCK) - F.col("_from"))
    mixed = pieces.join(schedule(documents.sparkSession, rows), ["_source", "block"]).select(
        "slot", "source", "doc_id", "_row", "_text", "epoch", (F.col("_from") - F.col("_start")).alias("from_word"), "words")
    sums = mixed.groupBy("_row").agg(F.sum("words").alias("taken"))
    taken = located.join(sums, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return mixed, taken


def op4_mixture(spark, sf_dir: str) -> DataFrame:
    _, taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, once for each time, with all their other columns.

    A document of which a pass takes only its first words keeps these alone,
    with one space between them; ``n_chars`` follows the text.
    """
    mixed, _ = mix(documents)
    runs = mixed.groupBy("_row", "doc_id", "_text", "epoch").agg(F.sum("words").alias("_taken")).withColumnRenamed(
        "doc_id", "_id").withColumnRenamed("_text", "_key")
    fields = {c: F.col(f"_document.`{c}`") for c in documents.columns}
    texts = documents.select(F.struct("*").alias("_document"), F.col("doc_id").alias("_doc"),
                             F.xxhash64(whole_text()).alias("_same")).dropDuplicates(["_doc", "_same"])
    joined = texts.join(runs, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_same") == F.col("_key")))
    text = F.coalesce(fields["text"], F.lit(""))
    first = F.expr("substring_index(_plain, ' ', cast(_taken AS int))")
    joined = joined.withColumn("_plain", F.trim(F.regexp_replace(text, f"{SPACE}+", " "))).withColumn(
        "_cut", F.when(n_words(text) > F.col("_taken"), first).otherwise(fields["text"]))
    fields |= {"text": F.col("_cut")} | ({"n_chars": F.char_length("_cut").cast("long")} if "n_chars" in fields else {})
    return joined.select(*[f.alias(c) for c, f in fields.items()])
