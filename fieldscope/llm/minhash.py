"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its shingles, runs of ``width`` words.  One hash of each shingle gives a
bin (upper bits) and a value; the smallest value of each bin is its signature.  An
empty bin borrows the value of the bin that comes first, among those that are not
empty, in an order drawn for it: optimal densification.  Bands of signature values
are buckets.  Equal sets are one class from the start.  In a bucket only star-shaped
edges, from each class to the smallest, are candidates, so there are never more of
them than entries; each is confirmed on the full sets.

A star can hide a link between two classes of a bucket that its centre doesn't
confirm.  So the sets of buckets whose classes are still in several components are
joined exactly: with shingles in order of how few of these sets have them, two linked
sets share one among the first ninth of the smaller and the first fifth of the larger.
Sets of different components that meet on such a shingle, and whose sizes and places
in this order leave room for a link, are candidates.  No bucket is held against itself.

Odd sketches rule candidates of both kinds out for sure: 2,048 parity bits of a
set, in which two sets differ by no more bits than they differ by shingles.  Only the
texts of pairs with as few bits as a link allows are compared.

* Letters A-Z count as small ones.  A NULL or empty text, or one without words, has
  an empty set and no links; fewer than ``width`` words are one shingle.
* Rows that repeat a doc_id are one document with several texts, and each row stays
  or goes with it; a NULL doc_id is linked with nothing and kept.  ``without_near_copies``
  first takes one row of those with equal doc_id and text, and of those without a doc_id
  and with equal words none where a document has that text, or else one.
* No rows, no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fieldscope.llm.common import kept, small_batches, whole_text
from fieldscope.llm.components import components

BINS = 256
BAND = 6
BANDS = BINS // BAND  # 42: a pair of similarity 0.8 shares no bucket with probability 3e-6
PERCENT = 80
WIDTH = 5
SKETCH = 32  # numbers of 64 parity bits
CACHE = 200_000  # words whose hashes a worker keeps
_SEED = 20240602
_U = np.uint64
# Odd multipliers of a public 64-bit mixer.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: Words, width: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    found = text.translate(_LOWER).split()
    if not found:
        return np.empty(0, _U)
    h = np.array([words[w] for w in found], _U)
    width = min(width, len(h))
    n = len(h) - width + 1
    made = _mix(h[:n])
    for i in range(1, width):
        made = _mix(made + (h[i:i + n] << _U(1)) + _U(1))
    return np.unique(made)


def _orders() -> np.ndarray:
    """For each bin the rank that it gives to each other one."""
    draw = np.random.default_rng(_SEED)
    return np.stack([draw.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def signature(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The densified signature of a set that is not empty."""
    edges = np.searchsorted(s, np.arange(BINS, dtype=_U) << _U(56))
    full = np.flatnonzero(np.diff(np.append(edges, len(s))))
    values = np.zeros(BINS, _U)
    values[full] = s[edges[full]]
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    if len(empty):
        values[empty] = values[full[np.argmin(ranks[empty][:, full], axis=1)]]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A bucket number for each band."""
    rows = values[:BANDS * BAND].reshape(BANDS, BAND)
    key = np.arange(1, BANDS + 1, dtype=_U) * _M2
    for i in range(BAND):
        key = _mix(key + rows[:, i])
    return key.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles at each of the sketch's bits."""
    parity = np.bincount((s & _U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


_BITS = [f"bits_{i}" for i in range(SKETCH)]
_SET = "doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>, " + ", ".join(f"{b} long" for b in _BITS)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """The size, identity (two hashes of the whole set), buckets and sketch of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks = Words(), _orders()
        for batch in batches:
            ids, sizes, first, second, keys, drawn = batch.column(0), [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py() or b"", words, width)
                raw = s.tobytes()
                sizes.append(len(s))
                first.append(xxhash.xxh3_64_intdigest(raw, 1))
                second.append(xxhash.xxh3_64_intdigest(raw, 2))
                keys.append(bands(signature(s, ranks)) if len(s) else np.empty(0, np.int64))
                drawn.append(sketch(s))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            hashes = [pa.array(np.array(x, _U).view(np.int64)) for x in (first, second)]
            words_ = [pa.array(c) for c in np.array(drawn, np.int64).reshape(-1, SKETCH).T]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *hashes, lists, *words_],
                                             ["doc_id", "n_shingles", "set_a", "set_b", "buckets", *_BITS])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _SET)


def _common(pairs: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """For pairs of ``a`` and ``b``: the sizes of their sets and of what these share, counted on whole texts.

    Only texts of documents in a pair move.  Texts follow the pairs in two
    joins on ids.  ``pairs`` is a written table, and the side that may be in many
    pairs comes first: Spark deals out large keys of a join of two tables.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = kept(documents.select("doc_id", whole_text().alias("text")).join(nodes, "doc_id", "left_semi"), "near-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").cast("binary").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").cast("binary").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, known = Words(), None, None
        for batch in batches:
            rows = []
            for a, b, left_, right_ in zip(*batch.columns):
                a, b, x, y = a.as_py(), b.as_py(), left_.as_py(), right_.as_py()
                if x != last:
                    last, known = x, shingles(x, words, width)
                other = shingles(y, words, width)
                rows.append((a, b, len(known), len(other), len(np.intersect1d(known, other, assume_unique=True))))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "size_a", "size_b", "both"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, size_a long, size_b long, both long")


def _links(common: DataFrame) -> DataFrame:
    return common.filter(f"100 * both >= {PERCENT} * (size_a + size_b - both)").select("a", "b")


def _may_link(left: str, right: str) -> str:
    """What the sizes and sketches of two sets must fulfil; prefixes name the columns of each."""
    few = f"{left}n_shingles + {right}n_shingles"
    differ = " + ".join(f"bit_count({left}{b} ^ {right}{b})" for b in _BITS)
    return (f"100 * least({left}n_shingles, {right}n_shingles) >= {PERCENT} * greatest({left}n_shingles, {right}n_shingles)"
            f" AND {100 + PERCENT} * ({differ}) <= {100 - PERCENT} * ({few})")


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in rows.columns])


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of ``a`` and ``b`` that sizes and sketches don't rule out."""
    return pairs.join(_named(sketches, "a_"), F.col("a") == F.col("a_doc_id")).join(
        _named(sketches, "b_"), F.col("b") == F.col("b_doc_id")).filter(_may_link("a_", "b_")).select("a", "b").distinct()


def near_components(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row's ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id that links reach."""
    small_batches(documents.sparkSession)
    sets = kept(signatures(documents, width), "signatures")
    real = sets.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = kept(real.groupBy(F.col("set_a").alias("_a"), F.col("set_b").alias("_b")).agg(
        F.min("doc_id").alias("class")), "classes")
    # One document stands for each class; its copies are linked to it at the end.
    first = real.join(classes.select(F.col("class").alias("doc_id"), F.col("_a").alias("set_a"),
                                     F.col("_b").alias("set_b")), ["doc_id", "set_a", "set_b"], "left_semi")
    first = kept(first, "class-sets")
    entries = kept(first.select("doc_id", F.explode("buckets").alias("bucket")).distinct(), "buckets")
    stars = entries.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_m")).filter("a < _m").drop("_m")
    starred = kept(entries.join(kept(stars, "stars"), "bucket").select("bucket", "a", F.col("doc_id").alias("b")), "starred")
    sketches = first.select("doc_id", "n_shingles", *_BITS)
    edges = kept(starred.filter("a < b").select("a", "b").distinct(), "edges")
    links = kept(_links(_common(kept(_promising(edges, sketches), "pairs"), documents, width)), "near-links")
    members = _open_members(starred, components(links))
    hidden = kept(_hidden(_shingle_rows(documents, members, width)), "hidden")
    rest = kept(_promising(hidden, sketches), "rest")
    links = links.unionByName(kept(_links(_common(rest, documents, width)), "more-links"))
    same = real.join(classes.select(F.col("_a").alias("set_a"), F.col("_b").alias("set_b"), "class"), ["set_a", "set_b"])
    copies = same.filter(F.col("class") != F.col("doc_id")).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(copies))
    return sets.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _open_members(starred: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id`` and ``component`` of all in buckets of three or more that lie in several components."""
    known = kept(starred.select("bucket", "b").join(found, F.col("b") == F.col("node"), "left").select(
        "bucket", F.col("b").alias("doc_id"), F.coalesce("component", "b").alias("component")), "known")
    open_ = known.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"),
                                        F.count(F.lit(1)).alias("_n")).filter("_low < _high AND _n > 2").select("bucket")
    return kept(known.join(kept(open_, "open-buckets"), "bucket", "left_semi").select("doc_id", "component").distinct(),
                "open-members")


def _shingle_rows(documents: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """A row for each shingle of the members' sets, named by ``doc_id`` and a hash of the set, with its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for doc_id, component, text in zip(*batch.columns):
                s = shingles(text.as_py(), words, width)
                same = [doc_id.as_py(), component.as_py(), xxhash.xxh3_64_intdigest(s.tobytes(), 1) - (1 << 63), len(s)]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(s), v, np.int64)) for v in same], pa.array(s.view(np.int64))],
                                                 ["doc_id", "component", "set", "n", "shingle"])

    texts = documents.select("doc_id", whole_text().cast("binary").alias("text")).join(members, "doc_id")
    return texts.select("doc_id", "component", "text").mapInArrow(
        run, "doc_id long, component long, set long, n long, shingle long")


def _hidden(rows: DataFrame) -> DataFrame:
    """Pairs of documents whose sets, given shingle by shingle, may be linked although their components differ so far.

    Linked sets of ``n`` and ``m >= n`` shingles share at least ``PERCENT / (100 + PERCENT)``
    of ``n + m``, so in any common order they share one among the first places counted
    below.  A shingle that only one component has there joins nothing.  Elsewhere one side
    of a pair lies outside the shingle's first component, which in a large group of near
    copies is the component of nearly all.
    """
    rows = kept(rows, "shingles")
    often = kept(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "often")
    order = Window.partitionBy("doc_id", "set").orderBy("often", "shingle")
    placed = rows.join(often, "shingle").withColumn("place", F.dense_rank().over(order))  # rows of equal sets share places
    ahead = kept(placed.filter(f"often > 1 AND place <= n - ({PERCENT} * n + 99) div 100 + 1").drop("often"), "ahead")
    shared = ahead.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("_high")).filter("low < _high")
    ahead = kept(ahead.join(kept(shared.drop("_high"), "shared"), "shingle"), "meeting")
    small = _named(ahead.filter(f"place <= n - ({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT} + 1"), "a_")
    large = _named(ahead, "b_")
    fits = F.expr(f"""a_shingle = b_shingle AND a_component <> b_component
        AND (a_n < b_n OR a_n = b_n AND a_doc_id < b_doc_id) AND 100 * a_n >= {PERCENT} * b_n
        AND {100 + PERCENT} * (least(a_n - a_place, b_n - b_place) + 1) >= {PERCENT} * (a_n + b_n)""")
    pairs = small.filter("a_component <> a_low").join(large, fits).unionByName(
        small.filter("a_component = a_low").join(large.filter("b_component <> b_low"), fits))
    return pairs.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def single_rows(documents: DataFrame) -> DataFrame:
    """The documents without rows that come again: of equal doc_id and text one stays, of equal texts no more without doc_id.

    Which one follows from a hash of all columns; rows that have equal ones are interchangeable.  Only
    keys of rows are counted, and texts that come again are merged before they move.
    """
    key = F.sha2(whole_text(), 256)
    keys = documents.select(F.col("doc_id").alias("_id"), key.alias("_key"), whole_text().rlike(r"[^\x20\x09-\x0D]").alias("_some"))
    groups = keys.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_n"), F.first("_some").alias("_some"))
    many = groups.filter("_id IS NOT NULL AND _n > 1 OR _id IS NULL AND _some")
    many = kept(many.withColumn("_repeated", F.lit(True)).drop("_n", "_some"), "repeated-rows")
    if many.isEmpty():
        return documents
    owned = kept(keys.join(many.filter("_id IS NULL").select("_key"), "_key", "left_semi").filter("_id IS NOT NULL").select(
        "_key").distinct(), "owned-texts")
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), key.alias("_text"))
    named = rows.join(many, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    once = named.filter("_repeated IS NULL").select("_row")
    again = named.filter("_repeated").groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    lone = again.filter("_id IS NULL").join(owned, "_key", "left_anti").select("_row")
    return once.unionByName(again.filter("_id IS NOT NULL").select("_row")).unionByName(lone).select("_row.*")


def without_near_copies(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without those that a link, or several, lead to one with a smaller doc_id; all columns."""
    found = near_components(documents, width)
    copies = kept(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct(), "near-copies")
    single = single_rows(documents)
    return single.join(copies, single["doc_id"] == copies["_copy"], "left_anti")


NEAR_SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM parts),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b
    ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ l ON l.a = r.other),
found AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)"""
