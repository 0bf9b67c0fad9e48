"""Exact similarity joins: titles with nearly the same words, names within a few edits.

Both follow the same plan.  A record is a set of tokens, and two records can only be similar
if they share many of them.  With tokens ordered from rare to common, such records share one
already among the first few of each, the prefix; how many that is follows from the
threshold.  So records meet on prefix tokens alone, pairs whose sizes or places in
the prefix rule them out never become rows, and the rest is verified on the whole records.

Equal records are one class before anything is joined, so copies, however many, cost and
yield one row each.  Tables that are joined on a token are written first, which lets Spark
deal a frequent token out to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import let
from fieldscope.functions.text import title_key
from fieldscope.operators.groups import materialize

PERCENT = 80
GRAM = 2
_PAD = "\x1f"  # no title key has it


def _rarest_first(records: DataFrame, key: str, tokens: str) -> DataFrame:
    """Each record's ``key``, ``size`` and ``ordered``: its tokens with their numbers of records, rare ones first."""
    listed = materialize(records.select(F.col(key).alias("key"), F.size(tokens).alias("size"), F.explode(tokens).alias("token")))
    known = materialize(listed.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("_n")))
    return listed.join(known, F.col("token") == F.col("_token")).groupBy("key", "size").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "token"))).alias("ordered"))


def _prefixes(ordered: DataFrame, length: Column, carry: list[str]) -> DataFrame:
    """A row for each of a record's first tokens with its place; a token of one record meets no other."""
    first = ordered.select("key", "size", *carry, F.posexplode(F.slice("ordered", F.lit(1), length)).alias("place", "_t"))
    return materialize(first.filter("_t.n > 1").select("key", "size", *carry, "place", F.col("_t.token").alias("token")))


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns])


# --- titles --------------------------------------------------------------------

def title_classes(items: DataFrame, title: str = "title", id_col: str = "id") -> DataFrame:
    """Each item's ``id`` and ``class_key``, which names the set of its title's words; titles without words are in no class."""
    words = F.sort_array(F.array_distinct(F.split(title_key(F.col(title)), " ")))
    return items.select(F.col(id_col).alias("id"), F.array_join(words, " ").alias("class_key")).filter("class_key <> ''")


def similar_titles(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes of ``title_classes`` that share at least ``percent`` of the words of both together.

    ``class_a`` < ``class_b`` are the smallest ids of the two classes, with ``shared`` and ``together``, the sizes of their
    words' intersection and union.  Every such pair is there.
    """
    classes = materialize(members.groupBy("class_key").agg(F.min("id").alias("first_id")).select(
        F.unhex(F.sha2("class_key", 256)).alias("key"), "first_id", F.split("class_key", " ").alias("words")))
    ordered = _rarest_first(classes, "key", "words")
    # All words but the last ceil(percent of them) - 1: two sets that share as many have one of these in common.
    entries = _prefixes(ordered, F.expr(f"size - ({percent} * size + 99) div 100 + 1"), [])
    least = f"({percent} * (a_size + b_size) + {100 + percent - 1}) div {100 + percent}"
    pairs = _sided(entries, "a").join(_sided(entries, "b"), F.expr(
        f"a_token = b_token AND a_key < b_key AND 100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)"
        # Of words in one order, those after this one are all that can still be shared; the first shared one passes.
        f" AND least(a_size - a_place, b_size - b_place) >= {least}"))
    pairs = materialize(pairs.select("a_key", "b_key").distinct())
    sides = pairs.join(_sided(classes, "a"), "a_key").join(_sided(classes, "b"), "b_key")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    found = sides.withColumn("shared", shared).withColumn("together", F.size("a_words") + F.size("b_words") - F.col("shared"))
    return found.filter(100 * F.col("shared") >= percent * F.col("together")).select(
        F.least("a_first_id", "b_first_id").alias("class_a"), F.greatest("a_first_id", "b_first_id").alias("class_b"), "shared", "together")


def title_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per item with a title: its class, how many items are in that, and with how many other classes it is linked."""
    # The words' hash stands for them, as in similar_titles, so that they are not shuffled with each item.
    hashed = members.select("id", F.unhex(F.sha2("class_key", 256)).alias("_item_key"))
    classes = materialize(hashed.groupBy(F.col("_item_key").alias("_key")).agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_same")))
    links = materialize(pairs.select(F.explode(F.array("class_a", "class_b")).alias("_class")).groupBy("_class").agg(
        F.count(F.lit(1)).alias("_links")))
    known = classes.join(links, F.col("class_id") == F.col("_class"), "left").select(
        "_key", "class_id", "n_same", F.coalesce("_links", F.lit(0)).alias("n_links"))
    return hashed.join(materialize(known), F.col("_item_key") == F.col("_key")).select("id", "class_id", "n_same", "n_links")


# --- names ---------------------------------------------------------------------

def _grams(text: Column) -> Column:
    """The GRAM-grams of a padded text, each with its number among equal ones, so that a text is a set of them."""
    pad = F.lit(_PAD * (GRAM - 1))
    made = let(F.split(F.concat(pad, text, pad), ""), lambda letters: F.transform(
        F.sequence(F.lit(1), F.size(letters) - GRAM + 1), lambda i: F.array_join(F.slice(letters, i, F.lit(GRAM)), "")))
    return let(F.sort_array(made), lambda grams: F.transform(
        grams, lambda g, i: F.concat(g, (i - F.array_position(grams, g) + 1).cast("string"))))


def name_index(names: DataFrame, edits: int = 2) -> DataFrame:
    """The inverted index of a registry's distinct ``key``s: for each of a key's rarest grams a row of ``token``, its number of
    keys ``n``, and ``key``; all keys' grams are counted, so that any name can be looked up.

    It is a written table that lookups of at most ``edits`` edits share.
    """
    keys = materialize(names.select("key").distinct())
    listed = materialize(keys.select("key", F.explode(_grams(F.col("key"))).alias("token")))
    counts = materialize(listed.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    known = listed.join(counts.select(F.col("token").alias("_token"), "n"), F.col("token") == F.col("_token"))
    rare = known.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "token"))), 1, GRAM * edits + 1).alias("first"))
    entries = rare.select("key", F.explode("first").alias("t")).select("key", "t.token", F.lit(True).alias("entry"), F.lit(0).alias("n"))
    # A count stands beside the entries of its gram, as grams that no key has among its rarest matter for the order too.
    return materialize(entries.unionByName(counts.select(F.lit(None).cast("string").alias("key"), "token", F.lit(False).alias("entry"), "n")))


def near_names(index: DataFrame, names: DataFrame, wanted: DataFrame, edits: int = 2) -> DataFrame:
    """Every pair of a key of ``wanted`` and one of ``names`` at most ``edits`` edits apart: ``wanted_key``, ``key``, ``distance``.

    An edit touches at most GRAM of a name's grams, so of the GRAM * edits + 1 rarest grams of two such names one is
    shared.  Where both have no more than GRAM * edits grams, none need be; such names, of a few letters, are
    compared by length.
    """
    asked = materialize(wanted.select(F.col("key").alias("wanted_key")).distinct())
    listed = asked.select("wanted_key", F.explode(_grams(F.col("wanted_key"))).alias("token"))
    counts = index.filter("NOT entry").select(F.col("token").alias("_token"), "n")
    known = listed.join(counts, F.col("token") == F.col("_token"), "left")
    rare = known.groupBy("wanted_key").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))), 1, GRAM * edits + 1).alias("first"))
    probes = materialize(rare.select("wanted_key", F.explode("first.token").alias("_probe")))
    entries = index.filter("entry").select("key", "token")
    near = F.abs(F.length("key") - F.length("wanted_key")) <= edits
    met = entries.join(probes, (F.col("token") == F.col("_probe")) & near).select("wanted_key", "key")
    few = GRAM * edits - GRAM + 1  # letters of a name with GRAM * edits grams
    sizes = F.sequence(F.greatest(F.lit(0), F.length("wanted_key") - edits), F.least(F.lit(few), F.length("wanted_key") + edits))
    short = asked.filter(F.length("wanted_key") <= few).select("wanted_key", F.explode(sizes).alias("_size"))
    tiny = names.select("key").filter(F.length("key") <= few).distinct().join(short, F.length("key") == F.col("_size")).select("wanted_key", "key")
    pairs = met.unionByName(tiny).distinct()
    return pairs.withColumn("distance", F.levenshtein("key", "wanted_key", edits)).filter("distance >= 0")
