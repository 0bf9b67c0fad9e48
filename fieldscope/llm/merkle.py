"""A Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

A level of an aligned block of BLOCK nodes is one string of hexadecimal digests.
Fixed-width substrings of it, FAN digests each, hash to the level above; the
substrings that flank a node in its run are its siblings.  A block's last digest is
a node of the next stage, where blocks of blocks are formed, until every group is
one node.  The sources' roots recurse as one more group.  On the way back each node
hands its path, the siblings of all levels above it, to the nodes of its block, so a
path costs no join per level and no row holds more than one block.

* A leaf digests doc_id, source, lang, n_chars and text: ``-`` for NULL, else the
  number of UTF-8 bytes, a colon and the value.  An empty text is ``0:``.
* Leaves of a source ascend by doc_id, NULL first, then by their digest.  Repeated
  rows are leaves of their own.  A NULL source is a source, and the first.
* A run of one node is hashed as well; a group of one node has no level above it.
* Other columns are ignored, whatever their names.  No documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldscope.functions.columns import let
from fieldscope.llm.common import kept

FAN = 3
DEPTH = 5
BLOCK = FAN ** DEPTH
DIGEST = 64  # hexadecimal digits
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left: string, right: string>>"


def leaf(*values: Column) -> Column:
    """The digest of a row; each value says how long it is, so no two rows share what is hashed."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, group: str, order: list[str], number: str, size: str) -> DataFrame:
    """Add each row's place in its group, from 0, and the group's size.

    Rows are dealt out by ranges of the whole order, so one group may fill many tasks; only counts of a group per range
    meet.  ``rows`` is a written table and its order total, or equal rows are interchangeable.
    """
    named = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    tasks = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = kept(rows.repartitionByRange(int(tasks), *named).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = ranges.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(group).alias("_group"), F.col("_range").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"),
                         F.sum("_n").over(own).alias(size))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*named[1:])) - 1
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part"))
    return ranges.withColumn("_inside", inside).join(parts, same).withColumn(number, F.col("_before") + F.col("_inside")).drop(
        "_inside", "_before", "_group", "_part", "_range")


def _parents(level: Column) -> Column:
    """The level above one: each FAN digests' own digest."""
    width = FAN * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _levels(members: Column, height: Column) -> Column:
    """The strings of a block's levels, from its nodes to the one at ``height``."""
    first = F.array_join(F.transform(members, lambda m: m["node"]), "")

    def grow(made: Column, at: Column) -> Column:
        return F.when(at > height, made).otherwise(F.concat(made, F.array(let(F.element_at(made, -1), _parents))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(first), grow)


def _segment(levels: Column, place: Column, height: Column) -> Column:
    """The siblings of the node at ``place`` on each level below ``height``, from its own run up."""
    widths = F.array(*[F.lit(FAN ** k) for k in range(DEPTH)])

    def siblings(level: Column, k: Column) -> Column:
        at = F.floor(place / widths[k]).cast("int")
        cut = F.substring(level, F.floor(at / FAN).cast("int") * (FAN * DIGEST) + 1, F.lit(FAN * DIGEST))
        mine = (at % FAN) * DIGEST
        return let(cut, lambda run: F.struct(F.substring(run, F.lit(1), mine).alias("left"),
                                             F.substring(run, mine + 1 + DIGEST, F.lit(FAN * DIGEST)).alias("right")))

    return F.transform(F.slice(levels, F.lit(1), height), siblings)


def blocks(nodes: DataFrame) -> DataFrame:
    """The blocks of a stage: nodes have ``group``, ``at``, ``size`` (of the group), ``node`` and ``key``, which a block carries along."""
    filled = nodes.groupBy("group", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), "size").agg(
        F.array_sort(F.collect_list(F.struct("at", "node", "key"))).alias("members"))
    height = F.coalesce(*[F.when(F.col("size") <= FAN ** at, F.lit(at)) for at in range(DEPTH)], F.lit(DEPTH))
    # Written here, so that strings and digests are made once for the way up and the way down.
    made = kept(filled.withColumn("height", height), "members")
    return kept(made.withColumn("levels", _levels(F.col("members"), F.col("height"))).withColumn(
        "top", F.element_at("levels", -1)), "levels")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The stages from the nodes to the one where each group is one block, whose ``top`` is the group's root."""
    stages = []
    while True:
        stages.append(blocks(nodes))
        most = stages[-1].agg(F.max("size")).first()[0] or 0
        if most <= BLOCK:
            return stages
        nodes = stages[-1].select("group", F.col("block").alias("at"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
                                  F.col("top").alias("node"), F.lit(None).cast(nodes.schema["key"].dataType).alias("key"))


def descend(stages: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Every node of the lowest stage: ``group``, ``key``, ``node``, ``path`` and what ``roots`` says of its group.

    ``roots`` has ``group``, ``path`` (the siblings above the group's root) and any other columns.
    """
    carried = [c for c in roots.columns if c not in ("group", "path")]
    above = roots.withColumn("at", F.lit(0).cast("long"))
    for stage in reversed(stages):
        up = above.select(F.col("group").alias("_group"), F.col("at").alias("_at"), F.col("path").alias("_path"), *carried)
        joined = stage.join(up, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_at")))
        own = F.transform("members", lambda m, i: F.struct(
            m["at"].alias("at"), m["key"].alias("key"), m["node"].alias("node"),
            _segment(F.col("levels"), i, F.col("height")).alias("own")))
        rows = joined.select("group", "_path", *carried, F.inline(own))
        above = rows.select("group", "at", "key", "node", F.concat("own", "_path").alias("path"), *carried)
    return above.drop("at")


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def manifest(leaves: DataFrame) -> DataFrame:
    """For each leaf its ``key``, ``node``, ``path`` to the ``root``, and its source's ``subroot``.

    ``leaves`` is a written table of ``group``, ``node``, ``key`` (of any kind) and ``order``, by which the nodes of a group ascend.
    """
    own = climb(numbered(leaves, "group", ["order", "node"], "at", "size"))
    subroots = kept(own[-1].select(F.lit(0).alias("group"), F.col("group").alias("order"), F.col("top").alias("node")), "subroots")
    # The source itself is the key by which the path of its root finds its leaves.
    top = climb(numbered(subroots, "group", ["order"], "at", "size").withColumn("key", F.col("order")).drop("order"))
    root = top[-1].select("group", F.lit(None).cast(_PATH).alias("path"), F.col("top").alias("root"))
    root = root.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    sources = kept(descend(top, root), "sources").select(
        F.col("key").alias("group"), "path", "root", F.col("node").alias("subroot"))
    return descend(own, sources)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = [F.col(c) for c in LEAF_COLUMNS]
    tampered = leaf(*whole[:-1], F.translate("text", "\n", ""))
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = kept(documents.select(
        F.col("source").alias("group"), F.col("doc_id").alias("order"), leaf(*whole).alias("node"),
        F.struct("doc_id", F.when(changed, tampered).alias("tampered")).alias("key")), "leaves")
    shown = manifest(leaves).select(
        F.col("key.doc_id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("key.tampered", "node"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


_FED = "SELECT doc_id, substr(rest, 3) AS rest, xor(c, ('0x' || substr(rest, 1, 2))::UBIGINT) AS c FROM crc WHERE rest <> ''"
for _ in range(8):
    _FED = f"SELECT doc_id, rest, xor(c >> 1, (c & 1) * 3988292384) AS c FROM ({_FED})"


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, LEAF_COLUMNS[:-1]), _field(text)]) + ")"


MERKLE_SQL = f"""
WITH RECURSIVE crc(doc_id, rest, c) AS (
  SELECT DISTINCT doc_id, hex(doc_id::VARCHAR), 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  {_FED}),
even AS (SELECT doc_id FROM crc WHERE rest = '' AND xor(c, 4294967295::UBIGINT) % 2 = 0),
leaves AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN {_leaf_sql("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1
  GROUP BY source, lvl, pos // 3, n),
subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
low AS (
  SELECT p.doc_id, p.source, p.pos AS leaf_at, t.lvl,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (3 ** t.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (3 ** t.lvl)::BIGINT), '') AS r
  FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.pos // 3 = (p.pos // (3 ** t.lvl)::BIGINT) // 3
  GROUP BY ALL),
high AS (
  SELECT s.source, t.lvl,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (3 ** t.lvl)::BIGINT), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (3 ** t.lvl)::BIGINT), '') AS r
  FROM subroots s JOIN top t ON t.n > 1 AND t.pos // 3 = (s.pos // (3 ** t.lvl)::BIGINT) // 3
  GROUP BY ALL),
paths AS (
  SELECT source, leaf_at, lvl, l, r FROM low
  UNION ALL
  SELECT p.source, p.pos, 1000 + h.lvl, h.l, h.r FROM placed p JOIN high h ON h.source IS NOT DISTINCT FROM p.source),
steps AS (
  SELECT source, leaf_at, l, r, row_number() OVER (PARTITION BY source, leaf_at ORDER BY lvl) AS step FROM paths),
proofs AS (SELECT source, leaf_at, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY ALL),
folding(source, pos, step, h) AS (
  SELECT source, pos, 1, coalesce(tampered, leaf) FROM placed
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(s.l || f.h || s.r)
  FROM folding f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.leaf_at = f.pos AND s.step = f.step),
folded AS (SELECT source, pos, arg_max(h, step) AS h FROM folding GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       f.h AS folded_root, f.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
JOIN folded f ON f.source IS NOT DISTINCT FROM p.source AND f.pos = p.pos
LEFT JOIN proofs q ON q.source IS NOT DISTINCT FROM p.source AND q.leaf_at = p.pos"""
