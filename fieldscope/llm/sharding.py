"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash.  A bucket that is
larger than the limit is split on one more bit; the others stay as they are,
so a shard is the shallowest prefix whose rows fit.

The bits come in three levels of 60: from the key, from the key and the text,
and from a number that is drawn once for each row.  So a key that holds a third
of all rows is split as well, and so are rows that repeat.

* NULL keys are one key of their own; a NULL text has 0 bytes.
* A single row above the limit has a shard of its own.
* Repeated rows count each time.  Without rows there are no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.llm.common import new_folder, whole_text

LEVEL_BITS = 60
ALL_BITS = 3 * LEVEL_BITS
# One round splits on this many bits more than an even split would need, and on no more than MOST_BITS.
SPARE_BITS = 3
MOST_BITS = 24


def _bits(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as zeros and ones."""
    number = F.conv(F.substring(F.md5(text), 1, LEVEL_BITS // 4), 16, 10).cast("long")
    return F.lpad(F.bin(number), LEVEL_BITS, "0")


def _directory(rows: DataFrame, known: int, depth: int, limit: int) -> DataFrame:
    """One row per cell (prefix of ``depth`` bits) with its shard: the shallowest prefix of over ``known`` bits or
    as many that fits.  ``shard`` is NULL where even the cell is too large."""
    cells = rows.groupBy(F.substring("_bits", 1, depth).alias("cell")).agg(
        F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    up = cells.withColumn("_depth", F.explode(F.sequence(F.lit(known), F.lit(depth)))).withColumn(
        "_prefix", F.expr("substring(cell, 1, _depth)"))
    fitting = up.groupBy("_depth", "_prefix").agg(
        F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows")).filter(
        (F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
    found = up.join(fitting, ["_depth", "_prefix"]).groupBy("cell").agg(
        F.min(F.struct("_depth", "_prefix", "shard_bytes", "shard_rows")).alias("_s"))
    return cells.select("cell").join(found, "cell", "left").select(
        "cell", F.col("_s._prefix").alias("shard"), F.col("_s._depth").alias("depth"), "_s.shard_bytes", "_s.shard_rows")


def shards(df: DataFrame, key: str, limit_bytes: int, carry: list[str], text: str = "text") -> DataFrame:
    """The shard of each row: the columns of ``carry``, ``n_bytes``, ``shard`` (its bits), ``depth``, ``shard_bytes``
    and ``shard_rows``.

    Only narrow rows are written and shuffled.  The directory is a table: its
    size grows with the number of shards, and nothing of it is collected but
    one total and one count for each round.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "sharding")
    body, name = whole_text(text), F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    rows = df.select(*carry, F.octet_length(body).cast("long").alias("n_bytes"), F.concat(
        _bits(name), _bits(F.concat(name, F.lit("\0"), F.md5(body))),
        _bits(F.monotonically_increasing_id().cast("string"))).alias("_bits"))
    rows.write.parquet(f"{folder}/rows0")
    schema, known, done, turn = rows.schema, 0, [], 0
    while True:
        rows = spark.read.schema(schema).parquet(f"{folder}/rows{turn}")
        total = rows.agg(F.sum("n_bytes")).first()[0] or 0
        depth = min(ALL_BITS, known + min(MOST_BITS, SPARE_BITS + (total // limit_bytes).bit_length()))
        directory = _directory(rows, known, depth, limit_bytes)
        directory.write.parquet(f"{folder}/directory{turn}")
        directory = spark.read.schema(directory.schema).parquet(f"{folder}/directory{turn}")
        placed = rows.join(directory, F.substring("_bits", 1, depth) == F.col("cell")).drop("cell")
        done.append(placed.filter("shard IS NOT NULL").drop("_bits"))
        if depth == ALL_BITS or directory.filter("shard IS NULL").isEmpty():
            break
        placed.filter("shard IS NULL").select(*schema.names).write.parquet(f"{folder}/rows{turn + 1}")
        known, turn = depth, turn + 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


LIMIT_BYTES = 16 << 20


def op10_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(documents, "doc_id", LIMIT_BYTES, ["doc_id"])


def sharding_sql(limit_bytes: int = LIMIT_BYTES) -> str:
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), {LEVEL_BITS}, '0') AS bits
  FROM documents),
prefixes AS (
  SELECT d, substr(bits, 1, d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM hashed, range(0, 31) AS depths(d) GROUP BY ALL),
placed AS (
  SELECT doc_id, n_bytes, prefix AS shard, d::INTEGER AS depth, shard_bytes, shard_rows,
         row_number() OVER (PARTITION BY doc_id ORDER BY d) AS place
  FROM hashed JOIN prefixes ON prefix = substr(bits, 1, d)
  WHERE shard_bytes <= {limit_bytes} OR shard_rows <= 1)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_rows FROM placed WHERE place = 1"""
