"""What several operators need: words, shared folders, and running sums without a hot task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The white space of every contract, and what is between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """The full URI of a folder of its own below the shared one, not there yet; it goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{store.makeQualified(path).toString()}/data"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session send at most so many rows at once to Python, where texts of any length are worked on.

    Spark counts rows, not bytes, and its default of 10,000 is meant for narrow
    ones; a smaller setting of the session is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, and safe from lost executors."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    """Words of a text that is not NULL."""
    bare = F.regexp_replace(text, f"^{SPACE}+", "")
    return F.when(bare == "", F.lit(0)).otherwise(
        F.size(F.split(F.regexp_replace(bare, f"{SPACE}+$", ""), f"{SPACE}+"))).cast("long")


def slice_bits(largest: int, rows: int = 256, most: int = 14) -> int:
    """Bits of a hash that cut a group of ``largest`` rows into slices of about ``rows``, but never into over 2**most."""
    return min(most, max(0, (max(largest, 1) // rows).bit_length()))


def running_sum(df: DataFrame, keys: list[str], part: str, order: list, value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in its group.

    ``part`` numbers slices of a group in the order of ``order``, so a group
    of any size is sorted slice by slice in many tasks; only the sums of its
    slices meet in one.  ``df`` is read twice: it should be a written table.
    """
    named = [f"_key{i}" for i in range(len(keys))]
    sums = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col(part).alias("_part")).agg(
        F.sum(value).alias("_sum"))
    before = Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*named, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col(part) == F.col("_part")
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(within), F.lit(0))
    return df.join(sums, same).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before", *named)
