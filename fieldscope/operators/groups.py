"""First rows per group, and row numbers over a global order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_SALTS = 64
# Every map task sends up to n rows of a hot group to the one task that ends it.
_SPREAD_ABOVE = 100


def _spread_above(spark: SparkSession) -> int:
    return min(_SPREAD_ABOVE, int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")))


def _ranked(df: DataFrame, keys, order, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def first_per_group(df: DataFrame, keys, order, n: int, rank: str | None = None, spread=None) -> DataFrame:
    """The first ``n`` rows of each group under a total order.

    For small ``n`` Spark cuts each group to ``n`` rows inside every map task,
    before the shuffle, so a group holding most of the rows stays cheap.  For
    larger ``n``, and beyond Spark's threshold for that cut, the first ``n`` of
    each salted slice of a group are taken before the first ``n`` of the whole.
    Slices are hashed from the ``spread`` columns, by default those of ``order``.
    """
    if n > _spread_above(df.sparkSession):
        slice_of = F.pmod(F.xxhash64(*(spread or order)), F.lit(_SALTS))
        sliced = df.withColumn("_slice", slice_of)
        df = _ranked(sliced, [*keys, "_slice"], order, n).drop("_slice", "_rank")
    ranked = _ranked(df, keys, order, n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first under ``order``, which must be total."""
    return first_per_group(df, keys, order, 1)


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that driver and executors share: below ``spark.checkpoint.dir``, or where that is
    unset below the warehouse.  It goes when the driver ends.

    A warehouse on the driver's own disk is shared with no other machine, so on a cluster it is refused.
    """
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    base = chosen or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/fieldscope-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not chosen and store.getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder, and the warehouse is on this machine's disk")
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{store.makeQualified(path).toString()}/data"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and whole when an executor is lost.

    The folder goes when the driver ends, or before that by ``sources.tables.remove``.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered_newest_first(df: DataFrame, at: Column, key: str, name: str = "rn") -> DataFrame:
    """Number all rows 1..N by ``at``, newest first and NULL last, then by the hexadecimal ``key``.

    Buckets follow from the row itself: its day, its minute, then its time with
    the first digits of its key, which are uniform and in order.  Counts of
    buckets are summed up level by level, and rows are sorted inside a bucket
    alone, so neither a busy day nor one time for all rows meets in one task.
    """
    rows = df.withColumn("_at", at).withColumn("_digits", F.substring(key, 1, 3))
    levels = {"_day": F.to_date("_at"), "_minute": F.date_trunc("minute", "_at")}
    counts = rows.groupBy("_at", "_digits").agg(F.count(F.lit(1)).alias("_n")).withColumns(levels)
    preceding = (Window.unboundedPreceding, -1)

    def before(table: DataFrame, within: list[str], order: list, total: str) -> Column:
        return F.coalesce(F.sum(total).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(*preceding)), F.lit(0))

    newest = lambda c: F.col(c).desc_nulls_last()
    minutes = counts.groupBy("_day", "_minute").agg(F.sum("_n").alias("_n"))
    # One row per day is all that a single task orders.
    days = minutes.groupBy("_day").agg(F.sum("_n").alias("_n"))
    days = days.select(F.col("_day").alias("_d"), before(days, [], [newest("_day")], "_n").alias("_before_day"))
    minutes = minutes.select(F.col("_minute").alias("_m"), F.col("_day").alias("_md"),
                             before(minutes, ["_day"], [newest("_minute")], "_n").alias("_before_minute"))
    buckets = counts.withColumn("_before_bucket", before(counts, ["_minute"], [newest("_at"), F.col("_digits")], "_n"))
    buckets = (buckets.join(minutes, F.col("_minute").eqNullSafe(F.col("_m"))).join(days, F.col("_day").eqNullSafe(F.col("_d")))
               .select(F.col("_at").alias("_time"), F.col("_digits").alias("_first"),
                       (F.col("_before_day") + F.col("_before_minute") + F.col("_before_bucket")).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_at", "_digits").orderBy(key))
    same = F.col("_at").eqNullSafe(F.col("_time")) & (F.col("_digits") == F.col("_first"))
    return rows.join(buckets, same).withColumn(name, F.col("_before") + inside).drop(
        "_at", "_digits", "_time", "_first", "_before")
