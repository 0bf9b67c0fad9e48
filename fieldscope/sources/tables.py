"""Append-only tables and report sinks on shared storage."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from fieldscope.functions.columns import ago, moment
from fieldscope.operators.groups import materialize, shared_folder
from fieldscope.operators.ingest import COLLECTION_ORDER, conform, dedupe_first, latest_value, upsert_new
from fieldscope.operators.retention import keeps_item
from fieldscope.operators.scoring import apply_scores_once
from fieldscope.schemas import ITEM, META, RUN, SCORE
from fieldscope.sources.keys import KeyStore

# Items as stored: month folders of their effective date.
_ITEM_FILES = T.StructType([*ITEM.fields, T.StructField("month", T.StringType())])


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table under a fixed schema; columns an older file lacks are
    NULL, and a table that does not exist yet is empty."""
    try:
        return conform(spark.read.schema(schema).parquet(path), schema)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_items(spark: SparkSession, path: str, effective_since=None) -> DataFrame:
    """Stored items; with a bound on the effective date, older month folders are
    not opened."""
    items = spark.read.schema(_ITEM_FILES).parquet(path)
    if effective_since is not None:
        items = items.filter(_from_month(effective_since))
    return conform(items, ITEM)


def _from_month(since) -> Column:
    return F.col("month") >= F.date_format(moment(since), "yyyy-MM")


def append_items(batch: DataFrame, path: str, fetched_at, order=COLLECTION_ORDER, known_since=None, keys: KeyStore | None = None) -> int:
    """Insert unseen items, partitioned by month of the effective date; returns
    how many were new, counted by the write itself.

    Only stored ids are read.  ``known_since`` bounds them to months from a date
    on, for sources that never deliver what is older than their look-back.  With
    ``keys`` the items are not read at all, only their index is; should a sweep fail
    between the two, ``keys.catch_up(stored_ids(...))`` adds what the index lacks.
    """
    if keys is not None:
        return _append_indexed(batch, path, fetched_at, order, known_since, keys)
    spark = batch.sparkSession
    existing = read_table(spark, path, _ITEM_FILES)
    if known_since is not None:
        existing = existing.filter(_from_month(known_since))
    new = conform(upsert_new(batch, existing, order))
    new = new.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(fetched_at).cast("timestamp")))
    seen = Observation()
    _by_month(new.observe(seen, F.count(F.lit(1)).alias("n"))).write.mode("append").partitionBy("month").parquet(path)
    return _observed_count(seen)


def _append_indexed(batch: DataFrame, path: str, fetched_at, order, known_since, keys: KeyStore) -> int:
    keys.merge()
    new = conform(keys.without_known(dedupe_first(batch, order), since=known_since))
    # Written once, as items and ids both come from it.
    new = materialize(new.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(fetched_at).cast("timestamp"))))
    _by_month(new).write.mode("append").partitionBy("month").parquet(path)
    keys.add(new.select("id", _month().alias("month")), keys.next_run())
    return new.count()


def stored_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of stored items with their months."""
    return spark.read.schema(_ITEM_FILES).parquet(path).select("id", "month")


def _month() -> Column:
    return F.date_format(F.coalesce(F.col("published_at").cast("timestamp"), F.col("fetched_at")), "yyyy-MM")


def _by_month(items: DataFrame) -> DataFrame:
    """Items with the month of their effective date, dealt out by it; rebalancing splits a month that outgrows one
    file instead of sending it to one task."""
    return items.withColumn("month", _month()).hint("rebalance", "month")


def _observed_count(seen: Observation) -> int:
    """The count a write observed.  A plan found to be empty at run time is
    replaced as a whole, observation included; its row then has no fields, which
    an assertion reports.  Any other failure is one."""
    try:
        return seen.get["n"]
    except Py4JJavaError as failure:
        if failure.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return 0


def append_scores(results: DataFrame, path: str, order) -> None:
    existing = read_table(results.sparkSession, path, SCORE)
    new = apply_scores_once(results, existing, order)
    conform(new, SCORE).write.mode("append").parquet(path)


def append_runs(records: DataFrame, path: str, run_at) -> None:
    """Run log, partitioned by day so that retention drops whole partitions."""
    stamped = records.withColumn("run_at", F.lit(run_at).cast("timestamp"))
    (conform(stamped, RUN).withColumn("run_date", F.to_date("run_at"))
     .write.mode("append").partitionBy("run_date").parquet(path))


def put_meta(spark: SparkSession, path: str, key: str, value: str, ts) -> None:
    row = spark.createDataFrame([(key, str(value), str(ts))], "key string, value string, ts string")
    conform(row, META).write.mode("append").parquet(path)


def advance_marks(run_log: DataFrame, marks: dict[str, str], path: str, ts) -> None:
    """Move the high-water mark of every source that succeeded, and of no other."""
    spark = run_log.sparkSession
    keys = spark.createDataFrame(list(marks.items()), "source string, key string")
    done = run_log.filter(F.col("ok") == 1).join(F.broadcast(keys), "source").select(
        "key", F.lit(str(ts)).alias("value"), F.lit(str(ts)).alias("ts"))
    conform(done, META).write.mode("append").parquet(path)


def get_meta(spark: SparkSession, path: str) -> DataFrame:
    """The last value of each key; of two writes at one time the larger value."""
    return latest_value(read_table(spark, path, META), "value")


def read_runs(spark: SparkSession, path: str, since=None) -> DataFrame:
    """The run log; with a bound, folders of earlier days are not opened."""
    schema = T.StructType([*RUN.fields, T.StructField("run_date", T.DateType())])
    runs = spark.read.schema(schema).parquet(path)
    if since is not None:
        at = moment(since)
        runs = runs.filter((F.col("run_date") >= F.to_date(at)) & (F.col("run_at") >= at))
    return conform(runs, RUN)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table or an intermediate one, if it is there."""
    store, found = _path(spark, path)
    store.delete(found, True)


def prune_run_table(spark: SparkSession, path: str, as_of, keep_days: int) -> list[str]:
    """Drop the days of the run log that lie before the cutoff's day; the names of their folders.

    The cutoff's own day stays whole; readers pass the bound to ``read_runs``.
    """
    first = spark.range(1).select(F.to_date(ago(as_of, days=keep_days)).cast("string")).first()[0]
    store, found = _path(spark, path)
    days = [s.getPath().getName() for s in store.listStatus(found)]
    old = sorted(d for d in days if d.startswith("run_date=") and d.removeprefix("run_date=") < first)
    for day in old:
        remove(spark, f"{path.rstrip('/')}/{day}")
    return old


def prune_item_table(spark: SparkSession, path: str, scores: DataFrame, threshold: int, as_of, keep_days: int) -> list[str]:
    """Take the rows that retention drops out of a stored table; the months it rewrote.

    Months in which nothing is dropped are not touched.  What the others keep is
    written to the shared folder first and then replaces them month by month, so
    no row exists in a failing job's memory alone.
    """
    items = spark.read.schema(_ITEM_FILES).parquet(path)
    scored = items.join(scores.select("id", "score"), "id", "left")
    kept = keeps_item(threshold, as_of, keep_days)
    months = [r["month"] for r in scored.filter(~kept).select("month").distinct().collect()]
    if not months:
        return []
    staging = shared_folder(spark)
    scored.filter(kept & F.col("month").isin(*months)).drop("score").write.partitionBy("month").parquet(staging)
    left = spark.read.schema(_ITEM_FILES).parquet(staging)
    (left.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(path))
    alive = {r["month"] for r in left.select("month").distinct().collect()}
    for month in set(months) - alive:
        remove(spark, f"{path.rstrip('/')}/month={month}")
    remove(spark, staging)
    return sorted(months)


def save_bucketed(df: DataFrame, table: str, buckets: int, mode: str = "append") -> None:
    """Append to a catalog table bucketed by item id.

    Items and scores bucketed alike meet bucket by bucket: the joins of a sweep
    (unseen, unscored, items with scores) then move neither table.
    """
    (df.repartition(buckets, "id").write.mode(mode).format("parquet")
     .bucketBy(buckets, "id").sortBy("id").saveAsTable(table))


def write_snapshot(kept: DataFrame, path: str) -> None:
    """Write the items that survive retention to a new folder in the shape of the
    items table; the old one stays valid until the reader is pointed here."""
    _by_month(conform(kept, ITEM)).write.mode("errorifexists").partitionBy("month").parquet(path)


def write_report(table: DataFrame, path: str, fmt: str = "parquet") -> None:
    table.write.mode("overwrite").format(fmt).save(path)
