"""Incremental sweeps: new files in, unseen items out."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fieldscope.operators.groups import materialize
from fieldscope.operators.ingest import dedupe_first
from fieldscope.sources.keys import KeyStore
from fieldscope.sources.tables import read_table, remove


def read_stream(spark: SparkSession, path: str, schema, pattern: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder, also those yet to come; ``pattern`` is a glob
    on file names and ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_to_end(writer) -> StreamingQuery:
    """Process everything that is there, then stop: one sweep per call."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_end_in(spark: SparkSession, writer, partitions: int) -> StreamingQuery:
    """``run_to_end`` with shuffles, and a state, of so many partitions at most.  A query takes the settings of its session as
    it starts; a checkpoint that is there keeps its number."""
    key = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(int(usual), partitions)))
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, usual)
    query.awaitTermination()
    return query


def with_batch_id(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def per_batch(stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None],
              mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(action).outputMode(mode).option("checkpointLocation", checkpoint)
    return run_to_end(writer) if partitions is None else run_to_end_in(stream.sparkSession, writer, partitions)


def sweep_stream(stream: DataFrame, table: str, checkpoint: str, order) -> StreamingQuery:
    """Append unseen rows of a stream of items to ``table``.

    Every micro-batch owns one folder and overwrites it, and compares only with
    folders of earlier batches, so a batch that is run again after a failure
    writes the same rows once.
    """
    schema = with_batch_id(stream.schema)

    def action(batch: DataFrame, batch_id: int) -> None:
        stored = read_table(batch.sparkSession, table, schema).filter(F.col("batch_id") < batch_id)
        fresh = dedupe_first(batch, order).join(stored.select("id"), "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch_id={batch_id}")

    return per_batch(stream, checkpoint, action)


def sweep_indexed(stream: DataFrame, table: str, checkpoint: str, order, keys: KeyStore, time: str | None = None,
                  look_back: str | None = None, arrived: Column | None = None) -> StreamingQuery:
    """Append unseen rows of a stream of items to ``table``, compared with an index of its ids instead of with the table.

    As in ``sweep_stream`` a micro-batch owns one folder and may run again.  The ids that it stores are added to ``keys`` under
    its number, with the month of ``time``.  ``look_back`` puts ``dedupe_recent`` before that, so that what is delivered again soon
    is stopped by a bounded state, and the index is asked only for the rest.

    The state has as many partitions as the index has buckets, or fewer: each is a file to write in every micro-batch, and
    rows meet the buckets where the state leaves them.
    """
    if look_back is not None:
        stream = dedupe_recent(stream, ["id"], look_back, arrived)
    month = F.date_format(F.col(time), "yyyy-MM") if time else F.lit("")

    def action(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{table.rstrip('/')}/batch_id={batch_id}"
        known = keys.of(spark)
        known.merge(before=batch_id)
        batch.persist()  # the look-up reads it twice, and would run the state twice
        try:
            batch.count()  # all of it at once, as a look-up begins with one partition
            known.without_known(dedupe_first(batch, order), before=batch_id).write.mode("overwrite").parquet(folder)
        finally:
            batch.unpersist()
        known.add(spark.read.schema(batch.schema).parquet(folder).select("id", month.alias("month")), batch_id)

    return per_batch(stream, checkpoint, action, partitions=keys.buckets)


ARRIVED = "_arrived"


def dedupe_recent(stream: DataFrame, keys, look_back: str = "7 days", arrived: Column | None = None) -> DataFrame:
    """First delivery of each key within ``look_back`` of its arrival; the state holds the keys of that time and no others.

    Time is when a row arrives, by default that of its micro-batch, not when it was published: so a row that was published
    long ago is late for nothing and comes out.  A key that is delivered again after the look-back comes out again; a sink
    that must not have it twice looks it up among what it has stored (``sweep_indexed``).
    """
    stamped = stream.withColumn(ARRIVED, F.current_timestamp() if arrived is None else arrived)
    return stamped.withWatermark(ARRIVED, look_back).dropDuplicatesWithinWatermark(list(keys)).drop(ARRIVED)


def dedupe_stream(stream: DataFrame, keys) -> DataFrame:
    """First delivery of each key, however late it comes and however files fall into batches.

    The state holds every key that was seen, as a late id may be a new one; use
    the RocksDB state store, which keeps it on disk.
    """
    return stream.dropDuplicates(list(keys))


def daily_counts(stream: DataFrame, time: str, keys) -> DataFrame:
    """Counts per UTC day, open days included, for a complete-mode sink (``write_complete``)."""
    day = F.to_date(F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()))
    return stream.groupBy(day.alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"))


def write_complete(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` at the whole result: one row per group, as of the newest batch."""
    def action(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return per_batch(counts, checkpoint, action, "complete")


def write_days(counts: DataFrame, table: str, checkpoint: str, keys) -> StreamingQuery:
    """Keep a table of ``daily_counts`` up to date, day by day.

    Only groups that changed come in.  Of the days that they are in, the new version is written beside the old one, which
    goes when the day changes next; files of other days are not touched, and a reader (``read_days``) always meets one whole
    version of every day.  A batch that is run again writes the same version again.
    """
    table = table.rstrip("/")

    def action(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = materialize(batch)
        days = [r["day"] for r in changed.select("day").distinct().collect()]  # of one micro-batch
        if not days:
            return
        before = _versions(spark, table, batch.schema).filter((F.col("version") < batch_id) & F.col("day").isin(days))
        kept = _newest(before).join(changed.select("day", *keys), ["day", *keys], "left_anti")
        new = kept.select(*batch.columns).unionByName(changed.select(*batch.columns)).withColumn("version", F.lit(batch_id))
        staged = materialize(new)  # whole before anything of the table changes
        (staged.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "version").parquet(table))
        old = before.select("day", "version").distinct().collect()
        newest = {day: max(r["version"] for r in old if r["day"] == day) for day in {r["day"] for r in old}}
        for r in old:
            if r["version"] < newest[r["day"]]:
                remove(spark, f"{table}/day={r['day']}/version={r['version']}")

    return per_batch(counts, checkpoint, action, "update")


def _versions(spark: SparkSession, table: str, schema) -> DataFrame:
    plain = [f for f in schema.fields if f.name != "day"]
    return read_table(spark, table, T.StructType([
        *plain, T.StructField("day", T.DateType()), T.StructField("version", T.LongType())]))


def _newest(versions: DataFrame) -> DataFrame:
    """The newest version of each day."""
    last = versions.groupBy(F.col("day").alias("_day")).agg(F.max("version").alias("_version"))
    return versions.join(last, (F.col("day").eqNullSafe(F.col("_day"))) & (F.col("version") == F.col("_version"))).drop("_day", "_version")


def read_days(spark: SparkSession, table: str, schema) -> DataFrame:
    """The counts that ``write_days`` keeps, as of its last finished version of each day."""
    return _newest(_versions(spark, table, schema)).drop("version")
