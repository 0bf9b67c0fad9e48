"""Failing sources kept up to date as run records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldscope.operators.health import failing_sources, last_n_runs
from fieldscope.settings import FAILURE_STREAK
from fieldscope.sources.tables import read_table, remove
from fieldscope.streaming.sweep import per_batch, with_batch_id


def failure_stream(runs: DataFrame, table: str, checkpoint: str, streak: int = FAILURE_STREAK,
                   tiebreak: str | None = None) -> StreamingQuery:
    """Keep, per batch, the last ``streak`` runs of every source.

    The latest runs of the previous batch merged with those of the new one are
    all that the next result depends on, so a batch never reads the whole log.
    """
    schema = with_batch_id(runs.schema)

    def action(batch: DataFrame, batch_id: int) -> None:
        stored = read_table(batch.sparkSession, table, schema)
        carried = stored.filter(F.col("batch_id") == batch_id - 1).drop("batch_id")
        latest = last_n_runs(carried.unionByName(batch), streak, tiebreak).drop("recency")
        latest.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch_id={batch_id}")
        # A batch that is run again needs the one before it, and nothing needs older ones.
        remove(batch.sparkSession, f"{table.rstrip('/')}/batch_id={batch_id - 2}")

    return per_batch(runs, checkpoint, action)


def current_failures(spark, table: str, schema, streak: int = FAILURE_STREAK,
                     tiebreak: str | None = None) -> DataFrame:
    """Failing sources as of the newest batch."""
    stored = read_table(spark, table, with_batch_id(schema))
    newest = stored.select(F.max("batch_id")).scalar()
    return failing_sources(stored.filter(F.col("batch_id") == newest), streak, tiebreak)
