"""Source health from the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldscope.operators.groups import first_per_group
from fieldscope.settings import FAILURE_STREAK


def last_n_runs(runs: DataFrame, n: int = FAILURE_STREAK, tiebreak: str | None = None) -> DataFrame:
    """The latest ``n`` runs of every source, numbered from the newest."""
    columns = ["run_at", tiebreak] if tiebreak else ["run_at"]
    newest = [F.col(c).desc() for c in columns]
    return first_per_group(runs, ["source"], newest, n, rank="recency", spread=columns)


def failing_sources(runs: DataFrame, streak: int = FAILURE_STREAK, tiebreak: str | None = None) -> DataFrame:
    """Sources whose last ``streak`` runs exist and all failed."""
    return (last_n_runs(runs, streak, tiebreak).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n"), F.max("ok").alias("best"))
            .filter((F.col("n") >= streak) & (F.col("best") == 0)).select("source"))
