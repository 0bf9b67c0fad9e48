"""Retention as keep-filters; the kept rows form the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import ago, since
from fieldscope.settings import KEEP_ITEM_DAYS, KEEP_RUN_DAYS


def keeps_item(threshold: int, as_of, keep_days: int) -> Column:
    """Score at the threshold or better, or recent.  Unscored counts as below."""
    recent = since(F.col("published_at"), F.col("fetched_at"), ago(as_of, days=keep_days))
    return F.coalesce(F.col("score") >= threshold, F.lit(False)) | F.coalesce(recent, F.lit(True))


def prune_items(items: DataFrame, threshold: int, as_of, keep_days: int = KEEP_ITEM_DAYS) -> DataFrame:
    """Rows that survive; items with neither date are kept."""
    return items.filter(keeps_item(threshold, as_of, keep_days))


def prune_runs(runs: DataFrame, as_of, keep_days: int = KEEP_RUN_DAYS) -> DataFrame:
    cutoff = ago(as_of, days=keep_days)
    return runs.filter(F.col("run_at").isNull() | (F.col("run_at") >= cutoff))
