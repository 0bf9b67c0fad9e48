"""Pluggable collectors and the sweep over all of them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

Collector = Callable[[SparkSession], DataFrame]


def collect_all(spark: SparkSession, collectors: dict[str, Collector], staging: str, at_once: int = 4):
    """Run every collector, each on its own and ``at_once`` at a time.

    Spark is lazy, so a broken source would only fail inside the joint job and
    take the others with it.  Each collector is therefore written to a folder
    under ``staging`` (shared storage) first; the union reads those files.
    Returns (items, records) with one record (source, fetched, ok, note) each.
    """
    def run(at: int, name: str, collect: Collector) -> tuple[DataFrame | None, tuple]:
        folder = f"{staging.rstrip('/')}/{at:03d}"
        try:
            collect(spark).write.mode("overwrite").parquet(folder)
            part = spark.read.parquet(folder)
            n = part.count()
        except Exception as failure:  # one source must not stop the others
            note = f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"
            return None, (name, 0, 0, note)
        return part.withColumn("collector", F.lit(name)).withColumn("source_ord", F.lit(at)), (name, n, 1, f"{n} items")

    with ThreadPoolExecutor(max(1, min(at_once, len(collectors)))) as pool:
        found = list(pool.map(run, range(len(collectors)), collectors, collectors.values()))
    parts = [part for part, _ in found if part is not None]
    run_log = spark.createDataFrame([record for _, record in found], "source string, fetched long, ok int, note string")
    items = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None
    return items, run_log
