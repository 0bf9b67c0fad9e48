"""Works and their edges as stored tables, so that a sweep explodes the references of new works only.

Each table is bucketed by what discovery joins it on: works and authorships by work, citations by
the cited work.  Those joins read the buckets as they lie; only the reader's library moves.
A sweep's rows are a partition of their own, which a sweep that is repeated replaces.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from fieldscope.operators.discovery import authorship_edges, citation_edges, work_table
from fieldscope.sources.tables import remove

# Columns and bucket key of each table.
_TABLES = {
    "works": ("work_id string, doi string, title string, type string, published date", "work_id", work_table),
    "citations": ("citing_id string, cited_id string", "cited_id", citation_edges),
    "authorships": ("work_id string, pos int, author_id string", "work_id", authorship_edges)}


class WorkGraph:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _name(self, table: str) -> str:
        return f"fieldscope_{table}_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def _registered(self, table: str) -> str:
        """The catalog's name of a table, which sessions that never saw it register."""
        name, (columns, key, _) = self._name(table), _TABLES[table]
        if not self.spark.catalog.tableExists(name):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
            self.spark.sql(f"CREATE TABLE {name} ({columns}, sweep BIGINT) USING parquet PARTITIONED BY (sweep) CLUSTERED BY ({key}) "
                           f"SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return name

    def _read(self, table: str) -> DataFrame:
        return self.spark.table(self._registered(table)).drop("sweep")

    def add(self, works: DataFrame, sweep: int) -> None:
        """Store nested works that no earlier sweep has stored, and their edges.  ``works`` are read for each table:
        they should be a written table."""
        for table, (columns, key, rows) in _TABLES.items():
            name = self._registered(table)
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (sweep = {sweep})")
            remove(self.spark, f"{self.path}/{table}/sweep={sweep}")
            names = [c.split()[0] for c in columns.split(", ")]
            found = rows(works).select(*names).selectExpr("*", f"{sweep}L AS sweep")
            found.repartition(self.buckets, key).write.mode("append").insertInto(name)

    def works(self) -> DataFrame:
        return self._read("works")

    def citations(self) -> DataFrame:
        return self._read("citations")

    def authorships(self) -> DataFrame:
        return self._read("authorships")
