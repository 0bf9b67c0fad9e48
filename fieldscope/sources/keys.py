"""The ids of a stored table, as an index of their own that appends are compared with.

A run (a sweep, or a micro-batch) adds a folder with its new ids.  Every so many runs
these are merged into a base: a table partitioned by month and bucketed by id, whose
buckets an anti-join reads as they lie, so a look-up does not shuffle it where the rows are
in no more partitions than buckets.  Of a base a look-up reads the months from a bound on,
and for a batch of a few ids only the buckets that these fall into.

A merge takes up earlier bases that are small or no larger than what it has so far.  The
others stay, so that an id is written again about as often as the index has doubled, not
in every merge, and each base is about twice the next one at least.

What a run number means is the caller's: runs only have to grow.  A run that is repeated
overwrites its own folder and is compared with earlier runs alone, so it adds the same ids
once.  A base is named after the last run in it and counts once it is complete, so a
merge that fails leaves the index as it was; should it fail before it has removed what it
took up, an id may be in two bases, which changes no answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldscope.functions.columns import moment

_SCHEMA = "id string, month string"


class KeyStore:
    """``named``: up to so many rows of a batch are looked up by name, which leaves whole buckets unread.  ``small``: bases of
    up to so many bytes go into every merge."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, merge_runs: int = 16, named: int = 1000, small: int = 16 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.merge_runs, self.named, self.small = buckets, merge_runs, named, small

    def of(self, spark: SparkSession) -> KeyStore:
        """The same index in another session."""
        return KeyStore(spark, self.path, self.buckets, self.merge_runs, self.named, self.small)

    def _folder(self, kind: str, run: int) -> str:
        return f"{self.path}/{kind}-{run:012d}"

    def _store(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _runs(self, kind: str, before: int | None) -> list[int]:
        """Numbers of the complete folders of a kind, in order."""
        store, top = self._store(self.path)
        if not store.exists(top):
            return []
        names = [s.getPath().getName() for s in store.listStatus(top)]
        runs = sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{kind}-"))
        return [r for r in runs if (before is None or r < before) and store.exists(self._store(f"{self._folder(kind, r)}/_SUCCESS")[1])]

    def _remove(self, kind: str, run: int) -> None:
        store, folder = self._store(self._folder(kind, run))
        store.delete(folder, True)

    def _size(self, kind: str, run: int) -> int:
        store, folder = self._store(self._folder(kind, run))
        return store.getContentSummary(folder).getLength()

    def _name(self, run: int) -> str:
        return f"fieldscope_keys_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_{run}"

    def _base(self, run: int) -> DataFrame:
        """A base as a table of the catalog, which knows its buckets; sessions that never saw it register it."""
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_SCHEMA}) USING parquet PARTITIONED BY (month) CLUSTERED BY (id) SORTED BY (id) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self._folder('base', run)}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def _recent(self, runs: list[int]) -> DataFrame | None:
        return self.spark.read.schema(_SCHEMA).parquet(*[self._folder("run", r) for r in runs]) if runs else None

    def tables(self, before: int | None = None) -> list[DataFrame]:
        """The bases and the runs since, of runs before one: together all ids."""
        bases = self._runs("base", before)
        base = bases[-1] if bases else -1
        recent = self._recent([r for r in self._runs("run", before) if r > base])
        return [self._base(b) for b in bases] + ([recent] if recent is not None else [])

    def next_run(self) -> int:
        return 1 + max([-1, *self._runs("base", None), *self._runs("run", None)])

    def without_known(self, rows: DataFrame, before: int | None = None, since=None) -> DataFrame:
        """The rows whose ``id`` no run before this one has; ``since`` leaves out what the index has of earlier months, for sources
        that never deliver anything older."""
        tables = self.tables(before)
        few = rows.select("id").limit(self.named + 1).collect() if tables and self.named else []
        for known in tables:
            if since is not None:
                known = known.filter(F.col("month") >= F.date_format(moment(since), "yyyy-MM"))
            if 0 < len(few) <= self.named:
                known = known.filter(F.col("id").isin(sorted({r["id"] for r in few})))
            rows = rows.join(known.select("id"), "id", "left_anti")
        return rows

    def add(self, ids: DataFrame, run: int) -> None:
        """Store a run's ``id``s with the ``month`` of each."""
        ids.select("id", F.coalesce("month", F.lit("")).alias("month")).write.mode("overwrite").parquet(self._folder("run", run))

    def merge(self, before: int | None = None) -> bool:
        """Make a new base of the runs since the last, and of those bases that are due, if enough runs have come in; whether it did.

        In a stream ``before`` is the batch at hand: only batches before it are sure not to be run again.  Frames that were
        built on the old base are no longer valid.
        """
        bases = self._runs("base", before)
        base = bases[-1] if bases else -1
        live = [r for r in self._runs("run", before) if r > base]
        if len(live) < self.merge_runs:
            return False
        due, size = [], sum(self._size("run", r) for r in live)
        for run in reversed(bases):
            held = self._size("base", run)
            if held > max(size, self.small):
                break
            due.append(run)
            size += held
        merged = self._recent(live)
        for run in due:
            merged = merged.unionByName(self._base(run).select("id", "month"))
        name = self._name(live[-1])
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._remove("base", live[-1])  # what a merge that failed has left
        (merged.repartition(self.buckets, "id").write.format("parquet").partitionBy("month").bucketBy(self.buckets, "id").sortBy("id")
         .option("path", self._folder("base", live[-1])).saveAsTable(name))
        for run in due:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            self._remove("base", run)
        for run in self._runs("run", live[-1] + 1):
            self._remove("run", run)
        return True

    def catch_up(self, items: DataFrame) -> None:
        """Add the stored items (``id``, ``month``) that a sweep has written without coming to its ids."""
        run = self.next_run()
        self.add(self.without_known(items.select("id", "month")), run)
