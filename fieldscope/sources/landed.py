"""Landed files of any format as a Spark data source: a plug-in is a function that parses one file.

Files are dealt out to tasks by size and parsed there, so a collector costs the driver a listing
and no more, and one that fails is a failed job of its own.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 64 << 20
# From a file's name and bytes to the rows in it, as dicts.
Parser = Callable[[str, bytes], Iterable[dict]]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a folder's files, in order; what starts with a dot or an underscore is no data."""
    where, top = located(path)
    found = where.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[:1] not in "._")


@dataclass
class _Chunk(InputPartition):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path, self.parser = schema.names, options["path"], options["parser"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        chunks, size = [[]], 0
        for name, bytes_ in _files(self.path):
            if chunks[-1] and size + bytes_ > self.task_bytes:
                chunks.append([])
                size = 0
            chunks[-1].append(name)
            size += bytes_
        return [_Chunk(c) for c in chunks]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        where, _ = located(self.path)
        parse: Parser = pickle.loads(base64.b64decode(self.parser))
        for name in partition.files:
            with where.open_input_stream(name) as stream:
                for row in parse(name, stream.read()):
                    yield tuple(row.get(c) for c in self.columns)


class LandedFiles(DataSource):
    """Options: ``path``, ``parser`` (a pickled function, as ``read_landed`` puts it) and ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_landed(spark: SparkSession, path: str, parser: Parser, schema: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of a folder's files.  The parser travels with the query, so executors need no copy of its module."""
    spark.dataSource.register(LandedFiles)
    packed = base64.b64encode(cloudpickle.dumps(parser)).decode()
    return spark.read.format("landed").schema(schema).option("parser", packed).option("taskBytes", task_bytes).load(path)


def json_lines(name: str, data: bytes) -> Iterable[dict]:
    """The plug-in for files of one JSON object per line; a line that isn't one fails its collector."""
    for line in data.splitlines():
        if line.strip():
            yield json.loads(line)


def front_matter(name: str, data: bytes) -> Iterable[dict]:
    """The plug-in for notes that begin with ``key: value`` lines, up to an empty one: those, and the rest as ``body``."""
    head, _, body = data.decode("utf-8", "replace").partition("\n\n")
    fields = (line.partition(":") for line in head.splitlines())
    yield {"body": body, **{k.strip().lower(): v.strip() for k, colon, v in fields if colon}}
