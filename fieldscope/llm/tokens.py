"""Token ids in Parquet files that allow selective reads.

A file holds documents in rising doc_id order: their ids as a list column with
dictionary encoding (16-bit indexes for a vocabulary of that size), their place
and number of ids as delta-encoded integers, and any metadata columns.  Row groups
end after a number of ids, and page indexes are written, so a reader can skip to
single documents or read metadata without any ids.

* A NULL text is an empty one: only the end id.
* A NULL doc_id comes last; rows with equal ids, or none, follow the order of a hash of
  their texts and metadata, so that many of them fill many files.
* Repeated rows are encoded each; no rows make no files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fieldscope.llm import files
from fieldscope.llm.common import kept, new_folder, small_batches

END = 2
GROUP_TOKENS = 1 << 20  # ids after which a row group ends
TASK_TOKENS = 1 << 23  # ids that a reading task gets
PAGE_BYTES = 1 << 16
CACHE = 1_000_000  # words whose ids a worker keeps
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARK = re.compile(rb"([.,])(?<=[A-Za-z0-9].)(?=[ \n]|\Z)")

_FILES = "part int, file string, group int, documents long, tokens long"
_READ = "part int, file string, group int, doc_id long, first long, n_tokens long, ids_crc32 long"


class WordEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers.

    For a tokenizer that ignores case, drops white space and has no token across
    it, a text's ids are those of its words one after the other, so each word is
    encoded once.  A comma or full stop between a letter and white space is a word
    of its own for it, so words are kept without them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if word.isalpha() and word.islower():  # plain letters are what normalization and splitting leave as they are
            ids = [t.id for t in self.tokenizer.model.tokenize(word.decode())]
        else:
            ids = self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        value = self[word] = np.array(ids, "<u4").tobytes()
        return value

    def ids(self, text: bytes) -> bytes:
        if b"<|" not in text:  # the special tokens are in small letters only
            text = text.translate(_SMALL)
        return b"".join(map(self.__getitem__, _MARK.sub(rb" \1", text).split()))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write(documents: DataFrame, folder: str, metadata: tuple[str, ...] = (), path: str | None = None,
          group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Encode the documents into files below ``folder``; the table of their row groups in the order of doc_id.

    Only files of tasks that succeeded are in that table.
    """
    kinds = {f.name: f.dataType for f in documents.schema}
    extra = [(f"meta_{m}", pa.int64() if kinds[m].typeName() in ("long", "integer") else pa.string()) for m in metadata]
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.list_(pa.uint32())), *extra])
    deltas = {"doc_id": "DELTA_BINARY_PACKED", "first": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}
    words_of = path or vocabulary()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = files.per_process(f"encoder {words_of}", lambda: WordEncoder(words_of))
        part, uri, out, writer = TaskContext.get().partitionId(), None, None, None
        ids, meta, first, at, groups = [], [], [], 0, []

        def flush():
            nonlocal uri, out, writer, ids, meta, first
            if writer is None:
                uri = files.fresh_name(folder, ".parquet")
                out = files.create(uri)
                writer = pq.ParquetWriter(
                    out, schema, compression="zstd", use_dictionary=["ids.list.element", *[n for n, _ in extra]],
                    column_encoding=deltas, write_page_index=True, data_page_size=PAGE_BYTES,
                    dictionary_pagesize_limit=1 << 20)
            sizes = [len(x) // 4 for x in ids]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4")))
            columns = [pa.array([m[0] for m in meta], pa.int64()), pa.array(first, pa.int64()), pa.array(sizes, pa.int64()), lists]
            columns += [pa.array([m[i + 1] for m in meta], kind) for i, (_, kind) in enumerate(extra)]
            writer.write_table(pa.table(columns, schema=schema), row_group_size=len(ids))
            groups.append((part, uri, len(groups), len(ids), int(offsets[-1])))
            ids, meta, first = [], [], []

        waiting = 0
        for batch in batches:
            for row in range(batch.num_rows):
                coded = encoder.ids(batch.column(1)[row].as_py() or b"") + end
                ids.append(coded)
                meta.append([batch.column(0)[row].as_py(), *[batch.column(i + 2)[row].as_py() for i in range(len(extra))]])
                first.append(at)
                at, waiting = at + len(coded) // 4, waiting + len(coded) // 4
                if waiting >= group_tokens:
                    flush()
                    waiting = 0
        if ids:
            flush()
        if writer is not None:
            writer.close()
            out.close()
        names = [x.split()[0] for x in _FILES.split(", ")]
        kinds_ = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*groups)) or [()] * 5, kinds_)], names)

    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *metadata)
    rows = rows.withColumn("_tie", F.xxhash64("text", *metadata))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("_tie")
    return kept(ordered.mapInArrow(run, _FILES), "token-files")


def read(groups: DataFrame) -> DataFrame:
    """Documents of these row groups, with the checksum of their ids; ``first`` counts the ids before them in their file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri, group in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with files.open_file(uri) as file:
                    table = pq.ParquetFile(file).read_row_group(group, columns=["doc_id", "first", "ids"])
                column = table.column("ids").combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                at, values = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4", copy=False)
                n = table.num_rows
                sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([uri] * n), pa.array([group] * n, pa.int32()),
                     table.column("doc_id").combine_chunks(), table.column("first").combine_chunks(),
                     pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                    [x.split()[0] for x in _READ.split(", ")])

    tasks = -(-(groups.agg(F.sum("tokens")).first()[0] or 1) // TASK_TOKENS)
    return groups.select("part", "file", "group").repartition(tasks, "file", "group").mapInArrow(run, _READ)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = write(documents, new_folder(spark, "tokens"), metadata=("lang", "source"))
    # One row for each task that wrote a file: a single one may order them, and they may be broadcast.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.groupBy("part").agg(F.sum("tokens").alias("_n")).select(
        F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    read_back = read(groups)
    return read_back.join(F.broadcast(kept(offsets, "token-offsets")), F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
