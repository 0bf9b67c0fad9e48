import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldscope.llm import files, tokens
from fieldscope.llm.common import new_folder
from llm import cases

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokens.vocabulary())


def expected(tokenizer, rows, got):
    """Rows of one id, or none, may come in any order; here in that of the result."""
    coded = [(doc_id, [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]) for doc_id, text, *_ in rows]
    coded = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded]
    found, at = [(i, n, crc) for i, _, n, crc in got], 0
    for doc_id, n, crc in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, found.index(r))):
        yield doc_id, at, n, crc
        at += n


def test_query_equals_the_tokenizer(spark, tmp_path, tokenizer):
    folder = cases.saved(cases.documents(spark), tmp_path, "documents")
    got = sorted(map(tuple, tokens.op7_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == list(expected(tokenizer, cases.DOCUMENTS, got))


def test_benchmark_documents(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, tokens.op7_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == list(expected(tokenizer, rows, got))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_fill_many_files(spark, doc_id):
    rows = [(doc_id if i % 3 else i, f"text number {i} " * 20) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # as these rows are few
    try:
        groups = tokens.write(docs, new_folder(spark, "tokens-test"))
    finally:
        spark.conf.unset(key)
    assert max(r.documents for r in groups.collect()) < 450 and tokens.read(groups).count() == 900


def test_no_documents(spark, tmp_path):
    assert tokens.op7_token_files(spark, cases.saved(cases.documents(spark, []), tmp_path, "documents")).collect() == []


@pytest.mark.parametrize("text", [
    "A.B, c., d.. ,e f.", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>.", "É É ΣΑΣ ς. ﬁ, 中文. don't We'LL",
    "\x1c\x85\xa0 á. ́b, 12,5. 1²", "", " \n.", "***, a***. (b), \"c.\" d…"])
def test_words_one_by_one_are_the_whole(tokenizer, text):
    encoder = tokens.WordEncoder(tokens.vocabulary())
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == want


def test_files_allow_selective_reads(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50, f"s{i % 3}", i * 7) for i in range(200)],
                                 "doc_id long, text string, source string, n long")
    groups = tokens.write(docs, new_folder(spark, "tokens-test"), metadata=("source", "n"), group_tokens=1000).collect()
    assert len(groups) > 10 and sum(g.documents for g in groups) == 200
    with files.open_file(groups[0].file) as file:
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).path for i in range(meta.num_columns)]
        group = meta.row_group(0)
        columns = {n: group.column(i) for i, n in enumerate(names)}
        assert {"RLE_DICTIONARY"} <= set(columns["ids.list.element"].encodings)
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
        rows = pq.ParquetFile(file).read(columns=["doc_id", "meta_source", "meta_n"])  # no ids are read
        assert rows.column("meta_n").to_pylist() == [7 * i for i in rows.column("doc_id").to_pylist()]
    # Spark prunes row groups and columns of the same files.
    folder = groups[0].file.rpartition("/")[0]
    one = spark.read.parquet(*sorted({g.file for g in groups})).filter(F.col("doc_id") == 150).select("ids").first().ids
    assert one == [*tokenizer.encode("text number 150 " * 50, add_special_tokens=False).ids, tokens.END] and folder
