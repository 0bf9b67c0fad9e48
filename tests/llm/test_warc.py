import hashlib

from pyspark.sql import functions as F

from fieldscope.llm import files, warc
from fieldscope.llm.common import new_folder
from llm import cases

BODY = "<p>" + "payload " * 40 + "</p>"
ROWS = [(1, "http://a/1", BODY), (2, "http://a/2", BODY), (3, None, None), (4, "http://a/ü 4\r\nX: y", ""), (5, "u", "short"),
        (6, "u", "short"), (None, "n", BODY), (7, "long", "é" * 300_000), (1, "http://a/1", BODY), (8, "u", None)]


def expected(rows):
    found = []
    for page, _, body in rows:
        raw = (body or "").encode()
        firsts = [p for p, _, b in rows if (b or "") == (body or "") and p is not None]
        first = min(firsts) if firsts and len(raw) >= 100 else None
        revisit = first is not None and page != first
        found.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(found, key=str)


def test_query_reads_back_what_it_wrote(spark, tmp_path):
    folder = cases.saved(cases.pages(spark, ROWS), tmp_path, "pages")
    assert sorted(map(tuple, warc.op1_warc_bundles(spark, folder).collect()), key=str) == expected(ROWS)


def test_no_pages(spark, tmp_path):
    assert warc.op1_warc_bundles(spark, cases.saved(cases.pages(spark, []), tmp_path, "pages")).collect() == []


def test_one_record_is_read_by_its_index_row(spark):
    index = warc.write(warc.with_responses(cases.pages(spark, ROWS)), new_folder(spark, "warc-test"), frame=2000, bundle=4000)
    assert index.count() == len(ROWS) and index.select("bundle").distinct().count() > 1
    row = warc.read(index.filter("page_id = 5")).first()
    assert (row.page_id, row.payload_bytes, row.record_type) == (5, 5, "response")
    assert warc.read(index.filter("page_id = 4")).first().url == "http://a/ü 4\r\nX: y"


URLS = ["http://h/a%20b", "http://h/%C3%BC?q=100%", "http://h/ü/\U0001F600", "http://h/a b", "x\ty\r\nz: 1", "", " ", "%", "urn:none", None, "a: b"]


def test_urls_are_read_back_as_they_were(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)]
    index = warc.write(warc.with_responses(cases.pages(spark, rows)), new_folder(spark, "warc-test"))
    assert {r.page_id: r.url for r in warc.read(index).collect()} == dict(enumerate(URLS))
    head, _, _ = warc.parse(warc.record(1, 0, "http://h/a%20b c", b"", "", 0, None, None))
    assert head["WARC-Target-URI"] == "http://h/a%20b%20c"


def test_every_record_has_an_id_and_revisits_name_one(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "u", BODY) for i in range(30)]
    index = warc.write(warc.with_responses(cases.pages(spark, rows)), new_folder(spark, "warc-test"), frame=2000)
    ids = [r.record_id for r in index.collect()]
    assert len(set(ids)) == len(rows)
    referred = set()
    for r in index.collect():
        head, _, _ = warc.parse(warc.BundleReader(r.bundle).frame(r.frame), r.place)
        assert head["WARC-Record-ID"] == r.record_id
        referred |= {head["WARC-Refers-To"]} if "WARC-Refers-To" in head else set()
    assert len(referred) == 1 and referred <= set(ids)


def test_frames_stand_alone_and_the_seek_table_is_standard(spark, tmp_path):
    import zstandard

    uri = f"file://{tmp_path}/a.warc.zst"
    writer = warc.BundleWriter(uri)
    parts = [bytes([65 + i]) * (1000 * i + 1) for i in range(5)]
    places = [writer.add(p) for p in parts]
    writer.close()
    reader = warc.BundleReader(uri)
    assert [reader.frame(i) for i in (4, 0, 2)] == [parts[4], parts[0], parts[2]]
    raw = files.open_file(uri).read()
    for part, (_, at) in zip(parts, places):
        assert zstandard.ZstdDecompressor().decompress(raw[at:]) == part
    # Any decompressor reads the whole bundle as one stream and passes over the seek table.
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(parts)


def test_groups_need_no_order(spark):
    known = warc.with_responses(cases.pages(spark, ROWS)).select("page_id", "first_id").filter(F.col("first_id").isNotNull())
    assert {tuple(r) for r in known.collect()} == {(1, 1), (2, 1), (None, 1)}
