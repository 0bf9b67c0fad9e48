import datetime as dt
import json

from pyspark.sql import functions as F

from fieldscope.operators.packing import pack_budget
from fieldscope.sources import entries, library, notes, registry
from fieldscope.sources.works import collect_works, read_works, works_to_items

NOW = dt.datetime(2024, 3, 20, 12)


def write_json(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


WORKS = [
    {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "title": "Power Grid", "type": "article",
     "publication_date": "2024-03-18", "primary_location": {"landing_page_url": "https://j/1", "source": {
         "display_name": "Joule", "type": "journal", "issn": ["1", "2"]}},
     "abstract_inverted_index": {"planning": [1, 3], "grid": [0], "again": [2]},
     "authorships": [{"author": {"id": "https://openalex.org/A1"}}], "referenced_works": []},
    {"id": "https://openalex.org/W2", "doi": None, "title": None, "type": "article", "publication_date": "2024-03-01",
     "primary_location": {"landing_page_url": None, "source": {"display_name": None, "type": "Repository"}}},
    {"id": "https://openalex.org/W3", "title": "", "type": "preprint", "publication_date": "", "unknown_key": 1,
     "primary_location": None, "authorships": [{"author": None}, {"author": {"id": "https://openalex.org/A1"}}]},
]


def test_works_to_items(spark, tmp_path):
    df = read_works(spark, write_json(tmp_path / "works.json", WORKS))
    got = {r["url"]: r for r in works_to_items(df, F.lit("openalex:x")).collect()}
    first = got["https://j/1"]
    assert (first["doi"], first["title"], first["summary"], first["venue"], first["is_preprint"], str(first["published_at"])) == (
        "10.1/A", "Power Grid", "grid planning again planning", "Joule", 0, "2024-03-18")
    second, third = got["https://openalex.org/W2"], got["https://openalex.org/W3"]
    assert (second["doi"], second["title"], second["summary"], second["venue"], second["is_preprint"]) == (None, "(untitled)", "", "", 1)
    assert (third["title"], third["published_at"], third["is_preprint"]) == ("(untitled)", None, 1)


def test_collect_works_lists_a_work_once_per_selection(spark, tmp_path):
    df = read_works(spark, write_json(tmp_path / "works.json", WORKS))
    found = collect_works(df, ["grid planning", "planning Power", "solar"], ["2", "9"], ["A1"], NOW, 7)
    assert sorted(r["source"] for r in found.collect()) == [
        "openalex:author:A1", "openalex:grid planning", "openalex:issn:2", "openalex:planning Power"]
    assert collect_works(df, [], [], [], NOW, 7).count() == 0
    paged = collect_works(df, ["grid planning", "planning Power"], [], [], NOW, 365, per_label=1)
    assert sorted(r["source"] for r in paged.collect()) == ["openalex:grid planning", "openalex:planning Power"]
    wide = collect_works(df, ["grid"], [], ["A1"], NOW, 365)     # unknown dates stay out
    assert {r["url"] for r in wide.collect()} == {"https://j/1"}


ENTRY = "title string, summary string, link string, published string, categories array<string>, doi string"


def test_preprints_match_category_or_phrase(spark):
    df = spark.createDataFrame([
        ("In\ncategory", " a\nb ", "l1", "2024-03-19T00:00:00Z", ["math.OC"], ""),
        ("By Phrase", "about Unit Commitment", "l2", None, ["cs.AI"], "10.1/x"),
        ("neither", "", "l3", "2024-03-19T00:00:00Z", ["cs.AI"], None),
        ("old", "", "l4", "2024-03-01T00:00:00Z", ["math.OC"], None),
        ("no categories", "", "l5", "2024-03-19T00:00:00Z", None, None)], ENTRY)
    got = {r["url"]: r for r in entries.scan_preprints(df, ["math.OC"], ["unit commitment"], NOW).collect()}
    assert set(got) == {"l1", "l2"}
    assert (got["l1"]["title"], got["l1"]["summary"], got["l1"]["doi"]) == ("In category", "a b", None)
    assert (got["l2"]["published_at"], got["l2"]["doi"], got["l2"]["venue"], got["l2"]["is_preprint"]) == (None, "10.1/x", "arXiv", 1)


def test_preprint_default_category_and_limit_before_window(spark):
    df = spark.createDataFrame([(f"t{n}", "", f"l{n}", f"2024-03-{20 - n:02d}T00:00:00Z", ["eess.SY"], None) for n in range(9)]
                               + [("x", "", "x", "2024-03-20T00:00:00Z", ["cs.AI"], None)], ENTRY)
    assert {r["url"] for r in entries.scan_preprints(df, [], None, NOW, max_results=3).collect()} == {"l0", "l1", "l2"}
    assert entries.scan_preprints(df, [], [], NOW, window_days=2).count() == 2


def test_news_keep_unknown_dates(spark):
    df = spark.createDataFrame([
        ("q one", " T ", "a", "<b>x</b>&nbsp;y", "2024-03-19 10:00:00"), ("q one", None, "b", None, "garbage"),
        ("q two", "old", "c", "", "2024-03-01 10:00:00"), ("q two", "none", "d", "", None)],
        "query string, title string, link string, summary string, published string")
    got = {r["url"]: (r["source"], r["title"], r["summary"], r["published_at"]) for r in entries.scan_news(df, NOW).collect()}
    assert got == {"a": ("gnews:q one", "T", "x y", dt.date(2024, 3, 19)), "b": ("gnews:q one", "", "", None),
                   "d": ("gnews:q two", "none", "", None)}


def test_feeds_fall_back_and_a_bad_line_is_reported(spark, tmp_path):
    good = [{"title": " A ", "link": "u1", "summary": "", "description": "<p>desc</p>", "updated": "2024-03-19T01:00:00Z"},
            {"title": None, "link": None, "summary": "s", "published": "2024-03-01T01:00:00Z"}]
    write_json(tmp_path / "Carbon Brief.jsonl", good)
    (tmp_path / "Broken.jsonl").write_text('{"title": "half\n{"title": "ok", "link": "u2"}', encoding="utf-8")
    parsed = entries.parse_feed_lines(entries.read_feed_lines(spark, str(tmp_path)))
    items = {r["url"]: (r["source"], r["source_type"], r["title"], r["summary"]) for r in
             entries.scan_feeds(parsed, NOW, source_types={"Broken": "news"}).collect()}
    assert items == {"u1": ("Carbon Brief", "org", "A", "desc"), "u2": ("Broken", "news", "ok", "")}
    records = {r["source"]: (r["fetched"], r["failed"], r["ok"]) for r in entries.feed_records(parsed, NOW).collect()}
    assert records == {"rss:Carbon Brief": (1, 0, 1), "rss:Broken": (1, 1, 0)}


def test_dois_from_bib_files(spark, tmp_path):
    (tmp_path / "a.bib").write_text(
        "@article{a, title={X}, doi = {10.4321/SEA.7}}\n@article{b, DOI=\n{ https://doi.org/10.8765/net.2 }}\n"
        '@article{c, doi="10.4321/sea.7"}\n@misc{d, title={without one}}\n', encoding="utf-8")
    (tmp_path / "b.bib").write_text("@article{e, doi={10.9/z}}", encoding="utf-8")
    found = library.dois_from_bib(library.read_bib(spark, str(tmp_path)))
    assert [r["doi"] for r in found.orderBy("seq").collect()] == ["10.4321/sea.7", "10.8765/net.2", "10.9/z"]


def test_dois_from_records(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([
        {"data": {"itemType": "journalArticle", "DOI": "10.7/Mast"}}, {"data": {"itemType": "book", "DOI": ""}},
        {"data": {"itemType": "journalArticle", "extra": "doi: 10.7/keel"}}, {"data": {"itemType": "attachment", "DOI": "10.1/pdf"}}]))
    (tmp_path / "2.json").write_text(json.dumps([{"data": {"DOI": "10.7/Mast"}}]))
    records = library.read_library_json(spark, str(tmp_path))
    found = library.dois_from_records(records)
    assert [r["doi"] for r in found.orderBy("seq").collect()] == ["10.7/mast", "10.7/keel"]


def test_library_union_keeps_the_first_list(spark):
    one = spark.createDataFrame([("a", (5, 0)), ("b", (1, 0))], "doi string, seq struct<seq:int,at:int>")
    two = spark.createDataFrame([("b", (0, 0)), ("c", (9, 0))], "doi string, seq struct<seq:int,at:int>")
    got = [(r["doi"], r["seq"]["part"]) for r in library.library_dois(one, two).orderBy("seq").collect()]
    assert got == [("b", 0), ("a", 0), ("c", 1)]


def test_notes_skip_readme_binary_hidden_and_blank(spark, tmp_path):
    for name, body in [("README.md", "about this folder"), ("1-plan.md", "a note on tides"), ("my notes+.TXT", " harbour plans\n"),
                       ("scan.pdf", "%PDF"), (".hidden.md", "secret"), ("blank.rst", "  \n")]:
        (tmp_path / name).write_text(body, encoding="utf-8")
    docs = notes.read_notes(spark, str(tmp_path))
    assert {r["name"] for r in docs.collect()} == {"1-plan.md", "my notes+.TXT", "blank.rst"}
    block = pack_budget(docs.withColumn("folder", F.lit("context")).withColumn("at", F.col("name")), ["folder"], "at", 24000).first()["block"]
    assert block == "\n--- 1-plan.md ---\na note on tides\n\n--- my notes+.TXT ---\nharbour plans\n"


def test_one_broken_collector_does_not_stop_the_others(spark, tmp_path):
    def broken(s):
        return s.range(3).select(F.raise_error(F.lit("feed is down")).cast("string").alias("title"))

    def missing(s):
        return s.read.parquet(str(tmp_path / "nowhere"))

    collectors = {"good": lambda s: s.range(2).select(F.lit("t").alias("title")), "broken": broken, "missing": missing,
                  "other": lambda s: s.range(1).select(F.lit("u").alias("url"))}
    items, records = registry.collect_all(spark, collectors, str(tmp_path / "staging"))
    assert {(r["collector"], r["source_ord"]) for r in items.collect()} == {("good", 0), ("other", 3)}
    log = {r["source"]: (r["fetched"], r["ok"]) for r in records.collect()}
    assert log == {"good": (2, 1), "broken": (0, 0), "missing": (0, 0), "other": (1, 1)}


def test_bibtex_fields_are_whole_words_with_braced_or_quoted_values(spark):
    entry = ('@article{k, mydoi = {10.1/no}, doi = {{10.1/Braces}}, x-doi={10.1/no2}, DOI = "https://doi.org/10.1/quoted",\n'
             ' doi={10.1/{In}ner}, doi = {}, note = {doi: 10.1/free}}')
    got = library.dois_from_bib(spark.createDataFrame([(1, entry)], "seq int, value string"))
    assert sorted(r["doi"] for r in got.collect()) == ["10.1/braces", "10.1/inner", "10.1/quoted"]
