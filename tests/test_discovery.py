import datetime as dt

from pyspark.sql import functions as F

from fieldscope.operators import discovery
from fieldscope.settings import AUTHOR_LABEL, CITES_LABEL, DiscoverySettings

NEW, OLD = dt.date(2024, 1, 10), dt.date(2023, 1, 1)


def graph(spark):
    works = spark.createDataFrame([
        ("L1", "https://doi.org/10.1/A", "article", OLD), ("L2", "10.1/b", "article", NEW),
        ("C1", None, "preprint", NEW), ("C2", None, "article", OLD), ("C3", "", "article", NEW),
        ("A1", None, "article", NEW), ("A2", None, "preprint", NEW), ("X", None, "article", NEW),
    ], "work_id string, doi string, type string, published date")
    cites = spark.createDataFrame([("C1", "L1"), ("C1", "L2"), ("C2", "L1"), ("L2", "L1"), ("C3", "L2"), ("X", "C1")],
                                  "citing_id string, cited_id string")
    authors = spark.createDataFrame([
        ("L1", 0, "ann"), ("L1", 1, "bob"), ("L2", 0, "bob"), ("L2", 1, "cid"), ("L2", 2, "cid"),
        ("A1", 0, "bob"), ("A2", 0, "bob"), ("C3", 0, "bob"), ("X", 0, "dee")],
        "work_id string, pos int, author_id string")
    dois = spark.createDataFrame([("10.1/a", 0), ("HTTPS://doi.org/10.1/B", 1), ("10.1/missing", 2), (" ", 3)],
                                 "doi string, seq int")
    return works, cites, authors, dois


def test_library_resolves_by_cleaned_doi(spark):
    works, _, _, dois = graph(spark)
    got = {(r["work_id"], r["seq"]) for r in discovery.resolve_library(dois, works).collect()}
    assert got == {("L1", 0), ("L2", 1)}


def test_top_authors_count_repeats_and_keep_first_encounter(spark):
    works, _, authors, dois = graph(spark)
    library = discovery.resolve_library(dois, works)
    top = [tuple(r) for r in discovery.top_authors(library, authors, 2).collect()]
    assert top == [("bob", 2), ("cid", 2)]      # both twice; bob is met first
    assert discovery.top_authors(library, authors, 9).count() == 3


def test_discovery_labels_and_leaves_out_the_library(spark):
    works, cites, authors, dois = graph(spark)
    library = discovery.resolve_library(dois, works)
    found = discovery.discover(works, library, cites, authors, F.lit("2023-12-01").cast("timestamp"))
    got = {r["work_id"]: r["source"] for r in found.collect()}
    # C2 is too old, L2 is the library, A2 is no article, C3 both cites and is by bob
    assert got == {"C1": CITES_LABEL, "C3": CITES_LABEL, "A1": AUTHOR_LABEL}


def test_seeds_are_the_first_library_works(spark):
    works, cites, authors, dois = graph(spark)
    library = discovery.resolve_library(dois, works)
    cutoff = F.lit("2023-12-01").cast("timestamp")
    one_seed = discovery.recent_citing(works, library, cites, cutoff, max_seeds=1)
    assert {r["work_id"] for r in one_seed.collect()} == {"C1", "L2"}
    found = discovery.discover(works, library, cites, authors, cutoff, DiscoverySettings(max_seed_works=1, max_authors=1))
    assert {r["work_id"]: r["source"] for r in found.collect()} == {
        "C1": CITES_LABEL, "C3": AUTHOR_LABEL, "A1": AUTHOR_LABEL}


def test_edges_from_nested_works(spark):
    nested = spark.createDataFrame(
        [("https://o.org/W1", ["https://o.org/W2", "https://o.org/W3"], [(("https://o.org/A1",),), ((None,),), (("A1",),)])],
        "id string, referenced_works array<string>, authorships array<struct<author:struct<id:string>>>")
    assert {tuple(r) for r in discovery.citation_edges(nested).collect()} == {("W1", "W2"), ("W1", "W3")}
    assert sorted(tuple(r) for r in discovery.authorship_edges(nested).collect()) == [("W1", 0, "A1"), ("W1", 2, "A1")]


def test_distinct_first(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "k string, s int")
    assert {tuple(r) for r in discovery.distinct_first(df, "k", "s").collect()} == {("x", 1), ("y", 2)}
