"""Every query against its SQL twin, and the plans that matter."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from fieldscope.workload import adapters as a
import __spark_entry__ as contract
from fieldscope.workload.queries import all_queries

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@needs_data
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, oracle, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = oracle.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canonical(mine) == canonical(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_every_query_has_a_twin():
    from fieldscope.workload import oracle, queries
    assert set(queries.all_queries()) == set(oracle.all_oracles())


@needs_data
def test_entry_has_rows(spark):
    assert 0 < contract.entry(spark).count() <= 8


@needs_data
@pytest.mark.parametrize("name, node", [
    ("top_picks", "TakeOrderedAndProject"), ("dashboard_listing", "TakeOrderedAndProject"),
    ("last_n_runs", "WindowGroupLimit"), ("dedupe_first", "WindowGroupLimit"), ("budget_pack", "WindowGroupLimit"),
    ("journal_lookup", "WindowGroupLimit")])
def test_plan_has(spark, name, node):
    assert node in plan_of(contract.queries()[name](spark, DATA))


@needs_data
@pytest.mark.parametrize("name", ["keyword_score", "prefilter_gate", "term_join", "watch_topic", "strip_html",
                                  "normalize_url", "clean_doi", "scan_feeds", "score_payload"])
def test_row_work_needs_no_shuffle(spark, name):
    assert "Exchange" not in plan_of(contract.queries()[name](spark, DATA))


@needs_data
def test_only_needed_columns_are_read(spark):
    plan = plan_of(contract.queries()["prune_runs"](spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
    assert "PushedFilters" in plan


@needs_data
def test_no_query_crosses_tables(spark):
    for name, build in all_queries().items():
        if not name.startswith("stream_"):  # they run while they are built
            assert "CartesianProduct" not in plan_of(build(spark, DATA)), name


@needs_data
def test_invariants_on_documents(spark):
    t = a.Tables(spark, DATA)
    scored = contract.queries()["keyword_score"](spark, DATA)
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 10)).count() == 0
    assert scored.count() == t.documents.count()
    best = contract.queries()["best_tag"](spark, DATA).select("id", F.col("tag").alias("best"))
    differing = scored.filter(F.col("rationale") != "excluded topic").join(best, "id", "left").filter(
        F.col("tag") != F.coalesce("best", F.lit("none")))
    assert differing.count() == 0
