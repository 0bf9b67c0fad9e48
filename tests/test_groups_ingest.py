import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from fieldscope.operators import ingest
from fieldscope.operators.groups import first_per_group, keep_first, numbered_newest_first
from fieldscope.schemas import ITEM


def rows_of(spark, n=600, seed=5):
    """One group holds a third of the rows."""
    rng = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", rng.randrange(50), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, a int, b int").repartition(5)


def brute_first(rows, n):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return sorted(r for g in groups.values() for r in g[:n])


@pytest.mark.parametrize("n", [1, 3])
def test_first_per_group_is_cut_before_the_shuffle(spark, n):
    rows, df = rows_of(spark)
    got = first_per_group(df, ["k"], ["a", "b"], n)
    assert plan_of(got).count("WindowGroupLimit") == 2
    assert sorted(map(tuple, got.collect())) == brute_first(rows, n)


def test_first_per_group_beyond_the_threshold_goes_by_slices(spark):
    rows, df = rows_of(spark)
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        got = first_per_group(df, ["k"], ["a", "b"], 7)
        assert "_slice" in plan_of(got)
        assert sorted(map(tuple, got.collect())) == brute_first(rows, 7)
        down = first_per_group(df, ["k"], [F.col("a").desc(), F.col("b").desc()], 7, rank="at", spread=["b"])
        mirrored = brute_first([(k, -x, -y) for k, x, y in rows], 7)
        assert sorted((r["k"], -r["a"], -r["b"]) for r in down.collect()) == mirrored
    finally:
        spark.conf.set(key, before)


def test_rank_column(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "k string, a int")
    got = first_per_group(df, ["k"], ["a"], 2, rank="at")
    assert sorted((r["k"], r["a"], r["at"]) for r in got.collect()) == [("x", 1, 1), ("x", 3, 2), ("y", 2, 1)]


def test_ordinal_numbers_all_rows_without_one_big_task(spark):
    """A third of the rows have one time, others share minutes or days, some have none."""
    rng = random.Random(9)
    times = [None if i % 11 == 0 else 0 if i % 3 == 0 else rng.choice([rng.randrange(50), rng.randrange(200_000), rng.randrange(9_000_000)])
             for i in range(900)]
    df = spark.createDataFrame(list(enumerate(times)), "n int, s long").select(
        "n", F.timestamp_seconds("s").alias("at"), F.sha1(F.col("n").cast("string")).alias("id")).repartition(5)
    got = numbered_newest_first(df, F.col("at"), "id").collect()
    expected = sorted(df.collect(), key=lambda r: (r["at"] is None, -(r["at"].timestamp() if r["at"] else 0), r["id"]))
    assert [r["n"] for r in sorted(got, key=lambda r: r["rn"])] == [r["n"] for r in expected]
    assert sorted(r["rn"] for r in got) == list(range(1, 901))
    assert "checkpoint" not in plan_of(numbered_newest_first(df, F.col("at"), "id")).lower()


def test_ordinal_of_nothing(spark):
    empty = spark.createDataFrame([], "at timestamp, id string")
    assert numbered_newest_first(empty, F.col("at"), "id").count() == 0


def test_rows_without_identity_are_told_apart(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", " ", ""), ("c", None, "https://x/1"), ("d", "10.1/x", None)],
                                 "title string, doi string, url string")
    assert [r["title"] for r in ingest.with_identity(rows).orderBy("title").collect()] == ["c", "d"]
    assert [r["title"] for r in ingest.without_identity(rows).orderBy("title").collect()] == ["a", "b"]


BATCH = "source_ord int, seq int, title string, url string, doi string"


def test_upsert_is_idempotent_and_first_delivery_wins(spark):
    batch = ingest.with_identity(spark.createDataFrame([
        (1, 0, "late", "https://x/1", None), (0, 5, "early", "https://X/1/?ref=a", None),
        (0, 6, "by doi", "https://x/2", "10.1/A"), (2, 0, "same doi", None, " 10.1/a"),
        (3, 0, "third", "https://x/3", None)], BATCH))
    empty = spark.createDataFrame([], "id string")
    first = ingest.upsert_new(batch, empty)
    assert sorted(r["title"] for r in first.collect()) == ["by doi", "early", "third"]
    assert ingest.upsert_new(batch, first).count() == 0


def test_keep_first_needs_no_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 9)], "k string, s int")
    assert sorted(map(tuple, keep_first(df, ["k"], ["s"]).collect())) == [("a", 1), ("b", 9)]


def test_evolve_adds_late_columns_once(spark):
    old = spark.createDataFrame([("o", "older")], "id string, title string")
    new = spark.createDataFrame([("n", "new", "Marine Letters", 0, "dropped")],
                                "id string, title string, venue string, is_preprint int, org string")
    merged = ingest.conform(ingest.evolve(old, new))
    assert merged.columns == ITEM.fieldNames()
    got = {r["id"]: (r["title"], r["venue"], r["is_preprint"]) for r in merged.collect()}
    assert got == {"o": ("older", None, None), "n": ("new", "Marine Letters", 0)}
    assert ingest.conform(merged).columns == merged.columns


def test_union_and_counts_list_silent_sources(spark):
    frames = {"a": spark.createDataFrame([("t",)], "title string"),
              "b": spark.createDataFrame([("u", "v")], "url string, venue string")}
    both = ingest.union_sources(frames)
    assert {(r["collector"], r["source_ord"], r["title"], r["url"]) for r in both.collect()} == {
        ("a", 0, "t", None), ("b", 1, None, "u")}
    counts = {r["collector"]: (r["fetched"], r["note"]) for r in ingest.source_counts(both, ["a", "b", "c"]).collect()}
    assert counts == {"a": (1, "1 items"), "b": (1, "1 items"), "c": (0, "0 items")}


def test_near_duplicate_titles(spark):
    df = spark.createDataFrame([("1", "A  Title"), ("2", "a title "), ("3", "other"), ("4", ""), ("5", " ")],
                               "id string, title string")
    assert [tuple(r) for r in ingest.near_duplicate_titles(df).collect()] == [("a title", 2, "1")]


def test_latest_value_last_write_wins(spark):
    df = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("j", "x", 1)], "key string, value string, ts int")
    assert {r["key"]: r["value"] for r in ingest.latest_value(df).collect()} == {"k": "new", "j": "x"}
