import datetime as dt

from pyspark.sql import functions as F

from conftest import plan_of
from fieldscope.operators.ingest import with_identity
from fieldscope.operators.scoring import unscored
from fieldscope.schemas import ITEM, META, RUN, SCORE
from fieldscope.sources import tables

NOW = "2024-03-20 12:00:00"


def batch(spark, *rows):
    df = spark.createDataFrame(list(rows), "source_ord int, seq int, title string, url string, doi string, published_at date")
    return with_identity(df)


def test_items_are_inserted_once(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = batch(spark, (0, 0, "a", "https://x/1", None, dt.date(2024, 1, 2)), (0, 1, "b", "https://x/2", None, None),
                 (0, 2, "a again", "https://X/1/", None, None))
    assert tables.append_items(rows, path, NOW) == 2
    assert tables.append_items(rows, path, NOW) == 0
    more = batch(spark, (0, 0, "changed", "https://x/1", None, None), (0, 1, "c", "https://x/3", None, None))
    assert tables.append_items(more, path, NOW) == 1
    stored = tables.read_table(spark, path, ITEM)
    assert {r["title"] for r in stored.collect()} == {"a", "b", "c"}        # stored rows are never changed
    assert {str(r["fetched_at"]) for r in stored.collect()} == {NOW}
    recent = tables.read_items(spark, path, effective_since="2024-03-01")
    assert {r["title"] for r in recent.collect()} == {"b", "c"}
    assert "PartitionFilters: [isnotnull(month" in plan_of(recent)
    months = {r["month"] for r in spark.read.parquet(path).select("month").collect()}
    assert months == {"2024-01", "2024-03"}


def test_known_ids_can_be_bounded_by_a_look_back(spark, tmp_path):
    path = str(tmp_path / "items")
    old = batch(spark, (0, 0, "old", "https://x/1", None, dt.date(2023, 1, 2)), (0, 1, "new", "https://x/2", None, dt.date(2024, 3, 2)))
    assert tables.append_items(old, path, NOW, known_since="2024-01-01") == 2
    assert tables.append_items(old, path, NOW, known_since="2022-12-31") == 0
    assert tables.append_items(old.filter("title = 'new'"), path, NOW, known_since="2024-01-01") == 0


def test_old_files_without_late_columns(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([("old", "t")], "id string, title string").write.parquet(path)
    rows = batch(spark, (0, 0, "n", "https://x/9", None, None)).withColumn("venue", F.lit("Joule"))
    tables.append_items(rows, str(tmp_path / "new"), NOW)
    merged = tables.read_table(spark, path, ITEM).unionByName(tables.read_table(spark, str(tmp_path / "new"), ITEM))
    assert {(r["title"], r["venue"]) for r in merged.collect()} == {("t", None), ("n", "Joule")}


def test_scores_append_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    results = spark.createDataFrame([("1", 5, 0), ("1", 9, 1), ("2", 3, 0)], "id string, score int, at int")
    tables.append_scores(results, path, ["at"])
    tables.append_scores(results.withColumn("score", F.lit(0)), path, ["at"])
    assert {(r["id"], r["score"]) for r in tables.read_table(spark, path, SCORE).collect()} == {("1", 5), ("2", 3)}


def test_run_log_and_marks(spark, tmp_path):
    log = spark.createDataFrame([("a", 3, 1, "3 items"), ("b", 0, 0, "boom")], "source string, fetched long, ok int, note string")
    tables.append_runs(log, str(tmp_path / "runs"), NOW)
    tables.append_runs(log, str(tmp_path / "runs"), "2024-03-21 12:00:00")
    runs = tables.read_table(spark, str(tmp_path / "runs"), RUN)
    assert runs.count() == 4 and {str(r["run_at"]) for r in runs.collect()} == {NOW, "2024-03-21 12:00:00"}

    meta = str(tmp_path / "meta")
    tables.put_meta(spark, meta, "last_digest_sent_at", "first", "2024-03-01 00:00:00")
    tables.put_meta(spark, meta, "last_digest_sent_at", "second", "2024-03-02 00:00:00")
    tables.advance_marks(log, {"a": "last_a_run", "b": "last_b_run"}, meta, NOW)      # b failed
    assert {r["key"]: r["value"] for r in tables.get_meta(spark, meta).collect()} == {
        "last_digest_sent_at": "second", "last_a_run": NOW}


def test_missing_table_is_empty(spark, tmp_path):
    for schema in (ITEM, SCORE, RUN, META):
        table = tables.read_table(spark, str(tmp_path / "none"), schema)
        assert table.count() == 0 and table.columns == schema.fieldNames()


def test_snapshots_and_reports(spark, tmp_path):
    stored = batch(spark, (0, 0, "old", "https://x/1", None, dt.date(2024, 1, 2)), (0, 1, "new", "https://x/2", None, dt.date(2024, 3, 2)))
    tables.write_snapshot(stored.withColumn("score", F.lit(5)), str(tmp_path / "v2"))
    assert tables.read_items(spark, str(tmp_path / "v2")).count() == 2
    recent = tables.read_items(spark, str(tmp_path / "v2"), effective_since="2024-02-01")
    assert [r["title"] for r in recent.collect()] == ["new"] and recent.columns == ITEM.fieldNames()
    df = spark.createDataFrame([("b", 2), ("a", 1)], "line string, n int")
    tables.write_report(df.orderBy("n").select("line"), str(tmp_path / "text"), "text")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a", "b"]


def test_retention_rewrites_only_the_months_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = [(0, i, f"t{i}", f"https://x/{i}", None, day) for i, day in enumerate(
        [dt.date(2023, 1, 5), dt.date(2023, 2, 5), dt.date(2023, 2, 6), dt.date(2024, 3, 1), dt.date(2022, 7, 1)])]
    tables.append_items(batch(spark, *rows), path, NOW)
    ids = {r["title"]: r["id"] for r in tables.read_items(spark, path).collect()}
    scores = spark.createDataFrame([(ids["t0"], 9), (ids["t1"], 9), (ids["t2"], 1), (ids["t4"], 0)], "id string, score int")
    untouched = sorted(p.name for p in (tmp_path / "items" / "month=2023-01").iterdir())
    assert tables.prune_item_table(spark, path, scores, 6, NOW, 180) == ["2022-07", "2023-02"]
    assert sorted(r["title"] for r in tables.read_items(spark, path).collect()) == ["t0", "t1", "t3"]
    assert sorted(p.name for p in (tmp_path / "items" / "month=2023-01").iterdir()) == untouched
    assert not (tmp_path / "items" / "month=2022-07").exists()
    assert tables.prune_item_table(spark, path, scores, 6, NOW, 180) == []


def test_run_log_drops_whole_days(spark, tmp_path):
    path = str(tmp_path / "runs")
    log = spark.createDataFrame([("a", 3, 1, "3 items")], "source string, fetched long, ok int, note string")
    for day in ("2024-01-05 08:00:00", "2024-02-19 08:00:00", "2024-02-19 13:00:00", "2024-03-19 08:00:00"):
        tables.append_runs(log, path, day)
    assert tables.prune_run_table(spark, path, NOW, 30) == ["run_date=2024-01-05"]
    recent = tables.read_runs(spark, path, "2024-02-19 12:00:00")
    assert sorted(str(r["run_at"]) for r in recent.collect()) == ["2024-02-19 13:00:00", "2024-03-19 08:00:00"]
    assert "PartitionFilters: [isnotnull(run_date" in plan_of(recent)
    assert tables.read_runs(spark, path).count() == 3


def test_two_writes_at_one_time_have_one_winner(spark, tmp_path):
    meta = str(tmp_path / "meta")
    for value in ("b", "a"):
        tables.put_meta(spark, meta, "k", value, NOW)
    assert tables.get_meta(spark, meta).first()["value"] == "b"


def test_bucketed_tables_join_without_a_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed_items")
    spark.sql("DROP TABLE IF EXISTS bucketed_scores")
    items = spark.range(100).select(F.sha1(F.col("id").cast("string")).alias("id"), F.lit("t").alias("title"))
    tables.save_bucketed(items, "bucketed_items", 4)
    tables.save_bucketed(items.limit(40).select("id", F.lit(1).alias("score")), "bucketed_scores", 4)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        pending = unscored(spark.table("bucketed_items"), spark.table("bucketed_scores"))
        assert "Exchange" not in plan_of(pending)
        assert pending.count() == 60
    finally:
        spark.conf.set(key, before)
