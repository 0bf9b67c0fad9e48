import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldscope.streaming import health, sweep

START = dt.datetime(2024, 1, 1)
SCHEMA = "id string, n long, ts timestamp, kind string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def at(day, hour=0):
    return START + dt.timedelta(days=day, hours=hour)


def source(spark, folder, **options):
    return sweep.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, **options)


def run_sweep(spark, tmp_path):
    sweep.sweep_stream(source(spark, tmp_path / "in", max_files=1), str(tmp_path / "items"), str(tmp_path / "state"), ["n"])
    return sorted((r["id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "items")).collect())


def test_redelivery_adds_nothing(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", 2, at(0), "k"), ("a", 1, at(0), "k"), ("b", 3, at(0), "k")])
    assert run_sweep(spark, tmp_path) == [("a", 1), ("b", 3)]
    land(spark, tmp_path / "in", [("a", 0, at(1), "k"), ("c", 4, at(1), "k")])
    land(spark, tmp_path / "in", [("c", 5, at(2), "k"), ("d", 6, at(2), "k")])
    expected = [("a", 1), ("b", 3), ("c", 4), ("d", 6)]
    assert run_sweep(spark, tmp_path) == expected
    assert run_sweep(spark, tmp_path) == expected      # nothing new


def test_a_batch_run_again_writes_the_same_rows_once(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", 1, at(0), "k"), ("b", 2, at(0), "k")])
    first = run_sweep(spark, tmp_path)
    # The state of a job that failed after its write and before its commit.
    sweep.sweep_stream(source(spark, tmp_path / "in"), str(tmp_path / "items"), str(tmp_path / "state2"), ["n"])
    again = sorted((r["id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "items")).collect())
    assert again == first


def to_rows(spark, tmp_path, stream):
    sweep.run_to_end(stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
                     .option("checkpointLocation", str(tmp_path / "out_state")))
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()]


def test_dedupe_within_the_look_back(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", 1, at(0), "k"), ("a", 2, at(1), "k"), ("b", 3, at(1), "k")])
    land(spark, tmp_path / "in", [("a", 4, at(3), "k"), ("c", 5, at(3), "k")])
    rows = to_rows(spark, tmp_path, sweep.dedupe_stream(source(spark, tmp_path / "in", max_files=1), ["id"]))
    assert sorted(r[0] for r in rows) == ["a", "b", "c"]


@pytest.mark.parametrize("order", [(30, 31, 1), (31, 1, 30), (1, 30, 31)])
def test_late_ids_are_kept_however_files_arrive(spark, tmp_path, order):
    for day in order:
        land(spark, tmp_path / "in", [(f"i{day}", day, at(day), "k"), ("again", day, at(day), "k")])
    rows = to_rows(spark, tmp_path, sweep.dedupe_stream(source(spark, tmp_path / "in", max_files=1), ["id"]))
    assert sorted(r[0] for r in rows) == ["again", "i1", "i30", "i31"]


@pytest.mark.parametrize("files", [1, 4])
def test_daily_counts_equal_the_batch_result(spark, tmp_path, files):
    """All days, the open ones too, also when late rows come in a file of their own."""
    rows = [(f"i{n}", n, at(n * 7 % 6, n % 24), "k" if n % 2 else "l") for n in range(60)]
    for part in range(files):
        land(spark, tmp_path / "in", rows[part::files])
    counts = sweep.daily_counts(source(spark, tmp_path / "in", max_files=1), "ts", ["kind"])
    sweep.write_complete(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["day"], r["kind"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {}
    for r in rows:
        expected[r[2].date(), r[3]] = expected.get((r[2].date(), r[3]), 0) + 1
    assert got == expected


def test_live_failures_follow_the_newest_runs(spark, tmp_path):
    def runs(rows):
        spark.createDataFrame([(START + dt.timedelta(hours=h), s, ok, h) for h, s, ok in rows],
                              "run_at timestamp, source string, ok int, run_id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))

    def failing():
        schema = spark.read.parquet(str(tmp_path / "runs")).schema
        stream = sweep.read_stream(spark, str(tmp_path / "runs"), schema, max_files=1)
        health.failure_stream(stream, str(tmp_path / "latest"), str(tmp_path / "state"), tiebreak="run_id")
        return sorted(r["source"] for r in health.current_failures(spark, str(tmp_path / "latest"), schema, tiebreak="run_id").collect())

    runs([(0, "a", 0), (1, "a", 0), (0, "b", 0)])
    assert failing() == []
    runs([(2, "a", 0), (2, "b", 0)])
    runs([(3, "b", 0)])
    assert failing() == ["a", "b"]
    runs([(4, "a", 1)])
    assert failing() == ["b"]
    assert spark.read.parquet(str(tmp_path / "latest")).filter(F.col("batch_id") == 3).count() == 6
