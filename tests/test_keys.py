import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from fieldscope.sources import tables
from fieldscope.sources.keys import KeyStore
from fieldscope.streaming import sweep

START = dt.datetime(2024, 1, 1)
SCHEMA = "id string, n long, ts timestamp, kind string"


def store(spark, tmp_path, **options):
    return KeyStore(spark, f"file://{tmp_path}/keys", **{"buckets": 8, "merge_runs": 3, **options})


def ids(spark, values, month="2024-01"):
    return spark.createDataFrame([(v, month) for v in values], "id string, month string")


def filled(spark, tmp_path, **options):
    keys = store(spark, tmp_path, **options)
    for run in range(5):
        keys.merge()
        keys.add(ids(spark, [f"id{run}-{i}" for i in range(20)], f"2024-0{run + 1}"), run)
    return keys


def test_known_ids_go_and_others_stay(spark, tmp_path):
    keys = filled(spark, tmp_path)
    assert len(keys.tables()) == 2 and sum(t.count() for t in keys.tables()) == 100
    batch = ids(spark, ["id0-1", "id4-19", "new", "id2-0", "id2-x"])
    assert sorted(r.id for r in keys.without_known(batch).collect()) == ["id2-x", "new"]
    assert sorted(r.id for r in keys.without_known(batch, before=4).collect()) == ["id2-x", "id4-19", "new"]
    assert sorted(r.id for r in keys.without_known(batch, since="2024-03-10").collect()) == ["id0-1", "id2-x", "new"]
    unnamed = store(spark, tmp_path, named=0)
    assert sorted(r.id for r in unnamed.without_known(batch).collect()) == ["id2-x", "new"]


def test_an_empty_index_knows_nothing(spark, tmp_path):
    keys = store(spark, tmp_path)
    assert keys.next_run() == 0 and keys.without_known(ids(spark, ["a"])).count() == 1 and not keys.merge()
    keys.add(ids(spark, []), 0)
    assert keys.next_run() == 1 and keys.without_known(ids(spark, ["a"])).count() == 1


def test_stored_ids_are_not_shuffled(spark, tmp_path):
    keys = filled(spark, tmp_path, named=0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = keys.tables()[0]
        plan = plan_of(ids(spark, ["a", "b"]).join(base.select("id"), "id", "left_anti"))
        bounded = plan_of(keys.without_known(ids(spark, ["a"]), since="2024-02-15"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    side = plan[plan.index("FileScan") - 200:plan.index("FileScan")]
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Exchange" not in side
    assert "month" in bounded and "PartitionFilters: [isnotnull(month" in bounded


def test_a_few_ids_read_a_few_buckets(spark, tmp_path):
    keys = filled(spark, tmp_path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(keys.without_known(ids(spark, ["id0-1"])))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SelectedBucketsCount: 1 out of 8" in plan


def test_another_session_finds_the_buckets(spark, tmp_path):
    keys = filled(spark, tmp_path)
    for run in range(5):
        spark.sql(f"DROP TABLE IF EXISTS {keys._name(run)}")  # the catalog of a new cluster
    again = store(spark, tmp_path)
    assert [r.id for r in again.without_known(ids(spark, ["id0-1", "x"])).collect()] == ["x"]


def test_a_failed_merge_changes_nothing(spark, tmp_path):
    keys = filled(spark, tmp_path, merge_runs=99)
    os.makedirs(f"{tmp_path}/keys/base-{4:012d}/month=2024-01")  # no _SUCCESS
    assert len(keys.tables()) == 1
    keys.merge_runs = 5
    assert keys.merge() and [t.count() for t in keys.tables()] == [100]
    assert [os.path.basename(p) for p in glob.glob(f"{tmp_path}/keys/*")] == [f"base-{4:012d}"]


def test_a_merge_leaves_larger_bases_as_they_are(spark, tmp_path):
    keys = store(spark, tmp_path, merge_runs=1, small=0)

    def add(run, values):
        keys.add(ids(spark, values), run)
        assert keys.merge()
        return sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/keys/*"))

    first = add(0, [f"{i * 7919:09d}x" for i in range(20000)])
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/keys/base-*/month=*/*.parquet")}
    for run in range(1, 4):
        assert add(run, [f"s{run}-{i}" for i in range(5)]) == [*first, f"base-{run:012d}"]
    assert files and all(os.path.getmtime(f) == at for f, at in files.items())
    assert sum(t.count() for t in keys.tables()) == 20015
    asked = ids(spark, [f"{7919:09d}x", "s1-0", "s2-4", "s3-1", "new"])
    for again in (keys, store(spark, tmp_path, small=0, named=0)):
        assert [r.id for r in again.without_known(asked).collect()] == ["new"]
    assert add(4, [f"{i * 7919:09d}y" for i in range(30000)]) == [f"base-{4:012d}"]
    assert sum(t.count() for t in keys.tables()) == 50015


def item(i, day, title="t"):
    return (f"id{i}", title, START.date() + dt.timedelta(days=day), 0, i)


def test_indexed_appends_equal_plain_ones(spark, tmp_path):
    schema = "id string, title string, published_at date, source_ord int, seq int"
    batches = [[item(i % 30, 10 * k + i % 7, f"{k}") for i in range(k * 9, k * 9 + 25)] for k in range(5)]
    keys = store(spark, tmp_path, merge_runs=2)
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        counts = {tables.append_items(df, f"file://{tmp_path}/plain", START), tables.append_items(df, f"file://{tmp_path}/indexed", START, keys=keys)}
        assert len(counts) == 1
    both = [sorted((r.id, r.title, r.published_at) for r in tables.read_items(spark, f"file://{tmp_path}/{name}").collect())
            for name in ("plain", "indexed")]
    assert both[0] == both[1] and len(both[0]) == 30
    # A sweep that failed after its items: the index learns of them.
    tables.append_items(spark.createDataFrame([item(99, 3)], schema), f"file://{tmp_path}/indexed", START)
    keys.catch_up(tables.stored_ids(spark, f"file://{tmp_path}/indexed"))
    assert tables.append_items(spark.createDataFrame([item(99, 3)], schema), f"file://{tmp_path}/indexed", START, keys=keys) == 0


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def at(day):
    return START + dt.timedelta(days=day)


def source(spark, folder):
    return sweep.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, max_files=1)


def run_sweep(spark, tmp_path, state="state", **options):
    keys = store(spark, tmp_path, merge_runs=2)
    sweep.sweep_indexed(source(spark, tmp_path / "in"), f"{tmp_path}/items", f"{tmp_path}/{state}", ["n"], keys, "ts", **options)
    return sorted((r["id"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/items").collect())


@pytest.mark.parametrize("look_back", [None, "7 days"])
def test_indexed_sweeps_store_each_id_once(spark, tmp_path, look_back):
    land(spark, tmp_path / "in", [("a", 2, at(0), "k"), ("b", 3, at(0), "k"), ("a", 1, at(0), "k")])
    first = run_sweep(spark, tmp_path, look_back=look_back)
    assert [r[0] for r in first] == ["a", "b"]
    for k in range(6):
        land(spark, tmp_path / "in", [("a", 0, at(40 * k), "k"), (f"c{k}", 4, at(-k), "k"), (f"c{k - 1}", 9, at(k), "k")])
    rows = run_sweep(spark, tmp_path, look_back=look_back)
    assert [r[0] for r in rows] == ["a", "b", "c-1", *[f"c{k}" for k in range(6)]] and rows[0] == first[0]
    assert run_sweep(spark, tmp_path, look_back=look_back) == rows
    assert len(glob.glob(f"{tmp_path}/keys/base-*")) == 1 and len(glob.glob(f"{tmp_path}/keys/run-*")) <= 3


def test_a_batch_that_runs_again_stores_the_same(spark, tmp_path):
    land(spark, tmp_path / "in", [("a", 1, at(0), "k"), ("b", 2, at(0), "k")])
    first = run_sweep(spark, tmp_path)
    assert run_sweep(spark, tmp_path, state="state2") == first  # batch 0 once more: it failed before its commit


def test_a_batch_runs_its_state_once_and_meets_the_buckets(spark, tmp_path, monkeypatch):
    land(spark, tmp_path / "in", [("a", 1, at(0), "k"), ("b", 2, at(0), "k"), ("a", 3, at(0), "k")])
    land(spark, tmp_path / "in", [("a", 4, at(1), "k"), ("c", 5, at(1), "k")])
    read, plans, real = spark.sparkContext.accumulator(0), [], KeyStore.without_known

    def without_known(*args, **options):
        found = real(*args, **options)
        plans.append(plan_of(found))
        return found

    monkeypatch.setattr(KeyStore, "without_known", without_known)
    seen = F.udf(lambda n: read.add(1) or n, "long").asNondeterministic()
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        stream, keys = source(spark, tmp_path / "in").withColumn("n", seen("n")), store(spark, tmp_path, merge_runs=1)
        sweep.sweep_indexed(stream, f"{tmp_path}/items", f"{tmp_path}/state", ["n"], keys, "ts", look_back="7 days")
        assert {k: spark.conf.get(k) for k in options} == options
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/items").collect()) == ["a", "b", "c"]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/state/state/0/[0-9]*")) == [str(n) for n in range(8)]
    assert read.value == 5 and not spark.sparkContext._jsc.getPersistentRDDs()
    base = plans[1].index("FileScan parquet spark_catalog")
    assert "Bucketed: true" in plans[1] and "Exchange" not in plans[1][base - 200:base]


def test_state_is_bounded_and_the_index_has_the_rest(spark, tmp_path):
    """What comes again after the look-back passes the state and is stopped by the index; what was published long ago passes both."""
    arrived = F.col("ts")
    for day, rows in [(0, ["a", "b"]), (3, ["a", "c"]), (30, ["d"]), (31, ["e"]), (60, ["a", "f"])]:
        land(spark, tmp_path / "in", [(i, day, at(day), "k") for i in rows])
    out = sweep.dedupe_recent(source(spark, tmp_path / "in"), ["id"], "7 days", arrived)
    query = sweep.run_to_end(out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s"))
    seen = sorted(r.id for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert seen == ["a", "a", "b", "c", "d", "e", "f"]
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
    rows = run_sweep(spark, tmp_path, look_back="7 days", arrived=arrived)
    assert rows == [("a", 0), ("b", 0), ("c", 3), ("d", 30), ("e", 31), ("f", 60)]


def test_days_that_do_not_change_keep_their_files(spark, tmp_path):
    table = f"{tmp_path}/days"

    def turn():
        counts = sweep.daily_counts(source(spark, tmp_path / "in"), "ts", ["kind"])
        sweep.write_days(counts, table, f"{tmp_path}/state", ["kind"])
        rows = sweep.read_days(spark, table, counts.schema).collect()
        return {(r.day.day, r.kind): r.n for r in rows}, {f: os.path.getmtime(f) for f in glob.glob(f"{table}/day=*/version=*/*.parquet")}

    land(spark, tmp_path / "in", [("a", 1, at(0), "k"), ("b", 1, at(0), "l"), ("c", 1, at(1), "k"), ("d", 1, at(2), "k")])
    counts, files = turn()
    assert counts == {(1, "k"): 1, (1, "l"): 1, (2, "k"): 1, (3, "k"): 1}
    land(spark, tmp_path / "in", [("e", 1, at(0), "k"), ("f", 1, at(3), "m")])
    land(spark, tmp_path / "in", [("g", 1, at(0), "n")])
    counts, after = turn()
    assert counts == {(1, "k"): 2, (1, "l"): 1, (1, "n"): 1, (2, "k"): 1, (3, "k"): 1, (4, "m"): 1}
    untouched = [f for f in files if "day=2024-01-02" in f or "day=2024-01-03" in f]
    assert untouched and all(after[f] == files[f] for f in untouched)
    assert {f.split("version=")[1][0] for f in after if "day=2024-01-01" in f} == {"1", "2"}  # the newest version and the one before
