import json
import random

from pyspark.sql import functions as F

from fieldscope.sources import landed, library, registry


def test_files_are_parsed_in_tasks(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"title": f"é{i}-{k}", "n": k, "more": 1}) for k in range(i)) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden").write_text("no JSON")
    df = landed.read_landed(spark, f"file://{tmp_path}", landed.json_lines, "n long, title string, absent string", 100)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.n, r.title, r.absent) for r in rows) == sorted((k, f"é{i}-{k}", None) for i in range(6) for k in range(i))
    assert len({r.task for r in rows}) >= 2


def test_notes_with_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("Title: On: grids\nvenue: x\nno colon\n\nbody\n\nmore")
    df = landed.read_landed(spark, str(tmp_path), landed.front_matter, "title string, venue string, body string")
    assert [tuple(r) for r in df.collect()] == [("On: grids", "x", "body\n\nmore")]


def test_a_plug_in_that_fails_is_a_record(spark, tmp_path):
    for name, text in (("good", '{"title": "a"}\n'), ("bad", "{broken\n"), ("empty", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(text)

    def collector(name, parser=landed.json_lines):
        return lambda s: landed.read_landed(s, str(tmp_path / name), parser, "title string")

    found = {"good": collector("good"), "bad": collector("bad"), "missing": collector("missing"), "empty": collector("empty"),
             "unknown": collector("good", lambda name, data: [{"title": 1 // 0}])}
    items, log = registry.collect_all(spark, found, str(tmp_path / "staging"))
    assert [(r.collector, r.title, r.source_ord) for r in items.collect()] == [("good", "a", 0)]
    assert [(r.source, r.fetched, r.ok) for r in log.collect()] == [
        ("good", 1, 1), ("bad", 0, 0), ("missing", 0, 0), ("empty", 0, 1), ("unknown", 0, 0)]


def test_one_export_is_read_by_many_tasks(spark, tmp_path):
    pick = random.Random(1)
    entries = [f"@article{{k{i},\r\n title={{{'long ' * pick.randint(0, 60)}}},\n doi =\n{{10.5/{i % 300}}}\n}}" for i in range(900)]
    (tmp_path / "library.bib").write_text("% exported\n" + "\n".join(entries), encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = library.read_bib_entries(spark, str(tmp_path))
        assert split.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 5
        assert split.filter("value LIKE 'article%'").count() == 900
        found = [r.doi for r in library.dois_from_bib(split).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert found == [r.doi for r in library.dois_from_bib(library.read_bib(spark, str(tmp_path))).orderBy("seq").collect()]
    assert found == [f"10.5/{i}" for i in range(300)]


def test_export_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace
    from fieldscope.workload import adapters
    monkeypatch.setattr(adapters, "BIB_ROWS", 10, raising=False)
    orders = spark.range(95).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey")
    adapters.land_bib(SimpleNamespace(orders=orders), str(tmp_path / "bib"))
    files = sorted((tmp_path / "bib").glob("part-*"))
    assert len(files) == 10
    assert [int(x.split("{k")[1].split(",")[0]) for f in files for x in f.read_text().split("@")[1:]] == list(range(95))
