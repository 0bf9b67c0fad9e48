import datetime as dt

from pyspark.sql import functions as F

from fieldscope.operators import health, journals, retention

NOW = dt.datetime(2024, 3, 1, 12)
RUNS = "run_at timestamp, source string, ok int, n int"


def days_ago(n):
    return NOW - dt.timedelta(days=n)


def test_failing_sources_need_a_full_streak(spark):
    runs = spark.createDataFrame(
        [(days_ago(d), "down", 0, d) for d in range(3)] + [(days_ago(9), "down", 1, 9)]
        + [(days_ago(d), "short", 0, d) for d in range(2)]
        + [(days_ago(0), "back", 1, 0), (days_ago(1), "back", 0, 1), (days_ago(2), "back", 0, 2)], RUNS)
    assert [r["source"] for r in health.failing_sources(runs).collect()] == ["down"]
    recent = health.last_n_runs(runs, 2)
    assert {(r["source"], r["n"], r["recency"]) for r in recent.collect() if r["source"] == "down"} == {("down", 0, 1), ("down", 1, 2)}


def test_pruning_the_log_keeps_failure_detection(spark):
    runs = spark.createDataFrame([(days_ago(90), "harbour", 0, i) for i in range(5)]
                                 + [(days_ago(i), "harbour", 0, i) for i in range(3)], RUNS)
    kept = retention.prune_runs(runs, NOW)
    assert kept.count() == 3
    assert [r["source"] for r in health.failing_sources(kept).collect()] == ["harbour"]


def test_prune_keeps_the_relevant_and_the_recent(spark):
    day = NOW.date() - dt.timedelta(days=180)           # the cutoff's own day
    rows = [("high", 6, dt.date(2020, 1, 1), None), ("low", 5, dt.date(2020, 1, 1), None),
            ("unscored", None, dt.date(2020, 1, 1), None), ("edge", 0, day, None),
            ("after", 0, day + dt.timedelta(days=1), None),
            ("fetched", 0, None, days_ago(180)), ("stale", 0, None, days_ago(180) - dt.timedelta(seconds=1)),
            ("undated", 0, None, None)]
    items = spark.createDataFrame(rows, "id string, score int, published_at date, fetched_at timestamp")
    kept = {r["id"] for r in retention.prune_items(items, 6, NOW).collect()}
    assert kept == {"high", "after", "fetched", "undated"}
    dropped = items.filter(~retention.keeps_item(6, NOW, 180))
    assert {r["id"] for r in dropped.collect()} == {r[0] for r in rows} - kept


JOURNALS = "display_name string, issn_l string, works_count long"


def test_audit_flags_dead_issns(spark):
    known = spark.createDataFrame([("Tides", "1111-0001", 10), ("Tides (old)", "1111-0001", 3), ("Waves", "1111-0002", None)], JOURNALS)
    audit = journals.watchlist_audit(known, ["1111-0001", "1111-0002", "0000-0000"])
    got = {r["issn"]: (r["status"], r["name"], r["works"]) for r in audit.collect()}
    assert got == {"1111-0001": ("ok", "Tides", 10), "1111-0002": ("ok", "Waves", 0), "0000-0000": ("DEAD", "?", 0)}
    assert journals.dead_count(audit).first()["dead"] == 1


def test_lookup_lists_near_names_best_first(spark):
    known = spark.createDataFrame([
        ("Letters of Marine Tidal Science", "1111-0001", 700), ("Marine Science", "1111-0002", 900),
        ("New Marine Science", "1111-0003", 40), ("Marine Science Stacks", None, 5), ("Botany", "1", 1)], JOURNALS)
    got = [(r["query"], r["status"], r["issn"]) for r in
           journals.journal_lookup(known, ["marine  science", "Quantum"]).orderBy("query", "position").collect()]
    assert got == [("Quantum", "no match", None), ("marine  science", "match", "1111-0002"),
                   ("marine  science", "match", "1111-0003"), ("marine  science", "match", "1111-0001")]


def test_lookup_limit_counts_journals_without_issn(spark):
    known = spark.createDataFrame([("Waves", None, 9), ("Waves One", "1", 1)], JOURNALS)
    assert journals.journal_lookup(known, ["Waves"], limit=1).first()["status"] == "no match"
    assert journals.journal_lookup(known.filter(F.lit(False)), ["Waves"]).first()["status"] == "no match"
