import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from fieldscope.plans import digest, reports
from fieldscope.plans.sweep import SweepSettings, sweep
from fieldscope.schemas import ITEM, SCORE
from fieldscope.settings import DEFAULT_WORKSTREAMS, ReportSettings, TermModel

NOW = dt.datetime(2024, 3, 20, 12)
COLUMNS = ("id string, source string, title string, url string, venue string, is_preprint int, source_type string, "
           "published_at date, fetched_at timestamp, score int, tag string, rationale string")


def day(n):
    return NOW.date() - dt.timedelta(days=n)


def hours(n):
    return NOW - dt.timedelta(hours=n)


def row(id, score, source="arxiv", published=None, fetched=None, tag="methods", **more):
    base = dict(id=id, source=source, title=f"title {id}", url=f"https://d/{id}", venue=None, is_preprint=None,
                source_type="paper", published_at=published, fetched_at=fetched or hours(1), score=score, tag=tag, rationale="w")
    base.update(more)
    return base


def table(spark, *rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_listing_hides_library_rows_and_orders_newest_first(spark):
    scored = table(spark, row("old", 9, published=day(5)), row("new", 6, published=day(1)), row("best", 9, published=day(1)),
                   row("low", 5, published=day(1)), row("mine", 9, source="Library: cites", published=day(1)),
                   row("anon", 7, source=None, published=day(2)), row("unscored", None, published=day(1)))
    listing = reports.dashboard_listing(scored, NOW)
    assert ids(listing) == ["best", "new", "anon", "old"]
    assert "TakeOrderedAndProject" in plan_of(listing)


def test_a_date_on_the_cutoff_day_is_out_and_unknown_dates_fall_back(spark):
    scored = table(spark, row("edge", 9, published=day(14)), row("in", 9, published=day(13)),
                   row("fetched", 9, fetched=hours(14 * 24)), row("stale", 9, fetched=hours(14 * 24) - dt.timedelta(seconds=1)))
    assert set(ids(reports.dashboard_listing(scored, NOW))) == {"in", "fetched"}


def test_top_picks_order_window_and_limit(spark):
    scored = table(spark, *[row(f"r{n}", 8 + n % 3, published=day(n % 2)) for n in range(12)],
                   row("before", 10, published=day(2)), row("low", 7, published=day(0)))
    got = reports.top_picks(scored, NOW)
    expected = sorted((f"r{n}" for n in range(12)), key=lambda i: (-(8 + int(i[1:]) % 3), int(i[1:]) % 2, i))[:8]
    assert ids(got) == expected


def test_display_shape(spark):
    scored = table(spark, row("a", 9, published=day(1), venue="Marine Letters", tag="captive-coal"),
                   row("b", 7, source="feed", is_preprint=1, tag="mystery", title=None), row("c", None, tag=None, rationale=None))
    got = {r["id"]: r for r in reports.display_shape(scored, DEFAULT_WORKSTREAMS).collect()}
    assert (got["a"]["source"], got["a"]["tag_label"], got["a"]["tag_color"], got["a"]["date"]) == (
        "Marine Letters", "Captive coal", "#CC3311", str(day(1)))
    assert (got["b"]["source"], got["b"]["tag_label"], got["b"]["tag_color"], got["b"]["title"]) == (
        "feed (preprint)", "mystery", "#888888", "")
    assert (got["c"]["score"], got["c"]["tag_label"], got["c"]["rationale"], got["c"]["date"]) == (
        0, "none", "", "2024-03-20T11:00:00Z")


def test_latest_scorer_ignores_rejections(spark):
    scores = spark.createDataFrame([("1", hours(3), "groq"), ("2", hours(1), "prefilter"), ("3", hours(2), "keyword"), ("4", hours(0), None)],
                                   "id string, scored_at timestamp, scorer string")
    assert reports.latest_scorer(scores).first()["scorer"] == "keyword"
    assert reports.latest_scorer(scores.filter(F.lit(False))).first()["scorer"] == "keyword"


def test_composition(spark):
    scored = table(spark, row("a", 9, published=day(1), is_preprint=1), row("b", 9, published=day(1), is_preprint=0),
                   row("c", 9, published=day(1), is_preprint=0), row("d", 9, published=day(1), source_type="news"))
    got = {r["venue_class"]: (r["n"], r["share_pct"]) for r in reports.shown_composition(scored, NOW).collect()}
    assert got == {"preprint": (1, 25), "peer-reviewed": (2, 50), "news": (1, 25)}


def test_headlines(spark):
    scored = table(spark, row("a", 6), row("b", 9), row("c", 7))
    assert reports.headline_list(scored, 2).first()["text"] == "- title b\n- title c"


def test_digest_floor_falls_back():
    assert ReportSettings().digest_floor == 6
    assert ReportSettings(digest_min_score=0).digest_floor == 6
    assert ReportSettings(digest_min_score=8).digest_floor == 8


@pytest.mark.parametrize("floor, expected", [(None, {"strong", "edge"}), (8, {"strong"}), (10, set())])
def test_digest_rows_clear_the_floor(spark, floor, expected):
    scored = table(spark, row("strong", 9), row("edge", 6), row("weak", 5), row("mine", 9, source="library: x"),
                   row("old", 9, fetched=hours(37)))
    cfg = ReportSettings(digest_min_score=floor)
    rows = digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS, cfg)
    assert set(ids(rows)) == expected
    header = digest.digest_header(rows, reports.library_shortlist(scored, NOW, ReportSettings(digest_min_score=10)), NOW)
    assert [r["n"] for r in header.collect()] == ([len(expected)] if expected else [])


def test_digest_since_the_last_one(spark):
    scored = table(spark, row("new", 9, fetched=hours(2)), row("sent", 9, fetched=hours(5)))
    assert ids(digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS, last_sent=hours(3))) == ["new"]
    assert len(ids(digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS, last_sent=hours(300)))) == 2


def test_digest_groups_follow_the_configuration(spark):
    scored = table(spark, row("a", 9, tag="methods"), row("b", 9, tag="chapter3"), row("c", 9, tag="none"),
                   row("d", 9, tag=None), row("e", 9, tag="gone"))
    groups = digest.digest_groups(digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS))
    assert [(r["group_label"], r["n"]) for r in groups.collect()] == [("chapter3", 1), ("Methods & tools", 1), ("Other", 3)]


def test_library_rows_are_in_the_shortlist_only(spark):
    scored = table(spark, row("l", 9, source="library: cites your library"), row("x", 9))
    assert ids(reports.library_shortlist(scored, NOW)) == ["l"]
    assert ids(digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS)) == ["x"]


def test_digest_text_reads_top_down(spark):
    scored = table(spark, row("l", 9, source="library: y"), row("a", 7, tag="methods"), row("b", 9, tag="methods"), row("c", 8, tag="zzz"))
    rows = digest.digest_rows(scored, NOW, DEFAULT_WORKSTREAMS)
    failing = spark.createDataFrame([("s2",), ("s1",)], "source string")
    lines = [r["line"].split("\n")[0] for r in digest.digest_text(
        rows, digest.library_lines(scored, NOW), failing, NOW, "RADAR").collect()]
    assert lines == ["RADAR — 2024-03-20", "== From your library · top 1 ==", "[9] title l — library: y",
                     "== Methods & tools ==", "[9] title b — arxiv", "[7] title a — arxiv", "== Other ==",
                     "[8] title c — arxiv", "Source failures (3 consecutive): s1, s2"]


def test_whole_sweep(spark):
    collected = spark.createDataFrame([
        (0, 0, "A GPU on the tide", "https://x/1", "10.1/a", "paper", "", 0), (0, 1, "again", None, "10.1/A", "paper", "t", 0),
        (1, 0, "trains", "https://x/2", None, "news", "", None), (1, 1, "nowhere", None, None, "news", "", None)],
        "source_ord int, seq int, title string, url string, doi string, source_type string, summary string, is_preprint int"
    ).select("*", F.lit("feed").alias("source"), F.lit(None).cast("date").alias("published_at"),
             F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("v").alias("venue"),
             F.lit(None).cast("int").alias("prefilter_hits"))
    model = TermModel(topic=("tide",), tags={"methods": ("gpu", "solver")})
    cfg = SweepSettings(model=model)
    abstracts = spark.createDataFrame([("10.1/a", "a solver")], "doi string, abstract string")
    items, scores = spark.createDataFrame([], ITEM), spark.createDataFrame([], SCORE)
    out = sweep(collected, items, scores, abstracts, NOW, cfg)
    assert out["new_items"].columns == ITEM.fieldNames()
    assert {(r["title"], r["summary"]) for r in out["new_items"].collect()} == {("A GPU on the tide", "a solver"), ("trains", "")}
    assert {(r["score"], r["scorer"]) for r in out["new_scores"].collect()} == {(8, "keyword"), (0, "prefilter")}
    assert [r["title"] for r in out["listing"].collect()] == ["A GPU on the tide"]
    assert out["kept"].count() == 2
    log = {r["source"]: (r["fetched"], r["note"]) for r in out["run_log"].collect()}
    assert log == {"feed": (4, "4 items"), "abstract backfill": (1, "1 of 1 filled"), "without identity": (1, "1 items"),
                   "scoring": (1, "1 scored, 1 prefiltered, 0 deferred")}
    assert [r["title"] for r in out["rejected"].collect()] == ["nowhere"]
    assert out["latest_scorer"].first()["scorer"] == "keyword"
    assert [r["title"] for r in out["digest_rows"].collect()] == ["A GPU on the tide"]
    assert out["digest_header"].first()["n"] == 1 and out["shortlist"].count() == 0 and out["discovered"].count() == 0
    runs = out["run_log"].withColumns({"ok": F.lit(0), "run_at": F.col("run_at") - F.expr("INTERVAL 1 DAY")})
    earlier = runs.unionByName(runs.withColumn("run_at", F.col("run_at") - F.expr("INTERVAL 90 DAY")))
    broken = spark.createDataFrame([("gone", 0, NOW)] * 3, "source string, ok int, at string").select(
        "source", "ok", F.col("at").cast("timestamp").alias("run_at"))
    again = sweep(collected, out["new_items"], out["new_scores"], abstracts, NOW, cfg,
                  runs=earlier.unionByName(broken, allowMissingColumns=True))
    assert again["new_items"].count() == 0 and again["new_scores"].count() == 0
    assert [r["source"] for r in again["failing"].collect()] == ["gone"]      # the others succeeded now
    assert again["kept_runs"].count() == 4 + 3 + 4
