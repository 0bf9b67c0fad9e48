import json

import pytest
from pyspark.sql import functions as F

from fieldscope.operators import external
from fieldscope.settings import VenueWeights

ITEMS = ("id string, title string, summary string, venue string, is_preprint int, "
         "published_at date, fetched_at timestamp")


def items(spark, *rows):
    return spark.createDataFrame([(r + (None,) * 7)[:7] for r in rows], ITEMS)


def ingest(spark, texts, requested, rows, tags=("methods",), weights=None, **more):
    replies = spark.createDataFrame(list(enumerate(texts)), "batch_id long, text string")
    asked = spark.createDataFrame(requested, "batch_id long, id string")
    out = external.ingest_scores(replies, asked, items(spark, *rows), tags, "remote", weights, **more)
    return [(r["id"], r["score"], r["tag"], r["rationale"]) for r in sorted(out.collect(), key=lambda r: (r["batch_id"], r["pos"]))]


def test_payload_leaves_out_what_is_unknown(spark):
    rows = {r["id"]: json.loads(r["p"]) for r in items(
        spark, ("1", 'T "q" é\n', "s" * 1100, "Joule", 0), ("2", "t", None, "", None), ("3", None, " \t", None, 1),
    ).select("id", external.payload(summary_limit=1000).alias("p")).collect()}
    assert rows["1"] == {"id": "1", "title": 'T "q" é\n', "summary": "s" * 1000, "venue": "Joule", "peer_reviewed": True}
    assert rows["2"] == {"id": "2", "title": "t", "summary": "", "note": external.NO_ABSTRACT_NOTE}
    assert rows["3"] == {"id": "3", "title": "", "summary": " \t", "peer_reviewed": False, "note": external.NO_ABSTRACT_NOTE}


def test_fences_ghost_ids_and_unknown_tags(spark):
    array = json.dumps([{"id": "b", "score": 2, "tag": "gardening", "why": "off"}, {"id": "stray", "score": 8, "tag": "methods"},
                        {"id": "a", "score": 7, "tag": "methods", "why": "fits"}], indent=1)
    text = f"```json\n{array}\n```"
    got = ingest(spark, [text], [(0, "a"), (0, "b"), (1, "stray")], [("a", "t1", ""), ("b", "t2", "")])
    assert got == [("b", 2, "none", "off"), ("a", 7, "methods", "fits")]


@pytest.mark.parametrize("score, expected", [
    ("9", 9), ('"9"', 9), ('" 9 "', 9), ('"+7"', 7), ('"1_0"', 10), ("7.9", 7), ('"7.9"', 0), ("-0.5", 0),
    ("true", 1), ("false", 0), ("null", 0), ("[1]", 0), ("{}", 0), ('"x"', 0), ("1e3", 10), ("-4", 0),
    ("123456789012345678901234567890", 10)])
def test_scores_as_models_write_them(spark, score, expected):
    got = ingest(spark, ['[{"id": "a", "score": %s}]' % score], [(0, "a")], [("a", "t", "")])
    assert got == [("a", expected, "none", "")]


def test_bad_replies_cost_their_own_batch_only(spark):
    texts = ["no array here", "[{broken", None, '{"id": "a"}', 'Sure: [1, "x", null, {"id": "a", "rationale": "r", "why": ""}] done',
             '[{"id": 5, "score": 3}]', "][", '[]']
    got = ingest(spark, texts, [(n, "a") for n in range(8)] + [(5, "5")], [("a", "t", "")])
    assert got == [("a", 0, "none", "r")]


def test_venue_step_recuts_the_rationale(spark):
    text = json.dumps([{"id": "a", "score": 10, "tag": "methods", "why": "w" * 400}])
    got = ingest(spark, [text], [(0, "a")], [("a", "t", "", None, 0)], weights=VenueWeights(), rationale_limit=280)
    assert got == [("a", 10, "methods", "w" * 280)]
    whole = ingest(spark, [text], [(0, "a")], [("a", "t", "", None, 0)], weights=VenueWeights())
    assert whole == [("a", 10, "methods", "w" * 400 + " [peer-reviewed, no abstract available +2]")]
    text = json.dumps([{"id": "a", "score": 1, "why": "w"}])
    assert ingest(spark, [text], [(0, "a")], [("a", "t", "x", None, 1)], weights=VenueWeights()) == [
        ("a", 0, "none", "w [preprint -1]")]


def many(spark, n):
    return spark.range(n).select(
        F.format_string("%03d", "id").alias("id"), F.lit("t").alias("title"), F.lit("s").alias("summary"),
        F.lit(None).cast("string").alias("venue"), F.lit(None).cast("int").alias("is_preprint"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("published_at"),
        F.lit(None).cast("timestamp").alias("fetched_at"))


def test_batches_follow_the_scoring_order(spark):
    batches = external.score_batches(many(spark, 47), size=20)
    rows = sorted(batches.collect(), key=lambda r: r["batch_id"])
    assert [len(r["ids"]) for r in rows] == [20, 20, 7]
    expected = sorted((f"{i:03d}" for i in range(47)), key=lambda i: (-(int(i) % 5), i))
    assert [i for r in rows for i in r["ids"]] == expected
    assert [x["id"] for x in json.loads(rows[0]["request"])] == expected[:20]


def test_pluggable_scorer_retries_and_isolates_failures(spark):
    batches = external.score_batches(many(spark, 60), size=20)

    def scorer(system, user):
        ids = [r["id"] for r in json.loads(user[user.index("["):user.rindex("]") + 1])]
        if "004" in ids:
            raise RuntimeError("quota")
        if "001" in ids and not user.endswith("Reply with valid JSON only."):
            return "cannot do that"
        return json.dumps([{"id": i, "score": 5, "tag": "methods", "why": system} for i in ids])

    found = external.score_with(batches, scorer, system_prompt="p")
    texts = {r["batch_id"]: r["text"] for r in found.collect()}
    assert texts[0] is None and texts[1] and texts[2]
    out = external.ingest_scores(found, external.requested_ids(batches), many(spark, 60), ["methods"], "local")
    assert out.count() == 40


def test_a_scorer_without_answers_scores_nothing(spark):
    batches = external.score_batches(many(spark, 5))
    found = external.score_with(batches, lambda system, user: None)
    assert external.ingest_scores(found, external.requested_ids(batches), many(spark, 5), ["m"], "x").count() == 0


def test_external_stage_leaves_deferred_and_unanswered_items_for_later(spark):
    from fieldscope.plans.external_scoring import external_score_stage
    from fieldscope.settings import TermModel

    rows = many(spark, 60).withColumn("source_type", F.when(F.col("id") < "010", "news").otherwise("paper"))
    old = spark.createDataFrame([("059",)], "id string")
    calls = spark.sparkContext.accumulator(0)

    def scorer(system, user):
        calls.add(1)
        ids = [r["id"] for r in json.loads(user[user.index("["):])]
        if "054" in ids:
            return None
        return json.dumps([{"id": i, "score": 4, "tag": "m"} for i in ids] + [{"id": ids[0], "score": 9, "tag": "m"}])

    model = TermModel(topic=("absent",))
    out = external_score_stage(rows, old, model, scorer, ["m"], "remote", cap=30, size=10)
    got = {r["id"]: (r["score"], r["scorer"], r["prefilter_hits"]) for r in out.collect()}
    newest = sorted((f"{i:03d}" for i in range(10, 59)), key=lambda i: (-(int(i) % 5), i))[:30]
    lost = next(set(newest[n:n + 10]) for n in (0, 10, 20) if "054" in newest[n:n + 10])
    expected = {i: (0, "prefilter", 0) for i in (f"{n:03d}" for n in range(10))}
    expected.update({i: (4, "remote", 0) for i in newest if i not in lost})
    assert got == expected
    assert calls.value == 4      # three batches, one of them asked twice
    assert out.count() == len(expected) and calls.value == 4
