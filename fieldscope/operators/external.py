"""Scores that come from outside: request batches, reply ingestion, hook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import effective_time, is_blank, string_list, strip
from fieldscope.functions.venue import apply_venue, clamp, venue_adjust
from fieldscope.operators.groups import numbered_newest_first
from fieldscope.settings import (
    BATCH_SIZE, NO_ABSTRACT_NOTE, NO_TAG, VenueWeights)


def payload(summary_limit: int | None = None) -> Column:
    """JSON request row of an item.  Keys without a value are left out."""
    summary = F.coalesce("summary", F.lit(""))
    sent = summary if summary_limit is None else F.substring(summary, 1, summary_limit)
    return F.to_json(F.struct(
        "id", F.coalesce("title", F.lit("")).alias("title"),
        sent.alias("summary"),
        F.when(F.col("venue") != "", F.col("venue")).alias("venue"),
        (F.col("is_preprint") == 0).alias("peer_reviewed"),
        F.when(is_blank(summary), F.lit(NO_ABSTRACT_NOTE)).alias("note")))


def score_batches(items: DataFrame, size: int = BATCH_SIZE, summary_limit: int | None = None) -> DataFrame:
    """Fixed-size batches in scoring order: (batch_id, ids, request).  A batch
    holds ``size`` rows at most, so gathering one is bounded."""
    slim = items.select("id", "published_at", "fetched_at", payload(summary_limit).alias("row"))
    numbered = numbered_newest_first(slim, effective_time(F.col("published_at"), F.col("fetched_at")), "id")
    batch = F.floor((F.col("rn") - 1) / size).cast("long")
    rows = F.sort_array(F.collect_list(F.struct("rn", "id", "row")))
    return (numbered.groupBy(batch.alias("batch_id")).agg(rows.alias("rows"))
            .select("batch_id", F.col("rows.id").alias("ids"),
                    F.concat(F.lit("["), F.array_join("rows.row", ","), F.lit("]")).alias("request")))


def _is_array(text: str | None) -> bool:
    if not text:
        return False
    start, end = text.find("["), text.rfind("]")
    try:
        return start >= 0 and isinstance(json.loads(text[start:end + 1]), list)
    except ValueError:
        return False


def score_with(batches: DataFrame, complete: Callable[[str, str], str | None],
               system_prompt: str = "", instruction: str = "Score these items; reply with a JSON array.\n",
               retry_note: str = "\nReply with valid JSON only.",
               parallelism: int | None = None) -> DataFrame:
    """Send each batch to ``complete(system_prompt, user_text)`` and return
    (batch_id, text).  A bad reply is asked for once more; a batch that fails
    both times has a NULL text, its items stay unscored and queue again.

    Calls of one task follow each other, so batches are spread over as many tasks
    as there are cores; ``parallelism`` asks for more, for scorers that mostly wait.
    """

    def ask(user: str) -> str | None:
        for text in (user, user + retry_note):
            try:
                reply = complete(system_prompt, text)
            except Exception:  # a failing call costs its own batch only
                reply = None
            if _is_array(reply):
                return reply
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "batch_id": frame["batch_id"],
                "text": [ask(instruction + request) for request in frame["request"]]})

    requests = batches.select("batch_id", "request")
    requests = requests.repartition(parallelism or batches.sparkSession.sparkContext.defaultParallelism)
    return requests.mapInPandas(run, "batch_id long, text string")


def requested_ids(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", F.explode("ids").alias("id"))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("element", f"$.{name}", kind)


def _kind(name: str) -> Column:
    return F.schema_of_variant(_field(name, "variant"))


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _field(name, "string"))


def _whole_number() -> Column:
    """The score as a whole number: numbers are truncated, booleans are 0 or 1,
    strings count only if they spell an integer, anything else is 0."""
    kind = _kind("score")
    digits = strip(_field("score", "string"))
    spelled = F.when(digits.rlike("^[+-]?[0-9]+(_[0-9]+)*$"),
                     F.replace(digits, F.lit("_"), F.lit("")).try_cast("double"))
    number = (F.when(kind == "STRING", spelled)
              .when(kind == "BOOLEAN", _field("score", "boolean").cast("int").cast("double"))
              .otherwise(_field("score", "double")))
    return clamp(F.coalesce(number, F.lit(0.0)))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(batch_id, pos, element): the objects of each reply's JSON array.  Fences
    are dropped and the array runs from the first "[" to the last "]"; a reply
    without a valid array gives no rows, an element that is no object is skipped."""
    bare = F.replace(F.replace("text", F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    found = F.try_parse_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0))
    listed = F.try_variant_get(found, "$", "array<variant>")
    return (replies.select("batch_id", F.posexplode(listed).alias("pos", "element"))
            .filter(F.schema_of_variant("element").startswith("OBJECT")))


def ingest_scores(replies: DataFrame, requested: DataFrame, items: DataFrame, tags, scorer: str,
                  weights: VenueWeights | None = None, rationale_limit: int | None = None) -> DataFrame:
    """Clean score rows from reply texts: (batch_id, pos, id, score, tag,
    rationale, scorer).  Ids that were not asked for in that batch are dropped."""
    tag = _text("tag")
    said = F.coalesce(F.when(_text("why") != "", _text("why")), _text("rationale"), F.lit(""))
    raw = parse_replies(replies).select(
        "batch_id", "pos", _text("id").alias("id"), _whole_number().alias("raw_score"),
        F.when(F.array_contains(string_list(tags), tag), tag).otherwise(F.lit(NO_TAG)).alias("tag"),
        (said if rationale_limit is None else F.substring(said, 1, rationale_limit)).alias("why"))
    known = raw.join(requested.select("batch_id", "id"), ["batch_id", "id"], "left_semi")
    placed = known.join(items.select("id", "is_preprint", "summary"), "id", "left")
    score, rationale = apply_venue(
        F.col("raw_score"), F.col("why"),
        venue_adjust(F.col("is_preprint"), F.col("summary"), weights), rationale_limit)
    return placed.select("batch_id", "pos", "id", clamp(score).alias("score"), "tag",
                         rationale.alias("rationale"), F.lit(scorer).alias("scorer"))
