"""Term scoring: gate, keyword score, venue correction, write-once scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import effective_time, let
from fieldscope.functions.terms import matching_terms, model_hits
from fieldscope.functions.text import scoring_text
from fieldscope.functions.venue import apply_venue, clamp, venue_adjust
from fieldscope.operators.groups import keep_first
from fieldscope.settings import NO_TAG, SCORE_MAX, TAG_WEIGHT, TermModel, VenueWeights


def _text_hits(model: TermModel) -> Column:
    """Every term count of the model, in one pass over the item's text."""
    return model_hits(scoring_text(F.col("title"), F.col("summary")), model)


def passes_gate(source_type: Column, hits: Column) -> Column:
    """Papers always pass; others need a topic hit and no excluded term."""
    return (source_type.eqNullSafe("paper")
            | ((hits["exclude"] == 0) & (hits["topic"] >= 1)))


def prefilter(items: DataFrame, model: TermModel) -> DataFrame:
    """Add ``prefilter_hits`` and ``passes``; no row is dropped, since rejected
    rows are written too."""
    gate = let(_text_hits(model), lambda hits: F.struct(
        hits["topic"].alias("topic"), passes_gate(F.col("source_type"), hits).alias("passes")))
    return (items.withColumn("_gate", gate)
            .withColumns({"prefilter_hits": F.col("_gate.topic"), "passes": F.col("_gate.passes")})
            .drop("_gate"))


def _scored(model: TermModel, tags, weights: VenueWeights | None) -> Column:
    """struct<score, tag, rationale, topic, passes>.

    One expression from text to score: a report's filter on the score is pushed
    below the projection as a copy of it, and a copy that mentioned the
    term counts several times would count them several times.
    """
    adjust = venue_adjust(F.col("is_preprint"), F.col("summary"), weights)

    def outcome(hits: Column) -> Column:
        best = hits["best"]
        excluded = hits["exclude"] > 0
        raw = F.least(F.lit(SCORE_MAX), best["hits"] * TAG_WEIGHT + hits["topic"] + hits["region"])
        why = F.concat(F.lit("keyword match: "), best["hits"].cast("string"), F.lit(" tag / "),
                       hits["topic"].cast("string"), F.lit(" topic / "),
                       hits["region"].cast("string"), F.lit(" region hits"))
        score, noted = apply_venue(raw, why, adjust)
        return F.struct(
            F.when(excluded, F.lit(0)).otherwise(clamp(score)).alias("score"),
            F.when(~excluded & (best["hits"] > 0) & best["tag"].isin(*tags), best["tag"])
            .otherwise(F.lit(NO_TAG)).alias("tag"),
            F.when(excluded, F.lit("excluded topic")).otherwise(noted).alias("rationale"),
            hits["topic"].alias("topic"), passes_gate(F.col("source_type"), hits).alias("passes"))

    return let(_text_hits(model), outcome)


def keyword_score(items: DataFrame, model: TermModel, tags, weights: VenueWeights | None) -> DataFrame:
    """Add score, tag, rationale and scorer to every item.  A narrow plan."""
    return (items.withColumn("_s", _scored(model, list(tags), weights))
            .withColumns({c: F.col(f"_s.{c}") for c in ("score", "tag", "rationale")})
            .withColumn("scorer", F.lit("keyword")).drop("_s"))


def best_tag(items: DataFrame, model: TermModel) -> DataFrame:
    """Relational form of the tag choice: hits per (item, tag), then the best."""
    rank = F.create_map(*[x for at, tag in enumerate(model.tags) for x in (F.lit(tag), F.lit(-at))])
    text = scoring_text(F.col("title"), F.col("summary"))
    tag_only = TermModel(tags=model.tags)
    found = items.select("id", F.explode(matching_terms(text, tag_only)).alias("m"))
    per_tag = found.groupBy("id", F.col("m.tag").alias("tag")).agg(F.count(F.lit(1)).alias("hits"))
    return per_tag.groupBy("id").agg(
        F.max_by("tag", F.struct("hits", rank[F.col("tag")])).alias("tag"),
        F.max("hits").alias("hits"))


def term_matches(items: DataFrame, model: TermModel) -> DataFrame:
    """One row per item and listed term that occurs in it."""
    text = scoring_text(F.col("title"), F.col("summary"))
    return (items.select("id", F.explode(matching_terms(text, model)).alias("m"))
            .select("id", "m.kind", "m.tag", "m.term"))


def unscored(items: DataFrame, scores: DataFrame) -> DataFrame:
    return items.join(scores.select("id"), "id", "left_anti")


def newest_first():
    """Scoring order: newest effective date first, id as tie-break."""
    return [effective_time(F.col("published_at"), F.col("fetched_at")).desc_nulls_last(), F.col("id").asc()]


def score_cap(passing: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` rows; the rest are deferred to a later sweep."""
    return passing.orderBy(*newest_first()).limit(cap)


def score_stage(items: DataFrame, scores: DataFrame, model: TermModel, tags,
                weights: VenueWeights | None) -> DataFrame:
    """Score every unscored item; rejected ones are scored 0 so that they never
    come back.  Gate and score share one pass over the text."""
    outcome = unscored(items, scores).withColumn("_s", _scored(model, list(tags), weights))
    passed = F.col("_s.passes")
    return outcome.select(
        "id", F.col("_s.topic").alias("prefilter_hits"),
        F.when(passed, F.col("_s.score")).otherwise(F.lit(0)).alias("score"),
        F.when(passed, F.col("_s.tag")).otherwise(F.lit(NO_TAG)).alias("tag"),
        F.when(passed, F.col("_s.rationale")).otherwise(F.lit("failed prefilter")).alias("rationale"),
        F.when(passed, F.lit("keyword")).otherwise(F.lit("prefilter")).alias("scorer"))


def score_stage_counts(stage: DataFrame, passing: DataFrame | None = None) -> DataFrame:
    """One row with what the stage wrote: scored and prefiltered rows, and those
    that a capped stage left for later.  ``passing`` holds the rows that passed
    the gate of such a stage; without it nothing was deferred."""
    written = stage.agg(F.count_if(F.col("scorer") != "prefilter").alias("scored"),
                        F.count_if(F.col("scorer") == "prefilter").alias("prefiltered"))
    if passing is None:
        return written.withColumn("deferred", F.lit(0).cast("long"))
    return written.withColumn("deferred", passing.select(F.count(F.lit(1))).scalar() - F.col("scored"))


def apply_scores_once(results: DataFrame, scores: DataFrame, order) -> DataFrame:
    """Results to append: the first per id, and only for ids without a score."""
    return keep_first(results, ["id"], list(order)).join(scores.select("id"), "id", "left_anti")
