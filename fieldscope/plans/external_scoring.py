"""The score stage with an external scorer in place of the term score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fieldscope.operators.external import ingest_scores, requested_ids, score_batches, score_with
from fieldscope.operators.groups import keep_first, materialize
from fieldscope.operators.scoring import prefilter, score_cap, unscored
from fieldscope.settings import BATCH_SIZE, NO_TAG, TermModel, VenueWeights


def external_score_stage(items: DataFrame, scores: DataFrame, model: TermModel,
                         complete: Callable[[str, str], str | None], tags, scorer: str,
                         weights: VenueWeights | None = None, system_prompt: str = "",
                         cap: int | None = None, size: int = BATCH_SIZE) -> DataFrame:
    """New score rows: rejected items at once, and the passing ones, or the
    newest ``cap`` of them, as far as the scorer answered.  All others stay unscored, so a later
    sweep finds them again.

    The chosen rows are written before the scorer is called, and so are its
    replies: both are read more than once, and a paid call must not be repeated.
    """
    gated = prefilter(unscored(items, scores), model)
    rejected = gated.filter(~F.col("passes")).select(
        "id", F.lit(0).alias("score"), F.lit(NO_TAG).alias("tag"), F.lit("failed prefilter").alias("rationale"),
        F.lit("prefilter").alias("scorer"), "prefilter_hits")
    passing = gated.filter("passes")
    chosen = materialize(passing if cap is None else score_cap(passing, cap))
    batches = score_batches(chosen, size)
    replies = materialize(score_with(batches, complete, system_prompt))
    results = keep_first(ingest_scores(replies, requested_ids(batches), chosen, tags, scorer, weights), ["id"], ["batch_id", "pos"])
    answered = results.join(chosen.select("id", "prefilter_hits"), "id")
    return rejected.unionByName(answered.drop("batch_id", "pos"))
