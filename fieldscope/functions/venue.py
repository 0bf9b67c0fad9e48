"""Score adjustment for where a paper appeared."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldscope.functions.columns import is_blank
from fieldscope.settings import SCORE_MAX, SCORE_MIN, VenueWeights


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(SCORE_MIN), F.least(F.lit(SCORE_MAX), c)).cast("int")


def venue_adjust(is_preprint: Column, summary: Column, weights: VenueWeights | None) -> Column:
    """struct<delta, why>.  Unknown venue kind is never guessed at; the offset
    for a missing abstract applies only where peer-reviewed work has a weight."""
    none = F.struct(F.lit(0).alias("delta"), F.lit("").alias("why"))
    if weights is None or not weights.enabled:
        return none

    def outcome(delta: int, text: str) -> Column:
        why = f"{text} {delta:+d}" if delta else ""
        return F.struct(F.lit(delta).alias("delta"), F.lit(why).alias("why"))

    peer = outcome(weights.peer_reviewed, "peer-reviewed")
    if weights.peer_reviewed:
        bare = outcome(weights.peer_reviewed + weights.no_abstract_offset,
                       "peer-reviewed, no abstract available")
        peer = F.when(is_blank(summary), bare).otherwise(peer)
    return (F.when(is_preprint.isNull(), none)
            .when(is_preprint == 1, outcome(weights.preprint, "preprint"))
            .otherwise(peer))


def apply_venue(score: Column, why: Column, adjust: Column, limit: int | None = None) -> tuple[Column, Column]:
    """Adjusted (score, rationale); a zero delta changes nothing."""
    moved = adjust["delta"] != 0
    noted = F.concat(why, F.lit(" ["), adjust["why"], F.lit("]"))
    if limit:
        noted = F.substring(noted, 1, limit)
    return (F.when(moved, clamp(score + adjust["delta"])).otherwise(score),
            F.when(moved, noted).otherwise(why))
