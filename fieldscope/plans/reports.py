"""Dashboard tables: listing, top picks, composition, latest scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldscope.functions.columns import ago, effective_time, since
from fieldscope.functions.text import source_label
from fieldscope.settings import DEFAULT_COLOR, HEADLINE_LIMIT, NO_TAG, ReportSettings


def with_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """The item row as reports see it: items with their scores, if any."""
    return items.join(scores, "id", "left")


def from_library() -> Column:
    return F.coalesce(F.col("source").ilike("library%"), F.lit(False))


def _effective() -> Column:
    return effective_time(F.col("published_at"), F.col("fetched_at"))


def _shown(scored: DataFrame, floor: int, cutoff: Column) -> DataFrame:
    """Cheap predicates come first: the score may be an expensive expression."""
    return scored.filter(since(F.col("published_at"), F.col("fetched_at"), cutoff)
                         & ~from_library() & (F.col("score") >= floor))


def dashboard_listing(scored: DataFrame, as_of, cfg: ReportSettings = ReportSettings()) -> DataFrame:
    """Newest first, then best; bounded by the page size."""
    return (_shown(scored, cfg.show_threshold, ago(as_of, days=cfg.render_days))
            .orderBy(_effective().desc(), F.col("score").desc(), F.col("id")).limit(cfg.listing_limit))


def top_picks(scored: DataFrame, as_of, cfg: ReportSettings = ReportSettings()) -> DataFrame:
    """Best of the last hours, then newest."""
    return (_shown(scored, cfg.highlight_threshold, ago(as_of, hours=cfg.top_hours))
            .orderBy(F.col("score").desc(), _effective().desc(), F.col("id")).limit(cfg.top_limit))


def library_shortlist(scored: DataFrame, as_of, cfg: ReportSettings = ReportSettings()) -> DataFrame:
    """Best library-sourced rows of the last library sweep."""
    cutoff = ago(as_of, days=cfg.library_every_days + 3)
    return (scored.filter((F.col("fetched_at") >= cutoff) & from_library() & (F.col("score") >= cfg.digest_floor))
            .orderBy(F.col("score").desc(), _effective().desc(), F.col("id")).limit(cfg.library_top_n))


def tag_lookup(workstreams, field: str, default: Column) -> Column:
    """A workstream's label or colour as a constant map, no join."""
    if not workstreams:
        return default
    pairs = [F.lit(x) for w in workstreams for x in (w.tag, getattr(w, field))]
    return F.coalesce(F.create_map(*pairs)[_tag()], default)


def _tag() -> Column:
    return F.coalesce(F.col("tag"), F.lit(NO_TAG))


def display_shape(scored: DataFrame, workstreams) -> DataFrame:
    """Rows as the page shows them."""
    date = F.coalesce(F.col("published_at").cast("string"),
                      F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return scored.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        source_label(F.col("venue"), F.col("source"), F.col("is_preprint")).alias("source"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("rationale", F.lit("")).alias("rationale"),
        date.alias("date"), tag_lookup(workstreams, "label", _tag()).alias("tag_label"),
        tag_lookup(workstreams, "color", F.lit(DEFAULT_COLOR)).alias("tag_color"))


def latest_scorer(scores: DataFrame, tiebreak: str = "id") -> DataFrame:
    """Scorer of the newest score that was not a prefilter rejection."""
    real = scores.filter(F.col("scorer").isNotNull() & (F.col("scorer") != "prefilter"))
    return real.agg(F.coalesce(F.max_by("scorer", F.struct("scored_at", tiebreak)),
                               F.lit("keyword")).alias("scorer"))


def shown_composition(scored: DataFrame, as_of, cfg: ReportSettings = ReportSettings()) -> DataFrame:
    """How the rows above the listing floor split by kind of venue."""
    kind = (F.when(F.col("is_preprint") == 1, "preprint").when(F.col("is_preprint") == 0, "peer-reviewed")
            .when(F.col("source_type") == "paper", "unknown").otherwise(F.col("source_type")))
    shown = _shown(scored, cfg.show_threshold, ago(as_of, days=cfg.render_days))
    counts = shown.groupBy(kind.alias("venue_class")).agg(F.count(F.lit(1)).alias("n"))
    # A handful of rows are left here, one per kind of venue.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.round(F.lit(100) * F.col("n") / total).cast("int"))


def headline_list(rows: DataFrame, n: int = HEADLINE_LIMIT) -> DataFrame:
    """One row: the best ``n`` titles as a bulleted text."""
    order = F.struct(-F.col("score"), -F.unix_micros(_effective()), F.col("id"))
    best = (rows.orderBy(F.col("score").desc(), _effective().desc(), F.col("id")).limit(n)
            .select(order.alias("at"), F.concat(F.lit("- "), F.coalesce("title", F.lit(""))).alias("line")))
    return best.agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "line")))["line"], "\n").alias("text"))
