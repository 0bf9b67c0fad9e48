"""One whole sweep: dedupe, backfill, upsert, discover, score, report, log, prune."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from fieldscope.functions.columns import ago, is_blank, moment
from fieldscope.operators.discovery import discover
from fieldscope.operators.enrichment import backfill, needs_abstract
from fieldscope.operators.groups import materialize
from fieldscope.operators.health import failing_sources
from fieldscope.operators.ingest import COLLECTION_ORDER, conform, upsert_new, with_identity, without_identity
from fieldscope.operators.retention import prune_items, prune_runs
from fieldscope.operators.scoring import score_stage, score_stage_counts
from fieldscope.plans.digest import digest_groups, digest_header, digest_rows
from fieldscope.plans.reports import (
    dashboard_listing, latest_scorer, library_shortlist, shown_composition, top_picks, with_scores)
from fieldscope.schemas import RUN
from fieldscope.settings import (
    DEFAULT_TERMS, DEFAULT_WORKSTREAMS, KEEP_ITEM_DAYS, KEEP_RUN_DAYS, DiscoverySettings, ReportSettings, TermModel,
    VenueWeights)

BACKFILL_RECORD = "abstract backfill"
SCORE_RECORD = "scoring"
REJECT_RECORD = "without identity"


@dataclass(frozen=True)
class SweepSettings:
    model: TermModel = DEFAULT_TERMS
    workstreams: tuple = DEFAULT_WORKSTREAMS
    weights: VenueWeights = VenueWeights()
    report: ReportSettings = field(default_factory=ReportSettings)
    discovery: DiscoverySettings = DiscoverySettings()
    keep_days: int = KEEP_ITEM_DAYS
    keep_run_days: int = KEEP_RUN_DAYS


@dataclass(frozen=True)
class LibraryTables:
    """What discovery needs: works, the resolved library, citation and authorship edges."""

    works: DataFrame
    library: DataFrame
    citations: DataFrame
    authorships: DataFrame


def discovered(tables: LibraryTables, as_of, cfg: SweepSettings) -> DataFrame:
    """New works around the reader's library, labelled as their source."""
    cutoff = ago(as_of, days=cfg.discovery.discovery_days)
    return discover(tables.works, tables.library, tables.citations, tables.authorships, cutoff, cfg.discovery)


def _record(counted: DataFrame, source: str, fetched: str, note) -> DataFrame:
    return counted.select(F.lit(source).alias("source"), F.col(fetched).alias("fetched"), F.lit(1).alias("ok"), note.alias("note"))


def run_log(collected: DataFrame, filled: DataFrame, new_scores: DataFrame, as_of) -> DataFrame:
    """The records of a sweep: each source, the backfill, the score stage, and rows that can have no id."""
    count = F.count(F.lit(1))
    items = lambda c: F.concat(F.col(c).cast("string"), F.lit(" items"))
    sources = collected.groupBy("source").agg(count.alias("fetched")).select(
        "source", "fetched", F.lit(1).alias("ok"), items("fetched").alias("note"))
    counts = filled.agg(F.count_if("_wanted").alias("tried"),
                        F.count_if(F.col("_wanted") & ~is_blank(F.col("summary"))).alias("filled"))
    stage = score_stage_counts(new_scores)
    lost = without_identity(collected).agg(count.alias("n")).filter("n > 0")
    parts = [
        _record(counts, BACKFILL_RECORD, "filled", F.format_string("%d of %d filled", "filled", "tried")),
        _record(stage, SCORE_RECORD, "scored", F.format_string(
            "%d scored, %d prefiltered, %d deferred", "scored", "prefiltered", "deferred")),
        _record(lost, REJECT_RECORD, "n", items("n"))]
    for part in parts:
        sources = sources.unionByName(part)
    return conform(sources.withColumn("run_at", moment(as_of)), RUN)


def sweep(collected: DataFrame, items: DataFrame, scores: DataFrame, abstracts: DataFrame, as_of,
          cfg: SweepSettings = SweepSettings(), order=COLLECTION_ORDER, runs: DataFrame | None = None,
          tables: LibraryTables | None = None, last_sent=None) -> dict[str, DataFrame]:
    """Results of one keyword-scored sweep over stored ``items``, ``scores`` and
    ``runs``: what to append to each table, the reports, and what survives.

    New items and new scores feed several of these and are written once each, as
    are the rows that reports read: items with their scores, joined once.
    """
    spark = collected.sparkSession
    wanted = with_identity(collected).withColumn("_wanted", F.coalesce(needs_abstract(), F.lit(False)))
    filled = materialize(backfill(wanted, abstracts))
    new_items = materialize(upsert_new(filled.drop("_wanted"), items, order).withColumn(
        "fetched_at", F.coalesce(F.col("fetched_at"), moment(as_of))).select(*items.columns))
    all_items = items.unionByName(new_items)
    tags = [w.tag for w in cfg.workstreams]
    new_scores = materialize(score_stage(all_items, scores, cfg.model, tags, cfg.weights).withColumn(
        "scored_at", moment(as_of)).select(*scores.columns))
    all_scores = scores.unionByName(new_scores)
    scored = materialize(with_scores(all_items, all_scores))
    log = run_log(collected, filled, new_scores, as_of)
    known = log if runs is None else conform(runs, RUN).unionByName(log)
    digest = digest_rows(scored, as_of, cfg.workstreams, cfg.report, last_sent)
    shortlist = library_shortlist(scored, as_of, cfg.report)
    return {
        "new_items": new_items,
        "rejected": without_identity(collected),
        "new_scores": new_scores,
        "run_log": log,
        "listing": dashboard_listing(scored, as_of, cfg.report),
        "top_picks": top_picks(scored, as_of, cfg.report),
        "composition": shown_composition(scored, as_of, cfg.report),
        "latest_scorer": latest_scorer(all_scores),
        "failing": failing_sources(known, tiebreak="fetched"),
        "digest_rows": digest,
        "digest_groups": digest_groups(digest),
        "digest_header": digest_header(digest, shortlist, as_of),
        "shortlist": shortlist,
        "discovered": discovered(tables, as_of, cfg) if tables else spark.createDataFrame([], "work_id string"),
        "kept": prune_items(scored, cfg.report.show_threshold, as_of, cfg.keep_days),
        "kept_runs": prune_runs(known, as_of, cfg.keep_run_days),
    }
