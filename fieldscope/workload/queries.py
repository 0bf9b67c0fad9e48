"""Every operator as a query over the benchmark tables.

Each query reads whole tables.  Dates and times are returned as text.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldscope.functions import identity, text, urls
from fieldscope.functions.columns import ago
from fieldscope.functions.terms import term_hits
from fieldscope.functions.venue import venue_adjust
from fieldscope.operators import (
    discovery, enrichment, external, health, ingest, journals, packing, retention, scoring, similar, termtable)
from fieldscope.operators.groups import materialize, shared_folder
from fieldscope.plans import digest, reports, sweep as plan
from fieldscope.schemas import ITEM, SCORE
from fieldscope.settings import DiscoverySettings
from fieldscope.sources import entries, graph, keys, landed, library, notes, registry, tables, works
from fieldscope.streaming import health as live, sweep
from fieldscope.workload import adapters as a
from fieldscope.workload.adapters import Tables, mod, text_of

_QUERIES = {}


def query(build):
    """Register ``build(tables)`` under its own name, less the ``q_`` that keeps
    a query apart from a function of that name."""
    name = build.__name__.removeprefix("q_")
    _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


def all_queries():
    return dict(_QUERIES)


def day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def scored_items(t: Tables) -> DataFrame:
    return scoring.keyword_score(a.items(t), a.TERMS, a.TAGS, a.WEIGHTS)


def labelled_items(t: Tables) -> DataFrame:
    return reports.with_scores(a.items(t), a.label_scores(t))


# --- reports ---------------------------------------------------------------
# Reports read stored scores; top_picks stands for scores computed on the way.

def _report_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", "source", "title", "score", "tag", "rationale", day("published_at"))


@query
def top_picks(t):
    return _report_columns(reports.top_picks(scored_items(t), a.AS_OF, a.REPORT))


@query
def dashboard_listing(t):
    return _report_columns(reports.dashboard_listing(labelled_items(t), a.AS_OF, a.REPORT))


@query
def library_shortlist(t):
    return _report_columns(reports.library_shortlist(labelled_items(t), a.AS_OF, a.REPORT))


@query
def display_shape(t):
    return reports.display_shape(labelled_items(t), a.WORKSTREAMS[:2])


@query
def latest_scorer(t):
    return reports.latest_scorer(a.event_scores(t))


@query
def shown_composition(t):
    return reports.shown_composition(labelled_items(t), a.AS_OF, a.REPORT)


@query
def headline_list(t):
    return reports.headline_list(labelled_items(t).filter(F.col("score") >= a.REPORT.digest_floor))


def _digest(t):
    return digest.digest_rows(labelled_items(t), a.AS_OF, a.WORKSTREAMS, a.REPORT, last_sent="2024-01-18 09:00:00")


@query
def digest_rows(t):
    return _digest(t).select("group_ord", "group_label", "group_color", "id", "title", "url", "source", "score", "why")


@query
def digest_groups(t):
    return digest.digest_groups(_digest(t))


@query
def digest_header(t):
    shortlist = reports.library_shortlist(labelled_items(t), a.AS_OF, a.REPORT)
    return digest.digest_header(_digest(t), shortlist, a.AS_OF)


@query
def digest_lines(t):
    return digest.digest_lines(_digest(t)).select("group_ord", "id", "line")


@query
def age_label(t):
    return t.orders.select("o_orderkey", text.age_label(F.col("o_orderdate"), a.AGE_AS_OF).alias("age"))


# --- scoring ---------------------------------------------------------------

@query
def keyword_score(t):
    return scored_items(t).select("id", "score", "tag", "rationale", "scorer")


@query
def q_term_hits(t):
    return a.items(t).select("id", term_hits(
        text.scoring_text(F.col("title"), F.col("summary")), a.TERMS.topic).alias("topic_hits"))


@query
def prefilter_gate(t):
    return scoring.prefilter(a.items(t), a.TERMS).select(
        "id", F.col("passes").cast("int").alias("passes"), "prefilter_hits")


@query
def term_join(t):
    return scoring.term_matches(a.items(t), a.TERMS)


@query
def term_table_hits(t):
    """Hits per kind of the terms of a table, by one automaton."""
    return termtable.term_hits(a.items(t).repartition("id"), a.term_table(t))


@query
def best_tag(t):
    return scoring.best_tag(a.items(t), a.TERMS).withColumn("hits", F.col("hits").cast("int"))


@query
def q_venue_adjust(t):
    adjust = venue_adjust(F.col("is_preprint"), F.col("summary"), a.WEIGHTS)
    return a.items(t).select("id", adjust.alias("v")).select("id", "v.delta", "v.why")


@query
def unscored(t):
    return scoring.unscored(a.items(t), a.label_scores(t)).select("id", "doc_id")


def _stage(t):
    return scoring.score_stage(a.items(t), a.label_scores(t), a.TERMS, a.TAGS, a.WEIGHTS)


@query
def score_stage(t):
    return _stage(t)


@query
def score_stage_counts(t):
    return scoring.score_stage_counts(_stage(t))


def _passing(t):
    gated = scoring.prefilter(scoring.unscored(a.items(t), a.label_scores(t)), a.TERMS)
    return gated.filter("passes")


@query
def score_cap(t):
    return scoring.score_cap(_passing(t), 150).select("id", "doc_id")


@query
def apply_scores_once(t):
    scored = scored_items(t)
    twice = (scored.withColumn("attempt", F.lit(0))
             .unionByName(scored.withColumn("attempt", F.lit(1)).withColumn("score", F.col("score") + 100)))
    return scoring.apply_scores_once(twice, a.label_scores(t), ["attempt"]).select("id", "score", "tag", "attempt")


@query
def score_payload(t):
    return a.items(t).select("id", external.payload(summary_limit=1000).alias("payload"))


@query
def score_batches(t):
    return external.score_batches(_passing(t), summary_limit=1000).select(
        "batch_id", F.array_join("ids", ",").alias("ids"), "request")


@query
def ingest_scores(t):
    requests = a.reply_requests(t)
    return external.ingest_scores(a.replies(t), requests, requests, a.TAGS, "remote", a.WEIGHTS, rationale_limit=280)


def _local_scorer(system: str, user: str) -> str:
    """A deterministic stand-in for a remote scorer."""
    rows = json.loads(user[user.index("["):])
    return json.dumps([{"id": r["id"], "score": len(r["title"]) % 11, "tag": "a", "why": "length"} for r in rows])


@query
def pluggable_scorer(t):
    batches = external.score_batches(_passing(t))
    found = external.score_with(batches, _local_scorer)
    return external.ingest_scores(found, external.requested_ids(batches), a.items(t), a.TAGS, "local", a.WEIGHTS)


# --- identity and ingest -----------------------------------------------------

@query
def normalize_url(t):
    return t.pages.select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query
def item_identity(t):
    orders = t.orders.select(
        F.concat(F.lit("order-"), text_of("o_orderkey")).alias("item"),
        F.when(mod("o_orderkey", 3) != 0, F.concat(F.lit(" 10.9999/ABC."), text_of("o_custkey"))).alias("doi"),
        F.concat(F.lit("HTTPS://Shop.example.com/O/"), text_of("o_custkey"), F.lit("/?b=2&a=1&gclid=z#x")).alias("url"))
    pages = t.pages.select(F.concat(F.lit("page-"), text_of("page_id")).alias("item"),
                           F.lit("").alias("doi"), "url")
    return orders.unionByName(pages).select("item", identity.item_id(F.col("doi"), F.col("url")).alias("id"))


@query
def dedupe_first(t):
    pages = a.page_deliveries(t).select(
        "id", F.concat(F.lit("page-"), text_of("page_id")).alias("item"), "source_ord", "seq")
    documents = a.duplicate_items(t).select(
        "id", F.concat(F.lit("document-"), text_of("doc_id")).alias("item"), "source_ord", "seq")
    return ingest.dedupe_first(pages.unionByName(documents)).select("id", "item", "source_ord")


@query
def upsert_new(t):
    batch = a.duplicate_items(t)
    stored = batch.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return ingest.upsert_new(batch, stored).select("id", "doc_id", "source")


@query
def schema_evolve(t):
    items = a.items(t)
    old = items.join(t.labels.select("doc_id"), "doc_id", "left_semi").drop("venue", "is_preprint")
    new = items.join(t.labels.select("doc_id"), "doc_id", "left_anti").withColumn("org", F.lit("dropped"))
    return ingest.conform(ingest.evolve(old, new), ITEM).select("id", "title", "venue", "is_preprint", "prefilter_hits")


@query
def collect_union(t):
    return ingest.union_sources(a.collectors(t)).select(
        "collector", "source_ord", "source_type", "title", "url", "doi", "venue")


@query
def source_counts(t):
    return ingest.source_counts(ingest.union_sources(a.collectors(t)), ["works", "feeds", "news", "library"])


@query
def meta_latest(t):
    meta = t.events.select(F.col("event_type").alias("key"), F.concat("props", text_of("event_id")).alias("value"),
                           "ts", "event_id")
    return ingest.latest_value(meta, "event_id")


@query
def near_dup_titles(t):
    return ingest.near_duplicate_titles(a.titles(t))


@query
def similar_titles(t):
    """Pairs of titles that share four of five words, one title standing for all that have the same words."""
    return similar.similar_titles(similar.title_classes(a.titles(t)))


@query
def title_links(t):
    members = similar.title_classes(a.titles(t))
    return similar.title_links(members, similar.similar_titles(members))


# --- text --------------------------------------------------------------------

@query
def strip_html(t):
    return t.pages.select("page_id", text.strip_html(F.col("html"), limit=1200).alias("text"))


@query
def strip_titled_html(t):
    return t.pages.select("page_id", text.strip_titled_html(F.col("html"), "title", limit=1200).alias("text"))


@query
def rebuild_text(t):
    rebuilt = a.inverted_index(t).select("doc_id", text.place_tokens(F.col("inverted")).alias("rebuilt"))
    return rebuilt.select("doc_id", text.strip_html(F.col("rebuilt")).alias("text"))


@query
def flatten_cut(t):
    return t.documents.select("doc_id", text.flatten_cut(F.concat(F.lit(" \n"), F.col("text")), limit=1200).alias("text"))


@query
def clean_doi(t):
    key = text_of("o_orderkey")
    raw = (F.when(mod("o_orderkey", 4) == 0, F.concat(F.lit(" https://doi.org/10.9999/ABC."), key, F.lit(" ")))
           .when(mod("o_orderkey", 4) == 1, F.concat(F.lit("http://dx.doi.org/10.9999/abc."), key))
           .when(mod("o_orderkey", 4) == 2, F.concat(F.lit("\t10.9999/Abc."), key, F.lit("\n"))))
    return t.orders.select("o_orderkey", identity.clean_doi(raw).alias("doi"))


# --- sources -----------------------------------------------------------------

@query
def project_items(t):
    items = works.works_to_items(a.works(t), F.lit("openalex:all"), [F.col("id").alias("work_id")])
    return items.select("work_id", "source", "source_type", "title", "url", "doi", day("published_at"),
                        "summary", "venue", "is_preprint")


def _recent_items(t):
    return a.items(t).filter(F.col("published_at") >= F.to_date(ago(a.AS_OF, days=7)))


@query
def watch_topic(t):
    words = text.scoring_text(F.col("title"), F.col("summary"))
    found = works.selected(_recent_items(t).drop("source"), works.topic_labels(words, a.TOPIC_QUERIES))
    return found.select("id", "doc_id", "source")


@query
def watch_topic_table(t):
    """Topic selection by a table of queries."""
    words = a.items(t).select("id", text.scoring_text(F.col("title"), F.col("summary")).alias("text"))
    return termtable.topic_matches(words.repartition("id"), a.query_table(t))


@query
def watch_issn(t):
    watched = works.selected(t.part, works.issn_labels(F.array("p_brand"), a.WATCHED_ISSNS))
    recent = t.lineitem.filter(F.col("l_shipdate") >= F.to_date(ago(a.LIBRARY_AS_OF, days=365)))
    return recent.join(watched, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "source")


@query
def watch_author(t):
    recent = t.lineitem.filter(F.col("l_shipdate") >= F.to_date(ago(a.LIBRARY_AS_OF, days=365)))
    found = works.selected(recent, works.author_labels(F.array(text_of("l_suppkey")), a.WATCHED_AUTHORS))
    return found.select("l_orderkey", "source").distinct()


@query
def scan_preprints(t):
    found = entries.scan_preprints(a.preprint_entries(t), ("de", "src3"), ("tion of",), a.AS_OF)
    return found.select("source", "source_type", "venue", "is_preprint", "title", "url", "doi",
                        day("published_at"), "summary")


@query
def scan_news(t):
    found = entries.scan_news(a.news_entries(t), a.EVENTS_AS_OF)
    return found.select("source", "source_type", "title", "url", "doi", day("published_at"), "summary")


@query
def scan_feeds(t):
    found = entries.scan_feeds(entries.parse_feed_lines(a.feed_lines(t)), a.AS_OF,
                               source_types={"feed3": "news"}, extra=["page_id"])
    return found.select("page_id", "source", "source_type", "title", "url", day("published_at"), "summary")


@query
def feed_records(t):
    return entries.feed_records(entries.parse_feed_lines(a.feed_lines(t)), a.AS_OF)


@query
def library_dois_bib(t):
    return library.dois_from_bib(a.bib_texts(t)).select("doi", F.col("seq.seq").alias("seq"))


@query
def library_dois_file(t):
    """DOIs of export files that are read entry by entry."""
    folder = shared_folder(t.spark)
    a.land_bib(t, folder)
    return library.dois_from_bib(library.read_bib_entries(t.spark, folder)).select("doi")


@query
def library_dois_json(t):
    return library.dois_from_records(a.library_records(t)).select("doi", F.col("seq.seq").alias("seq"))


@query
def library_dois(t):
    merged = library.library_dois(library.dois_from_bib(a.bib_texts(t)), library.dois_from_records(a.library_records(t)))
    return merged.select("doi", F.col("seq.part").alias("part"), F.col("seq.seq").alias("seq"))


@query
def recency_keep_null(t):
    news = a.news_entries(t)
    kept = news.filter(entries.in_window(entries.entry_time(F.col("published")), a.EVENTS_AS_OF, 7))
    return kept.select("link", "published")


# --- library discovery -------------------------------------------------------

def _cutoff():
    return ago(a.LIBRARY_AS_OF, days=365)


def _library(t):
    return discovery.resolve_library(a.order_library(t), a.order_works(t))


@query
def library_resolve(t):
    return _library(t)


@query
def top_authors(t):
    return discovery.top_authors(_library(t), a.line_authorships(t), 15)


@query
def collect_watched(t):
    """All three selections over nested works, in one pass."""
    found = works.collect_works(a.nested_works(t), a.WATCHED_ORDERS, a.WATCHED_CUSTOMERS, a.WATCHED_AUTHORS, a.LIBRARY_AS_OF, 365)
    return found.select("source", "source_type", "title", "url", "doi", day("published_at"), "venue", "is_preprint")


@query
def library_citing(t):
    found = discovery.recent_citing(a.order_works(t), _library(t), a.line_citations(t), _cutoff())
    return found.select("work_id", day("published"))


@query
def library_by_author(t):
    authors = discovery.top_authors(_library(t), a.line_authorships(t), 15)
    found = discovery.recent_by_authors(a.order_works(t), authors, a.line_authorships(t), _cutoff())
    return found.select("work_id", day("published"))


@query
def library_discovery(t):
    found = discovery.discover(a.order_works(t), _library(t), a.line_citations(t), a.line_authorships(t),
                               _cutoff(), DiscoverySettings(discovery_days=365))
    return found.select("work_id", "source", day("published"))


@query
def library_discovery_stored(t):
    """Discovery from works and edges that two sweeps have stored, one of them twice."""
    store = graph.WorkGraph(t.spark, shared_folder(t.spark), buckets=8)
    nested = materialize(a.nested_works(t))
    second = F.endswith("id", F.lit("1"))
    for turn, part in enumerate((~second, second, second)):
        store.add(nested.filter(part), min(turn, 1))
    library_ = discovery.resolve_library(a.order_library(t), store.works())
    found = discovery.discover(store.works(), library_, store.citations(), store.authorships(), _cutoff(), DiscoverySettings(discovery_days=365))
    return found.select("work_id", "source", day("published"))


@query
def distinct_first(t):
    return discovery.distinct_first(t.lineitem, "l_partkey", "l_orderkey")


# --- enrichment and packing --------------------------------------------------

@query
def abstract_backfill(t):
    return enrichment.backfill(a.backfill_items(t), a.abstracts(t)).select("id", "summary")


def _attempts(t, **budget):
    return enrichment.budgeted_lookup(a.backfill_items(t), a.abstracts(t), **budget)


@query
def backfill_budget(t):
    return _attempts(t, limit=60, give_up_after=10).select(F.col("seq").alias("doc_id"), F.col("tried").cast("int").alias("tried"),
                               F.col("filled").cast("int").alias("filled"))


@query
def backfill_budget_by_source(t):
    found = _attempts(t, partition_by=["source"], limit=2, give_up_after=1)
    return found.select(F.col("seq").alias("doc_id"), "source", F.col("tried").cast("int").alias("tried"),
                        F.col("filled").cast("int").alias("filled"))


@query
def backfill_counters(t):
    counts = enrichment.backfill_counters(a.backfill_items(t), _attempts(t, limit=60, give_up_after=10), give_up_after=10)
    return counts.withColumn("gave_up", F.col("gave_up").cast("int"))


@query
def budget_pack(t):
    blocks = packing.pack_budget(a.notes(t), ["conv_id"], "turn", max_chars=600, header="NOTES\n")
    return packing.describe_blocks(blocks)


# --- health and retention ----------------------------------------------------

@query
def last_n_runs(t):
    return health.last_n_runs(a.runs(t), tiebreak="run_id").select("source", "run_id", "ok", "recency")


@query
def failing_sources(t):
    return health.failing_sources(a.runs(t), tiebreak="run_id")


@query
def prune_items(t):
    return retention.prune_items(labelled_items(t), 6, a.AS_OF, keep_days=10).select("id", "score")


@query
def prune_runs(t):
    return retention.prune_runs(a.runs(t), a.EVENTS_AS_OF, keep_days=12).select("run_id", "source")


# --- stored tables -----------------------------------------------------------

@query
def stored_items(t):
    """Items appended twice to a stored table, less what retention takes out of it."""
    path, found = f"{shared_folder(t.spark)}/items", a.items(t).withColumn("source_ord", F.lit(0)).withColumn("seq", F.col("doc_id"))
    for _ in range(2):
        tables.append_items(found, path, a.AS_OF)
    tables.prune_item_table(t.spark, path, a.label_scores(t), 6, a.AS_OF, 10)
    return tables.read_items(t.spark, path).select("id", "title", "source", day("published_at"))


@query
def stored_items_indexed(t):
    """Items appended in three sweeps that overlap, compared with the index of stored ids alone."""
    path, found = f"{shared_folder(t.spark)}/items", a.items(t).withColumn("source_ord", F.lit(0)).withColumn("seq", F.col("doc_id"))
    store = keys.KeyStore(t.spark, f"{shared_folder(t.spark)}/keys", buckets=8, merge_runs=2)
    for turn in range(3):
        tables.append_items(found.filter(mod("doc_id", 3) <= turn).withColumn("title", F.concat(F.lit(f"{turn} "), "title")),
                            path, a.AS_OF, keys=store)
    return tables.read_items(t.spark, path).select("id", "title", "source", day("published_at"))


@query
def stored_runs(t):
    """Run records of three sweeps, less the days that retention drops, from a time on."""
    path = f"{shared_folder(t.spark)}/runs"
    log = t.events.groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("fetched")).select(
        "source", "fetched", F.lit(1).alias("ok"), F.concat(text_of("fetched"), F.lit(" events")).alias("note"))
    for at in a.RUN_TIMES:
        tables.append_runs(log, path, at)
    tables.prune_run_table(t.spark, path, a.AS_OF, 10)
    runs = tables.read_runs(t.spark, path, "2024-01-18 12:00:00")
    return runs.select("source", "fetched", "ok", "note", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"))


@query
def stored_report(t):
    """The listing as its report file has it."""
    path = f"{shared_folder(t.spark)}/report"
    tables.write_report(dashboard_listing(t), path)
    return t.spark.read.parquet(path)


@query
def collect_plugins(t):
    """Collectors run one by one, one of which is broken: its record says so, the others' items are there."""
    def broken(spark):
        return t.events.select(F.raise_error(F.lit("feed is down")).cast("string").alias("title"))

    frames = a.collectors(t)
    plugins = {name: (lambda spark, df=df: df) for name, df in frames.items()} | {"broken": broken}
    items, log = registry.collect_all(t.spark, plugins, f"{shared_folder(t.spark)}/staging")
    found = items.groupBy("collector").agg(F.count("title").alias("titles"), F.count("url").alias("urls"))
    return log.join(found, log["source"] == found["collector"], "left").select(
        "source", "fetched", "ok", F.coalesce("titles", F.lit(0)).alias("titles"), F.coalesce("urls", F.lit(0)).alias("urls"))


@query
def collect_landed(t):
    """Two collectors that parse landed files in tasks, and one whose files are broken."""
    folder = shared_folder(t.spark)
    news = a.news_entries(t).select("query", "title", "link", "published")
    talks = t.conversations.select("role", "text")
    a.land_json(news, f"{folder}/news", 3)
    a.land_json(talks, f"{folder}/talks", 2)
    t.pages.select(F.concat(F.lit("no JSON: "), "url").alias("value")).write.text(f"{folder}/pages")
    schemas = {"news": "title string, link string, published string", "talks": "role string, text string", "pages": "url string"}

    def collector(name):
        return lambda spark: landed.read_landed(spark, f"{folder}/{name}", landed.json_lines, schemas[name], 1 << 16)

    items, log = registry.collect_all(t.spark, {name: collector(name) for name in schemas}, f"{folder}/staging")
    found = items.groupBy("collector").agg(F.count("title").alias("titles"), F.count("text").alias("texts"))
    return log.join(found, log["source"] == found["collector"], "left").select(
        "source", "fetched", "ok", F.coalesce("titles", F.lit(0)).alias("titles"), F.coalesce("texts", F.lit(0)).alias("texts"))


def _landed_notes(t):
    folder = shared_folder(t.spark)
    a.land_notes(t, folder)
    return notes.read_notes(t.spark, folder)


@query
def notes_read(t):
    """Landed notes, read as files."""
    return _landed_notes(t).select("name", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("digest"))


@query
def notes_block(t):
    """The reference block of a scorer's prompt: landed notes, packed under its budget."""
    return packing.describe_blocks(packing.pack_budget(_landed_notes(t), [], "name", max_chars=6000, header="NOTES\n"))


@query
def whole_sweep(t):
    """One sweep over stored items and scores: what it stores, logs, reports and keeps, all from the same rows."""
    stored = a.items(t).join(t.labels.select("doc_id"), "doc_id", "left_semi")
    cfg = plan.SweepSettings(a.TERMS, a.WORKSTREAMS, a.WEIGHTS, a.REPORT, keep_days=10)
    out = plan.sweep(a.collected_twice(t), ingest.conform(stored, ITEM), ingest.conform(a.label_scores(t), SCORE), a.own_abstracts(t),
                     a.AS_OF, cfg, last_sent="2024-01-18 09:00:00")
    log = out["run_log"].select(F.concat("source", F.lit(": "), "note").alias("id"), F.col("fetched").cast("int").alias("score"))
    parts = {name: out[name].select("id", "score") for name in ("new_scores", "listing", "top_picks", "shortlist", "digest_rows", "kept")}
    parts |= {"new_items": out["new_items"].select("id", F.length("summary").alias("score")), "run_log": log}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("part"), "id", F.col("score").cast("int").alias("score"))
                                          for name, rows in parts.items()])


# --- journals ----------------------------------------------------------------

@query
def watchlist_audit(t):
    return journals.watchlist_audit(a.journals(t), a.AUDITED_ISSNS)


@query
def journal_lookup(t):
    return journals.journal_lookup(a.journals(t), a.LOOKUP_NAMES, limit=4)


@query
def misspelt_lookup(t):
    return journals.misspelt_lookup(a.journals(t), a.misspelt_names(t))


# --- streaming ---------------------------------------------------------------

def _event_stream(t: Tables) -> DataFrame:
    return sweep.read_stream(t.spark, t.sf_dir, t.events.schema, pattern="events*.parquet")


def _to_files(t: Tables, stream: DataFrame) -> DataFrame:
    folder = shared_folder(t.spark)
    sweep.run_to_end(stream.writeStream.format("parquet").outputMode("append")
                     .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query
def stream_sweep(t):
    folder = shared_folder(t.spark)
    stream = a.stream_items(_event_stream(t))
    sweep.sweep_stream(stream, f"{folder}/items", f"{folder}/state", ["event_id"])
    return t.spark.read.parquet(f"{folder}/items").select("id", "event_id", "event_type")


@query
def stream_dedupe(t):
    stream = a.stream_items(_event_stream(t))
    return _to_files(t, sweep.dedupe_stream(stream, ["id"])).select("id")


@query
def stream_daily(t):
    counts = sweep.daily_counts(_event_stream(t), "ts", ["event_type"])
    folder = shared_folder(t.spark)
    sweep.write_complete(counts, f"{folder}/out", f"{folder}/state")
    return t.spark.read.schema(counts.schema).parquet(f"{folder}/out").select(day("day"), "event_type", "n")


def _deliveries(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark)
    a.deliveries(t, folder)
    return sweep.read_stream(t.spark, folder, t.events.schema, max_files=1)


@query
def stream_sweep_indexed(t):
    """Files that arrive one by one, some rows late: each id is stored once, by way of a bounded state and the index of ids."""
    folder = shared_folder(t.spark)
    store = keys.KeyStore(t.spark, f"{folder}/keys", buckets=8, merge_runs=2)
    sweep.sweep_indexed(a.stream_items(_deliveries(t)), f"{folder}/items", f"{folder}/state", ["event_id"], store, "ts", look_back="7 days")
    return t.spark.read.parquet(f"{folder}/items").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("event_type"))


@query
def stream_days(t):
    """Daily counts kept day by day while files, and late rows, come in."""
    counts = sweep.daily_counts(_deliveries(t), "ts", ["event_type"])
    folder = shared_folder(t.spark)
    sweep.write_days(counts, f"{folder}/out", f"{folder}/state", ["event_type"])
    return sweep.read_days(t.spark, f"{folder}/out", counts.schema).select(day("day"), "event_type", "n")


@query
def stream_failures(t):
    folder = shared_folder(t.spark)
    events = _event_stream(t)
    stream = a.runs_of(events)
    live.failure_stream(stream, f"{folder}/latest", f"{folder}/state", tiebreak="run_id")
    return live.current_failures(t.spark, f"{folder}/latest", stream.schema, tiebreak="run_id")
