"""Radar tables derived from the benchmark tables.

The rules are arbitrary but fixed; ``oracle.py`` states the same ones in SQL.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldscope.functions.columns import let
from fieldscope.functions.identity import item_id
from fieldscope.operators import discovery
from fieldscope.settings import ReportSettings, TermModel, VenueWeights, Workstream
from fieldscope.sources.landed import located

AS_OF = "2024-01-20 12:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"
LIBRARY_AS_OF = "2001-08-01 00:00:00"
AGE_AS_OF = "2001-08-02 00:00:00"

# Fragments of the invented prose of the documents table.
TERMS = TermModel(
    topic=("that", "grid", "er"), region=("la",), exclude=("%%%",),
    tags={"a": ("tion", "the"), "b": ("und", "sch", "en"), "c": ("que", "ción", "ou")})
WORKSTREAMS = (
    Workstream("a", "Alpha", "#111111"), Workstream("b", "Beta", "#222222"), Workstream("c", "Gamma", "#333333"))
TAGS = tuple(w.tag for w in WORKSTREAMS)
WEIGHTS = VenueWeights()
REPORT = ReportSettings()

TOPIC_QUERIES = ("the and", "que la", "der die", "zebra quantum")
WATCHED_ISSNS = ("Brand#3", "Brand#7", "Brand#77")
AUDITED_ISSNS = ("Brand#1", "Brand#3", "Brand#7", "Brand#12", "Brand#25", "Brand#26", "Brand#77")
WATCHED_AUTHORS = ("3", "7", "42")
WATCHED_ORDERS = ("urgent order", "low zebra", "order f")
WATCHED_CUSTOMERS = ("C-3", "C-7", "C-77")
RUN_TIMES = ("2024-01-05 06:00:00", "2024-01-18 06:00:00", "2024-01-19 18:00:00")
LOOKUP_NAMES = ("red widget", "blue bolts", "Hot  Ring", "quantum journal")


class Tables:
    """Lazy access to the benchmark tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def mod(name: str, n: int) -> Column:
    return F.col(name) % n


def text_of(name: str) -> Column:
    return F.col(name).cast("string")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def base_day(name: str) -> Column:
    """Days spread over 2024-01-01 to 2024-01-20."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"cast(({name} div 7) % 20 as int)"))


def title_of(name: str = "text") -> Column:
    """A text's title is its first line ..."""
    return F.substring_index(name, "\n", 1)


def rest_of(name: str = "text") -> Column:
    """... and its summary all the rest, so nothing of a text is lost."""
    return F.expr(f"substring({name}, length(substring_index({name}, '\\n', 1)) + 2)")


def items(t: Tables) -> DataFrame:
    """Items from documents.  Where there is no summary the whole text is the title."""
    bare = mod("doc_id", 5) == 0
    paper = mod("doc_id", 3) == 0
    doi = F.when(paper, F.concat(F.lit("10.5555/"), text_of("doc_id")))
    url = F.concat(F.lit("https://example.org/doc/"), text_of("doc_id"))
    base = base_day("doc_id")
    return t.documents.select(
        "doc_id", item_id(doi, url).alias("id"),
        F.when(F.col("source") == "src0", F.lit("library: cites")).otherwise(F.col("source")).alias("source"),
        F.when(paper, "paper").when(mod("doc_id", 3) == 1, "news").otherwise("org").alias("source_type"),
        F.when(bare, F.col("text")).otherwise(title_of()).alias("title"), url.alias("url"), doi.alias("doi"),
        F.when(mod("doc_id", 11) != 0, base).alias("published_at"),
        (base.cast("timestamp") + F.expr("INTERVAL 6 HOUR")).alias("fetched_at"),
        F.when(bare, F.lit("")).otherwise(rest_of()).alias("summary"),
        F.when(mod("doc_id", 9) == 0, F.lit("arXiv"))
        .when(mod("doc_id", 6) == 0, F.concat(F.lit("Journal of "), F.col("lang")))
        .when(mod("doc_id", 6) == 3, F.lit("  ")).alias("venue"),
        F.when(paper & mod("doc_id", 4).isin(0, 1), 0).when(paper & (mod("doc_id", 4) == 2), 1).alias("is_preprint"))


def label_scores(t: Tables) -> DataFrame:
    """Existing scores from labels."""
    doi = F.when(mod("doc_id", 3) == 0, F.concat(F.lit("10.5555/"), text_of("doc_id")))
    url = F.concat(F.lit("https://example.org/doc/"), text_of("doc_id"))
    tag = (F.when(mod("doc_id", 5) == 0, "a").when(mod("doc_id", 5) == 1, "b").when(mod("doc_id", 5) == 2, "c")
           .when(mod("doc_id", 5) == 4, "zzz"))
    return t.labels.select(
        item_id(doi, url).alias("id"),
        F.greatest(F.lit(0), F.col("quality") * 10 - F.col("toxic") * 3).cast("int").alias("score"),
        tag.alias("tag"), F.concat(F.lit("label "), text_of("doc_id")).alias("rationale"),
        base_day("doc_id").cast("timestamp").alias("scored_at"), F.lit("labels").alias("scorer"))


def duplicate_items(t: Tables) -> DataFrame:
    """Documents identified by their text, so that copies share an id."""
    return t.documents.select(F.sha1("text").alias("id"), "doc_id", "source",
                              F.lit(0).alias("source_ord"), F.col("doc_id").alias("seq"))


def inverted_index(t: Tables) -> DataFrame:
    """(doc_id, inverted): every document's words with their positions."""
    return _spread(t.documents).select("doc_id", _inverted(F.col("text")).alias("inverted"))


def _spread(documents: DataFrame) -> DataFrame:
    """Documents over all tasks: the file may be one row group, and an index costs far more than its text's way."""
    return documents.repartition("doc_id")


def _inverted(text: Column) -> Column:
    """Word -> positions, inside the row: equal words are neighbours after a
    sort, so each run of them becomes one entry."""
    placed = F.sort_array(F.transform(
        F.split(text, " "), lambda word, at: F.struct(word.alias("word"), at.alias("at"))))

    def entries(words: Column) -> Column:
        n = F.size(words)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (
            (i == 0) | (words[i]["word"] != words[F.greatest(i - 1, F.lit(0))]["word"])))
        return let(starts, lambda s: F.map_from_entries(F.transform(s, lambda start, k: F.struct(
            words[start]["word"], F.transform(
                F.slice(words, start + 1, F.coalesce(F.get(s, k + 1), n) - start), lambda w: w["at"])))))

    return let(placed, entries)


def works(t: Tables) -> DataFrame:
    """Nested work records from documents, as the works API would return them."""
    host = F.struct(F.col("source").alias("display_name"),
                    F.when(F.col("lang") == "de", "Repository").otherwise("journal").alias("type"),
                    F.array(F.col("lang")).alias("issn"))
    place = F.struct(F.when(mod("doc_id", 5) != 0, F.concat(F.lit("https://example.org/w/"), text_of("doc_id")))
                     .alias("landing_page_url"), host.alias("source"))
    return _spread(t.documents).select(
        "doc_id", F.concat(F.lit("https://openalex.org/W"), text_of("doc_id")).alias("id"),
        F.when(mod("doc_id", 3) == 0, F.concat(F.lit("https://doi.org/10.5555/"), text_of("doc_id")))
        .when(mod("doc_id", 3) == 2, F.concat(F.lit("10.5555/"), text_of("doc_id"))).alias("doi"),
        F.when(mod("doc_id", 7) == 1, F.lit("")).when(mod("doc_id", 7) != 0, title_of()).alias("title"),
        F.when(mod("doc_id", 4) == 2, "preprint").otherwise("article").alias("type"),
        F.when(mod("doc_id", 11) == 0, F.lit("")).otherwise(base_day("doc_id").cast("string")).alias("publication_date"),
        F.when(mod("doc_id", 10) != 9, place).alias("primary_location"),
        _inverted(F.col("text")).alias("abstract_inverted_index"))


def preprint_entries(t: Tables) -> DataFrame:
    at = F.concat(base_day("doc_id").cast("string"), F.lit("T06:00:00Z"))
    return t.documents.select(
        title_of().alias("title"), rest_of().alias("summary"),
        F.concat(F.lit("https://example.org/p/"), text_of("doc_id")).alias("link"),
        F.when(mod("doc_id", 11) != 0, at).alias("published"), F.array("lang", "source").alias("categories"),
        F.when(mod("doc_id", 2) == 0, F.concat(F.lit("10.5555/"), text_of("doc_id"))).alias("doi"))


def news_entries(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_type").alias("query"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit(" "), text_of("event_id"), F.lit("\n")).alias("title"),
        F.concat(F.lit("https://news.example.org/"), text_of("event_id")).alias("link"),
        F.concat(F.lit("<p>user&nbsp;"), text_of("user_id"), F.lit(" &amp; <b>"), F.col("props"),
                 F.lit("</b></p>")).alias("summary"),
        F.when(mod("event_id", 13) == 0, F.lit(None)).when(mod("event_id", 17) == 0, F.lit("not a date"))
        .otherwise(iso(F.col("ts"))).alias("published"))


def feed_lines(t: Tables) -> DataFrame:
    """Feed entries as raw JSON lines, some of them cut off."""
    at = F.concat(base_day("page_id").cast("string"), F.lit("T08:00:00Z"))
    entry = F.struct(
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("url").alias("link"),
        F.when(mod("page_id", 4) == 0, F.lit("")).otherwise(F.col("html")).alias("summary"),
        F.col("html").alias("description"),
        F.when(mod("page_id", 3) == 0, at).alias("published"), F.when(mod("page_id", 3) == 1, at).alias("updated"))
    whole = F.to_json(entry)
    return t.pages.select(
        "page_id", F.concat(F.lit("feed"), mod("page_id", 7).cast("string")).alias("feed"),
        F.when(mod("page_id", 17) == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("raw"))


def collectors(t: Tables) -> dict[str, DataFrame]:
    """Three heterogeneous sources: each lacks columns the others have."""
    return {
        "works": t.documents.select(
            F.lit("paper").alias("source_type"), title_of().alias("title"),
            F.concat(F.lit("10.5555/"), text_of("doc_id")).alias("doi"), F.col("source").alias("venue")),
        "feeds": t.pages.select(F.lit("org").alias("source_type"), "url"),
        "news": t.conversations.select(
            F.lit("news").alias("source_type"), title_of().alias("title"),
            F.concat(F.lit("https://talk.example.org/"), text_of("conv_id"), F.lit("/"), text_of("turn")).alias("url")),
    }


def page_deliveries(t: Tables) -> DataFrame:
    """Pages delivered twice, the second time with a tracking parameter."""
    url = F.col("url")
    tracked = F.concat(F.regexp_extract(url, "^([^#]*)", 1),
                       F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_medium=mail"))
    once = t.pages.select("page_id", "url", F.lit(0).alias("source_ord"), F.col("page_id").alias("seq"))
    again = t.pages.select("page_id", tracked.alias("url"), F.lit(1).alias("source_ord"), F.col("page_id").alias("seq"))
    return once.unionByName(again).withColumn("id", item_id(F.lit(None).cast("string"), F.col("url")))


def bib_texts(t: Tables) -> DataFrame:
    """One BibTeX entry per order; customers stand for the cited works."""
    key = text_of("o_orderkey")
    cited = F.concat(F.lit("10.1000/ABC."), text_of("o_custkey"))
    field = (F.when(mod("o_orderkey", 4) == 0, F.concat(F.lit("doi = {"), cited, F.lit("}")))
             .when(mod("o_orderkey", 4) == 1, F.concat(F.lit('DOI="https://doi.org/'), cited, F.lit('"')))
             .when(mod("o_orderkey", 4) == 2, F.concat(F.lit("doi =\n{ http://dx.doi.org/"), F.lower(cited), F.lit(" }")))
             .otherwise(F.lit("note = {no identifier}")))
    return t.orders.select(F.col("o_orderkey").alias("seq"), F.concat(
        F.lit("@article{k"), key, F.lit(", title={T}, "), field, F.lit("}")).alias("value"))


BIB_ROWS = 500_000  # entries of one export file, about as many


def land_bib(t: Tables, folder: str) -> None:
    """The entries as export files in their order."""
    files = max(2, -(-t.orders.count() // BIB_ROWS))
    ordered = bib_texts(t).repartitionByRange(files, "seq").sortWithinPartitions("seq")
    ordered.select("value").write.text(folder)


def land_json(rows: DataFrame, folder: str, files: int) -> None:
    """Rows as files of JSON lines, as a collector's fetcher would leave them."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(files).write.text(folder)


def land_notes(t: Tables, folder: str) -> None:
    """A note per conversation, some of them in files that are no notes."""
    conv = F.col("conv_id")
    name = F.concat(conv.cast("string"), F.when(conv % 10 == 3, ".pdf").when(conv % 10 == 5, ".txt").otherwise(".md"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    body = F.concat_ws("\n", F.transform(turns, lambda x: F.concat_ws(": ", x["role"], x["text"])))
    notes = t.conversations.groupBy("conv_id").agg(body.alias("body")).select(name.alias("name"), "body")

    def write(batches):
        where, top = located(folder)
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where.create_dir(top, recursive=True)
                with where.open_output_stream(f"{top}/{file}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    notes.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def library_records(t: Tables) -> DataFrame:
    """Reference-manager records from events; the props key is the cited work."""
    number = F.regexp_extract("props", r"(\d+)", 1)
    kind = F.col("event_type")
    doi = (F.when(kind == "click", F.concat(F.lit("10.2000/K"), number)).when(kind == "view", F.lit(""))
           .when(kind == "purchase", F.concat(F.lit("https://doi.org/10.2000/k"), number))
           .when(kind == "error", F.concat(F.lit("10.2000/attached."), number)))
    extra = F.when(kind == "view", F.concat(F.lit("tex: x\nDOI: 10.2000/v"), number, F.lit(" more")))
    item_type = F.when(kind == "error", "attachment").otherwise("journalArticle")
    return t.events.select(F.col("event_id").alias("seq"), F.lit(0).alias("at"), F.struct(
        item_type.alias("itemType"), doi.alias("DOI"), extra.alias("extra")).alias("data"))


def _order_doi(prefix: str) -> Column:
    return F.concat(F.lit(prefix), text_of("o_orderkey"), F.lit("."), text_of("o_custkey"))


def nested_works(t: Tables) -> DataFrame:
    """Orders as nested work records: their lines' suppliers wrote them and their lines' parts are cited.
    An order has a handful of lines, so each list is short."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("lines"))
    author = lambda x: F.struct(F.struct(F.concat(F.lit("https://openalex.org/A/"), x["l_suppkey"].cast("string")).alias("id")).alias("author"))
    cited = lambda x: F.concat(F.lit("https://openalex.org/W/"), x["l_partkey"].cast("string"))
    host = F.struct(F.lit("Orders").alias("display_name"), F.lit("journal").alias("type"),
                    F.array(F.concat(F.lit("C-"), mod("o_custkey", 40).cast("string"))).alias("issn"))
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("https://openalex.org/W/"), text_of("o_orderkey")).alias("id"), _order_doi("10.7777/W").alias("doi"),
        F.concat("o_orderpriority", F.lit(" order "), "o_orderstatus").alias("title"),
        F.when(F.col("o_orderstatus") == "P", "preprint").otherwise("article").alias("type"),
        F.to_date("o_orderdate").cast("string").alias("publication_date"),
        F.struct(F.lit(None).cast("string").alias("landing_page_url"), host.alias("source")).alias("primary_location"),
        F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"),
        F.transform("lines", author).alias("authorships"), F.transform("lines", cited).alias("referenced_works"))


def order_works(t: Tables) -> DataFrame:
    return discovery.work_table(nested_works(t))


def order_library(t: Tables) -> DataFrame:
    """The reader's library: the urgent orders, as a list of DOIs."""
    return t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select(
        _order_doi("https://doi.org/10.7777/w").alias("doi"), F.col("o_orderkey").alias("seq"))


def line_citations(t: Tables) -> DataFrame:
    return discovery.citation_edges(nested_works(t))


def line_authorships(t: Tables) -> DataFrame:
    return discovery.authorship_edges(nested_works(t))


def backfill_items(t: Tables) -> DataFrame:
    """Items whose DOIs run over a fixed set, so that some have abstracts."""
    doi = F.when(F.col("source_type") == "paper", F.concat(F.lit(" 10.6000/A"), mod("doc_id", 60).cast("string")))
    return items(t).withColumn("doi", doi).withColumn("source_ord", F.lit(0)).withColumn("seq", F.col("doc_id"))


def collected_twice(t: Tables) -> DataFrame:
    """All items as two sources deliver them, the second one under other titles."""
    once = items(t).withColumns({"source_ord": F.lit(0), "seq": F.col("doc_id"), "prefilter_hits": F.lit(None).cast("int")})
    return once.unionByName(once.withColumns({"source_ord": F.lit(1), "title": F.concat(F.lit("again: "), "title")}))


def own_abstracts(t: Tables) -> DataFrame:
    """An abstract for some of the papers that come without."""
    return t.documents.filter(mod("doc_id", 30) == 0).select(
        F.concat(F.lit(" 10.5555/"), text_of("doc_id")).alias("doi"), F.concat(F.lit("<p>the abstract of "), text_of("doc_id"), F.lit("</p>")).alias("abstract"))


def abstracts(t: Tables) -> DataFrame:
    return t.benchmark.select(
        F.concat(F.lit("10.6000/a"), text_of("item_id")).alias("doi"),
        F.concat(F.lit("<jats:title>Abstract</jats:title><jats:p>"), F.col("text"), F.lit("</jats:p>")).alias("abstract"))


def runs(t: Tables) -> DataFrame:
    return runs_of(t.events)


def runs_of(events: DataFrame) -> DataFrame:
    """Run records from events, batch or stream."""
    return events.select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("run_at"),
        text_of("user_id").alias("source"), F.col("event_type").isin("click", "purchase").cast("int").alias("ok"))


def event_scores(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("scored_at"),
        F.when(kind == "error", "prefilter").when(kind == "click", "keyword").when(kind == "view", "remote-a")
        .when(kind == "purchase", "remote-b").alias("scorer"))


def journals(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_name").alias("display_name"), F.when(F.col("p_type") != "SMALL", F.col("p_brand")).alias("issn_l"),
        F.col("p_size").cast("long").alias("works_count"), F.col("p_type").alias("host_organization_name"))


def term_table(t: Tables) -> DataFrame:
    """The words of the benchmark's passages as terms, of a kind by their length."""
    words = t.benchmark.select(F.explode(F.split("text", " ")).alias("term")).filter(F.length("term") >= 3).distinct()
    return words.select(F.element_at(F.array(*map(F.lit, ("topic", "region", "exclude"))), F.length("term") % 3 + 1).alias("kind"), "term")


def query_table(t: Tables) -> DataFrame:
    """A topic query of four words from each question of the conversations."""
    return t.conversations.filter(F.col("role") == "user").select(
        F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query")).distinct()


def misspelt_names(t: Tables) -> DataFrame:
    """Of each part whose key a hundred divides, its name without one letter."""
    place = F.expr("cast((p_partkey div 100) % length(p_name) as int)")
    name = F.col("p_name")
    return t.part.filter(mod("p_partkey", 100) == 0).select(
        F.concat(F.substring(name, F.lit(1), place), F.substring(name, place + 2, F.length(name))).alias("query")).distinct()


def titles(t: Tables) -> DataFrame:
    """Titles of documents and pages with an id each."""
    return (t.documents.select(F.concat(F.lit("d"), text_of("doc_id")).alias("id"), title_of().alias("title"))
            .unionByName(t.pages.select(F.concat(F.lit("p"), text_of("page_id")).alias("id"),
                                        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))))


def notes(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", F.concat(text_of("turn"), F.lit("-"), F.col("role")).alias("name"), F.col("text").alias("body"))


def _reply_id(letter: str) -> Column:
    return F.concat(text_of("conv_id"), F.lit("-"), text_of("turn"), F.lit(f"-{letter}"))


def replies(t: Tables) -> DataFrame:
    """One scorer reply per conversation turn, covering what replies get wrong:
    fences, prose around the array, stray elements, ids nobody asked for, unknown
    tags, scores as text, fractions, booleans or nulls, and broken JSON."""
    at = (F.col("conv_id") * 8 + F.col("turn")) % 8
    quoted = F.to_json(F.struct(F.col("text").alias("why")))
    why = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    score = (F.when(at == 0, "9").when(at == 1, '" 9 "').when(at == 2, "7.9").when(at == 3, '"7.5"')
             .when(at == 4, "true").when(at == 5, "null").when(at == 6, "99").otherwise("-3"))
    tag = F.when(at < 3, "a").when(at < 6, "c").otherwise("nope")
    first = F.concat(F.lit('{"id": "'), _reply_id("a"), F.lit('", "score": '), score, F.lit(', "tag": "'), tag,
                     F.lit('", '), why, F.lit("}"))
    second = F.concat(F.lit('{"score": "12", "rationale": "from ['), F.col("role"), F.lit(']", "id": "'),
                      _reply_id("b"), F.lit('"}'))
    ghost = F.concat(F.lit('{"id": "'), _reply_id("ghost"), F.lit('", "score": 10, "tag": "a"}'))
    array = F.concat(F.lit("["), first, F.lit(", 5, "), ghost, F.lit(', "text", '), second, F.lit(", null]"))
    broken = F.concat(F.lit("["), first, F.lit(", "))
    text = (F.when(at == 7, broken)
            .when(at % 2 == 0, F.concat(F.lit("Here:\n```json\n"), array, F.lit("\n```")))
            .otherwise(array))
    return t.conversations.select(F.concat(text_of("conv_id"), F.lit("-"), text_of("turn")).alias("batch_id"),
                                  text.alias("text"))


def reply_requests(t: Tables) -> DataFrame:
    asked = F.array(*[F.struct(_reply_id(x).alias("id"), F.lit(at).alias("at")) for at, x in enumerate("abc")])
    return t.conversations.select(
        F.concat(text_of("conv_id"), F.lit("-"), text_of("turn")).alias("batch_id"), "turn", "role",
        F.explode(asked).alias("r")).select(
        "batch_id", "r.id", F.when(F.col("r.at") == 1, F.lit(1)).when(mod("turn", 2) == 0, 0).alias("is_preprint"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.lit("has text")).alias("summary"))


def deliveries(t: Tables, folder: str) -> list[str]:
    """Events as they might arrive: in files of ten days each by time, but every seventh one ten days late."""
    at = F.when(mod("event_id", 7) == 0, F.date_add(F.to_date("ts"), 10)).otherwise(F.to_date("ts"))
    bounds = ["0001-01-01", "2024-01-11", "2024-01-21", "9999-01-01"]
    for start, stop in zip(bounds, bounds[1:]):  # one after the other, as a stream takes files by their time
        t.events.filter((at >= F.lit(start).cast("date")) & (at < F.lit(stop).cast("date"))).write.mode("append").parquet(folder)
    return bounds


def stream_items(events: DataFrame) -> DataFrame:
    """Events as items that are delivered again and again: one id per user, day
    and kind of event."""
    identity = F.concat_ws("-", text_of("user_id"), "event_type", F.to_date("ts").cast("string"))
    return events.select(F.sha1(identity).alias("id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
