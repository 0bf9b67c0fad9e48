"""The periodic digest: rows, groups, and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldscope.functions.columns import ago, effective_time, moment
from fieldscope.functions.text import digest_line
from fieldscope.plans.reports import from_library, library_shortlist, tag_lookup
from fieldscope.settings import DEFAULT_COLOR, FAILURE_STREAK, NO_TAG, OTHER_LABEL, ReportSettings


def digest_since(as_of, last_sent=None, hours: int = 36) -> Column:
    """The later of the last digest and the start of the look-back."""
    floor = ago(as_of, hours=hours)
    return floor if last_sent is None else F.greatest(floor, F.coalesce(moment(last_sent), floor))


def _group_position(workstreams) -> Column:
    """Position of a row's workstream; everything unknown comes last."""
    if not workstreams:
        return F.lit(0)
    pairs = [F.lit(x) for at, w in enumerate(workstreams) for x in (w.tag, at)]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(F.col("tag"), F.lit(NO_TAG))], F.lit(len(workstreams)))


def digest_rows(scored: DataFrame, as_of, workstreams, cfg: ReportSettings = ReportSettings(),
                last_sent=None) -> DataFrame:
    """Rows of the digest under their workstream.  Groups of any size stay
    spread out: the order is carried by columns, not by a gathered list."""
    recent = scored.filter((F.col("fetched_at") >= digest_since(as_of, last_sent, cfg.digest_hours))
                           & ~from_library() & (F.col("score") >= cfg.digest_floor))
    return recent.select(
        _group_position(workstreams).alias("group_ord"),
        tag_lookup(workstreams, "label", F.lit(OTHER_LABEL)).alias("group_label"),
        tag_lookup(workstreams, "color", F.lit(DEFAULT_COLOR)).alias("group_color"),
        "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "source")], "score",
        F.coalesce("rationale", F.lit("")).alias("why"),
        effective_time(F.col("published_at"), F.col("fetched_at")).alias("effective_at"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """Non-empty groups in workstream order with their row counts."""
    return (rows.groupBy("group_ord", "group_label", "group_color").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("group_ord"))


def digest_header(rows: DataFrame, library: DataFrame, as_of) -> DataFrame:
    """One row with the counts, or no row when there is nothing to send."""
    each = rows.select(F.lit(0).alias("lib")).unionByName(library.select(F.lit(1).alias("lib")))
    return (each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lib") == 1).alias("n_library"))
            .filter(F.col("n") > 0)
            .withColumn("date", F.to_date(moment(as_of)).cast("string")))


def digest_lines(rows: DataFrame) -> DataFrame:
    """One text block per row; (group_ord, score desc, effective_at desc, id)
    is the reading order."""
    return rows.select(
        "group_ord", "score", "effective_at", "id",
        digest_line(F.col("score"), F.col("title"), F.col("source"), F.col("why"), F.col("url")).alias("line"))


def library_lines(scored: DataFrame, as_of, cfg: ReportSettings = ReportSettings()) -> DataFrame:
    """The library shortlist in the same shape, ahead of all workstreams."""
    shaped = library_shortlist(scored, as_of, cfg).select(
        F.lit(-1).alias("group_ord"), "score",
        effective_time(F.col("published_at"), F.col("fetched_at")).alias("effective_at"), "id",
        "title", "source", F.col("rationale").alias("why"), "url")
    return digest_lines(shaped)


def digest_text(rows: DataFrame, library: DataFrame, failures: DataFrame, as_of, title: str,
                streak: int = FAILURE_STREAK) -> DataFrame:
    """The whole digest as sorted lines (group_ord, section, ..., line), ready for a
    text sink.  The sort is a distributed one."""
    body = digest_lines(rows).unionByName(library).withColumn("section", F.lit(1))
    heads = (digest_groups(rows).select("group_ord", F.concat(F.lit("== "), F.col("group_label"), F.lit(" ==")).alias("line"))
             .unionByName(library.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
                 F.lit(-1).alias("group_ord"),
                 F.concat(F.lit("== From your library · top "), F.col("n").cast("string"), F.lit(" ==")).alias("line")))
             .withColumn("section", F.lit(0)))
    day = F.to_date(moment(as_of)).cast("string")
    top = digest_header(rows, library, as_of).select(
        F.lit(-2).alias("group_ord"), F.lit(0).alias("section"),
        F.concat(F.lit(title), F.lit(" — "), day, F.lit("\n"), F.col("n").cast("string"), F.lit(" items")).alias("line"))
    # Source names are as many as there are configured sources.
    broken = failures.agg(F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("names")).filter(
        F.col("names") != "").select(
        F.lit(1_000_000).alias("group_ord"), F.lit(0).alias("section"),
        F.concat(F.lit(f"Source failures ({streak} consecutive): "), F.col("names")).alias("line"))
    parts = [body, heads, top, broken]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.orderBy("group_ord", "section", F.col("score").desc(), F.col("effective_at").desc(), "id")
