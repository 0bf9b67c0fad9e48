"""Text cleaning and shaping as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from fieldscope.functions.columns import (
    collapse_space, is_blank, let, moment, strip)

# Entities decoded by built-in string replacement.  The ampersand itself comes
# last, so a decoded "&" is never read as the start of another entity.
NATIVE_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
    ("&amp;", "&"),
)
_NATIVE_NAMES = "|".join(entity[1:] for entity, _ in NATIVE_ENTITIES)
# An ampersand that could open an entity outside the list above.
_NEEDS_FULL_DECODER = f"&(?!(?:{_NATIVE_NAMES}))[#A-Za-z]"


@F.pandas_udf(T.StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Decode HTML entities.

    The usual handful is replaced natively.  Only rows holding anything else
    (numeric, rare or unterminated entities) are sent to Python, as NULLs are
    all the other rows contribute to the Arrow batches.
    """
    native = c
    for entity, char in NATIVE_ENTITIES:
        native = F.replace(native, F.lit(entity), F.lit(char))
    native = F.when(F.contains(c, F.lit("&")), native).otherwise(c)
    full = _unescape_all(F.when(c.rlike(_NEEDS_FULL_DECODER), c))
    return F.coalesce(full, native)


def cut(c: Column, limit: int | None) -> Column:
    """Cut to ``limit`` characters, if any; an ellipsis marks what was cut."""
    if limit is None:
        return c
    return F.when(F.length(c) > limit,
                  F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("…"))).otherwise(c)


def _untag(c: Column, limit: int | None) -> Column:
    plain = F.trim(collapse_space(F.regexp_replace(c, "<[^>]+>", " ")))
    return let(plain, lambda text: cut(text, limit))


def strip_html(c: Column, limit: int | None = None) -> Column:
    """HTML to plain text.  Entities are decoded first, so escaped
    markup goes too; script and style bodies stay, since only tags are removed."""
    return F.coalesce(_untag(unescape(c), limit), F.lit(""))


def strip_titled_html(c: Column, element: str = "jats:title", limit: int | None = None) -> Column:
    """Drop a title element with its content, then :func:`strip_html`."""
    untitled = F.regexp_replace(c, f"(?is)<{element}>.*?</{element}>", " ")
    return strip_html(untitled, limit)


def place_tokens(inverted: Column) -> Column:
    """The text of a token -> positions map: tokens in order of (position, token).

    Give the result a column of its own before cleaning it, as a cleaning step
    that needs Python would otherwise evaluate it more than once.
    """
    placed = F.flatten(F.transform(
        F.map_entries(inverted),
        lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("token")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["token"]), " ")


def title_key(c: Column) -> Column:
    """Lower-cased, whitespace-collapsed title for near-duplicate matching."""
    return F.coalesce(F.trim(collapse_space(F.lower(c))), F.lit(""))


def last_segment(c: Column) -> Column:
    return F.coalesce(F.substring_index(c, "/", -1), F.lit(""))


def flatten_cut(c: Column, limit: int | None = None) -> Column:
    """Newlines to spaces, trimmed; a limit cuts without a mark."""
    flat = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    return strip(flat) if limit is None else F.substring(strip(flat), 1, limit)


def scoring_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def age_label(when: Column, as_of) -> Column:
    """'today', '1 day ago' or 'N days ago' for a date or timestamp."""
    elapsed = F.timestamp_diff("DAY", when.cast("timestamp_ntz"), moment(as_of).cast("timestamp_ntz"))
    return let(elapsed, lambda days: (
        F.when(days <= 0, F.lit("today"))
        .when(days == 1, F.lit("1 day ago"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))))


def source_label(venue: Column, source: Column, is_preprint: Column) -> Column:
    """Venue if known, else source; preprints outside arXiv are marked."""
    name = F.when(is_blank(venue), F.coalesce(source, F.lit(""))).otherwise(strip(venue))
    return let(F.struct(name.alias("name"), is_preprint.alias("flag")), lambda x: (
        F.when((x["flag"] == 1) & ~F.contains(F.lower(x["name"]), F.lit("arxiv")),
               F.concat(x["name"], F.lit(" (preprint)")))
        .otherwise(x["name"])))


def digest_line(score: Column, title: Column, source: Column, why: Column, url: Column) -> Column:
    return F.concat(
        F.lit("["), score.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")),
        F.lit(" — "), F.coalesce(source, F.lit("")),
        F.lit("\n    "), F.coalesce(why, F.lit("")),
        F.lit("\n    "), F.coalesce(url, F.lit("")))
