"""Small building blocks shared by the other column functions."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F

# Everything Python's str.strip() removes, written as the inside of a regex
# class.  Spark's trim() removes spaces only and its \s is ASCII only.
WHITESPACE = (r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
              r"\u2028\u2029\u202f\u205f\u3000")

# The same characters as a plain set.
_WHITESPACE_CHARS = ("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                     "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A higher-order function evaluates its lambda per element, so an expensive
    expression captured in the lambda would be recomputed for each one, and the
    optimizer may inline a plain projected column back into it.  Binding
    it as a lambda variable keeps it to one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_space(c: Column) -> Column:
    """Every run of whitespace becomes one space.

    The pattern passes over lone spaces, which are most of the runs in ordinary
    text, and rules out printable ASCII before the long class is looked at.
    """
    run = f" [[^!-~]&&[{WHITESPACE}]][{WHITESPACE}]*|[[^ -~]&&[{WHITESPACE}]][{WHITESPACE}]*"
    return F.regexp_replace(c, run, " ")


def strip(c: Column) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(c, F.lit(_WHITESPACE_CHARS))


def file_name() -> Column:
    """Name of the file a row was read from; the scan reports it URL-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def is_blank(c: Column) -> Column:
    """NULL, empty or whitespace only."""
    return c.isNull() | ~c.rlike(f"[^{WHITESPACE}]")


def nonblank(c: Column) -> Column:
    """The value, or NULL when it is blank."""
    return F.when(~is_blank(c), c)


def string_list(values) -> Column:
    """An array<string> literal, also for an empty list."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def moment(as_of) -> Column:
    """``as_of`` as a timestamp in the session's time zone."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc)
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(as_of, date):
        as_of = as_of.isoformat()
    return F.lit(str(as_of)).cast("timestamp")


def ago(as_of, days: int = 0, hours: int = 0) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{int(days) * 24 + int(hours)}' HOUR")


def since(published: Column, fetched: Column, cutoff: Column) -> Column:
    """Is the effective date on or after ``cutoff``?

    A publication date is a bare day and counts only when it lies after the
    cutoff's day; a row without one falls back to its exact fetch time.  Written
    as an OR of plain comparisons so both halves can reach the parquet scan.
    """
    return ((published.isNotNull() & (published > F.to_date(cutoff)))
            | (published.isNull() & (fetched >= cutoff)))


def effective_time(published: Column, fetched: Column) -> Column:
    """Sort key: publication day at midnight, else the fetch time."""
    return F.coalesce(published.cast("timestamp"), fetched)
