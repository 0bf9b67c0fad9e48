"""Quality rules as a short-circuit cascade.

Each rule rejects a document or passes it on.  What a rule costs and how much it
rejects is measured on a bounded sample; rules then run by rejections per second,
and the first that rejects ends the work on a document.  The verdict is that any
rule rejects, so the sample decides how fast it is found, never what it is.  Rows
are drawn at random from all files and measured where they are read; only
each rule's sums come back.

* A NULL text is an empty one: no words, and too few of them.
* Repeated rows and ties are judged alike, row by row; no rows, no verdicts.
* All counts are over whole texts of any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldscope.llm.common import small_batches

WINDOW = 8
SAMPLE = 1000  # texts, about so many, on which costs and rejections are estimated
_SEED = 20240605
_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))


class Features:
    """What rules ask of a text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def bytes(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()  # at exactly the six white-space bytes

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        raw = self.bytes
        return len(self.text) - (len(raw) - len(raw.translate(None, _BLANK)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.bytes) - len(self.bytes.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.bytes.split(b"\n") if x.strip(_BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Capital and small letters among a to z."""
        raw = self.bytes
        return len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words (a power of 2) that occur twice or more, overlaps counted.

    Windows get numbers by doubling: a window is a pair of numbered halves.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    half = 1
    while half < width:
        pairs = ids[:-half] * (int(ids.max()) + 1) + ids[half:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        half *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Features], bool]


def few_words(t: Features) -> bool:
    return t.n_words < 20


def repeats_itself(t: Features) -> bool:
    return 100 * t.n_repeat_words > 30 * t.n_words


def full_of_symbols(t: Features) -> bool:
    return 10 * t.n_symbols > t.n_words


def repeats_lines(t: Features) -> bool:
    return 2 * t.n_dup_lines > len(t.lines)


def stutters(t: Features) -> bool:
    return 10 * sum(map(eq, t.words, t.words[1:])) > 3 * t.n_words


def odd_word_length(t: Features) -> bool:
    return t.n_words > 0 and not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


def shouts(t: Features) -> bool:
    capital, small = t.letters
    return 10 * capital > 3 * (capital + small)


BASE = (Rule("few_words", few_words), Rule("repeats_itself", repeats_itself))
RULES = (*BASE, Rule("full_of_symbols", full_of_symbols), Rule("repeats_lines", repeats_lines),
         Rule("odd_word_length", odd_word_length), Rule("shouts", shouts), Rule("stutters", stutters))


def measured(rules: Iterable[Rule], texts: Iterable[str | None]) -> dict[str, tuple[int, float]]:
    """How many of these texts each rule rejects, and the seconds it takes.

    Each rule is timed on fresh features, so it pays for all that it asks for.
    """
    rules = list(rules)
    rejected, seconds = dict.fromkeys((r.name for r in rules), 0), dict.fromkeys((r.name for r in rules), 0.0)
    for text in texts:
        for rule in rules:
            began = time.perf_counter()
            rejected[rule.name] += bool(rule.rejects(Features(text)))
            seconds[rule.name] += time.perf_counter() - began
    return {name: (rejected[name], seconds[name]) for name in rejected}


def _by_gain(rules: Iterable[Rule], sums: dict[str, tuple[int, float]]) -> list[Rule]:
    def gain(rule: Rule) -> float:
        rejected, seconds = sums.get(rule.name, (0, 0.0))
        return rejected / max(seconds, 1e-9)

    return sorted(rules, key=lambda r: -gain(r))


def by_rejection_per_cost(rules: Iterable[Rule], texts: Iterable[str | None]) -> list[Rule]:
    """The rules, those first that reject most for the time they take on these texts."""
    rules = list(rules)
    return _by_gain(rules, measured(rules, texts))


def first_rejecting(rules: Iterable[Rule], t: Features) -> str | None:
    return next((r.name for r in rules if r.rejects(t)), None)


def planned(documents: DataFrame, rules: Iterable[Rule] = RULES) -> list[Rule]:
    """The order for these documents, from about SAMPLE of all their rows; texts are measured in tasks and stay there."""
    small_batches(documents.sparkSession)
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = measured(rules, (text.as_py() for batch in batches for text in batch.column(0)))
        columns = [list(sums), *zip(*sums.values())] if sums else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.float64()))],
                                         ["rule", "rejected", "seconds"])

    drawn = documents.select("text").sample(min(1.0, SAMPLE / max(1, documents.count())), _SEED)
    sums = drawn.mapInArrow(run, "rule string, rejected long, seconds double").groupBy("rule").agg(
        F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    return _by_gain(rules, {r.rule: (r.rejected, r.seconds) for r in sums.collect()})


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean")


def judge(documents: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Counts and verdict of each document."""
    ordered = planned(documents, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                t = Features(text.as_py())
                kept = first_rejecting(ordered, t) is None
                rows.append((doc_id.as_py(), t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words,
                             first_rejecting(BASE, t) is not None, kept))
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def clean_documents(documents: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns; a rejected one costs no more than it needs."""
    ordered = planned(documents, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([first_rejecting(ordered, Features(t.as_py())) is None for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op5_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_W = r"[^\x20\x09-\x0D]"
QUALITY_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '{_W}+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM texts),
grams AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM parts WHERE len(w) > 7)),
often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
inside AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS at FROM often),
again AS (SELECT doc_id, count(*) AS n FROM inside GROUP BY 1),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capital, length(regexp_replace(t, '[^a-z]', '', 'g')) AS small
  FROM parts LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutters > 3 * n_words
            OR n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)
            OR 10 * capital > 3 * (capital + small)) AS kept
FROM counts"""
