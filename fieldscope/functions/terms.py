"""Term matching: how many listed terms occur in a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldscope.functions.columns import let, string_list


def _usable(terms) -> list[str]:
    return [t.lower() for t in terms if t]


def count_hits(text: Column, terms) -> Column:
    """Listed terms found as substrings of an already lower-cased text.

    The list is one constant array, so a hundred terms cost a hundred substring
    searches but only one expression node.
    """
    usable = _usable(terms)
    if not usable:
        return F.lit(0)
    return F.size(F.filter(string_list(usable), lambda t: F.contains(text, t)))


def term_hits(text: Column, terms) -> Column:
    return let(text, lambda x: count_hits(x, terms))


def model_hits(text: Column, model) -> Column:
    """All counts of a term model in one struct, computed over one evaluation
    of ``text``: topic, region, exclude, and the best tag with its count.

    Ties go to the tag configured first, hence the negated position.
    """
    def body(x: Column) -> Column:
        fields = [count_hits(x, model.topic).alias("topic"),
                  count_hits(x, model.region).alias("region"),
                  count_hits(x, model.exclude).alias("exclude")]
        if model.tags:
            best = F.array_max(F.array(*[
                F.struct(count_hits(x, terms).alias("hits"), F.lit(-at).alias("rank"),
                         F.lit(tag).alias("tag"))
                for at, (tag, terms) in enumerate(model.tags.items())]))
        else:
            best = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("rank"), F.lit("none").alias("tag"))
        return F.struct(*fields, best.alias("best"))

    return let(text, body)


def matching_terms(text: Column, model) -> Column:
    """array<struct<kind, tag, term>> of the listed terms that occur."""
    listed = [(k, tag, t.lower()) for k, tag, t in model.terms() if t]
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(tag).alias("tag"), F.lit(t).alias("term"))
        for k, tag, t in listed])
    return let(text, lambda x: F.filter(entries, lambda e: F.contains(x, e["term"])))
