import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from fieldscope.llm import quality
from llm import cases


def repeated(words, width=8):
    grams = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= set(range(i, i + width))
    return len(inside)


@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
@settings(deadline=None)
def test_repeated_words(words):
    assert quality.repeated_words(words) == repeated(words)


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    again = repeated(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, again,
            len(words) < 20 or 100 * again > 30 * len(words))


def test_query_counts_whole_texts(spark, tmp_path):
    got = quality.op5_quality_cascade(spark, cases.saved(cases.documents(spark), tmp_path, "documents")).collect()
    want = [(i, *counts(t or "")) for i, t, _, _ in cases.DOCUMENTS]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_no_documents(spark, tmp_path):
    assert quality.op5_quality_cascade(spark, cases.saved(cases.documents(spark, []), tmp_path, "documents")).collect() == []


def test_the_order_follows_gain_and_never_the_verdict():
    calls = []

    def rule(name, answer):
        return quality.Rule(name, lambda t: calls.append(name) or answer)

    ordered = quality.by_rejection_per_cost([rule("never", False), rule("always", True)], ["x"] * 50)
    assert [r.name for r in ordered] == ["always", "never"]
    calls.clear()
    assert quality.first_rejecting(ordered, quality.Features("x")) == "always" and calls == ["always"]
    texts = [t for _, t, _, _ in cases.DOCUMENTS]
    for order in (quality.RULES, quality.RULES[::-1]):
        assert [quality.first_rejecting(order, quality.Features(t)) is None for t in texts] == [
            quality.first_rejecting(quality.RULES, quality.Features(t)) is None for t in texts]


PROSE = ("It was late in the year when the letters came, and nobody in the small house by the river could say who had "
         "sent them or why.\nThey lay on the table for days, next to bread and salt, until the youngest opened one.")


def test_the_sample_is_drawn_from_all_files(spark, tmp_path, monkeypatch):
    """Files of prose come first; junk, all of it in capitals, fills the later half."""
    monkeypatch.setattr(quality, "SAMPLE", 100)
    rows = [(i, PROSE if i < 1000 else PROSE.upper()) for i in range(2000)]
    spark.createDataFrame(rows, "i long, text string").coalesce(1).sortWithinPartitions("i").write.option(
        "maxRecordsPerFile", 100).parquet(str(tmp_path / "sorted"))
    rules = [quality.Rule("few_words", quality.few_words), quality.Rule("shouts", quality.shouts)]
    assert [r.name for r in quality.planned(spark.read.parquet(str(tmp_path / "sorted")), rules)] == ["shouts", "few_words"]
    assert [r.name for r in quality.planned(spark.createDataFrame([], "text string"), rules)] == ["few_words", "shouts"]


def test_rules_tell_junk_from_prose():
    def verdict(text):
        return quality.first_rejecting(quality.RULES, quality.Features(text))

    assert verdict(PROSE) is None
    assert verdict(PROSE + "\nContact: a.b@example.org, call +49 30 1234567.") is None
    assert verdict("MIT License. Copyright (c) 2020 by the authors.\n" + PROSE) is None
    assert verdict(" | ".join(PROSE.split())) == "full_of_symbols"
    assert verdict(PROSE.upper()) == "shouts"
    assert verdict("\n".join(["Read more about this here"] * 9 + PROSE.split("\n"))) in ("repeats_lines", "repeats_itself")
    assert verdict(" ".join(w for w in PROSE.split() for _ in range(4))) == "stutters"
    assert verdict("A line that comes back.\n" * 2 + PROSE) is None
    assert verdict("too short") == "few_words"


def test_clean_documents_keep_their_columns(spark):
    docs = cases.documents(spark, [(1, PROSE, "en", "a"), (2, PROSE.upper(), "en", "a"), (3, None, None, None)])
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and [r.doc_id for r in clean.collect()] == [1]
