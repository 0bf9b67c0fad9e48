import random

import pytest
from hypothesis import given, settings, strategies as st

from conftest import plan_of
from fieldscope.operators import journals, similar


def items(spark, titles):
    return spark.createDataFrame([(f"i{at:05}", t) for at, t in enumerate(titles)], "id string, title string")


def expected_pairs(titles, percent):
    classes = {}
    for at, title in enumerate(titles):
        words = frozenset((title or "").lower().split())
        if words:
            classes.setdefault(words, f"i{at:05}")
    listed = list(classes.items())
    found = set()
    for i, (x, a) in enumerate(listed):
        for y, b in listed[i + 1:]:
            if 100 * len(x & y) >= percent * len(x | y):
                found.add((min(a, b), max(a, b), len(x & y), len(x | y)))
    return found


def made_up(seed, n, vocabulary=60):
    """Titles from a few words, many of them changed copies of others."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    titles = [" ".join(pick.choices(words, k=pick.randint(1, 24))) for _ in range(n)]
    for base in titles[::2]:
        for _ in range(3):
            changed = base.split()
            changed[pick.randrange(len(changed))] = pick.choice(words)
            pick.shuffle(changed)
            titles.append("  ".join(changed).title() if pick.random() < .5 else " ".join(changed))
    return titles + [None, "", " \t ", titles[0], titles[0].upper()]


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_pairs_equal_all_pairs(spark, percent):
    titles = made_up(percent, 120)
    expected = expected_pairs(titles, percent)
    found = similar.similar_titles(similar.title_classes(items(spark, titles)), percent)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert expected or percent == 100


def test_links_count_classes_not_copies(spark):
    titles = ["a b c d e", "e d c b a", "A b c d e"] + ["a b c d e f"] * 40 + ["x", "y z", None]
    members = similar.title_classes(items(spark, titles))
    rows = {r.id: (r.class_id, r.n_same, r.n_links) for r in similar.title_links(members, similar.similar_titles(members)).collect()}
    assert len(rows) == 45 and rows["i00001"] == ("i00000", 3, 1) and rows["i00042"] == ("i00003", 40, 1) and rows["i00043"] == ("i00043", 1, 0)


def test_copies_are_joined_once(spark):
    """A thousand copies of a title are one record on both sides of the join."""
    members = similar.title_classes(items(spark, ["one two three four five"] * 1000 + ["one two three four five six"]))
    pairs = similar.similar_titles(members)
    assert [tuple(r) for r in pairs.collect()] == [("i00000", "i01000", 5, 6)]
    assert "CartesianProduct" not in plan_of(pairs) and "NestedLoop" not in plan_of(pairs)


def test_no_titles(spark):
    members = similar.title_classes(items(spark, [None, ""]))
    assert similar.title_links(members, similar.similar_titles(members)).collect() == []


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_names_within_edits_equal_all_pairs(spark, edits):
    pick = random.Random(edits)
    names = ["".join(pick.choices("ab é", k=pick.randint(0, 9))) for _ in range(250)] + ["aaaaaaaa", "aaaaaaaaaa", "\U0001F600b"]
    asked = names[:60] + ["".join(pick.choices("abz", k=pick.randint(0, 7))) for _ in range(60)]
    known = spark.createDataFrame([(n,) for n in names], "key string")
    index = similar.name_index(known, edits)
    found = similar.near_names(index, known, spark.createDataFrame([(n,) for n in asked], "key string"), edits)
    expected = {(q, n, distance(q, n)) for q in asked for n in names if distance(q, n) <= edits}
    rows = [tuple(r) for r in found.select("wanted_key", "key", "distance").collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_misspelt_words_find_their_journal(spark):
    registry = spark.createDataFrame([
        ("Journal of Urban Studies", "1", 5, "p"), ("Journal of Urban Studies", "2", None, None), ("Journal of Rural Studies", "3", 7, "q"),
        ("Journal of Urban Studies", None, 9, "p"), (None, "4", 1, "p"), ("Energy", "5", 2, "p")],
        "display_name string, issn_l string, works_count int, host_organization_name string")
    asked = spark.createDataFrame([("Jurnal of Urbn  Studies",), ("energy ",), ("Quantum",), ("",), ("energy ",)], "query string")
    rows = {(r.query, r.status, r.issn, r.distance) for r in journals.misspelt_lookup(registry, asked).collect()}
    assert rows == {("Jurnal of Urbn  Studies", "match", "1", 2), ("Jurnal of Urbn  Studies", "match", "2", 2), ("energy ", "match", "5", 0),
                    ("Quantum", "no match", None, None), ("", "match", "4", 1)}
    # One index serves lookups by the hundred.
    index = journals.journal_index(registry)
    again = journals.misspelt_lookup(registry, asked, index=index)
    assert {(r.query, r.status, r.issn, r.distance) for r in again.collect()} == rows


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc", max_size=5), min_size=1, max_size=8))
def test_grams_are_a_set(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "key string")
    for r in df.select("key", similar._grams(df["key"]).alias("g")).collect():
        assert len(set(r.g)) == len(r.g) == len(r.key) + similar.GRAM - 1


def test_links_join_on_a_hash_of_the_words(spark):
    from conftest import plan_of
    items = spark.createDataFrame([(str(i), f"one two three four five{i % 3}") for i in range(9)], "id string, title string")
    members = similar.title_classes(items)
    found = similar.title_links(members, similar.similar_titles(members))
    moved = [line for line in plan_of(found).splitlines() if "Join" in line or "Exchange" in line]
    assert moved and not any("class_key" in line for line in moved) and found.count() == 9
