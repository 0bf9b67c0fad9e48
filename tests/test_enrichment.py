import random

import pytest

from fieldscope.operators import enrichment

ITEMS = "id string, source string, source_type string, doi string, summary string, source_ord int, seq int"


def walk(rows, have, limit, give_up):
    """Look items up one by one, the slow and obvious way."""
    tried, filled = [], []
    gave_up = False
    for row in rows:
        if len(filled) >= limit:
            break
        if len(tried) >= give_up and not filled:
            gave_up = True
            break
        if (row[4] or "").strip() or row[2] != "paper" or not row[3]:
            continue
        tried.append(row[0])
        if row[3].strip().lower() in have:
            filled.append(row[0])
    return set(tried), set(filled), gave_up


def make(rng, n, hit_rate):
    rows = []
    for i in range(n):
        hit = rng.random() < hit_rate
        rows.append((f"i{i}", f"s{i % 2}", rng.choice(["paper", "paper", "paper", "news"]),
                     rng.choice([f" 10.1/{'H' if hit else 'M'}{i}", f"10.1/{'h' if hit else 'm'}{i}", None, ""]),
                     rng.choice(["", None, " ", "text"]), 0, i))
    return rows


@pytest.mark.parametrize("seed, hit_rate, limit, give_up", [
    (1, 0.5, 3, 10), (2, 0.0, 60, 4), (3, 0.1, 60, 3), (4, 0.9, 1, 1), (5, 0.3, 60, 10), (6, 0.0, 60, 60), (7, 0.2, 2, 5)])
def test_budgeted_lookup_is_the_sequential_walk(spark, seed, hit_rate, limit, give_up):
    rows = make(random.Random(seed), 60, hit_rate)
    have = {r[3].strip().lower() for r in rows if r[3] and "h" in r[3].lower()}
    items = spark.createDataFrame(rows, ITEMS)
    abstracts = spark.createDataFrame([(d.upper(), f"<jats:p>text {d}</jats:p>") for d in sorted(have)] + [("10.1/none", "")],
                                      "doi string, abstract string")
    attempts = enrichment.budgeted_lookup(items, abstracts, limit=limit, give_up_after=give_up)
    got = attempts.collect()
    tried, filled, gave_up = walk(rows, have, limit, give_up)
    assert {f"i{r['seq']}" for r in got if r["tried"]} == tried
    assert {f"i{r['seq']}" for r in got if r["filled"]} == filled
    counts = enrichment.backfill_counters(items, attempts, give_up_after=give_up).first()
    assert (counts["filled"], counts["tried"], counts["gave_up"]) == (len(filled), len(tried), gave_up)


def test_budget_per_source(spark):
    rows = [(r[0], None if r[1] == "s1" else r[1], *r[2:]) for r in make(random.Random(11), 80, 0.3)]
    have = {r[3].strip().lower() for r in rows if r[3] and "h" in r[3].lower()}
    items = spark.createDataFrame(rows, ITEMS)
    abstracts = spark.createDataFrame([(d, "a") for d in sorted(have)], "doi string, abstract string")
    got = enrichment.budgeted_lookup(items, abstracts, limit=2, give_up_after=2, partition_by=["source"]).collect()
    for source in ("s0", None):
        tried, filled, _ = walk([r for r in rows if r[1] == source], have, 2, 2)
        assert {f"i{r['seq']}" for r in got if r["tried"] and r["source"] == source} == tried
        assert {f"i{r['seq']}" for r in got if r["filled"] and r["source"] == source} == filled


def test_gives_up_when_nothing_is_deposited(spark):
    rows = [(f"i{n}", "s", "paper", f"10.6/{n}", "", 0, n) for n in range(50)]
    items = spark.createDataFrame(rows, ITEMS)
    none = spark.createDataFrame([], "doi string, abstract string")
    attempts = enrichment.budgeted_lookup(items, none, limit=60, give_up_after=10)
    assert enrichment.backfill_counters(items, attempts, give_up_after=10).first().asDict() == {"filled": 0, "tried": 10, "gave_up": True}
    ten = items.filter("seq < 10")       # nothing follows the tenth miss
    attempts = enrichment.budgeted_lookup(ten, none, limit=60, give_up_after=10)
    assert enrichment.backfill_counters(ten, attempts, give_up_after=10).first().asDict() == {"filled": 0, "tried": 10, "gave_up": False}


def test_no_budget_tries_nothing(spark):
    items = spark.createDataFrame([("i", "s", "paper", "10.1/a", "", 0, 0)], ITEMS)
    abstracts = spark.createDataFrame([("10.1/a", "text")], "doi string, abstract string")
    attempts = enrichment.budgeted_lookup(items, abstracts, limit=0, give_up_after=10)
    assert enrichment.backfill_counters(items, attempts, give_up_after=10).first().asDict() == {"filled": 0, "tried": 0, "gave_up": False}


@pytest.mark.parametrize("budgeted", [False, True])
def test_backfill_fills_blank_papers_only(spark, budgeted):
    rows = [("a", "s", "paper", "10.5/A", "", 0, 0), ("b", "s", "paper", "10.5/b", "own words", 0, 1),
            ("c", "s", "news", "10.5/c", "", 0, 2), ("d", "s", "paper", None, None, 0, 3), ("e", "s", None, "10.5/e", "", 0, 4)]
    items = spark.createDataFrame(rows, ITEMS)
    abstracts = spark.createDataFrame([(f"10.5/{x}", "found <b>words</b>") for x in "abce"],
                                      "doi string, abstract string")
    if budgeted:
        out = enrichment.apply_attempts(items, enrichment.budgeted_lookup(items, abstracts, limit=60, give_up_after=10))
    else:
        out = enrichment.backfill(items, abstracts)
    got = {r["id"]: r["summary"] for r in out.collect()}
    assert got == {"a": "found words", "b": "own words", "c": "", "d": None, "e": ""}
