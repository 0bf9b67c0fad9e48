import re
from collections import defaultdict

import pytest

from fieldscope.llm import mixing
from llm import cases


def test_targets_fill_up_to_twice_the_size():
    assert mixing.fill([10, 10, 10], [5, 2, 1], 45) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.fill([100, 1, 1], [1, 1, 1], 153) == pytest.approx([149, 2, 2])
    assert mixing.fill([0, 0], [5, 2], 0) == [0, 0] and mixing.fill([], [], 0) == []


def corpus(n=700):
    rows = []
    for i in range(n):
        source = [None, "b", "a", "ü", "z"][i % 5] if i % 3 else "hot"
        rows.append((i, " ".join(f"w{i}x{j}" for j in range(i * 31 % 97)), "en", source))
    return rows


def test_query_meets_its_targets(spark, tmp_path):
    rows = corpus()
    got = mixing.op4_mixture(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        by[rows[r.doc_id][3]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r.doc_id] for r in by[s]) for s in order]
    want = mixing.fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))
    for s, n, target in zip(order, sizes, want):
        assert {r.source_size for r in by[s]} == {n} and {r.target for r in by[s]} == {target}
        assert sum(r.taken for r in by[s]) == round(target)
    again = mixing.op4_mixture(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_slots_follow_the_golden_points(spark):
    rows = [("a", 0, 0, 0.0, 0, 500), ("b", 1, 0, 0.0, 0, 300), ("c", 2, 0, 0.0, 0, 3)]
    slots = sorted((r.slot, r._source, r.block) for r in mixing.schedule(spark, rows).collect())
    for source, need in ((0, 500), (1, 300), (2, 3)):
        assert sorted(b for _, s, b in slots if s == source) == list(range(need))
    edges = [500 / 803, 800 / 803, 1]
    surplus = 0
    for slot, source, _ in slots:
        if slot < 803:
            point = (slot + 1) * mixing.GOLDEN % 1
            assert source == next(i for i, e in enumerate(edges) if point < e)
        surplus += slot >= 803
    assert surplus <= 6
    for n in (50, 200, 700):  # every stretch of the mix has its share
        assert abs(sum(s == 0 for t, s, _ in slots if t < n) - n * 500 / 803) < 4


def test_mixed_documents_hold_the_words_taken(spark):
    rows = corpus(300)
    docs = cases.documents(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        assert rows[r.doc_id][1].startswith(r.text) and r.n_chars == len(r.text)
        words[r.source] += len(r.text.split())
    _, taken = mixing.mix(docs)
    want = {r["source"]: round(r.target) for r in taken.collect()}
    assert {k: v for k, v in want.items() if v} == dict(words)


def test_odd_rows(spark):
    docs = cases.documents(spark)
    mixed, taken = mixing.mix(docs)
    assert taken.count() == len(cases.DOCUMENTS)
    sizes = sorted(r["size"] for r in taken.collect())
    assert sizes == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in cases.DOCUMENTS)
    assert mixing.mixed_documents(docs).filter("text IS NULL").count() == 0
    for empty in (cases.documents(spark, []), cases.documents(spark, [(1, None, None, None)])):
        mixed, taken = mixing.mix(empty)
        assert mixed.count() == 0 and all(r.taken == 0 for r in taken.collect())
        assert mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_are_located_in_many_slices(spark, doc_id):
    rows = [(doc_id if i % 3 == 0 else 1000 + i, f"text {i}", "en", "a") for i in range(3000)]
    located, _, _ = mixing._located(cases.documents(spark, rows))
    assert located.select("_first").distinct().count() == 3000
    assert max(r["count"] for r in located.groupBy("_slice").count().collect()) < 500
