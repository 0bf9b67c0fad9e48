import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldscope.llm import packing
from llm import cases


def padding_of(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_bounds_have_least_padding(lengths, buckets):
    bins = sorted(Counter(lengths).items())
    bounds = packing.best_bounds(np.array([b for b, _ in bins]), np.array([n for _, n in bins]), np.array([b * n for b, n in bins]), buckets)
    values, most = [b for b, _ in bins], bins[-1][0]
    best = min(padding_of(lengths, {*c, most}) for c in itertools.combinations(values, min(buckets, len(values)) - 1))
    assert len(bounds) <= buckets and padding_of(lengths, bounds) == best


def test_bins_never_mix_the_order(spark):
    rows = [(n,) for n in [0, 1, 4095, 4096, 4097, 5000, 8191, 8192, 8193, 10**6, 10**6 + 1, 2**31, 2**40]]
    got = [r.b for r in spark.createDataFrame(rows, "n long").orderBy("n").select(packing._bin(packing.F.col("n")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) >= 11


def test_batches_keep_the_budget(spark):
    rows = [(i, "w " * (i * 37 % 211)) for i in range(900)] + [(i, None) for i in range(900, 910)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, buckets=4, budget=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(910))
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_length - r.n_words >= 0
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert len(rows) * rows[0].bucket_length <= 500 or len(rows) == 1
        assert sorted(r.place for r in rows) == list(range(len(rows)))
    for bucket in {b for b, _ in batches}:  # all but the last batch of a bucket are full
        sizes = [len(v) for (b, _), v in sorted(batches.items()) if b == bucket]
        assert len(set(sizes[:-1])) <= 1
    again = packing.pack_documents(docs, buckets=4, budget=500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    got = packing.pack_documents(cases.documents(spark)).collect()
    assert len(got) == len(cases.DOCUMENTS)
    assert sorted(r.n_words for r in got)[-1] == 30_000
    assert packing.pack_documents(cases.documents(spark, [])).collect() == []


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_are_numbered_in_many_slices(spark, monkeypatch, doc_id):
    rows = [(doc_id if i % 3 == 0 else 1000 + i, f"text {i}", "en", "a") for i in range(3000)]
    seen = []
    whole = packing.running_sum
    monkeypatch.setattr(packing, "running_sum", lambda df, *rest: (seen.append(df), whole(df, *rest))[1])
    found = packing.pack_documents(cases.documents(spark, rows)).collect()
    assert len({(r.bucket, r.batch, r.place) for r in found}) == len(found) == 3000
    assert max(r["count"] for r in seen[0].groupBy("bucket", "_slice").count().collect()) < 500
