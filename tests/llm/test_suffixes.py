import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldscope.llm import suffixes as s
from llm import cases


@given(st.lists(st.sampled_from([b"ab", b"\0", b"abcabcab", b"x" * 20]), max_size=40), st.integers(9, 60))
@settings(deadline=None, max_examples=80)
def test_suffix_array_and_common_prefixes(parts, depth):
    data = b"".join(parts)
    raw = np.frombuffer(data, np.uint8)
    order, rank = s.suffix_array(raw, depth)
    heads = [data[i:i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(len(data))) and heads == sorted(heads)
    assert [rank[order[i]] == rank[order[i - 1]] for i in range(1, len(data))] == [a == b for a, b in zip(heads, heads[1:])]
    at = np.arange(1, len(data))
    if len(at):
        shared = s.common_prefixes(raw, order, at, depth)
        for i, n in zip(at, shared):
            a, b = data[order[i]:][:depth], data[order[i - 1]:][:depth]
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_equal_strings_have_equal_anchors():
    random.seed(5)
    shared = bytes(random.choices(range(97, 100), k=300))
    texts = [bytes(random.choices(range(97, 100), k=random.randint(0, 90))) + shared for _ in range(20)]
    known = {}
    for text in texts:
        h, first, count = s.anchors(np.frombuffer(text, np.uint8))
        assert count.sum() == max(0, len(text) - s.LENGTH + 1)
        for value, a, n in zip(h.tolist(), first.tolist(), count.tolist()):
            for i in range(a, a + n):
                assert known.setdefault(text[i:i + s.LENGTH], value) == value


def expected(rows):
    """For each row: its bytes, the bytes removed, the runs, and the digest of the rest."""
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    owner = {}
    for i, b in texts:
        for at in range(len(b) - s.LENGTH + 1):
            key = b[at:at + s.LENGTH]
            owner[key] = min(owner.get(key, s._LAST), s._LAST if i is None else i)
    for i, b in texts:
        gone = bytearray(len(b))
        for at in range(len(b) - s.LENGTH + 1):
            if owner[b[at:at + s.LENGTH]] < (s._LAST if i is None else i):
                gone[at:at + s.LENGTH] = b"\1" * s.LENGTH
        left = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for a in range(len(b)) if gone[a] and not (a and gone[a - 1]))
        yield i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()


def check(spark, tmp_path, rows):
    got = s.op8_suffix_repeats(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(rows), key=str)


def test_odd_rows(spark, tmp_path):
    check(spark, tmp_path, cases.DOCUMENTS)


def test_no_documents(spark, tmp_path):
    check(spark, tmp_path, [])


def corpus():
    random.seed(11)
    word = lambda: "".join(random.choices("abcdé", k=random.randint(2, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(120):
        own = [" ".join(word() for _ in range(random.randint(0, 40))) for _ in range(3)]
        text = own[0] + random.choice(passages)[random.randint(0, 60):] + own[1] + "ab" * random.choice([0, 20, 45]) + own[2]
        rows.append((random.randint(0, 100), text if random.random() < 0.9 or not rows else random.choice(rows)[1], "en", "a"))
    return rows


@pytest.mark.parametrize("hot", [256, 1])
def test_many_small_groups_equal_brute_force(spark, tmp_path, monkeypatch, hot):
    """Also with every shared anchor sent string by string."""
    for name, value in (("GROUP", 3000), ("PIECE", 700), ("ANCHOR_SHARD", 9000), ("SUFFIX_SHARD", 2500), ("HOT_GROUPS", hot)):
        monkeypatch.setattr(s, name, value)
    check(spark, tmp_path, corpus())


def test_documents_without_repeats_keep_their_columns(spark):
    rows = corpus()
    docs = cases.documents(spark, rows)
    left = s.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    found = left.collect()
    assert all(r.n_chars == len(r.text) and r.size == "x" for r in found)
    want = {h for _, _, _, _, h in expected(rows)}
    ascii_ = [r for r in found if r.text.isascii()]
    assert all(hashlib.sha256(r.text.encode()).hexdigest() in want for r in ascii_)


def test_benchmark_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, s.op8_suffix_repeats(spark, folder).collect())) == sorted(expected(rows))
