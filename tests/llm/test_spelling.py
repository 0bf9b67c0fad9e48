import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, strategies as st

from fieldscope.llm import spelling
from llm import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words_ = st.text("abcé", min_size=0, max_size=8)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    totals = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            totals[run] += 1
    return {w: n for w, n in totals.items() if len(w) >= 6 and n >= 5}


def grouped(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * n:
            forms[w] = best
    found = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        found.append((w, forms.get(w), root, n, len(near[w]), counts.get(forms.get(w))))
    return sorted(found, key=str)


def got(spark, tmp_path, rows):
    made = spelling.op11_spelling_groups(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents"))
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, made.collect()), key=str)


def variants(seed, n):
    """A text of words, their misspellings, and misspellings of those, in falling numbers."""
    pick = random.Random(seed)
    letters = "abcdeéÿ×"
    out = []
    for _ in range(n):
        word, times = "".join(pick.choices(letters, k=pick.randint(5, 9))), 130
        while times >= 4:
            out += [word if pick.random() < .8 else word.upper()] * times
            at = pick.randrange(len(word))
            word = pick.choice([word[:at] + word[at + 1:], word[:at] + pick.choice(letters) + word[at:], word[:at] + pick.choice(letters) + word[at + 1:]])
            times //= pick.choice([2, 5])
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [20_000, 7, 1])
def test_groups_equal_all_pairs(spark, tmp_path, monkeypatch, limit):
    """Also where the trie is cut deep down, to shards of a few words."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", limit)
    monkeypatch.setattr(spelling, "SHARDS", 1 << 20)
    words = variants(limit, 60)
    rows = [(i if i % 9 else None, " ".join(words[i::40]) + "\n", "en", "a") for i in range(40)]
    expected = grouped(counted(rows))
    assert got(spark, tmp_path, rows) == expected
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] != r[2] and r[1] for r in expected)


def test_rows_that_break_things(spark, tmp_path):
    long_ = "".join(random.Random(5).choices("abcdefghij", k=5000))
    rows = [*cases.DOCUMENTS, *[(100 + i, f"{long_} {long_[:2500]}{long_[2501:]} {'x' * 70}{'y' * (i % 2)}", "en", "b") for i in range(12)]]
    expected = grouped(counted(rows))
    assert any(len(r[0]) == 5000 and r[4] for r in expected)
    assert got(spark, tmp_path, rows) == expected


def test_no_documents(spark, tmp_path):
    assert got(spark, tmp_path, []) == []


def test_counts_are_handed_on_piece_by_piece(spark, monkeypatch):
    words = variants(3, 30)
    rows = [(7, " ".join(words), "en", "a"), (8, "a" * 700 + " " + "b" * 3, "en", "a")]
    monkeypatch.setattr(spelling, "HELD", 10)
    monkeypatch.setattr(spelling, "PIECE", 100)
    made = {r.word: r.n for r in spelling.corpus_words(cases.documents(spark, rows)).collect()}
    assert {w: n for w, n in made.items() if len(w) >= 6} == counted(rows)


@given(st.text("ab é", max_size=60))
def test_pieces_cut_no_run(text):
    spelling_piece, spelling.PIECE = spelling.PIECE, 5
    try:
        pieces = list(spelling._pieces(text))
    finally:
        spelling.PIECE = spelling_piece
    assert "".join(pieces) == text and [r for p in pieces for r in spelling._RUN.findall(p)] == spelling._RUN.findall(text)


@given(st.sets(words_, max_size=12), words_)
def test_search_and_leaves_miss_no_near_word(known, word):
    groups = bytes([0] * 97 + [i % spelling.GROUPS for i in range(159)])
    trie, leaves = {}, {}
    for w in known:
        path = spelling.vector(w, groups)
        if path not in leaves:
            leaves[path] = spelling.Leaf()
            spelling.put(trie, path, leaves[path])
        leaves[path].add(w, 1)
    ends = spelling.near_paths(trie, spelling.vector(word, groups))
    assert len(ends) == len(set(map(id, ends)))
    assert sorted(o for leaf in ends for o, _ in leaf.near(word)) == sorted(w for w in known if one_edit(w, word))
