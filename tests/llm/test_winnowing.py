import hashlib
import random
import re
import struct

import pytest
import xxhash

from fieldscope.llm import winnowing as w
from llm import cases


def hash_of(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v, seed=h)
        h = h - (1 << 64) if h >> 63 else h
        h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def units(text):
    for x in re.findall(r"[^\x20\x09-\x0D]+", text):
        for i in range(max(1, len(x) - w.PIECE + 1)):
            yield x[i:i + w.PIECE]


def winnow(text):
    words = [hash_of([x.encode()]) for x in units(text)]
    grams = [hash_of(words[i:i + w.K]) for i in range(max(1, len(words) - w.K + 1))] if words else []
    chosen = []
    for i in range(1 - w.W, len(grams)) if grams else ():
        window = range(max(i, 0), min(i + w.W, len(grams)))
        best = min(window, key=lambda j: ((grams[j] % (1 << 64)) >> 32, -j))
        if best not in chosen:
            chosen.append(best)
    return [(grams[j] % (1 << 64), j) for j in chosen]


def shown(prints):
    return " ".join(f"{h:x}:{j}" for h, j in prints)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    # Equal ids differ by a hash that only Spark knows; the cases repeat whole rows.
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for here, after in zip(order, order[1:] + order[:1]):
        text, next_ = here[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + next_[:half]
        yield (here[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(winnow(text)), shown(winnow(edited)),
               pytest.approx(alike(winnow(text), winnow(edited))), pytest.approx(alike(winnow(text), winnow(next_))))


def test_query_against_plain_winnowing(spark, tmp_path):
    rows = [r for r in cases.DOCUMENTS if r[0] is not None]
    got = w.op2_winnowing(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    want = list(expected(rows))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=lambda r: (r[0], r[2])), sorted(want, key=lambda r: (r[0], r[2]))):
        assert a == b


def test_many_ranges_have_the_right_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "ROWS", 3)
    rows = [(i * i - 40, f"text number {i} " * (i % 7 + 1), "en", "a") for i in range(60)]
    got = w.op2_winnowing(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    want = {r[0]: r for r in expected(rows)}
    assert len(got) == 60 and all(tuple(r) == want[r.doc_id] for r in got)


def test_rows_and_firsts_of_ranges_have_the_same_bounds(spark, tmp_path, monkeypatch):
    """Approximate quantiles come out otherwise when tasks end in another order; here they do so at every call."""
    monkeypatch.setattr(w, "ROWS", 5)
    quantiles, calls = w.F.percentile_approx, []

    def shaky(column, places, accuracy):
        calls.append(column)
        return quantiles(column, [min(1.0, p + 0.04 * (len(calls) % 2)) for p in places], accuracy)

    monkeypatch.setattr(w.F, "percentile_approx", shaky)
    rows = [(i * 3, f"text number {i} " * (i % 7 + 1), "en", "a") for i in range(300)]
    got = w.op2_winnowing(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).select(
        "doc_id", "n_chars", "edited_sha256").collect()
    want = {r[0]: r[:3] for r in expected(rows)}
    assert len(got) == 300 and all(tuple(r) == want[r.doc_id] for r in got) and calls


def test_ids_from_end_to_end_of_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "RANGES", 2)
    monkeypatch.setattr(w, "ROWS", 3)
    rows = [(i * ((1 << 63) // 40), f"text number {i}", "en", "a") for i in range(-40, 40)] + [((1 << 63) - 1, "the last one", "en", "a")]
    got = w.op2_winnowing(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    want = {r[0]: r for r in expected(rows)}
    assert len(got) == 81 and all(tuple(r) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(None, "a b c", None, None), (None, "d", None, None)], [(5, "just one", "en", "a")]])
def test_degenerate_tables(spark, tmp_path, rows):
    got = w.op2_winnowing(spark, cases.saved(cases.documents(spark, rows), tmp_path, "documents")).collect()
    assert len(got) == len(rows)


def test_ties_go_to_the_right(spark):
    df = spark.createDataFrame([("x " * 40,)], "text string")
    prints = w.fingerprint(df, "text", "p", "h").first()
    grams = 40 - w.K + 1
    assert [int(x.split(":")[1]) for x in prints.p.split()] == list(range(grams)) and len(prints.h) == 1
    draw = random.Random(5)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(60))) for _ in range(200)]
    found = w.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "p", "h").collect()
    assert all(r.p == shown(winnow(r.text)) for r in found)


def test_runs_as_long_as_promised_share_a_print(spark):
    run = " ".join(f"shared{i}" for i in range(w.K + w.W - 1))
    rows = [(" ".join(f"a{j}x{i}" for j in range(i)) + " " + run + f" end{i} of it",) for i in range(1, 30)]
    found = [set(r.h) for r in w.fingerprint(spark.createDataFrame(rows, "text string"), "text", "p", "h").collect()]
    assert all(found[0] & other for other in found)


def test_no_python_in_the_plan(spark, tmp_path):
    from conftest import plan_of
    plan = plan_of(w.op2_winnowing(spark, cases.saved(cases.documents(spark), tmp_path, "documents")))
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_long_texts_without_spaces_have_windows(spark):
    """An edit in the second half of a text of one word leaves the fingerprints of the first; so does one early letter."""
    draw = random.Random(3)
    text = "".join(draw.choice("漢字仮名交文日本語中国話\U0001F600x") for _ in range(600))
    rows = [(0, text), (1, text[:300] + "".join(draw.choice("abc") for _ in range(300))), (2, "字" + text), (3, text[:72]), (4, text[:71] + "z")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: (r.p.split(), set(r.h)) for r in w.fingerprint(df, "t", "p", "h").collect()}
    assert len(got[0][0]) > 600 // w.W
    assert 0.2 < alike_sets(got[0][1], got[1][1]) < 0.6 and alike_sets(got[0][1], got[2][1]) > 0.95
    assert 0.5 < alike_sets(got[3][1], got[4][1]) < 1
    grams = [hash_of([text[i:i + w.PIECE].encode()]) for i in range(len(text) - w.PIECE + 1)]
    runs = {hash_of(grams[i:i + w.K]) for i in range(len(grams) - w.K + 1)}
    assert got[0][1] <= runs


def test_nothing_jumps_at_a_length(spark):
    """A word's runs grow one by one, and short texts that differ in their last word differ."""
    def prints(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.p for r in w.fingerprint(df, "t", "p", "h").orderBy("i").collect()]

    letters = "".join(chr(0x4E00 + i) for i in range(300))
    lengths = [*range(w.PIECE - 2, w.PIECE + 20), *range(120, 140)]
    for n, found in zip(lengths, prints(*[letters[:n] for n in lengths])):
        last = max(0, n - w.PIECE + 1 - w.K)
        assert found == shown(winnow(letters[:n])) and found.split()[-1].endswith(f":{last}")
    for n in range(1, 30):
        words = " ".join(f"w{i}" for i in range(n))
        assert len(set(prints(words, words + "x"))) == 2


def alike_sets(a, b):
    return len(a & b) / len(a | b)
