"""Groups of spelling variants: words one edit apart, found in a trie of letter counts.

A word's letters fall into GROUPS groups, and its vector is its length and how many
letters it has of each.  Words are arranged in a trie by these numbers, one level each.
Two words that differ by one inserted, deleted or replaced letter have lengths that differ
by one at most, and counts that differ by one surplus and one deficit at most.  So a
depth-first search for a word's neighbours follows equal counts and may once take a count
that is one more, and once one that is one less.  The words of the leaves that it reaches
are verified letter by letter.

The trie is cut into shards at the shallowest nodes with at most as many words as a task
should hold.  Their prefixes are few (see ``directory``), and every task has them: the same
search in them tells which shards a word's neighbours may be in.  A word lives in one shard
and visits those of them that come later, so each pair meets once.

* A word is a result of ``corpus_words``: maximal runs of letters, A-Z as small ones, some
  with a letter deleted, of at least LEAST_CHARS code points and LEAST_COUNT occurrences.
* A NULL text has no words; a NULL doc_id counts as an empty string in the hash that chooses deletions.
* Rows that repeat count each.  Of near words with equal counts the first in code-point order is the form.
* Words of any length are whole; numbers above CLIP count as CLIP, for which a search is no less complete.
* Other columns are ignored, whatever their names.  No documents, no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fieldscope.llm.common import kept, small_batches

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5  # times as frequent as a word its form must be
DELETED = 199  # one in so many runs loses a letter
GROUPS = 8
SHARD_WORDS = 10_000
SHARDS = 1024  # shards hold at least this fraction of all words before they are cut, so more words make larger shards, not more
CLIP = 15
CLIP_CHARS = 63
HELD = 300_000  # words that a task counts before it hands its counts on
PIECE = 1 << 18  # characters of a text that are cut into runs at once
_SHORT = 32  # bytes of a run up to which its hash is combined from parts

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")


# --- words -------------------------------------------------------------------

def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that cut no run."""
    at = 0
    while len(text) - at > PIECE:
        found = _BREAK.search(text, at + PIECE)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


class _Counts(dict):
    """Numbers of the runs that a task has met, with their hashes, lengths and occurrences."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hashes, self.sizes = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64)
        self.totals = np.zeros(0, np.int64)
        self.seen, self.waiting, self.changed, self.chars = [], 0, Counter(), 0

    def __missing__(self, run: str) -> int:
        number, raw = len(self), run.encode()
        if number == len(self.sizes):
            self.hashes, self.sizes = np.resize(self.hashes, 2 * number), np.resize(self.sizes, 2 * number)
        self.hashes[number], self.sizes[number] = zlib.crc32(raw), len(raw)
        self.chars += len(run)
        self[run] = number
        return number

    def add(self, prefix: bytes, shifts: np.ndarray, runs: list[str]) -> None:
        """Count the runs of a document whose hash goes on from ``prefix``.

        The CRC of two strings one after the other is that of the first, shifted by the length of the second, and that of
        the second; so each distinct run is hashed once, and the rest is arithmetic on arrays.
        """
        if not runs:
            return
        numbers = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        sizes = self.sizes[numbers]
        hashes = self.hashes[numbers] ^ shifts[np.minimum(sizes, _SHORT)]
        hit = hashes % DELETED == 0
        hit[sizes >= _SHORT] = False
        for at in np.flatnonzero(hit | (sizes >= _SHORT)):
            run = runs[at]
            h = zlib.crc32(run.encode(), zlib.crc32(prefix)) if sizes[at] >= _SHORT else int(hashes[at])
            if h % DELETED == 0:
                k = h % len(run)
                self.changed[run[:k] + run[k + 1:]] += 1
                hit[at] = True
        self.seen.append(numbers[~hit])
        self.waiting += len(numbers)
        if self.waiting > 1 << 20:
            self._sum()

    def _sum(self) -> None:
        if self.seen:
            totals = np.bincount(np.concatenate(self.seen), minlength=len(self))
            totals[:len(self.totals)] += self.totals
            self.totals = totals
        self.seen, self.waiting = [], 0

    def take(self) -> tuple[list[str], list[int]]:
        """The words of enough code points and their counts; forgets them."""
        self._sum()
        found = self.changed
        for run, n in zip(self, self.totals.tolist()):
            if n and len(run) >= LEAST_CHARS:
                found[run] += n
        words = [w for w in found if len(w) >= LEAST_CHARS]
        made = words, [found[w] for w in words]
        self.clear()
        return made


_ZEROS = [bytes(i) for i in range(_SHORT + 1)]


def corpus_words(documents: DataFrame) -> DataFrame:
    """The words of all documents with their number of occurrences, ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        bare = np.array([zlib.crc32(z) for z in _ZEROS], np.uint32)

        def batch_of(words, ns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*(batch.column(i) for i in range(2))):
                prefix = f"{doc_id.as_py() or ''}:".encode()
                seed = zlib.crc32(prefix)
                shifts = np.array([zlib.crc32(z, seed) for z in _ZEROS], np.uint32) ^ bare
                for piece in _pieces((text.as_py() or b"").translate(_LOWER).decode("utf-8", "replace")):
                    counts.add(prefix, shifts, _RUN.findall(piece))
                    if len(counts) > HELD or counts.chars > 100 * HELD:
                        yield batch_of(*counts.take())
        yield batch_of(*counts.take())

    small_batches(documents.sparkSession)
    counted = documents.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- the trie ----------------------------------------------------------------

def letter_groups(words: DataFrame) -> bytes:
    """For each Latin-1 letter its group; groups hold about as many letters of the words each.

    At most one number per letter comes to the driver.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    totals, table = [0] * GROUPS, bytearray(256)
    for letter, n in sorted(((r["letter"], r["count"]) for r in letters.collect()), key=lambda x: (-x[1], x[0])):
        least = totals.index(min(totals))
        table[ord(letter)], totals[least] = least, totals[least] + n
    return bytes(table)


def vector(word: str, groups: bytes) -> bytes:
    """The path of a word in the trie: its length, and its number of letters of each group."""
    letters = word.encode("latin-1").translate(groups)
    return bytes([min(len(word), CLIP_CHARS), *[min(letters.count(g), CLIP) for g in range(GROUPS)]])


def near_paths(trie: dict, path: bytes) -> list:
    """What the trie has at the end of all paths that words near those of ``path`` may have.

    Inner nodes are dicts by the next number; what isn't a dict is an end, at whatever depth.
    """
    found, stack = [], [(trie, 0, 1, 1)]
    while stack:
        node, level, surplus, deficit = stack.pop()
        if type(node) is not dict:
            found.append(node)
            continue
        count = path[level]
        if (child := node.get(count)) is not None:
            stack.append((child, level + 1, surplus, deficit))
        # The first number is the length, which the letters account for: it spends nothing.
        if (child := node.get(count + 1)) is not None and surplus:
            stack.append((child, level + 1, surplus - (level > 0), deficit))
        if count and (child := node.get(count - 1)) is not None and deficit:
            stack.append((child, level + 1, surplus, deficit - (level > 0)))
    return found


def put(trie: dict, path: bytes, end) -> None:
    for count in path[:-1]:
        trie = trie.setdefault(count, {})
    trie[path[-1]] = end


class Leaf:
    """Words of one path.  To verify that a word is one edit away, only those are looked at that share a half with it:
    of an edit, one side is as it was."""

    def __init__(self):
        self.halves: dict[tuple, list[tuple[str, int]]] = {}

    def add(self, word: str, n: int) -> None:
        half, rest = len(word) // 2, (len(word) - 1) // 2
        for key in ((0, len(word), word[:half]), (1, len(word), word[half:]), (2, len(word), word[:rest]), (3, len(word), word[rest + 1:])):
            self.halves.setdefault(key, []).append((word, n))

    def near(self, word: str) -> list[tuple[str, int]]:
        size, get = len(word), self.halves.get
        half, rest, found = size // 2, (size - 1) // 2, {}
        for key in ((0, size, word[:half]), (1, size, word[half:])):
            for other, n in get(key, ()):
                if other != word and _replaced(word, other):
                    found[other] = n
        for key in ((2, size + 1, word[:half]), (3, size + 1, word[half:])):  # of a longer word
            for other, n in get(key, ()):
                if _inserted(word, other):
                    found[other] = n
        for key in ((0, size - 1, word[:rest]), (1, size - 1, word[rest + 1:])):  # of a shorter one
            for other, n in get(key, ()):
                if _inserted(other, word):
                    found[other] = n
        return list(found.items())


def _first_difference(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def _replaced(a: str, b: str) -> bool:
    at = _first_difference(a, b)
    return a[at + 1:] == b[at + 1:]


def _inserted(short: str, long: str) -> bool:
    at = _first_difference(short, long)
    return short[at:] == long[at + 1:]


def directory(words: DataFrame, groups: bytes) -> list[bytes]:
    """The prefixes of paths at which the trie is cut, in order.

    A node with more words than a shard should have is cut further down.  There are at most SHARDS such nodes on each
    level, and each has at most CLIP_CHARS + 1 children on the first and CLIP + 1 on the others, so there are never more than
    64 + 8 * 1024 * 16 prefixes of 9 bytes, however many words there are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = Counter(vector(w, groups) for w in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(paths), pa.binary()), pa.array(paths.values(), pa.int64())], ["path", "n"])

    paths = kept(words.select("word").mapInArrow(run, "path binary, n long").groupBy("path").agg(F.sum("n").alias("n")), "paths")
    total = paths.agg(F.sum("n")).first()[0] or 0
    limit, cut, open_ = max(SHARD_WORDS, -(-total // SHARDS)), [], {b""}
    for depth in range(1, GROUPS + 2):
        if not open_:
            break
        # Only children of nodes that are cut further down are counted.
        inner = F.substring("path", 1, depth - 1).isin(*map(bytearray, open_)) if depth > 1 else F.lit(True)
        sums = paths.filter(inner).groupBy(F.substring("path", 1, depth).alias("prefix")).agg(F.sum("n").alias("n")).collect()
        open_ = {bytes(r.prefix) for r in sums if r.n > limit and depth <= GROUPS}
        cut += [bytes(r.prefix) for r in sums if bytes(r.prefix) not in open_]
    return sorted(cut)


_PLACED = "shard int, guest boolean, path binary, word string, n long"
_PAIRS = "word string, near string, near_n long"
PAIRS = 50_000  # that a task hands on at once


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words one edit apart, in both directions: ``word``, ``near`` and its count ``near_n``.

    ``words`` is a written table.  A shard's words are held by one task while its guests pass; guests are never held.
    """
    groups = letter_groups(words)
    cut = directory(words, groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = {}, {}
        for number, prefix in enumerate(cut):
            put(shards, prefix, number)
        depth = max(map(len, cut), default=0)
        for batch in batches:
            rows = []
            for word, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
                path = vector(word, groups)
                head = path[:depth]
                if head not in known:
                    home = shards
                    for count in path:
                        home = home[count]
                        if type(home) is not dict:
                            break
                    known[head] = home, [s for s in set(near_paths(shards, path)) if s > home]
                home, others = known[head]
                rows.append((home, False, path, word, n))
                rows += [(s, True, path, word, n) for s in others]
            yield _batch(rows, [pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int64()], _PLACED)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trie, own, last, leaves = None, {}, [], None, []
        rows: list[tuple] = []

        def full(least: int = PAIRS) -> Iterator[pa.RecordBatch]:
            if len(rows) >= least:
                yield _batch(rows, [pa.string(), pa.string(), pa.int64()], _PAIRS)
                rows.clear()

        def among() -> Iterator[pa.RecordBatch]:
            """Pairs of the shard's own words, each of which finds its own near ones."""
            at, ends = None, []
            for path, word in own:
                if path != at:
                    at, ends = path, near_paths(trie, path)
                for leaf in ends:
                    rows.extend((word, other, n) for other, n in leaf.near(word))
                yield from full()
            own.clear()

        for batch in batches:
            for number, guest, path, word, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if number != shard:
                    yield from among()
                    shard, trie, last = number, {}, None
                if not guest:
                    if path != last:
                        last, leaf = path, Leaf()
                        put(trie, path, leaf)
                    leaf.add(word, n)
                    own.append((path, word))
                    continue
                if own:
                    yield from among()
                    last = None
                if path != last:
                    last, leaves = path, near_paths(trie, path)
                for end in leaves:
                    for other, m in end.near(word):
                        rows.extend(((word, other, m), (other, word, n)))
                yield from full()
        yield from among()
        yield from full(0)

    placed = words.select("word", "n").mapInArrow(place, _PLACED)
    return placed.repartition(max(1, len(cut)), "shard").sortWithinPartitions("shard", "guest", "path", "word").mapInArrow(meet, _PAIRS)


def _batch(rows: list[tuple], kinds: list, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])


# --- forms -------------------------------------------------------------------

def spelling_groups(words: DataFrame) -> DataFrame:
    """For each word of a written table its near words, the form that it is a variant of, and the root of its group."""
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    n = -F.col("best.less")
    is_form = n >= RATIO * F.col("n")
    found = kept(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, n).alias("form_n")), "forms")
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """The last word of each chain of forms.

    Counts grow RATIO-fold along a chain, so a chain of 64-bit counts has fewer than 32 steps; each round doubles the steps
    taken, and no round is needed after the longest chain has been walked.
    """
    now = kept(steps, "roots")
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        after = kept(now.join(ahead, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def op11_spelling_groups(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_groups(kept(corpus_words(documents), "words"))


_FED = "SELECT doc_id, run, substr(rest, 3) AS rest, xor(c, ('0x' || substr(rest, 1, 2))::UBIGINT) AS c FROM crc WHERE rest <> ''"
for _ in range(8):
    _FED = f"SELECT doc_id, run, rest, xor(c >> 1, (c & 1) * 3988292384) AS c FROM ({_FED})"

SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
crc(doc_id, run, rest, c) AS (
  SELECT doc_id, run, hex(coalesce(doc_id::VARCHAR, '') || ':' || run), 4294967295::UBIGINT FROM counted
  UNION ALL
  {_FED}),
hashed AS (SELECT doc_id, run, xor(c, 4294967295::UBIGINT) AS h FROM crc WHERE rest = ''),
marked AS (
  SELECT counted.run, n, CASE WHEN h % {DELETED} = 0 THEN (h % length(counted.run))::BIGINT END AS k
  FROM counted JOIN hashed ON hashed.run = counted.run AND hashed.doc_id IS NOT DISTINCT FROM counted.doc_id),
changed AS (SELECT CASE WHEN k IS NULL THEN run ELSE substr(run, 1, k) || substr(run, k + 2) END AS word, n FROM marked),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM words, range(1, 1000) AS places(i) WHERE i <= length(word)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'less': -n, 'form': other}}) AS best FROM near GROUP BY word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best.less >= {RATIO} * words.n THEN best.form END AS form, CASE WHEN -best.less >= {RATIO} * words.n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain(word, now, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.now WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(now, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
