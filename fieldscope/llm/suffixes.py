"""Removal of repeated byte strings by suffix arrays in shards.

A byte goes where a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id.  Documents lie in groups of a few megabytes, each a
file in the shared folder.  Of every ``LENGTH`` bytes in a row, the gram with the
smallest hash is the anchor, so equal strings have equal anchors.

1. Groups send their anchors, sorted and each once, to the shards of the hash range;
   merging by binary search finds those that occur in several documents.
2. Groups cut out the strings around shared anchors, about a tenth of the texts, and
   send them to the suffix shard of the anchor.  Of equal strings in a group only the
   smallest document's goes on; the others are repeats already.
3. Each suffix shard sorts its suffixes by Larsson-Sadakane refinement; common
   prefixes of neighbours, in Kasai's order of the text, give the classes of equal
   strings, and a class the smallest document that has it.
4. Groups remove what the shards found.

An anchor of many groups could make its suffix shard large.  Its strings are sent one
by one to shards of their own hash instead, each once per group.

* Texts count as UTF-8 bytes; a NULL text is empty.  Strings never cross documents.
* Rows with one doc_id are never repeats of each other; a NULL doc_id is larger than
  all others.
* Shorter texts than LENGTH lose nothing; no rows, no result rows.
* A long text is worked on in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldscope.llm import files
from fieldscope.llm.common import kept, new_folder, small_batches

LENGTH = 50
GRAM = 20
GROUP = 4 << 20  # bytes of text after which a group ends
PIECE = 1 << 20  # bytes whose anchors are found at once
ANCHOR_SHARD = 32 << 20  # bytes of text for each anchor shard, which gets about a hundredth of them
SUFFIX_SHARD = 2 << 20  # bytes of text for each suffix shard, which gets about as many
HOT_GROUPS = 256  # an anchor in more groups is sent string by string

_U = np.uint64
_LAST = np.iinfo(np.int64).max
# Odd multipliers of public 64-bit mixers.
_M = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
# An anchor travels as 6 bytes: 46 bits of its hash, and two bits that say "in several documents" and "hot".
_SEVERAL, _HOT, _KEY = _U(1), _U(2), _U((1 << 48) - 4)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _M[3]
    return h ^ (h >> _U(32))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` (at least 8) bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded.data, 0, (1,)).copy()
    n = len(data) - size + 1
    h = words[:n] * _M[0]
    for at in [*range(8, size - 7, 8), size - 8]:
        h = (h ^ (h >> _U(29))) * _M[1] + words[at:at + n] * _M[2]
    return _finish(h)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first string and number of strings of each run of neighbouring strings that have one anchor.

    ``data`` is a piece of fewer than 2**24 bytes.  Among equal hashes the rightmost gram counts.
    """
    strings = len(data) - length + 1
    if strings <= 0:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _hashes(data, gram)
    low = _U((1 << 24) - 1)
    least = ((h >> _U(24)) << _U(24)) | (low - np.arange(len(h), dtype=_U))
    window, size = length - gram + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[:size - window], least[window - size:])
    at = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.diff(np.append(first, strings))


class Group:
    """The documents of one group file, one after the other."""

    def __init__(self, uri: str):
        with files.open_file(uri) as file:
            table = pq.ParquetFile(file).read()
        self.table = table
        ids = table.column("doc_id")
        self.ids = ids.combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, first string (its place in the group's bytes) and number of strings of each run."""
        found = []
        for at in range(0, len(self.data), PIECE):
            h, first, count = anchors(self.data[at:at + PIECE + LENGTH - 1])
            found.append((h, first + at, count))
        if not found:
            return np.empty(0, _U), *[np.empty(0, np.int64)] * 3
        h, first, count = (np.concatenate(x) for x in zip(*found))
        # Strings must end in the document in which they start: a run may begin in one that they would leave.
        row = np.searchsorted(self.offsets, first, "right") - 1
        parts = []
        while len(first):
            end = np.minimum(first + count, np.maximum(self.offsets[row + 1] - LENGTH + 1, first))
            whole = end > first
            parts.append((h[whole], row[whole], first[whole], (end - first)[whole]))
            rest = first + count > self.offsets[row + 1]
            start = self.offsets[row + 1][rest]
            h, count, first = h[rest], (first + count)[rest] - start, start
            row = np.searchsorted(self.offsets, first, "right") - 1
            fine = row < len(self.offsets) - 1
            h, count, first, row = h[fine], count[fine], first[fine], row[fine]
        return tuple(np.concatenate(x) for x in zip(*parts))


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """A shard by the upper bits, which the 46 bits that travel share only in part."""
    return ((h >> _U(32)) % _U(shards)).astype(np.int64)


def _unique_keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sorted keys of a group's anchors, marked where several of its rows have one."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(row, start) != np.maximum.reduceat(row, start)
    return ((h[start] << _U(2)) & _KEY) | np.where(several, _SEVERAL, _U(0)), h[start]


_FILES = "group string, bytes long"
_ANCHORS = "shard long, group string, keys binary"


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def groups(documents: DataFrame, carry: list[str], folder: str) -> DataFrame:
    """Write the documents, with ``doc_id``, ``text`` as bytes and the columns of ``carry``, into group files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush():
            nonlocal waiting, size
            uri = files.fresh_name(folder, ".parquet")
            table = pa.Table.from_batches(waiting)
            at = table.schema.get_field_index("text")
            table = table.set_column(at, "text", table.column(at).cast(pa.large_binary()))
            with files.create(uri) as out:
                pq.write_table(table, out, compression="zstd", compression_level=1)
            made = _table([[uri], [size]], _FILES)
            waiting, size = [], 0
            return made

        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[
                batch.column("text").offset:][:batch.num_rows + 1])
            start = 0
            for stop in range(1, batch.num_rows + 1):
                size += int(lengths[stop - 1])
                if size >= GROUP:
                    waiting.append(batch.slice(start, stop - start))
                    start = stop
                    yield flush()
            if start < batch.num_rows:
                waiting.append(batch.slice(start))
        if waiting:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *carry)
    return kept(rows.mapInArrow(run, _FILES), "groups")


def _sent_anchors(found: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                h, row, _, _ = Group(uri).anchors()
                if not len(h):
                    continue
                keys, h = _unique_keys(h, row)
                where = _shard(h, shards)
                order = np.lexsort((keys, where))
                names, start = np.unique(where[order], return_index=True)
                blobs = [_pack(x) for x in np.split(keys[order], start[1:])]
                yield _table([names, [uri] * len(blobs), blobs], _ANCHORS)

    return found.select("group").mapInArrow(run, _ANCHORS)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each group of one shard, those of its anchors that occur in several documents."""
    lists = [_unpack(b) for b in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(lists))
    keys, first, count = np.unique(every & _KEY, return_index=True, return_counts=True)
    several = (count > 1) | ((every[first + count - 1] & _SEVERAL) > 0)
    keys, count = keys[several], count[several]
    marked = keys | np.where(count > HOT_GROUPS, _HOT, _U(0))
    blobs = []
    for own in lists:
        at = np.searchsorted(keys, own & _KEY)  # each group's sorted list is merged by binary search
        here = np.flatnonzero(keys[np.minimum(at, max(len(keys) - 1, 0))] == (own & _KEY)) if len(keys) else []
        blobs.append(_pack(marked[at[here]] if len(here) else np.empty(0, _U)))
    return pa.table({"shard": table.column("shard"), "group": table.column("group"),
                     "keys": pa.array(blobs, pa.binary())})


_STRINGS = ("shard long, group string, anchors binary, ids binary, rows binary, places binary, counts binary, "
            "text binary")


def _cut(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from each place on, one string after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)] if len(first) else data[:0]


def _digests(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string of those that lie one after the other."""
    raw, ends = text.tobytes(), np.cumsum(size)
    return np.array([xxhash.xxh3_64_intdigest(raw[e - n:e]) for e, n in zip(ends.tolist(), size.tolist())], _U)


def _equal_strings(text, ends, size, ids, anchor, digests) -> tuple[np.ndarray, np.ndarray]:
    """The strings in an order that puts equal ones of one anchor together, the smallest document first, and for each
    place of it that first string.  Equal hashes are compared as bytes."""
    order = np.lexsort((ids, digests, anchor))
    a, b = order[:-1], order[1:]
    same = (anchor[a] == anchor[b]) & (digests[a] == digests[b]) & (size[a] == size[b])
    raw = text.tobytes()
    for i in np.flatnonzero(same).tolist():
        x, y = int(a[i]), int(b[i])
        same[i] = raw[ends[x] - size[x]:ends[x]] == raw[ends[y] - size[y]:ends[y]]
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    return order, np.repeat(order[start], np.diff(np.append(start, len(order))))


def _sent_strings(answers: DataFrame, anchor_shards: int, shards: int) -> DataFrame:
    """The strings around shared anchors of each group, and, without anchors, the repeats that a group finds itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, names, blobs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                group = Group(uri)
                h, row, first, count = group.anchors()
                key, where = (h << _U(2)) & _KEY, _shard(h, anchor_shards)
                state = np.zeros(len(h), np.int8)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(anchor_shards + 1))
                for name, blob in zip(names, blobs):
                    mine = order[edges[name]:edges[name + 1]]
                    shared = _unpack(blob)
                    bare = shared & _KEY
                    if len(shared):
                        at = np.minimum(np.searchsorted(bare, key[mine]), len(bare) - 1)
                        hit = bare[at] == key[mine]
                        state[mine[hit]] = np.where(shared[at[hit]] & _HOT, 2, 1)
                hot = state == 2
                each = count[hot]
                steps = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                h = np.concatenate([h[state == 1], np.repeat(h[hot], each)])
                row = np.concatenate([row[state == 1], np.repeat(row[hot], each)])
                first = np.concatenate([first[state == 1], np.repeat(first[hot], each) + steps])
                single = np.concatenate([np.zeros((state == 1).sum(), bool), np.ones(len(steps), bool)])
                count = np.concatenate([count[state == 1], np.ones(len(steps), np.int64)])
                yield from send(uri, group, h, row, first, count, single)

    def send(uri, group, h, row, first, count, single):
        if not len(h):
            return
        ids = group.ids[row]
        size = count + LENGTH - 1
        text = _cut(group.data, first, size)
        digests = _digests(text, size)
        order, head = _equal_strings(text, np.cumsum(size), size, ids, h, digests)
        repeat = ids[order] > ids[head]
        gone = order[repeat]
        if len(gone):
            place = first[gone] - group.offsets[row[gone]]
            yield _table([[xxhash.xxh3_64_intdigest(uri) % shards], [uri], [b""], [b""], [row[gone].astype("<i4").tobytes()],
                          [place.astype("<i4").tobytes()], [count[gone].astype("u1").tobytes()], [b""]], _STRINGS)
        go = np.sort(order[~repeat])
        anchor = np.where(single[go], digests[go], h[go])
        goal = _shard(_finish(anchor), shards)
        order = np.argsort(goal, kind="stable")
        names, start = np.unique(goal[order], return_index=True)
        for name, part, own in zip(names.tolist(), np.split(go[order], start[1:]), np.split(anchor[order], start[1:])):
            place = first[part] - group.offsets[row[part]]
            yield _table([[name], [uri], [own.astype("<u4").tobytes()], [ids[part].tobytes()], [row[part].astype("<i4").tobytes()],
                          [place.astype("<i4").tobytes()], [count[part].astype("u1").tobytes()],
                          [_cut(group.data, first[part], size[part]).tobytes()]], _STRINGS)

    return answers.mapInArrow(run, _STRINGS)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes or more, and the rank of each, equal for equal ones.

    After a first sort by eight bytes, each round doubles the number of bytes
    that count, by the rank of the suffix that many bytes on, and sorts only
    what lies in groups that are not yet single (Larsson and Sadakane).
    Behind the end there is something smaller than any byte.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded.data, 0, (1,)).astype(_U)
    order = np.argsort(key)
    # Of suffixes that the padding made equal, the shorter comes first.
    at = np.flatnonzero(np.isin(key[order], key[max(n - 7, 0):]))
    order[at] = order[at][np.lexsort((np.minimum(n - order[at], 8), key[order[at]]))]
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if n else np.empty(0, bool)
    short = order > n - 8
    new[1:] |= short[1:] | short[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 8
    while done < depth:
        step = min(done, depth - done)
        counts = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.repeat(counts > 1, counts)
        places = np.flatnonzero(open_)
        if not len(places):
            break
        who = order[places]
        beyond = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        by = np.lexsort((beyond, rank[who])) if n >= 1 << 31 else np.argsort((rank[who] << 32) | beyond)
        order[places] = who[by]
        own, ahead = rank[who][by], beyond[by]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        new[places] = fresh
        rank[order[places]] = np.maximum.accumulate(np.where(fresh, places, 0))
        done += step
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """For suffixes at some places of the order: the bytes, up to ``most``, that each shares with the one before it.

    Pairs are taken in the order of the text, as Kasai does, so neighbours read
    neighbouring bytes; all pairs advance together, eight bytes at a time.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((n + most,), "<u8", padded.data, 0, (1,))
    by_text = np.argsort(order[at], kind="stable")
    here, before = order[at][by_text], order[at - 1][by_text]
    limit = np.minimum(most, n - np.maximum(here, before))
    shared, going = np.zeros(len(at), np.int64), np.arange(len(at))
    for done in range(0, most, 8):
        differ = words[here[going] + done] ^ words[before[going] + done]
        bits = differ & (~differ + _U(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(bits, _U(1)).astype(np.float64)).astype(np.int64) // 8)
        shared[going] += equal
        going = going[equal == 8]
        if not len(going):
            break
    result = np.empty(len(at), np.int64)
    result[by_text] = np.minimum(shared, limit)
    return result


_REPEATS = "group string, rows binary, places binary, counts binary"


def _repeats(table: pa.Table) -> pa.Table:
    """Of the strings of one suffix shard, those that also start in a smaller document, by group."""
    columns = {name: [np.frombuffer(b, kind) for b in table.column(name).to_pylist()] for name, kind in (
        ("anchors", "<u4"), ("ids", np.int64), ("rows", "<i4"), ("places", "<i4"), ("counts", "u1"))}
    sent = [i for i, x in enumerate(columns["anchors"]) if len(x)]
    found = [(i, columns["rows"][i], columns["places"][i], columns["counts"][i].astype(np.int64))
             for i in range(table.num_rows) if not len(columns["anchors"][i])]
    if sent:
        source = np.repeat(sent, [len(columns["anchors"][i]) for i in sent])
        anchor, ids, rows, places, counts = (np.concatenate([columns[c][i] for i in sent]) for c in columns)
        counts = counts.astype(np.int64)
        text = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
        size = counts + LENGTH - 1
        ends = np.cumsum(size)
        order, head = _equal_strings(text, ends, size, ids, anchor, _digests(text, size))
        whole = ids[order] > ids[head]
        # What is left of an anchor with one string only has no smaller document; others are sorted by their suffixes.
        heads = np.unique(head)
        _, which, several = np.unique(anchor[heads], return_inverse=True, return_counts=True)
        heads = heads[several[which] > 1]
        own, step = _sorted_repeats(_cut(text, (ends - size)[heads], size[heads]), counts[heads], ids[heads])
        flags = np.zeros(len(text), bool)
        flags[(ends - size)[heads[own]] + step] = True
        owner = np.repeat(order, counts[order])
        steps = np.arange(len(owner)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
        repeat = np.repeat(whole, counts[order]) | flags[np.repeat((ends - size)[head], counts[order]) + steps]
        # Neighbouring repeats of one string run are one row.
        change = np.concatenate([[True], owner[1:] != owner[:-1]])
        edge = np.flatnonzero(repeat & (change | np.concatenate([[True], ~repeat[:-1]])))
        stop = np.flatnonzero(repeat & np.concatenate([change[1:] | ~repeat[1:], [True]]))
        if len(edge):
            by = np.argsort(source[owner[edge]], kind="stable")
            edge, stop = edge[by], stop[by]
            names, start = np.unique(source[owner[edge]], return_index=True)
            for name, part in zip(names.tolist(), np.split(np.arange(len(edge)), start[1:])):
                at = owner[edge[part]]
                found.append((name, rows[at], places[at] + steps[edge[part]], stop[part] - edge[part] + 1))
    uris = table.column("group").to_pylist()
    return pa.table({
        "group": pa.array([uris[i] for i, *_ in found], pa.string()),
        "rows": pa.array([r.astype("<i4").tobytes() for _, r, _, _ in found], pa.binary()),
        "places": pa.array([p.astype("<i4").tobytes() for _, _, p, _ in found], pa.binary()),
        "counts": pa.array([c.astype("u1").tobytes() for _, _, _, c in found], pa.binary())})


def _sorted_repeats(data: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of strings, one after the other in ``data``: the run and the place in it of each string of LENGTH bytes
    that also starts in the run of a smaller document."""
    size = counts + LENGTH - 1
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(owner):
        return owner, step
    place = (np.cumsum(size) - size)[owner] + step
    order, rank = suffix_array(data, LENGTH)
    doc = np.full(len(data), _LAST)
    doc[place] = ids[owner]
    # Neighbours in the array with a common prefix of LENGTH are one class; suffixes that start no string don't count.
    ranks = rank[order]
    tied = np.flatnonzero(np.concatenate([[False], ranks[1:] == ranks[:-1]]))
    joined = np.zeros(len(data), bool)
    joined[tied] = common_prefixes(data, order, tied, LENGTH) >= LENGTH
    heads = np.flatnonzero(~joined)
    smallest = np.empty(len(data), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(doc[order], heads), np.diff(np.append(heads, len(data))))
    repeat = smallest[place] < ids[owner]
    return owner[repeat], step[repeat]


def covered(group: Group, blobs: list[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """The bytes of a group that repeats cover."""
    rows, places, counts = (np.frombuffer(b"".join(x), kind) for x, kind in zip(
        list(zip(*blobs)) or [[], [], []], ("<i4", "<i4", "u1")))
    start, size = group.offsets[rows] + places, len(group.data) + 1
    stop = start + counts + LENGTH - 1
    edge = np.bincount(start, minlength=size) - np.bincount(stop, minlength=size)
    return np.cumsum(edge[:-1]) > 0


def repeats(documents: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Each group file with the repeats in it: ``group`` and ``blobs``, a list of ``rows``, ``places`` and ``counts``."""
    spark = documents.sparkSession
    small_batches(spark)
    found = groups(documents, list(carry), new_folder(spark, "suffix-groups"))
    total = found.agg(F.sum("bytes")).first()[0] or 0
    anchor_shards, shards = total // ANCHOR_SHARD + 1, total // SUFFIX_SHARD + 1
    # Tables of files look small to the planner whatever their tasks read and make: the number of tasks follows from
    # the groups, and nothing is broadcast.
    tasks = max(1, found.count())
    sent = _sent_anchors(found.repartition(tasks, "group"), anchor_shards)
    shared = sent.groupBy("shard").applyInArrow(_shared_anchors, _ANCHORS)
    answers = shared.repartition(tasks, "group").groupBy("group").agg(F.collect_list(F.struct("shard", "keys")).alias("a")).select(
        "group", F.col("a.shard").alias("shards"), F.col("a.keys").alias("keys"))
    blobs = _sent_strings(answers, anchor_shards, shards).groupBy("shard").applyInArrow(_repeats, _REPEATS).repartition(
        tasks, "group").groupBy("group").agg(F.collect_list(F.struct("rows", "places", "counts")).alias("blobs"))
    return found.select("group").join(blobs.hint("merge"), "group", "left")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(documents: DataFrame) -> DataFrame:
    """What each document loses, and the digest of what remains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = Group(uri)
                gone = covered(group, [(b["rows"], b["places"], b["counts"]) for b in blobs or ()])
                out = []
                for a, b in zip(group.offsets.tolist(), group.offsets[1:].tolist()):
                    mine = gone[a:b]
                    n = int(np.count_nonzero(mine))
                    spans = int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(b > a and mine[0])
                    left = group.data[a:b][~mine] if n else group.data[a:b]
                    out.append((b - a, n, spans, hashlib.sha256(left.tobytes()).hexdigest()))
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [group.table.column("doc_id").combine_chunks(), *[pa.array(c, pa.int64()) for c in columns[:3]],
                     pa.array(columns[3], pa.string())], [x.split()[0] for x in _RESULT.split(", ")])

    return repeats(documents).mapInArrow(run, _RESULT)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with all their other columns; ``n_chars`` follows the text.

    Bytes of a character that was cut in two go with the other half.
    """
    schema = documents.schema
    names = [c for c in documents.columns if c not in ("doc_id", "text")]
    kinds = {f.name: f for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = Group(uri)
                gone = covered(group, [(b["rows"], b["places"], b["counts"]) for b in blobs or ()])
                texts = [group.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
                         for a, b in zip(group.offsets.tolist(), group.offsets[1:].tolist())]
                table = group.table.drop_columns(["text"]).append_column("text", pa.array(texts, pa.string()))
                if "n_chars" in kinds:
                    table = table.set_column(table.schema.get_field_index("n_chars"), "n_chars", pa.array(map(len, texts), pa.int64()))
                yield from table.select(list(kinds)).to_batches()

    return repeats(documents, names).mapInArrow(run, schema)


def op8_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
