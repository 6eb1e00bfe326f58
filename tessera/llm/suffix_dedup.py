"""Exact substring dedup with a distributed difference-cover suffix sort.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

1. Anchors. Every 50-byte window has a key, the least hash of its 24-byte pieces; equal
   windows have equal keys. A run of windows with one key is a context, sent as its key and a
   hash of its bytes. A context that a smaller doc_id has too is lost as a whole, without its
   bytes; what stays is searched if other documents have other contexts under its key, and
   dropped if none has. This step loses no match.
2. Sort. The contexts to be searched travel to the bucket of their key, so windows
   that can be equal meet in one bucket and the suffix array is built bucket by bucket. Each
   bucket sorts the suffixes of its distinct contexts by the difference cover modulo 3: the
   triples at sampled places are sorted and named, the names are sorted by recursion, and the
   remaining suffixes are merged in. Neighbours in that order are compared over 50 bytes;
   windows that agree form a group, whose least doc_id decides.
3. Cut. The bytes of all windows that lost are united and removed.

Contexts are combined in each block before they are shuffled: later copies of a
context in a block lost already and ride along under random buckets, so that copies of a
document do not gather. The windows around a very common passage share a key with many
different contexts; such keys (at most `hot_keys`, by count) are split by the windows' own hash.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, cutting

LENGTH = 50
PIECE = 24
SPAN = LENGTH - PIECE + 1
#: Keys and contexts that a task combines before it sends them.
HELD_KEYS, HELD_CONTEXTS = 1 << 20, 1 << 17
#: Contexts that are sorted together.
SORTED_BYTES = 1 << 18
#: Text to a bucket, and to a target where what was found for a document comes together.
BUCKET_BYTES, TARGET_BYTES = 8 << 20, 16 << 20
#: From here up, numbers stand for rows without an id: by text, as rows alike in it are answered alike, but equal in order.
NO_ID = 1 << 62
#: Parts of a large group of exact copies.
SALTS = 32


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of numbers >= 0, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s - s.min() + 1
    sample = np.arange(n + (n % 3 == 1))
    sample = sample[sample % 3 != 0]
    # sort the sampled triples and name them
    _, two = np.unique(t[sample] * (t.max() + 1) + t[sample + 1], return_inverse=True)
    named, name = np.unique(two * (t.max() + 1) + t[sample + 2], return_inverse=True)
    if len(named) == len(sample):
        order = sample[np.argsort(name)]
    else:  # recurse on the names, first those at places 1 mod 3, then 2 mod 3
        places = np.concatenate((sample[sample % 3 == 1], sample[sample % 3 == 2]))
        string = np.concatenate((name[sample % 3 == 1], name[sample % 3 == 2]))
        order = places[suffix_array(string)]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    # the remaining suffixes: by first symbol and the rank behind it, then merged with the sample
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], t[rest]))]
    one, both = order % 3 == 1, order % 3 == 2
    wide = len(rank) + 1
    _, pair = np.unique(t[:-1] * (t.max() + 1) + t[1:], return_inverse=True)
    by_one = lambda i: t[i] * wide + rank[i + 1]
    by_two = lambda i: pair[i] * wide + rank[i + 2]
    before = np.zeros(len(order), np.int64)
    before[one] = np.searchsorted(by_one(rest), by_one(order[one]))
    before[both] = np.searchsorted(by_two(rest), by_two(order[both]))
    out = np.empty(n, np.int64)
    out[np.arange(len(order)) + before] = order
    out[np.arange(len(rest)) + np.searchsorted(by_one(order[one]), by_one(rest)) + np.searchsorted(by_two(order[both]), by_two(rest))] = rest
    return out


def window_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, key and row of every run of windows with one key."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64), none
    h, width, piece, done = blocks._BYTE_KEY[data], 1, np.zeros(0, np.uint64), 0
    while done < PIECE:  # strings of 1, 2, 4, ... bytes, of which a piece consists
        shift = np.uint64(pow(blocks._BASE, width, 2**64))
        if PIECE & width:
            rest = h[done:]
            piece = piece[: len(rest)] * shift + rest if done else rest
            done += width
        h = h[:-width] * shift + h[width:]
        width *= 2
    least = pieces = blocks.mix(piece)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    row_end = np.repeat(at[1:], np.diff(at))[: len(least)]
    valid = np.arange(len(least)) + LENGTH <= row_end
    turn = np.ones(len(least), bool)
    # also where the least piece comes in again from the right: so a run has at most SPAN windows, and equal windows still meet
    turn[1:] = (least[1:] != least[:-1]) | ~valid[:-1] | (pieces[SPAN:] == least[1:])
    first = np.flatnonzero(valid & turn)
    stop = np.ones(len(least), bool)
    stop[:-1] = turn[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    # least hashes crowd at the low end; spread again, so that buckets are even
    return first, last, blocks.mix(least[first] ^ np.uint64(blocks._BASE)), np.searchsorted(at, first, "right") - 1


def contexts(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, end, short key, hash and row of every context. A short key is a bucket and 32 bits of the key's place in it."""
    first, last, key, row = window_keys(data, at)
    high, low = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    short = high * np.uint64(buckets) + (low * np.uint64(buckets) >> np.uint64(32))
    return first, last + LENGTH, short, blocks.mix(blocks.span_hashes(data, first, last + LENGTH) ^ blocks.mix(short)), row


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in schema.split(", "))])


def _batches(schema: str, rows, size: int = 64):
    """Record batches of rows (tuples in the order of the schema)."""
    fields = _schema(schema)
    for some in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), fields, strict=True)], schema=fields)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches(list(_batches(schema, rows, max(1, len(rows)))) or [pa.RecordBatch.from_pylist([], _schema(schema))])


def _slices(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(bucket):
        return []
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


_KEYS = "bucket int, n int, keys binary, ids binary, likes binary"


def _least(key: np.ndarray, like: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, like, owner) in this order, and which of them are lost: a smaller id has the context too."""
    order = np.lexsort((owner, like, key))
    key, like, owner = key[order], like[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (like[1:] != like[:-1])
    once = new.copy()
    once[1:] |= owner[1:] != owner[:-1]
    rank = np.minimum(owner, NO_ID)
    lost = rank > rank[np.flatnonzero(new)][np.cumsum(new) - 1]
    return key[once], like[once], owner[once], lost[once]


def _anchors(buckets: int):
    def run(batches):
        held, salt = [], 0

        def rows():
            nonlocal salt
            key, like, owner, lost = _least(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            salt = (salt * 31 + len(key) + int(key[0] % np.uint64(65521))) % buckets
            gone = np.flatnonzero(lost)
            for lo in range(0, len(gone), 1 << 12):  # known without any other block
                k = gone[lo : lo + (1 << 12)]
                salt = (salt + 1) % buckets
                yield (buckets + salt, len(k), b"", blocks.narrow(owner[k]), like[k].tobytes())
            key, like, owner = key[~lost], like[~lost], owner[~lost]
            sent = (key >> np.uint64(32)).astype(np.int64)
            for lo, hi in _slices(sent):
                yield (int(sent[lo]), hi - lo, key[lo:hi].astype(np.uint32).tobytes(), blocks.narrow(owner[lo:hi]), like[lo:hi].tobytes())

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i, _, data, at in blocks.chunks(batch.column("text")):
                _, _, key, like, row = contexts(data, at, buckets)
                if len(key):
                    held.append((key, like, ids[i + row]))
                if sum(len(x[0]) for x in held) > HELD_KEYS:
                    yield from _batches(_KEYS, rows())
        if held:
            yield from _batches(_KEYS, rows())

    return run


def _targets(place: np.ndarray, n: int) -> np.ndarray:
    """Bucket of ids or places in which what was found for them comes together."""
    return (blocks.mix(place.view(np.uint64)) % np.uint64(n)).astype(np.int32)


_FOUND = "target int, n int, ids binary, keys binary"


def _repeated(buckets: int, targets: int, hot: int):
    """Blocks of (id, number) by the id's target: hashes of contexts that the id lost, and keys for which its others are searched.

    Under target -1 the keys that are searched in `hot` contexts or more.
    """

    def reduce(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        number = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["likes"]])
        owner = np.concatenate([blocks.wide(x.as_py(), n) for x, n in zip(table["ids"], sizes, strict=True)])
        out = []
        if (bucket := table["bucket"][0].as_py()) < buckets:
            key = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["keys"]]) + (np.uint64(bucket) << np.uint64(32))
            key, like, owner, lost = _least(key, number, owner)
            rest, of = key[~lost], owner[~lost]
            rank = np.minimum(of, NO_ID)
            start = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))  # there is one: the least ids lose nothing
            count = np.diff(np.append(start, len(rest)))
            some = np.minimum.reduceat(rank, start) < np.maximum.reduceat(rank, start)  # ids differ, and so do contexts
            common = some & (count >= hot)
            if common.any():
                out.append((-1, int(common.sum()), b"", blocks.mix(rest[start[common]]).tobytes()))
            searched = np.repeat(some, count)
            number, owner = np.concatenate((like[lost], blocks.mix(rest[searched]))), np.concatenate((owner[lost], of[searched]))
        target = _targets(owner, targets)
        order = np.argsort(target, kind="stable")
        number, owner, target = number[order], owner[order], target[order]
        out += [(int(target[lo]), hi - lo, blocks.narrow(owner[lo:hi]), number[lo:hi].tobytes()) for lo, hi in _slices(target)]
        return _table(_FOUND, out)

    return reduce


def _keys_by_id(table: pa.Table) -> pa.Table:
    """id and keys (array) of one target's blocks."""
    owner = np.concatenate([blocks.wide(x.as_py(), n) for x, n in zip(table["ids"], table["n"].to_pylist(), strict=True)])
    key = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["keys"]])
    order = np.argsort(owner, kind="stable")
    owner, key = owner[order], key[order]
    runs = _slices(owner)
    return pa.table({"id": pa.array([owner[lo] for lo, _ in runs], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0] + [hi for _, hi in runs], pa.int32()), pa.array(key))})


def _common(batches):
    for batch in batches:
        for k in batch.column("keys"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_py(), np.int64))], names=["key"])


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are in the sorted values."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


_CONTEXTS = "bucket int, n int, base long, keys binary, ids binary, places binary, starts binary, sizes binary, bytes binary"


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places start[k], start[k] + 1, ... of ranges of the given sizes, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _contexts(buckets: int, hot_keys):
    def cut(data, at, numbers, lists, hot):
        """Key, first start, end and row of the contexts that are searched, and first start, end and row of what the row's others lost."""
        first, end, key, like, row = contexts(data, at, buckets)
        key = blocks.mix(key)
        tag = lambda r, k: blocks.mix(k + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        known = np.sort(tag(np.repeat(np.arange(len(lists) - 1), np.diff(lists)), numbers))
        lost = _among(known, tag(row, like))
        a, b, r = first[lost], end[lost], row[lost]
        new = np.ones(len(a), bool)  # contexts are in order and overlap
        new[1:] = (r[1:] != r[:-1]) | (a[1:] > b[:-1])
        gone = a[new], b[np.append(new[1:], True)] if len(b) else b, r[new]
        stay = ~lost & _among(known, tag(row, key))
        first, end, key, row = first[stay], end[stay], key[stay], row[stay]
        if (split := _among(hot, key)).any():  # every window of a hot key for itself
            size = np.where(split, end - first - LENGTH + 1, 1)
            k = np.repeat(np.arange(len(first)), size)
            within = _places(np.zeros(len(size), np.int64), size)
            first, end = first[k] + within, np.where(split[k], first[k] + within + LENGTH, end[k])
            key, row, split = key[k], row[k], split[k]
            key = np.where(split, blocks.mix(key ^ blocks.span_hashes(data, first, first + LENGTH)), key)
        return key, first, end, row, gone

    def run(batches):
        hot, held, ready, salt = hot_keys.value, [], [], 0

        def pack(bucket, key, owner, place, begin, size, raw):
            base = int(place.min())
            return (bucket, len(place), base, key.tobytes(), blocks.narrow(owner), blocks.narrow(place - base), begin.astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), raw)

        def rows():
            nonlocal salt
            if held:
                key, like, owner, place, begin, size, text = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                start = np.cumsum(size) - size
                order = np.lexsort((begin, place, owner, like, key))
                key, like, owner, place, begin, size, start = (x[order] for x in (key, like, owner, place, begin, size, start))
                group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (like[1:] != like[:-1])))) - 1
                rank = np.minimum(owner, NO_ID)
                lost = rank > rank[np.flatnonzero(np.diff(group, prepend=-1))][group]
                some = np.flatnonzero(~lost)
                sent = blocks.bucket_of(key[some], buckets)
                for lo, hi in _slices(sent):
                    k = some[lo:hi]
                    yield pack(int(sent[lo]), key[k], owner[k], place[k], begin[k], size[k], text[_places(start[k], size[k])].tobytes())
                ready.append(tuple(x[lost] for x in (owner, place, begin, size)))
            gone = tuple(np.concatenate(x) for x in zip(*ready, strict=True))
            ready.clear()
            salt = (salt * 31 + len(gone[0]) + int(gone[1].max(initial=0)) % 65521) % buckets
            for lo in range(0, len(gone[0]), 1 << 11):
                salt = (salt + 1) % buckets
                yield pack(buckets + salt, np.zeros(0, np.uint64), *(x[lo : lo + (1 << 11)] for x in gone), b"")

        for batch in batches:
            ids, places = batch.column("id").to_numpy(), batch.column("place").to_numpy()
            numbers = batch.column("keys")
            lists = np.concatenate(([0], np.cumsum([len(x) for x in numbers])))
            numbers = numbers.flatten().to_numpy().view(np.uint64)
            for i, j, data, at in blocks.chunks(batch.column("text")):
                key, first, end, row, (a, b, r) = cut(data, at, numbers[lists[i] : lists[j]], lists[i : j + 1], hot)
                if len(r):
                    ready.append((ids[i + r], places[i + r], a - at[r], b - a))
                if len(key):
                    like = blocks.mix(blocks.span_hashes(data, first, end) ^ key)
                    held.append((key, like, ids[i + row], places[i + row], first - at[row], end - first, data[_places(first, end - first)]))
                if sum(len(x[0]) for x in (*held, *ready)) > HELD_CONTEXTS:
                    yield from _batches(_CONTEXTS, rows(), 32)
        if held or ready:
            yield from _batches(_CONTEXTS, rows(), 32)

    return run


def _groups(text: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and offset of the windows whose string also starts in a context with a smaller id.

    Contexts lie at text[start:start + size]; least holds their ids.
    """
    count = size - LENGTH + 1
    context = np.repeat(np.arange(len(start)), count)
    offset = _places(np.zeros(len(count), np.int64), count)
    # contexts set apart by zeros, so that equal windows at their ends differ behind
    spaced = np.zeros(int(size.sum()) + len(start), np.int64)
    head = np.cumsum(size + 1) - size - 1
    spaced[_places(head, size)] = text[_places(start, size)].astype(np.int64) + 1
    window = np.full(len(spaced), -1)
    window[head[context] + offset] = np.arange(len(context))
    order = suffix_array(spaced)
    order = order[window[order] >= 0]
    joint = np.zeros(len(order), bool)  # same first 50 bytes as the neighbour before
    symbols = spaced.astype(np.uint16)
    for lo in range(1, len(order), 1 << 16):
        here = order[lo : lo + (1 << 16)]
        left = order[lo - 1 : lo - 1 + len(here)]
        reach = np.arange(LENGTH)
        joint[lo : lo + len(here)] = (symbols[here[:, None] + reach] == symbols[left[:, None] + reach]).all(axis=1)
    group = np.cumsum(~joint) - 1
    ids = least[context[window[order]]]
    lowest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, ids)
    lost = window[order[ids > lowest[group]]]
    return context[lost], offset[lost]


def _lost(key, owner, begin, size, start, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the ranges that contexts with these keys lose to each other."""
    like = blocks.mix(blocks.span_hashes(text, start, start + size) ^ key)
    order = np.lexsort((owner, like, key))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (like[order][1:] != like[order][:-1])))
    alike = np.empty(len(order), np.int64)
    alike[order] = np.cumsum(new) - 1
    first = order[new]  # each distinct context, with its least id
    owner = np.minimum(owner, NO_ID)
    later = owner > owner[first][alike]
    gone = [(np.flatnonzero(later), begin[later], begin[later] + size[later])]
    # keys with one distinct context have no other window to compare
    _, back, contexts = np.unique(key[first], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(contexts[back] > 1)
    if len(open_):
        k = first[open_]
        which, offset = _groups(text, start[k], size[k], owner[k])
        # of the rows that hold a context's least id, every place loses these windows
        rows = np.flatnonzero(~later)
        rows = rows[np.argsort(alike[rows], kind="stable")]
        lo, hi = (np.searchsorted(alike[rows], open_[which], side) for side in ("left", "right"))
        index, row = np.repeat(np.arange(len(which)), hi - lo), rows[_places(lo, hi - lo)]
        gone.append((row, begin[row] + offset[index], begin[row] + offset[index] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*gone, strict=True))


_RANGES = "target int, n int, ids binary, places binary, begins binary, ends binary"


def _sorted(buckets: int, targets: int):
    """Blocks of place, begin, end of the ranges that each bucket's suffix order removes, by the place's target.

    Keys do not meet each other, so a bucket is sorted a few keys at a time: SORTED_BYTES of
    contexts, or one key's.
    """

    def reduce(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])
        place = np.concatenate([b + blocks.wide(x.as_py(), n) for b, x, n in zip(table["base"].to_pylist(), table["places"], sizes, strict=True)])
        begin, size = join("starts", np.uint32).astype(np.int64), join("sizes", np.uint32).astype(np.int64)
        owner = np.concatenate([blocks.wide(x.as_py(), n) for x, n in zip(table["ids"], sizes, strict=True)])
        gone = [(place, owner, begin, begin + size)]
        if table["bucket"][0].as_py() < buckets:
            key, text = join("keys", np.uint64), join("bytes", np.uint8)
            start = np.cumsum(size) - size
            order = np.argsort(key, kind="stable")
            turn = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True])))
            reached = np.concatenate(([0], np.cumsum(size[order])))[turn]
            gone, at = [(place[:0], owner[:0], begin[:0], begin[:0])], 0
            while at < len(turn) - 1:
                to = max(at + 1, int(np.searchsorted(reached, reached[at] + SORTED_BYTES, "right")) - 1)
                k = order[turn[at] : turn[to]]
                row, a, b = _lost(key[k], owner[k], begin[k], size[k], np.cumsum(size[k]) - size[k], text[_places(start[k], size[k])])
                gone.append((place[k[row]], owner[k[row]], a, b))
                at = to
        place, ids, a, b = (np.concatenate(x) for x in zip(*gone, strict=True))
        order = np.lexsort((a, place))
        place, ids, a, b = place[order], ids[order], a[order], b[order]
        runs = _slices(place)
        merged = [cutting.merged(a[lo:hi], b[lo:hi]) for lo, hi in runs]
        heads, many = [lo for lo, _ in runs], [len(m[0]) for m in merged]
        where, whose = (np.repeat(x[heads], many) if runs else x for x in (place, ids))
        begins, ends = (np.concatenate([m[k] for m in merged]) if runs else a for k in (0, 1))
        target = _targets(whose, targets)
        order = np.argsort(target, kind="stable")
        where, whose, begins, ends, target = where[order], whose[order], begins[order].astype(np.int32), ends[order].astype(np.int32), target[order]
        return _table(_RANGES, [(int(target[lo]), hi - lo, blocks.narrow(whose[lo:hi]), where[lo:hi].tobytes(), begins[lo:hi].tobytes(), ends[lo:hi].tobytes()) for lo, hi in _slices(target)])

    return reduce


def _ranges_by_id(table: pa.Table) -> pa.Table:
    """id, places, begins, ends of one target's blocks; the places tell rows with one id apart."""
    owner = np.concatenate([blocks.wide(x.as_py(), n) for x, n in zip(table["ids"], table["n"].to_pylist(), strict=True)])
    place, begin, end = (np.concatenate([np.frombuffer(x.as_py(), k) for x in table[n]]) for n, k in (("places", np.int64), ("begins", np.int32), ("ends", np.int32)))
    order = np.lexsort((begin, place, owner))
    owner, place, begin, end = owner[order], place[order], begin[order], end[order]
    ids, lists, at = [], ([], [], []), [0]
    for lo, hi in _slices(owner):
        for x, y in _slices(place[lo:hi]):
            b, e = cutting.merged(begin[lo + x : lo + y], end[lo + x : lo + y])
            for part, new in zip(lists, (np.full(len(b), place[lo + x]), b, e), strict=True):
                part.append(new)
        ids.append(owner[lo])
        at.append(sum(map(len, lists[0][-len(_slices(place[lo:hi])) :])) + at[-1])
    flat = [np.concatenate(p).astype(k) if p else np.zeros(0, k) for p, k in zip(lists, (np.int64, np.int32, np.int32), strict=True)]
    return pa.table({"id": pa.array(ids, pa.int64())} | {n: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for n, x in zip(("places", "begins", "ends"), flat, strict=True)})


def _copies(rows: DataFrame) -> DataFrame:
    """id and rk of the rows whose whole text a smaller id has too; such texts need no search."""
    order = F.least("id", F.lit(NO_ID))
    marks = blocks.table(rows.select("id", "rk", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(7)).alias("g"), F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH))
    least = marks.groupBy("h", "g", "n").agg(F.min(order).alias("least"), F.max(order).alias("most")).filter("least < most").drop("most")
    parts = least.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return marks.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(parts, ["h", "g", "n", "salt"]).filter(order > F.col("least")).select("id", "rk")


def _renumbered(rows: DataFrame) -> DataFrame:
    """rows with numbers below NO_ID in the order of doc_id: ranges of ids, each sorted, counted on from range to range."""
    ids = rows.select(F.col("doc_id").alias("of")).filter("of IS NOT NULL").distinct().repartitionByRange(blocks.partitions(rows.sparkSession), "of").sortWithinPartitions("of")
    numbers = blocks.table(ids.withColumn("number", F.monotonically_increasing_id()))
    return rows.join(numbers.hint("merge"), F.col("doc_id") == F.col("of"), "left").drop("of")


def dedup(docs: DataFrame, hot: int = 1000, full: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with `full` also kept, the bytes), one row per input row.

    Strings are judged on the input texts as UTF-8. Null texts are empty; texts under 50 bytes
    lose nothing, an empty table gives an empty one. Rows with one doc_id do not remove each
    other's strings; a null doc_id counts as larger than all others.
    Rows alike in doc_id and text get the same answer. A very long text is one row of a task like
    any other, read a chunk at a time. Only doc_id and text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    rows = cutting.numbered(docs)
    # buckets, targets and the line between hot keys and others follow the bytes of all texts
    found = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max("doc_id").alias("largest")).first()
    total = found.bytes or 0
    rows = rows.withColumn("number", F.col("doc_id")) if (found.largest or 0) < NO_ID else _renumbered(rows)
    rows = rows.select("doc_id", F.coalesce("number", F.col("rk").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))).alias("id"), "rk", "text")
    buckets, targets = 1 + total // BUCKET_BYTES, 1 + total // TARGET_BYTES
    hot = blocks.hot_from(total, hot)
    repeated = blocks.table(rows.select("id", "text").mapInArrow(_anchors(buckets), _KEYS).groupBy("bucket").applyInArrow(_repeated(buckets, targets, hot), _FOUND))
    common = repeated.filter("target = -1").select("keys").mapInArrow(_common, "key long")
    common = np.sort(common.toPandas()["key"].to_numpy(np.int64).view(np.uint64))  # a key has `hot` contexts or more, which bounds their number
    blocks.release(spark)
    # what each id lost and has to be searched for; exact copies of smaller ids lose everything without either
    by_id = repeated.filter("target >= 0").groupBy("target").applyInArrow(_keys_by_id, "id long, keys array<long>")
    copies = _copies(rows).groupBy("id").agg(F.collect_set("rk").alias("copies"))
    copy = F.coalesce(F.array_contains("copies", F.col("rk")), F.lit(False))
    searched = ~copy & (F.coalesce(F.size("keys"), F.lit(0)) > 0)
    # texts are shuffled once, for the search; their table is bucketed, so the cut reads them in place
    marked = rows.join(by_id, "id", "left").join(copies, "id", "left").select(
        "doc_id",
        "id",
        F.monotonically_increasing_id().alias("place"),
        F.when(searched, F.col("keys")).alias("keys"),
        F.when(searched | F.lit(full), F.col("text")).alias("text"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.when(copy, F.lit("")).otherwise(F.col("text")), 256).alias("whole_sha256"),
        copy.alias("copy"),
    )
    marked = blocks.bucketed(marked, "id")
    blocks.release(spark)
    contexts = marked.filter("keys IS NOT NULL").select("id", "place", "text", "keys").mapInArrow(_contexts(buckets, spark.sparkContext.broadcast(common)), _CONTEXTS)
    lost = contexts.groupBy("bucket").applyInArrow(_sorted(buckets, targets), _RANGES)
    ranges = lost.groupBy("target").applyInArrow(_ranges_by_id, "id long, places array<long>, begins array<int>, ends array<int>")
    own = lambda name: F.filter(name, lambda _, k: F.get("places", k) == F.col("place"))
    both = marked.drop("keys").join(ranges, "id", "left").withColumns({"begins": own("begins"), "ends": own("ends")})
    return cutting.cut(both, 0, full)
