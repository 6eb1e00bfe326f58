"""Alignment of two tokenizers by an associative monoid of fragments.

Both token sequences of a text cover the same bytes. The offsets where tokens of both end cut them
into groups. A fragment stands for a byte range: what ends before its first common offset (open
prefix), the groups between its first and its last one (closed), and what ends after (open
suffix). Fragments of neighbouring ranges compose: the suffix of one and the prefix of the next
make a group, or stay open where a range has no common offset. Composition is associative, so a
long document's byte ranges are encoded by different tasks and reduced as a tree over tasks; each
round joins FAN neighbours. Short documents are single fragments and take no part in that.

A pair of ids is linked once for every two tokens whose byte ranges overlap. The stretches between
neighbouring offsets, of either kind, are just these overlaps, so links need no search. Counts of
pairs over the corpus come from the stored fragments. Pairs from a count up, chosen so that at most
`head_pairs` reach it, are broadcast; the other pairs, rare by that choice, are joined.

Both vocabularies only join pieces at a space that follows a word, never across it. A text is
therefore cut before single spaces between words, and each distinct cut piece of a chunk is encoded
once. The result's bytes are compared with the text; a text that differs is encoded as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Neighbours that a round of the tree joins.
FAN = 8
_FLUSH = 1_500_000
#: White space of 2 bytes starts with 0xC2; longer characters are never cut after.
_CUT_AFTER = np.zeros(256, bool)
_CUT_AFTER[0x21:0x7F] = True


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple:
    """For each side (encode texts to lists of ids, bytes of every id, whether texts may be cut before spaces)."""
    return _byte_level(path_a), _pieces(path_b)


def _byte_level(path: str):
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.load(open(path))
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel":
        raise ValueError(f"{path} is no byte-level BPE")
    # the printable stand-ins of byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    known = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
    size = max(known.values()) + 1
    raw = [b""] * size
    for token, i in known.items():
        raw[i] = token
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    in_order = all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merges)) and sorted(known.values()) == list(range(256 + len(merges)))
    simple = spec.get("normalizer") is None and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
    if in_order and simple:  # ids are ranks: the faster library gives the same ids
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        return (lambda texts: [fast.encode_ordinary(" " + x) for x in texts]), raw, True
    return (lambda texts: [x.ids for x in whole.encode_batch([" " + x for x in texts], add_special_tokens=False)]), raw, False


def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    cut = not any("▁" in p.lstrip("▁") for p in names)
    return (lambda texts: model.encode(texts, num_threads=1)), raw, cut


class Sides:
    """The two vocabularies as tables, and the encoding of a chunk of texts by them."""

    def __init__(self, paths: tuple[str, str]):
        both = tokenizers(*paths)
        self.encode = [x[0] for x in both]
        self.raw = [x[1] for x in both]
        self.cut = all(x[2] for x in both)
        self.size = [np.array([len(t) for t in x[1]], np.int64) for x in both]
        # what a token adds to a group's text, by what follows it: a comma, or the end of its side
        self.written = [[f"{i}{end}" for i in range(len(x[1])) for end in ends] for x, ends in zip(both, (",|", ",;"), strict=True)]

    def tokens(self, data: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Both sides' ids and end offsets in the texts behind a space each, and which rows have tokens; the others take no room."""
        full = np.flatnonzero(np.diff(at))
        first = at[full] + np.arange(len(full))
        text = np.empty(len(data) + len(full), np.uint8)
        head = np.zeros(len(text), bool)
        head[first] = True
        text[head], text[~head] = 32, data
        limits = np.append(first, len(text))
        both = self._by_piece(text, head, limits) if self.cut else self._whole(text, limits, np.arange(len(full)))
        good = self._spelt(text, limits, both)
        if self.cut and not good.all():
            both = self._mended(text, limits, both, np.flatnonzero(~good))
            good = self._spelt(text, limits, both)
        out = []
        for side, (ids, count) in enumerate(both):
            ids = ids[np.repeat(good, count)]
            out.append((ids, np.cumsum(self.size[side][ids])))
        ok = np.zeros(len(at) - 1, bool)
        ok[full] = good
        return out, ok

    def _by_piece(self, text, head, limits):
        """Both sides' ids and numbers of tokens by row, each distinct piece encoded once."""
        begin = np.flatnonzero(head | cuts(text))
        end = np.append(begin[1:], len(text))[: len(begin)]
        _, one, back = np.unique(blocks.span_hashes(text, begin, end), return_index=True, return_inverse=True)
        raw, row = text.tobytes(), np.searchsorted(limits, begin, "right") - 1
        plain = [raw[b + 1 : e].decode() for b, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        out = []
        for encode in self.encode:
            lists = encode(plain) if plain else []
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((i for x in lists for i in x), np.int64, int(count.sum()))
            each = count[back]
            place = np.repeat((np.cumsum(count) - count)[back] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            out.append((flat[place], np.bincount(row, weights=each, minlength=len(limits) - 1).astype(np.int64)))
        return out

    def _whole(self, text, limits, rows):
        """As _by_piece(), of these rows, each text encoded as one."""
        raw = text.tobytes()
        plain = [raw[limits[r] + 1 : limits[r + 1]].decode() for r in rows.tolist()]
        lists = [[np.array(x, np.int64) for x in (encode(plain) if plain else [])] for encode in self.encode]
        return [(np.concatenate([np.zeros(0, np.int64), *x]), np.array([len(y) for y in x], np.int64)) for x in lists]

    def _mended(self, text, limits, both, rows):
        again = self._whole(text, limits, rows)
        out = []
        for (ids, count), (new, n) in zip(both, again, strict=True):
            parts, fresh = np.split(ids, np.cumsum(count)[:-1]), np.split(new, np.cumsum(n)[:-1])
            count = count.copy()
            for k, r in enumerate(rows.tolist()):
                parts[r], count[r] = fresh[k], n[k]
            out.append((np.concatenate(parts), count))
        return out

    def _spelt(self, text, limits, both) -> np.ndarray:
        """Rows whose tokens, of both sides, spell their text."""
        good = np.ones(len(limits) - 1, bool)
        want = text.tobytes()
        for side, (ids, count) in enumerate(both):
            at = np.concatenate(([0], np.cumsum(self.size[side][ids])))[np.concatenate(([0], np.cumsum(count)))]
            raw = b"".join(map(self.raw[side].__getitem__, ids.tolist()))
            if raw != want or not np.array_equal(at, limits):
                good &= [raw[at[r] : at[r + 1]] == want[limits[r] : limits[r + 1]] for r in range(len(good))]
        return good


def cuts(text: np.ndarray) -> np.ndarray:
    """Where a text may be cut: before a single space between a word and a word."""
    out = np.zeros(len(text), bool)
    if len(text) > 3:
        word = _CUT_AFTER[text]
        two = (text[:-1] >= 0xC3) & (text[:-1] < 0xE0)  # lead byte of a two-byte character that is no space
        before = word[1:-2] | two[:-2]
        out[2:-1] = (text[2:-1] == 32) & before & (word[3:] | (text[3:] >= 0xC3) & (text[3:] < 0xE0))
    return out


def met(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets that both sides have, and all offsets; each side is sorted and has an offset once."""
    both = np.concatenate((a_end, b_end))
    both.sort(kind="stable")  # two sorted runs are merged
    again = both[1:] == both[:-1]
    return both[1:][again], both[np.concatenate(([True], ~again))[: len(both)]]


class Fragment:
    """What the tokens that end in a byte range say of the alignment; offsets are those of the whole text."""

    NONE = (np.zeros(0, np.int64),) * 4

    def __init__(self, prefix=NONE, suffix=NONE, first=-1, last=-1, written=b"", groups=0, pairs=None):
        self.prefix, self.suffix, self.first, self.last, self.written, self.groups = prefix, suffix, first, last, written, groups
        self.pairs = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if pairs is None else pairs

    @staticmethod
    def of(sides: Sides, a, a_end, b, b_end) -> Fragment:
        """Of the tokens that end in a range; it is open as a whole if no two ends meet."""
        common, _ = met(a_end, b_end)
        if not len(common):
            return Fragment(prefix=(a, a_end, b, b_end))
        first, last = int(common[0]), int(common[-1])
        part = lambda lo, hi: tuple(x[(e > lo) & (e <= hi)] for x, e in ((a, a_end), (a_end, a_end), (b, b_end), (b_end, b_end)))
        inner = part(first, last)
        return Fragment(part(-1, first), part(last, 1 << 62), first, last, _written(sides, *inner).encode(), max(0, len(common) - 1), _linked(sides, *inner))

    def __add__(self, other: Fragment) -> Fragment:
        join = lambda x, y: tuple(np.concatenate(z) for z in zip(x, y, strict=True))
        if self.first < 0:
            return Fragment(join(self.prefix, other.prefix), other.suffix, other.first, other.last, other.written, other.groups, other.pairs)
        if other.first < 0:
            return Fragment(self.prefix, join(self.suffix, other.prefix), self.first, self.last, self.written, self.groups, self.pairs)
        raise TypeError("composing two closed fragments needs the vocabularies: use compose()")


def compose(sides: Sides, x: Fragment, y: Fragment) -> Fragment:
    """Of two neighbouring ranges; associative, and an empty fragment changes nothing."""
    if x.first < 0 or y.first < 0:
        return x + y
    middle = tuple(np.concatenate(z) for z in zip(x.suffix, y.prefix, strict=True))
    text = b";".join(t for t in (x.written, _written(sides, *middle).encode(), y.written) if t)
    pairs = _together([x.pairs, _linked(sides, *middle), y.pairs])
    return Fragment(x.prefix, y.suffix, x.first, y.last, text, x.groups + 1 + y.groups, pairs)


def closed(sides: Sides, x: Fragment) -> Fragment:
    """A whole text's fragment: its prefix is a group too."""
    if not len(x.prefix[0]):
        return x
    whole = Fragment(first=0, last=0)
    return compose(sides, whole, x)


def _codes(sides: Sides, a, a_end, b, b_end, common) -> np.ndarray:
    """The tokens of groups in order, each as its place in `written` of both sides together."""
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[np.searchsorted(a_end, common)] = b_last[np.searchsorted(b_end, common)] = True
    a_group, b_group = (np.cumsum(last) - last for last in (a_last, b_last))
    shift = 2 * len(sides.raw[0])
    code = np.empty(len(a) + len(b), np.int64)
    # of a group first the one side, then the other
    code[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = 2 * a + a_last
    code[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = shift + 2 * b + b_last
    return code


def _written(sides: Sides, a, a_end, b, b_end) -> str:
    if not len(a):
        return ""
    table = sides.written
    shift = len(table[0])
    code = _codes(sides, a, a_end, b, b_end, met(a_end, b_end)[0])
    return "".join([table[0][c] if c < shift else table[1][c - shift] for c in code.tolist()])[:-1]


def _linked(sides: Sides, a, a_end, b, b_end) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (id of A times the size of B, plus id of B) and how often."""
    _, ends = met(a_end, b_end)
    keys = a[np.searchsorted(a_end, ends)] * len(sides.raw[1]) + b[np.searchsorted(b_end, ends)] if len(ends) else ends
    return np.unique(keys.astype(np.uint64), return_counts=True)


def _together(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _kind(sides: Sides) -> str:
    """Type of stored pairs."""
    return "uint32" if len(sides.raw[0]) * len(sides.raw[1]) < 1 << 32 else "uint64"


_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_PART = "place long, doc_id long, part long, ok boolean, n_a long, n_b long, first long, last long, n_groups long, written binary, prefix binary, suffix binary, n_prefix long, n_suffix long, pairs binary, times binary"


def _narrow(times: np.ndarray) -> bytes:
    return times.astype(np.uint8 if not len(times) or times.max() < 256 else np.int64).tobytes()


def _wide(keys: bytes, times: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, kind).astype(np.uint64)
    return k, np.frombuffer(times, np.uint8 if len(times) == len(k) else np.int64).astype(np.int64)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names=list(names))


def _short(texts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Documents of a single fragment, many at once."""

    def run(batches):
        sides = Sides(paths)
        kind, table = _kind(sides), sides.written[0] + sides.written[1]
        bits = (len(sides.raw[0]) * len(sides.raw[1])).bit_length()
        shift = np.uint64(bits)
        for batch in batches:
            for i, j, data, at in blocks.chunks(batch.column("text")):
                ((a, a_end), (b, b_end)), ok = sides.tokens(data, at)
                limit = np.concatenate(([0], np.cumsum(np.where(ok, np.diff(at) + 1, 0))))
                common, ends = met(a_end, b_end)
                code = _codes(sides, a, a_end, b, b_end, common)
                keys = a[np.searchsorted(a_end, ends)] * len(sides.raw[1]) + b[np.searchsorted(b_end, ends)] if len(ends) else ends
                row = np.searchsorted(limit, ends) - 1
                held, times = np.unique(row.astype(np.uint64) << shift | keys.astype(np.uint64), return_counts=True)
                na, nb, ng, nl = (np.diff(np.searchsorted(e, limit, "right")) for e in (a_end, b_end, common, ends))
                cut = np.searchsorted(held, np.arange(j - i + 1).astype(np.uint64) << shift)
                held &= np.uint64((1 << bits) - 1)
                place = np.concatenate(([0], np.cumsum(na + nb)))
                rows = []
                for r, doc in enumerate(batch.column("doc_id").slice(i, j - i).to_pylist()):
                    digest = hashlib.sha256("".join(map(table.__getitem__, code[place[r] : place[r + 1]].tolist()))[:-1].encode()).hexdigest() if ok[r] else ""
                    rows.append((doc, na[r], nb[r], ng[r], nl[r], digest, held[cut[r] : cut[r + 1]].astype(kind).tobytes(), _narrow(times[cut[r] : cut[r + 1]])))
                for k in range(0, len(rows), 500):
                    yield _table(rows[k : k + 500], _DONE)

    return texts.mapInArrow(run, _DONE)


def _packed(sides: Sides, x: Fragment) -> tuple:
    pack = lambda p: b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in p)
    return x.first, x.last, x.groups, x.written, pack(x.prefix), pack(x.suffix), len(x.prefix[0]), len(x.suffix[0]), x.pairs[0].astype(_kind(sides)).tobytes(), _narrow(x.pairs[1])


def _unpacked(sides: Sides, r: dict) -> Fragment:
    def side(raw, n):
        flat = np.frombuffer(raw, np.int64)
        m = len(flat) // 2 - n
        return flat[:n], flat[n : 2 * n], flat[2 * n : 2 * n + m], flat[2 * n + m :]

    return Fragment(side(r["prefix"], r["n_prefix"]), side(r["suffix"], r["n_suffix"]), r["first"], r["last"], r["written"], r["n_groups"], _wide(r["pairs"], r["times"], _kind(sides)))


def _long(texts: DataFrame, paths: tuple[str, str], cut: bool, chunk_bytes: int, tasks: int) -> DataFrame:
    """Documents of several byte ranges: each range a fragment, composed by a tree over tasks."""

    def deal(batches):
        for batch in batches:
            for place, doc, text in zip(batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = np.frombuffer(b" " + text.as_py().encode(), np.uint8)
                may = np.flatnonzero(cuts(raw)) if cut else np.zeros(0, np.int64)
                at = np.unique(may[np.minimum(np.searchsorted(may, np.arange(chunk_bytes, len(raw), chunk_bytes)), len(may) - 1)]) if len(may) else may
                at = [0, *at.tolist(), len(raw)]
                for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([doc], pa.int64()), pa.array([k]), pa.array([lo]), pa.array([raw[lo + 1 : hi].tobytes().decode()])], names=["place", "doc_id", "part", "at", "text"])

    def encode(batches):
        sides = Sides(paths)
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["text"].encode(), np.uint8)
                ((a, a_end), (b, b_end)), ok = sides.tokens(data, np.array([0, len(data)]))
                whole = Fragment()
                for lo in range(0, len(data) + 1, chunk_bytes):  # ranges of bytes, wherever tokens end
                    p, q = ((e > lo) & (e <= lo + chunk_bytes) for e in (a_end, b_end))
                    whole = compose(sides, whole, Fragment.of(sides, a[p], a_end[p] + r["at"], b[q], b_end[q] + r["at"]))
                yield _table([(r["place"], r["doc_id"], r["part"], bool(ok[0]), len(a), len(b), *_packed(sides, whole))], _PART)

    def reduce(table: pa.Table) -> pa.Table:
        sides = Sides(paths)
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        whole = functools.reduce(functools.partial(compose, sides), [_unpacked(sides, r) for r in rows])
        out = (rows[0]["place"], rows[0]["doc_id"], rows[0]["part"] // FAN, all(r["ok"] for r in rows), sum(r["n_a"] for r in rows), sum(r["n_b"] for r in rows), *_packed(sides, whole))
        return pa.Table.from_batches([_table([out], _PART)])

    def finish(batches):
        sides = Sides(paths)
        for batch in batches:
            for r in batch.to_pylist():
                x = closed(sides, _unpacked(sides, r))
                good = r["ok"] and not len(x.suffix[0])
                yield _table([(r["doc_id"], r["n_a"], r["n_b"], x.groups, int(x.pairs[1].sum()), hashlib.sha256(x.written).hexdigest(), x.pairs[0].astype(_kind(sides)).tobytes(), _narrow(x.pairs[1])) if good else (r["doc_id"], 0, 0, 0, 0, "", b"", b"")], _DONE)

    parts = texts.mapInArrow(deal, "place long, doc_id long, part long, at long, text string").repartition(tasks, "place", "part")
    now = blocks.table(parts.mapInArrow(encode, _PART))
    while (now.agg(F.max("part")).first()[0] or 0) > 0:
        now = blocks.table(now.withColumn("up", F.floor(F.col("part") / FAN)).groupBy("place", "up").applyInArrow(lambda t: reduce(t.drop_columns(["up"])), _PART))
    return now.mapInArrow(finish, _DONE)


def _counted(done: DataFrame, kind: str) -> DataFrame:
    """pair, n over the corpus."""

    def run(batches):
        held, waiting = [], 0

        def rows():
            keys, times = _together(held)
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(times[k : k + 100_000])], names=["pair", "n"])
            held.clear()

        for batch in batches:
            for k, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                held.append(_wide(k, t, kind))
                waiting += len(held[-1][0])
                if waiting > _FLUSH:
                    yield from rows()
                    waiting = 0
        if held:
            yield from rows()

    return done.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = 1 << 18, head_pairs: int = 500_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per input row.

    A is a byte-level BPE file, encoding space+text, B a piece model that adds the space itself. A
    text that is null, empty, or that either side does not spell has no tokens: zeros and ''. Rows
    that repeat are aligned and counted each, also without a doc_id; an empty table gives an
    empty one. Texts over `chunk_bytes` are cut into ranges over tasks; one without a space between
    words is encoded by one task. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    paths = (path_a, path_b)
    sides = Sides(paths)
    size_b = len(sides.raw[1])
    rows = blocks.corpus(docs).withColumn("place", F.monotonically_increasing_id())
    large = F.octet_length("text") > chunk_bytes
    tasks = blocks.partitions(spark)
    done = blocks.table(_short(rows.filter(~large).select("doc_id", "text"), paths).unionByName(_long(rows.filter(large), paths, sides.cut, chunk_bytes, tasks)).withColumn("place", F.monotonically_increasing_id()))

    kind = _kind(sides)
    counts = blocks.table(_counted(done, kind))
    # at most one row for each piece of B
    best = counts.groupBy((F.col("pair") % size_b).alias("piece")).agg(F.max("n").alias("most"))
    counts = blocks.table(counts.join(F.broadcast(best), F.col("pair") % size_b == F.col("piece")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    # the least power of two that at most head_pairs pairs reach
    reach = counts.select(*(F.count_if(F.col("n") >= (1 << k)).alias(f"k{k}") for k in range(48))).first()
    cut = next(1 << k for k in range(48) if reach[k] <= head_pairs)
    head = counts.filter(F.col("n") >= cut).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64).astype(np.uint64), head["n"].to_numpy(np.int64), head["best"].to_numpy(bool)))
    del head

    def look(batches):
        pair, n, best = shared.value
        for batch in batches:
            sums, tops, rare = [], [], []
            for k, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
                keys, times = _wide(k, t, kind)
                at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
                hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                sums.append(int((n[at[hit]] * times[hit]).sum()))
                tops.append(int(times[hit][best[at[hit]]].sum()))
                rare.append(np.repeat(keys[~hit], times[~hit]).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in rare]))).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rare, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(sums, pa.int64()), pa.array(tops, pa.int64()), tail], names=["place", "sums", "tops", "tail"])

    # with few pairs all are in the head, and the join below has no rows
    found = blocks.table(done.select("place", "pairs", "times").mapInArrow(look, "place long, sums long, tops long, tail array<long>"))
    rare = found.select("place", F.explode("tail").alias("pair")).join(counts.filter(F.col("n") < cut).hint("merge"), "pair")
    more = rare.groupBy("place").agg(F.sum("n").alias("more_sums"), F.count_if("best").alias("more_tops"))
    every = done.drop("pairs", "times").join(found.drop("tail").hint("merge"), "place").join(more.hint("merge"), "place", "left")
    total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).cast("long")
    return every.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("tops", "more_tops").alias("n_best"), total("sums", "more_sums").alias("count_sum"), "groups_sha256")
