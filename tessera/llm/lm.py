"""Language-model scoring with a log-frequency Bloom filter.

Word and word-pair counts of all training texts are summed in packed form: a task sends one
sorted block of 64-bit hashes and counts per bucket, so the shuffle moves no text. A bucket
quantises its counts to powers of two and enters a count of level q into its part of the filter
under the levels 1..q; the parts are broadcast together. A count is read back by probing the
levels in turn until one is missing, and stands for the middle of its level. Word pairs are
smoothed with the word's own probability (Dirichlet prior).

The filter is bounded: words and pairs are admitted from the highest count level down as far as
`filter_bits` allow at `bits_per_entry`. Those below are looked up: each block of texts asks for
the keys that the filter lacks, once each and packed by bucket, and is scored with the answers.
They stand for the middle of their level too, so the bound does not change the model.

The base score needs exact counts. Words from a count up, chosen so that at most `head_words`
reach it, are broadcast; the other words of the texts, rare by that choice, are joined with the
count table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

PROBES = 3
#: More than any count needs: level q holds the counts from 2^(q-1) up, and only levels that occur take room.
LEVELS = 48
_EDGE = np.uint64(0x5851F42D4C957F2D)  # stands before the first and after the last word
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 1_000_000
#: Rows of a block that asks for keys below the filter: 2 to this power.
_BLOCK_ROWS = 11
#: Text to a bucket of counts.
BUCKET_BYTES = 4 << 20


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    """Rows kept from counting: crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word of a chunk, and row and hash of every pair, with the edges of each text."""
    data = blocks.lower_ascii(data)
    start, end, row = blocks.words(data, at)
    word = blocks.span_hashes(data, start, end)
    n = len(at) - 1
    # each text's words followed by an edge; the pair of a token is it and the one before
    count = np.bincount(row, minlength=n)
    owner = np.repeat(np.arange(n), count + 1)
    token = np.full(len(owner), _EDGE)
    last = np.cumsum(count + 1) - 1
    inside = np.ones(len(owner), bool)
    inside[last] = False
    token[inside] = word
    before = np.empty_like(token)
    before[0:1], before[1:] = _EDGE, token[:-1]
    return row, word, owner, np.stack([before, token])


def _pairs(tokens: np.ndarray) -> np.ndarray:
    return blocks.mix(tokens[0] * _PAIR + tokens[1])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(keys: np.ndarray, counts: np.ndarray, kind: int, buckets: int):
    """(bucket, kind, keys, counts) of sorted keys; counts take one byte where they can."""
    cut = np.searchsorted(blocks.bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        k, c = keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]
        yield b, kind, k.tobytes(), c.astype(np.uint8 if c.max() < 256 else np.int64).tobytes()


def _unpacked(keys, counts) -> tuple[np.ndarray, np.ndarray]:
    k = [np.frombuffer(x.as_py(), np.uint64) for x in keys]
    c = [np.frombuffer(y := x.as_py(), np.uint8 if len(y) == len(h) else np.int64).astype(np.int64) for x, h in zip(counts, k, strict=True)]
    return (np.concatenate(k), np.concatenate(c)) if k else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, LEVELS)


_MIDDLE = np.array([0.0] + [(2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, LEVELS + 1)])


def _place(key: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    a = blocks.mix(key + np.uint64(level * 0xD1B54A32D192ED03 % 2**64))
    return (a + np.uint64(probe) * ((a >> np.uint64(21)) | np.uint64(1))) % size


def _filter(keys: np.ndarray, level: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= q]
        for p in range(PROBES):
            bits[_place(some, q, p, np.uint64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


_WORD_SALT = np.uint64(0xA0761D6478BD642F)
_COUNTED = "bucket int, distinct long, total long, entries array<long>, words binary, uses binary, keys binary, levels binary"


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: its words and their counts; keys of words and pairs with their levels, and how many filter entries the levels from each one up need."""

    def count(batches):
        held: dict[int, list] = {0: [], 1: []}

        def rows(least):
            for kind, parts in held.items():
                if sum(len(k) for k, _ in parts) > least:
                    keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                    found = list(_packed(keys, counts, kind, buckets))
                    parts.clear()
                    for at in range(0, len(found), 64):
                        some = list(zip(*found[at : at + 64], strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), pa.array(some[2], pa.binary()), pa.array(some[3], pa.binary())], names=["bucket", "kind", "keys", "counts"])

        for batch in batches:
            for _, _, data, at in blocks.chunks(batch.column("text")):
                _, _, _, tokens = _tokens(data, at)
                for kind, keys in ((0, tokens[1]), (1, _pairs(tokens))):
                    held[kind].append(_summed(keys, np.ones(len(keys), np.int64)))
                yield from rows(_FLUSH)
        yield from rows(0)

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        kinds = table["kind"].to_numpy()
        parts = [_summed(*_unpacked(table["keys"].filter(pa.array(kinds == k)), table["counts"].filter(pa.array(kinds == k)))) for k in (0, 1)]
        (words, uses), (pairs, times) = parts
        keys, level = np.concatenate([words ^ _WORD_SALT, pairs]), _level(np.concatenate([uses, times]))
        of_level = np.bincount(level, minlength=LEVELS + 1) * np.arange(LEVELS + 1)
        entries = np.cumsum(of_level[::-1])[::-1]
        row = (bucket, len(words), int(uses.sum()), entries.tolist(), words.tobytes(), uses.tobytes(), keys.tobytes(), level.astype(np.uint8).tobytes())
        kinds_of = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({f.split()[0]: pa.array([x], k) for f, k, x in zip(_COUNTED.split(", "), kinds_of, row, strict=True)})

    packed = docs.select("text").mapInArrow(count, "bucket int, kind int, keys binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(reduce, _COUNTED)


def _word_counts(counted: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column("words"), batch.column("uses"), strict=True):
                hashes, n = np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                for at in range(0, len(hashes), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["hash", "c"])

    return counted.select("words", "uses").mapInArrow(run, "hash long, c long")


def _filters(counted: DataFrame, least: int, bits_per_entry: int) -> DataFrame:
    """bucket, size, bits: of each bucket the filter of its words and pairs from level `least` up."""

    def run(batches):
        for batch in batches:
            for bucket, k, q, entries in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("levels"), batch.column("entries").to_pylist(), strict=True):
                keys, level = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint8).astype(np.int64)
                size = 64 + (entries[least] if least <= LEVELS else 0) * bits_per_entry
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([size], pa.int64()), pa.array([_filter(keys[level >= least], level[level >= least], size)], pa.binary())], names=["bucket", "size", "bits"])

    return counted.select("bucket", "keys", "levels", "entries").mapInArrow(run, "bucket int, size long, bits binary")


class Filter:
    """The broadcast filter: its parts by bucket in one array. Keys below level `least` are not in it."""

    def __init__(self, parts: dict[int, tuple[int, bytes]], buckets: int, least: int = 1):
        self.buckets, self.least = buckets, least
        self.size = np.ones(buckets, np.uint64)
        length = np.zeros(buckets, np.int64)
        for b, (size, bits) in parts.items():
            self.size[b], length[b] = size, len(bits)
        self.at = np.concatenate(([0], np.cumsum(np.maximum(length, 1))))[:-1]
        self.bits = np.zeros(int(np.maximum(length, 1).sum()), np.uint8)
        for b, (_, bits) in parts.items():
            self.bits[self.at[b] : self.at[b] + len(bits)] = np.frombuffer(bits, np.uint8)

    def levels(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Levels, found by probing them in turn; 0 for what is not in the filter."""
        level = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            for p in range(PROBES):
                b = bucket[left]
                i = _place(keys[left], q, p, self.size[b])
                left = left[(self.bits[self.at[b] + (i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
            level[left] = q
        level[level < self.least] = 0  # such a level is chance
        return level

    def counts(self, keys: np.ndarray, bucket: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Counts by level; `below` has the sorted keys and the levels of what is not in the filter."""
        level = self.levels(keys, bucket)
        if below is not None and len(below[0]):
            known, of = below
            lacking = np.flatnonzero(level == 0)
            place = np.minimum(np.searchsorted(known, keys[lacking]), len(known) - 1)
            level[lacking] = np.where(known[place] == keys[lacking], of[place], 0)
        return _MIDDLE[level]

    def words(self, hashes: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return self.counts(hashes ^ _WORD_SALT, blocks.bucket_of(hashes, self.buckets), below)

    def pairs(self, keys: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        return self.counts(keys, blocks.bucket_of(keys, self.buckets), below)

    def lacking(self, hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words and pairs those not in the filter, as keys and their buckets."""
        every = np.concatenate([hashes ^ _WORD_SALT, keys])
        bucket = blocks.bucket_of(np.concatenate([hashes, keys]), self.buckets)
        some = self.levels(every, bucket) == 0
        return every[some], bucket[some]


def _answered(texts: DataFrame, counted: DataFrame, shared, least: int) -> DataFrame:
    """block, keys, levels: for each block of (block, doc_id, text) the counted keys below `least` that its texts use, in parts."""

    def ask(batches):
        held: dict[int, list] = {}

        def rows():
            for block, parts in held.items():
                words, pairs = (np.unique(np.concatenate(p)) for p in zip(*parts, strict=True))
                keys, bucket = shared.value[0].lacking(words, pairs)
                order, slices = blocks.bucket_slices(bucket)
                found = [(b, block, keys[order[i:j]].tobytes()) for b, i, j in slices]
                for k in range(0, len(found), 64):
                    some = list(zip(*found[k : k + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int64()), pa.array(some[2], pa.binary())], names=["bucket", "block", "keys"])
            held.clear()

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if int(block[lo]) not in held:
                    yield from rows()
                for _, _, data, at in blocks.chunks(batch.column("text").slice(lo, hi - lo)):
                    _, _, _, tokens = _tokens(data, at)
                    held.setdefault(int(block[lo]), []).append((np.unique(tokens[1]), np.unique(_pairs(tokens))))
        yield from rows()

    def answer(asked: pa.Table, kept: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k.as_py(), np.uint64) for k in kept["keys"])])
        level = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(q.as_py(), np.uint8) for q in kept["levels"])])
        known, level = known[level < least], level[level < least]
        order = np.argsort(known)
        known, level = known[order], level[order]
        blocks_of, keys, levels = [], [], []
        for block, raw in zip(asked["block"].to_pylist() if len(known) else [], asked["keys"], strict=False):
            wanted = np.frombuffer(raw.as_py(), np.uint64)
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[place] == wanted
            if hit.any():
                blocks_of.append(block)
                keys.append(wanted[hit].tobytes())
                levels.append(level[place[hit]].tobytes())
        return pa.table({"block": pa.array(blocks_of, pa.int64()), "keys": pa.array(keys, pa.binary()), "levels": pa.array(levels, pa.binary())})

    asked = texts.select("block", "text").mapInArrow(ask, "bucket int, block long, keys binary")
    kept = counted.select("bucket", "keys", "levels")
    return asked.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(answer, "block long, keys binary, levels binary")


def score(docs: DataFrame, bits_per_entry: int = 8, filter_bits: int = 1 << 31, head_words: int = 400_000, prior: float = 8.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    A null or empty text has one token, its end. With no training text every count is 0; an empty
    table gives an empty one, rows that repeat are counted each. A long text is read a chunk of
    rows at a time, itself whole. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    at = blocks.corpus(docs)
    buckets = 1 + blocks.text_bytes(at) // BUCKET_BYTES
    counted = blocks.table(_counted(at.filter(~held_out()), buckets))
    table = _word_counts(counted)
    total = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), *(F.coalesce(F.sum(F.col("entries")[q]), F.lit(0)) for q in range(LEVELS + 1))).first()
    distinct, tokens, entries = int(total[0]), int(total[1]), list(total[2:])
    # beyond the last level that occurs: nothing fits, all is looked up
    least = next(q for q in range(1, LEVELS + 2) if q > LEVELS or entries[q] * bits_per_entry <= filter_bits)
    parts = {r["bucket"]: (r["size"], bytes(r["bits"])) for r in _filters(counted, least, bits_per_entry).toLocalIterator()}
    # the least power of two that at most head_words words reach
    reach = table.select(*(F.count_if(F.col("c") >= (1 << k)).alias(f"k{k}") for k in range(48))).first()
    cut = next(1 << k for k in range(48) if reach[k] <= head_words)
    head = table.filter(F.col("c") >= cut).toPandas()
    keys = head["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((Filter(parts, buckets, least), keys[order], head["c"].to_numpy(np.int64)[order]))
    del parts, head
    bottom = tokens + distinct + 1

    def run(batches, below=None):
        model, known, uses = shared.value
        for batch in batches:
            n = batch.num_rows
            n_tokens, n_known, base, full, tails = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
            for i, j, data, cut_at in blocks.chunks(batch.column("text")):
                _, _, owner, pair = _tokens(data, cut_at)
                found, back = np.unique(pair[1], return_inverse=True)
                place = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                hit = known[place] == found if len(known) else np.zeros(len(found), bool)
                logs = np.where(hit, np.log10(np.where(hit, uses[place], 0) + 1.0), 0.0) if len(known) else np.zeros(len(found))
                n_tokens[i:j] = np.bincount(owner, minlength=j - i)
                n_known[i:j] = np.bincount(owner, weights=hit[back], minlength=j - i)
                base[i:j] = np.bincount(owner, weights=logs[back], minlength=j - i)
                rare = ~hit[back]
                ends = np.searchsorted(owner[rare], np.arange(j - i + 1))
                tails.append((pair[1][rare].view(np.int64), ends))
                c = model.words(found, below)
                one = (c + 1.0) / bottom
                before = np.empty(len(back), np.int64)
                before[1:] = back[:-1]
                before[0:1] = np.searchsorted(found, _EDGE)
                two = (model.pairs(_pairs(pair), below) + prior * one[back]) / (np.maximum(c[before], 0) + prior)
                full[i:j] = np.bincount(owner, weights=np.log10(np.minimum(two, 1.0)), minlength=j - i)
            lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for v, e in tails]
            tail = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(full), tail], names=["doc_id", "n_tokens", "head_known", "head_sum", "score", "tail"])

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(answers[name].to_pylist()), kind)
        keys, first = np.unique(join("keys", np.uint64), return_index=True)
        below = keys, join("levels", np.uint8)[first].astype(np.int64)
        return pa.Table.from_batches(run(texts.select(["doc_id", "text"]).to_batches(), below))

    kinds = "doc_id long, n_tokens long, head_known long, head_sum double, score double, tail array<long>"
    if least == 1:  # the filter has every count
        scored = at.mapInArrow(run, kinds)
    else:
        texts = blocks.table(at.withColumn("block", F.shiftright(F.monotonically_increasing_id(), _BLOCK_ROWS)))
        scored = texts.groupBy("block").cogroup(_answered(texts, counted, shared, least).groupBy("block")).applyInArrow(finish, kinds)
    scored = blocks.checkpoint(scored.withColumn("place", F.monotonically_increasing_id()))
    rare = scored.select("place", F.explode("tail").alias("hash")).join(table, "hash").groupBy("place").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    both = scored.join(rare, "place", "left")
    return both.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(bottom)))).alias("base_score"),
        "score",
    )
