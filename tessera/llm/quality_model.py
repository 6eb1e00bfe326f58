"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are n-grams of words (one and two) and of word shapes (one to three), hashed into a
fixed number of slots. A shape keeps the order of letter cases, digits and punctuation marks
and drops repeats, with its own value for a word that repeats the one before, so that marks of
junk carry over to unseen words. A slot's value is its share of the text's n-grams, so a score
is a sparse dot product that is linear in the text.

Training takes a bounded hash sample of the labelled rows (`max_rows`), dealt to a fixed number
of shards; each runs FTRL-proximal passes over its rows and the shards' weights are averaged.
The model has `slots` numbers and is broadcast for scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

BITS = 18
SCALE = 16.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every n-gram of a chunk of texts."""
    start, end, row = blocks.words(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = blocks.span_hashes(data, start, end)
    mapped = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = mapped[1:] != mapped[:-1]
    keep[start] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shape = blocks.span_hashes(mapped[keep], place[start], place[end])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    shape[again] = np.uint64(7)
    rows, slots = [], []
    for hashes, most, salt in ((word, 2, 1), (shape, 3, 101)):
        key = hashes
        for n in range(1, most + 1):
            if n > 1:
                key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
            inside = row[: len(key)] == row[n - 1 :]
            rows.append(row[: len(key)][inside])
            slots.append((blocks.mix(key[inside] + np.uint64(salt + n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def _examples(rows: DataFrame, shards: int) -> DataFrame:
    """shard, y, slots and values of each row of (doc_id, text, y)."""

    def run(batches):
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for _, _, data, at in blocks.chunks(batch.column("text")):
                row, slot = _slots(data, at)
                order = np.argsort(row, kind="stable")
                row, slot = row[order], slot[order]
                ends = np.searchsorted(row, np.arange(len(at)))
                for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    found, count = np.unique(slot[lo:hi], return_counts=True)
                    out.append((found.astype(np.int32).tobytes(), (count * (SCALE / max(1, hi - lo))).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("y"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["shard", "y", "slots", "values"])

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"), F.col("y").cast("int").alias("y"), "text")
    return dealt.mapInArrow(run, "shard int, y int, slots binary, values binary")


def _ftrl(table: pa.Table, passes: int, alpha: float, beta: float, l1: float, l2: float) -> pa.Table:
    """Passes of FTRL-proximal over one shard's rows; one row with its weights, the bias last."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = [(np.append(np.frombuffer(s.as_py(), np.int32), size - 1), np.append(np.frombuffer(v.as_py(), np.float32), np.float32(1))) for s, v in zip(table["slots"], table["values"], strict=True)]
    y = table["y"].to_numpy()
    order = np.random.RandomState(7)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[k]) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([weights(np.arange(size)).astype(np.float32).tobytes()], pa.binary())})


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Rows kept from training: crc32 of doc_id as text; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 24_000, shards: int = 8, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1
) -> np.ndarray:
    """Weights of the slots and, last, the bias. Held-out rows and rows without a label are not used.

    Labels that repeat a doc_id count once (the least), rows that repeat it are examples each. Without
    usable labels, as with an empty table on either side, all weights are 0. Null and empty texts are
    examples without n-grams. A long text is read whole, a chunk of rows at a time; its example has
    at most one entry a slot. Only doc_id and text, and doc_id and quality, are read.
    """
    marks = labels.select("doc_id", F.col("quality").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y")).filter(~held_out())
    share = min(1.0, max_rows / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = blocks.corpus(docs).join(chosen, "doc_id")
    fitted = _examples(rows, shards).groupBy("shard").applyInArrow(lambda t: _ftrl(t, passes, alpha, beta, l1, l2), "rows long, weights binary").collect()
    total = sum(r["rows"] for r in fitted)
    if not total:
        return np.zeros((1 << BITS) + 1, np.float32)
    return sum(np.frombuffer(r["weights"], np.float32) * np.float32(r["rows"] / total) for r in fitted)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted; one row per input row.

    Null and empty texts get the bias' score; rows that repeat are scored each, a null doc_id is not
    held out, an empty table gives an empty one. Time is linear in a text's length; only doc_id
    and text are read, so other columns cannot clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, at in blocks.chunks(batch.column("text")):
                row, slot = _slots(data, at)
                total = np.bincount(row, weights=w[slot], minlength=j - i)
                count = np.bincount(row, minlength=j - i)
                out[i:j] = SCALE * total / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out + w[-1], -30, 30))))], names=["doc_id", "score"])

    scored = blocks.corpus(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
