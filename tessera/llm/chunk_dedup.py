"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts every text where five of its bits are zero,
about every 32 bytes, so an insertion moves no cut further than 16 bytes from it. Chunks are
deduplicated by 128-bit digest: the first document (by doc_id, then place) keeps a chunk, other
occurrences are marked, and runs of marked chunks of `least` bytes or more are removed.

Digests travel packed, one sorted block per task and bucket. Of a digest's occurrences in a
block only the first takes part in the comparison; the others are marked at once and ride along
under random buckets, so that neither a popular chunk nor a group of copies fills a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, cutting

WINDOW = 16
#: Text whose digests are combined before they are sent.
BLOCK_BYTES = 4 << 20
#: Marked chunks that ride together under one random bucket.
PIECE = 512
#: Text to a bucket of digests.
BUCKET_BYTES = 8 << 20
_GEAR = np.random.RandomState(64).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: np.ndarray, at: np.ndarray, bits: int = 5, longest: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every chunk of the texts data[at[k]:at[k + 1]]."""
    n = len(at) - 1
    size = np.diff(at)
    place = np.arange(len(data)) + np.repeat(np.arange(n) * WINDOW, size)
    h = np.zeros(len(data) + n * WINDOW, np.uint32)  # gaps of zeros: no text's hash sees the text before
    h[place] = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[k:] = h[:-k]
        h = h + (older << np.uint32(k))
    natural = ((h[place] >> np.uint32(WINDOW - bits)) & np.uint32((1 << bits) - 1)) == 0
    stop = natural.copy()
    stop[at[1:][size > 0] - 1] = True
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(at, end - 1, "right") - 1
    start = np.concatenate(([0], end[:-1])) if len(end) else end
    gap = end - start
    if (gap > longest).any():  # long stretches without a cut, such as one byte over and over
        parts = (gap + longest - 1) // longest
        index = np.repeat(np.arange(len(end)), parts)
        within = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end, row = start[index] + within * longest, np.minimum(start[index] + (within + 1) * longest, end[index]), row[index]
    return start, end, row


_PACKED = "bucket int, n int, keys binary, more binary, ids binary, rks binary, starts binary, sizes binary"


def _mapper(buckets: int):
    def run(batches):
        digest = xxhash.xxh3_128_digest
        salt = 0
        for batch in batches:
            ids, rks = batch.column("id").to_numpy(), batch.column("rk").to_numpy()
            for i, _, data, at in blocks.chunks(batch.column("text"), BLOCK_BYTES):
                start, end, row = cuts(data, at)
                if not len(start):
                    continue
                raw = data.tobytes()
                key, more = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64).reshape(-1, 2).T.copy()
                owner, rk, begin, size = ids[i + row], rks[i + row], (start - at[row]).astype(np.uint32), (end - start).astype(np.uint16)
                order = np.lexsort((begin, rk, owner, more, key))
                first = np.ones(len(order), bool)
                first[1:] = (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])
                for chosen, spread in ((order[first], blocks.bucket_of(key[order[first]], buckets)), (order[~first], None)):
                    if spread is None:  # marked at once: pieces under random buckets
                        salt = (salt * 31 + int(key[0] % np.uint64(65521)) + 7) % buckets
                        spread = (buckets + (salt + np.arange(len(chosen)) // PIECE) % buckets).astype(np.int32)
                    edges = np.flatnonzero(np.diff(spread, prepend=-1, append=1 << 30))
                    rows = []
                    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        k = chosen[lo:hi]
                        rows.append((int(spread[lo]), hi - lo, *((key[k].tobytes(), more[k].tobytes()) if spread[lo] < buckets else (b"", b"")), blocks.narrow(owner[k]), rk[k].tobytes(), begin[k].tobytes(), size[k].tobytes()))
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=[f.split()[0] for f in _PACKED.split(", ")])

    return run


def _marked(buckets: int):
    def reduce(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]])
        owner = np.concatenate([blocks.wide(x.as_py(), k) for x, k in zip(table["ids"], n, strict=True)])
        rk, begin, size = join("rks", np.int64), join("starts", np.uint32), join("sizes", np.uint16)
        if table["bucket"][0].as_py() < buckets:
            key, more = join("keys", np.uint64), join("more", np.uint64)
            order = np.lexsort((begin, rk, owner, more, key))
            again = np.zeros(len(order), bool)
            again[1:] = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
            some = order[again]
            owner, rk, begin, size = owner[some], rk[some], begin[some], size[some]
        return pa.table({"id": pa.array(owner), "rk": pa.array(rk), "at": pa.array(begin.astype(np.int32)), "size": pa.array(size.astype(np.int32))})

    return reduce


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """id, rk, at, size of every chunk of (id, rk, text) that an earlier document or place has."""
    buckets = 1 + blocks.text_bytes(rows) // BUCKET_BYTES
    packed = rows.select("id", "rk", "text").mapInArrow(_mapper(buckets), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_marked(buckets), "id long, rk long, at int, size int")


def dedup(docs: DataFrame, least: int = 100, full: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with `full` also kept, the bytes), one row per input row.

    Null and empty texts have no chunks, an empty table gives an empty one, a very long text is one
    row of a task like any other. Only doc_id and text are read, so other columns cannot clash. Rows alike in doc_id and text are answered alike: both
    are measured against other documents, not against each other.
    """
    rows = cutting.numbered(docs)
    marks = repeated_chunks(cutting.distinct_rows(rows))
    ranges = marks.groupBy("id", "rk").agg(F.collect_list("at").alias("begins"), F.collect_list(F.col("at") + F.col("size")).alias("ends"))
    whole = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "whole_sha256": F.sha2("text", 256), "copy": F.lit(False)})
    both = whole.join(ranges, ["id", "rk"], "left")
    if not full:
        both = both.withColumn("text", F.when(F.col("begins").isNotNull(), F.col("text")))  # only these reach Python
    return cutting.cut(both, least, full)
