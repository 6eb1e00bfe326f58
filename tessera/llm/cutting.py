"""Removal of byte ranges from documents: the last step of both substring dedup operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Stands for a null doc_id in order and joins; such rows come last and are alike.
NO_ID = (1 << 63) - 1


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, id (doc_id, NO_ID for null), rk (row key) and text of every row."""
    at = blocks.corpus(docs)
    return at.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), blocks.row_key().alias("rk"), "text")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """rows without repeats of (id, rk); texts are only shuffled if some id occurs twice."""
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows if twice.isEmpty() else rows.dropDuplicates(["id", "rk"])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal runs; ranges that touch become one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.ones(len(begin), bool)
    first[1:] = begin[1:] > end[:-1]
    last = np.concatenate((first[1:], [True]))[: len(begin)]
    return begin[first], end[last]


def cut(rows: DataFrame, least: int = 0, full: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with `full` also kept) of rows
    (doc_id, text, n_bytes, whole_sha256, copy, begins, ends).

    The ranges begins[k] to ends[k] (arrays of int, null: none) are united; runs shorter than
    `least` bytes stay. Rows without ranges need no text: they lose nothing, or all if `copy`,
    and whole_sha256 is the digest of what they keep.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * full

    def run(batches):
        for batch in batches:
            text, at = blocks.utf8(batch.column("text"))
            begins, ends = (batch.column(n) for n in ("begins", "ends"))
            where = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in begins])))
            begins, ends = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (begins, ends))
            copy, size = batch.column("copy").to_pylist(), batch.column("n_bytes").to_pylist()
            digest = batch.column("whole_sha256").to_pylist()
            removed = [n if c else 0 for n, c in zip(size, copy, strict=True)]
            spans = [int(c) for c in copy]
            kept = [b"" if c else text[a:b].tobytes() for c, a, b in zip(copy, at[:-1], at[1:], strict=True)] if full else []
            for k in np.flatnonzero(np.diff(where)).tolist():
                whole = text[at[k] : at[k + 1]]
                b, e = merged(begins[where[k] : where[k + 1]], ends[where[k] : where[k + 1]])
                b, e = b[e - b >= least], e[e - b >= least]
                edge = np.zeros(len(whole) + 1, np.int8)
                np.add.at(edge, b, 1)
                np.add.at(edge, e, -1)
                rest = whole[np.cumsum(edge[:-1]) == 0].tobytes()
                removed[k], spans[k], digest[k] = int((e - b).sum()), len(b), hashlib.sha256(rest).hexdigest()
                if full:
                    kept[k] = rest
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * full, names=names)

    wanted = rows.select("doc_id", "n_bytes", "text", "whole_sha256", "copy", "begins", "ends")
    return wanted.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full)
