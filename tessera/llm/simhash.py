"""Near-duplicate detection with SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .components import components

SEED = 42
#: Distinct fingerprints that may meet in one bucket pairwise; larger buckets go the two-wildcard way.
PAIRWISE = 32


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, rk (row key) and fp (64 bits as a long): one row per input row, also for repeated rows.

    ASCII capitals are lowered, words are runs without ASCII white space. Texts with
    fewer than `width` words have one shingle, texts without words (and null texts) fp 0.
    """

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            for i, _, data, at in blocks.chunks(batch.column("text")):
                data = blocks.lower_ascii(data)
                start, end, row = blocks.words(data, at)
                if not len(start):
                    continue
                # words moved together with one space after each, so that a shingle is one slice
                size = end - start + 1
                to = np.concatenate(([0], np.cumsum(size)))
                keep = np.zeros(len(data) + 1, bool)
                keep[end] = True
                solid = np.zeros(len(data) + 1, np.int8)
                solid[start] = 1
                np.subtract.at(solid, end, 1)
                joined = np.full(to[-1], 32, np.uint8)
                inside = np.cumsum(solid[:-1]).astype(bool)
                spot = np.ones(to[-1], bool)
                spot[to[1:] - 1] = False
                joined[spot] = data[inside]
                text = joined.tobytes()
                # first and last word of every shingle
                count = np.bincount(row, minlength=len(at) - 1)
                first = np.concatenate(([0], np.cumsum(count)))[:-1]
                last = np.minimum(np.arange(len(start)) + width, (first + count)[row])
                whole = (np.arange(len(start)) + width <= (first + count)[row]) | (np.arange(len(start)) == first[row])
                a, b = to[:-1][whole], to[last[whole]] - 1
                h = np.array([digest(text[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
                owner = row[whole]
                rows, begin = np.unique(owner, return_index=True)
                stop = [*begin[1:].tolist(), len(owner)]
                for r, lo, hi in zip(rows.tolist(), begin.tolist(), stop, strict=True):
                    ones = np.zeros(64, np.int64)
                    for part in range(lo, hi, 1 << 16):  # long texts by parts
                        bits = np.unpackbits(h[part : min(hi, part + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        ones += bits.sum(axis=0, dtype=np.int64)
                    fp[i + r] = np.packbits(2 * ones > hi - lo, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), pa.array(fp.view(np.int64))], names=["doc_id", "rk", "fp"])

    return blocks.corpus(docs).withColumn("rk", blocks.row_key()).mapInArrow(run, "doc_id long, rk long, fp long")


def _hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _variants(distinct: DataFrame) -> DataFrame:
    """Two 32-bit segments, each with one bit masked out in 32 ways: 64 keys per fingerprint.

    Of two fingerprints within two bits, one segment differs by at most one bit, so they
    share a key of that segment. key = segment, masked position, the other 31 bits.
    """
    low = F.lit(0xFFFFFFFF)
    keys = []
    for segment, value in ((0, F.col("fp").bitwiseAND(low)), (1, F.shiftrightunsigned("fp", 32))):
        for bit in range(32):
            keys.append(F.lit((segment * 32 + bit) << 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))))
    return distinct.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of "at most `bits` differ".

    Buckets of two need no join. Buckets of up to PAIRWISE are joined with themselves and verified.
    The members of larger buckets get a key for every two masked bits of 64: sharing one proves at
    most two differing bits, so each member is linked to the least of its key and no pairs are made.
    """
    if bits != 2:
        raise ValueError("the two-segment, one-wildcard index is exact for two bits")
    variants = _variants(distinct)
    sizes = blocks.checkpoint(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    two = sizes.filter("n = 2").select("a", "b")
    # "merge" where both sides grow with the corpus: a size that is estimated too small must not be broadcast
    some = variants.join(sizes.filter(F.col("n").between(3, PAIRWISE)).select("key").hint("merge"), "key")
    pairs = some.alias("x").join(some.alias("y").hint("merge"), "key").filter("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    close = two.unionByName(pairs).filter(_hamming(F.col("a"), F.col("b")) <= bits).distinct()
    crowd = variants.join(sizes.filter(F.col("n") > PAIRWISE).select("key").hint("merge"), "key").select("fp").distinct()
    star = crowd.selectExpr("fp", "explode(sequence(0, 62)) AS i").selectExpr("fp", "i", "explode(sequence(i + 1, 63)) AS j").selectExpr("i", "j", "fp", "fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) AS rest")
    # at most 2,017 fingerprints share a key, so no key is hot
    least = star.groupBy("i", "j", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = star.join(least.hint("merge"), ["i", "j", "rest"]).filter("a < fp").select("a", F.col("fp").alias("b")).distinct()
    return close.unionByName(starred)


def _classes(docs: DataFrame, width: int, bits: int) -> tuple[DataFrame, DataFrame, int]:
    """The marked rows (doc_id, rk, fp); fp, uses and root of each fingerprint with the first row (no_id, doc_id, rk) of its class; the number of rows."""
    marked = blocks.checkpoint(fingerprints(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("first")
    # dealt out again, as the few bytes of a fingerprint become 64 variants
    distinct = blocks.checkpoint(marked.groupBy("fp").agg(first, F.count("*").alias("uses")).repartition(blocks.partitions(docs.sparkSession), "fp"))
    found = components(links(distinct.select("fp"), bits))
    named = distinct.join(found.hint("merge"), distinct.fp == found.node, "left").select("fp", "first", "uses", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members"))
    total = distinct.count()
    by_fp = blocks.keyed(named.drop("first"), roots, "root", "members", total)
    return marked, by_fp, total


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id, one row per input row.

    component_id is the smallest doc_id reachable over links between fingerprints that differ
    in at most `bits` bits; equal fingerprints (exact copies, empty texts) are linked. A null
    doc_id takes part but is nobody's smallest; a component of null ids only has a null id.
    Rows that repeat a doc_id are judged each by its text. An empty table gives an empty one;
    long texts are read a chunk at a time; only doc_id and text are read.
    """
    marked, by_fp, total = _classes(docs, width, bits)
    named = blocks.checkpoint(by_fp.select("fp", "uses", F.col("first.doc_id").alias("component_id")))
    return blocks.keyed(marked, named, "fp", "uses", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: that with the smallest doc_id.

    Rows are judged each for itself: of several with that doc_id the one with the least row key
    stays, of rows alike in doc_id and text one, of a group without ids the one with the least row key.
    An empty table gives an empty one; all columns are kept, whatever their names.
    """
    marked, by_fp, _ = _classes(docs, width, bits)
    winners = by_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("w_id"), F.col("first.rk").alias("w_rk"))
    # the key stands beside the whole row, so that no column of docs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).select("row", "id", F.xxhash64("id", "t").alias("rk"))
    if not marked.groupBy("doc_id", "rk").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["id", "rk"])
    kept = rows.join(winners.hint("merge"), (F.col("rk") == F.col("w_rk")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
