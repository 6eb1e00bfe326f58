"""Small helpers shared by the text operators: Arrow access, word positions, packed shuffles.

Text columns reach Python as Arrow batches. The helpers read the UTF-8 buffers in
place with NumPy, a few megabytes at a time, so a task's memory does not depend on
the size of its partition.
"""

from __future__ import annotations

import gc
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: One odd 64-bit number per byte value, drawn once from a fixed seed.
_BYTE_KEY = np.random.RandomState(20).randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def partitions(spark: SparkSession) -> int:
    """Shuffle width of the session; the number of packed buckets follows it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Unset, a folder is made in local mode (tests), where all share one machine; else it is an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a null column of the type where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def corpus(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty): all that most operators read, so other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def row_key() -> Column:
    """With doc_id, names a row by its content; rows alike in both have the same results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word (run of bytes that are no ASCII white space)."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a row's end also ends a word
    prior = np.empty_like(solid)
    prior[0], prior[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~prior | edge[:-1]))
    follow = np.empty_like(solid)
    follow[-1], follow[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~follow | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _BASE_INVERSE):
            out = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 2**64))
                filled *= 2
            both.append(out)
        _powers[size] = tuple(both)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span, from one running sum over the bytes."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEY[data] * up[: len(data)], out=total[1:])
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def bucket_slices(bucket: np.ndarray):
    """Order of the rows by bucket, and (bucket, begin, end) of every bucket in that order."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit keys; uses the high half, so sorting by key inside a bucket stays free."""
    return (((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


_made: list[str] = []


def _place(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables made so far; for use when the results that read them have been written."""
    jvm = spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back; compact where checkpoint() is not."""
    path = _place(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As table(), bucketed by key, so that a later join on key does not shuffle df again.

    Only the catalog knows of buckets, so the files are named there until the table is read; then the name is dropped.
    """
    spark = df.sparkSession
    path = _place(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffles of jobs that are over; Spark deletes them once the driver's garbage is collected, whenever that happens."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_from(total: int, least: int) -> int:
    """From how many entries a key counts as hot: at most 2^24 keys of `total` entries can have so many, so their list is bounded."""
    return max(least, total >> 24)


def text_bytes(rows: DataFrame) -> int:
    """Bytes of all texts, from which the numbers of packed buckets follow."""
    return rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def keyed(left: DataFrame, right: DataFrame, key: str, uses: str, total: int, least: int = 10_000) -> DataFrame:
    """left joined with the row of right that has its key.

    right has each key once, and in column `uses` the number of left's `total` rows with it. Keys with
    a large share of the rows (at most 2^16 can have it) are broadcast, so that none of them gathers
    in one task; all others are joined by sorted shuffle, whatever size is estimated.
    """
    line = max(least, total >> 16)
    hot = F.broadcast(right.filter(F.col(uses) >= line).drop(uses))
    rest = right.filter(F.col(uses) < line).drop(uses).hint("merge")
    return left.join(hot, key).unionByName(left.join(rest, key))


def narrow(ids: np.ndarray) -> bytes:
    """64-bit ids in four bytes each where all fit."""
    return ids.astype(np.uint32).tobytes() if len(ids) and ids.min() >= 0 and ids.max() < 1 << 32 else ids.astype(np.int64).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    """The n ids of narrow()."""
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * n and n else np.int64).astype(np.int64)
