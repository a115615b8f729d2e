"""Shared pieces of the operators: shared-folder tables, Arrow buffers as numpy arrays, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers of the rolling hash and of the finaliser.
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: ASCII white space that separates words: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that one numpy step handles; bounds a worker's memory whatever the batch holds.
CHUNK = 1 << 18
#: Rows of an Arrow batch, at most, and about its bytes: the JVM holds each batch whole, outside its heap.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may have none, and gets a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def short_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands at most BATCH_ROWS rows, or about BATCH_BYTES, to Python at once: rows hold whole texts."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:  # else the user's own
        conf.set(name, str(BATCH_BYTES))
    return df


def in_steps(run):
    """run, a function on Arrow batches, with its results in batches of about BATCH_BYTES, one row at least."""

    def stepped(batches):
        for batch in run(batches):
            step = max(1, len(batch) * BATCH_BYTES // max(1, batch.nbytes))
            for i in range(0, len(batch), step):
                yield batch.slice(i, step)

    return stepped


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def pieces(off: np.ndarray, most: int | None = None):
    """Row ranges (lo, hi) of at most `most` bytes, one row at least."""
    lo, n, most = 0, len(off) - 1, most or CHUNK
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j, modulo 2**64."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    x = buf.astype(U64)
    x += U64(1)
    x *= up[: len(buf)]
    np.cumsum(x, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * MIX_A
    x ^= x >> U64(29)
    x *= MIX_B
    x ^= x >> U64(32)
    return x


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word [^ \\t-\\r]+ in rows off[i]:off[i+1] of buf; off starts at 0."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values modulo 2**64."""
    out = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=out[1:])
    return out


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """An even share of 0..n-1 by the hash's upper 32 bits."""
    return ((h >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def packed(bucket: np.ndarray, rows: np.ndarray, n: int):
    """(bucket, bytes) for the records of each bucket; rows is a structured array."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    rows = rows[order]
    for b in np.flatnonzero(edge[1:] > edge[:-1]):
        yield int(b), rows[edge[b] : edge[b + 1]].tobytes()
