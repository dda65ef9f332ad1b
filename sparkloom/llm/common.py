"""Helpers shared by the training-data operators: tables, scratch tables, and byte-level text arrays.

Text reaches Python tasks as Arrow arrays. The helpers below view a whole batch as one ``uint8`` buffer with
document offsets, so that words and hashes are found with a few array operations instead of a loop per row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Odd multiplier of the polynomial word hash (2**64 divided by the golden ratio).
BASE = U64(0x9E3779B97F4A7C15)
#: Bytes of text that one array step handles at a time; a longer document is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, read by Spark only (the path may be any Hadoop URI)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and
    everything runs in one process. A cluster without a shared folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sparkloom_scratch", None) or "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark._sparkloom_scratch = base
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if path.getName().startswith("sparkloom-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made under :func:`scratch` that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(doc_id: str, buckets: int) -> "F.Column":
    """CRC-32 of the id's decimal text modulo ``buckets``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(buckets)


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary()) if not pa.types.is_large_binary(arr.type) else arr
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def steps(lengths: np.ndarray, limit: int = STEP_BYTES) -> Iterator[slice]:
    """Consecutive row ranges of at most ``limit`` bytes each (one row may exceed it)."""
    at = 0
    while at < len(lengths):
        total = np.cumsum(lengths[at : at + 65536])
        n = max(1, int(np.searchsorted(total, limit, "right")))
        yield slice(at, at + n)
        at += n


def batches(it: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with the bytes and offsets of ``column``."""
    for batch in it:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(column))
        for part in steps(np.diff(offs), limit):
            piece = batch.slice(part.start, part.stop - part.start)
            yield (piece, *buffers(piece.column(column)))


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """``BASE**0 … BASE**(n-1)`` modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1024)
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.r_[U64(1), np.full(size - 1, BASE)])
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z made lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Not part of a word when punctuation separates words too: ASCII other than letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(128) if not chr(c).isalnum()]] = True


#: Bytes from which on a word is hashed by XXH3: sums of powers modulo 2**64 are equal for some regular long words.
LONG_WORD = 256


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE, fold: np.ndarray = LOWER, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(start, end, document, hash) of each maximal run of bytes outside ``sep``; words never cross documents.

    With ``stems``, also, for each of these lengths, the hash of each word's first bytes (0 for shorter words).
    """
    empty = np.zeros(0, np.int64)
    none = (empty, empty, empty, np.zeros(0, U64)) + tuple(np.zeros(0, U64) for _ in stems)
    if not len(data):
        return none
    inside = ~sep[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    begin[first] = inside[first]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    head = np.flatnonzero(begin[at])
    start = at[head]
    length = np.diff(np.r_[head, len(at)])
    within = np.arange(len(at)) - np.repeat(head, length)
    value = (fold[data[at]].astype(U64) + U64(1)) * powers(int(length.max()))[within]
    h = mix(np.add.reduceat(value, head))
    for i in np.flatnonzero(length >= LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(fold[data[start[i] : start[i] + length[i]]].tobytes())
    doc = np.searchsorted(offs, start, "right") - 1
    out = [start, start + length, doc, h]
    for k in stems:
        stem = mix(np.add.reduceat(np.where(within < k, value, U64(0)), head) + U64(0x5BD1E995 + k))
        out.append(np.where(length >= k, stem, U64(0)))
    return tuple(out)


def arrow_map(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` of a function on (iterator of batches) -> iterator of batches."""
    return df.mapInArrow(fn, schema)


#: A prime, and the base and letter values of range hashes modulo that prime (any base and values do).
P61 = (1 << 61) - 1
BASE61 = 0x1B873593CC9E2D51 % P61
LETTER61 = np.array([xxhash.xxh3_64_intdigest(bytes([b])) % P61 for b in range(256)], U64)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    low, half = U64((1 << 31) - 1), U64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return _fold61((a1 * b1 << U64(1)) + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << half) + a0 * b0)


def _fold61(x: np.ndarray) -> np.ndarray:
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def _powers61(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = mul61(out[:m], np.full(m, pow(base, k, P61), U64))
        k += m
    return out


def range_hashes61(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(start, end) -> hash of the byte ranges: a polynomial over the field of 2**61 - 1 elements."""
    n = len(data)
    value = mul61(LETTER61[data], _powers61(BASE61, n)[:n])
    low, high = np.cumsum(value & U64(0xFFFFFFFF), dtype=U64), np.cumsum(value >> U64(32), dtype=U64)
    prefix = np.zeros(n + 1, U64)
    prefix[1:] = _fold61(_fold61(low) + mul61(_fold61(high), np.full(n, 1 << 32, U64)))
    down = _powers61(pow(BASE61, -1, P61), n + 1)

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mul61(_fold61(prefix[end] + U64(P61) - prefix[start]), down[start])

    return of
