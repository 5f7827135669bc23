"""What the operators share: sub-batches of bounded size, hashing of words, shared tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.scratch import scratch_dir

_libc = ctypes.CDLL(None)
#: Bytes of text that Python code handles at once; rows larger than that come alone.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes; at the end of a task its free memory goes back to the system, as the worker lives on."""
    try:
        for b in batches:
            step = max(1, int(b.num_rows * limit // max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(_libc, "malloc_trim"):
            _libc.malloc_trim(0)


def unused(columns: Iterable[str], prefix: str = "__") -> str:
    """A prefix that no column name starts with, for columns of an operator's own."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def bounded(df: DataFrame) -> DataFrame:
    """The rows, with the session set to send Arrow batches of SLICE_BYTES at most: texts are long, and 10,000 of them are too many for a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name).rstrip("b")) > SLICE_BYTES:
        conf.set(name, str(SLICE_BYTES))
    return df


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut and lost executors cost nothing but a reread."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift multiply), so that sums and products of hashes come out uniform."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Longest word hashed by position weights; longer ones go through xxhash one by one.
_LONG = 512
_WEIGHTS = np.cumprod(np.full(_LONG, 0x9E3779B97F4A7C15, np.uint64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, which ASCII white space separates: weighted sums of byte values, for all words at once."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of words, so that a very long text takes no more memory than a long one
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 18))))
        first, size = starts[at], ends[at:to] - starts[at:to]
        if to == at + 1 and size[0] > _LONG:
            out[at] = xxhash.xxh64_intdigest(raw[first : ends[at]])
        else:
            run = data[first : ends[to - 1]]
            place = np.arange(len(run)) - np.repeat(starts[at:to] - first, np.diff(np.append(starts[at:to], ends[to - 1])))
            weighted = np.append(_BYTES[run] * _WEIGHTS.take(place, mode="clip"), np.uint64(0))
            cuts = np.stack([starts[at:to] - first, ends[at:to] - first], axis=1).reshape(-1)
            out[at:to] = np.add.reduceat(weighted, cuts)[::2] + size.astype(np.uint64)
            for k in np.flatnonzero(size > _LONG):
                out[at + k] = xxhash.xxh64_intdigest(raw[starts[at + k] : ends[at + k]])
        at = to
    return mix(out)


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` words: base-weighted sums mod 2^64 by shift-and-add doubling, O(n log width)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mod = 1 << 64
    out, done, power, span, run = None, 0, base % mod, 1, words
    bits = width
    while bits:
        if bits & 1:  # append a run of `span` words after the `done` words that are hashed
            part = run[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, span, mod)) + part
            done += span
        bits >>= 1
        if bits:
            run = run[: len(run) - span] * np.uint64(power) + run[span:]
            power, span = power * power % mod, span * 2
    return mix(out)


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
