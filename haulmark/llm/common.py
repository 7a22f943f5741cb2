"""Helpers that the operators share: table access, the shared folder, and hashing of symbol sequences with numpy."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    now = spark.sparkContext.getCheckpointDir()
    if now is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        now = tempfile.mkdtemp(prefix="haulmark-")
        spark.sparkContext.setCheckpointDir(now)
    return now


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and cuts the lineage.

    What led here isn't needed any more, but Spark removes its shuffle files only when the driver's garbage is collected, which on a large heap is
    seldom: loops that checkpoint each round would fill the executors' disks. So garbage is collected here.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """A Parquet table in the shared folder, reread: like checkpoint(), but columnar and compressed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, summed by one column scan; sizes groups and partitions."""
    return int(df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One symbol for each byte value.
BYTE_SYMBOLS = mix64(np.arange(1, 257, dtype=U64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 modulo 2^64, and those of its inverse."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 17)
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:end] that depends on the symbols alone, for each span."""
    return mix64((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(symbols)
    return mix64((sums[k:] - sums[:-k]) * powers(n)[1])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in buf; texts lie at offsets[i]:offsets[i+1] and no word crosses from one to the next."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(space[buf], out=inside[:n])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[(offsets < n)]
    starts[at] = inside[at]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    at = offsets[(offsets > 0)]
    ends[at] = inside[at - 1]
    return np.flatnonzero(starts[:n]), np.flatnonzero(ends)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray = BYTE_SYMBOLS, block: int = 1 << 16) -> np.ndarray:
    """A hash of each word; the buffer goes block by block so that the arrays stay in cache."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + block, side="right")))
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = span_hashes(prefix_sums(symbols[buf[a : int(ends[j - 1])]]), s, e)
        i = j
    return out


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without copies per row: (bytes, offsets). Null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def row_pieces(batches, column: str = "text", most: int = 2 << 20):
    """Slices of Arrow batches that hold about most bytes of a text column each, so that numpy's arrays beside them stay small."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def text_pieces(batches, column: str = "text", most: int = 2 << 20):
    for piece in row_pieces(batches, column, most):
        yield text_buffer(piece.column(column))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... start+length-1 of each span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
