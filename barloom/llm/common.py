"""Shared pieces of the corpus operators: staging folder, Arrow access, hashing.

Texts are handled as UTF-8 bytes. A *word* is a maximal run of bytes other than
space and 0x09-0x0D, which is the same for bytes and for characters. Hashes are
64 bits wide, depend on content alone, and therefore agree between tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or the warehouse where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all stage tables that this driver has written. Results are lazy, so call it once they have been written or read."""
    while _MADE:
        _delete(spark, _MADE.pop())


class Stage:
    """Tables that cut the lineage: Parquet in the shared folder, dropped when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        _MADE.append(self.root)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` and read it again, so that nothing upstream is computed twice; with ``by``, in a folder for each value of that column."""
        path = self.path(name)
        conf, flag = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = conf.get(flag, "false")
        conf.set(flag, "true")  # what this write shuffled is not needed again
        try:
            out = df.write.option("compression", "zstd")
            (out.partitionBy(by) if by else out).parquet(path)
        finally:
            conf.set(flag, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop_part(self, frame: DataFrame, part: str) -> None:
        """Delete one folder, such as ``kind=1``, of a table written ``by`` a column; nothing may read it any more."""
        _delete(self.spark, f"{self.paths[id(frame)]}/{part}")

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                _delete(self.spark, path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns (new=old), so that extra columns cannot clash with ours."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


#: Bits of the filter that keeps rows without partners from being shuffled (4 MB).
FILTER_BITS = 1 << 25


def may_hold(rows: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id (column ``on``) is among ``ids``, and few others while ids are few against FILTER_BITS: a filter of fixed size, broadcast as 4-KB bitmaps.
    With more ids it lets more rows through and loses none."""
    at = F.pmod(F.xxhash64(on, F.lit(17)), F.lit(FILTER_BITS))
    slot, bit = F.shiftright(at, 15).cast("int"), at.bitwiseAND((1 << 15) - 1)
    bits = ids.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    near = rows.join(F.broadcast(bits), slot == F.col("__slot"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return near.filter(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1).select(*rows.columns)


def bucket_of(*cols: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


# ---- Arrow -----------------------------------------------------------------


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each value, without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from texts_of(chunk)
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = None if column.null_count == 0 else np.asarray(column.is_valid())
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid is None or valid[i] else raw[:0]


def blobs(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, type=pa.binary())


# ---- words and hashes --------------------------------------------------------

_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP, _LONG_WORD = np.uint64(0x9E3779B97F4A7C15), 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def fold(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of a hash over a sequence. Each step shifts down after it multiplies, so hashes are no polynomials and have none of their systematic collisions."""
    h = (h ^ x) * _STEP
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text."""
    edge = np.ones(len(buf) + 2, dtype=np.int8)
    edge[1:-1] = _SEP[buf]
    step = np.diff(edge)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes a step, and BLAKE2b for spans of more than 64 bytes."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    h = sizes.astype(np.uint64)
    live, k = np.flatnonzero((sizes > 0) & (sizes <= _LONG_WORD)), 0
    while len(live):
        rest = sizes[live] - k
        h[live] = fold(h[live], eights[starts[live] + k] & _LOW_BYTES[np.minimum(rest, 8)])
        live, k = live[rest > 8], k + 8
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return mix(h)


def word_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of one text."""
    return span_hashes(buf, *word_spans(buf))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values."""
    n = len(words) - width + 1
    h = np.full(max(0, n), width, dtype=np.uint64)
    for k in range(width):
        h = fold(h, words[k : k + n])
    return mix(h)


def shingle_set(buf: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a lower-cased text; one for fewer words; none for none."""
    words = word_hashes(lower(buf))
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(k, len(words))))


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


