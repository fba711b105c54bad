"""Helpers shared by the operators: shared scratch tables and vectorised
work on the UTF-8 bytes of Arrow text columns.

Text is never turned into Python strings where bytes suffice: an Arrow
string column is one byte buffer plus offsets, and word bounds, hashes of
words and of arbitrary substrings come from a few numpy passes over it.
Buffers are processed in chunks of about ``CHUNK`` bytes (whole documents,
at least one), so memory follows the longest document, not the partition.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import delete_path
from ..session import scratch_root

CHUNK = 1 << 20
BITMAP_BITS = 26        # bits of a semi-join's bitmap, as a power of two (8 MB)
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
         "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
# rows of about a MB: row groups and pages end after few of them, not after 100 at least, and are read one by one
_BULKY_JOBS = {"spark.sql.parquet.columnarReaderBatchSize": "1"}
_BULKY_FILES = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8",
                "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8", "parquet.enable.dictionary": "false"}
_M = np.uint64(0x9E3779B97F4A7C15)      # odd, so it has an inverse modulo 2^64
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)     # the first bytes of eight
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ------------------------------------------------------------------ tables

def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def lean_jobs(spark: SparkSession, bulky: bool = False) -> Iterator[None]:
    """Jobs run inside remove their shuffle files as soon as they end, not
    when the driver happens to collect its garbage, and exchange Arrow
    batches of at most 8 MB (or one row). ``bulky``: they read tables of
    bulky rows, each a batch of its own; else a task would decode up to
    4,096 rows, the whole file, at once."""
    conf = _LEAN | _BULKY_JOBS if bulky else _LEAN
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _written(df: DataFrame, path: str, reads_bulky: bool = False, bulky: bool = False) -> DataFrame:
    spark, schema = df.sparkSession, df.schema
    with lean_jobs(spark, reads_bulky):
        df.write.options(**_BULKY_FILES if bulky else {}).parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared Parquet table and read it back: cuts the
    lineage, survives a lost executor, and is read as often as needed."""
    return _written(df, scratch_path(df.sparkSession, name))


class Scratch:
    """Shared intermediate tables of one operator run, deleted when no
    later step reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str, reads_bulky: bool = False, bulky: bool = False) -> DataFrame:
        """As :func:`materialise`; the table goes by ``name`` until it is dropped.
        ``bulky``: its rows have about a MB each; ``reads_bulky``: it is made of such a table."""
        path = scratch_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return _written(df, path, reads_bulky, bulky)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names (all of them: no names). Only
        tables that nothing unwritten depends on may go."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                delete_path(self.spark, path)


def prefix_sums(counts: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of the integer
    ``key`` (0..n, one row each) in two levels: blocks of ``width`` keys,
    then the block totals. No task sees more than ``width`` rows of a block,
    and the top level has n / ``width`` rows."""
    from pyspark.sql import Window
    c = counts.withColumn("_blk", F.floor(F.col(key) / width))
    inner = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = (c.groupBy("_blk").agg(F.sum(value).alias("_t"))
            .select("_blk", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_off")))
    return (c.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
            .join(tops, "_blk").withColumn(out, (F.col("_in") + F.col("_off")).cast("long"))
            .drop("_blk", "_in", "_off"))


# --------------------------------------------------- semi-join by a bitmap

def _bit(words: list) -> list:
    """The rotations that make one number of the words of a group."""
    return [(w, 17 * k) for k, w in enumerate(words)]


def inside(often: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Whether the bitmap has the groups of these words."""
    h = np.zeros(len(words[0]), np.uint64)
    for w, by in _bit(words):
        h ^= (w << np.uint64(by)) | (w >> np.uint64(64 - by)) if by else w
    h &= np.uint64((8 * len(often)) - 1)
    return (often[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(groups: DataFrame, columns: list[str], bits: int = BITMAP_BITS) -> np.ndarray:
    """Bitmap of the groups, made by aggregates; ``2 ** bits`` bits."""
    h = F.lit(0).cast("long")
    for w, by in _bit([F.col(c) for c in columns]):
        h = h.bitwiseXOR(F.shiftleft(w, by).bitwiseOR(F.shiftrightunsigned(w, 64 - by)) if by else w)
    at = groups.select(h.bitwiseAND(F.lit((1 << bits) - 1)).alias("h"))
    # Spark's buckets have 32,768 bits and start at number 1
    rows = (at.select((F.col("h") + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect())
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        begin = (r["bucket"] - 1) * 4096
        out[begin:begin + len(part)] = part
    return out


# ------------------------------------------------------------- Arrow bytes

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, at least one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_slices(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index, distinct bytes): the distinct slices of a buffer, in the order
    of their first place, and for every slice its index among them. The
    slices ascend and do not overlap. Bytes are compared, not hashes."""
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    step = np.zeros(len(b) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    data = b[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def slice_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits (XXH3) of every slice. The slices ascend and do not overlap."""
    code, letters = distinct_slices(b, starts, ends)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in letters.to_pylist()], np.uint64)[code]


def word_keys(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of every slice, as ``slice_hashes`` but with other values and
    nothing done word by word up to 16 bytes: those are read as two numbers
    and mixed with their length; longer ones go by XXH3."""
    size = ends - starts
    padded = np.zeros(len(b) + 16, np.uint8)
    padded[:len(b)] = b
    at = np.ndarray(len(b) + 9, "<u8", padded, strides=(1,))       # the eight bytes from every place on
    low = at[starts] & _BYTES[np.minimum(size, 8)]
    high = at[starts + 8] & _BYTES[np.clip(size - 8, 0, 8)]
    out = mix(mix(low) ^ (high + size.astype(np.uint64) * _M))
    long = np.flatnonzero(size > 16)
    if len(long):
        out[long] = slice_hashes(b, starts[long], ends[long])
    return out


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 1 << 16)
            if size > 4 * CHUNK:        # one very long document: not kept
                return cls._make(size)
            cls.up, cls.down = cls._make(size + size // 8)
        return cls.up[:n + 1], cls.down[:n + 1]

    @staticmethod
    def _make(size: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for m in (_M, _MINV):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]


class Rolling:
    """Hashes of arbitrary substrings of a byte buffer: one prefix sum of
    ``table[b[i]] * m^i`` modulo 2^64, moved to the origin by the inverse
    power of the start, then mixed with the length. Such sums are equal for
    some strings of 1,024 bytes and more, made by doubling and swapping two
    letters: words, which can be that long, go by ``slice_hashes``."""

    def __init__(self, b: np.ndarray):
        up, self.down = Powers.get(len(b))
        self.c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_TABLE[b] * up[:len(b)], out=self.c[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.c[end] - self.c[start]) * self.down[start]
        return mix(raw ^ (np.asarray(end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every k-byte substring, by start."""
        n = len(self.c) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.c[k:] - self.c[:-k]) * self.down[:n])


def word_bounds(b: np.ndarray, off: np.ndarray,
                gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every row, ``[^\\x20\\x09-\\x0D]+`` or
    the runs of bytes that are no ``gap``, and
    the index of the first word of each row (rows + 1 entries)."""
    n = len(b)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~gap[b]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    before[off] = False                     # a word never crosses rows
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:] = solid[1:]
    inner = off[(off > 0) & (off < n + 1)] - 1
    after[inner[inner < n]] = False
    ends = np.flatnonzero(solid[:n] & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def map_text(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` over Arrow batches (the input has no other
    columns than those ``fn`` reads)."""
    return df.mapInArrow(fn, schema)
