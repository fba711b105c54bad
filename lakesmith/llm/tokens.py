"""Token-id files with directly addressable codes.

A segment holds the ids of whole documents, one after the other. Ids are
split into 8-bit chunks by level: level 1 has the low chunk of every id,
level 2 the next chunk of those ids that need one, and so on. A bitmap per
level says whether an id goes on at the next level, and a rank directory
(ones before every 512 bits) turns a position at one level into its
position at the next, so any id is read with one byte and one rank per
level and no block is decoded.

Segment layout, little-endian: ``DAC1``, levels (u32), then for each level
the number of chunks (u64), the chunks (u8), the bitmap (u8, bits in little
order) and the directory (u32). Segments are rows of a Parquet table
(part, seq, n_tokens, the keys and local starts of their documents,
payload), in ascending key order by (part, seq).
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, distinct_slices, text_bytes, word_bounds

SEGMENT_TOKENS = 1 << 20
CACHE_WORDS = 1_200_000
_BLOCK = 512        # bits between two entries of a rank directory


# ------------------------------------------------------------------- codes

def dac_encode(ids: np.ndarray) -> bytes:
    level, cur = 0, ids.astype(np.uint32)
    body = []
    while True:
        low = (cur & np.uint32(255)).astype(np.uint8)
        rest = cur >> np.uint32(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-len(bits) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
        pad[:len(bits)] = bits
        ones = np.bitwise_count(pad.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.zeros(len(ones) + 1, np.uint32)
        np.cumsum(ones, out=ranks[1:])
        body += [struct.pack("<Q", len(low)), low.tobytes(), pad.tobytes(), ranks.tobytes()]
        level += 1
        cur = rest[more]
        if not len(cur):
            break
    out = [b"DAC1", struct.pack("<I", level), *body]
    return b"".join(out)


class DacSegment:
    """Random access to the ids of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        n_levels, = struct.unpack_from("<I", payload, 4)
        at = 8
        self.levels = []
        for _ in range(n_levels):
            n, = struct.unpack_from("<Q", payload, at)
            at += 8
            chunk = np.frombuffer(payload, np.uint8, n, at)
            at += n
            blocks = -(-(-(-n // 8)) // (_BLOCK // 8))
            bits = np.frombuffer(payload, np.uint8, blocks * (_BLOCK // 8), at)
            at += len(bits)
            ranks = np.frombuffer(payload, np.uint32, blocks + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for shift, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * shift)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // _BLOCK
            first = block * (_BLOCK // 8)
            i = (int(ranks[block]) + int(np.bitwise_count(bits[first:byte]).sum(dtype=np.int64))
                 + int(bits[byte] & (1 << bit) - 1).bit_count())
        return value

    def read(self) -> np.ndarray:
        """All ids."""
        value = None
        for chunk, bits, _ in reversed(self.levels):
            cur = chunk.astype(np.uint32)
            if value is not None:
                cur[np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)] |= value << np.uint32(8)
            value = cur
        return value


# ---------------------------------------------------------------- encoding

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?|]*)")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for a byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class WordEncoder:
    """Ids of white-space separated words, each encoded once.

    The vocabulary's pre-tokenizer never joins across ASCII white space, so
    the ids of a text are those of its words in turn. Words of letters with
    an optional tail of marks go straight to the library's model (lower
    case, byte-level characters: what its normalizer and pre-tokenizer make
    of them); all other words, those with a special token's string among
    them, take the whole library path. The store of words is emptied when
    it holds ``CACHE_WORDS``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        chars = byte_chars()
        self.table = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.n = self.used = 0

    def word(self, w: str) -> list[int]:
        m = _PLAIN.fullmatch(w)
        if m is None:
            return self.tok.encode(w, add_special_tokens=False).ids
        model = self.tok.model
        out = [t.id for t in model.tokenize(m[1].lower().translate(self.table))]
        if m[2]:
            out += [t.id for t in model.tokenize(m[2])]
        return out

    def add(self, key: bytes, ids: list[int]) -> int:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if self.n + 2 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += 1
        self.start[self.n] = self.used
        self.index[key] = self.n - 1
        return self.n - 1

    def encode(self, b: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by row), ``end_id`` after each row."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        starts, ends, first = word_bounds(b, off)
        inv, letters = distinct_slices(b, starts, ends)
        known = np.empty(len(letters), np.int64)
        get = self.index.get
        for k, key in enumerate(letters.to_pylist()):
            i = get(key)
            known[k] = self.add(key, self.word(key.decode())) if i is None else i
        w = known[inv]
        size = self.start[w + 1] - self.start[w]
        before = np.concatenate([[0], np.cumsum(size)])
        per_row = before[first[1:]] - before[first[:-1]] + 1
        total = int(before[-1])
        flat = self.ids[np.repeat(self.start[w] - before[:-1], size) + np.arange(total)]
        row_end = np.cumsum(per_row)
        out = np.empty(total + len(per_row), np.uint32)
        mask = np.ones(len(out), bool)
        mask[row_end - 1] = False
        out[mask] = flat
        out[~mask] = end_id
        return out, per_row


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _segments(path: str, end_id: int, size: int, key_type: pa.DataType):
    def run(batches):
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        seq = held = 0
        ids, keys, counts = [], [], []

        def flush():
            n = np.concatenate(counts)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(key_type)),
                pa.array([(np.cumsum(n) - n).tolist()], pa.list_(pa.int64())),
                pa.array([dac_encode(np.concatenate(ids))], pa.binary()),
            ], names=["part", "seq", "n_tokens", "keys", "starts", "payload"])

        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            key = batch.column("key")
            for i, j in chunks(off):
                x, n = enc.encode(b[off[i]:off[j]], off[i:j + 1] - off[i], end_id)
                ids.append(x)
                keys.append(key.slice(i, j - i))
                counts.append(n)
                held += len(x)
                if held >= size:
                    yield flush()
                    seq, held = seq + 1, 0
                    ids, keys, counts = [], [], []
        if counts:
            yield flush()
    return run


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id",
                      text: str = "text", parts: int | None = None, segment: int = SEGMENT_TOKENS) -> None:
    """Encode every whole text (null: empty), add ``end_id`` to each, and
    write segments in ascending key order (null keys first; rows with one
    key by a hash of their text). The key range is split by sampling, also
    inside a repeated key whose texts differ. ``segment`` ids close a
    segment; a longer document has one of its own."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    (rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
     .mapInArrow(_segments(vocabulary, end_id, segment, to_arrow_type(kind)),
                 f"part int, seq int, n_tokens long, keys array<{kind.simpleString()}>, starts array<long>, "
                 "payload binary")
     .write.parquet(path))


def _documents(batches):
    for batch in batches:
        for part, seq, n, keys, starts, payload in zip(*(batch.column(c) for c in (
                "part", "seq", "n_tokens", "keys", "starts", "payload")), strict=True):
            ids = DacSegment(payload.as_buffer().to_pybytes()).read().astype("<u4")
            at = np.frombuffer(np.ascontiguousarray(starts.values.to_numpy()), np.int64)
            size = np.diff(np.append(at, n.as_py()))
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * s:4 * (s + k)]) for s, k in zip(at.tolist(), size.tolist(), strict=True)]
            m = len(at)
            yield pa.RecordBatch.from_arrays([
                keys.values, pa.array(np.full(m, part.as_py(), np.int32)), pa.array(np.full(m, seq.as_py(), np.int32)),
                pa.array(at), pa.array(size), pa.array(crc, pa.int64())],
                names=["key", "part", "seq", "local", "n_tokens", "ids_crc32"])


def token_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, part, seq, start (ids before
    it in all files), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). Only sizes meet in the running sums: a row
    per segment of a part, then a row per part."""
    table = spark.read.parquet(path)
    kind = table.schema["keys"].dataType.elementType.simpleString()
    docs = table.mapInArrow(_documents, f"key {kind}, part int, seq int, local long, n_tokens long, ids_crc32 long")
    sizes = table.select("part", "seq", F.col("n_tokens").alias("n"))
    per_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    part_off = per_part.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("o1"))
    seq_off = sizes.select("part", "seq", F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("seq")),
                                                     F.lit(0)).alias("o2"))
    return (docs.join(seq_off.join(part_off, "part"), ["part", "seq"])
            .select(F.col("key").alias(key), "part", "seq", (F.col("o1") + F.col("o2") + F.col("local")).alias("start"),
                    "n_tokens", "ids_crc32"))


def token_at(spark: SparkSession, path: str, part: int, seq: int, i: int) -> int:
    """One id, read from its segment without decoding the others."""
    row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).select("payload").first()
    return DacSegment(bytes(row["payload"]))[i]
