"""Token counts of whole texts, huge ones by overlap resynchronisation.

A SentencePiece BPE model joins, again and again, the two neighbouring
symbols whose union is the best piece. Two facts about that carry the counts:

* No piece of the vocabulary goes on with a word boundary after other
  characters, and none holds a line break (both checked), so a text falls
  into units that are encoded each for itself: a run of spaces with the
  characters up to the next, or a line break. Texts of ordinary size are
  counted by units; a worker remembers the counts of units it has met.
* A sequence of symbols is the segmentation of a text if every symbol is one
  of its own text and every two neighbours are the segmentation of theirs:
  the first merge across a border would be made in the pair of neighbours
  alone too, as what happened before lies inside the symbols. So if the
  segmentations of two overlapping pieces of a text have one symbol in
  common (same start, same end), the first may be followed up to that symbol
  and the second from it on: every pair of neighbours then stands in one of
  the two.

A huge text is cut into chunks that overlap by ``OVERLAP`` bytes; chunks are
dealt out over the cluster and encoded with the byte offsets of their
symbols. Neighbouring chunks are spliced at the first symbol that both have
in the overlap; the sum over the splices gives the count. Where an overlap
has none (long runs of one character can be out of step), the text is
walked chunk by chunk, each chunk starting at a border of the one before,
with overlaps that double until its first symbol is the other's too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import CHUNK, Scratch, chunks, distinct_slices, text_bytes

HUGE = 1 << 16          # bytes above which a text is cut
PIECE = 1 << 15         # bytes from the start of a chunk to the next one's
OVERLAP = 1 << 10       # bytes that two chunks have in common
CACHE_UNITS = 400_000
CACHE_BYTES = 64        # longer units are not remembered
_WIDE = 20              # bits of a symbol's length in its key; chunks are shorter


class UnitCounter:
    """The library behind a memory of units."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer, kinds = proto.normalizer_spec, proto.trainer_spec, pb.ModelProto.SentencePiece
        normal = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a model that keeps the text as it is, with a dummy prefix, is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("a model without user-defined or unused pieces is needed")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in normal):
            raise ValueError("pieces cross word boundaries or line breaks")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.width = np.ones(len(proto.pieces), np.int64)       # bytes of text by id
        self.lead = np.ones(len(proto.pieces), bool)            # starts a symbol: not an inner byte of a character
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.width[i] = len(p.piece.replace("▁", " ").encode())
            elif p.type == kinds.BYTE:
                self.lead[i] = int(p.piece[1:-1], 16) & 0xC0 != 0x80
        self.known: dict[bytes, int] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they stand inside a longer one. The line break
        before each keeps the dummy prefix off; it is in no piece."""
        return [x[2:] for x in self.library.encode(["\n" + t for t in texts], num_threads=1)]

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(start byte, token index) of every symbol, bytes and tokens of all."""
        ids = np.array(self.ids([text])[0], np.int64)
        end = np.cumsum(self.width[ids])
        at = np.flatnonzero(self.lead[ids])
        return (end - self.width[ids])[at], at, int(end[-1]) if len(end) else 0, len(ids)

    def rows(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Token counts of the rows of a buffer (every row that is not empty
        starts with the dummy prefix as a space)."""
        if not len(b):
            return np.zeros(len(off) - 1, np.int64)
        space, line = b == 32, b == 10
        first = np.zeros(len(b), bool)
        first[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        first[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(first)
        code, units = distinct_slices(b, starts, np.append(starts[1:], len(b)))
        units = units.to_pylist()
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        fresh = [u for u in units if u not in self.known]
        sizes = dict(zip(fresh, map(len, self.ids([u.decode() for u in fresh])), strict=True))
        number = np.array([sizes[u] if u in sizes else self.known[u] for u in units], np.int64)
        self.known.update((u, n) for u, n in sizes.items() if len(u) <= CACHE_BYTES)
        total = np.concatenate([[0], np.cumsum(number[code])])
        edge = np.searchsorted(starts, off)
        return total[edge[1:]] - total[edge[:-1]]

    def walk(self, raw: bytes, piece: int, overlap: int) -> int:
        """Tokens of a whole text (dummy prefix included), one chunk after
        the other; an overlap that does not align is doubled, and a chunk
        whose overlap has reached its start grows."""
        at = total = 0
        size, lap = piece, overlap
        cur = self.symbols(_cut(raw, 0, size))
        while at + cur[2] < len(raw):
            end = at + cur[2]
            k = int(np.searchsorted(cur[0], cur[2] - lap, "right")) - 1
            if k > 0:
                begin = at + int(cur[0][k])
                after = self.symbols(_cut(raw, begin, end + piece))
                mine = np.append(cur[0], cur[2])[k + 1] - cur[0][k]
                if mine == np.append(after[0], after[2])[1]:
                    total += int(cur[1][k])
                    at, cur, size, lap = begin, after, piece, overlap
                    continue
                lap *= 2
            else:
                size, lap = 2 * size + lap, overlap
                cur = self.symbols(_cut(raw, at, at + size))
        return total + cur[3]


def _border(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a character starts."""
    at = min(at, len(raw))
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _cut(raw: bytes, begin: int, end: int) -> str:
    return raw[_border(raw, begin):_border(raw, end)].decode()


_COUNTERS: dict[str, UnitCounter] = {}


def counter(path: str) -> UnitCounter:
    """One counter for each vocabulary and worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnitCounter(path)
    return _COUNTERS[path]


def _count_rows(path: str):
    def run(batches):
        known = counter(path)
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            n = [known.rows(b[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in chunks(off, 2 * CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))],
                                             names=["row", "n_tokens"])
    return run


def _cut_rows(piece: int, overlap: int):
    """Chunks of every text, with a number for the row that is its own in
    the written table; the row itself goes with its first chunk."""
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_buffer().to_pybytes()
                n = max(1, -(-(len(raw) - overlap) // piece))
                for seq in range(n):
                    begin = _border(raw, seq * piece)
                    end = len(raw) if seq == n - 1 else _border(raw, (seq + 1) * piece + overlap)
                    row = batch.column("row").slice(i, 1) if seq == 0 else pa.nulls(1, batch.column("row").type)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid]), pa.array([seq], pa.int32()), pa.array([seq == n - 1]), pa.array([begin]), row,
                         pa.array([raw[begin:end].decode()])], names=["uid", "seq", "last", "begin", "row", "text"])
                uid += 1
    return run


def _keys(start: np.ndarray, end: int, begin: int) -> np.ndarray:
    """One number for start and length of each symbol."""
    return ((start + begin) << _WIDE) | np.diff(np.append(start, end))


def _encode_chunks(path: str, overlap: int):
    """Symbols of the overlaps at either end of every chunk."""
    def run(batches):
        known = counter(path)
        for batch in batches:
            out = []
            for begin, text in zip(batch.column("begin").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start, at, size, n = known.symbols(text)
                key = _keys(start, size, begin)
                head, tail = start < overlap + 4, start >= size - overlap - 4
                out.append((n, key[head].tolist(), at[head].tolist(), key[tail].tolist(), at[tail].tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("seq"), batch.column("last"), pa.array(cols[0], pa.int64()),
                 *[pa.array(c, lists) for c in cols[1:]]],
                names=["uid", "seq", "last", "n", "head", "head_at", "tail", "tail_at"])
    return run


def _walk_rows(path: str, piece: int, overlap: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("seq")
        raw, at = [], 0
        for begin, text in zip(parts["begin"], parts["text"], strict=True):
            b = text.encode()
            raw.append(b[at - begin:])
            at = begin + len(b)
        return pd.DataFrame({"uid": parts["uid"].iloc[:1], "walked": [counter(path).walk(b"".join(raw), piece, overlap)]})
    return run


def count_tokens(df: DataFrame, vocabulary: str, keep: list[str | Column], text: str = "text", huge: int = HUGE,
                 piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """Columns ``keep`` of ``df`` with n_bytes (UTF-8) and n_tokens, the
    number of ids that the library gives for the whole text without added
    ids. Null and empty texts have 0 of both; rows may repeat and keys may
    be null, every row is counted for itself; an empty table stays empty.
    ``overlap`` is below half of ``piece``, ``piece`` below 2^19."""
    if not 0 < 2 * overlap < piece < 1 << _WIDE - 1:
        raise ValueError("overlap must be below half of piece, and piece below 2^19")
    spark = df.sparkSession
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    given = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # a boundary mark in a text is a space to the library; the dummy prefix is a space before the text
    prefixed = F.when(given != "", F.concat(F.lit(" "), F.replace(given, F.lit("▁"), F.lit(" ")))).otherwise("")
    base = df.select(F.struct(F.struct(*cols).alias("kept"), F.octet_length(given).cast("long").alias("n_bytes")).alias("row"),
                     prefixed.alias("text"))
    long = F.octet_length("text") > huge
    row, count = StructField("row", base.schema["row"].dataType), StructField("n_tokens", LongType())
    small = base.where(~long).mapInArrow(_count_rows(vocabulary), StructType([row, count]))
    scratch = Scratch(spark)
    cut = scratch.table(base.where(long).mapInArrow(
        _cut_rows(piece, overlap), StructType.fromDDL("uid long, seq int, last boolean, begin long").add(row).add("text", "string")),
        "token-chunks")
    spread = cut.select("uid", "seq", "last", "begin", "text").repartition("uid", "seq")
    coded = scratch.table(spread.mapInArrow(
        _encode_chunks(vocabulary, overlap), "uid long, seq int, last boolean, n long, head array<long>, head_at array<long>, "
        "tail array<long>, tail_at array<long>"), "token-overlaps")
    right = coded.select("uid", (F.col("seq") - 1).alias("seq"), "head", "head_at")
    splice = (coded.where("not last").select("uid", "seq", "tail", "tail_at").join(right, ["uid", "seq"])
              .withColumn("common", F.array_min(F.array_intersect("tail", "head")))
              .select("uid", F.expr("tail_at[array_position(tail, common) - 1] - head_at[array_position(head, common) - 1]")
                      .alias("n"), F.col("common").isNull().alias("failed")))
    ends = coded.where("last").select("uid", "n", F.lit(False).alias("failed"))
    sums = scratch.table(splice.unionByName(ends).groupBy("uid").agg(F.sum("n").alias("n"), F.max("failed").alias("failed")),
                         "token-sums")
    walked = (cut.select("uid", "seq", "begin", "text").join(sums.where("failed").select("uid"), "uid")
              .groupBy("uid").applyInPandas(_walk_rows(vocabulary, piece, overlap), "uid long, walked long"))
    big = (cut.where("seq = 0").select("uid", "row").join(sums, "uid").join(walked, "uid", "left")
           .select("row", F.when(F.col("failed"), F.col("walked")).otherwise(F.col("n")).alias("n_tokens")))
    return small.unionByName(big).select("row.kept.*", "row.n_bytes", "n_tokens")
