"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix
array (prefix doubling, as deep as the longest piece). A binary search of
every piece of the vocabulary gives its range of occurrences; the ranges
become edges (start, length, piece), ordered by position in a table. The relaxation
over the edges follows the kind of model: this one is a BPE model, whose
segmentation is not a shortest path, so in every round each word joins the
two neighbouring symbols whose union is the edge with the best score
(leftmost among equals) until none is left, for all words at once. What no
edge covers falls back to bytes.

Words are independent when no piece goes on with a word boundary after
other characters (checked for the vocabulary); each worker keeps the ids of
the words that it has met, up to ``CACHE_WORDS``.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import CHUNK, chunks, distinct_slices, text_bytes

CACHE_WORDS = 200_000
BATCH_WORDS = 16_000    # words indexed by one suffix array
SLICES = 1 << 16        # values of slices that are copied at once
LONG_WORD = 64          # longer words join with a heap instead of in common rounds
_GAP = 0x110000         # stands between words; no code point
_SPACE = ord("▁")


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[start:start + size]`` of every slice, one after the other;
    places are listed for ``SLICES`` values at once (at least one slice)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], values.dtype)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICES, "right")) - 1)
        if j == i + 1:
            out[ends[i]:ends[j]] = values[start[i]:start[i] + size[i]]
        else:
            out[ends[i]:ends[j]] = values[np.repeat(start[i:j] - ends[i:j], size[i:j]) + np.arange(ends[i], ends[j])]
        i = j
    return out


class Vocabulary:
    """Pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a model that keeps the text as it is, with a dummy prefix, is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        self.ids = np.array([i for i, _, _ in normal], np.int32)
        # smaller is better: order of falling scores, equal scores share a rank
        score = np.array([s for _, _, s in normal])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        self.rank = np.full(len(proto.pieces), np.iinfo(np.int32).max, np.int32)
        self.rank[self.ids] = rank
        self.length = np.array([len(p) for _, p, _ in normal], np.int32)
        self.depth = int(self.length.max())
        self.chars = np.full((len(normal), self.depth), -1, np.int32)
        for r, (_, p, _) in enumerate(normal):
            self.chars[r, :len(p)] = [ord(c) for c in p]
        if any("▁" in p.lstrip("▁") for _, p, _ in normal):
            raise ValueError("pieces cross word boundaries")
        self.byte_ids = np.zeros(256, np.int32)
        out = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_ids[value] = i
                out[i] = bytes([value])
            elif p.type == kinds.NORMAL:
                out[i] = p.piece.replace("▁", " ").encode()
        self.out_start = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)


# ------------------------------------------------------------ suffix array

def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, sorted by their first ``depth`` characters:
    as many characters as fit are packed into the first key, then the
    compared width doubles."""
    alphabet, rank = np.unique(text, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    width = max(1, min(depth, 62 // bits))
    key = np.zeros(len(text), np.int64)
    padded = np.concatenate([rank.astype(np.int64) + 1, np.zeros(width, np.int64)])
    for i in range(width):
        key = (key << bits) | padded[i:i + len(text)]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        fresh = np.ones(len(key), np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(fresh)
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:]
        key = rank * (len(text) + 2) + ahead
        width *= 2


def occurrences(text: np.ndarray, order: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) place in the suffix array of every piece."""
    padded = np.append(text, np.full(voc.depth, -1)).astype(np.int32)
    column = np.arange(voc.depth)
    inside = column < voc.length[:, None]

    def bound(after: bool) -> np.ndarray:
        low = np.zeros(len(voc.ids), np.int64)
        high = np.full(len(voc.ids), len(order))
        todo = np.arange(len(low))
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            window = padded[order[mid][:, None] + column]
            piece = voc.chars[todo]
            other = (window != piece) & inside[todo]
            at = other.argmax(axis=1)
            rows = np.arange(len(todo))
            equal = ~other[rows, at]
            before = np.where(equal, after, window[rows, at] < piece[rows, at])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        return low

    return bound(False), bound(True)


class Edges:
    """All occurrences of pieces by position and length: the piece of a
    range of characters, or -1."""

    def __init__(self, text: np.ndarray, voc: Vocabulary):
        order = suffix_array(text, voc.depth)
        first, last = occurrences(text, order, voc)
        ends = np.concatenate([[0], np.cumsum(last - first)])
        self.width = voc.depth + 1
        self.table = np.full(len(text) * self.width, -1, np.int32)
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICES, "right")) - 1)
            n = last[i:j] - first[i:j]
            start = gather(order, first[i:j], n)
            self.table[start * self.width + np.repeat(voc.length[i:j], n)] = np.repeat(voc.ids[i:j], n)
            i = j

    def __call__(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        near = length < self.width
        return np.where(near, self.table[start.astype(np.int64) * self.width + np.where(near, length, 0)], np.int32(-1))


# -------------------------------------------------------------- relaxation

def relax(start: np.ndarray, word: np.ndarray, end: np.ndarray, find: Edges, voc: Vocabulary):
    """(starts, lengths, words) of the final symbols. ``start``: every
    character of every word, ``end``: end of the word of each."""
    none = np.iinfo(np.int32).max
    out = []

    def ranks(s, w, stop):
        """Rank of the union of each symbol with the next of its word."""
        r = np.full(len(s), none, np.int32)
        if len(s) > 1:
            pair = np.flatnonzero(w[1:] == w[:-1])
            after = np.append(s[2:], s[:1])
            union_end = np.where(np.append(w[2:] == w[1:-1], False), after, stop[1:])[pair]
            p = find(s[pair], union_end - s[pair])
            r[pair] = np.where(p >= 0, voc.rank[p], none)
        return r

    s, w, stop = start, word, end
    while len(s):
        r = ranks(s, w, stop)
        head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        best = np.minimum.reduceat(r, head)
        size = np.diff(np.append(head, len(s)))
        done = np.repeat(best == none, size)
        out.append((s[done], w[done], stop[done]))
        hit = np.flatnonzero((r == np.repeat(best, size)) & ~done)
        lead = hit[np.append(True, w[hit][1:] != w[hit][:-1])] if len(hit) else hit     # leftmost of the best
        keep = ~done
        keep[lead + 1] = False
        s, w, stop = s[keep], w[keep], stop[keep]
    s, w, stop = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (start, word, end)
    by = np.argsort(s, kind="stable")
    s, w, stop = s[by], w[by], stop[by]
    nxt = np.append(s[1:], s[:1])
    last = np.append(w[1:] != w[:-1], True)
    return s, np.where(last, stop, nxt) - s, w


def relax_long(start: int, end: int, find: Edges, voc: Vocabulary) -> list[tuple[int, int]]:
    """The same for one long word, with a heap."""
    nxt = list(range(1, end - start + 1))
    prev = list(range(-1, end - start - 1))
    size = [1] * (end - start)
    heap: list[tuple[int, int, int, int]] = []

    at = np.arange(start, end - 1)
    p = find(at, np.full(len(at), 2))
    heap = [(int(voc.rank[x]), i, 1, 1) for i, x in enumerate(p.tolist()) if x >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = i + a
        if size[i] != a or j >= end - start or size[j] != b or nxt[i] != j:
            continue
        size[i], size[j] = a + b, 0
        nxt[i] = nxt[j]
        if nxt[i] < end - start:
            prev[nxt[i]] = i
        for k in (prev[i], i):
            if k >= 0 and nxt[k] < end - start:
                q = int(find(np.array([start + k]), np.array([size[k] + size[nxt[k]]]))[0])
                if q >= 0:
                    heapq.heappush(heap, (int(voc.rank[q]), k, size[k], size[nxt[k]]))
    return [(start + i, n) for i, n in enumerate(size) if n]


def segment(words: list[str], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and the number of ids of each
    (a word has its boundary marks as spaces)."""
    marked = [w.replace(" ", "▁") for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.int32)
    kind = np.int32 if len(flat) + len(words) < 1 << 31 else np.int64
    text = np.full(len(flat) + len(words), _GAP, np.int32)
    begin = (np.cumsum(size + 1) - size - 1).astype(kind)
    size = size.astype(kind)
    word = np.repeat(np.arange(len(words), dtype=kind), size)
    place = np.arange(len(flat), dtype=kind) + word
    text[place] = flat
    find = Edges(text, voc)
    short = size <= LONG_WORD
    pick = short[word]
    s, n, w = relax(place[pick], word[pick], (begin + size)[word[pick]], find, voc)
    for i in np.flatnonzero(~short).tolist():
        got = np.array(relax_long(int(begin[i]), int(begin[i] + size[i]), find, voc), np.int64)
        s, n, w = np.append(s, got[:, 0]), np.append(n, got[:, 1]), np.append(w, np.full(len(got), i))
    by = np.argsort(s, kind="stable")
    s, n, w = s[by], n[by], w[by]
    piece = find(s, n)
    counts = np.bincount(w, minlength=len(words))
    unknown = np.flatnonzero(piece < 0)
    if len(unknown):
        raw = [voc.byte_ids[list(chr(text[k]).encode("utf-8", "surrogatepass"))] for k in s[unknown].tolist()]
        size = np.ones(len(piece), np.int64)
        size[unknown] = [len(x) for x in raw]
        known = np.repeat(piece >= 0, size)
        out = np.empty(len(known), np.int32)
        out[known], out[~known] = piece[piece >= 0], np.concatenate(raw)
        piece, counts = out, np.bincount(w, size, minlength=len(words)).astype(np.int64)
    return piece.astype(np.int32), counts


# ----------------------------------------------------------------- batches

def _plain_marks(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundary marks that a text holds itself as the spaces they mean."""
    if len(b) < 3:
        return b, off
    at = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x96) & (b[2:] == 0x81))
    if not len(at):
        return b, off
    keep = np.ones(len(b), bool)
    keep[at + 1] = keep[at + 2] = False
    b = b.copy()
    b[at] = 32
    return b[keep], np.concatenate([[0], np.cumsum(keep)])[off]


class PieceEncoder:
    def __init__(self, path: str):
        self.voc = Vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by row)."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        b, off = _plain_marks(b, off)
        # a space before every text that is not empty: the dummy prefix
        full = np.diff(off) > 0
        o = off + np.append(0, np.cumsum(full))
        text = np.full(o[-1], 32, np.uint8)
        own = np.ones(len(text), bool)
        own[o[:-1][full]] = False
        text[own] = b
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(full), np.int64)
        space, line = text == 32, text == 10
        first = np.zeros(len(text), bool)
        first[o[:-1][full]] = True
        first[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(text))
        inv, letters = distinct_slices(text, starts, ends)
        keys = letters.to_pylist()
        fresh = [k for k, key in enumerate(keys) if key not in self.index]
        if fresh:
            words = [keys[k].decode() for k in fresh]
            got = [segment(words[i:i + BATCH_WORDS], self.voc) for i in range(0, len(words), BATCH_WORDS)]
            base = len(self.start) - 1
            self.index.update((keys[k], base + i) for i, k in enumerate(fresh))
            self.start = np.append(self.start, self.start[-1] + np.cumsum(np.concatenate([n for _, n in got])))
            self.flat = np.concatenate([self.flat, *[x for x, _ in got]])
        known = np.array([self.index[k] for k in keys], np.int64)[inv]
        size = self.start[known + 1] - self.start[known]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = gather(self.flat, self.start[known], size)
        edge = np.searchsorted(starts, o)
        return ids, before[edge[1:]] - before[edge[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the rows' ids and their offsets: pieces one after
        the other, boundary marks as spaces, without the dummy prefix."""
        v = self.voc
        size = v.out_start[ids + 1] - v.out_start[ids]
        before = np.concatenate([[0], np.cumsum(size)])
        raw = gather(v.out_bytes, v.out_start[ids], size)
        off = before[np.concatenate([[0], np.cumsum(counts)])]
        lead = off[:-1]
        spaced = counts > 0
        spaced[spaced] = raw[lead[spaced]] == 32
        keep = np.ones(len(raw), bool)
        keep[lead[spaced]] = False
        return raw[keep], off - np.append(0, np.cumsum(spaced))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _encode_rows(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            for i, j in chunks(off, 2 * CHUNK):
                part, o = b[off[i]:off[j]], off[i:j + 1] - off[i]
                ids, n = enc.encode(part, o)
                back, bo = enc.decode(ids, n)
                same = [np.array_equal(back[bo[r]:bo[r + 1]], part[o[r]:o[r + 1]]) for r in range(j - i)]
                place = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(place, pa.array(ids)), pa.array(same, pa.bool_())],
                    names=["row", "n_ids", "ids", "round_trip"])
    return run


def encode(df: DataFrame, vocabulary: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` with ids, n_ids and round_trip (the ids
    decode to the very text). Null and empty texts have no ids and a true
    round trip; a text is never cut; an empty table stays empty."""
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType([base.schema["row"], StructField("n_ids", LongType()),
                         StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    return base.mapInArrow(_encode_rows(vocabulary), schema).select("row.*", "n_ids", "ids", "round_trip")


def _decode_rows(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            col = batch.column("ids")
            col = col.fill_null([]) if col.null_count else col
            flat = np.asarray(col.flatten()).astype(np.int64)
            raw, off = enc.decode(flat, np.diff(np.asarray(col.offsets)))
            texts = [raw[off[r]:off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(len(col))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])
    return run


def decode(df: DataFrame, vocabulary: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``df`` with the text of ``ids`` (null: empty;
    bytes that are no UTF-8 become U+FFFD)."""
    from pyspark.sql.types import StringType
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    schema = StructType([base.schema["row"], StructField("text", StringType())])
    return base.mapInArrow(_decode_rows(vocabulary), schema).select("row.*", "text")
