"""Benchmark decontamination by latent semantic retrieval.

* **Space.** Passages are runs of ``PASSAGE`` words of the corpus; terms
  are the words of the benchmark items that at most ``COMMON`` of all
  passages have, and the rarest words of every item. The SVD of the TF-IDF matrix of all
  passages is found by randomised projection in one pass: with counts T,
  IDF weights d and a random W, every task sums T'(T W); A'A W/d = d * T'T W is then known for A = T d, and the
  Nyström form of the symmetric product gives the leading right singular
  vectors. Only sums over all passages (terms x ``RANK``) reach the driver.
* **Candidates.** Windows over the whole texts, of a length near that of the
  item and a quarter of it apart (``STRIDE`` words at most; items of up to
  ``SHORT`` words have windows of just their length at every word), are
  projected if they hold enough of the items' terms, and compared with the
  items by cosine.
* **Confirmation.** The longest common subsequence of the item's words with
  the window and its surroundings must hold ``COPIED`` of the item, or
  ``RETOLD`` of it and nearly all of its answer, its last sentence.

Items travel to the tasks in blocks of ``BLOCK_ITEMS``, each a pass of its
own, so what is sent at once is bounded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import LOWER, chunks, slice_hashes, text_bytes, word_bounds

PASSAGE = 64
RANK = 64
STRIDE = 8          # words between the windows of long items
SHORT = 12          # items of so many words are looked for at every word
COSINE = 0.6
TERMS = 0.5
COPIED = 0.75
RETOLD = 0.5
ANSWER = 0.9
LEAST_WORDS = 4
COMMON = 0.005
BLOCK_ITEMS = 20_000
_BITS = 20


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, A-Z lower-cased; first word of every row)."""
    b = LOWER[b]
    starts, ends, first = word_bounds(b, off)
    return slice_hashes(b, starts, ends), first


class Items:
    """Words of the items, their answers, and the terms of all of them."""

    def __init__(self, keys: list, texts: list[str]):
        b, off = text_bytes(pa.array(texts, pa.string()))
        h, first = word_hashes(b, off)
        self.keys, self.words, self.answers = [], [], []
        for k, text, a, z in zip(keys, texts, first[:-1], first[1:], strict=True):
            if z - a < LEAST_WORDS:
                continue
            last = re.split(r"(?<=[.!?])\s+", text.strip())[-1]
            self.keys.append(k)
            self.words.append(h[a:z])
            self.answers.append(h[z - max(1, len(re.findall(r"[^\x20\x09-\x0D]+", last))):z])
        self.limit_terms(np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)])))

    def limit_terms(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.terms & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.held = [len(self.slots(w)[1]) for w in self.words]

    def choose_terms(self, df: np.ndarray, passages: int) -> None:
        """Terms become the words that ``COMMON`` of the passages have at
        most, and the rarest words of every item."""
        rare = df <= COMMON * passages
        for words in self.words:
            mine = np.searchsorted(self.terms, np.unique(words))
            rare[mine[np.argsort(df[mine], kind="stable")[:LEAST_WORDS]]] = True
        self.limit_terms(self.terms[rare])

    def slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that are terms, their terms)."""
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(self.terms):
            return at[:0], at[:0]
        s = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[s] == h[at]
        return at[ok], s[ok]


# ------------------------------------------------------------------- space

def _passages(items: Items, batches):
    """(term occurrences, their passages, passages) chunk by chunk."""
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        for i, j in chunks(off):
            h, first = word_hashes(b[off[i]:off[j]], off[i:j + 1] - off[i])
            count = -(-np.diff(first) // PASSAGE)
            at, slot = items.slots(h)
            row = np.searchsorted(first, at, "right") - 1
            yield slot, (np.cumsum(count) - count)[row] + (at - first[row]) // PASSAGE, int(count.sum())


def _frequencies(items: Items):
    """Per task: passages with each term; slot -1: passages."""
    def run(batches):
        n = len(items.terms)
        seen, passages = np.zeros(n, np.int64), 0
        for slot, passage, count in _passages(items, batches):
            passages += count
            seen += np.bincount(np.unique(passage * max(n, 1) + slot) % max(n, 1), minlength=n)[:n]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(n), -1)), pa.array(np.append(seen, passages))],
                                         names=["slot", "df"])
    return run


def _moments(items: Items, test: np.ndarray):
    """Per task: the sum over its passages of T'(T W), a row per term."""
    def run(batches):
        n, rank = test.shape
        total = np.zeros((n, rank))
        for slot, passage, _ in _passages(items, batches):
            if not len(slot):
                continue
            head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            sums = np.add.reduceat(test[slot], head, axis=0)                # T W
            index = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(slot))))
            by = np.argsort(slot, kind="stable")
            s, index = slot[by], index[by]
            head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            total[s[head]] += np.add.reduceat(sums[index], head, axis=0)    # T'(T W)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         names=["slot", "y"])
    return run


def latent_space(texts: DataFrame, items: Items, rank: int = RANK) -> np.ndarray:
    """Chooses the terms and returns, by term, what an occurrence adds to a
    text's place in the space: IDF weight times right singular vectors over
    singular values (fold-in). ``texts`` has one column, text."""
    got = dict(texts.mapInArrow(_frequencies(items), "slot long, df long").groupBy("slot")
               .agg(F.sum("df")).collect())
    passages = got.get(-1, 0)
    if not passages or not len(items.terms):
        return np.zeros((len(items.terms), rank), np.float32)
    counts = dict(zip(items.terms.tolist(), (got[i] for i in range(len(items.terms))), strict=True))
    items.choose_terms(np.array(list(counts.values())), passages)
    idf = np.log((1 + passages) / (1 + np.array([counts[t] for t in items.terms.tolist()]))) + 0.05
    test = np.random.default_rng(3).standard_normal((len(items.terms), rank)).astype(np.float32)
    rows = texts.mapInArrow(_moments(items, test), "slot long, y array<double>")
    sums = rows.groupBy("slot").agg(*[F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(rank)]).orderBy("slot")
    z = idf[:, None] * np.array([r[1:] for r in sums.collect()])     # A'A O with O = W / idf
    core = (test / idf[:, None]).T @ z                               # O'A'A O
    val, vec = np.linalg.eigh((core + core.T) / 2)
    ok = val > 1e-9 * max(val.max(), 1e-300)
    u, s, _ = np.linalg.svd(z @ (vec[:, ok] / np.sqrt(val[ok])), full_matrices=False)
    return (idf[:, None] * u / np.maximum(s, 1e-12)).astype(np.float32)


# ------------------------------------------------------------------ search

def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = place.get(x, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) - v.bit_count()


def _classes(items: Items) -> list[tuple[int, int, np.ndarray]]:
    """(window length, terms that a window must hold, items): items of
    similar length (the same up to ``SHORT`` words, else within a half) and
    number of terms (within twice)."""
    size, held = np.array([len(w) for w in items.words]), np.array(items.held)
    out, length = [], LEAST_WORDS
    while len(size) and length <= size.max():
        longer = length + 1 if length <= SHORT else length * 3 // 2
        few = 1
        while few <= max(1, held.max()):
            pick = np.flatnonzero((size >= length) & (size < longer) & (held >= few) & (held < 2 * few))
            if len(pick):
                out.append((int(np.median(size[pick])), max(1, int(TERMS * held[pick].min())), pick))
            few *= 2
        length = longer
    return out


def stride(length: int) -> int:
    """Words between the starts of windows of ``length`` words."""
    return 1 if length <= SHORT else min(STRIDE, length // 4)


def _windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the windows: every ``stride(length)`` words and
    one at the end of the text; a shorter text is one window."""
    n, step = np.diff(first), stride(length)
    steps = np.maximum(n - length, 0)
    count = np.where(n > 0, -(-steps // step) + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * step, steps[row])
    return row, first[:-1][row] + start, first[:-1][row] + np.minimum(start + length, n[row])


def _search(items: Items, space: np.ndarray):
    classes = _classes(items)
    vectors = []
    for words in items.words:
        v = space[items.slots(words)[1]].sum(axis=0)
        vectors.append(v / max(np.linalg.norm(v), 1e-12))

    def confirm(h: np.ndarray, a: int, z: int, item: int) -> tuple[float, float]:
        words = items.words[item].tolist()
        around = h[a:z].tolist()
        share = lcs(words, around) / len(words)
        answer = items.answers[item].tolist()
        return share, (lcs(answer, around) / len(answer) if share >= RETOLD else 0.0)

    def run(batches):
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            out: dict[tuple[int, int], tuple] = {}
            for i, j in chunks(off):
                h, first = word_hashes(b[off[i]:off[j]], off[i:j + 1] - off[i])
                at, slot = items.slots(h)
                known = np.zeros(len(h) + 1, np.int64)
                known[at + 1] = 1
                np.cumsum(known, out=known)
                for length, need, pick in classes:
                    row, a, z = _windows(first, length)
                    ok = known[z] - known[a] >= need
                    row, a, z = row[ok], a[ok], z[ok]
                    target = np.array([vectors[k] for k in pick], np.float32).T
                    for lo in range(0, len(row), 8192):
                        r, s, e = row[lo:lo + 8192], a[lo:lo + 8192], z[lo:lo + 8192]
                        n = known[e] - known[s]
                        head = np.cumsum(n) - n
                        v = np.add.reduceat(space[slot[np.repeat(known[s] - head, n) + np.arange(n.sum())]], head, axis=0)
                        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                        cos = v @ target
                        for w, k in zip(*np.nonzero(cos >= COSINE), strict=True):
                            item, doc = int(pick[k]), int(r[w])
                            wide = len(items.words[item]) // 2 + STRIDE
                            from_, to = max(first[doc], s[w] - wide), min(first[doc + 1], e[w] + wide)
                            share, answer = confirm(h, from_, to, item)
                            if share >= COPIED or (share >= RETOLD and answer >= ANSWER):
                                found = (share, float(cos[w, k]), answer, int(s[w] - first[doc]), int(e[w] - s[w]))
                                if found > out.get((i + doc, item), (0.0,)):
                                    out[i + doc, item] = found
            rows = pa.array([d for d, _ in out], pa.int64())
            keys = pa.array([k for _, k in out], pa.int32())
            cols = list(zip(*out.values(), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(rows), keys, pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                names=["row", "item", "lcs", "cosine", "answer", "first_word", "n_words"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item_key: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(key, item_key, lcs, cosine, answer, first_word, n_words): the best
    window of every text that leaks an item.

    Items that are null, empty or shorter than ``LEAST_WORDS`` words cannot
    be told from chance and are left out; null and empty texts leak nothing;
    items or documents that repeat give a row each; empty tables give an
    empty result."""
    spark = docs.sparkSession
    ids = F.col(f"`{item_key}`")
    items = benchmark.where(F.col(item_text).isNotNull()).select(ids.alias("k"), F.col(f"`{item_text}`").alias("t"),
                                                                F.xxhash64(ids, F.col(f"`{item_text}`")).alias("h"))
    base = docs.select(F.struct(F.col(f"`{key}`").alias("key")).alias("row"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType([base.schema["row"], StructField("item", IntegerType()), StructField("lcs", DoubleType()),
                         StructField("cosine", DoubleType()), StructField("answer", DoubleType()),
                         StructField("first_word", IntegerType()), StructField("n_words", IntegerType())])
    blocks = max(1, -(-items.count() // block_items))
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod("h", F.lit(blocks)) == block).orderBy("h").collect()
        these = Items([r["k"] for r in rows], [r["t"] for r in rows])
        space = latent_space(base.select("text"), these)
        names = spark.createDataFrame(
            list(enumerate(these.keys)), StructType([StructField("item", IntegerType()),
                                                     StructField(item_key, items.schema["k"].dataType)]))
        found = base.mapInArrow(_search(these, space), schema).join(F.broadcast(names), "item")
        parts.append(found.select(F.col("row.key").alias(key), item_key, "lcs", "cosine", "answer", "first_word", "n_words"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
