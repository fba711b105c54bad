"""Phrase collocations by set-oriented relational mining.

The occurrence relation of the frequent words is persisted, sorted by piece
and position: a place is a running number that skips one between two
pieces, so adjacent places are adjacent words of one piece. From one length
to the next, the persisted relation of frequent phrases (sorted starts) is
merge-joined with the word relation on the place right after the phrase,
the groups are counted, and the occurrences of frequent groups alone (a
semi-join) are persisted for the next length, together with the words that
they can still be joined with.

Relations are stored in blocks of whole texts, one row of arrays each, so a
merge join never leaves its block and only group counts are shuffled. A
word is known by 64 bits of its language and letters; two words that share
them are found on the whole word table and told apart by numbers of their
own. The semi-join goes through a bitmap of ``2 ** BITMAP_BITS`` bits, whatever
the number of frequent groups: it lets all of them pass, and what else
passes is counted at the next length and dropped there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import broadcast_if_small
from .common import BITMAP_BITS, CHUNK, LOWER, Scratch, bitmap, chunks, distinct_slices, inside, text_bytes, word_bounds

LEAST = 30              # occurrences of a candidate
LONGEST = 4             # words of a candidate
INSIDE = 80             # percent of a phrase's occurrences in a longer one that drop it
RANKS = 2000
FACTOR = 2_000_000
MOST_SHARED = 100_000   # words with shared bits that are told apart
SMALL = 500_000         # rows of a word table that is broadcast
PARTS = 32              # in which the phrases of a language are ranked first
_HARD = np.zeros(256, bool)         # bytes between pieces
_HARD[[ord(c) for c in ".,;:!?"]] = True
_HARD[0x0A:0x0E] = True
_BETWEEN = _HARD.copy()
_BETWEEN[[0x20, 0x09]] = True


# --------------------------------------------------------- word occurrences

class Names:
    """Words of a batch's languages and their 64 bits."""

    def __init__(self, lang: pa.Array, shared: dict[bytes, int]):
        coded = lang.dictionary_encode()
        self.code, self.names, self.shared = coded.indices.to_numpy().astype(np.int64), coded.dictionary, shared
        self.lead = [n.encode() + b" " for n in coded.dictionary.to_pylist()]

    def words(self, b: np.ndarray, off: np.ndarray, i: int):
        """Of the texts from row ``i`` on: 64 bits, language and letters of
        each distinct word, and the word and place of every occurrence."""
        b = LOWER[b]
        starts, ends, first = word_bounds(b, off, _BETWEEN)
        code, letters = distinct_slices(b, starts, ends)
        row = np.repeat(np.arange(i, i + len(off) - 1), np.diff(first))
        width = max(1, len(letters))
        key, code = np.unique(self.code[row] * width + code, return_inverse=True)
        of, letters = key // width, letters.take(pa.array(key % width))
        full = [self.lead[k] + w for k, w in zip(of.tolist(), letters.to_pylist(), strict=True)]
        bits = [self.shared.get(w) or xxhash.xxh3_64_intdigest(w) for w in full] if self.shared else [
            xxhash.xxh3_64_intdigest(w) for w in full]
        hard = np.concatenate([[0], np.cumsum(_HARD[b])])
        broken = np.ones(len(starts), bool)
        broken[1:] = (hard[starts[1:]] != hard[ends[:-1]]) | (row[1:] != row[:-1])
        return np.array(bits, np.uint64), of, letters, code, np.arange(len(code)) + np.cumsum(broken)


def _word_rows(batches):
    """(word, lang, letters, n) of every block."""
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        names = Names(batch.column("lang"), {})
        for i, j in chunks(off, 2 * CHUNK):
            bits, of, letters, code, _ = names.words(b[off[i]:off[j]], off[i:j + 1] - off[i], i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits.view(np.int64)), names.names.take(pa.array(of)), letters.cast(pa.string()),
                 pa.array(np.bincount(code, minlength=len(bits)))], names=["word", "lang", "phrase", "n"])


def _word_relation(shared: dict[bytes, int], often: np.ndarray):
    """Blocks of the occurrence relation of the words in the bitmap."""
    def run(batches):
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            names = Names(batch.column("lang"), shared)
            for i, j in chunks(off):
                bits, _, _, code, place = names.words(b[off[i]:off[j]], off[i:j + 1] - off[i], i)
                use = inside(often, [bits])
                at = np.flatnonzero(use[code])
                new = np.cumsum(use) - 1
                yield _block(bits[use], new[code[at]], place[at], at[:0])
    return run


# ------------------------------------------------------------ the relations

RELATION = "words binary, code binary, step binary, start binary"


def _packed(x: np.ndarray) -> bytes:
    """The numbers (none below 0) in the fewest bytes each, and behind them that number of bytes."""
    kind = np.min_scalar_type(x.max(initial=0))
    return x.astype(kind).tobytes() + bytes([kind.itemsize])


def _unpacked(b: pa.Buffer) -> np.ndarray:
    b = np.frombuffer(b, np.uint8)
    return b[:-1].view(f"u{b[-1]}").astype(np.int64)


def _block(words: np.ndarray, code: np.ndarray, place: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """One row: distinct words; of the word relation, sorted by place, the
    word and the step from the place before; of the phrase relation, sorted,
    the step from the word row before where a phrase starts (empty for
    single words, which start everywhere). Packed, so that no engine has to
    walk a million numbers of a row one by one."""
    return pa.RecordBatch.from_arrays(
        [pa.array([x], pa.binary()) for x in (words.tobytes(), _packed(code), _packed(np.diff(place, prepend=0)),
                                              _packed(np.diff(start, prepend=0)))], names=["words", "code", "step", "start"])


def _blocks(batch: pa.RecordBatch, length: int):
    for r in range(batch.num_rows):
        words, code, step, start = (batch.column(c)[r].as_buffer() for c in ("words", "code", "step", "start"))
        code = _unpacked(code)
        yield (np.frombuffer(words, np.uint64), code, np.cumsum(_unpacked(step)),
               np.arange(len(code)) if length == 1 else np.cumsum(_unpacked(start)))


def extended(place: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of phrases of ``length`` words with the words right after
    them: (start, row of the next word)."""
    want = place[start] + length
    at = np.searchsorted(place, want)
    hit = at < len(place)
    hit[hit] = place[at[hit]] == want[hit]
    return start[hit], at[hit]


def _members(code: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Words of the phrases: their places follow one another, and so do the
    rows of their words."""
    return [code[start + k] for k in range(length)]


def _group_rows(length: int):
    """(w1, ..., n): counted groups of ``length + 1`` words of every block."""
    def run(batches):
        for batch in batches:
            for words, code, place, start in _blocks(batch, length):
                begin, _ = extended(place, start, length)
                members = _members(code, begin, length + 1)
                width, key = max(1, len(words)), np.zeros(len(begin), np.int64)
                for m in members:
                    if width ** len(members) >= 1 << 62:        # numbers of prefixes keep the key in 64 bits
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * width + m
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(words[m[at]].view(np.int64)) for m in members], pa.array(n)],
                    names=[f"w{k + 1}" for k in range(length + 1)] + ["n"])
    return run


def _next_relation(length: int, longest: int, often: np.ndarray):
    """Phrases of ``length + 1`` words in the bitmap, with the word rows
    that phrases of up to ``longest`` words can still use."""
    def run(batches):
        for batch in batches:
            for words, code, place, start in _blocks(batch, length):
                begin, _ = extended(place, start, length)
                begin = begin[inside(often, [words[m] for m in _members(code, begin, length + 1)])]
                keep = np.zeros(len(code) + longest, bool)
                for k in range(longest):
                    keep[begin + k] = True      # rows past a gap are kept in vain; places tell
                rows = np.flatnonzero(keep[:len(code)])
                used, new = np.unique(code[rows], return_inverse=True)
                if len(begin):
                    yield _block(words[used], new, place[rows], np.searchsorted(rows, begin))
    return run


# ------------------------------------------------------------------- mining

def _shared_bits(words: DataFrame) -> dict[bytes, int]:
    """Words that have their 64 bits in common with another one, and the
    numbers that stand for them."""
    twice = words.groupBy("word").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("word")
    rows = words.join(twice, "word").select("lang", "phrase").limit(MOST_SHARED + 1).collect()
    if len(rows) > MOST_SHARED:
        raise ValueError("too many words share their 64 bits")
    names = sorted(f"{r['lang']} {r['phrase']}".encode() for r in rows)
    return {name: k + 1 for k, name in enumerate(names)}


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST,
                     bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases: lang, words, phrase, f; totals: lang, n). ``docs``: text,
    lang without nulls. Phrases of 1 to ``longest`` words with ``f`` of at
    least ``least``, each as an array of words and joined by spaces."""
    words = scratch.table(docs.mapInArrow(_word_rows, "word long, lang string, phrase string, n long")
                          .groupBy("word", "lang", "phrase").agg(F.sum("n").alias("n")), "phrase-words")
    shared = _shared_bits(words)
    if shared:
        other = docs.sparkSession.createDataFrame(
            [(k, *name.decode().rsplit(" ", 1)) for name, k in shared.items()], "other long, lang string, phrase string")
        words = words.join(F.broadcast(other), ["lang", "phrase"], "left").withColumn("word", F.coalesce("other", "word"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    single = scratch.table(words.where(F.col("n") >= least).select("word", "lang", "phrase", F.col("n").alias("f")), "phrase-1")
    relation = scratch.table(docs.mapInArrow(_word_relation(shared, bitmap(single, ["word"], bits)), RELATION), "relation-1", bulky=True)
    phrases = single.select("lang", F.array("phrase").alias("words"), "phrase", "f")
    known = broadcast_if_small(single.select("word", "lang", "phrase"), SMALL)
    for length in range(1, longest):
        keys = [f"w{k + 1}" for k in range(length + 1)]
        found = scratch.table(
            relation.mapInArrow(_group_rows(length), ", ".join(f"{k} long" for k in [*keys, "n"]))
            .groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"phrase-{length + 1}", reads_bulky=True)
        if length + 1 < longest:
            relation = scratch.table(relation.mapInArrow(
                _next_relation(length, longest, bitmap(found, keys, bits)), RELATION),
                f"relation-{length + 1}", reads_bulky=True, bulky=True)
            scratch.drop(f"relation-{length}")
        named = found
        for k in keys:
            named = named.join(known.select(F.col("word").alias(k), F.col("lang").alias(f"lang_{k}"),
                                            F.col("phrase").alias(f"is_{k}")), k)
        named = named.select(F.col("lang_w1").alias("lang"), F.array(*[f"is_{k}" for k in keys]).alias("words"), "f")
        phrases = phrases.unionByName(named.withColumn("phrase", F.array_join("words", " ")))
    phrases = scratch.table(phrases, "phrases")
    totals = scratch.table(totals, "phrase-totals")
    scratch.drop(*[f"phrase-{k + 1}" for k in range(longest)], f"relation-{longest - 1}", "phrase-words")
    return phrases, totals


def scored(phrases: DataFrame, factor: int = FACTOR, inside_percent: int = INSIDE) -> DataFrame:
    """Candidates that are not dropped: lang, phrase, a, l, r, score of
    their lowest cut (the first of equals). Decimals, so exact."""
    longer = phrases.where(F.size("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"))
    f = phrases.select("lang", "phrase", "f")
    cut = longer.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("tail"))
    cut = (cut.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
           .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    score = F.expr(f"(cast(a as decimal(20,0)) * {factor}BD) div (cast(l as decimal(20,0)) + r)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    part = longer.select("lang", "a", "words", F.explode(F.expr(
        "flatten(transform(sequence(2, greatest(size(words) - 1, 2)), m -> transform(sequence(1, greatest(size(words) - m, 0) + 1), "
        "s -> if(m < size(words), array_join(slice(words, s, m), ' '), null))))")).alias("phrase")).where("phrase is not null")
    cover = part.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    kept = best.join(cover, ["lang", "phrase"], "left").where(F.expr(
        f"cover is null or cast(cover as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside_percent}"))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(df: DataFrame, text: str = "text", lang: str | Column = "lang", least: int = LEAST, longest: int = LONGEST,
                 ranks: int = RANKS, bits: int = BITMAP_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``ranks`` phrases of
    each language. Null texts count as empty, null languages as ``und``;
    rows that repeat count each; texts without words add nothing, and a
    language without candidates has no rows. Very long texts are blocks of
    their own. Other columns play no part; an empty table gives an empty
    one."""
    of = F.col(f"`{lang}`") if isinstance(lang, str) else lang
    docs = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                     F.coalesce(of.cast("string"), F.lit("und")).alias("lang"))
    scratch = Scratch(df.sparkSession)
    phrases, totals = frequent_phrases(docs, scratch, least, longest, bits)
    order = [F.desc("score"), F.desc("a"), "phrase"]

    def first(rows: DataFrame, *of: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("rank") <= ranks)
    # a language of any size is ranked in parts, whose first rows alone meet
    parts = first(scored(phrases).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part")
    top = first(parts.drop("part", "rank"), "lang")
    return (top.join(broadcast_if_small(totals, SMALL), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
