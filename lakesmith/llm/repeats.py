"""Repeated byte strings across a corpus by prefix-free parsing.

A byte is removed when some ``span``-byte string that covers it also starts
anywhere else (same document included, overlaps count). Matches never cross
documents; strings are judged on the input.

* **Triggers and phrases.** A rolling hash of every ``GRAM`` bytes marks
  triggers: the trigger of a ``span``-byte window is the leftmost smallest
  gram hash inside it, so it depends on the window's content alone and no
  window is without one. The window starts between two triggers form a
  phrase, cut into cells of ``CELL`` starts at fixed distances from the
  trigger, so equal text is cut alike wherever it stands.
* **Dictionary and parse.** A cell is known by its *core* (the bytes that
  all windows of the full cell share) and its *extent* (all bytes that its
  own windows cover). Cores are counted over the corpus: a core that occurs
  once holds no repeat and goes no further, which is nearly all fresh text.
  If all cells of a core have one extent, every window in them repeats.
* **Suffixes.** What is left are the edges of repeats: cores with several
  extents. Each distinct extent (a dictionary entry with its number of
  occurrences) is taken once, whatever the number of copies; the classes of
  equal ``span``-byte suffix heads over all entries are formed by their
  fingerprints, and a class with two occurrences or more repeats.

The order of the suffixes inside the dictionary is never needed for this
result, only which of them are equal over ``span`` bytes, so classes stand
in for the ranks of a suffix array: a sorted order would have to move the
bytes of each suffix through a shuffle, a class moves eight. Fingerprints
are 64-bit (an error needs a collision).

Skew: cores, extents and classes are counted with map-side aggregation and
joined back to rows by joins that AQE can split; no group is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Rolling, chunks, materialise, mix, text_bytes

GRAM = 16
CELL = 64
_POS = np.uint64((1 << 28) - 1)
_TOP = np.uint64(2**64 - 1)


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries (van Herk)."""
    n = len(key)
    if n < width:
        return key[:0]
    blocks = -(-n // width)
    pad = np.full(blocks * width, _TOP)
    pad[:n] = key
    m = pad.reshape(blocks, width)
    pre = np.minimum.accumulate(m, axis=1).ravel()
    suf = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(suf[:last], pre[width - 1:width - 1 + last])


def cells(b: np.ndarray, off: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Cells of a chunk of documents: row, first and last window start
    (from the document's start), core hash, extent hash."""
    none = np.zeros(0, np.int64)
    gram = min(GRAM, span)
    roll = Rolling(b)
    grams = roll.grams(gram)
    width = span - gram + 1
    if len(grams) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    if len(b) > int(_POS):      # positions of one very long document need more bits than the key has
        key = mix(grams) & ~np.uint64((1 << 40) - 1) | np.arange(len(grams), dtype=np.uint64)
        pos_mask = np.uint64((1 << 40) - 1)
    else:
        key = grams & ~_POS | np.arange(len(grams), dtype=np.uint64)
        pos_mask = _POS
    trig = (sliding_min(key, width) & pos_mask).astype(np.int64)
    doc_end = np.repeat(off[1:], np.diff(off))[:len(trig)]
    p = np.flatnonzero(np.arange(len(trig)) + span <= doc_end)
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    trig = trig[p]
    cell = (trig - p) // CELL
    new = np.ones(len(p), bool)
    new[1:] = (trig[1:] != trig[:-1]) | (cell[1:] != cell[:-1]) | (p[1:] != p[:-1] + 1)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(p)) - 1
    lo, hi, t, c = p[s], p[e], trig[s], cell[s]
    core = roll(t - CELL * c, t - np.minimum(CELL * c + CELL - 1, width - 1) + span) ^ mix(c.astype(np.uint64))
    extent = roll(lo, hi + span) ^ mix((t - lo).astype(np.uint64) + np.uint64(1))
    row = np.searchsorted(off, lo, "right") - 1
    return row, lo - off[row], hi - off[row], core, extent


def _cell_rows(span: int, with_place: bool):
    def run(batches):
        for batch in batches:
            rid = np.asarray(batch.column("rid"))
            b, off = text_bytes(batch.column("text"))
            for i, j in chunks(off):
                row, lo, hi, core, extent = cells(b[off[i]:off[j]], off[i:j + 1] - off[i], span)
                cols = {"core": core.view(np.int64), "extent": extent.view(np.int64)}
                if with_place:
                    cols = {"rid": rid[i:j][row], "lo": lo, "hi": hi, **cols}
                yield pa.RecordBatch.from_pydict(cols)
    return run


def _suffix_rows(span: int):
    """Fingerprints of the windows of the given cells of each document."""
    def run(batches):
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            todo = batch.column("entries").to_pylist()
            for i, j in chunks(off):
                base = off[i]
                roll = Rolling(b[off[i]:off[j]])
                part = [(off[r] - base + x["lo"], x["hi"] - x["lo"] + 1, x["extent"], x["n"])
                        for r in range(i, j) for x in todo[r]]
                if not part:
                    continue
                start, n, extent, times = (np.array(v, np.int64) for v in zip(*part, strict=True))
                which = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = start[which] + k
                yield pa.RecordBatch.from_pydict({
                    "head": roll(at, at + span).view(np.int64), "extent": extent[which],
                    "k": k.astype(np.int32), "n": times[which]})
    return run


def _cut_rows(span: int):
    def run(batches):
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for r, runs in enumerate(spans):
                d = b[off[r]:off[r + 1]]
                lo, hi = merged(runs or [], span)
                keep, last = [], 0
                for x, y in zip(lo, hi, strict=True):
                    keep.append(d[last:x])
                    last = y
                keep.append(d[last:])
                kept = np.concatenate(keep).tobytes()
                out["n_bytes"].append(len(d))
                out["n_removed"].append(len(d) - len(kept))
                out["n_spans"].append(len(lo))
                out["kept"].append(kept)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(v) for v in out.values())],
                                             names=["row", *out])
    return run


def merged(runs: list[dict], span: int) -> tuple[list[int], list[int]]:
    """Byte ranges covered by runs of window starts; touching ones join
    (a maximal removed run)."""
    lo: list[int] = []
    hi: list[int] = []
    for x in sorted((r["lo"], r["hi"] + span) for r in runs):
        if lo and x[0] <= hi[-1]:
            hi[-1] = max(hi[-1], x[1])
        else:
            lo.append(x[0])
            hi.append(x[1])
    return lo, hi


def repeated_runs(docs: DataFrame, span: int) -> DataFrame:
    """(rid, lo, hi): runs of window starts whose ``span`` bytes occur
    elsewhere too. ``docs`` has rid (the same for identical rows only) and
    text."""
    places = docs.mapInArrow(_cell_rows(span, True), "rid long, lo long, hi long, core long, extent long")
    shared = materialise(
        docs.mapInArrow(_cell_rows(span, False), "core long, extent long")
        .groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("extent").alias("e0"), F.max("extent").alias("e1"))
        .where("n > 1").select("core", (F.col("e0") != F.col("e1")).alias("mixed")), "repeats-cores")
    hits = materialise(places.join(shared, "core").select("rid", "lo", "hi", "extent", "mixed"), "repeats-cells")
    mixed = hits.where("mixed")
    entries = materialise(mixed.groupBy("extent").agg(F.count(F.lit(1)).alias("n"),
                                                      F.min(F.struct("rid", "lo", "hi")).alias("at"))
                          .select("extent", "n", "at.rid", "at.lo", "at.hi"), "repeats-entries")
    todo = entries.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi", "extent", "n")).alias("entries"))
    suffixes = materialise(
        docs.join(todo, "rid").select("text", "entries")
        .mapInArrow(_suffix_rows(span), "head long, extent long, k int, n long"), "repeats-suffixes")
    repeated = suffixes.groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").select("head")
    windows = (suffixes.where("n = 1").join(repeated, "head").select("extent", "k").distinct()
               .join(entries.where("n = 1"), "extent")
               .select("rid", (F.col("lo") + F.col("k")).alias("lo"), (F.col("lo") + F.col("k")).alias("hi")))
    whole = (hits.where("not mixed").select("rid", "lo", "hi")
             .unionByName(mixed.join(entries.where("n > 1").select("extent"), "extent").select("rid", "lo", "hi")))
    return whole.unionByName(windows)


def remove_repeats(df: DataFrame, text: str = "text", span: int = 200) -> DataFrame:
    """Every row of ``df`` with the repeated bytes of ``text`` taken out.

    Adds n_bytes, n_removed, n_spans (maximal removed runs), kept (binary:
    the remaining bytes; a run may end inside a code point) and kept_sha256.
    Null text counts as empty; texts shorter than ``span`` keep everything;
    identical rows repeat each other, so both lose their windows; an empty
    table gives an empty one. ``text`` itself is left out, and columns of
    ``df`` with the names of results are replaced."""
    made = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    cols = [F.col(f"`{c}`") for c in df.columns if c not in made and c != text]
    base = df.select(F.struct(*cols, F.lit(0).alias("_")).alias("row"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64("row", "text"))
    spans = (repeated_runs(base.select("rid", "text"), span)
             .groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    schema = StructType([base.schema["row"], *(StructField(c, LongType()) for c in made[:3]),
                         StructField("kept", BinaryType()), StructField("kept_sha256", StringType())])
    out = base.join(spans, "rid", "left").select("row", "text", "spans").mapInArrow(_cut_rows(span), schema)
    return out.select(*[F.col(f"row.`{c}`") for c in df.columns if c not in made and c != text], *made)
