"""Source divergence audit on a k2-tree of the group-term count matrix.

For every language, rows are its sources (groups), columns its kept terms,
cells the counts. The matrix is cut by hash into tiles of about ``ROWS``
groups and ``COLUMNS`` terms; one task takes the tile of a block of rows, or
those of two blocks, and builds a quadtree of each: every quadrant is one
bit, kept as a bitmap by level with ranks, and all-zero quadrants have no
children. Two trees are walked together, all pairs of rows at once, level by
level: a quadrant that is zero in both gives its number of columns to its
pairs of rows and is priced as that many times the price of two zero
counts; where one or both have counts the walk goes on, down to single
cells, which are priced by their counts. Terms stand in a tile by falling
number of groups, so that zeros come together.

All arithmetic is exact: shares are long divisions in 64-bit integers (for
groups of less than 9 * 10^15 terms) or decimals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import broadcast_if_small
from .common import CHUNK, LOWER, Scratch, chunks, distinct_slices, text_bytes, word_bounds

LEAST_DOCS = 3
TERM_RANKS = 200
ROWS = 32
COLUMNS = 400
MOST_GROUPS = 100_000      # of a table of groups that is broadcast (below 10 MB)
UNIT = 1_000_000_000
_BETWEEN = np.ones(256, bool)       # bytes between terms
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


# ------------------------------------------------------------------ counts

def _term_rows(batches):
    """Per chunk of texts: (lang, source, term, n, docs), docs the number of
    its texts in the group that hold the term."""
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
        n_sources = max(1, len(names[1].dictionary))
        for i, j in chunks(off, 8 * CHUNK):
            part, o = LOWER[b[off[i]:off[j]]], off[i:j + 1] - off[i]
            starts, ends, first = word_bounds(part, o, _BETWEEN)
            code, terms = distinct_slices(part, starts, ends)
            width = max(1, len(terms))
            row = np.repeat(np.arange(i, j), np.diff(first))
            seen, count = np.unique(row * width + code, return_counts=True)      # a text and a term
            group = (lang * n_sources + source)[seen // width]
            key, at = np.unique(group * width + seen % width, return_inverse=True)
            group = key // width
            yield pa.RecordBatch.from_arrays(
                [names[0].dictionary.take(pa.array(group // n_sources)), names[1].dictionary.take(pa.array(group % n_sources)),
                 terms.take(pa.array(key % width)).cast(pa.string()),
                 pa.array(np.bincount(at, count, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)))],
                names=["lang", "source", "term", "n", "docs"])


def term_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The nonzero cells: lang, source, term, n, and of the term in its
    language total (count) and head (true in one row of each term)."""
    raw = (docs.mapInArrow(_term_rows, "lang string, source string, term string, n long, docs long")
           .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (raw.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("d"),
                       F.sum("n").over(term).alias("total"),
                       (F.row_number().over(term.orderBy("source")) == 1).alias("head"))
            .where(F.col("d") >= least_docs).drop("d"))


# -------------------------------------------------------------------- tree

class K2Tree:
    """Quadtree of the nonzero cells (row, column) of a square of side
    ``2 ** height``: by level one bit per quadrant of every nonzero
    quadrant above, with ranks."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int):
        code = np.zeros(len(row), np.int64)
        for k in range(height):
            code |= ((row >> k & 1) << (2 * k + 1)) | ((column >> k & 1) << 2 * k)
        order = np.argsort(code)
        code, self.value = code[order], value[order]
        self.bits, self.rank = [], []
        above = np.zeros(1, np.int64)
        for k in range(height - 1, -1, -1):
            here = np.unique(code >> 2 * k)
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, here >> 2) + (here & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            above = here
        self.root = 0 if len(code) else -1

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """Nodes of a quadrant (-1: zero)."""
        at = np.maximum(node, 0) * 4 + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.rank[level][at], -1)


def share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / size), by long division."""
    rest = count + 1
    out, rest = rest // size, rest % size
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // size, rest % size
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def joint_prices(a: K2Tree, b: K2Tree, height: int, columns: int, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Summed prices (rows of a x rows of b) over ``columns`` columns;
    ``size``: total count of each row plus the number of terms."""
    n, m = len(size_a), len(size_b)
    zeros = np.zeros((n, m), np.int64)
    x, y, r, s, c = (np.array([v], np.int64) for v in (a.root, b.root, 0, 0, 0))
    side = 1 << height
    if a.root < 0 and b.root < 0:
        zeros += columns
        x, y, r, s, c = (v[:0] for v in (x, y, r, s, c))
    for level in range(height):
        side //= 2
        coarse = np.zeros((-(-n // side), -(-m // side)), np.int64)
        nxt = []
        for qa, qb, qc in np.ndindex(2, 2, 2):
            u, v = a.child(level, x, 2 * qa + qc), b.child(level, y, 2 * qb + qc)
            rr, ss, cc = r + qa * side, s + qb * side, c + qc * side
            real = (rr < n) & (ss < m) & (cc < columns)
            none = real & (u < 0) & (v < 0)
            np.add.at(coarse, (rr[none] // side, ss[none] // side), np.minimum(side, columns - cc[none]))
            some = real & ~none
            nxt.append((u[some], v[some], rr[some], ss[some], cc[some]))
        zeros += np.repeat(np.repeat(coarse, side, axis=0), side, axis=1)[:n, :m]
        x, y, r, s, c = (np.concatenate(z) for z in zip(*nxt, strict=True))
    none = np.zeros(1, np.int64)
    p = share(np.append(a.value, none)[x], size_a[r])       # -1 takes the last entry: no count
    q = share(np.append(b.value, none)[y], size_b[s])
    out = zeros * price(share(none, size_a)[:, None], share(none, size_b)[None, :])
    np.add.at(out, (r, s), price(p, q))
    return out


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of one tile for all pairs of a row of block i and one of
    block j. Rows without a term stand for the groups: their total in n,
    the number of terms of the language in v and of the tile in w."""
    lang, i, j = rows["lang"].iloc[0], rows["i"].iloc[0], rows["j"].iloc[0]
    bare = rows["term"].isna()
    groups, cells = rows[bare], rows[~bare]
    columns, terms = int(groups["w"].iloc[0]), int(groups["v"].iloc[0])
    term = pd.factorize(cells["term"])[0]
    spread = np.bincount(term, minlength=1)
    place = np.empty(len(spread), np.int64)
    place[np.argsort(-spread, kind="stable")] = np.arange(len(spread))
    trees, names, sizes = [], [], []
    height = max(1, int(max(columns, len(groups)) - 1).bit_length())
    for block in (i, j):
        own = groups[groups["rb"] == block].sort_values("source")
        mine = (cells["rb"] == block).to_numpy()
        row = pd.Index(own["source"]).get_indexer(cells["source"][mine])
        trees.append(K2Tree(row.astype(np.int64), place[term[mine]], cells["n"][mine].to_numpy(np.int64), height))
        names.append(own["source"].to_numpy())
        sizes.append(np.maximum(own["n"].to_numpy(np.int64) + terms, 1))
    out = joint_prices(*trees, height, columns, *sizes)
    return pd.DataFrame({"lang": lang, "source": np.repeat(names[0], len(names[1])), "item": np.tile(names[1], len(names[0])),
                         "value": out.ravel()})


# ------------------------------------------------------------------- audit

def pair_prices(cells: DataFrame, groups: DataFrame, langs: DataFrame, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, item (every other source of the language), value: the
    summed prices of the source's shares against the item's. ``groups``:
    lang, source, n; ``langs``: lang, groups, v."""
    shape = langs.select("lang", "v", F.expr(f"greatest(1, ceil(groups / {rows}))").alias("blocks"),
                         F.expr(f"greatest(1, ceil(v / {columns}))").alias("tiles"))
    shape = broadcast_if_small(shape, MOST_GROUPS)
    block = F.expr("pmod(xxhash64(source), blocks)").alias("rb")
    cell = cells.join(shape, "lang").select("lang", "source", "term", "n", "head", block, "blocks", F.expr(
        "pmod(xxhash64(term), tiles)").alias("cb"))
    widths = cell.where("head").groupBy("lang", "cb").agg(F.count(F.lit(1)).alias("w"))
    both = F.expr("explode(array_distinct(flatten(transform(sequence(0L, blocks - 1), "
                  "k -> array(struct(rb AS i, k AS j), struct(k AS i, rb AS j))))))").alias("t")
    cell = cell.select("lang", "cb", both, "rb", "source", "term", "n", F.lit(0).cast("long").alias("v"),
                       F.lit(0).cast("long").alias("w"))
    head = (groups.join(shape, "lang").select("lang", "source", "n", "v", block, "blocks",
                                              F.expr("explode(sequence(0L, tiles - 1))").alias("cb"))
            .join(widths, ["lang", "cb"], "left")
            .select("lang", "cb", both, "rb", "source", F.lit(None).cast("string").alias("term"), "n", "v",
                    F.coalesce("w", F.lit(0)).alias("w")))
    tiles = cell.unionByName(head).select("lang", "cb", "t.i", "t.j", "rb", "source", "term", "n", "v", "w")
    priced = tiles.groupBy("lang", "cb", "i", "j").applyInPandas(_tile, "lang string, source string, item string, value long")
    return (priced.where("source <> item").groupBy("lang", "source", "item")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")))


def term_prices(cells: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item, value: the terms that a source has more of than
    its language, by share."""
    of = "1 + (1000000000BD * cast({0} + 1 as decimal(20,0))) div cast({1} + v as decimal(20,0))"
    size = broadcast_if_small(groups.select("lang", "source", F.col("n").alias("size")), MOST_GROUPS)
    whole = broadcast_if_small(langs.select("lang", "v", F.col("n").alias("whole")), MOST_GROUPS)
    shares = cells.join(size, ["lang", "source"]).join(whole, "lang").select(
        "lang", "source", F.col("term").alias("item"), F.expr(of.format("n", "size")).alias("p"),
        F.expr(of.format("total", "whole")).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
          term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) of
    ``df`` its divergence from each other source of the language (part
    ``pair``, all) and the terms that set it apart from its language (part
    ``term``, the first ``term_ranks``). Null texts, languages and sources
    count as empty ones; a term is kept if ``least_docs`` rows of the
    language hold it (rows that repeat count each). A group without terms
    has pairs too, with value 0 if its language keeps no term. An empty
    table gives an empty one. Other columns play no part."""
    docs = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                       for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    scratch = Scratch(df.sparkSession)
    cells = scratch.table(term_cells(docs, least_docs), "divergence-cells")
    counted = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("head").cast("long")).alias("v"))
    groups = scratch.table(docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left")
                           .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")),
                           "divergence-groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    sizes = groups.select("lang", "source", "n")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = pair_prices(cells, sizes, langs).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = (term_prices(cells, sizes, langs).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
             .where(F.col("rank") <= term_ranks))
    return pairs.unionByName(terms)
