"""Near-duplicate documents by an LSH forest over MinHash signatures.

* A document's set holds the hashes of its distinct ``SHINGLE``-word
  shingles. Documents with equal sets are one class, known by two sums over
  the set and represented by the smallest id; a class of any size is one
  aggregate.
* The signature of a class has ``HASHES`` MinHash values. Each tree of the
  forest sorts all classes by the signature in an order of its own. Sorted
  neighbours have the longest common prefix of any, so each class is a
  candidate with its next ``REACH`` neighbours if they share at least one
  value: dense regions are told apart at a greater depth, sparse ones at a
  smaller, and no region makes more pairs than it has members. The sort is
  a range partition of (tree, key, id), so a region of any size is split;
  pairs across partition borders are made from the border rows.
* Candidates whose full signatures agree too little for the threshold are
  dropped (at least ``MIN_AGREE`` of 64 values: six standard deviations
  below 0.75), the others are confirmed on full sets: first one link for
  each class, then every pair that still lies in two components (pairs
  inside a component cannot change it), joined by pairs of a class with the
  hubs of its neighbours' families, until no link is new.
* What the forest misses is found exactly (``missed_pairs``): shingles have
  one total order, those common in a sample last. Two sets that reach the
  threshold share a shingle among the first ones of both, so pairs of two
  components that do are confirmed on full sets. The sample decides on the
  cost of the order alone, any order gives all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Scratch, bitmap, chunks, inside, mix, text_bytes, word_bounds, word_keys
from .components import components

SHINGLE = 5
PERCENT = 75
HASHES = 64
TREES = 16
DEPTH = 12          # values of a tree's key
REACH = 2
MIN_AGREE = 27
SAMPLE = 16         # one class of so many tells which shingles are common
COMMON = 1 << 18    # shingles at most that are put last
BIN_BITS = 9        # ranges of hashes that a set is counted in, as a power of two
_RNG = np.random.default_rng(99)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(b: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first one of each row, rows + 1 entries): the sorted distinct
    shingle hashes of every row: A-Z lower-cased, words
    ``[^\\x20\\x09-\\x0D]+``; with fewer than ``k`` words the whole sequence
    is one shingle, without words the set is empty."""
    b = LOWER[b]
    starts, ends, first = word_bounds(b, off)
    w = word_keys(b, starts, ends)
    n = np.diff(first)
    full = max(len(w) - k + 1, 0)
    h = np.zeros(full, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i:i + full])
    size = np.where(n < k, np.minimum(n, 1), n - k + 1)
    place = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(place[-1], np.uint64)
    for s, m, i, j in zip(first[:-1].tolist(), n.tolist(), place[:-1].tolist(), place[1:].tolist(), strict=True):
        if m >= k:
            out[i:j] = h[s:s + j - i]
            out[i:j].sort()
        elif m:
            x = np.uint64(m)
            for v in w[s:s + m]:
                x = mix(np.array([x ^ v], np.uint64))[0] + np.uint64(1)
            out[i] = x
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[place[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[place]


def signatures(flat: np.ndarray, place: np.ndarray) -> list[bytes | None]:
    """``HASHES`` MinHash values of every set, 16 bits each; null: empty."""
    some = np.diff(place) > 0
    head = place[:-1][some]
    low = np.empty((len(head), HASHES), np.uint64)
    if len(head):
        x = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _A[k], out=x)
            x += _B[k]
            low[:, k] = np.minimum.reduceat(x, head)
    data, step = (low >> np.uint64(20)).astype(">u2").tobytes(), 2 * HASHES
    at = (step * (np.cumsum(some) - 1)).tolist()
    return [data[i:i + step] if s else None for i, s in zip(at, some.tolist(), strict=True)]


def _sums(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sums of every set, modulo 2^64."""
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (c[place[1:]] - c[place[:-1]]).view(np.int64)


def _set_rows(batches):
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        n, f1, f2, sig = [], [], [], []
        with np.errstate(over="ignore"):
            for i, j in chunks(off):
                flat, place = shingle_sets(b[off[i]:off[j]], off[i:j + 1] - off[i])
                n.append(np.diff(place))
                f1.append(_sums(mix(flat), place))
                f2.append(_sums(mix(flat ^ np.uint64(0x5BD1E995)), place))
                sig += signatures(flat, place)
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(np.concatenate([*x, none])) for x in (n, f1, f2)], pa.array(sig, pa.binary())],
            names=["id", "n", "f1", "f2", "sig"])


def _full_sets(batches):
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        with np.errstate(over="ignore"):
            for i, j in chunks(off):
                flat, place = shingle_sets(b[off[i]:off[j]], off[i:j + 1] - off[i])
                sets.append(flat)
                sizes.append(np.diff(place))
        place = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        flat = np.concatenate(sets).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(place, pa.array(flat))],
                                         names=["id", "members"])


def _prefix(x: bytes, y: bytes) -> int:
    """Common leading 16-bit values."""
    n = 0
    while n < len(x) and x[n:n + 2] == y[n:n + 2]:
        n += 2
    return n // 2


def _neighbours(reach: int):
    """Pairs of sorted neighbours; the first and last rows of the
    partition once more, with their keys, for the pairs across borders."""
    def run(batches):
        head, tail = [], []
        for batch in batches:
            rows = list(zip(batch.column("tree").to_pylist(), batch.column("key").to_pylist(),
                            batch.column("id").to_pylist(), batch.column("n").to_pylist(), strict=True))
            if len(head) < reach:
                head += rows[:reach - len(head)]
            seq = tail + rows
            a, b = [], []
            for d in range(1, reach + 1):
                for i in range(max(len(tail), d), len(seq)):
                    x, y = seq[i - d], seq[i]
                    if x[0] == y[0] and x[1][:2] == y[1][:2] and 100 * min(x[3], y[3]) >= PERCENT * max(x[3], y[3]):
                        a.append(min(x[2], y[2]))
                        b.append(max(x[2], y[2]))
            tail = seq[-reach:]
            yield _pairs(a, b)
        edge = list(dict.fromkeys(head + tail))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(edge), pa.int64()), pa.array([r[2] for r in edge], pa.int64()),
             pa.array([r[0] for r in edge], pa.int32()), pa.array([r[1] for r in edge], pa.binary())],
            names=["a", "b", "tree", "key"])
    return run


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int32()),
                                       pa.nulls(len(a), pa.binary())], names=["a", "b", "tree", "key"])


def candidate_pairs(classes: DataFrame, scratch: Scratch, trees: int = TREES, depth: int = DEPTH,
                    reach: int = REACH) -> DataFrame:
    """Distinct pairs (a, b), a < b, of sorted neighbours in some tree whose
    sizes allow the threshold. ``classes``: id, n, sig."""
    step = 2 * (HASHES // trees)
    rows = classes.select("id", "n", F.expr(
        f"posexplode(transform(sequence(0, {trees - 1}), "
        f"t -> substring(concat(sig, sig), t * {step} + 1, {2 * depth})))").alias("tree", "key"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.table(
        rows.repartitionByRange(parts, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
        .mapInArrow(_neighbours(reach), "a long, b long, tree int, key binary"), "forest-neighbours")
    # a few border rows per partition, in the order of the forest
    w = Window.orderBy("tree", "key", "b")
    edge = found.where("tree is not null").select("tree", "key", "b").distinct()
    across = [edge.select(F.lag("b", d).over(w).alias("x"), F.col("b").alias("y"), "tree", "key",
                          F.lag("tree", d).over(w).alias("t"), F.lag("key", d).over(w).alias("k"))
              .where((F.col("tree") == F.col("t")) & F.expr("substring(key, 1, 2) = substring(k, 1, 2)"))
              .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")) for d in range(1, reach + 1)]
    pairs = found.where("tree is null").select("a", "b")
    for more in across:
        pairs = pairs.unionByName(more)
    return pairs.where("a < b").distinct()


def _agreement(batches):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
        same = (x == y).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same.astype(np.int32))],
                                         names=["a", "b", "agree"])


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def full_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, members) of the given ids. ``texts``: id, text."""
    return texts.join(ids, "id").select("id", "text").mapInArrow(_full_sets, "id long, members array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >=
    ``percent`` * union."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
            .select("a", "b", (F.size("ma") + F.size("mb")).alias("both"),
                    F.size(F.array_intersect("ma", "mb")).alias("inter")))
    return both.where(100 * F.col("inter") >= percent * (F.col("both") - F.col("inter"))).select("a", "b")


def _bin_rows(batches):
    """(id, bins): how many of a set's hashes fall into each of
    ``2 ** BIN_BITS`` ranges; null for sets too large to count so."""
    for batch in batches:
        off = batch.column("members").offsets.to_numpy()
        flat = batch.column("members").values.to_numpy().view(np.uint64)
        bins = []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            n = np.bincount((flat[i:j] >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
            bins.append(n.astype(np.uint16).tobytes() if n.max() < 1 << 16 else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bins, pa.binary())], names=["id", "bins"])


def _possible(percent: int):
    """Pairs whose sets may reach the threshold: the intersection is at most
    the sum over the bins of the smaller count."""
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True)):
                if x is not None and y is not None:
                    x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                    both, most = int(x.sum(dtype=np.int64) + y.sum(dtype=np.int64)), int(np.minimum(x, y).sum(dtype=np.int64))
                    keep[k] = 100 * most >= percent * (both - most)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def possible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that a bound on the intersection, from counts by
    range of hashes, does not rule out (none that reaches the threshold is)."""
    bins = sets.select("id", "members").mapInArrow(_bin_rows, "id long, bins binary")
    both = (pairs.select("a", "b").join(bins.select(F.col("id").alias("a"), F.col("bins").alias("ba")), "a")
            .join(bins.select(F.col("id").alias("b"), F.col("bins").alias("bb")), "b"))
    return both.select("a", "b", "ba", "bb").mapInArrow(_possible(percent), "a long, b long")


def likely(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the threshold (exact) and whose signatures
    agree in ``MIN_AGREE`` values or more."""
    return (pairs.join(sig.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
            .where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
            .select("a", "b", "sa", "sb").mapInArrow(_agreement, "a long, b long, agree int")
            .where(F.col("agree") >= MIN_AGREE))


def crossing(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs that lie in two components, with those (null: alone)."""
    return (pairs.join(group.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(group.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")))


def hub_pairs(pairs: DataFrame, links: DataFrame, group: DataFrame) -> DataFrame:
    """In a large family the neighbours of a copy are other copies, farther
    from it than the text they all come from. So a class that is a
    neighbour of some member is a candidate with the family's smallest
    member and with the one that has most links."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    hubs = (group.join(degree, "id").groupBy("component")
            .agg(F.max(F.struct("d", (-F.col("id")).alias("m"))).alias("top"))
            .select(F.col("component").alias("c"), F.array_distinct(F.array("component", -F.col("top.m"))).alias("hubs")))
    out = crossing(pairs, group)
    sides = (out.where("cb is not null").select(F.col("a").alias("x"), F.col("cb").alias("c"))
             .unionByName(out.where("ca is not null").select(F.col("b").alias("x"), F.col("ca").alias("c"))).distinct())
    return (sides.join(hubs, "c").select("x", F.explode("hubs").alias("h"))
            .select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b")).where("a < b").distinct())


def _every_shingle(batches):
    for batch in _full_sets(batches):
        yield pa.RecordBatch.from_arrays([batch.column("members").flatten()], names=["h"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that three sampled texts or more
    have, the ``COMMON`` most frequent ones. ``texts``: id, text."""
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "text")
    got = (some.mapInArrow(_every_shingle, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 2")
           .orderBy(F.desc("d"), "h").limit(COMMON).toArrow())
    h, d = got.column("h").to_numpy().view(np.uint64), got.column("d").to_numpy()
    by = np.argsort(h)
    return h[by], d[by]


def _least_shared(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of these sizes share at the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _first_shingles(common: np.ndarray, count: np.ndarray, percent: int, often: np.ndarray | None = None):
    """The shingles of a set, in the order of all, that may be the first one
    it shares with a set at the threshold; ``short``: with one no smaller.
    With a bitmap, only those that it has; without one, only their hashes,
    components and ``short``."""
    names = ["h", "c", "short"] if often is None else ["h", "id", "c", "n", "rest", "short"]
    maybe = np.zeros(1 << 20, bool)
    maybe[(common >> np.uint64(44)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            table = batch.select(["id", "text"])
            for sets in _full_sets([table]):
                flat = sets.column("members").values.to_numpy().view(np.uint64)
                off = sets.column("members").offsets.to_numpy()
                rank = np.zeros(len(flat), np.int64)
                if len(common):
                    some = np.flatnonzero(maybe[(flat >> np.uint64(44)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(common, flat[some]), len(common) - 1)
                    rank[some] = np.where(common[at] == flat[some], count[at], 0)
                n = np.diff(off).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                # hashes ascend in every set and few are common, so the rows are nearly in order
                by = np.argsort(row * (int(count.max(initial=0)) + 1) + rank, kind="stable")
                place = np.arange(len(flat)) - off[:-1][row]
                left = n[row] - place           # shingles from here on
                use = left >= -(-percent * n[row] // 100)
                if often is not None:
                    use[use] = inside(often, [flat[by][use]])
                short = left >= _least_shared(n[row], n[row], percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[by][use].view(np.int64)), batch.column("id").take(pa.array(row[use])),
                     batch.column("c").take(pa.array(row[use])), pa.array(n[row][use]), pa.array(left[use]),
                     pa.array(short[use])], names=["h", "id", "c", "n", "rest", "short"]).select(names)
    return run


def missed_pairs(classes: DataFrame, texts: DataFrame, group: DataFrame, scratch: Scratch | None = None,
                 percent: int = PERCENT) -> DataFrame:
    """All pairs (a, b) of classes in two components that can reach the
    threshold: at the first shingle that both have, each must have as many
    left as they must share. A first pass over hashes and components alone
    finds the shingles of two components, a second one sends the rows of
    those (a bitmap keeps most others back); the shorter set of a pair is
    looked for among its fewer ``short`` shingles only."""
    scratch = scratch or Scratch(classes.sparkSession)
    of = (classes.select("id").distinct().join(group, "id", "left")
          .select("id", F.coalesce("component", "id").alias("c")))
    base = texts.join(of, "id").select("id", "c", "text")
    common, count = common_shingles(base)
    rows = base.mapInArrow(_first_shingles(common, count, percent), "h long, c long, short boolean")
    shared = scratch.table(rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("short").alias("s"))
                           .where("lo < hi and s").select("h"), "near-shared")
    rows = base.mapInArrow(_first_shingles(common, count, percent, bitmap(shared, ["h"])),
                           "h long, id long, c long, n long, rest long, short boolean")
    rows = scratch.table(rows.join(shared, "h", "left_semi").distinct(), "near-first-shingles")
    x = rows.where("short").select("h", *[F.col(c).alias(f"{c}x") for c in ("id", "c", "n", "rest")])
    y = rows.select("h", *[F.col(c).alias(f"{c}y") for c in ("id", "c", "n", "rest")])
    need = f"ceil({percent} * (nx + ny) / {100 + percent}.0)"
    return (x.join(y, "h").where("cx <> cy and (nx < ny or (nx = ny and idx < idy))")
            .where(f"100 * nx >= {percent} * ny and restx >= {need} and resty >= {need}")
            .select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``df``.

    component_id is the smallest key that the row reaches over links,
    itself included; kept says that it is the row's own key. Rows without
    words (null and empty texts too) have no shingles and no links. Rows
    with a null key cannot stand for a group: they get the component of
    their set, or null, and are kept only if it is null. Rows that repeat a
    key share its links. An empty table gives an empty one."""
    ids = F.col(f"`{key}`").cast("long").alias("id")
    docs = df.select(ids, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    scratch, done = Scratch(df.sparkSession), Scratch(df.sparkSession)      # done: what the result is read from
    sets = done.table(docs.mapInArrow(_set_rows, "id long, n long, f1 long, f2 long, sig binary"), "near-signatures")
    found = sets.where("n > 0 and id is not null")
    rep = done.table(found.groupBy("n", "f1", "f2").agg(F.min("id").alias("id")), "near-classes")
    classes = scratch.table(found.join(rep, ["id", "n", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1"])
                            .select("id", "n", "sig"), "near-forest")
    sig = classes.select("id", "n", "sig")
    pairs = scratch.table(candidate_pairs(sig, scratch), "near-pairs")
    scratch.drop("forest-neighbours")
    scored = scratch.table(likely(pairs, sig), "near-candidates")
    # one likely link for each class first: to the smallest of its closest neighbours
    ends = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    first = (ends.groupBy("a").agg(F.max(F.struct(F.least("agree", F.lit(54)).alias("g"), (-F.col("b")).alias("m")))
                                   .alias("best"))
             .select(F.least("a", -F.col("best.m")).alias("x"), F.greatest("a", -F.col("best.m")).alias("y"))
             .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    first = scratch.table(first, "near-first")
    full = scratch.table(full_sets(ends_of(scored), docs), "near-sets")     # the texts are shuffled once for all likely pairs
    links = scratch.table(confirmed(first, full).distinct(), "near-links")
    todo, seen = scored.select("a", "b"), first
    group, turn = scratch.table(components(links), "near-groups-0"), 0
    while True:
        todo = todo.unionByName(likely(hub_pairs(pairs, links, group), sig).select("a", "b")).distinct()
        todo = scratch.table(crossing(todo.join(seen, ["a", "b"], "left_anti"), group).select("a", "b"), "near-rest")
        fresh = scratch.table(ends_of(todo).join(full.select("id"), "id", "left_anti"), "near-fresh")
        if not fresh.isEmpty():
            full = full.unionByName(scratch.table(full_sets(fresh, docs), "near-sets"))
        scratch.drop("near-fresh")
        more = scratch.table(confirmed(todo, full).distinct(), "near-links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        stars = group.select(F.col("id").alias("a"), F.col("component").alias("b"))     # what the older links came to
        turn += 1
        group = scratch.table(components(stars.unionByName(more)), f"near-groups-{turn}")
        scratch.drop(f"near-groups-{turn - 1}")
        seen = seen.unionByName(todo)
        todo = todo.limit(0)
    scratch.drop("near-pairs", "near-candidates", "near-first", "near-rest", "near-links")
    rest = scratch.table(missed_pairs(sig, docs, group, scratch), "near-missed")
    scratch.drop("near-shared", "near-first-shingles", "near-forest")
    fresh = scratch.table(ends_of(rest).join(full.select("id"), "id", "left_anti"), "near-fresh")
    if not fresh.isEmpty():
        full = full.unionByName(scratch.table(full_sets(fresh, docs), "near-sets"))
    rest = scratch.table(possible(rest, full), "near-possible")
    more = scratch.table(confirmed(rest, full).distinct(), "near-last-links")
    stars = group.select(F.col("id").alias("a"), F.col("component").alias("b"))
    group = done.table(group if more.isEmpty() else components(stars.unionByName(more)), "near-groups")
    scratch.drop()
    best = (rep.select("n", "f1", "f2", "id").join(group, "id", "left")
            .select("n", "f1", "f2", F.coalesce("component", "id").alias("component")))
    out = sets.select("id", "n", "f1", "f2").join(best, ["n", "f1", "f2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
