"""Physical-plan helpers: checked broadcast, salting, lineage cuts.

Rules followed everywhere in the package:

* ``broadcast`` only behind a row-count check (:func:`broadcast_if_small`);
  beyond the bound the frame is returned unhinted and Spark plans a
  shuffle join (AQE may still demote it to a broadcast at runtime using
  real shuffle statistics).
* hot keys are split with a deterministic salt (``xxhash64`` of row
  content, never ``rand``) so task retries recompute identical rows.
* long lineages are cut with ``checkpoint()`` into the shared
  ``spark.checkpoint.dir``; ``localCheckpoint`` is never used because it
  dies with the executor that holds the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Row bound under which a side may be broadcast. Dimension tables of the
# warehouse (region, nation, date dimension, rule tables, query vectors)
# sit far below it; facts never do.
DEFAULT_BROADCAST_ROWS = 2_000_000


def row_count_at_most(df: DataFrame, bound: int) -> bool:
    """True when ``df`` has at most ``bound`` rows. Runs a LIMIT job that
    stops reading once ``bound + 1`` rows are seen."""
    return df.limit(bound + 1).count() <= bound


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` for broadcast only when its size is proven small."""
    if row_count_at_most(df, max_rows):
        return F.broadcast(df)
    return df


def broadcast_many(dfs: list[DataFrame], max_rows: int = DEFAULT_BROADCAST_ROWS) -> list[DataFrame]:
    """Size-check several candidate sides in ONE job (a union of LIMIT
    counts) and hint only those proven small."""
    if not dfs:
        return []
    probe = None
    for i, d in enumerate(dfs):
        p = d.limit(max_rows + 1).select(F.lit(i).alias("_i"))
        probe = p if probe is None else probe.unionAll(p)
    counts = {r["_i"]: r["n"] for r in probe.groupBy("_i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [F.broadcast(d) if counts.get(i, 0) <= max_rows else d for i, d in enumerate(dfs)]


def plan_text(df: DataFrame) -> str:
    """The physical plan as ``explain()`` prints it (nothing is executed)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue()


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Give CPU-heavy row work (regex profiles, text extraction, vector
    scoring) at least one partition per core. An input with fewer
    partitions (one unsplittable file) is redistributed round-robin; a
    large input already has more partitions and passes through unchanged."""
    try:
        target = min_parts or df.sparkSession.sparkContext.defaultParallelism
    except Exception:       # sessions without a SparkContext (Spark Connect): leave as is
        return df
    if "Exchange" in plan_text(df):
        # after a shuffle the partitions already follow the shuffle setting;
        # asking an adaptive plan for its partition count would run it
        return df
    if df.rdd.getNumPartitions() < target:      # scan-only plan: no job runs
        # hash of the row content: deterministic placement without the
        # local sort a round-robin repartition needs for retry safety
        return df.repartition(target, F.xxhash64(*[F.col(c) for c in df.columns]))
    return df


def salt_column(n_salts: int, *cols: str | Column) -> Column:
    """Deterministic salt in ``[0, n_salts)`` from row content."""
    exprs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.pmod(F.xxhash64(*exprs), F.lit(n_salts)).cast("int")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def delete_path(spark, path: str) -> None:
    """Remove a folder of the shared storage (left there by sessions
    without a JVM of their own, such as Spark Connect)."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b): the smallest id it can
    reach. Large-star and small-star rounds alternate until no edge changes,
    about log n rounds for a path of n ids; lineage is cut each round."""
    cur = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := _edge_state(cur)) != before and now[0]:
        before = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
    label = cur.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
    ids = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    return ids.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _edge_state(edges: DataFrame) -> tuple:
    """Number and order-free content hash of the edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: list[str],
                   n_parts: int | None = None) -> DataFrame:
    """Running totals of ``sum_cols`` over rows ordered by ``order_col``
    (one row per distinct ``order_col`` value expected, e.g. value counts).

    A global ``Window.orderBy`` would sort everything in one task. Instead
    the key range is cut into ``n_parts`` buckets at approximate quantiles
    (one sketch pass), each bucket's totals are computed (one row per
    bucket), turned into offsets by a window over those few rows, joined
    back by broadcast (bounded by ``n_parts``) and added to a running sum
    inside each bucket. The bucket is a pure function of the key, so equal
    keys never split and recomputation after a lost executor is identical.
    Adds ``{c}_before`` (exclusive) and ``{c}_upto`` (inclusive) columns.
    """
    from pyspark.sql import Window
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n_parts for i in range(1, n_parts)]
    bounds = df.agg(F.percentile_approx(order_col, probs, 10_000)).collect()[0][0] if probs else []
    bounds = sorted(set(b for b in (bounds or []) if b is not None))
    arr = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    bucket = F.size(F.filter(arr, lambda b: b < F.col(order_col)))
    parts = df.withColumn("_pid", bucket)
    totals = parts.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wt = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # <= n_parts rows
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wt), F.lit(0)).alias(f"_o_{c}")
                                      for c in sum_cols])
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "_pid")
    for c in sum_cols:
        upto = F.col(f"_o_{c}") + F.sum(c).over(w)
        out = out.withColumn(f"{c}_upto", upto).withColumn(f"{c}_before", upto - F.col(c))
    return out.drop("_pid", *[f"_o_{c}" for c in sum_cols])
