"""Warehouse modelling and change application.

Plain Parquet has no ``MERGE INTO``: every merge here is a join that
returns the complete new state of the target, which the caller writes to a
new path (or with dynamic partition overwrite). Keys are compared with
null-safe equality; change detection uses the null-safe row hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import row_hash, surrogate_key
from .relational import latest_per_key

OPEN_END = "9999-12-31"


def _ks(k):
    return [k] if isinstance(k, str) else list(k)


def _lit_date(d: str) -> Column:
    return F.lit(d).cast("date")


# --------------------------------------------------------------- WH-01

def date_dim(spark, start: str | Column, end: str | Column, as_of: str) -> DataFrame:
    """Calendar rows from ``start`` to ``end``: yyyymmdd key, Sunday = 0
    weekday, ISO week, month / quarter attributes, fiscal year starting in
    July, relative flags against ``as_of``. ``start``/``end`` may be columns
    of a one-row frame's values passed as literals."""
    s = F.lit(start).cast("date") if isinstance(start, str) else start
    e = F.lit(end).cast("date") if isinstance(end, str) else end
    days = spark.range(1).select(F.explode(F.sequence(s, e, F.expr("interval 1 day"))).alias("d"))
    return dim_from_dates(days, as_of)


def dim_from_dates(days: DataFrame, as_of: str) -> DataFrame:
    d = F.col("d")
    now = F.lit(as_of).cast("date")
    m = F.month(d)
    wk = F.date_trunc("week", d).cast("date")
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d.alias("full_date"),
        (F.dayofweek(d) - 1).alias("day_of_week"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.weekofyear(d).alias("week_of_year"),
        wk.alias("week_start_date"),
        F.date_add(wk, 6).alias("week_end_date"),
        m.alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.trunc(d, "month").alias("month_start_date"),
        F.last_day(d).alias("month_end_date"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
        F.year(d).alias("year_number"),
        F.when(m >= 7, F.year(d) + 1).otherwise(F.year(d)).alias("fiscal_year"),
        F.when(m >= 7, F.ceil((m - 6) / 3.0)).otherwise(F.ceil((m + 6) / 3.0)).cast("int")
        .alias("fiscal_quarter"),
        (d == now).alias("is_current_day"),
        ((d >= F.date_trunc("week", now).cast("date"))
         & (d < F.date_add(F.date_trunc("week", now).cast("date"), 7))).alias("is_current_week"),
        (F.trunc(d, "month") == F.trunc(now, "month")).alias("is_current_month"),
        (F.trunc(d, "quarter") == F.trunc(now, "quarter")).alias("is_current_quarter"),
        (F.year(d) == F.year(now)).alias("is_current_year"))


# ------------------------------------------------------------ WH-02 SCD0/1

def _keyed_join(dim: DataFrame, stage: DataFrame, key, prefix: str = "_s_") -> DataFrame:
    ks = _ks(key)
    s = stage.select(*[F.col(c).alias(prefix + c) for c in stage.columns])
    cond = None
    for k in ks:
        c = F.col(k).eqNullSafe(F.col(prefix + k))
        cond = c if cond is None else cond & c
    return dim.join(s, cond, "full_outer")


def scd1_merge(dim: DataFrame, stage: DataFrame, key) -> DataFrame:
    """Type 1: matching keys take the stage values, new keys are inserted,
    dimension-only keys stay."""
    j = _keyed_join(dim, stage, key)
    in_stage = F.col("_s_" + _ks(key)[0]).isNotNull() | F.lit(False)
    for k in _ks(key)[1:]:
        in_stage = in_stage | F.col("_s_" + k).isNotNull()
    return j.select(*[F.when(in_stage, F.col("_s_" + c)).otherwise(F.col(c)).alias(c) for c in dim.columns])


def scd0_merge(dim: DataFrame, stage: DataFrame, key) -> DataFrame:
    """Type 0: existing rows keep their original values; only new keys are
    inserted."""
    j = _keyed_join(dim, stage, key)
    in_dim = F.lit(False)
    for k in _ks(key):
        in_dim = in_dim | F.col(k).isNotNull()
    return j.select(*[F.when(in_dim, F.col(c)).otherwise(F.col("_s_" + c)).alias(c) for c in dim.columns])


# ------------------------------------------------------------ WH-03 SCD2

def scd2_init(df: DataFrame, start: str) -> DataFrame:
    return (df.withColumn("effective_from", _lit_date(start))
            .withColumn("effective_to", _lit_date(OPEN_END))
            .withColumn("is_current", F.lit(True)))


def scd2_merge(dim: DataFrame, stage: DataFrame, key, cols: Sequence[str], as_of: str) -> DataFrame:
    """Type 2 history: for a changed current row the old version is closed
    (``effective_to = as_of``, not current) and a new version opened; new
    keys are opened; everything else is carried unchanged. Returns the
    full new dimension as a union of untouched, closed and opened rows."""
    ks = _ks(key)
    attrs = [c for c in stage.columns if c not in ks]
    cur = dim.where("is_current")
    hist = dim.where(~F.col("is_current"))
    s = stage.select(*[F.col(c).alias("_s_" + c) for c in stage.columns]) \
        .withColumn("_s_hash", row_hash(*[F.col("_s_" + c) for c in cols]))
    cond = None
    for k in ks:
        c = F.col(k) == F.col("_s_" + k)
        cond = c if cond is None else cond & c
    j = cur.withColumn("_c_hash", row_hash(*cols)).join(s, cond, "full_outer")
    matched = F.col(ks[0]).isNotNull() & F.col("_s_" + ks[0]).isNotNull()
    changed = matched & (F.col("_c_hash") != F.col("_s_hash"))
    is_new = F.col(ks[0]).isNull()
    dim_cols = dim.columns
    untouched = j.where(F.col(ks[0]).isNotNull() & ~F.coalesce(changed, F.lit(False))).select(*dim_cols)
    closed = (j.where(changed).select(*dim_cols)
              .withColumn("effective_to", _lit_date(as_of)).withColumn("is_current", F.lit(False)))
    opened = (j.where(changed | is_new)
              .select(*[F.col("_s_" + c).alias(c) for c in ks + attrs])
              .withColumn("effective_from", _lit_date(as_of))
              .withColumn("effective_to", _lit_date(OPEN_END))
              .withColumn("is_current", F.lit(True)))
    other = [c for c in dim_cols if c not in opened.columns]
    for c in other:
        opened = opened.withColumn(c, F.lit(None).cast(dim.schema[c].dataType))
    return hist.unionByName(untouched).unionByName(closed).unionByName(opened.select(*dim_cols))


# ------------------------------------------------------------ WH-04 SCD3

def scd3_merge(dim: DataFrame, stage: DataFrame, key, col: str, as_of: str) -> DataFrame:
    """Type 3: keep the previous value of ``col`` and the change date."""
    ks = _ks(key)
    j = _keyed_join(dim, stage.select(*ks, col), key)
    changed = F.col(ks[0]).isNotNull() & F.col("_s_" + ks[0]).isNotNull() & \
        ~F.col(col).eqNullSafe(F.col("_s_" + col))
    is_new = F.col(ks[0]).isNull()
    out = []
    for c in dim.columns:
        if c in ks:
            out.append(F.coalesce(F.col(c), F.col("_s_" + c)).alias(c))
        elif c == col:
            out.append(F.when(changed | is_new, F.col("_s_" + col)).otherwise(F.col(col)).alias(c))
        elif c == f"previous_{col}":
            out.append(F.when(changed, F.col(col)).otherwise(F.col(c)).alias(c))
        elif c == f"{col}_changed_at":
            out.append(F.when(changed, _lit_date(as_of)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# ------------------------------------------------------------ WH-05 SCD4

def scd4_split(dim: DataFrame, key, bands: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Type 4 mini-dimension: fast-changing attributes are banded into a
    separate profile dimension; the main rows keep only ``profile_key``."""
    banded = dim.select(*[F.col(c) for c in dim.columns], *[e.alias(n) for n, e in bands.items()])
    pk = surrogate_key(*[F.col(n) for n in bands])
    profile = banded.select(pk.alias("profile_key"), *bands.keys()).distinct()
    main = banded.withColumn("profile_key", pk).drop(*bands.keys())
    return main, profile


# ------------------------------------------------------------ WH-06 SCD6

def scd6_view(scd2: DataFrame, key, col: str) -> DataFrame:
    """Type 6 over a type 2 table: each version carries its historical
    value, the key's current value and the previous version's value."""
    ks = _ks(key)
    w = Window.partitionBy(*ks).orderBy("effective_from")
    cur = (scd2.where("is_current").select(*ks, F.col(col).alias(f"current_{col}")))
    return (scd2.withColumn(f"previous_{col}", F.lag(col).over(w))
            .withColumnRenamed(col, f"historical_{col}")
            .join(cur, ks, "left"))


# ------------------------------------------------------------ WH-07..09 vault

def hub_load(hub: DataFrame, stage: DataFrame, bk: str, source: str, as_of: str) -> DataFrame:
    """Insert business keys not yet in the hub (idempotent)."""
    new = (stage.select(bk).where(F.col(bk).isNotNull()).distinct()
           .join(hub.select(bk), bk, "left_anti")
           .select(F.md5(F.col(bk).cast("string")).alias("hub_key"), bk,
                   _lit_date(as_of).alias("load_date"), F.lit(source).alias("record_source")))
    return hub.unionByName(new)


def sat_load(sat: DataFrame, stage: DataFrame, bk: str, cols: Sequence[str], source: str,
             as_of: str) -> DataFrame:
    """Satellite: a new row when the attribute hash differs from the
    current row of the key; only changed keys have their current row
    closed (unchanged rows stay open)."""
    st = (stage.select(F.md5(F.col(bk).cast("string")).alias("hub_key"), *cols)
          .withColumn("hash_diff", row_hash(*cols)))
    cur = sat.where(F.col("load_end_date").isNull())
    j = st.join(cur.select("hub_key", F.col("hash_diff").alias("_cur_hash")), "hub_key", "left")
    changed = j.where(F.col("_cur_hash").isNull() | (F.col("_cur_hash") != F.col("hash_diff")))
    new_rows = (changed.drop("_cur_hash").withColumn("load_date", _lit_date(as_of))
                .withColumn("load_end_date", F.lit(None).cast("date"))
                .withColumn("record_source", F.lit(source)))
    closing = changed.where(F.col("_cur_hash").isNotNull()).select("hub_key").withColumn("_close", F.lit(True))
    s2 = (sat.join(closing, "hub_key", "left")
          .withColumn("load_end_date", F.when(F.col("_close") & F.col("load_end_date").isNull(),
                                              _lit_date(as_of)).otherwise(F.col("load_end_date")))
          .drop("_close"))
    return s2.unionByName(new_rows.select(*sat.columns))


def link_load(link: DataFrame, stage: DataFrame, keys: Sequence[str], source: str, as_of: str) -> DataFrame:
    """Link: insert key pairs not yet linked; link key = md5 of both keys."""
    pairs = stage.select(*keys).where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).distinct()
    new = (pairs.join(link.select(*keys), keys, "left_anti")
           .select(surrogate_key(*keys).alias("link_key"), *keys,
                   _lit_date(as_of).alias("load_date"), F.lit(source).alias("record_source")))
    return link.unionByName(new)


# ------------------------------------------------------------ WH-10/11

def merge_upsert(target: DataFrame, stage: DataFrame, key, order=None) -> DataFrame:
    """Incremental merge: the latest stage row per key replaces the target
    row; target rows without a stage row stay."""
    ks = _ks(key)
    s = latest_per_key(stage, ks, order) if order else stage
    keep = target.join(s.select(*ks), ks, "left_anti")
    return keep.unionByName(s.select(*target.columns))


def apply_cdc(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Apply change events ``(op, key, order, after...)``: c / r insert, u
    update, d delete; the last event per key wins."""
    last = latest_per_key(changes, key, [order])
    live = last.where(F.col("op").isin("c", "r", "u")).select(*target.columns)
    untouched = target.join(last.select(key), key, "left_anti")
    return untouched.unionByName(live)


# ------------------------------------------------------------ WH-12

def build_star(fact: DataFrame, dims: dict[str, tuple[str, Sequence[str]]], date_cols: Sequence[str] = ()) -> DataFrame:
    """Fact with surrogate keys: ``dims`` maps output key -> (unused
    dimension name, natural key columns); date columns become yyyymmdd
    keys. Natural keys are replaced by their md5 surrogate."""
    out = fact
    drop = []
    for sk, (_dim, nk) in dims.items():
        out = out.withColumn(sk, surrogate_key(*nk))
        drop += list(nk)
    for c in date_cols:
        out = out.withColumn(f"{c}_key", F.date_format(c, "yyyyMMdd").cast("int"))
        drop.append(c)
    return out.drop(*drop)


def snowflake(dim: DataFrame, sub_cols: Sequence[str], sub_key: str) -> tuple[DataFrame, DataFrame]:
    """Normalise ``sub_cols`` of a dimension into a sub-dimension keyed by
    the md5 of those columns."""
    k = surrogate_key(*sub_cols)
    sub = dim.select(k.alias(sub_key), *sub_cols).distinct()
    return dim.withColumn(sub_key, k).drop(*sub_cols), sub


# ------------------------------------------------------------ WH-14/15

def partition_advice(df: DataFrame, size_bytes: int, top: int = 3) -> DataFrame:
    """Partitioning candidates from exact column statistics in one pass:
    skip > 20% null; date/timestamp -> range (size / 365 per part);
    <= 100 distinct -> list; <= 10000 -> hash with a power-of-two count
    near size / 128 MB; smallest partition size first, top 3."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.countDistinct(c).alias(f"d{i}")]
    r = df.agg(*aggs).collect()[0]      # one row of statistics
    mb = 1024 * 1024
    rows = []
    for i, c in enumerate(cols):
        null_pct = r[f"z{i}"] * 100.0 / r["_n"] if r["_n"] else 0.0
        card = r[f"d{i}"]
        if null_pct > 20:
            continue
        typ = df.schema[c].dataType.typeName()
        if typ in ("date", "timestamp", "timestamp_ntz"):
            rows.append((c, "range", None, size_bytes / 365 / mb, int(card)))
        elif card and card <= 100:
            rows.append((c, "list", int(card), size_bytes / card / mb, int(card)))
        elif card and card <= 10000:
            n = max(1, int(size_bytes / (128 * mb)))
            n = 2 ** int(math.log2(n) + 0.5)
            rows.append((c, "hash", n, size_bytes / n / mb, int(card)))
    rows.sort(key=lambda x: x[3])
    return df.sparkSession.createDataFrame(
        rows[:top], "column_name string, partition_type string, num_partitions int, "
                    "partition_size_mb double, cardinality long")


SKETCH_BITS = 12        # 2^12 registers: a relative standard error of about 1.6 % (1.04 / 2^6)


def column_sketches(df: DataFrame, cols: Sequence[str], part: Column | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """(part, column_name, kind, rows, nulls, sketch): mergeable
    distinct-count sketches of every column, per partition value ``part``
    (one for the table without), from one scan and one partial aggregate.
    The table can be kept: a new partition adds its rows, and nothing is
    scanned again."""
    part = F.lit(None).cast("string") if part is None else part.cast("string")
    kept = df.select(part.alias("part"), *[F.col(c) for c in cols])
    g = kept.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *[x for i, c in enumerate(cols) for x in (
        F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"s{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.typeName()).alias("kind"), F.col("rows"),
                               F.col(f"z{i}").alias("nulls"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return g.select("part", F.explode(cells).alias("c")).select("part", "c.*")


def sketched_advice(sketches: DataFrame, size_bytes: int) -> DataFrame:
    """:func:`partition_advice` for every column from kept sketches:
    (column_name, rows, nulls, cardinality, partition_type, num_partitions,
    partition_size_mb); partition_type is null where none suits.
    ``cardinality`` is an estimate (exact for a few hundred values)."""
    mb = 1024 * 1024
    hashed = 2 ** int(math.log2(max(1, int(size_bytes / (128 * mb)))) + 0.5)
    m = sketches.groupBy("column_name", "kind").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cardinality"))
    n, dated = F.col("cardinality"), F.col("kind").isin("date", "timestamp", "timestamp_ntz")
    usable = F.col("nulls") * 100.0 <= F.col("rows") * 20
    kind = F.when(usable & dated, "range").when(usable & (n > 0) & (n <= 100), "list").when(usable & (n > 0) & (n <= 10000), "hash")
    parts = F.when(kind == "list", n).when(kind == "hash", F.lit(hashed)).cast("int")
    return m.select("column_name", "rows", "nulls", "cardinality", kind.alias("partition_type"), parts.alias("num_partitions"),
                    (F.lit(float(size_bytes)) / F.when(kind == "range", F.lit(365)).otherwise(parts) / mb).alias("partition_size_mb"))


def key_skew(df: DataFrame, key, threshold: float = 5.0) -> DataFrame:
    """Largest group vs median group size; skewed when the ratio exceeds
    ``threshold``. The median of group sizes is exact and distributed."""
    sizes = df.groupBy(*_ks(key)).count()
    med = exact_quantiles(sizes, "count", [0.5])[0]
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("count").alias("max_group"),
                     F.min("count").alias("min_group")) \
        .withColumn("median_group", F.lit(med).cast("double")) \
        .withColumn("skew_ratio", F.col("max_group") / F.col("median_group")) \
        .withColumn("skewed", F.col("skew_ratio") > threshold)


def job_findings(metrics: DataFrame) -> DataFrame:
    """Rules over job metrics rows (``jobId, duration, numTasks,
    shuffleReadBytes, shuffleWriteBytes, inputBytes, gcTime, failedTasks,
    speculativeTasks``): shuffle > 1.5 x input, GC > 10% of time, failed
    tasks, speculative > 10% of tasks, > 10000 tasks, < 10 tasks on > 1 GB."""
    shuffle = F.col("shuffleReadBytes") + F.col("shuffleWriteBytes")
    rules = [
        ("excessive_shuffle", shuffle > F.col("inputBytes") * 1.5),
        ("high_gc", F.col("gcTime") > F.col("duration") * 0.1),
        ("failed_tasks", F.col("failedTasks") > 0),
        ("speculation", F.col("speculativeTasks") > F.col("numTasks") * 0.1),
        ("too_many_tasks", F.col("numTasks") > 10000),
        ("too_few_tasks", (F.col("numTasks") < 10) & (F.col("inputBytes") > 1024 ** 3)),
    ]
    arr = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return metrics.select("jobId", F.explode(arr).alias("finding"))


def resize(df: DataFrame, size_mb: float, target_mb: float = 200.0) -> DataFrame:
    """Partition count = size / target (>= 1): coalesce to shrink (no
    shuffle), repartition to grow."""
    from ..plans.scale import plan_text
    n = max(1, int(size_mb / target_mb))
    shuffle_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        cur = shuffle_parts if "Exchange" in plan_text(df) else df.rdd.getNumPartitions()   # no job runs
    except Exception:       # no RDD view (Spark Connect): assume the shuffle setting
        cur = shuffle_parts
    return df.coalesce(n) if n < cur else df.repartition(n)


# ------------------------------------------------------------ WH-13 medallion

def bronze(raw: DataFrame, as_of: str) -> DataFrame:
    from .clean import with_ingest_metadata
    return with_ingest_metadata(raw, as_of)


def silver(bronze_df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Required user, allowed types, one row per event id (latest ingest
    wins), event date and hourly session."""
    from .clean import silver_filter
    s = silver_filter(bronze_df, ["user_id"], {"event_type": list(allowed)})
    s = latest_per_key(s, "event_id", ["_ingested_at"])
    return (s.withColumn("event_date", F.to_date("ts"))
            .withColumn("session_id", F.date_trunc("hour", "ts")))


def gold(silver_df: DataFrame) -> DataFrame:
    from .relational import daily_user_metrics
    return daily_user_metrics(silver_df)


def medallion(raw: DataFrame, root: str | None, as_of: str,
              allowed: Sequence[str] = ("click", "view", "purchase")) -> DataFrame:
    """bronze -> silver -> gold. With ``root`` each layer is written as
    Parquet (gold partitioned by event date) and the next layer reads the
    written files, which also cuts the lineage; without it the layers are
    composed lazily."""
    b = bronze(raw, as_of)
    if root:
        b.write.mode("append").parquet(f"{root}/bronze")
        b = raw.sparkSession.read.parquet(f"{root}/bronze")
    s = silver(b, allowed)
    if root:
        s.write.mode("overwrite").parquet(f"{root}/silver")
        s = raw.sparkSession.read.parquet(f"{root}/silver")
    g = gold(s)
    if root:
        g.write.mode("overwrite").partitionBy("event_date").parquet(f"{root}/gold/daily_user_metrics")
        g = raw.sparkSession.read.parquet(f"{root}/gold/daily_user_metrics")
    return g


# ------------------------------------------------------------ WH-17 lineage

LINEAGE_SCHEMA = ("run_id string, job string, event_type string, event_time timestamp, inputs array<string>, "
                  "outputs array<string>, output_schema string, row_count long, error string")


def with_lineage(job: str, inputs: Sequence[str], outputs: Sequence[str], fn, lineage_path: str,
                 run_id: str | None = None):
    """Run ``fn() -> DataFrame`` (which produces the job's output) and append
    START and COMPLETE (or FAIL) events to a Parquet lineage table. The row
    count is an observed metric of the write, so no extra pass is made; the
    output is written by the caller through the returned frame's observer."""
    import uuid as _uuid
    from pyspark.sql import Observation, SparkSession
    spark = SparkSession.getActiveSession()
    rid = run_id or _uuid.uuid4().hex

    def emit(kind, schema=None, rows=None, err=None):
        spark.createDataFrame([(rid, job, kind, None, list(inputs), list(outputs), schema, rows, err)],
                              LINEAGE_SCHEMA) \
            .withColumn("event_time", F.current_timestamp()) \
            .write.mode("append").parquet(lineage_path)

    emit("START")
    try:
        out = fn()
        obs = Observation(f"lineage_{rid}")
        observed = out.observe(obs, F.count(F.lit(1)).alias("rows"))
        observed.write.mode("overwrite").parquet(outputs[0])
        emit("COMPLETE", out.schema.simpleString(), int(obs.get["rows"]))
    except Exception as e:  # record the failure, then re-raise
        emit("FAIL", err=str(e)[:1000])
        raise
    return rid
