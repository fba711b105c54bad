"""Projection, cleaning, casting and filters.

Each function is one ``select``/``filter`` over the input, so a chain of
them fuses into one whole-stage-codegen stage. Where a decision depends on
the data (which columns are dates, which floats are whole numbers, fill
values) a single aggregate pass computes every column's statistic at once
and the driver receives one row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import trim_all


# ------------------------------------------------------------------ names (CLN-01)

def normalize_name(name: str) -> str:
    s = name.lower().replace(" ", "_").replace("-", "_")
    s = re.sub(r"[^a-z0-9_]", "", s)
    s = re.sub(r"_+", "_", s)
    return s.strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case snake names; colliding names get ``_2``, ``_3`` ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = normalize_name(c) or "col"
        if n in seen:
            seen[n] += 1
            n = f"{n}_{seen[n]}"
        else:
            seen[n] = 1
        names.append(n)
    return df.toDF(*names)


# ------------------------------------------------------------ strings (CLN-02)

def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every string column; ``nan``, ``None`` and empty become null."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            t = trim_all(f.name)
            out.append(F.when(t.isin("nan", "None", ""), F.lit(None)).otherwise(t).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- dates (CLN-03)

# Timestamp layouts tried in order when parsing text dates.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
]


def parse_timestamp(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    t = trim_all(col)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def detect_and_parse_dates(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """String columns where more than ``threshold`` of non-null values parse
    as dates are replaced by the parsed timestamp (failures null). One
    aggregate pass measures every string column."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    aggs = []
    for i, c in enumerate(strs):
        aggs += [F.count(c).alias(f"n{i}"), F.count(parse_timestamp(c)).alias(f"p{i}")]
    r = df.agg(*aggs).collect()[0]
    dates = {c for i, c in enumerate(strs) if r[f"n{i}"] and r[f"p{i}"] / r[f"n{i}"] > threshold}
    return df.select(*[parse_timestamp(c).alias(c) if c in dates else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------- numerics (CLN-04)

INT32 = (-(2 ** 31), 2 ** 31 - 1)


def downcast_numeric(df: DataFrame) -> DataFrame:
    """Floating columns holding only whole numbers become bigint; integer
    columns whose range fits become int. One aggregate pass."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    it = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    aggs = []
    for i, c in enumerate(fl):
        x = F.col(c)
        aggs.append(F.coalesce(F.bool_and(F.when(x.isNotNull(), ~F.isnan(x) & (x == F.floor(x))
                                                 & (F.abs(x) < 9.0e18))), F.lit(False))
                    .alias(f"w{i}"))
    for i, c in enumerate(it):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    if not aggs:
        return df
    r = df.agg(*aggs).collect()[0]
    whole = {c for i, c in enumerate(fl) if r[f"w{i}"]}
    small = {c for i, c in enumerate(it)
             if r[f"lo{i}"] is not None and INT32[0] <= r[f"lo{i}"] and r[f"hi{i}"] <= INT32[1]}
    return df.select(*[F.col(c).cast("long").alias(c) if c in whole
                       else F.col(c).cast("int").alias(c) if c in small else F.col(c)
                       for c in df.columns])


# ------------------------------------------------------------ rows (CLN-05/06)

def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset) if subset else None)


# ------------------------------------------------------------ nulls (CLN-07)

def _mode_value(df: DataFrame, col: str):
    """Most frequent non-null value, ties by smallest value."""
    r = (df.where(F.col(col).isNotNull()).groupBy(col).count()
         .orderBy(F.desc("count"), F.asc(col)).limit(1).collect())
    return r[0][col] if r else None


def handle_nulls(df: DataFrame, policy: dict[str, object], drop_over: float | None = None) -> DataFrame:
    """Per-column null policy: ``"keep"``, ``"drop"`` (drop rows),
    ``"median"``, ``"mode"``, or ``("value", v)``. Columns with a null share
    above ``drop_over`` are removed first."""
    out = df
    if drop_over is not None:
        r = df.agg(F.count(F.lit(1)).alias("_n"),
                   *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).collect()[0]
        gone = [c for c in df.columns if r["_n"] and r[c] / r["_n"] > drop_over]
        out = out.drop(*gone)
        policy = {k: v for k, v in policy.items() if k not in gone}
    drops = [c for c, p in policy.items() if p == "drop"]
    if drops:
        out = out.na.drop(subset=drops)
    fills = {}
    for c, p in policy.items():
        if p == "median":
            fills[c] = exact_quantiles(out, c, [0.5])[0]
        elif p == "mode":
            fills[c] = _mode_value(out, c)
        elif isinstance(p, tuple) and p[0] == "value":
            fills[c] = p[1]
    return out.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c)
                        if c in fills and fills[c] is not None else F.col(c)
                        for c in out.columns])


# --------------------------------------------------------- encoding (CLN-08)

def encode_category(df: DataFrame, col: str, mapping: dict | None = None,
                    out: str | None = None) -> DataFrame:
    """Integer code by explicit map, or by frequency order (most frequent =
    0, ties by value). The code table holds one row per distinct value and
    is joined back (broadcast only when proven small)."""
    from ..plans.scale import broadcast_if_small
    out = out or f"{col}_code"
    if mapping is not None:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return df.withColumn(out, F.element_at(m, F.col(col)))
    codes = (df.where(F.col(col).isNotNull()).groupBy(col).count()
             .withColumn(out, (F.row_number().over(
                 Window.orderBy(F.desc("count"), F.asc(col))) - 1).cast("int"))
             .drop("count"))
    return df.join(broadcast_if_small(codes, 100_000), col, "left")


# ------------------------------------------------------- audit (CLN-09)

def cleaning_audit(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row per step: rows and null cells. All steps are measured in one
    job: each step contributes one aggregate row, the rows are unioned and
    the previous step joined by a lag over the (tiny) step list."""
    parts = []
    for i, (name, d) in enumerate(steps):
        nulls = sum((F.count_if(F.col(c).isNull()) for c in d.columns), F.lit(0))
        parts.append(d.agg(F.count(F.lit(1)).alias("rows_after"),
                           nulls.cast("long").alias("nulls_after"))
                     .select(F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                             "rows_after", "nulls_after"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.orderBy("step_no")   # one row per step: a handful of rows
    return (u.withColumn("rows_before", F.coalesce(F.lag("rows_after").over(w), F.col("rows_after")))
            .withColumn("nulls_before", F.coalesce(F.lag("nulls_after").over(w), F.col("nulls_after")))
            .withColumn("dropped", F.col("rows_before") - F.col("rows_after")))


# --------------------------------------------------------- staging (CLN-10)

def stage(df: DataFrame, spec: dict[str, tuple[str, str | None]], upper: Sequence[str] = ()) -> DataFrame:
    """``spec``: output name -> (source column, cast type or None)."""
    cols = []
    for name, (src, typ) in spec.items():
        c = F.col(src)
        if src in upper:
            c = F.upper(c)
        if typ:
            c = c.cast(typ)
        cols.append(c.alias(name))
    return df.select(*cols)


# ------------------------------------------------------- date parts (CLN-11/12)

DATE_PART_SUFFIXES = ("_year", "_month", "_day", "_dow")


def add_date_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``_year, _month, _day, _dow`` (Monday = 0); source column dropped."""
    out = df
    for c in cols:
        out = (out.withColumn(f"{c}_year", F.year(c)).withColumn(f"{c}_month", F.month(c))
               .withColumn(f"{c}_day", F.dayofmonth(c)).withColumn(f"{c}_dow", F.weekday(c))
               .drop(c))
    return out


def drop_date_parts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(DATE_PART_SUFFIXES)])


# ------------------------------------------- compatibility and evolution (CLN-15/16)

def compat_view(df: DataFrame, mapping: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Old schema over a new table: ``mapping`` old name -> new column;
    ``defaults`` fill old columns that may be null or absent."""
    cols = []
    for old, new in mapping.items():
        c = F.col(new) if new in df.columns else F.lit(None)
        if old in defaults:
            c = F.coalesce(c, F.lit(defaults[old]))
        cols.append(c.alias(old))
    return df.select(*cols)


def evolve(df: DataFrame, existing: DataFrame, mode: str = "append_new_columns") -> DataFrame:
    """Align an incoming frame with an existing table.

    ``append_new_columns``: union of both column sets, old rows null in new
    columns; ``sync_all_columns``: incoming schema wins, old-only columns
    dropped; ``fail``: raise when the column sets differ."""
    new_cols = [c for c in df.columns if c not in existing.columns]
    gone = [c for c in existing.columns if c not in df.columns]
    if mode == "fail" and (new_cols or gone):
        raise ValueError(f"schema changed: added {new_cols}, removed {gone}")
    if mode == "sync_all_columns":
        return existing.select(*[c for c in existing.columns if c in df.columns]) \
            .unionByName(df, allowMissingColumns=True)
    return existing.unionByName(df, allowMissingColumns=True)


# -------------------------------------------------------- measures (CLN-17)

def with_amounts(df: DataFrame, qty: str, price: str, disc: str) -> DataFrame:
    """gross = qty x price; net = gross x (1 - coalesce(disc, 0) / 100)."""
    gross = F.col(qty) * F.col(price)
    return (df.withColumn("gross_amount", gross)
            .withColumn("net_amount", gross * (1 - F.coalesce(F.col(disc), F.lit(0)) / 100)))


# ------------------------------------------------------------ gaps (CLN-18)

def fill_gaps(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Forward fill, then backward fill, per ordered series. Both passes are
    running frames (the backward one runs over the reversed order), so each
    series is read once per pass, never once per row."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    os_ = [order] if isinstance(order, str) else list(order)
    fwd = Window.partitionBy(*ks).orderBy(*os_).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*ks).orderBy(*[F.col(o).desc() for o in os_]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for c in cols:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(fwd))
    for c in cols:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(bwd))
    return out


# ================================================================ filters (2.4)

def silver_filter(df: DataFrame, required: Sequence[str], allowed: dict[str, Sequence]) -> DataFrame:
    cond = F.lit(True)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    for c, vals in allowed.items():
        cond = cond & F.col(c).isin(list(vals))
    return df.where(cond)


def filter_contains(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Every non-null filter must be a case-insensitive substring of the
    field's text; a missing field counts as empty text."""
    cond = F.lit(True)
    for field, v in filters.items():
        if v is None:
            continue
        text = F.coalesce(F.col(field).cast("string"), F.lit("")) if field in df.columns else F.lit("")
        cond = cond & F.lower(text).contains(str(v).lower())
    return df.where(cond)


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def incremental_filter(src: DataFrame, target: DataFrame, ts_col: str,
                       floor: str = "1900-01-01") -> DataFrame:
    """Rows newer than the target's high-water mark (``floor`` when the
    target is empty). The mark is one scalar, read once on the driver, and
    becomes a literal predicate that Parquet can push down."""
    hw = target.agg(F.max(ts_col).alias("m")).collect()[0]["m"]
    mark = F.lit(hw) if hw is not None else F.lit(floor).cast(src.schema[ts_col].dataType)
    return src.where(F.col(ts_col) > mark)


def for_date(df: DataFrame, ts_col: str, date: str) -> DataFrame:
    """One logical date as a half-open range on the raw column (keeps the
    predicate pushable; ``to_date(ts) = d`` would not be)."""
    typ = df.schema[ts_col].dataType
    d0 = F.lit(date).cast("date")
    lo = d0.cast(typ)
    hi = F.date_add(d0, 1).cast(typ)
    return df.where((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def recent(df: DataFrame, ts_col: str, days: int, as_of: str) -> DataFrame:
    typ = df.schema[ts_col].dataType
    now = F.lit(as_of).cast(typ)
    return df.where((F.col(ts_col) >= now - F.make_dt_interval(F.lit(days))) & (F.col(ts_col) <= now))


def url_host(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def _host_match(host: Column, domain: str) -> Column:
    d = domain.lower()
    return (host == d) | host.endswith("." + d)


def filter_domains(df: DataFrame, url_col: str, include: Sequence[str] = (),
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose URL host is (a subdomain of) an included domain and
    not of an excluded one. Empty ``include`` admits every host."""
    h = url_host(url_col)
    cond = F.lit(True)
    if include:
        inc = F.lit(False)
        for d in include:
            inc = inc | _host_match(h, d)
        cond = cond & inc
    for d in exclude:
        cond = cond & ~_host_match(h, d)
    return df.where(cond)


def with_ingest_metadata(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Bronze metadata: ingestion time and source file of each row."""
    ts = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    return df.withColumn("_ingested_at", ts).withColumn("_source_file", F.col("_metadata.file_path"))


