"""Profiling and exploratory statistics.

Design rule: a profile is one wide aggregate over all columns at once
(counts, pattern matches, moments) plus, where value frequencies are
needed, one ``groupBy(column, value)`` over the unpivoted table. Results
come back long: one row per column (or per column pair).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import column_index, quantiles_of, ranked_values
from ..functions.scalars import kurtosis_unbiased, safe_divide, skewness_unbiased, trim_all
from ..plans.scale import cut_lineage, ordered_cumsum, spread

# Text patterns for type and pattern detection, in the order
# they are tried (first with a large enough share wins).
TYPE_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "phone": r"^\+?[\d\s\-\(\)]{10,}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
}
# Words read as booleans.
BOOL_WORDS = ("true", "false", "yes", "no", "1", "0")
# Text accepted by Python int() / float() (underscores between digits,
# nan / inf words), written as patterns so both engines agree.
INT_RE = r"^[+-]?\d+(_\d+)*$"
FLOAT_RE = (r"^[+-]?((\d+(_\d+)*)?\.\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|\d+(_\d+)*\.?([eE][+-]?\d+(_\d+)*)?"
            r"|nan|inf|infinity)$")


def pattern_order(reference_order: bool = True) -> list[str]:
    """Pattern names in trial order. ``reference_order=False`` tries the two
    date patterns before ``phone`` (an ISO date otherwise reads as a phone)."""
    names = list(TYPE_PATTERNS)
    if not reference_order:
        names.remove("date_iso")
        names.remove("datetime_iso")
        names.insert(names.index("phone"), "datetime_iso")
        names.insert(names.index("datetime_iso"), "date_iso")
    return names


def _text(c: str) -> Column:
    return trim_all(F.col(c).cast("string"))


def _guard(name: str, t: Column) -> Column:
    """A cheap condition every match of pattern ``name`` satisfies, checked
    before the regular expression (exact: it only skips sure misses)."""
    n = F.length(t)
    return {
        "email": t.contains("@"),
        "uuid": n == 36,
        "phone": n >= 10,
        "url": F.lower(F.substring(t, 1, 4)) == "http",
        "ipv4": (n >= 7) & (n <= 15),
        "date_iso": n == 10,
        "datetime_iso": n >= 19,
        "credit_card": (n >= 16) & (n <= 19),
    }[name]


# bit positions in a cell's match mask
B_BOOL, B_INT, B_FLOAT, B_PRESENT, B_MISSING = 8, 9, 10, 11, 12


def _mask(t: Column, raw_missing: Column) -> Column:
    """One integer per cell: bit j set when pattern j matches; then
    boolean word, integer, float-only, present, raw-missing bits."""
    present = t.isNotNull() & (t != "")
    bits = [F.when(present & _guard(name, t) & t.rlike("(?i)" + rx), F.lit(1 << j)).otherwise(F.lit(0))
            for j, (name, rx) in enumerate(TYPE_PATTERNS.items())]
    bits += [F.when(present & F.lower(t).isin(*BOOL_WORDS), F.lit(1 << B_BOOL)).otherwise(F.lit(0)),
             F.when(present & t.rlike(INT_RE), F.lit(1 << B_INT)).otherwise(F.lit(0)),
             F.when(present & ~t.rlike(INT_RE) & t.rlike("(?i)" + FLOAT_RE), F.lit(1 << B_FLOAT))
             .otherwise(F.lit(0)),
             F.when(present, F.lit(1 << B_PRESENT)).otherwise(F.lit(0)),
             F.when(raw_missing, F.lit(1 << B_MISSING)).otherwise(F.lit(0))]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def type_count_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with, per column i: ``n{i}`` non-blank values, ``m{i}_{j}``
    matches of pattern j, ``b{i}`` boolean words, ``i{i}`` integers,
    ``f{i}`` other floats, ``z{i}`` raw missing (null or empty), and
    ``_total`` rows. Cells are unpivoted and reduced to (column, mask)
    counts: a narrow aggregate with partial aggregation whose result is
    bounded by columns x 2^13 masks (in practice a few dozen rows), so it
    is folded into the counters on the driver."""
    cells = F.array(*[F.struct(F.lit(i).alias("ci"), _text(c).alias("t"),
                               (F.col(c).isNull() | (F.col(c).cast("string") == "")).alias("z"))
                      for i, c in enumerate(cols)])
    g = (spread(df.select(*cols)).select(F.explode(cells).alias("s"))
         .select(F.col("s.ci").alias("ci"), _mask(F.col("s.t"), F.col("s.z")).alias("mask"))
         .groupBy("ci", "mask").count().collect())
    out: dict[str, int] = {"_total": 0}
    names = []
    for i in range(len(cols)):
        names += [f"n{i}"] + [f"m{i}_{j}" for j in range(len(TYPE_PATTERNS))] + [f"b{i}", f"i{i}", f"f{i}", f"z{i}"]
    for nme in names:
        out[nme] = 0
    bit_names = {B_PRESENT: "n", B_BOOL: "b", B_INT: "i", B_FLOAT: "f", B_MISSING: "z"}
    for r in g:
        i, mask, c = r["ci"], r["mask"], r["count"]
        if i == 0:
            out["_total"] += c
        for j in range(len(TYPE_PATTERNS)):
            if mask & (1 << j):
                out[f"m{i}_{j}"] += c
        for bit, prefix in bit_names.items():
            if mask & (1 << bit):
                out[f"{prefix}{i}"] += c
    keys = ["_total"] + names
    schema = ", ".join(f"`{k}` long" for k in keys)
    return df.sparkSession.createDataFrame([tuple(out[k] for k in keys)], schema)


def _type_expr(i: int, order: list[str], share: float) -> Column:
    n = F.col(f"n{i}")
    names = list(TYPE_PATTERNS)
    e = None
    for name in order:
        j = names.index(name)
        cond = F.col(f"m{i}_{j}") / n > share
        e = F.when(cond, name) if e is None else e.when(cond, name)
    e = (e.when(F.col(f"b{i}") / n > share, "boolean")
         .when(F.col(f"i{i}") / n > share, "integer")
         .when((F.col(f"i{i}") + F.col(f"f{i}")) / n > share, "float")
         .otherwise("string"))
    return F.when(n == 0, "string").otherwise(e)


def _pattern_expr(i: int, order: list[str], share: float = 0.8, min_values: int = 10) -> Column:
    n = F.col(f"n{i}")
    names = list(TYPE_PATTERNS)
    e = None
    for name in order:
        j = names.index(name)
        cond = F.col(f"m{i}_{j}") / n > share
        e = F.when(cond, name) if e is None else e.when(cond, name)
    return F.when(n >= min_values, e)


def _long(row_df: DataFrame, cols: Sequence[str], exprs) -> DataFrame:
    """Turn the one-row aggregate into one row per column."""
    structs = [F.struct(F.lit(c).alias("column_name"), *[f(i).alias(k) for k, f in exprs.items()])
               for i, c in enumerate(cols)]
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def detect_types(df: DataFrame, cols: Sequence[str] | None = None, share: float = 0.9,
                 reference_order: bool = True) -> DataFrame:
    """Detected logical type per column (PR-01)."""
    cols = list(cols or df.columns)
    order = pattern_order(reference_order)
    agg = type_count_row(df, cols)
    return _long(agg, cols, {"inferred_type": lambda i: _type_expr(i, order, share)})


def detect_patterns(df: DataFrame, cols: Sequence[str] | None = None,
                    reference_order: bool = True) -> DataFrame:
    """Dominant text pattern per column (PR-02): share > 0.8 of at least 10
    non-blank values, else null."""
    cols = list(cols or df.columns)
    order = pattern_order(reference_order)
    agg = type_count_row(df, cols)
    return _long(agg, cols, {"pattern": lambda i: _pattern_expr(i, order)})


def _unpivot_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) for every non-missing cell, value as text."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.explode(arr).alias("s")).select("s.*")
            .where(F.col("value").isNotNull() & (F.col("value") != "")))


def value_frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, count) over all columns in one shuffle."""
    cols = list(cols or df.columns)
    return _unpivot_text(df, cols).groupBy("column_name", "value").count()


def top_values(df: DataFrame, cols: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` values per column, count desc then value asc. The rank
    filter becomes a per-partition group limit before the window shuffle."""
    w = Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value"))
    return (value_frequencies(df, cols).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None,
                    reference_order: bool = True) -> DataFrame:
    """Per column: total, nulls (null or empty), null %, distinct count and
    distinct % of non-null, detected type and pattern (PR-03). Two jobs:
    one wide aggregate, one value-frequency shuffle."""
    cols = list(cols or df.columns)
    order = pattern_order(reference_order)
    row = type_count_row(df, cols)
    base = _long(row, cols, {
        "total": lambda i: F.col("_total"),
        "null_count": lambda i: F.col(f"z{i}"),
        "inferred_type": lambda i: _type_expr(i, order, 0.9),
        "pattern": lambda i: _pattern_expr(i, order),
    })
    distinct = value_frequencies(df, cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"))
    out = base.join(distinct, "column_name", "left").fillna(0, ["distinct_count"])
    non_null = F.col("total") - F.col("null_count")
    return out.select(
        "column_name", "total", "null_count",
        F.round(safe_divide(F.col("null_count") * 100.0, F.col("total")), 6).alias("null_pct"),
        F.col("distinct_count").cast("long").alias("distinct_count"),
        F.round(safe_divide(F.col("distinct_count") * 100.0, non_null), 6).alias("distinct_pct"),
        "inferred_type", "pattern")


def _present_number(col: str) -> Column:
    """The value, or null where it is no number (null, NaN)."""
    x = F.col(col).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.col(col))


def profile_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, max, mean, median, sample std and rank quartiles
    ``sorted[n//4]``, ``sorted[3n//4]`` per numeric column (PR-04). NaN
    counts as missing in all of them, like null."""
    rows = []
    agg = df.agg(*[e for c in cols for v in [_present_number(c)] for e in (
        F.count(v).alias(f"{c}__n"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max"),
        F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__std"))]).collect()[0]
    found = ranked_values(df, cols, {"p25": lambda n: F.floor(n / 4), "p75": lambda n: F.floor(3 * n / 4),
                                     "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    for c in cols:
        n, (p25, p75, low, high) = found[c]
        if n:
            med = (low + high) / 2
        else:
            med = p25 = p75 = None
        rows.append((c, int(n), _f(agg[f"{c}__min"]), _f(agg[f"{c}__max"]), _f(agg[f"{c}__mean"]),
                     med, _f(agg[f"{c}__std"]), p25, p75))
    schema = ("column_name string, n long, min double, max double, mean double, median double, "
              "std double, p25 double, p75 double")
    return df.sparkSession.createDataFrame(rows, schema)


def _f(v):
    return None if v is None else float(v)


def profile_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, max and mean text length per column (PR-05)."""
    agg = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(F.length(c)).alias(f"a{i}"), F.max(F.length(c)).alias(f"b{i}"),
        F.avg(F.length(c)).alias(f"c{i}"))])
    return _long(agg, cols, {"min_length": lambda i: F.col(f"a{i}"),
                             "max_length": lambda i: F.col(f"b{i}"),
                             "mean_length": lambda i: F.col(f"c{i}")})


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows (rows minus distinct rows) and a size
    estimate as the sum of the text bytes of every cell (PR-06)."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns),
               F.lit(0))
    a = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(size).cast("long").alias("size_bytes"))
    dist = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    return (a.crossJoin(dist)   # both sides are single-row aggregates
            .select("row_count", F.lit(len(df.columns)).alias("column_count"),
                    (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows"),
                    "size_bytes"))


def infer_rules(profile: DataFrame, numeric: DataFrame | None = None,
                allowed: DataFrame | None = None) -> DataFrame:
    """Schema rules from a profile (PR-07): nullable when any null, unique
    when distinct % > 99, pattern, allowed values when distinct <= 20 and
    distinct % < 10 (values from ``allowed(column_name, values)``)."""
    r = profile.select(
        "column_name", "inferred_type",
        (F.col("null_count") > 0).alias("nullable"),
        (F.col("distinct_pct") > 99).alias("unique"),
        "pattern",
        ((F.col("distinct_count") <= 20) & (F.col("distinct_pct") < 10)).alias("_enum"))
    if numeric is not None:
        r = r.join(numeric.select("column_name", F.col("min").alias("min_value"),
                                  F.col("max").alias("max_value")), "column_name", "left")
    if allowed is not None:
        r = r.join(allowed, "column_name", "left").withColumn(
            "allowed_values", F.when(F.col("_enum"), F.col("values"))).drop("values")
    return r.drop("_enum")


NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType, T.BooleanType)


def column_class(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"          # booleans report numeric, as the pandas test runs first
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def eda_schema(df: DataFrame) -> DataFrame:
    """dtype, class, distinct, missing % (2 dp), modelling flag and
    min/max/mean/std for numerics (PR-08). The flag is false for derived
    date-part columns (``_year, _month, _day, _dow`` suffixes)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"z{i}"),
                 F.approx_count_distinct(c).alias(f"ad{i}")]
        if column_class(df.schema[c].dataType) == "numeric":
            x = F.col(c).cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"),
                     F.stddev_samp(x).alias(f"sd{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(k) for k in (f"mn{i}", f"mx{i}", f"av{i}", f"sd{i}")]
    row = df.agg(*aggs)
    distinct = value_frequencies(df, cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"))
    base = _long(row, cols, {
        "dtype": lambda i: F.lit(df.schema[cols[i]].dataType.simpleString()),
        "column_class": lambda i: F.lit(column_class(df.schema[cols[i]].dataType)),
        "missing_pct": lambda i: F.round(safe_divide(F.col(f"z{i}") * 100.0, F.col("_n")), 2),
        "min": lambda i: F.col(f"mn{i}"), "max": lambda i: F.col(f"mx{i}"),
        "mean": lambda i: F.col(f"av{i}"), "std": lambda i: F.col(f"sd{i}"),
    })
    out = base.join(distinct, "column_name", "left").fillna(0, ["distinct_count"])
    suffixes = ("_year", "_month", "_day", "_dow")
    flag = F.lit(True)
    for sfx in suffixes:
        flag = flag & ~F.col("column_name").endswith(sfx)
    return out.withColumn("use_for_modeling", flag)


def detect_task(df: DataFrame, target: str | None) -> DataFrame:
    """Task type and data class (PR-09)."""
    has_dt = any(column_class(f.dataType) == "datetime" for f in df.schema.fields)
    if target is None:
        task = "segmentation"
    else:
        cls = column_class(df.schema[target].dataType)
        nd = df.agg(F.countDistinct(target)).collect()[0][0]
        if cls == "numeric":
            task = "classification" if nd <= 20 else ("forecasting" if has_dt else "regression")
        else:
            task = "classification" if nd <= 20 else "segmentation"
    data_class = ("time_series" if has_dt and target is not None
                  and column_class(df.schema[target].dataType) == "numeric" else "tabular")
    return df.sparkSession.createDataFrame([(target, task, data_class)],
                                           "target string, task string, data_class string")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max, last bin closed; every bin is
    reported, empty ones with 0 (PR-10). Mid-points included."""
    x = [_present_number(c).cast("double") for c in cols]
    mm = df.agg(*[e for i, c in enumerate(x) for e in (F.min(c).alias(f"lo{i}"),
                                                       F.max(c).alias(f"hi{i}"))]).collect()[0]
    parts = []
    for i, c in enumerate(cols):
        lo, hi = mm[f"lo{i}"], mm[f"hi{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins if hi > lo else 1.0
        b = F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        counts = (df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
                  .groupBy(b.alias("bin")).count())
        allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        h = (allb.join(counts, "bin", "left").fillna(0, ["count"])
             .select(F.lit(c).alias("column_name"), "bin",
                     (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                     (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                     (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("bin_mid"),
                     F.col("count").cast("long").alias("count")))
        parts.append(h)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skewness and excess kurtosis with sample bias correction, plus n,
    missing %, min, max, mean, median, std (PR-11)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), skewness_unbiased(x).alias(f"sk{i}"),
                 kurtosis_unbiased(x).alias(f"ku{i}"), F.min(x).alias(f"mn{i}"),
                 F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    row = df.agg(*aggs)
    meds = {c: q[0] for c, q in quantiles_of(df, cols, [0.5]).items()}
    return _long(row, cols, {
        "n": lambda i: F.col(f"n{i}"),
        "missing_pct": lambda i: safe_divide((F.col("_rows") - F.col(f"n{i}")) * 100.0, F.col("_rows")),
        "skewness": lambda i: F.col(f"sk{i}"), "kurtosis": lambda i: F.col(f"ku{i}"),
        "min": lambda i: F.col(f"mn{i}"), "max": lambda i: F.col(f"mx{i}"),
        "mean": lambda i: F.col(f"av{i}"), "std": lambda i: F.col(f"sd{i}"),
        "median": lambda i: F.lit(meds[cols[i]]).cast("double"),
    })


def box_stats(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Interpolated Q1, median, Q3, IQR, min, max and share of values
    outside the whiskers (PR-12). Quartiles are exact and distributed."""
    q = quantiles_of(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, _, q3 = q[c]
        x = F.col(c).cast("double")
        iqr = q3 - q1
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.count_if((x < q1 - k * iqr) | (x > q3 + k * iqr)).alias(f"o{i}")]
    row = df.agg(*aggs)
    return _long(row, cols, {
        "q1": lambda i: F.lit(q[cols[i]][0]).cast("double"),
        "median": lambda i: F.lit(q[cols[i]][1]).cast("double"),
        "q3": lambda i: F.lit(q[cols[i]][2]).cast("double"),
        "iqr": lambda i: F.lit(q[cols[i]][2] - q[cols[i]][0]).cast("double"),
        "min": lambda i: F.col(f"mn{i}"), "max": lambda i: F.col(f"mx{i}"),
        "outlier_share": lambda i: safe_divide(F.col(f"o{i}") * 1.0, F.col(f"n{i}")),
    })


def outlier_counts(df: DataFrame, cols: Sequence[str], k: float = 1.5, z: float = 3.0) -> DataFrame:
    """IQR outliers (interpolated quartiles) and z outliers with
    ``|x - mean| / (std + 1e-9) > z`` (PR-13). Two passes: statistics,
    then one counting aggregate with the statistics as literals."""
    q = quantiles_of(df, cols, [0.25, 0.75])
    st = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(F.col(c).cast("double")).alias(f"m{i}"),
        F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}"))]).collect()[0]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q1, q3 = q[c]
        iqr = q3 - q1
        m, s = st[f"m{i}"], st[f"s{i}"] or 0.0
        aggs += [F.count_if((x < q1 - k * iqr) | (x > q3 + k * iqr)).alias(f"iq{i}"),
                 F.count_if(F.abs((x - F.lit(m)) / F.lit(s + 1e-9)) > z).alias(f"zz{i}")]
    row = df.agg(*aggs)
    return _long(row, cols, {"iqr_outliers": lambda i: F.col(f"iq{i}"),
                             "z_outliers": lambda i: F.col(f"zz{i}")})


def pearson(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Correlation matrix, long, all pairs in one aggregate (PR-14).
    Pairwise-complete rows, as in pandas."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                        (F.round(F.col(f"r{i}"), digits) + 0.0).alias("r"))   # no negative zero
               for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, avg_rank) with ties sharing the mean rank: rank = values
    before + (count + 1) / 2, from value counts and a distributed running
    count (no single-task sort)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).count()
    cs = ordered_cumsum(vc, "_v", ["count"])
    return cs.select(F.col("_v").alias(col), (F.col("count_before") + (F.col("count") + 1) / 2.0)
                     .alias(f"{col}_rank"))


def spearman(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Spearman matrix: Pearson over average ranks (PR-15). Ranks of all
    columns come from one pipeline; each column's ranks are joined back on
    the value (one row per distinct value)."""
    base = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    ranks = cut_lineage(column_index(base, cols))       # materialised once, read by every join
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    ranked = base
    for c in cols:
        ranked = ranked.join(ranks.where(F.col("column_name") == c).select(F.col("v").alias(c), rank.alias(f"{c}_rank")), c, "left")
    return pearson(ranked.select(*[F.col(f"{c}_rank").alias(c) for c in cols]), cols, digits)


def corr_summary(matrix: DataFrame, strong: float = 0.8) -> DataFrame:
    """Strongest and weakest pair by |r|, number of pairs with |r| > strong,
    mean |r| over the upper triangle (PR-16)."""
    up = matrix.where(F.col("col_a") < F.col("col_b")).withColumn("abs_r", F.abs("r"))
    pair = F.concat_ws("~", "col_a", "col_b")
    return up.agg(
        F.max_by(pair, F.struct("abs_r", F.col("col_a"), F.col("col_b"))).alias("strongest_pair"),
        F.max("abs_r").alias("strongest_abs_r"),
        F.min_by(pair, F.struct("abs_r", F.col("col_a"), F.col("col_b"))).alias("weakest_pair"),
        F.min("abs_r").alias("weakest_abs_r"),
        F.count_if(F.col("abs_r") > strong).alias("strong_pairs"),
        F.avg("abs_r").alias("mean_abs_r"))


def verdicts(stats: DataFrame) -> DataFrame:
    """Threshold labels (PR-17) for columns present in ``stats``: skewness,
    kurtosis, outlier share, r, r2, mape."""
    out = stats
    cols = set(stats.columns)
    if "skewness" in cols:
        a = F.abs("skewness")
        out = out.withColumn("skew_label", F.when(a > 1, "highly skewed")
                             .when(a > 0.5, "moderately skewed").otherwise("approximately symmetric"))
    if "kurtosis" in cols:
        out = out.withColumn("tail_label", F.when(F.col("kurtosis") > 3, "heavy tails")
                             .when(F.col("kurtosis") > 2, "moderate tails").otherwise("normal tails"))
    if "outlier_share" in cols:
        out = out.withColumn("outlier_label", F.when(F.col("outlier_share") > 0.05, "many outliers")
                             .when(F.col("outlier_share") > 0.01, "some outliers").otherwise("few outliers"))
    if "r" in cols:
        a = F.abs("r")
        out = out.withColumn("corr_label", F.when(a > 0.8, "strong").when(a > 0.5, "moderate")
                             .otherwise("weak"))
    if "r2" in cols:
        out = out.withColumn("fit_label", F.when(F.col("r2") > 0.8, "excellent")
                             .when(F.col("r2") > 0.5, "good").when(F.col("r2") > 0, "weak")
                             .otherwise("poor"))
    if "mape" in cols:
        out = out.withColumn("mape_label", F.when(F.col("mape") < 10, "highly accurate")
                             .when(F.col("mape") < 20, "good").when(F.col("mape") < 50, "reasonable")
                             .otherwise("inaccurate"))
    return out
