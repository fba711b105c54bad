"""Data-quality rules and contracts.

Rules are data: a :class:`RowRule` holds a Catalyst predicate that is true
for a *failing* row. :func:`evaluate_row_rules` fuses any number of row
rules over one table into a single aggregate (one scan), and gathers at
most ``samples`` business keys per rule in a second, group-limited pass.
Set rules (uniqueness, keys, outliers, relationships) are each one
aggregate or anti join. Every check returns rows of :data:`RESULT_SCHEMA`,
passes included, so summaries and scores are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import rank_quantiles_of
from ..functions.scalars import micros_between, safe_divide, trim_all
from ..plans.scale import broadcast_if_small, spread
from .profile import BOOL_WORDS, FLOAT_RE, INT_RE, TYPE_PATTERNS

RESULT_COLUMNS = ["check_name", "column_name", "passed", "severity", "expected", "actual",
                  "failed_count", "sample_keys"]
RESULT_SCHEMA = ("check_name string, column_name string, passed boolean, severity string, "
                 "expected string, actual double, failed_count bigint, sample_keys array<string>")


@dataclass
class RowRule:
    """``fail`` is true on rows that break the rule; ``applies`` narrows the
    rows the rule is evaluated on (default: all)."""
    check: str
    column: str | None
    fail: Column
    severity: str = "error"
    expected: str = ""
    applies: Column | None = None
    mostly: float = 1.0


def text(c: str) -> Column:
    return F.col(c).cast("string")


def present(c: str) -> Column:
    """Not null and not empty text (the validator's null model)."""
    return F.col(c).isNotNull() & (text(c) != "")


def as_number(c: str, dtype=None) -> Column:
    """Float value of text that Python ``float()`` accepts, else null.
    Columns that are already numeric are cast directly (no text round
    trip); pass the column's data type to take that path."""
    from pyspark.sql import types as T
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                          T.DecimalType)):
        return F.col(c).cast("double")
    t = F.lower(trim_all(text(c)))
    ok = t.rlike("(?i)" + FLOAT_RE)
    clean = F.regexp_replace(t, "_", "")
    inf = F.regexp_replace(clean, "^([+-]?)inf(inity)?$", "$1Infinity")
    return F.when(ok, F.when(clean.rlike("nan$"), F.lit("NaN")).otherwise(inf).try_cast("double"))


def empty_results(spark) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


def _result(df_one_row: DataFrame, check: str, column: str | None, passed: Column, severity: str,
            expected: str, actual: Column, failed: Column) -> DataFrame:
    return df_one_row.select(
        F.lit(check).alias("check_name"), F.lit(column).cast("string").alias("column_name"),
        passed.alias("passed"), F.lit(severity).alias("severity"), F.lit(expected).alias("expected"),
        actual.cast("double").alias("actual"), failed.cast("long").alias("failed_count"),
        F.array().cast("array<string>").alias("sample_keys"))


def evaluate_row_rules(df: DataFrame, rules: Sequence[RowRule], key: str | None = None,
                       samples: int = 100) -> DataFrame:
    """All row rules of one table in one aggregate; sample keys (smallest
    first, at most ``samples`` per rule) in one group-limited pass.

    ``actual`` is the failing share of the applicable rows; a rule passes
    when the success share is at least ``mostly``."""
    aggs = []
    for i, r in enumerate(rules):
        app = r.applies if r.applies is not None else F.lit(True)
        aggs += [F.count_if(app & r.fail).alias(f"f{i}"), F.count_if(app).alias(f"a{i}")]
    df = spread(df)
    row = df.agg(*aggs)
    parts = []
    for i, r in enumerate(rules):
        f, a = F.col(f"f{i}"), F.col(f"a{i}")
        share_ok = F.when(a == 0, F.lit(1.0)).otherwise(1 - f / a)
        parts.append(F.struct(
            F.lit(i).alias("rule_no"), F.lit(r.check).alias("check_name"),
            F.lit(r.column).cast("string").alias("column_name"),
            (share_ok >= F.lit(r.mostly)).alias("passed"), F.lit(r.severity).alias("severity"),
            F.lit(r.expected).alias("expected"),
            F.when(a == 0, F.lit(0.0)).otherwise(f / a).alias("actual"), f.cast("long").alias("failed_count")))
    res = row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    if key is None or samples <= 0:
        return res.withColumn("sample_keys", F.array().cast("array<string>")).drop("rule_no")
    failing = F.array_compact(F.array(*[
        F.when((r.applies if r.applies is not None else F.lit(True)) & r.fail, F.lit(i))
        for i, r in enumerate(rules)]))
    hits = (df.select(F.col(key).alias("_k"), F.explode(failing).alias("rule_no"))
            .withColumn("_rn", F.row_number().over(Window.partitionBy("rule_no").orderBy("_k")))
            .where(F.col("_rn") <= samples)
            .groupBy("rule_no")
            .agg(F.array_sort(F.collect_list(F.struct("_rn", F.col("_k").cast("string").alias("k"))))
                 .alias("_ks"))
            .select("rule_no", F.transform("_ks", lambda s: s["k"]).alias("sample_keys")))
    return (res.join(F.broadcast(hits), "rule_no", "left")   # one row per rule
            .withColumn("sample_keys", F.coalesce("sample_keys", F.array().cast("array<string>")))
            .drop("rule_no"))


# ------------------------------------------------------------- row rules

def not_null_rule(col: str, blank: bool = False) -> RowRule:
    """DQ-03: null or empty text fails (``blank``: also whitespace only)."""
    fail = ~present(col) if not blank else (F.col(col).isNull() | (trim_all(text(col)) == ""))
    return RowRule("not_null", col, fail, "error", "no nulls")


TYPE_CHECKS = {
    "integer": lambda t: trim_all(t).rlike(INT_RE),
    "float": lambda t: trim_all(t).rlike("(?i)" + FLOAT_RE),
    "boolean": lambda t: F.lower(t).isin(*BOOL_WORDS),
    "email": lambda t: t.rlike("(?i)" + TYPE_PATTERNS["email"]),
    "uuid": lambda t: t.rlike("(?i)" + TYPE_PATTERNS["uuid"]),
    "date": lambda t: t.rlike(TYPE_PATTERNS["date_iso"]),
    "datetime": lambda t: t.rlike(TYPE_PATTERNS["datetime_iso"]),
}


def type_rule(col: str, typ: str) -> RowRule:
    """DQ-06: text conformance by pattern (not ``try_cast``, whose accepted
    forms differ between engines). Unknown types accept every value."""
    check = TYPE_CHECKS.get({"date_iso": "date", "datetime_iso": "datetime"}.get(typ, typ))
    fail = ~check(text(col)) if check else F.lit(False)
    return RowRule("data_type", col, fail, "error", typ, applies=present(col))


def range_rule(col: str, lo: float | None, hi: float | None) -> RowRule:
    """DQ-07: values that parse as numbers must lie in [lo, hi]; NaN never
    fails (it compares false in Python), unparsable values are ignored."""
    x = as_number(col)
    fail = F.lit(False)
    if lo is not None:
        fail = fail | (x < lo)
    if hi is not None:
        fail = fail | (x > hi)
    return RowRule("value_range", col, fail & ~F.isnan(x), "error", f"[{lo}, {hi}]",
                   applies=present(col))


def length_rule(col: str, lo: int | None, hi: int | None) -> RowRule:
    """DQ-08: text length in range (warning)."""
    n = F.length(text(col))
    fail = F.lit(False)
    if lo is not None:
        fail = fail | (n < lo)
    if hi is not None:
        fail = fail | (n > hi)
    return RowRule("string_length", col, fail, "warning", f"length [{lo}, {hi}]",
                   applies=present(col))


def pattern_rule(col: str, regex: str) -> RowRule:
    """DQ-09: the value must match from its start."""
    return RowRule("pattern_match", col, ~text(col).rlike(f"^(?:{regex})"), "error",
                   f"matches {regex}", applies=present(col))


def in_set_rule(col: str, values: Sequence) -> RowRule:
    """DQ-10: allowed values, compared as text."""
    return RowRule("allowed_values", col, ~text(col).isin([str(v) for v in values]), "error",
                   f"one of {list(values)}", applies=present(col))


def format_rule(col: str, kind: str) -> RowRule:
    """DQ-13: email (every row; missing is empty text and fails), http(s)
    URL (blank allowed), real ``YYYY-MM-DD`` calendar date."""
    t = F.coalesce(text(col), F.lit(""))
    if kind == "email":
        return RowRule("email_format", col, ~t.rlike(TYPE_PATTERNS["email"]), "error", "email")
    if kind == "url":
        return RowRule("url_format", col, (trim_all(t) != "") & ~t.rlike(TYPE_PATTERNS["url"]),
                       "error", "http(s) url")
    if kind == "date":
        ok = t.rlike(TYPE_PATTERNS["date_iso"]) & F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).isNotNull()
        return RowRule("date_format", col, ~ok, "error", "YYYY-MM-DD")
    raise ValueError(kind)


def accepted_range_rule(col: str, lo, hi, inclusive: bool = True, where: str | None = None) -> RowRule:
    """DQ-24: accepted range with inclusive flag and optional row condition."""
    x = F.col(col)
    ok = (x >= lo) & (x <= hi) if inclusive else (x > lo) & (x < hi)
    app = F.col(col).isNotNull() & (F.expr(where) if where else F.lit(True))
    return RowRule("accepted_range", col, ~ok, "error", f"{'[' if inclusive else '('}{lo}, {hi}"
                   f"{']' if inclusive else ')'}", applies=app)


def expression_rule(name: str, sql: str) -> RowRule:
    """DQ-22: a boolean SQL expression that must hold for every row."""
    return RowRule(name, None, ~F.coalesce(F.expr(sql), F.lit(False)), "error", sql)


# ----------------------------------------------------------- table rules

def check_row_count(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """DQ-01: non-empty (error), below min (error), above max (warning)."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    out = _result(n, "data_not_empty", None, F.col("n") > 0, "error", "non-empty dataset",
                  F.col("n"), F.when(F.col("n") > 0, 0).otherwise(1))
    if lo is not None:
        out = out.unionByName(_result(n, "row_count_min", None, F.col("n") >= lo, "error", f">= {lo}",
                                      F.col("n"), F.when(F.col("n") >= lo, 0).otherwise(1)))
    if hi is not None:
        out = out.unionByName(_result(n, "row_count_max", None, F.col("n") <= hi, "warning", f"<= {hi}",
                                      F.col("n"), F.when(F.col("n") <= hi, 0).otherwise(1)))
    return out


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """DQ-02: expected columns present (schema lookup, no job)."""
    rows = [("column_exists", c, c in df.columns, "error", "column present",
             1.0 if c in df.columns else 0.0, 0 if c in df.columns else 1, [])
            for c in expected]
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def check_unique(df: DataFrame, cols: Sequence[str], variant: str = "validator",
                 where: str | None = None) -> DataFrame:
    """DQ-04 / DQ-26. ``validator``: duplicates = non-null values minus
    distinct values. ``qc``: number of distinct values seen more than once
    (empty text counts as a value). All columns in one shuffle."""
    d = df.where(F.expr(where)) if where else df
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), text(c).alias("v")) for c in cols])
    cells = d.select(F.explode(arr).alias("s")).select("s.*")
    if variant == "validator":
        cells = cells.where(F.col("v").isNotNull() & (F.col("v") != ""))
    else:
        cells = cells.withColumn("v", F.coalesce("v", F.lit("")))
    g = cells.groupBy("column_name", "v").count()
    per = g.groupBy("column_name").agg(
        (F.sum("count") - F.count(F.lit(1))).alias("dups"),
        F.count_if(F.col("count") > 1).alias("repeated"))
    allc = d.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    per = allc.join(per, "column_name", "left").fillna(0, ["dups", "repeated"])
    measure = F.col("dups") if variant == "validator" else F.col("repeated")
    return per.select(F.lit("unique").alias("check_name"), "column_name", (measure == 0).alias("passed"),
                      F.lit("error").alias("severity"), F.lit("all unique").alias("expected"),
                      measure.cast("double").alias("actual"), measure.cast("long").alias("failed_count"),
                      F.array().cast("array<string>").alias("sample_keys"))


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ-05: number of key combinations seen more than once (null is a
    value)."""
    dup = (df.groupBy(*keys).count().where(F.col("count") > 1)
           .agg(F.count(F.lit(1)).alias("d")))
    return _result(dup, "primary_key_unique", ",".join(keys), F.col("d") == 0, "error", "all unique",
                   F.col("d"), F.col("d"))


def _numeric_values(df: DataFrame, col: str) -> DataFrame:
    x = as_number(col, df.schema[col].dataType)
    return df.select(x.alias("x")).where(x.isNotNull())


def check_zscore(df: DataFrame, cols: Sequence[str], z: float = 3.0, key: str | None = None) -> DataFrame:
    """DQ-11: |x - mean| / sample sd > z; needs at least 10 values and sd > 0."""
    parts = []
    numbers = {c: as_number(c, df.schema[c].dataType) for c in cols}
    st = df.agg(*[e for i, x in enumerate(numbers.values()) for e in (
        F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"))]).first()
    for i, (c, x) in enumerate(numbers.items()):
        if st[f"n{i}"] < 10 or not st[f"s{i}"]:
            continue
        zx = F.abs((x - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"]))
        parts.append(RowRule("z_score_outlier", c, zx > z, "warning", f"z-score <= {z}",
                             applies=x.isNotNull()))
    if not parts:
        return empty_results(df.sparkSession)
    return evaluate_row_rules(df, parts, key)


def check_iqr(df: DataFrame, cols: Sequence[str], k: float = 1.5, key: str | None = None) -> DataFrame:
    """DQ-12: outside [q1 - k iqr, q3 + k iqr] with rank quartiles; n >= 10."""
    parts = []
    numbers = {c: as_number(c, df.schema[c].dataType) for c in cols}
    for c, (n, quartiles) in rank_quantiles_of(df, numbers, [(1, 4), (3, 4)]).items():
        if n < 10:
            continue
        (q1, q3), x = quartiles, numbers[c]
        iqr = q3 - q1
        parts.append(RowRule("iqr_outlier", c, (x < q1 - k * iqr) | (x > q3 + k * iqr), "warning",
                             f"value in [{q1 - k * iqr:.2f}, {q3 + k * iqr:.2f}]",
                             applies=x.isNotNull()))
    if not parts:
        return empty_results(df.sparkSession)
    return evaluate_row_rules(df, parts, key)


# Phone style classes, tested in this order.
PHONE_STYLES = ["international", "001-prefix", "dot-separated", "dash-separated", "plain"]


def phone_style(c: str) -> Column:
    p = F.coalesce(text(c), F.lit(""))
    return (F.when(p.startswith("+"), "international").when(p.startswith("001"), "001-prefix")
            .when(p.contains("."), "dot-separated").when(p.contains("-"), "dash-separated")
            .otherwise("plain"))


def phone_styles(df: DataFrame, col: str) -> DataFrame:
    """DQ-14: style mix; dominant style (ties by name), its share of all
    rows (2 dp), PASS when at most two styles occur else WARN."""
    g = df.groupBy(phone_style(col).alias("style")).count()       # at most five rows
    top = g.orderBy(F.desc("count"), F.asc("style")).limit(1)
    tot = g.agg(F.count(F.lit(1)).alias("formats_found"), F.sum("count").alias("_n"))
    return top.crossJoin(tot).select(
        "formats_found", F.col("style").alias("dominant_format"),
        F.round(F.col("count") * 100.0 / F.col("_n"), 2).alias("consistency_percentage"),
        F.when(F.col("formats_found") <= 2, "PASS").otherwise("WARN").alias("status"))


def freshness_span(df: DataFrame, col: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """DQ-15: oldest, latest and span in days of the values that parse as
    dates; FAIL when none parse."""
    t = text(col)
    d = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.to_date(F.try_to_timestamp(t, F.lit(fmt))))
    return df.agg(F.min(d).alias("oldest_record"), F.max(d).alias("latest_record")).select(
        F.when(F.col("latest_record").isNull(), "FAIL").otherwise("INFO").alias("status"),
        "oldest_record", "latest_record",
        F.datediff("latest_record", "oldest_record").alias("date_range_days"))


def preload_gate(df: DataFrame, null_share: float = 0.5) -> DataFrame:
    """DQ-16: row count (PASS when rows), columns over 50% null (WARN),
    duplicate rows (WARN), type summary (INFO); overall PASS only when
    every check is PASS or INFO. One aggregate plus one distinct count."""
    cols = df.columns
    a = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)])
    dist = df.distinct().agg(F.count(F.lit(1)).alias("d"))
    high = F.size(F.array_compact(F.array(*[
        F.when(F.col(f"z{i}") > F.col("n") * null_share, F.lit(c)) for i, c in enumerate(cols)])))
    j = a.crossJoin(dist)   # two single-row aggregates
    def chk(name, status, value):
        return F.struct(F.lit(name).alias("check"), status.alias("status"),
                        value.cast("double").alias("value"))
    checks = j.select(F.explode(F.array(
        chk("row_count", F.when(F.col("n") > 0, "PASS").otherwise("FAIL"), F.col("n")),
        chk("high_null_columns", F.when(high == 0, "PASS").otherwise("WARN"), high),
        chk("duplicate_rows", F.when(F.col("n") == F.col("d"), "PASS").otherwise("WARN"),
            F.col("n") - F.col("d")),
        chk("type_summary", F.lit("INFO"), F.lit(len(cols))))).alias("s"))
    checks = checks.select("s.*")
    overall = checks.agg(F.when(F.bool_and(F.col("status").isin("PASS", "INFO")), "PASS")
                         .otherwise("FAIL").alias("status")) \
        .select(F.lit("overall").alias("check"), "status", F.lit(None).cast("double").alias("value"))
    return checks.unionByName(overall)


def check_column_set(df: DataFrame, cols: Sequence[str], exact_order: bool = False) -> DataFrame:
    """DQ-19: the column set (or ordered list) equals the expected one."""
    ok = list(df.columns) == list(cols) if exact_order else set(df.columns) == set(cols)
    return df.sparkSession.createDataFrame(
        [("column_set", None, ok, "error", ",".join(cols), 1.0 if ok else 0.0, 0 if ok else 1, [])],
        RESULT_SCHEMA)


def check_stat_between(df: DataFrame, col: str, stat: str, lo=None, hi=None) -> DataFrame:
    """DQ-20: mean / max / min of a column within [lo, hi]."""
    v = df.agg(getattr(F, {"mean": "avg"}.get(stat, stat))(col).alias("v"))
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col("v") >= lo)
    if hi is not None:
        ok = ok & (F.col("v") <= hi)
    ok = F.coalesce(ok, F.lit(False))
    return _result(v, f"{stat}_between", col, ok, "error", f"[{lo}, {hi}]", F.col("v"),
                   F.when(ok, 0).otherwise(1))


def check_pair_in_set(df: DataFrame, a: str, b: str, pairs: Sequence[tuple]) -> DataFrame:
    """DQ-21: (a, b) must be one of the allowed pairs; the pair list is a
    parameter (bounded), broadcast to an anti join."""
    allowed = df.sparkSession.createDataFrame([(str(x), str(y)) for x, y in pairs], "_a string, _b string")
    bad = (df.select(text(a).alias("_a"), text(b).alias("_b"))
           .join(F.broadcast(allowed), ["_a", "_b"], "left_anti")
           .agg(F.count(F.lit(1)).alias("f")))
    return _result(bad, "pair_in_set", f"{a},{b}", F.col("f") == 0, "error", f"{len(pairs)} pairs",
                   F.col("f"), F.col("f"))


def check_equal_rowcount(a: DataFrame, b: DataFrame) -> DataFrame:
    """DQ-22: both tables hold the same number of rows."""
    j = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    return _result(j, "equal_row_count", None, F.col("na") == F.col("nb"), "error", "equal",
                   F.col("na") - F.col("nb"), F.abs(F.col("na") - F.col("nb")))


def check_recency(df: DataFrame, col: str, hours: float, as_of: str) -> DataFrame:
    """DQ-23: the latest value lies within ``hours`` of ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    m = df.agg(F.max(F.col(col).cast("timestamp_ntz")).alias("m"))
    age_h = micros_between(F.col("m"), now) / 3.6e9
    ok = F.coalesce(age_h <= hours, F.lit(False))
    return _result(m, "recency", col, ok, "error", f"<= {hours} h", age_h, F.when(ok, 0).otherwise(1))


def check_relationship(child: DataFrame, ck: str, parent: DataFrame, pk: str) -> DataFrame:
    """DQ-25: orphan child keys (anti join), severity warning."""
    p = parent.select(F.col(pk).alias("_pk")).where(F.col("_pk").isNotNull()).distinct()
    o = (child.where(F.col(ck).isNotNull()).join(p, F.col(ck) == F.col("_pk"), "left_anti")
         .agg(F.count(F.lit(1)).alias("f")))
    return _result(o, "relationship", ck, F.col("f") == 0, "warning", f"references {pk}",
                   F.col("f"), F.col("f"))


def rate_checks(df: DataFrame, col: str, max_null_rate: float | None = None,
                max_dup_rate: float | None = None, lo=None, hi=None,
                max_range_rate: float | None = None) -> DataFrame:
    """DQ-27: null rate, duplicate rate = 1 - distinct / total (nulls are
    missing from distinct), range violation rate, each against a limit."""
    x = F.col(col)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("z"),
               F.countDistinct(x).alias("d"),
               F.count_if((x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)).alias("r"))
    out = []
    if max_null_rate is not None:
        rate = safe_divide(F.col("z"), F.col("n"))
        out.append(_result(a, "null_rate", col, rate <= max_null_rate, "error", f"<= {max_null_rate}",
                           rate, F.col("z")))
    if max_dup_rate is not None:
        rate = 1 - safe_divide(F.col("d"), F.col("n"), 1.0)
        out.append(_result(a, "duplicate_rate", col, rate <= max_dup_rate, "error", f"<= {max_dup_rate}",
                           rate, F.col("n") - F.col("d")))
    if max_range_rate is not None:
        rate = safe_divide(F.col("r"), F.col("n"))
        out.append(_result(a, "range_violation_rate", col, rate <= max_range_rate, "error",
                           f"<= {max_range_rate}", rate, F.col("r")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def run_checks(df: DataFrame, checks: Sequence[tuple[str, str, object]]) -> tuple[DataFrame, DataFrame]:
    """DQ-28: run named checks ``(name, severity, fn(df) -> results)``. A
    check whose analysis fails is recorded failed with actual -1. Returns
    (results, summary: total, passed, failed, success_rate,
    critical_failures, overall_passed)."""
    spark = df.sparkSession
    parts = []
    for name, severity, fn in checks:
        try:
            r = fn(df)
            r.schema  # noqa: B018  (forces analysis)
            parts.append(r.withColumn("severity", F.lit(severity)).withColumn("check_name", F.lit(name)))
        except Exception:  # analysis error -> failed record
            parts.append(spark.createDataFrame(
                [(name, None, False, severity, "runs", -1.0, -1, [])], RESULT_SCHEMA))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    summary = res.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures"))
    summary = (summary.withColumn("success_rate", F.round(safe_divide(F.col("passed") * 100.0,
                                                                      F.col("total")), 6))
               .withColumn("overall_passed", F.col("critical_failures") == 0))
    return res, summary


def summarize(results: DataFrame) -> DataFrame:
    """DQ-35: totals over a result frame."""
    return results.agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("warnings"))


def quality_score(profile: DataFrame, results: DataFrame, reference_score: bool = False) -> DataFrame:
    """DQ-29: completeness = 100 - mean null %; uniqueness = mean distinct %
    of columns above 90 (100 when none); validity = share of passed
    error-level checks; consistency = share of passed warning-level checks;
    accuracy = min(100, 50 + 50 x patterned / columns); overall weighted
    .25 .15 .30 .20 .10. ``reference_score``: validity is 100 when no error
    failed else 0, as when results list only failures."""
    p = profile.agg(
        (100 - F.avg("null_pct")).alias("completeness"),
        F.coalesce(F.avg(F.when(F.col("distinct_pct") > 90, F.col("distinct_pct"))), F.lit(100.0))
        .alias("uniqueness"),
        F.least(F.lit(100.0), 50 + 50 * F.count("pattern") / F.count(F.lit(1))).alias("accuracy"))
    r = results.agg(
        F.count_if(F.col("severity") == "error").alias("e_n"),
        F.count_if((F.col("severity") == "error") & F.col("passed")).alias("e_ok"),
        F.count_if(F.col("severity") == "warning").alias("w_n"),
        F.count_if((F.col("severity") == "warning") & F.col("passed")).alias("w_ok"))
    if reference_score:
        validity = F.when(F.col("e_ok") == F.col("e_n"), 100.0).otherwise(0.0)
    else:
        validity = F.when(F.col("e_n") == 0, 100.0).otherwise(F.col("e_ok") * 100.0 / F.col("e_n"))
    consistency = F.when(F.col("w_n") == 0, 100.0).otherwise(F.col("w_ok") * 100.0 / F.col("w_n"))
    j = p.crossJoin(r).select("completeness", "uniqueness", validity.alias("validity"),
                              consistency.alias("consistency"), "accuracy")
    return j.withColumn("overall", F.col("completeness") * 0.25 + F.col("uniqueness") * 0.15
                        + F.col("validity") * 0.30 + F.col("consistency") * 0.20
                        + F.col("accuracy") * 0.10)


# ----------------------------------------------------------- suites (DQ-17/18)

def generate_suite(profile: DataFrame, row_count: int) -> DataFrame:
    """DQ-17: expectations from a column profile, as rows
    ``(expectation, column_name, params, mostly)``: not-null (<1% null
    strict; <50% with mostly = 1 - 1.5 x null share), unique when distinct %
    > 99, row count 0.5x..2x."""
    p = profile
    share = F.col("null_pct") / 100
    nn = p.where(share < 0.5).select(
        F.lit("expect_column_values_to_not_be_null").alias("expectation"), "column_name",
        F.lit("").alias("params"),
        F.when(share < 0.01, 1.0).otherwise(F.round(1 - 1.5 * share, 4)).alias("mostly"))
    uq = p.where(F.col("distinct_pct") > 99).select(
        F.lit("expect_column_values_to_be_unique").alias("expectation"), "column_name",
        F.lit("").alias("params"), F.lit(1.0).alias("mostly"))
    rc = p.sparkSession.createDataFrame(
        [("expect_table_row_count_to_be_between", None,
          f"{int(row_count * 0.5)}..{int(row_count * 2)}", 1.0)],
        "expectation string, column_name string, params string, mostly double")
    return nn.unionByName(uq).unionByName(rc)


def evaluate_suite(df: DataFrame, rules: Sequence[RowRule], key: str | None = None,
                   samples: int = 100) -> DataFrame:
    """DQ-18: each rule passes when its success share is at least its
    ``mostly``; all rules in one aggregate."""
    return evaluate_row_rules(df, rules, key, samples)


# ------------------------------------------------------------- contracts

def check_contract_volume(df: DataFrame, ts_col: str, min_rows: int | None, max_rows: int | None,
                          daily_min: int | None = None, daily_max: int | None = None,
                          max_deviation: float = 0.5) -> DataFrame:
    """DQ-31: per-day volume with min/max and deviation from the mean daily
    volume (> 50% flagged). ``min_rows`` and ``max_rows`` bound the whole
    table: columns total_rows, below_min_rows and above_max_rows."""
    daily = df.groupBy(F.to_date(ts_col).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(F.lit(0))  # one row per day: thousands of rows at most
    d = daily.withColumn("mean_rows", F.avg("rows").over(w))
    dev = F.abs(F.col("rows") - F.col("mean_rows")) / F.col("mean_rows")
    out = d.withColumn("deviation", dev).withColumn("deviation_flag", dev > max_deviation)
    if daily_min is not None:
        out = out.withColumn("below_min", F.col("rows") < daily_min)
    if daily_max is not None:
        out = out.withColumn("above_max", F.col("rows") > daily_max)
    total = F.sum("rows").over(w)
    if min_rows is not None or max_rows is not None:
        out = out.withColumn("total_rows", total)
    if min_rows is not None:
        out = out.withColumn("below_min_rows", F.col("total_rows") < min_rows)
    if max_rows is not None:
        out = out.withColumn("above_max_rows", F.col("total_rows") > max_rows)
    return out


def validate_json(df: DataFrame, col: str, schema: str, required: Sequence[str],
                  enums: dict[str, Sequence] | None = None, minimums: dict[str, float] | None = None,
                  key: str | None = None) -> DataFrame:
    """DQ-33: parse JSON text against a DDL schema; per record list the
    violated rules (unparsable, required missing, enum, minimum)."""
    parsed = df.withColumn("_j", F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"}))
    errs = [F.when(F.col("_j").isNull() & F.col(col).isNotNull(), F.lit("unparsable"))]
    for r in required:
        errs.append(F.when(F.col(f"_j.{r}").isNull(), F.lit(f"required:{r}")))
    for f, vals in (enums or {}).items():
        errs.append(F.when(~F.col(f"_j.{f}").isin(list(vals)), F.lit(f"enum:{f}")))
    for f, lo in (minimums or {}).items():
        errs.append(F.when(F.col(f"_j.{f}") < lo, F.lit(f"minimum:{f}")))
    out = parsed.withColumn("errors", F.array_compact(F.array(*errs)))
    keep = [key] if key else []
    return out.select(*keep, "errors", (F.size("errors") == 0).alias("valid"))


def contract_diff(old: DataFrame, new: DataFrame, consumers: DataFrame | None = None) -> DataFrame:
    """DQ-34: compare two field tables ``(field, type, required,
    enum_values array)``: removed required field, type change = breaking;
    new optional field, enum value added = non-breaking. With
    ``consumers(consumer, required_fields array)`` the breaking fields
    each consumer depends on are listed."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    j = o.join(n, F.col("o_field") == F.col("n_field"), "full_outer")
    field = F.coalesce("o_field", "n_field")
    change = (F.when(F.col("n_field").isNull(), "field_removed")
              .when(F.col("o_field").isNull(), F.when(F.col("n_required"), "required_field_added")
                    .otherwise("optional_field_added"))
              .when(F.col("o_type") != F.col("n_type"), "type_changed")
              .when(F.size(F.array_except("n_enum_values", "o_enum_values")) > 0, "enum_value_added")
              .when(F.size(F.array_except("o_enum_values", "n_enum_values")) > 0, "enum_value_removed"))
    breaking = (F.col("change").isin("type_changed", "required_field_added", "enum_value_removed")
                | ((F.col("change") == "field_removed") & F.coalesce("o_required", F.lit(False))))
    d = (j.select(field.alias("field"), change.alias("change"), "o_required").where(F.col("change").isNotNull())
         .select("field", "change", breaking.alias("breaking")))
    if consumers is None:
        return d
    brk = d.where("breaking").agg(F.collect_set("field").alias("_b"))   # fields of one contract
    return consumers.crossJoin(brk).select(
        "consumer", F.array_sort(F.array_intersect("required_fields", "_b")).alias("impacted_fields"))


# ------------------------------------------------------------- quarantine

def failed_rules(rules: Sequence[RowRule]) -> Column:
    """Names of the rules that a row fails, in the order given."""
    return F.array_compact(F.array(*[
        F.when(r.fail & (r.applies if r.applies is not None else F.lit(True)),
               F.lit(r.check + (f":{r.column}" if r.column else ""))) for r in rules]))


def split_quarantine(df: DataFrame, rules: Sequence[RowRule], max_retries: int = 3,
                     as_of: str | None = None, retry_col: str = "retry_count") -> tuple[DataFrame, DataFrame]:
    """DQ-36: good rows and quarantined rows; quarantined rows carry the
    failed rule names, error type, message, time and retry count, and are
    retryable while the count is below ``max_retries``. Both outputs come
    from one tagged frame (persist it when both are written)."""
    tagged = df.withColumn("_failed", failed_rules(rules))
    good = tagged.where(F.size("_failed") == 0).drop("_failed")
    retry = F.coalesce(F.col(retry_col), F.lit(0)) if retry_col in df.columns else F.lit(0)
    bad = (tagged.where(F.size("_failed") > 0)
           .withColumn("failed_rules", F.col("_failed")).drop("_failed")
           .withColumn("error_type", F.lit("validation_error"))
           .withColumn("error_message", F.concat(F.lit("failed: "), F.array_join("failed_rules", ", ")))
           .withColumn("quarantined_at", F.lit(as_of).cast("timestamp_ntz") if as_of
                       else F.current_timestamp().cast("timestamp_ntz"))
           .withColumn(retry_col, retry)
           .withColumn("retryable", retry < max_retries))
    return good, bad


def pair_frame(df_with_pairs: DataFrame) -> DataFrame:
    return broadcast_if_small(df_with_pairs, 100_000)


# Compatible logical type groups for contract checks.
TYPE_GROUPS = {
    "numeric": ["integer", "float", "number", "decimal", "int", "double"],
    "string": ["string", "email", "uuid", "phone", "url", "ipv4", "credit_card", "text"],
    "boolean": ["boolean", "bool"],
    "date": ["date", "date_iso"],
    "datetime": ["datetime", "datetime_iso", "timestamp"],
}


def type_group(t: str) -> str:
    for g, members in TYPE_GROUPS.items():
        if t in members:
            return g
    return "string"


def check_contract_schema(df: DataFrame, contract: Sequence[dict], reference_order: bool = True) -> DataFrame:
    """DQ-30: for each contract field ``{name, type, required}``: column
    present, detected type in the same group as the declared type, and no
    nulls when required. One type-detection aggregate and one null
    aggregate over the present columns."""
    from .profile import detect_types
    spark = df.sparkSession
    present_cols = [f["name"] for f in contract if f["name"] in df.columns]
    detected = {}
    if present_cols:
        detected = {r.column_name: r.inferred_type
                    for r in detect_types(df, present_cols, reference_order=reference_order).collect()}
        nulls = df.agg(*[F.count_if(~present(c)).alias(c) for c in present_cols]).collect()[0]
    rows = []
    for f in contract:
        name, typ, req = f["name"], f.get("type", "string"), bool(f.get("required", False))
        if name not in df.columns:
            rows.append(("column_exists", name, False, "error", "column present", 0.0, 1, []))
            continue
        d = detected[name]
        ok = type_group(d) == type_group(typ)
        rows.append(("type_compatible", name, ok, "error", typ, 1.0 if ok else 0.0, 0 if ok else 1, [d]))
        if req:
            n = int(nulls[name])
            rows.append(("not_null", name, n == 0, "error", "no nulls", float(n), n, []))
    return spark.createDataFrame(rows, RESULT_SCHEMA)
