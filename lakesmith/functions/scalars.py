"""Scalar expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- null model --------------------------------------------------------------
# Three named predicates: missing = null or empty text; blank = missing or
# only whitespace; null token = blank or the words "nan" / "None".

def trim_all(c: str | Column) -> Column:
    """Strip every kind of leading/trailing whitespace (``trim`` only
    strips spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def is_missing(c: str | Column) -> Column:
    col = _c(c)
    return col.isNull() | (col.cast("string") == F.lit(""))


def is_blank(c: str | Column) -> Column:
    col = _c(c)
    return col.isNull() | (trim_all(col.cast("string")) == F.lit(""))


def is_null_token(c: str | Column) -> Column:
    col = _c(c)
    return is_blank(col) | trim_all(col.cast("string")).isin("nan", "None")


# --- arithmetic ------------------------------------------------------------------

def safe_divide(n: str | Column, d: str | Column, default=0) -> Column:
    """``n / d``, or ``default`` when ``d`` is null or zero."""
    den = _c(d)
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(_c(n) / den)


def cents_to_dollars(c: str | Column, scale: int = 2) -> Column:
    return F.round(_c(c) / 100, scale).cast(f"decimal(16,{scale})")


# --- keys and hashes ---------------------------------------------------------
# concat_ws skips nulls (so null and absent collide) and concat returns null
# when any part is null; a sentinel keeps null distinct from every text.
NULL_SENTINEL = "\u0000"


def surrogate_key(*cols: str | Column, sep: str = "|") -> Column:
    """md5 over the key columns, null-safe."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_SENTINEL)) for c in cols]
    return F.md5(F.concat_ws(sep, *parts))


def row_hash(*cols: str | Column) -> Column:
    """Change-detection hash of attribute columns (same rule as the key)."""
    return surrogate_key(*cols)


# --- moments -------------------------------------------------------------------

def skewness_unbiased(c: str | Column) -> Column:
    """Sample skewness with bias correction (pandas / DuckDB definition);
    Spark's ``skewness`` is the population moment."""
    n = F.count(_c(c)).cast("double")
    g1 = F.skewness(_c(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_unbiased(c: str | Column) -> Column:
    """Excess kurtosis with sample bias correction."""
    n = F.count(_c(c)).cast("double")
    g2 = F.kurtosis(_c(c))
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


# --- vectors -------------------------------------------------------------------

def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two numeric arrays (null when a norm is 0)."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


# --- time ----------------------------------------------------------------------

def epoch_micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp read as wall clock (NTZ
    arithmetic: monotonic and independent of the session time zone)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(c).cast("timestamp_ntz"))


def micros_between(a: str | Column, b: str | Column) -> Column:
    """Microseconds from ``a`` to ``b`` on the wall clock."""
    return epoch_micros(b) - epoch_micros(a)
