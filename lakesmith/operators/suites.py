"""Expectation suites as data (DQ-17, DQ-18): a profile writes a suite, a
table of expectations; any such table is evaluated on a frame in one
aggregate for all row and table expectations and one count by value for all
unique columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import profile as P
from .rules import as_number, present, range_rule, text, type_rule

SUITE_SCHEMA = ("expectation string, column_name string, min_value double, max_value double, value_set array<string>, "
                "pattern string, mostly double")
# The e-mail pattern and the date layout of generated suites.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
ISO_DATE = "%Y-%m-%d"
# Type names that an integer or float column may have.
TYPE_LISTS = {"integer": ["int", "int64", "INTEGER", "BIGINT"], "float": ["float", "float64", "FLOAT", "DOUBLE"]}
LAYOUTS = {ISO_DATE: "yyyy-MM-dd"}


def column_facts(df: DataFrame, cols: Sequence[str] | None = None, reference_order: bool = True) -> DataFrame:
    """The column profile (PR-03) with min_value and max_value of columns
    detected as numbers, min_length and max_length of those detected as
    text (PR-05), and the ten most frequent values with their counts."""
    cols = list(cols or df.columns)
    base = P.profile_columns(df, cols, reference_order)
    numbers = {c: as_number(c, df.schema[c].dataType) for c in cols}
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(F.when(~F.isnan(numbers[c]), numbers[c])).alias(f"lo{i}"), F.max(F.when(~F.isnan(numbers[c]), numbers[c])).alias(f"hi{i}"),
        F.min(F.when(present(c), F.char_length(text(c)))).alias(f"s{i}"), F.max(F.when(present(c), F.char_length(text(c)))).alias(f"l{i}"))])
    cells = row.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"s{i}").alias("short"),
        F.col(f"l{i}").alias("long")) for i, c in enumerate(cols)])).alias("c")).select("c.*")
    top = P.top_values(df, cols).groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))), lambda t: F.struct(
            t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"))       # ten a column
    number, words = F.col("inferred_type").isin("integer", "float"), F.col("inferred_type") == "string"
    return (base.join(cells, "column_name").join(top, "column_name", "left")
            .select(*base.columns, F.when(number, F.col("lo")).alias("min_value"), F.when(number, F.col("hi")).alias("max_value"),
                    F.when(words, F.col("short")).alias("min_length"), F.when(words, F.col("long")).alias("max_length"), "top_values"))


def _row(name: str, when: Column, low=None, high=None, values=None, pattern=None, mostly=None) -> Column:
    def cell(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    return F.when(when, F.struct(
        F.lit(name).alias("expectation"), F.col("column_name"), cell(low, "double").alias("min_value"),
        cell(high, "double").alias("max_value"), cell(values, "array<string>").alias("value_set"),
        cell(pattern, "string").alias("pattern"), cell(1.0 if mostly is None else mostly, "double").alias("mostly")))


def generate(facts: DataFrame, row_count: int) -> DataFrame:
    """DQ-17: the suite of a table from its column facts, as rows of
    ``SUITE_SCHEMA``. Per column: it exists; not null (up to 1 % nulls
    always, below 50 % with ``mostly`` 1 - 1.5 x share); unique above 99 %
    distinct; type list and range of numbers; e-mail pattern; date layout;
    lengths of text (at least 1, up to twice the longest); value set of
    columns with at most 20 values that are below 10 % of the rows, from the
    frequent values above 1 % of the rows (95 %). For the table: rows from
    half (at least 1) to twice as many, and the number of columns."""
    kind, share = F.col("inferred_type"), F.col("null_pct") / 100
    often = F.transform(F.filter("top_values", lambda t: t["count"] > F.col("total") * 0.01), lambda t: t["value"])
    lists = F.array(*[F.lit(v) for v in TYPE_LISTS["integer"]]), F.array(*[F.lit(v) for v in TYPE_LISTS["float"]])
    rows = F.array_compact(F.array(
        _row("expect_column_to_exist", F.lit(True)),
        _row("expect_column_values_to_not_be_null", F.col("null_pct") < 1),
        _row("expect_column_values_to_not_be_null", (F.col("null_pct") >= 1) & (F.col("null_pct") < 50), mostly=1 - share * 1.5),
        _row("expect_column_values_to_be_unique", F.col("distinct_pct") > 99),
        _row("expect_column_values_to_be_in_type_list", kind == "integer", values=lists[0]),
        _row("expect_column_values_to_be_in_type_list", kind == "float", values=lists[1]),
        _row("expect_column_values_to_be_between", F.col("min_value").isNotNull(), F.col("min_value"), F.col("max_value")),
        _row("expect_column_values_to_match_regex", kind == "email", pattern=EMAIL),
        _row("expect_column_values_to_match_strftime_format", kind.isin("date_iso", "date"), pattern=ISO_DATE),
        _row("expect_column_value_lengths_to_be_between", F.col("min_length").isNotNull(),
             F.greatest(F.lit(1), F.col("min_length")), F.col("max_length") * 2),
        _row("expect_column_values_to_be_in_set", (F.col("distinct_count") <= 20) & (F.col("distinct_pct") < 10)
             & (F.size(often) > 0), values=often, mostly=0.95)))
    per_column = facts.select(F.explode(rows).alias("e")).select("e.*")
    table = facts.sparkSession.createDataFrame([
        ("expect_table_row_count_to_be_between", None, float(max(1, int(row_count * 0.5))), float(row_count * 2), None, None, 1.0),
        ("expect_table_column_count_to_equal", None, float(facts.count()), float(facts.count()), None, None, 1.0)], SUITE_SCHEMA)
    return per_column.unionByName(table)


def _row_check(e, df: DataFrame) -> tuple[Column, Column]:
    """(rows it applies to, rows among them that fail)."""
    c, name = e["column_name"], e["expectation"]
    there = present(c)
    if name == "expect_column_values_to_not_be_null":
        return F.lit(True), ~there
    if name == "expect_column_values_to_be_in_type_list":
        kind = next((k for k, names in TYPE_LISTS.items() if set(e["value_set"]) & set(names)), None)
        if kind is None:
            raise ValueError(f"unknown types {e['value_set']}")
        rule = type_rule(c, kind)
        return there, rule.fail
    if name == "expect_column_values_to_be_between":
        return there, range_rule(c, e["min_value"], e["max_value"]).fail
    if name == "expect_column_values_to_match_regex":
        return there, ~text(c).rlike(e["pattern"])
    if name == "expect_column_values_to_match_strftime_format":
        if e["pattern"] not in LAYOUTS:
            raise ValueError(f"unknown date layout {e['pattern']}")
        exact = text(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
        return there, ~(exact & F.try_to_timestamp(text(c), F.lit(LAYOUTS[e["pattern"]])).isNotNull())
    if name == "expect_column_value_lengths_to_be_between":
        n = F.char_length(text(c))
        low, high = e["min_value"], e["max_value"]
        fail = F.lit(False)
        fail = fail | (n < low) if low is not None else fail
        return there, fail | (n > high) if high is not None else fail
    if name == "expect_column_values_to_be_in_set":
        return there, ~text(c).isin(list(e["value_set"]))
    raise ValueError(f"unknown expectation {name}")


_TABLE = {"expect_column_to_exist", "expect_table_row_count_to_be_between", "expect_table_column_count_to_equal"}
RESULT_SCHEMA = "expectation string, column_name string, success boolean, observed double, unexpected_count bigint"


def evaluate(df: DataFrame, suite: DataFrame) -> DataFrame:
    """DQ-18: (expectation, column_name, success, observed, unexpected_count)
    of every row of ``suite``. ``observed`` is the share of values that meet
    a column expectation (1 without values), the number of rows or columns
    for the table's. An expectation on a column that is missing fails.
    Uniqueness counts every row of a repeated value as unexpected."""
    rows = suite.collect()      # expectations, some for every column
    have = set(df.columns)
    checks = {i: _row_check(e, df) for i, e in enumerate(rows)
              if e["expectation"] not in _TABLE and e["expectation"] != "expect_column_values_to_be_unique" and e["column_name"] in have}
    got = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, (on, fail) in checks.items() for x in (
        F.count_if(on).alias(f"n{i}"), F.count_if(on & F.coalesce(fail, F.lit(True))).alias(f"f{i}"))]).first()
    unique = sorted({e["column_name"] for e in rows if e["expectation"] == "expect_column_values_to_be_unique"} & have)
    repeats = {}
    if unique:
        counts = P.value_frequencies(df, unique).groupBy("column_name").agg(
            F.sum("count").alias("n"), F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("f"))
        repeats = {r["column_name"]: (r["n"], r["f"]) for r in counts.collect()}
    out = []
    for i, e in enumerate(rows):
        name, c = e["expectation"], e["column_name"]
        if name in _TABLE:
            seen = float(got["rows"]) if "row" in name else float(len(df.columns)) if "count" in name else float(c in have)
            good = c in have if name == "expect_column_to_exist" else e["min_value"] <= seen <= e["max_value"]
            out.append((name, c, good, seen, 0 if good else 1))
            continue
        if c not in have:
            out.append((name, c, False, 0.0, got["rows"]))
            continue
        n, bad = repeats.get(c, (0, 0)) if name.endswith("unique") else (got[f"n{i}"], got[f"f{i}"])
        met = 1 - bad / n if n else 1.0
        out.append((name, c, met >= e["mostly"], met, bad))
    return df.sparkSession.createDataFrame(out, RESULT_SCHEMA)
