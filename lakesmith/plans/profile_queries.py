"""Registered profiling queries (PR). SQL twins are generated from the same
pattern table the Spark operators use, so both engines test one rule."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import suites as SU
from ..session import scratch_root
from ..sources.tables import table
from .registry import register

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]
NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(c: str) -> str:
    return rf"regexp_replace(cast({c} as varchar), '^\s+|\s+$', '', 'g')"


def _present(c: str) -> str:
    return f"({_trim(c)} is not null and {_trim(c)} <> '')"


def _rx(c: str, regex: str) -> str:
    return f"({_present(c)} and regexp_matches({_trim(c)}, {_sql_str('(?i)' + regex)}))"


def type_count_sql(cols, src: str) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"count(*) filter (where {_present(c)}) as n{i}")
        for j, name in enumerate(P.TYPE_PATTERNS):
            parts.append(f"count(*) filter (where {_rx(c, P.TYPE_PATTERNS[name])}) as m{i}_{j}")
        words = ", ".join(_sql_str(w) for w in P.BOOL_WORDS)
        parts.append(f"count(*) filter (where {_present(c)} and lower({_trim(c)}) in ({words})) as b{i}")
        parts.append(f"count(*) filter (where {_rx(c, P.INT_RE)}) as i{i}")
        parts.append(f"count(*) filter (where {_present(c)} and not regexp_matches({_trim(c)}, "
                     f"{_sql_str(P.INT_RE)}) and regexp_matches({_trim(c)}, {_sql_str('(?i)' + P.FLOAT_RE)})) as f{i}")
    return f"select {', '.join(parts)} from {src}"


def type_case_sql(i: int, share: float = 0.9, reference_order: bool = True) -> str:
    names = list(P.TYPE_PATTERNS)
    whens = [f"when m{i}_{names.index(n)} / n{i} > {share} then '{n}'"
             for n in P.pattern_order(reference_order)]
    return (f"case when n{i} = 0 then 'string' {' '.join(whens)} "
            f"when b{i} / n{i} > {share} then 'boolean' when i{i} / n{i} > {share} then 'integer' "
            f"when (i{i} + f{i}) / n{i} > {share} then 'float' else 'string' end")


def pattern_case_sql(i: int, reference_order: bool = True) -> str:
    names = list(P.TYPE_PATTERNS)
    whens = [f"when m{i}_{names.index(n)} / n{i} > 0.8 then '{n}'"
             for n in P.pattern_order(reference_order)]
    return f"case when n{i} >= 10 then case {' '.join(whens)} end end"


def orders_as_text(spark, d):
    o = table(spark, d, "orders")
    return o.select(*[F.col(c).cast("string").alias(c) for c in ORDER_COLS])


ORDERS_TEXT_SQL = "(select " + ", ".join(f"cast({c} as varchar) as {c}" for c in ORDER_COLS) + \
    " from orders)"


def _detect_sql(cols, src):
    sel = " union all ".join(
        f"select '{c}' as column_name, {type_case_sql(i)} as inferred_type from a"
        for i, c in enumerate(cols))
    return f"with a as ({type_count_sql(cols, src)}) {sel}"


@register("pr_01", _detect_sql(ORDER_COLS, ORDERS_TEXT_SQL))
def q_pr_01(spark, d):
    return P.detect_types(orders_as_text(spark, d))


PAGE_COLS = ["page_id", "url"]


@register("pr_02", "with a as ({}) {}".format(
    type_count_sql(PAGE_COLS, "pages"),
    " union all ".join(f"select '{c}' as column_name, {pattern_case_sql(i)} as pattern from a"
                       for i, c in enumerate(PAGE_COLS))))
def q_pr_02(spark, d):
    return P.detect_patterns(table(spark, d, "pages").select(*PAGE_COLS))


def _profile_sql(cols, src):
    z = ", ".join(f"count(*) filter (where {c} is null or cast({c} as varchar) = '') as z{i}"
                  for i, c in enumerate(cols))
    dist = " union all ".join(
        f"select '{c}' as column_name, count(distinct cast({c} as varchar)) filter "
        f"(where {c} is not null and cast({c} as varchar) <> '') as dc from {src}"
        for c in cols)
    rows = " union all ".join(
        f"select '{c}' as column_name, t as total, z{i} as null_count, "
        f"{type_case_sql(i)} as inferred_type, {pattern_case_sql(i)} as pattern from a, zz"
        for i, c in enumerate(cols))
    return f"""with a as ({type_count_sql(cols, src)}),
zz as (select count(*) as t, {z} from {src}),
b as ({rows}), dd as ({dist})
select b.column_name, b.total, b.null_count,
  round(case when b.total = 0 then 0 else b.null_count * 100.0 / b.total end, 6) as null_pct,
  cast(dd.dc as bigint) as distinct_count,
  round(case when b.total - b.null_count = 0 then 0 else dd.dc * 100.0 / (b.total - b.null_count) end, 6)
    as distinct_pct, b.inferred_type, b.pattern
from b join dd using (column_name)"""


@register("pr_03", _profile_sql(ORDER_COLS, ORDERS_TEXT_SQL))
def q_pr_03(spark, d):
    return P.profile_columns(orders_as_text(spark, d))


def _rank_sql(c: str, frac: str) -> str:
    return (f"(select {c} from (select {c}, row_number() over (order by {c}) - 1 as k from lineitem "
            f"where {c} is not null) where k = (select {frac} from (select count({c}) as n from lineitem)))")


@register("pr_04", " union all ".join(
    f"""select '{c}' as column_name, count({c}) as n, min({c}) as min, max({c}) as max,
  round(avg({c}), 6) as mean, round(median({c}), 6) as median, round(stddev_samp({c}), 6) as std,
  {_rank_sql(c, 'n // 4')} as p25, {_rank_sql(c, '3 * n // 4')} as p75 from lineitem"""
    for c in NUM_COLS[:3]))
def q_pr_04(spark, d):
    r = P.profile_numeric(table(spark, d, "lineitem"), NUM_COLS[:3])
    for c in ("mean", "median", "std"):
        r = r.withColumn(c, F.round(c, 6))
    return r


@register("pr_05", """select 'text' as column_name, cast(min(length(text)) as integer) as min_length,
  cast(max(length(text)) as integer) as max_length, round(avg(length(text)), 6) as mean_length from documents""")
def q_pr_05(spark, d):
    r = P.profile_text(table(spark, d, "documents"), ["text"])
    return r.withColumn("mean_length", F.round("mean_length", 6))


@register("pr_06", """select count(*) as row_count, 2 as column_count,
  count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as duplicate_rows,
  cast(sum(strlen(cast(l_orderkey as varchar)) + strlen(cast(l_linenumber as varchar))) as bigint)
    as size_bytes
from lineitem""")
def q_pr_06(spark, d):
    return P.profile_table(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@register("pr_08", """
select column_name, dtype, column_class, missing_pct, cast(distinct_count as bigint) as distinct_count,
  min, max, round(mean, 6) as mean, round(std, 6) as std, use_for_modeling from (
  select 'c_custkey' as column_name, 'bigint' as dtype, 'numeric' as column_class,
    round(count(*) filter (where c_custkey is null) * 100.0 / count(*), 2) as missing_pct,
    count(distinct c_custkey) as distinct_count, cast(min(c_custkey) as double) as min,
    cast(max(c_custkey) as double) as max, avg(c_custkey) as mean, stddev_samp(c_custkey) as std,
    true as use_for_modeling from customer
  union all select 'c_name', 'string', 'categorical',
    round(count(*) filter (where c_name is null) * 100.0 / count(*), 2), count(distinct c_name),
    null, null, null, null, true from customer
  union all select 'c_nationkey', 'int', 'numeric',
    round(count(*) filter (where c_nationkey is null) * 100.0 / count(*), 2), count(distinct c_nationkey),
    min(c_nationkey), max(c_nationkey), avg(c_nationkey), stddev_samp(c_nationkey), true from customer
  union all select 'c_acctbal', 'double', 'numeric',
    round(count(*) filter (where c_acctbal is null) * 100.0 / count(*), 2), count(distinct c_acctbal),
    min(c_acctbal), max(c_acctbal), avg(c_acctbal), stddev_samp(c_acctbal), true from customer
  union all select 'c_mktsegment', 'string', 'categorical',
    round(count(*) filter (where c_mktsegment is null) * 100.0 / count(*), 2), count(distinct c_mktsegment),
    null, null, null, null, true from customer)""")
def q_pr_08(spark, d):
    r = P.eda_schema(table(spark, d, "customer"))
    return r.select("column_name", "dtype", "column_class", "missing_pct",
                    F.col("distinct_count").cast("long").alias("distinct_count"), "min", "max",
                    F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    "use_for_modeling")


@register("pr_10", """
with mm as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
w as (select lo, case when hi > lo then (hi - lo) / 30 else 1.0 end as width from mm),
b as (select cast(least(floor((l_extendedprice - w.lo) / w.width), 29) as integer) as bin, count(*) as c
      from lineitem, w where l_extendedprice is not null group by 1)
select 'l_extendedprice' as column_name, cast(r.range as integer) as bin,
  round(w.lo + r.range * w.width, 6) as bin_start, round(w.lo + (r.range + 1) * w.width, 6) as bin_end,
  round(w.lo + (r.range + 0.5) * w.width, 6) as bin_mid, cast(coalesce(b.c, 0) as bigint) as count
from range(30) r cross join w left join b on b.bin = r.range""")
def q_pr_10(spark, d):
    h = P.histogram(table(spark, d, "lineitem"), ["l_extendedprice"], 30)
    for c in ("bin_start", "bin_end", "bin_mid"):
        h = h.withColumn(c, F.round(c, 6))
    return h


SHAPE_SQL = " union all ".join(
    f"""select '{c}' as column_name, count({c}) as n,
  round((count(*) - count({c})) * 100.0 / count(*), 6) as missing_pct,
  round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis, min({c}) as min,
  max({c}) as max, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
  round(median({c}), 6) as median from lineitem""" for c in NUM_COLS)


@register("pr_11", SHAPE_SQL)
def q_pr_11(spark, d):
    s = P.shape(table(spark, d, "lineitem"), NUM_COLS)
    for c in ("missing_pct", "skewness", "kurtosis", "mean", "std", "median"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@register("pr_12", """
with q as (select quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.5) as med,
  quantile_cont(c_acctbal, 0.75) as q3 from customer)
select 'c_acctbal' as column_name, round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
  round(q3 - q1, 6) as iqr, min(c_acctbal) as min, max(c_acctbal) as max,
  round(count(*) filter (where c_acctbal < q1 - 1.5 * (q3 - q1) or c_acctbal > q3 + 1.5 * (q3 - q1))
    * 1.0 / count(c_acctbal), 6) as outlier_share
from customer, q group by q1, med, q3""")
def q_pr_12(spark, d):
    b = P.box_stats(table(spark, d, "customer"), ["c_acctbal"])
    for c in ("q1", "median", "q3", "iqr", "outlier_share"):
        b = b.withColumn(c, F.round(c, 6))
    return b


@register("pr_13", """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3,
  avg(value) as m, stddev_samp(value) as s from events)
select 'value' as column_name,
  count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as iqr_outliers,
  count(*) filter (where abs((value - m) / (s + 1e-9)) > 3) as z_outliers
from events, q""")
def q_pr_13(spark, d):
    return P.outlier_counts(table(spark, d, "events"), ["value"])


PEARSON_SQL = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 3) + 0.0 as r from lineitem"
    for a in NUM_COLS for b in NUM_COLS)


@register("pr_14", PEARSON_SQL)
def q_pr_14(spark, d):
    return P.pearson(table(spark, d, "lineitem"), NUM_COLS)


RANKS_SQL = "(select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}"
    for c in NUM_COLS) + " from lineitem)"


@register("pr_15", " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 3) + 0.0 as r from {RANKS_SQL}"
    for a in NUM_COLS for b in NUM_COLS))
def q_pr_15(spark, d):
    return P.spearman(table(spark, d, "lineitem"), NUM_COLS)


@register("pr_16", f"""
with m as ({PEARSON_SQL}), u as (select *, abs(r) as abs_r from m where col_a < col_b)
select arg_max(col_a || '~' || col_b, (abs_r, col_a, col_b)) as strongest_pair, max(abs_r) as strongest_abs_r,
  arg_min(col_a || '~' || col_b, (abs_r, col_a, col_b)) as weakest_pair, min(abs_r) as weakest_abs_r,
  count(*) filter (where abs_r > 0.8) as strong_pairs, round(avg(abs_r), 6) as mean_abs_r
from u""")
def q_pr_16(spark, d):
    s = P.corr_summary(P.pearson(table(spark, d, "lineitem"), NUM_COLS))
    return s.withColumn("mean_abs_r", F.round("mean_abs_r", 6))


@register("pr_17", f"""
select column_name, skewness, kurtosis,
  case when abs(skewness) > 1 then 'highly skewed' when abs(skewness) > 0.5 then 'moderately skewed'
    else 'approximately symmetric' end as skew_label,
  case when kurtosis > 3 then 'heavy tails' when kurtosis > 2 then 'moderate tails'
    else 'normal tails' end as tail_label
from ({SHAPE_SQL})""")
def q_pr_17(spark, d):
    s = P.shape(table(spark, d, "lineitem"), NUM_COLS).select(
        "column_name", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))
    return P.verdicts(s)


@register("pr_07", f"""select column_name, inferred_type, null_count > 0 as nullable, distinct_pct > 99 as "unique",
  pattern, distinct_count <= 20 and distinct_pct < 10 as enumerable
from ({_profile_sql(ORDER_COLS, ORDERS_TEXT_SQL)})""")
def q_pr_07(spark, d):
    prof = P.profile_columns(orders_as_text(spark, d))
    r = P.infer_rules(prof)
    e = prof.select("column_name", ((F.col("distinct_count") <= 20) & (F.col("distinct_pct") < 10)).alias("enumerable"))
    return r.join(e, "column_name").select("column_name", "inferred_type", "nullable", "unique", "pattern",
                                           "enumerable")


@register("pr_09", """select 'c_acctbal' as target,
  case when count(distinct c_acctbal) <= 20 then 'classification' else 'regression' end as task,
  'tabular' as data_class from customer""")
def q_pr_09(spark, d):
    return P.detect_task(table(spark, d, "customer"), "c_acctbal")


@register("dq_17", f"""
with p as ({_profile_sql(ORDER_COLS, ORDERS_TEXT_SQL)})
select 'expect_column_values_to_not_be_null' as expectation, column_name, '' as params,
  case when null_pct / 100 < 0.01 then 1.0 else round(1 - 1.5 * null_pct / 100, 4) end as mostly
from p where null_pct / 100 < 0.5
union all select 'expect_column_values_to_be_unique', column_name, '', 1.0 from p where distinct_pct > 99
union all select 'expect_table_row_count_to_be_between', null,
  cast(cast(floor(count(*) * 0.5) as bigint) as varchar) || '..' || cast(count(*) * 2 as varchar), 1.0 from orders""")
def q_dq_17(spark, d):
    from ..operators import rules as Q
    o = orders_as_text(spark, d)
    return Q.generate_suite(P.profile_columns(o), o.count())


def _suite_sql() -> str:
    """Every expectation of the orders table, from its profile."""
    facts = " union all ".join(f"""select '{c}' as column_name, min(try_cast({c} as double)) as lo, max(try_cast({c} as double)) as hi,
  min(length({c})) as short, max(length({c})) as long,
  (select list(v order by n desc, v) from (select {c} as v, count(*) as n from {ORDERS_TEXT_SQL} where {c} <> '' group by 1
    order by n desc, v limit 10) where n > (select count(*) from orders) * 0.01) as often from {ORDERS_TEXT_SQL}""" for c in ORDER_COLS)
    none, d = "null::varchar[]", "null::double"
    rows = [("to_exist", "true", d, d, none, "null", "1.0"),
            ("values_to_not_be_null", "null_pct < 1", d, d, none, "null", "1.0"),
            ("values_to_not_be_null", "null_pct >= 1 and null_pct < 50", d, d, none, "null", "1 - null_pct / 100 * 1.5"),
            ("values_to_be_unique", "distinct_pct > 99", d, d, none, "null", "1.0"),
            ("values_to_be_in_type_list", "inferred_type = 'integer'", d, d, "['int', 'int64', 'INTEGER', 'BIGINT']", "null", "1.0"),
            ("values_to_be_in_type_list", "inferred_type = 'float'", d, d, "['float', 'float64', 'FLOAT', 'DOUBLE']", "null", "1.0"),
            ("values_to_be_between", "inferred_type in ('integer', 'float')", "lo", "hi", none, "null", "1.0"),
            ("values_to_match_regex", "inferred_type = 'email'", d, d, none, "'?'", "1.0"),
            ("values_to_match_strftime_format", "inferred_type in ('date_iso', 'date')", d, d, none, "'%Y-%m-%d'", "1.0"),
            ("value_lengths_to_be_between", "inferred_type = 'string'", "greatest(1, short)", "long * 2", none, "null", "1.0"),
            ("values_to_be_in_set", "distinct_count <= 20 and distinct_pct < 10 and len(often) > 0", d, d, "often", "null", "0.95")]
    parts = [f"""select 'expect_column_{name}' as expectation, column_name, {lo}::double as min_value, {hi}::double as max_value,
  {vs} as value_set, {pat} as pattern, {mostly}::double as mostly from f where {cond}""" for name, cond, lo, hi, vs, pat, mostly in rows]
    parts += ["select 'expect_table_row_count_to_be_between', null, greatest(1, floor(count(*) * 0.5))::double, count(*) * 2::double, "
              f"{none}, null, 1.0 from orders",
              f"select 'expect_table_column_count_to_equal', null, {len(ORDER_COLS)}::double, {len(ORDER_COLS)}::double, {none}, null, 1.0"]
    return (f"with p as ({_profile_sql(ORDER_COLS, ORDERS_TEXT_SQL)}), g as ({facts}), f as (select * from p join g using (column_name)) "
            + " union all ".join(parts))


@register("dq_17_suite", "select expectation, column_name, min_value, max_value, array_to_string(value_set, '|') as value_set, pattern, "
          f"round(mostly, 6) as mostly from ({_suite_sql()})")
def q_dq_17_suite(spark, d):
    """The whole expectation suite of the orders, as rows."""
    o = orders_as_text(spark, d)
    suite = SU.generate(SU.column_facts(o), o.count())
    return suite.withColumn("value_set", F.array_join("value_set", "|")).withColumn("mostly", F.round("mostly", 6))


@register("dq_18_suite", f"""with s as ({_suite_sql()})
select expectation, column_name, true as success, case when expectation = 'expect_table_column_count_to_equal' then {len(ORDER_COLS)}.0
  when expectation = 'expect_table_row_count_to_be_between' then (select count(*) from orders)::double else 1.0 end as observed,
  0::bigint as unexpected_count from s""")
def q_dq_18_suite(spark, d):
    """The orders' suite is written, read back and evaluated on them."""
    o = orders_as_text(spark, d)
    path = f"{scratch_root(spark)}/suite-{uuid.uuid4().hex}"
    SU.generate(SU.column_facts(o), o.count()).coalesce(1).write.parquet(path)
    return SU.evaluate(o, spark.read.parquet(path))


@register("pr_07_facts", f"""with p as ({_profile_sql(ORDER_COLS, ORDERS_TEXT_SQL)}), g as ({" union all ".join(
    f"select '{c}' as column_name, min(try_cast({c} as double)) as lo, max(try_cast({c} as double)) as hi, min(length({c})) as short, "
    f"max(length({c})) as long, (select string_agg(v, '|' order by n desc, v) from (select {c} as v, count(*) as n from {ORDERS_TEXT_SQL} "
    f"where {c} <> '' group by 1 order by n desc, v limit 10)) as vals from {ORDERS_TEXT_SQL}" for c in ORDER_COLS)})
select column_name, inferred_type as type, null_pct > 0 as nullable, distinct_pct > 99 as "unique",
  case when inferred_type in ('integer', 'float') then lo end as min_value, case when inferred_type in ('integer', 'float') then hi end as max_value,
  case when inferred_type = 'string' then short end as min_length, case when inferred_type = 'string' then long end as max_length, pattern,
  case when distinct_count <= 20 and distinct_pct < 10 then vals end as allowed_values from p join g using (column_name)""")
def q_pr_07_facts(spark, d):
    """Rules of a schema with ranges, lengths and allowed values."""
    f = SU.column_facts(orders_as_text(spark, d))
    few = (F.col("distinct_count") <= 20) & (F.col("distinct_pct") < 10)
    return f.select("column_name", F.col("inferred_type").alias("type"), (F.col("null_pct") > 0).alias("nullable"),
                    (F.col("distinct_pct") > 99).alias("unique"), "min_value", "max_value", "min_length", "max_length", "pattern",
                    F.when(few, F.array_join(F.col("top_values.value"), "|")).alias("allowed_values"))


@register("pr_03_top", " union all ".join(
    f"""select * from (select '{c}' as column_name, cast({c} as varchar) as value, count(*) as count,
  row_number() over (order by count(*) desc, cast({c} as varchar)) as rank
  from {ORDERS_TEXT_SQL} where {c} is not null and cast({c} as varchar) <> '' group by 2) where rank <= 10"""
    for c in ORDER_COLS))
def q_pr_03_top(spark, d):
    """Top 10 values per column (count desc, value asc), all columns in one
    value-frequency shuffle."""
    t = P.top_values(orders_as_text(spark, d), n=10)
    return t.select("column_name", "value", "count", F.col("rank").cast("long").alias("rank"))
