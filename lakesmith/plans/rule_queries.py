"""Registered data-quality queries (DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.documents import document_errors
from ..operators import profile as P
from ..operators import rules as Q
from ..sources.tables import table
from .clean_queries import SEEDED_ORDERS_SQL, seeded_orders
from .profile_queries import ORDER_COLS, ORDERS_TEXT_SQL, _profile_sql, orders_as_text
from .registry import register
from .relational_queries import SEEDED_CUSTOMER_SQL, seeded_customer

SAMPLES = 5
FLAT_COLS = ["check_name", "column_name", "passed", "severity", "expected", "actual",
             "failed_count", "sample_keys"]


def flat(res):
    """Result frame with sample keys as comma-joined text, actual rounded."""
    return res.select("check_name", "column_name", "passed", "severity", "expected",
                      F.round("actual", 6).alias("actual"), "failed_count",
                      F.array_join("sample_keys", ",").alias("sample_keys"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_sql(src: str, key: str | None, rules, key_order: str | None = None) -> str:
    """SQL twin of :func:`evaluate_row_rules`: rules are ``(check, column,
    fail_sql, applies_sql, severity, expected, mostly)``."""
    parts = []
    for (check, col, fail, app, sev, exp, mostly) in rules:
        app = app or "true"
        cond = f"({app}) and coalesce(({fail}), false)"
        sample = "''"
        if key:
            sample = (f"coalesce(array_to_string(list_slice(list(cast({key} as varchar) order by {key_order or key}) "
                      f"filter (where {cond}), 1, {SAMPLES}), ','), '')")
        f = f"count(*) filter (where {cond})"
        a = f"count(*) filter (where {app})"
        parts.append(
            f"select {_q(check)} as check_name, {('cast(null as varchar)' if col is None else _q(col))} "
            f"as column_name, (case when {a} = 0 then 1.0 else 1 - {f} / {a} end) >= {mostly} as passed, "
            f"{_q(sev)} as severity, {_q(exp)} as expected, "
            f"round(case when {a} = 0 then 0.0 else {f} / {a} end, 6) as actual, "
            f"{f} as failed_count, {sample} as sample_keys from {src}")
    return " union all ".join(parts)


def _trim(c):
    return rf"regexp_replace(cast({c} as varchar), '^\s+|\s+$', '', 'g')"


def _present(c):
    return f"({c} is not null and cast({c} as varchar) <> '')"


def _num(c):
    """SQL twin of ``as_number``."""
    t = f"lower({_trim(c)})"
    return (f"case when regexp_matches({t}, {_q('(?i)' + P.FLOAT_RE)}) then "
            f"try_cast(replace({t}, '_', '') as double) end")


# ----------------------------------------------------------------- DQ-01
@register("dq_01", """
with n as (select count(*) as n from orders)
select 'data_not_empty' as check_name, cast(null as varchar) as column_name, n > 0 as passed,
  'error' as severity, 'non-empty dataset' as expected, cast(n as double) as actual,
  cast(case when n > 0 then 0 else 1 end as bigint) as failed_count, '' as sample_keys from n
union all select 'row_count_min', null, n >= 1000, 'error', '>= 1000', n, case when n >= 1000 then 0 else 1 end, '' from n
union all select 'row_count_max', null, n <= 10000, 'warning', '<= 10000', n, case when n <= 10000 then 0 else 1 end, '' from n""")
def q_dq_01(spark, d):
    return flat(Q.check_row_count(table(spark, d, "orders"), 1000, 10000))


# ----------------------------------------------------------------- DQ-03
NN_COLS = ["c_acctbal", "c_name", "c_mktsegment"]


@register("dq_03", rules_sql(SEEDED_CUSTOMER_SQL, "c_custkey", [
    ("not_null", c, f"not {_present(c)}", None, "error", "no nulls", 1.0) for c in NN_COLS]))
def q_dq_03(spark, d):
    return flat(Q.evaluate_row_rules(seeded_customer(spark, d), [Q.not_null_rule(c) for c in NN_COLS],
                                     "c_custkey", SAMPLES))


# ----------------------------------------------------------------- DQ-04
@register("dq_04", " union all ".join(f"""
select 'unique' as check_name, '{c}' as column_name, count({c}) - count(distinct {c}) = 0 as passed,
  'error' as severity, 'all unique' as expected, cast(count({c}) - count(distinct {c}) as double) as actual,
  count({c}) - count(distinct {c}) as failed_count, '' as sample_keys from lineitem"""
                                      for c in ("l_orderkey", "l_partkey", "l_linenumber")))
def q_dq_04(spark, d):
    return flat(Q.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"]))


# ----------------------------------------------------------------- DQ-05
@register("dq_05", """
with dd as (select count(*) as d from (select l_orderkey, l_linenumber from lineitem
  group by all having count(*) > 1))
select 'primary_key_unique' as check_name, 'l_orderkey,l_linenumber' as column_name, d = 0 as passed,
  'error' as severity, 'all unique' as expected, cast(d as double) as actual, d as failed_count,
  '' as sample_keys from dd""")
def q_dq_05(spark, d):
    return flat(Q.check_primary_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


# ----------------------------------------------------------------- DQ-06
TYPE_SPEC = [("o_orderkey", "integer"), ("o_totalprice", "float"), ("o_orderdate", "datetime"),
             ("o_orderstatus", "boolean"), ("o_orderpriority", "integer")]


def _type_fail_sql(c, typ):
    t = f"cast({c} as varchar)"
    return {
        "integer": f"not regexp_matches({_trim(c)}, {_q(P.INT_RE)})",
        "float": f"not regexp_matches({_trim(c)}, {_q('(?i)' + P.FLOAT_RE)})",
        "boolean": f"lower({t}) not in ({', '.join(_q(w) for w in P.BOOL_WORDS)})",
        "datetime": f"not regexp_matches({t}, {_q(P.TYPE_PATTERNS['datetime_iso'])})",
    }[typ]


@register("dq_06", rules_sql(ORDERS_TEXT_SQL, "o_orderkey", [
    ("data_type", c, _type_fail_sql(c, t), _present(c), "error", t, 1.0) for c, t in TYPE_SPEC],
    key_order="cast(o_orderkey as bigint)"))
def q_dq_06(spark, d):
    rules = [Q.type_rule(c, t) for c, t in TYPE_SPEC]
    o = orders_as_text(spark, d).withColumn("_key", F.col("o_orderkey").cast("long"))
    res = Q.evaluate_row_rules(o, rules, "_key", SAMPLES)
    return flat(res)


# ----------------------------------------------------------------- DQ-07..10
CUST_TEXT_SQL = """(select c_custkey, cast(c_acctbal as varchar) as c_acctbal, c_name from customer)"""


@register("dq_07", rules_sql(CUST_TEXT_SQL, "c_custkey", [
    ("value_range", "c_acctbal", f"(({_num('c_acctbal')}) < 0 or ({_num('c_acctbal')}) > 9000) "
     f"and not isnan({_num('c_acctbal')})", _present("c_acctbal"), "error", "[0, 9000]", 1.0)]))
def q_dq_07(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    return flat(Q.evaluate_row_rules(c, [Q.range_rule("c_acctbal", 0, 9000)], "c_custkey", SAMPLES))


@register("dq_08", rules_sql("part", "p_partkey", [
    ("string_length", "p_name", "length(p_name) < 5 or length(p_name) > 12", _present("p_name"),
     "warning", "length [5, 12]", 1.0)]))
def q_dq_08(spark, d):
    return flat(Q.evaluate_row_rules(table(spark, d, "part"), [Q.length_rule("p_name", 5, 12)],
                                     "p_partkey", SAMPLES))


@register("dq_09", rules_sql("customer", "c_custkey", [
    ("pattern_match", "c_name", "not regexp_matches(c_name, '^(?:Customer#00000[01])')",
     _present("c_name"), "error", "matches Customer#00000[01]", 1.0)]))
def q_dq_09(spark, d):
    return flat(Q.evaluate_row_rules(table(spark, d, "customer"),
                                     [Q.pattern_rule("c_name", "Customer#00000[01]")], "c_custkey", SAMPLES))


@register("dq_10", rules_sql("orders", "o_orderkey", [
    ("allowed_values", "o_orderstatus", "cast(o_orderstatus as varchar) not in ('O', 'F')",
     _present("o_orderstatus"), "error", "one of ['O', 'F']", 1.0)]))
def q_dq_10(spark, d):
    return flat(Q.evaluate_row_rules(table(spark, d, "orders"),
                                     [Q.in_set_rule("o_orderstatus", ["O", "F"])], "o_orderkey", SAMPLES))


# ----------------------------------------------------------------- DQ-11/12
@register("dq_11", """
with s as (select avg(value) as m, stddev_samp(value) as sd from events)
select 'z_score_outlier' as check_name, 'value' as column_name,
  count(*) filter (where abs((value - m) / sd) > 3) = 0 as passed, 'warning' as severity,
  'z-score <= 3.0' as expected,
  round(count(*) filter (where abs((value - m) / sd) > 3) / count(*), 6) as actual,
  count(*) filter (where abs((value - m) / sd) > 3) as failed_count,
  coalesce(array_to_string(list_slice(list(cast(event_id as varchar) order by event_id)
    filter (where abs((value - m) / sd) > 3), 1, 5), ','), '') as sample_keys
from events, s group by m, sd""")
def q_dq_11(spark, d):
    return flat(Q.check_zscore(table(spark, d, "events"), ["value"], 3.0, key="event_id")
                .withColumn("sample_keys", F.slice("sample_keys", 1, SAMPLES)))


@register("dq_12", """
with v as (select value, row_number() over (order by value) - 1 as k from events),
n as (select count(*) as n from events),
q as (select (select value from v, n where k = n.n // 4) as q1,
             (select value from v, n where k = 3 * n.n // 4) as q3)
select 'iqr_outlier' as check_name, 'value' as column_name,
  count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) = 0 as passed,
  'warning' as severity,
  'value in [' || printf('%.2f', q1 - 1.5 * (q3 - q1)) || ', ' || printf('%.2f', q3 + 1.5 * (q3 - q1)) || ']'
    as expected,
  round(count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) / count(*), 6)
    as actual,
  count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as failed_count,
  coalesce(array_to_string(list_slice(list(cast(event_id as varchar) order by event_id)
    filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)), 1, 5), ','), '') as sample_keys
from events, q group by q1, q3""")
def q_dq_12(spark, d):
    return flat(Q.check_iqr(table(spark, d, "events"), ["value"], 1.5, key="event_id")
                .withColumn("sample_keys", F.slice("sample_keys", 1, SAMPLES)))


# ----------------------------------------------------------------- DQ-13
DATES_TEXT_SQL = """(select o_orderkey, case when o_orderkey % 97 = 0 then '2024-02-30'
  else cast(cast(o_orderdate as date) as varchar) end as d from orders)"""


def _orders_date_text(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, "2024-02-30")
                    .otherwise(F.to_date("o_orderdate").cast("string")).alias("d"))


@register("dq_13", rules_sql(DATES_TEXT_SQL, "o_orderkey", [
    ("date_format", "d", "not (regexp_matches(coalesce(d, ''), '^\\d{4}-\\d{2}-\\d{2}$') and "
     "try_strptime(coalesce(d, ''), '%Y-%m-%d') is not null)", None, "error", "YYYY-MM-DD", 1.0)])
    + " union all " + rules_sql("pages", "page_id", [
        ("url_format", "url", "trim(coalesce(url, '')) <> '' and not regexp_matches(coalesce(url, ''), "
         "'^https?://[^\\s]+$')", None, "error", "http(s) url", 1.0)]))
def q_dq_13(spark, d):
    a = Q.evaluate_row_rules(_orders_date_text(spark, d), [Q.format_rule("d", "date")], "o_orderkey", SAMPLES)
    b = Q.evaluate_row_rules(table(spark, d, "pages"), [Q.format_rule("url", "url")], "page_id", SAMPLES)
    return flat(a.unionByName(b))


# ----------------------------------------------------------------- DQ-14/15
PHONES_SQL = """(select c_custkey, case c_custkey % 7 when 0 then '+1-555-' || c_custkey
  when 1 then '001' || c_custkey when 2 then '555.' || c_custkey when 3 then '555-' || c_custkey
  else '555' || c_custkey end as phone from customer)"""


def _phones(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 7
    return c.select("c_custkey", F.when(m == 0, F.concat(F.lit("+1-555-"), k))
                    .when(m == 1, F.concat(F.lit("001"), k)).when(m == 2, F.concat(F.lit("555."), k))
                    .when(m == 3, F.concat(F.lit("555-"), k)).otherwise(F.concat(F.lit("555"), k))
                    .alias("phone"))


@register("dq_14", f"""
with s as (select case when starts_with(phone, '+') then 'international'
  when starts_with(phone, '001') then '001-prefix' when contains(phone, '.') then 'dot-separated'
  when contains(phone, '-') then 'dash-separated' else 'plain' end as style from {PHONES_SQL}),
g as (select style, count(*) as c from s group by 1),
t as (select style, c from g order by c desc, style limit 1)
select (select count(*) from g) as formats_found, t.style as dominant_format,
  round(t.c * 100.0 / (select sum(c) from g), 2) as consistency_percentage,
  case when (select count(*) from g) <= 2 then 'PASS' else 'WARN' end as status from t""")
def q_dq_14(spark, d):
    return Q.phone_styles(_phones(spark, d), "phone")


@register("dq_15", """
select 'INFO' as status, min(cast(o_orderdate as date)) as oldest_record,
  max(cast(o_orderdate as date)) as latest_record,
  cast(date_diff('day', min(cast(o_orderdate as date)), max(cast(o_orderdate as date))) as integer)
    as date_range_days
from orders""")
def q_dq_15(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("d"))
    return Q.freshness_span(o, "d")


# ----------------------------------------------------------------- DQ-16
@register("dq_16", """
with s as (select l_orderkey, l_linenumber, l_returnflag from lineitem),
a as (select count(*) as n, (select count(*) from (select distinct * from s)) as d,
  (case when count(*) filter (where l_orderkey is null) > count(*) * 0.5 then 1 else 0 end
   + case when count(*) filter (where l_linenumber is null) > count(*) * 0.5 then 1 else 0 end
   + case when count(*) filter (where l_returnflag is null) > count(*) * 0.5 then 1 else 0 end) as high from s),
c as (select 'row_count' as check_name, case when n > 0 then 'PASS' else 'FAIL' end as status,
        cast(n as double) as value from a
  union all select 'high_null_columns', case when high = 0 then 'PASS' else 'WARN' end, high from a
  union all select 'duplicate_rows', case when n = d then 'PASS' else 'WARN' end, n - d from a
  union all select 'type_summary', 'INFO', 3.0 from a)
select * from c union all
select 'overall', case when bool_and(status in ('PASS', 'INFO')) then 'PASS' else 'FAIL' end, null from c""")
def q_dq_16(spark, d):
    g = Q.preload_gate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    return g.withColumnRenamed("check", "check_name")


# ----------------------------------------------------------------- DQ-18
@register("dq_18", rules_sql(SEEDED_ORDERS_SQL, "o_orderkey", [
    ("not_null", "o_totalprice", f"not {_present('o_totalprice')}", None, "error", "no nulls", 0.9),
    ("allowed_values", "o_orderstatus", "cast(o_orderstatus as varchar) not in ('O', 'F')",
     _present("o_orderstatus"), "error", "one of ['O', 'F']", 0.5),
    ("value_range", "o_totalprice", f"(({_num('o_totalprice')}) < 1000 or ({_num('o_totalprice')}) > 500000) "
     f"and not isnan({_num('o_totalprice')})", _present("o_totalprice"), "error", "[1000, 500000]", 0.99)]))
def q_dq_18(spark, d):
    rules = [Q.not_null_rule("o_totalprice"), Q.in_set_rule("o_orderstatus", ["O", "F"]),
             Q.range_rule("o_totalprice", 1000, 500000)]
    for r, m in zip(rules, (0.9, 0.5, 0.99)):
        r.mostly = m
    return flat(Q.evaluate_suite(seeded_orders(spark, d), rules, "o_orderkey", SAMPLES))


# ----------------------------------------------------------------- DQ-20..27
@register("dq_20", """
select 'mean_between' as check_name, 'o_totalprice' as column_name,
  coalesce(avg(o_totalprice) between 100000 and 200000, false) as passed, 'error' as severity,
  '[100000, 200000]' as expected, round(avg(o_totalprice), 6) as actual,
  cast(case when coalesce(avg(o_totalprice) between 100000 and 200000, false) then 0 else 1 end as bigint)
    as failed_count, '' as sample_keys from orders
union all
select 'max_between', 'o_totalprice', coalesce(max(o_totalprice) <= 400000, false), 'error',
  '[None, 400000]', round(max(o_totalprice), 6),
  case when coalesce(max(o_totalprice) <= 400000, false) then 0 else 1 end, '' from orders""")
def q_dq_20(spark, d):
    o = table(spark, d, "orders")
    return flat(Q.check_stat_between(o, "o_totalprice", "mean", 100000, 200000)
                .unionByName(Q.check_stat_between(o, "o_totalprice", "max", None, 400000)))


@register("dq_21", """
select 'pair_in_set' as check_name, 'l_returnflag,l_linestatus' as column_name, count(*) = 0 as passed,
  'error' as severity, '3 pairs' as expected, cast(count(*) as double) as actual, count(*) as failed_count,
  '' as sample_keys
from lineitem where (l_returnflag, l_linestatus) not in (('R', 'F'), ('A', 'F'), ('N', 'O'))""")
def q_dq_21(spark, d):
    return flat(Q.check_pair_in_set(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus",
                                    [("R", "F"), ("A", "F"), ("N", "O")]))


@register("dq_22", rules_sql("lineitem", None, [
    ("discount_bounds", None, "not coalesce(l_discount between 0 and 0.1, false)", None, "error",
     "l_discount between 0 and 0.1", 1.0)]) + """ union all
select 'equal_row_count', null, (select count(*) from orders) = (select count(distinct l_orderkey) from lineitem),
  'error', 'equal', (select count(*) from orders) - (select count(distinct l_orderkey) from lineitem),
  abs((select count(*) from orders) - (select count(distinct l_orderkey) from lineitem)), ''""")
def q_dq_22(spark, d):
    li = table(spark, d, "lineitem")
    e = Q.evaluate_row_rules(li, [Q.expression_rule("discount_bounds", "l_discount between 0 and 0.1")])
    c = Q.check_equal_rowcount(table(spark, d, "orders"), li.select("l_orderkey").distinct())
    return flat(e.unionByName(c))


@register("dq_23", """
select 'recency' as check_name, 'o_orderdate' as column_name,
  coalesce(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-15 00:00:00') / 3.6e9 <= 720, false)
    as passed, 'error' as severity, '<= 720 h' as expected,
  round(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-15 00:00:00') / 3.6e9, 6) as actual,
  cast(case when coalesce(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-15 00:00:00') / 3.6e9
    <= 720, false) then 0 else 1 end as bigint) as failed_count, '' as sample_keys
from orders""")
def q_dq_23(spark, d):
    return flat(Q.check_recency(table(spark, d, "orders"), "o_orderdate", 720, "2001-08-15 00:00:00"))


@register("dq_24", rules_sql("lineitem", None, [
    ("accepted_range", "l_quantity", "not (l_quantity >= 1 and l_quantity <= 45)",
     "l_quantity is not null and l_returnflag = 'R'", "error", "[1, 45]", 1.0)]))
def q_dq_24(spark, d):
    return flat(Q.evaluate_row_rules(table(spark, d, "lineitem"), [
        Q.accepted_range_rule("l_quantity", 1, 45, True, "l_returnflag = 'R'")]))


@register("dq_25", """
select 'relationship' as check_name, 'o_custkey' as column_name, count(*) = 0 as passed,
  'warning' as severity, 'references c_custkey' as expected, cast(count(*) as double) as actual,
  count(*) as failed_count, '' as sample_keys
from orders o where o_custkey is not null and not exists (
  select 1 from customer c where c.c_mktsegment <> 'BUILDING' and c.c_custkey = o.o_custkey)""")
def q_dq_25(spark, d):
    c = table(spark, d, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return flat(Q.check_relationship(table(spark, d, "orders"), "o_custkey", c, "c_custkey"))


@register("dq_26", """
select 'unique' as check_name, 'l_orderkey' as column_name,
  count(l_orderkey) - count(distinct l_orderkey) = 0 as passed, 'error' as severity,
  'all unique' as expected, cast(count(l_orderkey) - count(distinct l_orderkey) as double) as actual,
  count(l_orderkey) - count(distinct l_orderkey) as failed_count, '' as sample_keys
from lineitem where l_linenumber = 1""")
def q_dq_26(spark, d):
    return flat(Q.check_unique(table(spark, d, "lineitem"), ["l_orderkey"], where="l_linenumber = 1"))


@register("dq_27", f"""
with s as {SEEDED_CUSTOMER_SQL},
a as (select count(*) as n, count(*) filter (where c_acctbal is null) as z, count(distinct c_acctbal) as d,
  count(*) filter (where c_acctbal < 0 or c_acctbal > 9000) as r from s)
select 'null_rate' as check_name, 'c_acctbal' as column_name, z / n <= 0.1 as passed, 'error' as severity,
  '<= 0.1' as expected, round(z / n, 6) as actual, z as failed_count, '' as sample_keys from a
union all select 'duplicate_rate', 'c_acctbal', 1 - d / n <= 0.01, 'error', '<= 0.01', round(1 - d / n, 6),
  n - d, '' from a
union all select 'range_violation_rate', 'c_acctbal', r / n <= 0.2, 'error', '<= 0.2', round(r / n, 6), r, ''
  from a""")
def q_dq_27(spark, d):
    return flat(Q.rate_checks(seeded_customer(spark, d), "c_acctbal", 0.1, 0.01, 0, 9000, 0.2))


def _dq06_results(spark, d):
    rules = [Q.type_rule(c, t) for c, t in TYPE_SPEC]
    return Q.evaluate_row_rules(orders_as_text(spark, d), rules)


@register("dq_28", f"""
with r as ({rules_sql(ORDERS_TEXT_SQL, None, [
    ("data_type", c, _type_fail_sql(c, t), _present(c), "critical" if t == "integer" else "error", t, 1.0)
    for c, t in TYPE_SPEC])})
select count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed,
  count(*) filter (where not passed and severity = 'critical') as critical_failures,
  round(count(*) filter (where passed) * 100.0 / count(*), 6) as success_rate,
  count(*) filter (where not passed and severity = 'critical') = 0 as overall_passed
from r""")
def q_dq_28(spark, d):
    o = orders_as_text(spark, d)
    checks = [(c, "critical" if t == "integer" else "error",
               (lambda df, c=c, t=t: Q.evaluate_row_rules(df, [Q.type_rule(c, t)])))
              for c, t in TYPE_SPEC]
    res, summary = Q.run_checks(o, checks)
    return summary.select("total", "passed", "failed", "critical_failures", "success_rate", "overall_passed")


@register("dq_35", f"""
with r as ({rules_sql(ORDERS_TEXT_SQL, None, [
    ("data_type", c, _type_fail_sql(c, t), _present(c), "error", t, 1.0) for c, t in TYPE_SPEC])}
  union all {rules_sql(SEEDED_CUSTOMER_SQL, None, [
    ("not_null", c, f"not {_present(c)}", None, "warning", "no nulls", 1.0) for c in NN_COLS])})
select count(*) as total_checks, count(*) filter (where passed) as passed,
  count(*) filter (where not passed) as failed,
  count(*) filter (where not passed and severity = 'error') as errors,
  count(*) filter (where not passed and severity = 'warning') as warnings from r""")
def q_dq_35(spark, d):
    nn = []
    for c in NN_COLS:
        r = Q.not_null_rule(c)
        r.severity = "warning"
        nn.append(r)
    res = _dq06_results(spark, d).unionByName(Q.evaluate_row_rules(seeded_customer(spark, d), nn))
    return Q.summarize(res)


@register("dq_29", f"""
with prof as (
  select column_name, null_pct, distinct_pct, pattern from ({_profile_sql(ORDER_COLS, ORDERS_TEXT_SQL)})),
r as ({rules_sql(ORDERS_TEXT_SQL, None, [
    ("data_type", c, _type_fail_sql(c, t), _present(c), "error", t, 1.0) for c, t in TYPE_SPEC])}),
p as (select 100 - avg(null_pct) as completeness,
  coalesce(avg(distinct_pct) filter (where distinct_pct > 90), 100.0) as uniqueness,
  least(100.0, 50 + 50 * count(pattern) / count(*)) as accuracy from prof),
q as (select case when count(*) filter (where severity = 'error') = 0 then 100.0 else
    count(*) filter (where severity = 'error' and passed) * 100.0 / count(*) filter (where severity = 'error') end
    as validity,
  case when count(*) filter (where severity = 'warning') = 0 then 100.0 else
    count(*) filter (where severity = 'warning' and passed) * 100.0 / count(*) filter (where severity = 'warning') end
    as consistency from r)
select round(completeness, 6) as completeness, round(uniqueness, 6) as uniqueness, round(validity, 6) as validity,
  round(consistency, 6) as consistency, round(accuracy, 6) as accuracy,
  round(completeness * 0.25 + uniqueness * 0.15 + validity * 0.30 + consistency * 0.20 + accuracy * 0.10, 6)
    as overall
from p, q""")
def q_dq_29(spark, d):
    prof = P.profile_columns(orders_as_text(spark, d))
    s = Q.quality_score(prof, _dq06_results(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@register("dq_31", """
with daily as (select cast(o_orderdate as date) as day, count(*) as rows from orders group by 1),
m as (select *, avg(rows) over () as mean_rows from daily)
select day, rows, round(mean_rows, 6) as mean_rows, round(abs(rows - mean_rows) / mean_rows, 6) as deviation,
  abs(rows - mean_rows) / mean_rows > 0.5 as deviation_flag, rows < 3 as below_min, rows > 12 as above_max,
  cast(sum(rows) over () as bigint) as total_rows, sum(rows) over () < 1000 as below_min_rows,
  sum(rows) over () > 10000 as above_max_rows
from m""")
def q_dq_31(spark, d):
    v = Q.check_contract_volume(table(spark, d, "orders"), "o_orderdate", 1000, 10000, 3, 12)
    return v.select("day", "rows", F.round("mean_rows", 6).alias("mean_rows"),
                    F.round("deviation", 6).alias("deviation"), "deviation_flag", "below_min", "above_max",
                    "total_rows", "below_min_rows", "above_max_rows")


@register("dq_32", f"""
select * from ({rules_sql("orders", None, [
    ("not_null", c, f"not {_present(c)}", None, "error", "no nulls", 1.0)
    for c in ("o_orderkey", "o_custkey", "o_orderdate")] + [
    ("allowed_values", "o_orderstatus", "cast(o_orderstatus as varchar) not in ('O', 'F', 'P')",
     _present("o_orderstatus"), "error", "one of ['O', 'F', 'P']", 1.0),
    ("value_range", "o_totalprice", f"(({_num('o_totalprice')}) < 0) and not isnan({_num('o_totalprice')})",
     _present("o_totalprice"), "error", "[0, None]", 1.0)])})
union all
select 'unique', 'o_orderkey', count(o_orderkey) - count(distinct o_orderkey) = 0, 'error', 'all unique',
  round(count(o_orderkey) - count(distinct o_orderkey), 6), count(o_orderkey) - count(distinct o_orderkey), ''
  from orders
union all
select 'primary_key_unique', 'o_custkey,o_orderdate', d = 0, 'error', 'all unique', d, d, '' from
  (select count(*) as d from (select o_custkey, o_orderdate from orders group by all having count(*) > 1))
union all
select 'recency', 'o_orderdate',
  coalesce(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-02 00:00:00') / 3.6e9 <= 24, false),
  'error', '<= 24 h', round(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-02 00:00:00') / 3.6e9, 6),
  case when coalesce(date_diff('microsecond', max(o_orderdate), timestamp '2001-08-02 00:00:00') / 3.6e9 <= 24,
    false) then 0 else 1 end, '' from orders""")
def q_dq_32(spark, d):
    o = table(spark, d, "orders")
    rules = [Q.not_null_rule(c) for c in ("o_orderkey", "o_custkey", "o_orderdate")] + [
        Q.in_set_rule("o_orderstatus", ["O", "F", "P"]), Q.range_rule("o_totalprice", 0, None)]
    r = (Q.evaluate_row_rules(o, rules)
         .unionByName(Q.check_unique(o, ["o_orderkey"]))
         .unionByName(Q.check_primary_key(o, ["o_custkey", "o_orderdate"]))
         .unionByName(Q.check_recency(o, "o_orderdate", 24, "2001-08-02 00:00:00")))
    return flat(r)


# An order with its lines, seeded: text for a number in every third line, a negative
# quantity in every fifth, a bad status, a missing customer.
ORDER_SCHEMA = {
    "type": "object", "required": ["order_id", "customer_id"],
    "properties": {
        "order_id": {"type": "integer"}, "customer_id": {"type": "integer", "minimum": 1},
        "status": {"type": "string", "enum": ["O", "F", "P"]},
        "created_at": {"type": "timestamp"},
        "line_items": {"type": "array", "items": {
            "type": "object", "required": ["product_id", "quantity"],
            "properties": {"product_id": {"type": "integer"}, "quantity": {"type": "decimal", "minimum": 0},
                           "discounts": {"type": "array", "items": {"type": "number", "maximum": 0.05}}}}}}}


@register("dq_33_nested", """
with l as (select l_orderkey, l_linenumber, l_discount, row_number() over (partition by l_orderkey
  order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 as i from lineitem),
o as (select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem))
select l_orderkey as order_id, '$.line_items[' || i || '].quantity' as path, 'type: decimal expected, string found' as error
  from l where l_linenumber = 3
union all select l_orderkey, '$.line_items[' || i || '].quantity', 'minimum' from l where l_linenumber = 5
union all select l_orderkey, '$.line_items[' || i || '].discounts[1]', 'maximum' from l where l_discount > 0.05
union all select o_orderkey, '$.status', 'enum' from o where o_orderkey % 13 = 0
union all select o_orderkey, '$.customer_id', 'required' from o where o_orderkey % 7 = 0
union all select o_orderkey, '$.customer_id', 'minimum' from o where o_orderkey % 7 <> 0 and o_custkey < 1
union all select o_orderkey, '$.created_at', 'type: timestamp expected, string found' from o where o_orderkey % 11 = 0""")
def q_dq_33_nested(spark, d):
    """Orders as documents with an array of lines, each with an array of
    discounts; every violation with its path."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    quantity = (F.when(F.col("l_linenumber") == 3, F.lit('"many"')).when(F.col("l_linenumber") == 5, F.lit("-1"))
                .otherwise(F.col("l_quantity").cast("string")))
    line = F.concat(F.lit('{"product_id":'), F.col("l_partkey"), F.lit(',"quantity":'), quantity, F.lit(',"discounts":[0,'),
                    F.col("l_discount").cast("string"), F.lit("]}"))
    # the lines of an order, at most a handful
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", line.alias("line")))).alias("lines"))
    k = F.col("o_orderkey")
    doc = F.concat(
        F.lit('{"order_id":'), k, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(',"customer_id":'), F.col("o_custkey"))),
        F.lit(',"status":"'), F.when(k % 13 == 0, "?").otherwise(F.col("o_orderstatus")), F.lit('","created_at":"'),
        F.when(k % 11 == 0, "soon").otherwise(F.col("o_orderdate").cast("date").cast("string")), F.lit('","line_items":['),
        F.array_join(F.col("lines.line"), ","), F.lit("]}"))
    docs = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(k.alias("order_id"), doc.alias("doc"))
    return document_errors(docs, "doc", ORDER_SCHEMA, ["order_id"])


@register("dq_33", """
select event_id, coalesce(array_to_string(list_filter([
    case when try_cast(json_extract(props, '$.k') as integer) is null then 'required:k' end,
    case when try_cast(json_extract(props, '$.k') as integer) < 10 then 'minimum:k' end], lambda x: x is not null),
    ','), '') as errors,
  len(list_filter([
    case when try_cast(json_extract(props, '$.k') as integer) is null then 'required:k' end,
    case when try_cast(json_extract(props, '$.k') as integer) < 10 then 'minimum:k' end], lambda x: x is not null)) = 0
    as valid
from events""")
def q_dq_33(spark, d):
    v = Q.validate_json(table(spark, d, "events"), "props", "k int", ["k"], minimums={"k": 10}, key="event_id")
    return v.select("event_id", F.array_join("errors", ",").alias("errors"), "valid")


@register("dq_36", f"""
with s as {SEEDED_CUSTOMER_SQL}
select c_custkey, failed_rules <> '' as quarantined, failed_rules,
  case when failed_rules <> '' then true end as retryable from (
  select c_custkey, array_to_string(list_filter([
      case when not (c_name is not null and c_name <> '') then 'not_null:c_name' end,
      case when c_acctbal is not null and c_acctbal < 0 then 'value_range:c_acctbal' end], lambda x: x is not null),
    ', ') as failed_rules from s)""")
def q_dq_36(spark, d):
    s = seeded_customer(spark, d)
    rules = [Q.not_null_rule("c_name"), Q.RowRule("value_range", "c_acctbal", F.col("c_acctbal") < 0,
                                                 applies=F.col("c_acctbal").isNotNull())]
    good, bad = Q.split_quarantine(s, rules, 3, "2024-02-01 00:00:00")
    g = good.select("c_custkey", F.lit(False).alias("quarantined"), F.lit("").alias("failed_rules"),
                    F.lit(None).cast("boolean").alias("retryable"))
    b = bad.select("c_custkey", F.lit(True).alias("quarantined"),
                   F.array_join("failed_rules", ", ").alias("failed_rules"), "retryable")
    return g.unionByName(b)


# ----------------------------------------------------------------- schema-level checks

EXPECTED_CUSTOMER = ["c_custkey", "c_name", "c_phone"]


@register("dq_02", f"""
with e as (select unnest({EXPECTED_CUSTOMER!r}) as column_name),
c as (select column_name as present_name from information_schema.columns where table_name = 'customer')
select 'column_exists' as check_name, e.column_name, c.present_name is not null as passed, 'error' as severity,
  'column present' as expected, cast(case when c.present_name is not null then 1.0 else 0.0 end as double) as actual,
  cast(case when c.present_name is not null then 0 else 1 end as bigint) as failed_count, '' as sample_keys
from e left join c on c.present_name = e.column_name""")
def q_dq_02(spark, d):
    return flat(Q.check_columns(table(spark, d, "customer"), EXPECTED_CUSTOMER))


EXPECTED_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("dq_19", f"""
select 'column_set' as check_name, cast(null as varchar) as column_name,
  (select list_sort(list(column_name)) from information_schema.columns where table_name = 'orders')
    = list_sort({EXPECTED_ORDERS!r}) as passed, 'error' as severity, '{",".join(EXPECTED_ORDERS)}' as expected,
  cast(case when (select list_sort(list(column_name)) from information_schema.columns where table_name = 'orders')
    = list_sort({EXPECTED_ORDERS!r}) then 1.0 else 0.0 end as double) as actual,
  cast(case when (select list_sort(list(column_name)) from information_schema.columns where table_name = 'orders')
    = list_sort({EXPECTED_ORDERS!r}) then 0 else 1 end as bigint) as failed_count, '' as sample_keys""")
def q_dq_19(spark, d):
    return flat(Q.check_column_set(table(spark, d, "orders"), EXPECTED_ORDERS))


CONTRACT = [{"name": "o_orderkey", "type": "integer", "required": True},
            {"name": "o_totalprice", "type": "float", "required": True},
            {"name": "o_orderdate", "type": "datetime", "required": True},
            {"name": "o_orderstatus", "type": "string", "required": False},
            {"name": "o_discount", "type": "float", "required": False}]


def _group_sql(expr: str) -> str:
    whens = " ".join(f"when {expr} in ({', '.join(repr(t) for t in ts)}) then '{g}'"
                     for g, ts in Q.TYPE_GROUPS.items())
    return f"case {whens} else 'string' end"


def _dq30_sql():
    from .profile_queries import type_case_sql, type_count_sql
    idx = {c: i for i, c in enumerate(ORDER_COLS)}
    parts = []
    for f in CONTRACT:
        n = f["name"]
        if n not in ORDER_COLS:
            parts.append(f"select 'column_exists' as check_name, '{n}' as column_name, false as passed, 'error' as severity, "
                         f"'column present' as expected, 0.0 as actual, cast(1 as bigint) as failed_count, '' as sample_keys")
            continue
        det = type_case_sql(idx[n])
        ok = f"({_group_sql(det)}) = '{Q.type_group(f['type'])}'"
        parts.append(f"select 'type_compatible' as check_name, '{n}' as column_name, {ok} as passed, "
                     f"'error' as severity, '{f['type']}' as expected, case when {ok} then 1.0 else 0.0 end as actual, "
                     f"cast(case when {ok} then 0 else 1 end as bigint) as failed_count, {det} as sample_keys from a")
        if f.get("required"):
            miss = f"(select count(*) filter (where not {_present(n)}) from {ORDERS_TEXT_SQL})"
            parts.append(f"select 'not_null' as check_name, '{n}' as column_name, {miss} = 0 as passed, "
                         f"'error' as severity, 'no nulls' as expected, cast({miss} as double) as actual, "
                         f"{miss} as failed_count, '' as sample_keys")
    return f"with a as ({type_count_sql(ORDER_COLS, ORDERS_TEXT_SQL)}) " + " union all ".join(parts)


@register("dq_30", _dq30_sql())
def q_dq_30(spark, d):
    return flat(Q.check_contract_schema(orders_as_text(spark, d), CONTRACT))


def _fields(df, enums=None):
    enums = enums or {}
    rows = [(f.name, f.dataType.simpleString(), not f.nullable or f.name.endswith("key"), enums.get(f.name, []))
            for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "field string, type string, required boolean, enum_values array<string>")


@register("dq_34")
def q_dq_34(spark, d):
    """Contract change classes between the orders schema and an evolved
    version (price to decimal, priority dropped, optional comment added,
    a new status value), with the impact on two consumers."""
    o = table(spark, d, "orders")
    statuses = [r[0] for r in o.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]  # few values
    new = (o.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)")).drop("o_orderpriority")
           .withColumn("o_comment", F.lit(None).cast("string")))
    old_f = _fields(o, {"o_orderstatus": statuses})
    new_f = _fields(new, {"o_orderstatus": statuses + ["X"]})
    consumers = spark.createDataFrame([("finance", ["o_orderkey", "o_totalprice"]),
                                       ("ops", ["o_orderkey", "o_orderstatus"])],
                                      "consumer string, required_fields array<string>")
    diff = Q.contract_diff(old_f, new_f)
    impact = Q.contract_diff(old_f, new_f, consumers)
    return diff.crossJoin(impact.agg(F.to_json(F.collect_list(F.struct("consumer", "impacted_fields")))
                                     .alias("consumer_impact")))


@register("dq_04_qc", " union all ".join(f"""
select 'unique' as check_name, '{c}' as column_name, count(*) filter (where c > 1) = 0 as passed,
  'error' as severity, 'all unique' as expected, cast(count(*) filter (where c > 1) as double) as actual,
  count(*) filter (where c > 1) as failed_count, '' as sample_keys
from (select coalesce(cast({c} as varchar), '') as v, count(*) as c from {SEEDED_CUSTOMER_SQL} group by 1)"""
                                         for c in ("c_name", "c_mktsegment")))
def q_dq_04_qc(spark, d):
    """DQ-04, checker variant: number of distinct values seen more than
    once, empty text counted as a value."""
    return flat(Q.check_unique(seeded_customer(spark, d), ["c_name", "c_mktsegment"], variant="qc"))


@register("dq_03_qc", rules_sql("""(select c_custkey, case when c_custkey % 4 = 0 then '   ' else c_name end as c_name,
  c_mktsegment from customer)""", "c_custkey", [
    ("not_null", c, f"{c} is null or regexp_replace(cast({c} as varchar), '^\\s+|\\s+$', '', 'g') = ''", None,
     "error", "no nulls", 1.0) for c in ("c_name", "c_mktsegment")]))
def q_dq_03_qc(spark, d):
    """DQ-03, checker variant: blank text after trimming counts as missing."""
    c = table(spark, d, "customer")
    s = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "   ").otherwise(F.col("c_name")).alias("c_name"),
                 "c_mktsegment")
    return flat(Q.evaluate_row_rules(s, [Q.not_null_rule(c, blank=True) for c in ("c_name", "c_mktsegment")],
                                     "c_custkey", SAMPLES))
