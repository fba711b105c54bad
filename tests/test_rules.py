from lakesmith.operators import rules as Q


def _bad_customers(spark):
    rows = [
        ("CUST00000000001", "Ann", "ann@example.com", "2024-01-05", "+1-555-0100", "http://a.example.com"),
        ("", "Bob", "bob@example.com", "2024-02-30", "001-555-0101", "ftp://b.example.com"),
        ("CUST00000000003", "  ", "ann@example.com", "2024-03-01", "555.0102", ""),
        ("CUST0000000004", "Dee", "dee(at)example.com", "2024-13-01", "555-0103", "https://d.example.com"),
        ("CUST00000000005", "Eve", "eve@example.com", "2023-12-31", "5550104", "https://e.example.com"),
    ]
    return spark.createDataFrame(rows, "id string, name string, email string, sub_date string, "
                                       "phone string, site string")


def test_row_rules_fused(spark):
    df = _bad_customers(spark)
    res = {r.check_name + ":" + (r.column_name or ""): r for r in Q.evaluate_row_rules(df, [
        Q.not_null_rule("id"), Q.not_null_rule("name", blank=True), Q.format_rule("email", "email"),
        Q.format_rule("sub_date", "date"), Q.format_rule("site", "url"), Q.length_rule("id", 15, 15),
    ], key="id").collect()}
    assert res["not_null:id"].failed_count == 1
    assert res["not_null:name"].failed_count == 1
    assert res["email_format:email"].failed_count == 1
    assert res["date_format:sub_date"].failed_count == 2          # Feb 30 and month 13
    assert res["url_format:site"].failed_count == 1               # blank allowed, ftp fails
    assert res["string_length:id"].failed_count == 1
    assert res["not_null:id"].sample_keys == [""]


def test_type_rule_uses_python_number_forms(spark):
    df = spark.createDataFrame([(v,) for v in ["5d", "1_000", " 5 ", "nan", "inf", "1e3", ""]], "v string")
    r = {x.expected: x.failed_count for x in Q.evaluate_row_rules(
        df, [Q.type_rule("v", "integer"), Q.type_rule("v", "float")]).collect()}
    assert r["integer"] == 4          # 5d nan inf 1e3 (empty is not evaluated)
    assert r["float"] == 1            # only 5d


def test_range_rule_ignores_nan_and_text(spark):
    df = spark.createDataFrame([(v,) for v in ["5", "50", "nan", "abc", "-1"]], "v string")
    r = Q.evaluate_row_rules(df, [Q.range_rule("v", 0, 10)]).collect()[0]
    assert r.failed_count == 2


def test_zscore_needs_ten_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 100]], "v double")
    assert Q.check_zscore(df, ["v"]).count() == 0


def test_phone_styles(spark):
    r = Q.phone_styles(_bad_customers(spark), "phone").collect()[0]
    assert r.formats_found == 5 and r.status == "WARN"


def test_primary_key_counts_combinations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, None), (2, None), (3, 1)], "a int, b int")
    assert Q.check_primary_key(df, ["a", "b"]).collect()[0].failed_count == 2


def test_quarantine_split(spark):
    df = _bad_customers(spark)
    good, bad = Q.split_quarantine(df, [Q.not_null_rule("id"), Q.format_rule("email", "email")], 3,
                                   "2024-01-01 00:00:00")
    assert good.count() + bad.count() == df.count()
    assert all(r.retryable for r in bad.collect())


def test_contract_diff(spark):
    old = spark.createDataFrame([("order_id", "string", True, []), ("status", "string", True, ["a", "b"]),
                                 ("legacy", "string", False, [])],
                                "field string, type string, required boolean, enum_values array<string>")
    new = spark.createDataFrame([("order_id", "int", True, []), ("status", "string", True, ["a", "b", "c"]),
                                 ("discount", "double", False, [])],
                                "field string, type string, required boolean, enum_values array<string>")
    d = {r.field: (r.change, r.breaking) for r in Q.contract_diff(old, new).collect()}
    assert d == {"order_id": ("type_changed", True), "status": ("enum_value_added", False),
                 "legacy": ("field_removed", False), "discount": ("optional_field_added", False)}
