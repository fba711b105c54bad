"""Suites: every kind is written, read back and green on its own table; each
kind turns red when the data break it."""

import pytest

from lakesmith.operators import suites as SU


@pytest.fixture(scope="module")
def people(spark):
    rows = [(str(k), f"u{k}@ex.org", f"2024-0{k % 9 + 1}-1{k % 10}", "north" if k % 2 else "south", f"{k}.5" if k % 20 else "",
             "x" * (k % 7 + 1) + "?") for k in range(1, 401)]
    return spark.createDataFrame(rows, "id string, mail string, day string, zone string, amount string, note string")


def outcome(df, suite):
    return {(r["expectation"].removeprefix("expect_"), r["column_name"]): (r["success"], r["observed"], r["unexpected_count"])
            for r in SU.evaluate(df, suite).collect()}


@pytest.fixture(scope="module")
def suite(spark, people, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("suite") / "s")
    SU.generate(SU.column_facts(people, reference_order=False), people.count()).write.parquet(path)
    return spark.read.parquet(path)


def test_all_kinds_are_written_and_green(people, suite):
    got = outcome(people, suite)
    kinds = {k for k, _ in got}
    assert kinds == {"column_to_exist", "column_values_to_not_be_null", "column_values_to_be_unique", "column_values_to_be_in_type_list",
                     "column_values_to_be_between", "column_values_to_match_regex", "column_values_to_match_strftime_format",
                     "column_value_lengths_to_be_between", "column_values_to_be_in_set", "table_row_count_to_be_between",
                     "table_column_count_to_equal"}
    assert all(ok for ok, _, _ in got.values()), got
    row = suite.where("expectation = 'expect_column_values_to_not_be_null' and column_name = 'amount'").first()
    assert abs(row["mostly"] - (1 - 0.05 * 1.5)) < 1e-9


def test_each_kind_turns_red(spark, people, suite):
    bad = people.selectExpr(
        "if(int(id) <= 40, '1', id) id", "if(id = '5', 'nobody', mail) mail", "if(id = '6', '2024-13-01', day) day",
        "if(int(id) <= 50, 'wests', zone) zone", "if(int(id) <= 200, null, if(id = '300', 'lots', amount)) amount",
        "if(id = '9', repeat('z', 99), note) note").unionByName(people.limit(0))
    got = outcome(bad, suite)
    red = {k for k, (ok, _, _) in got.items() if not ok}
    assert red == {("column_values_to_be_unique", "id"), ("column_values_to_match_regex", "mail"),
                   ("column_values_to_match_strftime_format", "day"), ("column_values_to_be_in_set", "zone"),
                   ("column_values_to_not_be_null", "amount"), ("column_values_to_be_in_type_list", "amount"),
                   ("column_values_to_be_between", "amount"), ("column_value_lengths_to_be_between", "note")} | (
                       {("column_values_to_be_unique", "mail")} & red)
    assert got["column_values_to_be_unique", "id"][2] == 40
    assert got["column_values_to_match_regex", "mail"] == (False, 1 - 1 / 400, 1)
    small = outcome(people.drop("note").limit(100), suite)
    assert not small["table_row_count_to_be_between", None][0] and not small["table_column_count_to_equal", None][0]
    assert not small["column_to_exist", "note"][0] and small["column_value_lengths_to_be_between", "note"] == (False, 0.0, 100)


def test_small_and_empty_tables(spark):
    one = spark.createDataFrame([("a",)], "c string")
    rows = {r["expectation"]: r for r in SU.generate(SU.column_facts(one), 1).collect()}
    assert rows["expect_table_row_count_to_be_between"]["min_value"] == 1.0
    empty = one.limit(0)
    got = outcome(empty, SU.generate(SU.column_facts(one), 1))
    assert not got["table_row_count_to_be_between", None][0] and got["column_values_to_not_be_null", "c"][0]
    with pytest.raises(ValueError, match="unknown expectation"):
        SU.evaluate(one, spark.createDataFrame([("expect_luck", "c", None, None, None, None, 1.0)], SU.SUITE_SCHEMA))
