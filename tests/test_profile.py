from lakesmith.operators import profile as P


def _types(spark, rows, reference_order=True):
    df = spark.createDataFrame([(v,) for v in rows], "c string")
    return P.detect_types(df, reference_order=reference_order).collect()[0]["inferred_type"]


def test_type_detection_thresholds_are_strict(spark):
    emails = [f"user{i}@example.com" for i in range(9)] + ["nope"]          # 90% is not > 90%
    assert _types(spark, emails) != "email"
    assert _types(spark, emails + [f"u{i}@example.org" for i in range(5)]) == "email"


def test_iso_dates_read_as_phone_in_reference_order(spark):
    dates = [f"2024-01-{d:02d}" for d in range(1, 21)]
    assert _types(spark, dates, reference_order=True) == "phone"
    assert _types(spark, dates, reference_order=False) == "date_iso"


def test_zero_one_is_boolean_and_numbers(spark):
    assert _types(spark, ["0", "1"] * 10) == "boolean"
    assert _types(spark, ["1_000", " 5 ", "-3", "42"] * 5) == "integer"
    assert _types(spark, ["1e3", "nan", "2.5", "inf", "7"] * 4) == "float"


def test_histogram_bins_sum_and_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(0, 301)], "x double")
    h = sorted(P.histogram(df, ["x"], 30).collect(), key=lambda r: r["bin"])
    assert len(h) == 30 and sum(r["count"] for r in h) == 301
    assert h[-1]["count"] == 11            # 290..300 with 300 included


def test_bias_corrected_moments_match_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.0, 9.0, 12.0, 4.0]
    s = P.shape(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"]).collect()[0]
    ps = pd.Series(vals)
    assert abs(s["skewness"] - ps.skew()) < 1e-9 and abs(s["kurtosis"] - ps.kurt()) < 1e-9


def test_profile_and_histogram_leave_out_nan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),), (None,)], "x double")
    row = P.profile_numeric(df, ["x"]).first()
    assert list(row)[1:6] == [10, 0.0, 9.0, 4.5, 4.5]
    assert [r["count"] for r in P.histogram(df, ["x"], 3).orderBy("bin").collect()] == [3, 3, 4]
