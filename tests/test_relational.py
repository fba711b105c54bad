import pytest
from pyspark.sql import functions as F

from lakesmith.operators import clean as C
from lakesmith.operators import relational as R
from lakesmith.sources.tables import table


def test_salted_join_equals_plain_join_on_hot_key(spark):
    big = spark.range(0, 3000).select(F.when(F.col("id") % 10 != 0, 0).otherwise(F.col("id")).alias("k"),
                                      F.col("id").alias("v"))           # 90% of rows on key 0
    small = big.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string")))
    a = sorted(R.salted_join(big, small, "k", salts=7).collect())
    b = sorted(big.join(small, "k").collect())
    assert a == b


def test_orphans_ignore_null_parent(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, pk int")
    parent = spark.createDataFrame([(10,), (None,)], "pk int")
    rows = R.orphans(child, "pk", parent, "pk").select("id").collect()
    assert [r.id for r in rows] == [2]          # NOT IN would return nothing here


def test_latest_per_key_and_fill_gaps(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None), (2, 1, None), (2, 2, None)],
                               "k int, t int, v double")
    last = {r.k: r.t for r in R.latest_per_key(df, "k", ["t"]).collect()}
    assert last == {1: 3, 2: 2}
    filled = {(r.k, r.t): r.v for r in C.fill_gaps(df, "k", "t", ["v"]).collect()}
    assert filled[(1, 1)] == 5.0 and filled[(1, 3)] == 5.0 and filled[(2, 1)] is None


def test_lag_features_backfill_head(spark):
    df = spark.createDataFrame([(1, i, float(i * 10)) for i in range(1, 6)], "k int, t int, v double")
    r = {x.t: (x.v_lag1, x.v_lag3) for x in R.lag_features(df, "k", "t", ["v"]).collect()}
    assert r[1] == (10.0, 10.0) and r[2] == (10.0, 10.0) and r[4] == (30.0, 10.0) and r[5] == (40.0, 20.0)


def test_normalize_columns_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`First Name` int, `first-name` int, `__x__` int")
    assert C.normalize_columns(df).columns == ["first_name", "first_name_2", "x"]


def test_value_counts_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    assert [tuple(r) for r in R.value_counts(df, "x", 3).collect()] == [("c", 2), ("a", 1), ("b", 1)]


def test_traverse_levels(spark, sf_small):
    from lakesmith.plans.relational_queries import graph_tables
    edges, names = graph_tables(spark, sf_small)
    start = spark.createDataFrame([("r0",)], "start_id string")
    out = R.traverse(start, edges, ["HAS_NATION"], names)
    n = table(spark, sf_small, "nation").where("n_regionkey = 0").count()
    assert out.count() == n


def test_bucketed_windows_equal_plain_windows_with_sparse_buckets(spark, sf_small):
    ev = table(spark, sf_small, "events").select("event_id", "user_id", "ts",
                                                 F.when(F.col("event_id") % 5 == 0, None)
                                                 .otherwise(F.col("value")).alias("value"))
    minute = F.date_trunc("minute", "ts")          # most buckets hold one row: halos span buckets
    order = ["ts", "event_id"]
    a = R.lag_features_bucketed(ev, "user_id", order, ["value"], minute, force=True)
    b = R.lag_features(ev, "user_id", order, ["value"])
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    c = R.rolling_mean_bucketed(ev, "user_id", order, ["value"], minute, force=True)
    d = R.rolling_mean(ev, "user_id", order, ["value"])
    assert sorted(c.collect()) == sorted(d.select(*c.columns).collect())
    e = R.fill_gaps_bucketed(ev, "user_id", order, ["value"], minute, force=True)
    f = C.fill_gaps(ev, "user_id", order, ["value"])
    assert sorted(e.collect()) == sorted(f.select(*e.columns).collect())


def test_hot_key_detection(spark):
    hot = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    even = spark.range(0, 4000).select((F.col("id") % 500).alias("k"))
    assert R.key_is_hot(hot, "k") and not R.key_is_hot(even, "k")


def test_lag_features_keeps_every_column(spark):
    cols = [f"c{i}" for i in range(10)]
    df = spark.createDataFrame([("a", t, *[t * 10 + i for i in range(10)]) for t in range(5)], ["k", "t", *cols])
    out = R.lag_features(df, "k", "t", cols)
    assert {f"{c}_lag{n}" for c in cols for n in (1, 3)} <= set(out.columns)


def test_salted_join_refuses_joins_that_keep_the_small_side(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for how in ("right", "full", "full_outer"):
        with pytest.raises(ValueError):
            R.salted_join(df, df, "k", how=how)


def test_connected_components_of_a_long_chain(spark):
    from lakesmith.plans.scale import connected_components
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 71)] + [(100, 100), (202, 201)], "a long, b long")
    got = {r.id: r.label for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 72), 1), 100: 100, 201: 201, 202: 201}
