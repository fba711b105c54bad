"""The rank index, and what is read from it."""

import numpy as np
import pytest

from lakesmith.functions.ranks import column_index, quantiles_of, rank_index, rank_quantiles_of, value_at
from lakesmith.operators import ml as M


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000).round(2).tolist()
    b = [7.0] * 3000 + rng.integers(0, 50, 900).astype(float).tolist() + [None] * 50 + [float("nan")] * 50       # one value holds most rows
    return a, b, spark.createDataFrame(list(zip(a, b, [None] * 4000, strict=True)), "a double, b double, c double")


def test_ranks_of_all_columns(numbers):
    a, b, df = numbers
    got = {(r.column_name, r.v): (r.n, r.before) for r in column_index(df, ["a", "b", "c"]).collect()}
    for name, values in (("a", a), ("b", [x for x in b if x is not None and x == x])):
        s = np.sort(values)
        for v in set(values):
            assert got[name, v] == (int((s == v).sum()), int((s < v).sum()))
    assert not any(name == "c" for name, _ in got)


def test_quantiles_equal_numpy(numbers):
    a, b, df = numbers
    b = [x for x in b if x is not None and x == x]
    got = quantiles_of(df, ["a", "b", "c"], [0, 0.1, 0.5, 0.999, 1])
    assert np.allclose(got["a"], np.quantile(a, [0, 0.1, 0.5, 0.999, 1])) and np.allclose(got["b"], np.quantile(b, [0, 0.1, 0.5, 0.999, 1]))
    assert got["c"] == [None] * 5
    n, (q1, q3) = rank_quantiles_of(df, ["b"], [(1, 4), (3, 4)])["b"]
    assert (n, q1, q3) == (len(b), sorted(b)[len(b) // 4], sorted(b)[3 * len(b) // 4])


def test_the_source_is_scanned_once(spark, tmp_path):
    """The number of columns does not change the number of scans."""
    seen = spark.sparkContext.accumulator(0)
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr(*[f"cast(id % {k} as double) c{k}" for k in range(2, 9)]).coalesce(1).write.parquet(path)

    def spy(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    df = spark.read.parquet(path)
    quantiles_of(df.mapInArrow(spy, df.schema), df.columns, [0.25, 0.75])
    assert seen.value == 1000


def test_value_in_the_order_of_its_type(spark):
    df = spark.createDataFrame([(str(k),) for k in range(20)], "k string")
    assert value_at(df, df["k"], 3) == (sorted(map(str, range(20)))[3], 3)
    assert value_at(df, df["k"], 20) is None
    big = spark.createDataFrame([(2**53 + k, 0) for k in range(10)], "k long, t int")
    split = M.chronological_split(big, "t", "k", 0.5)
    assert {r.k - 2**53 for r in split.where("split = 'train'").collect()} == set(range(5))
    words = spark.createDataFrame([(f"k{k:02d}", 0) for k in range(10)], "k string, t int")
    assert {r.k for r in M.chronological_split(words, "t", "k", 0.8).where("split = 'test'").collect()} == {"k08", "k09"}


def test_groups_with_marks(spark):
    df = spark.createDataFrame([("x", 1.0, True), ("x", 1.0, False), ("x", 2.0, True), ("y", 1.0, False), (None, 3.0, True)],
                               "g string, v double, y boolean")
    got = sorted((str(r.g), r.v, r.n, r.before, r.pos) for r in rank_index(df, ["g"], "v", {"pos": df["y"]}).collect() if r.g)
    assert got == [("x", 1.0, 2, 0, 1), ("x", 2.0, 1, 2, 1), ("y", 1.0, 1, 0, 0)]


def test_multiclass_auc_equals_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for model, noise in (("m1", 0.5), ("m2", 2.0)):
        for k in range(300):
            label = "abc"[int(rng.integers(0, 3))]
            scores = {c: round(float((c == label) + rng.normal() * noise), 1) for c in "abc"}
            rows.append((model, k, label, scores))
    df = spark.createDataFrame(rows, "model string, id int, actual string, scores map<string,double>")
    got = {r.model: r.auc_roc for r in M.multiclass_auc(df).collect()}
    for model in got:
        mine, total = [r for r in rows if r[0] == model], 0.0
        for c in "abc":
            pos, neg = ([r[3][c] for r in mine if (r[2] == c) == yes] for yes in (True, False))
            pairs = np.subtract.outer(pos, neg)
            total += ((pairs > 0).mean() + (pairs == 0).mean() / 2) * len(pos)
        assert abs(got[model] - total / 300) < 1e-9
    one = df.where("actual = 'a'")
    assert {r.auc_roc for r in M.multiclass_auc(one).collect()} == {0.0}


def test_split_holds_the_share_of_every_label(spark):
    rows = [(k, "many") for k in range(400)] + [(k, "few") for k in range(400, 407)] + [(999, "one"), (1000, None), (1001, None)]
    got = M.stratified_split(spark.createDataFrame(rows, "id long, y string"), "id", "y", 0.8)
    n = {(r.y, r.split): r["count"] for r in got.groupBy("y", "split").count().collect()}
    assert n == {("many", "train"): 320, ("many", "test"): 80, ("few", "train"): 6, ("few", "test"): 1, ("one", "train"): 1,
                 (None, "train"): 1, (None, "test"): 1}


def test_any_number_of_levels(spark):
    train = spark.range(100_000).selectExpr("id as k", "concat('L', id) as big", "if(id % 3 = 0, 'x', 'y') as small", "double(id) as num")
    test = spark.createDataFrame([(1, "L7", "x", 1.0), (2, "unseen", None, None), (3, None, "z", 5.0)], "k long, big string, small string, num double")
    got = {r.k: r for r in M.preprocess_sparse(train, test, "k", ["num"], ["big", "small"]).collect()}
    order = sorted(f"L{i}" for i in range(100_000))
    assert got[1]["size"] == 100_003 and got[1]["indices"] == [0, 1 + order.index("L7"), 100_001] and got[1]["values"][1:] == [1.0, 1.0]
    assert got[2]["indices"] == [0, 100_002] and abs(got[2]["values"][0]) < 1e-9      # median for null, mode 'y'
    assert got[3]["indices"] == [0, 1 + order.index("L0")]                            # mode: the smallest of equals
    one = M.preprocess_sparse(train.limit(1001), test, "k", [], ["big"]).collect()
    assert {r["size"] for r in one} == {1001}


def test_sketches_merge(spark):
    from lakesmith.operators import warehouse as W
    df = spark.range(60_000).selectExpr("id % 7 as part", "id % 90 as few", "id % 5000 as some", "id as key", "if(id % 2 = 0, null, id) as half")
    cols = ["few", "some", "key", "half"]
    whole = {r.column_name: r for r in W.sketched_advice(W.column_sketches(df, cols), 2**40).collect()}
    merged = {r.column_name: r for r in W.sketched_advice(W.column_sketches(df, cols, df["part"]), 2**40).collect()}
    for c, n in (("few", 90), ("some", 5000), ("key", 60_000), ("half", 30_000)):
        assert merged[c].rows == 60_000 and abs(merged[c].cardinality - n) <= 0.06 * n and abs(whole[c].cardinality - n) <= 0.06 * n
    assert {c: r.partition_type for c, r in merged.items()} == {"few": "list", "some": "hash", "key": None, "half": None}
    assert merged["few"].cardinality == 90 and merged["half"].nulls == 30_000
