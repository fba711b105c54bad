"""Micro-batch targets in buckets: what is rewritten, who wins, what a lost
marker means."""

import json
import os

import pytest

from lakesmith.sources import sinks as SK
from lakesmith.streaming import sinks as K


def rows(spark, root):
    return {r.k: r.v for r in K.VersionedTable(spark, root).read().collect()}


def test_a_small_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    fn = K.upsert_batch_fn(root, "k")
    fn(spark.range(2000).selectExpr("id as k", "0 as v"), 0)
    before = K.VersionedTable(spark, root).state()["live"]
    fn(spark.range(10).selectExpr("id * 7 as k", "1 as v"), 1)
    after = K.VersionedTable(spark, root).state()["live"]
    moved = [b for b in before if before[b] != after[b]]
    assert len(before) == 64 and 1 <= len(moved) <= 10
    got = rows(spark, root)
    assert len(got) == 2000 and {k for k, v in got.items() if v == 1} == {7 * i for i in range(10)}


def test_deletes_can_empty_a_bucket(spark, tmp_path):
    root = str(tmp_path / "t")
    fn = K.cdc_batch_fn(root, "k", "t", ["k", "v"], buckets=4)
    schema = "op string, k int, v string, t int"
    fn(spark.createDataFrame([("c", k, "a", 1) for k in range(6)], schema), 0)
    fn(spark.createDataFrame([("d", k, None, 2) for k in range(6)] + [("u", 0, "z", 3)], schema), 1)
    assert rows(spark, root) == {0: "z"}
    fn(spark.createDataFrame([("d", 0, None, 4)], schema), 2)
    assert rows(spark, root) == {}


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "t")
    K.upsert_batch_fn(root, "k")(spark.createDataFrame([(1, "a")], "k int, v string"), 0)
    first, second = K.VersionedTable(spark, root), K.VersionedTable(spark, root)
    stale = second.state()
    second.state = lambda: stale        # has read the table before the other one commits
    batch = spark.createDataFrame([(1, "b", 1)], "k int, v string, batch_id long")
    first.merge(batch, ["k"], batch.columns, 1, lambda rows, new: new)
    with pytest.raises(SK.CommitConflict):
        second.merge(batch, ["k"], batch.columns, 1, lambda rows, new: new)
    assert rows(spark, root) == {1: "b"}


def test_lost_newest_marker(spark, tmp_path):
    """The state before is in force again, and the batch is applied again."""
    root = str(tmp_path / "t")
    fn = K.upsert_batch_fn(root, "k")
    for batch, value in enumerate("ab"):
        fn(spark.createDataFrame([(1, value), (batch + 10, value)], "k int, v string"), batch)
    os.remove(f"{root}/commits/{1:012d}")
    assert rows(spark, root) == {1: "a", 10: "a"}
    fn(spark.createDataFrame([(1, "b"), (11, "b")], "k int, v string"), 1)
    assert rows(spark, root) == {1: "b", 10: "a", 11: "b"}
    open(f"{root}/commits/{2:012d}", "w").close()       # opened by a writer that died
    assert rows(spark, root) == {1: "b", 10: "a", 11: "b"}


def test_staged_loads_race(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    SK.stage_parquet(spark.range(1), root)
    real, raced = SK.last_commit, []

    def slow(s, r):
        seen = real(s, r)
        if not raced:       # another loader commits between the look and the marker
            raced.append(1)
            SK.stage_parquet(spark.range(10, 12), root, "append")
        return seen
    monkeypatch.setattr(SK, "last_commit", slow)
    SK.stage_parquet(spark.range(20, 23), root, "append")
    monkeypatch.undo()
    assert sorted(r.id for r in SK.read_staged(spark, root).collect()) == [0, 10, 11, 20, 21, 22]
    assert len(json.loads(real(spark, root)[1])) == 3
    other = str(tmp_path / "u")
    spark.range(1).write.parquet(f"{other}/v-1")
    with pytest.raises(RuntimeError):
        SK.read_staged(spark, other)
