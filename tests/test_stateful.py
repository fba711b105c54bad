"""Keyed state with timers: keys that share a bucket keep apart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import rules as Q
from lakesmith.streaming import stateful as X
from lakesmith.streaming import windows as S

DAY = datetime(2024, 1, 1)


def _runs(spark, tmp_path, runs, schema, query):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    with X.with_state_store(spark):
        for rows in runs:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            X.run_available(query(spark.readStream.schema(schema).parquet(src)), out, ckpt)
    return spark.read.parquet(out)


@pytest.mark.parametrize("buckets", [1, 3])
def test_sessions_of_keys_in_one_bucket(spark, tmp_path, buckets):
    keys = ["a", "b", None, "d"]
    at = {k: [0, 10, 40 + i, 75 + i, 200, 229] for i, k in enumerate(keys)}      # minutes
    rows = [(k, DAY + timedelta(minutes=m), 1.5) for k in keys for m in at[k]]
    rows.sort(key=lambda r: r[1])
    end = [("z", DAY + timedelta(days=1), 1.0)]
    runs = [rows[:9], rows[9:], end]
    got = _runs(spark, tmp_path, runs, "user_id string, ts timestamp_ntz, value double",
                lambda s: X.sessions_on_timeout(S.event_time(s), buckets=buckets))
    want = []
    for k in keys:
        groups = [[at[k][0]]]
        for m in at[k][1:]:
            if m - groups[-1][-1] <= 30:
                groups[-1].append(m)
            else:
                groups.append([m])
        want += [(k, DAY + timedelta(minutes=g[0]), DAY + timedelta(minutes=g[-1] + 30), len(g), 1.5 * len(g)) for g in groups]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_retries_of_keys_in_one_bucket_and_expiry(spark, tmp_path):
    rule = Q.RowRule("value_range", "v", F.col("v") < 0, applies=F.col("v").isNotNull())

    def day(n):
        return DAY + timedelta(days=n)
    runs = [[(1, -1.0, day(0)), (2, 1.0, day(0)), (3, -1.0, day(0)), (None, -1.0, day(0))],
            [(1, -1.0, day(1)), (3, 1.0, day(1)), (None, 2.0, day(1))],
            [(1, -1.0, day(2)), (4, -1.0, day(2))], [(1, -1.0, day(3))], [(5, 1.0, day(60))]]
    got = _runs(spark, tmp_path, runs, "k long, v double, event_time timestamp",
                lambda s: X.quarantine_with_retries(s, [rule], "k", buckets=1))
    assert sorted(((r.k, r.attempt, r.status) for r in got.collect()), key=str) == sorted([
        (1, 1, "retry"), (1, 2, "retry"), (1, 3, "dead"), (1, 3, "expired"), (2, 0, "passed"), (3, 1, "retry"), (3, 1, "released"),
        (4, 1, "retry"), (4, 1, "expired"), (5, 0, "passed"), (None, 1, "retry"), (None, 1, "released")], key=str)


def test_state_calls_are_bounded_by_buckets(spark, sf_small):
    ev = S.event_time(spark.read.parquet(f"{sf_small}/events.parquet"))
    calls = ev.select(X.bucket_of("user_id", 4).alias("b")).distinct().count()
    assert calls <= 4 < ev.select("user_id").distinct().count()
