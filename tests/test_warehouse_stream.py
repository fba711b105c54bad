import tempfile

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import rules as Q
from lakesmith.operators import warehouse as W
from lakesmith.sources.tables import table
from lakesmith.streaming import sinks as K
from lakesmith.streaming import windows as S

SCHEMA = "k int, name string, city string"


def test_scd2_one_current_row_per_key(spark):
    dim = W.scd2_init(spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (5, "e", "q")],
                                            SCHEMA), "2024-01-01")
    stage = spark.createDataFrame([(1, "a", "x"), (2, "b", "Y"), (3, "c", None), (4, "d", "w")], SCHEMA)
    out = W.scd2_merge(dim, stage, "k", ["name", "city"], "2024-02-01")
    cur = out.where("is_current").groupBy("k").count().collect()
    assert all(r["count"] == 1 for r in cur) and len(cur) == 5       # key 5 (gone from stage) stays
    assert out.count() == 7                                          # two changed keys add versions
    closed = out.where(~F.col("is_current")).select("k").collect()
    assert sorted(r.k for r in closed) == [2, 3]


def test_cdc_replay_twice_equals_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    ch = spark.createDataFrame([("u", 1, "a2", 2), ("d", 2, None, 3), ("c", 3, "c", 1), ("d", 3, None, 2),
                                ("c", 3, "c2", 5), ("r", 4, "d", 1)], "op string, k int, v string, ts int")
    once = W.apply_cdc(target, ch, "k", "ts")
    twice = W.apply_cdc(once, ch, "k", "ts")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a2"), (3, "c2"), (4, "d")]


def test_stream_tumbling_equals_batch(spark, sf_small):
    src = table(spark, sf_small, "events")
    d = tempfile.mkdtemp(prefix="ls-stream-")
    src.write.mode("overwrite").parquet(f"{d}/in")
    stream = S.event_time(spark.readStream.schema(src.schema).parquet(f"{d}/in"))
    q = (S.tumbling_counts(stream, watermark="5 minutes").writeStream.outputMode("complete")
         .format("memory").queryName("tumble_t").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from tumble_t").collect())
    want = sorted(tuple(r) for r in S.tumbling_counts(src, ts="ts", watermark=None).collect())
    assert got == want


def test_sessionize_batch_equals_session_window(spark, sf_small):
    ev = table(spark, sf_small, "events")
    a = S.sessionize(ev, gap_seconds=1800).select("user_id", "session_start", "event_count")
    a2 = S.sessionize(ev, gap_seconds=1800, force_buckets=True).select("user_id", "session_start", "event_count")
    assert sorted(a.collect()) == sorted(a2.collect())
    b = (ev.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("s"))
         .agg(F.count(F.lit(1)).alias("event_count"))
         .select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "event_count"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_foreach_batch_upsert_replay_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="ls-upsert-")
    fn = K.upsert_batch_fn(root, "k")
    b0 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b1 = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    fn(b0, 0)
    fn(b1, 1)
    fn(b1, 1)                                   # replayed batch id is skipped
    t = K.VersionedTable(spark, root).read()
    assert sorted((r.k, r.v) for r in t.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_stream_dedupe_within_watermark(spark, sf_small):
    src = table(spark, sf_small, "events")
    d = tempfile.mkdtemp(prefix="ls-dedupe-")
    src.unionByName(src).write.mode("overwrite").parquet(f"{d}/in")
    stream = S.event_time(spark.readStream.schema(src.schema).parquet(f"{d}/in"))
    q = (S.stream_dedupe(stream).writeStream.outputMode("append").format("memory")
         .queryName("dedupe_t").start())
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) c from dedupe_t").collect()[0].c == src.count()


def test_hub_load_idempotent_and_sat_closes_only_changed(spark):
    from lakesmith.functions.scalars import row_hash
    stage = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, name string, v double")
    hub0 = spark.createDataFrame([], "hub_key string, k int, load_date date, record_source string")
    h1 = W.hub_load(hub0, stage, "k", "crm", "2024-01-01")
    h2 = W.hub_load(h1, stage, "k", "crm", "2024-02-01")
    assert h1.count() == 3 and sorted(h2.collect()) == sorted(h1.collect())
    sat = stage.where("k < 3").select(F.md5(F.col("k").cast("string")).alias("hub_key"), "name", "v",
                                      row_hash("name", "v").alias("hash_diff"),
                                      F.lit("2024-01-01").cast("date").alias("load_date"),
                                      F.lit(None).cast("date").alias("load_end_date"),
                                      F.lit("crm").alias("record_source"))
    new_stage = spark.createDataFrame([(1, "a", 1.0), (2, "B", 2.0), (3, "c", 3.0)], "k int, name string, v double")
    out = W.sat_load(sat, new_stage, "k", ["name", "v"], "crm", "2024-02-01")
    closed = out.where("load_end_date is not null").select("name").collect()
    assert [r.name for r in closed] == ["b"] and out.count() == 4       # unchanged key 1 stays open


def test_chronological_split_disjoint_and_complete(spark, sf_small):
    from lakesmith.operators import ml as M
    from lakesmith.sources.tables import table
    o = table(spark, sf_small, "orders").select("o_orderkey", "o_orderdate")
    s = M.chronological_split(o, "o_orderdate", "o_orderkey")
    n = o.count()
    tr = s.where("split = 'train'")
    assert tr.count() == int(n * 0.8) and s.count() == n
    last_train = tr.agg(F.max(F.struct("o_orderdate", "o_orderkey"))).collect()[0][0]
    first_test = s.where("split = 'test'").agg(F.min(F.struct("o_orderdate", "o_orderkey"))).collect()[0][0]
    assert tuple(last_train) < tuple(first_test)


def test_message_stream_parse_equals_batch(spark, sf_small):
    from lakesmith.sources import readers as RD
    src = table(spark, sf_small, "events").select("event_id", "ts", "user_id", "event_type", "value")
    d = tempfile.mkdtemp(prefix="ls-msg-")
    RD.to_messages(src).write.mode("overwrite").text(f"{d}/in")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    raw = spark.readStream.format("text").load(f"{d}/in")
    q = (RD.parse_messages(raw, schema).writeStream.format("memory").queryName("msgs_t")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("select * from msgs_t").collect()) == sorted(src.collect())


def test_watermark_drops_late_rows_in_stream(spark):
    d = tempfile.mkdtemp(prefix="ls-late-")
    schema = "k int, ts timestamp_ntz"
    # batch 1 moves the watermark to 10:00 - 10 min; batch 2 holds a row far behind it
    spark.createDataFrame([(1, "2024-01-01 10:00:00")], "k int, ts string") \
        .selectExpr("k", "cast(ts as timestamp_ntz) ts").write.mode("append").parquet(f"{d}/in")
    stream = S.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in"))
    agg = S.tumbling_counts(stream, watermark="10 minutes", keys=("k",))
    q = agg.writeStream.outputMode("update").format("memory").queryName("late_t").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, "2024-01-01 09:00:00"), (1, "2024-01-01 10:05:00")], "k int, ts string") \
        .selectExpr("k", "cast(ts as timestamp_ntz) ts").write.mode("append").parquet(f"{d}/in")
    q.processAllAvailable()
    dropped = S.dropped_by_watermark(q)
    starts = {r.window_start.hour for r in spark.sql("select * from late_t").collect()}
    q.stop()
    assert dropped == 1 and 9 not in starts


def test_stream_sessions_equal_batch_sessions(spark, sf_small):
    src = table(spark, sf_small, "events")
    d = tempfile.mkdtemp(prefix="ls-sess-")
    src.write.mode("overwrite").parquet(f"{d}/in")
    stream = S.event_time(spark.readStream.schema(src.schema).parquet(f"{d}/in"))
    q = (S.sessionize_stream(stream, watermark=None).writeStream.outputMode("complete")
         .format("memory").queryName("sess_t").start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.user_id, r.session_start, r.event_count)
                 for r in spark.sql("select * from sess_t").collect())
    want = sorted((r.user_id, r.session_start, r.event_count)
                  for r in S.sessionize(src, gap_seconds=1800).collect())
    assert got == want


def test_stream_sliding_equals_batch(spark, sf_small):
    src = table(spark, sf_small, "events")
    d = tempfile.mkdtemp(prefix="ls-slide-")
    src.write.mode("overwrite").parquet(f"{d}/in")
    stream = S.event_time(spark.readStream.schema(src.schema).parquet(f"{d}/in"))
    q = (S.sliding_counts(stream, watermark="10 minutes").writeStream.outputMode("complete")
         .format("memory").queryName("slide_t").start())
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from slide_t").collect())
    want = sorted(tuple(r) for r in S.sliding_counts(src, ts="ts", watermark=None).collect())
    assert got == want


def test_upsert_first_batch_is_reduced_and_a_lost_marker_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="ls-upsert-")
    fn = K.upsert_batch_fn(root, "k", ["t"])
    fn(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string"), 0)
    table = K.VersionedTable(spark, root)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "b"), (2, "c")]
    fn(spark.createDataFrame([(2, 2, "d")], "k int, t int, v string"), 1)
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "b"), (2, "d")]
    # a reader that sees versions without any marker does not take the table for empty
    other = tempfile.mkdtemp(prefix="ls-upsert-")
    spark.range(3).write.parquet(f"{other}/v0")
    with pytest.raises(RuntimeError):
        K.VersionedTable(spark, other).read()


def test_quarantine_replay_keeps_each_row_once(spark):
    d = tempfile.mkdtemp(prefix="ls-quarantine-")
    fn = K.quarantine_batch_fn(f"{d}/good", f"{d}/bad", [Q.not_null_rule("v")])
    for batch, ident in ((0, 1), (0, 1), (1, 2)):
        fn(spark.createDataFrame([(ident, "x"), (ident, None)], "k int, v string"), batch)
    assert sorted(r.k for r in spark.read.parquet(f"{d}/good").collect()) == [1, 2]
    assert sorted(r.k for r in spark.read.parquet(f"{d}/bad").collect()) == [1, 2]
