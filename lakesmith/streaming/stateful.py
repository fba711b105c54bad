"""Keyed state with event-time timers: sessions that are emitted once, when
their timer fires (ST-03), and quarantined records that carry their number
of attempts from batch to batch (ST-08).

Both run as ``transformWithStateInPandas``: state lives in the state store
under the checkpoint, so it survives lost executors and restarts; a timer is
an event time, and it fires when the watermark has passed it. A call of a
processor costs milliseconds whatever it is given, so keys share a call, a
state and a timer by buckets of their hash: calls are bounded by the number
of buckets, which stays fixed for the life of a checkpoint. Null keys have a
bucket of their own. The processors need a state store with column families
(:func:`with_state_store`).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.rules import RowRule, failed_rules

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that timers need."""
    before = spark.conf.get(_STORE_KEY, None)
    spark.conf.set(_STORE_KEY, STATE_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE_KEY)
        else:
            spark.conf.set(_STORE_KEY, before)


def run_available(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, then the batch without data that lets the
    last timers fire, and append the result to the Parquet folder ``path``."""
    query = (out.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


# ---------------------------------------------------------------- buckets

BUCKETS = 256      # a bucket should hold some thousands of open keys at most


def bucket_of(key: str, buckets: int) -> Column:
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


class BucketProcessor(StatefulProcessor):
    """Rows of a bucket in one state value, as an Arrow table. The one timer
    of a bucket is the first at which any of its rows is due."""

    columns: Sequence[str] = ()

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", "rows binary")

    def due(self, held: pd.DataFrame) -> pd.Series:
        raise NotImplementedError

    def held(self) -> pd.DataFrame:
        if not self.rows.exists():
            return pd.DataFrame({c: pd.Series(dtype=object if c == "key" else np.int64) for c in self.columns})
        with pa.ipc.open_stream(bytes(self.rows.get()[0])) as f:
            return f.read_all().to_pandas()

    def _first(self, held: pd.DataFrame) -> int | None:
        return int(self.due(held).min()) if len(held) else None

    def keep(self, held: pd.DataFrame, timer: int | None) -> None:
        """Make ``held`` the state; ``timer`` is the one now registered."""
        first = self._first(held)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.rows.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        batch = pa.RecordBatch.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as f:
            f.write_batch(batch)
        self.rows.update((sink.getvalue().to_pybytes(),))

    def expired(self, timerValues) -> pd.DataFrame:
        """Rows that are due at the watermark; the others stay."""
        held = self.held()
        if not len(held):
            return held
        done = self.due(held) <= timerValues.getCurrentWatermarkInMs()
        self.keep(held[~done], None)        # the engine has removed the timer that fired
        return held[done]

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- sessions

def merged_sessions(s: pd.DataFrame, gap: int) -> pd.DataFrame:
    """(key, start, last, n, total) with sessions of a key whose distance is
    at most ``gap`` made one, by key and start."""
    code, _ = pd.factorize(s["key"], use_na_sentinel=False)
    s = s.assign(code=code).sort_values(["code", "start"], kind="stable")
    reach = s.groupby("code")["last"].cummax().shift(1, fill_value=0)
    head = np.flatnonzero((s["code"] != s["code"].shift(1, fill_value=-1)) | (s["start"] - reach > gap))
    return pd.DataFrame({"key": s["key"].to_numpy()[head], "start": s["start"].to_numpy()[head], **{
        c: f.reduceat(s[c].to_numpy(), head) for c, f in (("last", np.maximum), ("n", np.add), ("total", np.add))}})


class SessionProcessor(BucketProcessor):
    """Open sessions: (key, start, last event, events, total), times in
    microseconds. A session is due in the first millisecond after which no
    event can belong to it."""

    columns = ("key", "start", "last", "n", "total")

    def __init__(self, gap: int):
        self.gap = gap

    def due(self, held: pd.DataFrame) -> pd.Series:
        return (held["last"] + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        held = self.held()
        timer = self._first(held)
        new = [pd.DataFrame({"key": r["key"], "start": r["us"], "last": r["us"], "n": np.int64(1),
                             "total": r["value"].fillna(0.0).astype(float)}) for r in rows]
        self.keep(merged_sessions(pd.concat([x for x in [held, *new] if len(x)], ignore_index=True), self.gap), timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = self.expired(timerValues)
        if len(done):
            yield done[list(self.columns)]


def sessions_on_timeout(stream: DataFrame, ts: str = "event_time", key: str = "user_id", value: str = "value",
                        gap_seconds: int = 1800, watermark: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """ST-03: (key, session_start, session_end, event_count, total_value) of
    every session, once, when the watermark has passed its end (its last
    event plus the gap). Events that come later than the watermark are
    dropped by the engine; an event exactly ``gap_seconds`` after the last
    one continues the session, as in :func:`windows.sessionize`. Append mode."""
    rows = stream.withWatermark(ts, watermark).select(
        bucket_of(key, buckets).alias("bucket"), F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"),
        F.col(value).cast("double").alias("value"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *(
        T.StructField(c, T.LongType()) for c in ("start", "last", "n")), T.StructField("total", T.DoubleType())])
    out = rows.groupBy("bucket").transformWithStateInPandas(SessionProcessor(gap_seconds * 1_000_000), schema, "append", "eventTime")

    def moment(us) -> F.Column:
        return F.timestamp_micros(us).cast("timestamp_ntz")
    return out.select(F.col("key").alias(key), moment("start").alias("session_start"),
                      moment(F.col("last") + gap_seconds * 1_000_000).alias("session_end"), F.col("n").alias("event_count"),
                      F.col("total").alias("total_value"))


# -------------------------------------------------------------- quarantine

class RetryProcessor(BucketProcessor):
    """Failed attempts of records, by their keys: (key, attempts, when to
    forget them). A failing arrival is one attempt; the attempt number
    ``most`` is the last one reported. A passing arrival ends the record's
    quarantine. Records that stay away are forgotten."""

    columns = ("key", "n", "until")

    def __init__(self, most: int, forget: int):
        self.most, self.forget = most, forget

    def due(self, held: pd.DataFrame) -> pd.Series:
        return held["until"]

    def handleInputRows(self, key, rows, timerValues):
        held = self.held()
        timer = self._first(held)
        null = key[0] == -1
        keys = [None] * len(held) if null else held["key"].tolist()
        attempts = dict(zip(keys, zip(held["n"].tolist(), held["until"].tolist(), strict=True), strict=True))
        arrivals = sorted(((t, f, None if null else k) for r in rows for t, f, k in zip(
            r["us"].tolist(), r["failed"].tolist(), r["key"].tolist(), strict=True)), key=lambda a: a[:2])
        out = []
        for at, failed, k in arrivals:
            n, _ = attempts.get(k, (0, None))
            if not failed:
                out.append((k, at, n, "released" if n else "passed", ""))
                attempts.pop(k, None)
                continue
            if n < self.most:
                n += 1
                out.append((k, at, n, "dead" if n == self.most else "retry", failed))
            attempts[k] = (n, at // 1000 + self.forget)
        if attempts or len(held):
            self.keep(pd.DataFrame([(k, *v) for k, v in attempts.items()], columns=list(self.columns)), timer)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "attempt", "status", "failed_rules"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = self.expired(timerValues)
        if len(done):
            yield pd.DataFrame({"key": done["key"], "us": done["until"] * 1000, "attempt": done["n"], "status": "expired", "failed_rules": ""})


def quarantine_with_retries(stream: DataFrame, rules: Sequence[RowRule], key: str, ts: str = "event_time", max_retries: int = 3,
                            watermark: str = "1 day", forget_seconds: int = 30 * 86400, buckets: int = BUCKETS) -> DataFrame:
    """ST-08: (key, arrived, attempt, status, failed_rules) of every arrival
    of a record. Status ``passed``; ``retry`` with the number of failed
    attempts so far; ``dead`` at attempt ``max_retries``, after which failing
    arrivals of the record are not reported any more; ``released`` when a
    quarantined record passes, with the attempts it took; ``expired`` when it
    has not come again for ``forget_seconds``. Append mode."""
    rows = stream.withWatermark(ts, watermark).select(
        bucket_of(key, buckets).alias("bucket"), F.col(key).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"),
        F.array_join(failed_rules(rules), ",").alias("failed"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("us", T.LongType()),
                           T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()),
                           T.StructField("failed_rules", T.StringType())])
    out = rows.groupBy("bucket").transformWithStateInPandas(RetryProcessor(max_retries, forget_seconds * 1000), schema, "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").cast("timestamp_ntz").alias("arrived"), "attempt",
                      "status", "failed_rules")
