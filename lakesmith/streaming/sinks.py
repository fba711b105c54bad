"""Micro-batch sinks: idempotent upsert, CDC, quarantine, lambda views
(SURVEY 2.12, ST-05 and ST-07..09).

``foreachBatch`` functions rewrite the buckets of the target that a
micro-batch touches and record the batch id with them; a replayed batch id
(after a driver restart the engine may re-run the last batch) is recognised
and skipped, so the sink is exactly-once without a transactional table
format.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import latest_per_key
from ..operators.rules import RowRule, split_quarantine
from ..operators.warehouse import apply_cdc, merge_upsert
from ..sources.sinks import add_commit, last_commit, path_exists


def _uri_join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


class VersionedTable:
    """A table whose rows are hashed by key into buckets. A commit writes
    the buckets that it touches to a new folder and adds a marker of its own
    (``commits/<number>``: last applied batch, schema, live folder of every
    bucket); no marker is changed or deleted, the highest one is in force,
    and of two writers with the same number one gets a conflict. Folders
    without any marker are an error, not an empty table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def state(self) -> dict | None:
        """The marker in force: number, batch, buckets (in all), schema, live."""
        top = last_commit(self.spark, self.root)
        if top is None:
            if path_exists(self.spark, _uri_join(self.root, "v*")):
                raise RuntimeError(f"{self.root} holds versions but no commit marker")
            return None
        return {"number": top[0], **json.loads(top[1])}

    def _rows(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        folders = [f for b, f in state["live"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self) -> DataFrame | None:
        state = self.state()
        return None if state is None or state["schema"] is None else self._rows(state)

    def applied(self, batch_id: int) -> bool:
        state = self.state()
        return state is not None and batch_id <= state["batch"]

    def merge(self, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], batch_id: int,
              apply: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrite the buckets that hold keys of ``changes``: each becomes
        ``apply(its rows, its changes)``, with the columns of the table (at
        first ``columns``). Returns the number of buckets rewritten."""
        state = self.state() or {"number": -1, "batch": -1, "buckets": self.buckets, "schema": None, "live": {}}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(state["buckets"])).cast("int")
        touched = {r[0] for r in changes.select(bucket).distinct().collect()}       # buckets at most
        if state["schema"] is None:
            state["schema"] = changes.select(*columns).schema.jsonValue()
        new = apply(self._rows(state, touched), changes)
        folder = _uri_join(self.root, f"v-{uuid.uuid4().hex}")
        (new.withColumn("_bucket", bucket).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(folder))
        live = {b: f for b, f in state["live"].items() if int(b) not in touched}
        for b in sorted(touched):
            if path_exists(self.spark, _uri_join(folder, f"_bucket={b}")):
                live[str(b)] = _uri_join(folder, f"_bucket={b}")
        add_commit(self.spark, self.root, state["number"] + 1, json.dumps(
            {"batch": batch_id, "buckets": state["buckets"], "schema": state["schema"], "live": live}))
        return len(touched)


def upsert_batch_fn(root: str, key: str | Sequence[str], order: Sequence[str] | None = None, buckets: int = 64
                    ) -> Callable[[DataFrame, int], None]:
    """ST-05: foreachBatch body that merges each batch into a versioned
    table by key (WH-10) and tags rows with the batch id. A batch, the first
    one too, is reduced to the latest row per key by ``order``, then by the
    remaining columns. Only buckets with keys of the batch are rewritten."""
    keys = [key] if isinstance(key, str) else list(key)

    def fn(batch: DataFrame, batch_id: int) -> None:
        t = VersionedTable(batch.sparkSession, root, buckets)
        if t.applied(batch_id):
            return                      # replay of a committed batch
        b = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        t.merge(b, keys, b.columns, batch_id,
                lambda rows, new: merge_upsert(rows, latest_per_key(new.select(*rows.columns), key, order or ()), key))
    return fn


def cdc_batch_fn(root: str, key: str, order: str, columns: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """ST-07: foreachBatch body applying change events (WH-11) to the
    buckets that hold their keys."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        t = VersionedTable(batch.sparkSession, root, buckets)
        if t.applied(batch_id):
            return
        t.merge(batch, [key], columns, batch_id, lambda rows, changes: apply_cdc(rows, changes, key, order))
    return fn


def quarantine_batch_fn(good_path: str, bad_path: str, rules: Sequence[RowRule],
                        max_retries: int = 3) -> Callable[[DataFrame, int], None]:
    """ST-08: split each batch into good rows and quarantined rows (two
    sinks), each batch in a ``batch_id`` partition of its own that a replay
    overwrites."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).cache()
        good, bad = split_quarantine(tagged, rules, max_retries)
        (good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(good_path))
        (bad.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(bad_path))
        tagged.unpersist()
    return fn


def speed_batch_fn(root: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Speed-layer body: each micro-batch is reduced to partial counts per
    key and written as its own ``batch_id`` partition with dynamic
    overwrite, so a replayed batch replaces (never duplicates) its
    partials."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        part = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))
                .withColumn("batch_id", F.lit(batch_id).cast("long")))
        (part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(_uri_join(root, "speed")))
    return fn


def start_lambda_views(stream: DataFrame, batch: DataFrame, root: str, checkpoint: str, cut: str,
                       keys: Sequence[str] = ("user_id", "event_type"), trigger_once: bool = True):
    """ST-09: events before ``cut`` form the batch view (``root/batch``);
    events from ``cut`` on stream through the speed layer
    (``root/speed``, per-batch partial counts); :func:`serve_views` merges
    the two without overlap."""
    c = F.lit(cut).cast("timestamp_ntz")
    daily = (batch.where(F.col("ts") < c).groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_event")))
    daily.write.mode("overwrite").parquet(_uri_join(root, "batch"))
    w = (stream.where(F.col("ts") >= c).writeStream.foreachBatch(speed_batch_fn(root, keys))
         .option("checkpointLocation", checkpoint))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def serve_views(spark: SparkSession, root: str, keys: Sequence[str] = ("user_id", "event_type")) -> DataFrame:
    """Serving layer: batch counts plus speed-layer partial counts per key."""
    b = spark.read.parquet(_uri_join(root, "batch")).select(*keys, "event_count")
    from pyspark.errors import AnalysisException
    try:
        s = spark.read.parquet(_uri_join(root, "speed")).select(*keys, "event_count")
    except AnalysisException:          # no micro-batch yet
        s = b.limit(0)
    return b.unionByName(s).groupBy(*keys).agg(F.sum("event_count").alias("event_count"))


def local_path(p: str) -> str:
    return os.path.abspath(p)
